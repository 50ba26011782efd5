"""Preference formatting: one prompt and two masked completions from a chosen and a rejected conversation.

The longest common turn prefix is rendered once as prompt (mask 0); what follows on either side is that
side's completion, in which assistant turns have mask 1 and other turns mask 0. Everything is row-level,
one row per rendered turn with its character offsets, so a conversation of any length is never gathered;
``assembled`` joins the turns of ordinary pairs into strings.

Edge cases: rows with a null conversation or turn are left out; exact repeats of a row count once; rows
that share a turn number follow each other by role and text; null roles and texts are empty strings; a side
without turns has no completion rows; a pair whose sides are equal is all prompt; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import running, table

START, END = "<|im_start|>", "<|im_end|>\n"


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END))


def positions(turns: DataFrame, span: int = 512) -> DataFrame:
    """(conv_id, pos, role, text): distinct turns numbered from 0 within their conversation."""
    rows = turns.where("conv_id is not null and turn is not null")
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    # Written once: the running sum reads its rows twice.
    return running(table(rows), ["conv_id"], F.floor(F.col("turn") / span), ["turn", "role", "text"], "pos", F.lit(1))


def preference(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, part, pos, role, rendered, loss_mask, start, end) for pairs (pair_id, chosen, rejected).

    part is prompt, chosen or rejected; pos counts turns in the conversation; start and end are
    characters within the part.
    """
    sides = pairs.select("pair_id", F.explode(F.array(F.struct(F.lit("chosen").alias("side"), F.col("chosen").alias("conv_id")), F.struct(F.lit("rejected").alias("side"), F.col("rejected").alias("conv_id")))).alias("s")).select("pair_id", "s.side", "s.conv_id")
    rows = table(positions(turns).join(sides, "conv_id").select("pair_id", "side", "pos", "role", "text"))
    turn = F.struct("role", "text")
    met = rows.groupBy("pair_id", "pos").agg(F.count(F.lit(1)).alias("n"), F.min(turn).alias("a"), F.max(turn).alias("b"))
    split = met.groupBy("pair_id").agg(F.min(F.when((F.col("n") < 2) | (F.col("a") != F.col("b")), F.col("pos"))).alias("common"))
    rows = rows.join(split, "pair_id").where((F.col("side") == "chosen") | (F.col("pos") >= F.col("common")))
    shared = F.col("common").isNull() | (F.col("pos") < F.col("common"))
    rows = rows.select("pair_id", F.when(shared, "prompt").otherwise(F.col("side")).alias("part"), "pos", "role", rendered(F.col("role"), F.col("text")).alias("rendered"), (~shared & (F.col("role") == "assistant")).cast("int").alias("loss_mask"))
    rows = running(table(rows), ["pair_id", "part"], F.floor(F.col("pos") / 512), ["pos"], "start", F.length("rendered"))
    return rows.select("pair_id", "part", "pos", "role", "rendered", "loss_mask", "start", (F.col("start") + F.length("rendered")).alias("end"))


def neighbours(turns: DataFrame) -> DataFrame:
    """Pairs of conversations 2p (chosen) and 2p + 1 (rejected): the table names no preferences."""
    ids = turns.where("conv_id is not null").select("conv_id").distinct()
    p = F.shiftright(F.col("conv_id").cast("long"), 1)  # whole numbers throughout: ids may pass 2 ** 53
    return ids.select(p.alias("pair_id")).distinct().select("pair_id", (F.col("pair_id") * 2).alias("chosen"), (F.col("pair_id") * 2 + 1).alias("rejected"))


def assembled(rows: DataFrame) -> DataFrame:
    """(pair_id, prompt, chosen, rejected, chosen_spans, rejected_spans): whole strings, for pairs that fit a row."""
    turn = F.sort_array(F.collect_list(F.struct("pos", "rendered", "loss_mask", "start", "end")))
    parts = rows.groupBy("pair_id", "part").agg(turn.alias("t"))
    text = F.array_join(F.transform("t", lambda x: x["rendered"]), "")
    spans = F.transform(F.filter("t", lambda x: x["loss_mask"] == 1), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    one = lambda part, col: F.max(F.when(F.col("part") == part, F.col(col)))
    parts = parts.select("pair_id", "part", text.alias("text"), spans.alias("spans"))
    empty = F.lit("")
    return parts.groupBy("pair_id").agg(F.coalesce(one("prompt", "text"), empty).alias("prompt"), F.coalesce(one("chosen", "text"), empty).alias("chosen"), F.coalesce(one("rejected", "text"), empty).alias("rejected"), one("chosen", "spans").alias("chosen_spans"), one("rejected", "spans").alias("rejected_spans"))
