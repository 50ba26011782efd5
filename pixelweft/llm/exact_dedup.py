"""Exact duplicates by a heavy-hitter split, with DataFrame and SQL functions only.

Texts are equal when they are identical after every run of white space (space, tab to carriage return) became
one space; equality is that of SHA-256 digests. Of equal texts the row with the smallest doc_id stays.

A digest that many rows share would put them all into one task of a shuffle. Misra-Gries counters (the frequent
items sketch behind approx_top_k, a sketch a task, merged in two levels) name every digest that more than a
``few``-th part of all rows has, and some others. A second pass counts the named ones exactly and finds their
smallest doc_id: those that really pass the share, fewer than ``few``, are the verified winners. They are
broadcast and settle their rows where they lie. All other rows are shuffled by digest and meet in a window, in
which no digest has more than that share. What the sketch names never decides a result, only the way it is got.

Edge cases: a null text counts as empty, and an empty text differs from white space alone (one space). Null ids
are counted; one is kept only where no row of its group has an id. Repeated rows of the staying doc_id are all
marked kept (``keep`` leaves one of them). An empty table gives no rows. Extra columns are ignored by
``exact_duplicates`` and returned by ``keep``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

FEW = 1000
COUNTERS = 8192


def text_sha256(text: Column) -> Column:
    """Lowercase hex digest of the text with its white space made even."""
    even = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return F.sha2(even.cast("binary"), 256)


def frequent(rows: DataFrame, few: int = FEW, counters: int = COUNTERS, fan: int = 64) -> DataFrame:
    """(text_sha256): at most 2 * few digests, all those among them that more than a few-th part of the rows has.

    A sketch of c counters is off by at most 3.5 / c of the rows and names what passes twice that, so c has to
    be more than 7 * few. Each task keeps one sketch; ``fan`` tasks merge them before the last one does.
    """
    if counters <= 7 * few:
        raise ValueError("too few counters for the share")
    dealt = rows.select("text_sha256", (F.spark_partition_id() % fan).alias("part"))
    parts = dealt.groupBy("part").agg(F.expr(f"approx_top_k_accumulate(text_sha256, {counters})").alias("sketch"))
    # All parts have the key 0; with a key tasks without rows make no sketch, which could not be merged.
    whole = parts.groupBy(F.expr(f"part div {fan}").alias("all")).agg(F.expr(f"approx_top_k_combine(sketch, {counters})").alias("sketch"))
    return whole.select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {2 * few})")).alias("f")).select(F.col("f.item").alias("text_sha256"))


def winners(rows: DataFrame, few: int = FEW) -> DataFrame:
    """(text_sha256, keep_id, group_size) of the digests that more than a few-th part of the rows has: fewer than few rows."""
    total = rows.count()
    named = frequent(rows, few) if total else rows.select("text_sha256").limit(0)
    exact = rows.join(F.broadcast(named), "text_sha256", "left_semi").groupBy("text_sha256")
    return exact.agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where(F.col("group_size") * few > total)


def exact_duplicates(docs: DataFrame, few: int = FEW) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row per row of docs. Texts are read once."""
    rows = table(docs.select("doc_id", text_sha256(F.col("text")).alias("text_sha256")))
    heavy = table(winners(rows, few))
    settled = rows.join(F.broadcast(heavy), "text_sha256")
    group = W.partitionBy("text_sha256")
    others = rows.join(F.broadcast(heavy.select("text_sha256")), "text_sha256", "left_anti")
    others = others.withColumn("keep_id", F.min("doc_id").over(group)).withColumn("group_size", F.count(F.lit(1)).over(group))
    out = settled.unionByName(others)
    return out.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, one of each group of equal texts, with all their columns."""
    labels = exact_duplicates(docs).where("kept").select(F.col("doc_id").alias("_pixelweft_stays"), F.col("text_sha256").alias("_pixelweft_of"))
    named = docs.withColumn("_pixelweft_sha", text_sha256(F.col("text")))
    same = (F.col("_pixelweft_sha") == F.col("_pixelweft_of")) & F.col("doc_id").eqNullSafe(F.col("_pixelweft_stays"))
    return named.join(labels, same, "left_semi").dropDuplicates(["_pixelweft_sha"]).drop("_pixelweft_sha")


SQL = r"""
with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) text_sha256 from documents)
select doc_id, min(doc_id) over w keep_id, count(*) over w group_size,
  doc_id is not distinct from min(doc_id) over w kept, text_sha256
from d window w as (partition by text_sha256)
"""
