"""Collocations by top-order marginalisation: only the longest word windows are counted, shorter phrases are sums.

Every word starts one window: itself and the next four words of its piece (lead columns), padded with null behind
the end of the piece. Windows are counted by language; a phrase of k words occurs as often as all windows
together that begin with it, so Spark's ROLLUP over (lang, w1, .., w5) gives every phrase of 1 to 5 words and, with
no word left, the number of all words.

Most windows are unlike any other, and a phrase under ``least`` occurrences is in no result. So two passes count
words and pairs, then triples of words in hashed buckets, and windows are padded from the first of these on whose bucket
is under ``least``: no phrase that goes on from there can reach it, a count that reaches it is not changed. A
bitmap of buckets has ``2 ** bits`` bits whatever the input (16 MB by default), and a bucket shared by chance only
leaves a window longer than need be. With more words than some 40 a bucket (5e9 for the default) fewer windows
are cut and more rows are shuffled, with the same result; more bits help.

Edge cases: a null text counts as empty and an empty one gives nothing; a null language is ``und`` together with
that name; repeated rows count again; an empty table and languages without candidates give no rows; extra
columns are ignored. Ids are not read. Whole texts are cut in batches by characters, a longer one by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import attach, table, trimmed

LEAST = 100
TOP = 2000
ORDER = 5
BITS = 27
WORDS = [f"w{k}" for k in range(1, ORDER + 1)]
#: No UTF-8 text holds this byte: it marks the ends of pieces.
END = b"\xff"


def _byte_table() -> bytes:
    """A-Z to lower case, piece ends to one mark, tabs to spaces; all other bytes stay."""
    out = bytearray(range(256))
    for b in range(ord("A"), ord("Z") + 1):
        out[b] = b + 32
    for b in b".,;:!?\x0a\x0b\x0c\x0d":
        out[b] = END[0]
    out[0x09] = 0x20
    return bytes(out)


BYTES = _byte_table()


def cut(texts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """Words of the marked texts in order as indices of a dictionary of words, -1 between pieces."""
    marked = END.join(texts).replace(END, b" \xff ")
    coded = pa.array(marked.split(), pa.binary()).dictionary_encode()
    words, at = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.flatnonzero(pc.equal(words, END).to_numpy(zero_copy_only=False))
    if len(ends):
        at[at == ends[0]] = -1
    return at, words


def _mixed(h: np.ndarray, bits: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return ((h ^ (h >> np.uint64(29))) >> np.uint64(64 - bits)).astype(np.int64)


def hashes(lang: bytes, words: pa.Array) -> np.ndarray:
    import xxhash

    seed = xxhash.xxh32_intdigest(lang)
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words.to_pylist()), np.uint64, len(words))


def buckets(at: np.ndarray, h: np.ndarray, k: int, bits: int) -> np.ndarray:
    """Bucket of the k words from each place on, -1 across an end; h are the hashes of the dictionary's words."""
    n = max(0, len(at) - k + 1)
    whole, inside, out = h[at] if len(at) else h[:0], np.ones(n, bool), np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + whole[j : j + n]
        inside &= at[j : j + n] >= 0
    return np.where(inside, _mixed(out, bits), -1)


def runs(batches, most: int = 2_000_000) -> Iterator[tuple[str, list[bytes]]]:
    """(lang, marked texts) of some ``most`` bytes each from batches of (lang, text); longer texts are cut at ends of pieces."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
        for lang, text in zip(langs, texts, strict=True):
            lang, text = "und" if lang is None else lang, (text or b"").translate(BYTES)
            while len(text) > most:
                end = text.rfind(END, 0, most)
                end = end if end >= 0 else text.find(END, most)
                if end < 0:
                    break
                yield lang, [text[:end]]
                text = text[end + 1 :]
            if text:
                held.setdefault(lang, []).append(text)
                size += len(text)
            if size > most:
                yield from held.items()
                held, size = {}, 0
    yield from held.items()


def _marked(counted: DataFrame, least: int, bits: int) -> np.ndarray:
    """The bitmap of the buckets b with at least ``least`` in all of n: 2 ** bits bits, whatever was counted."""
    often = counted.groupBy("b").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    maps = often.groupBy(F.expr("bitmap_bucket_number(b)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(b))").alias("m"))
    # Bitmap k (from 1, and one for bucket 0) holds 32,768 buckets.
    out = np.zeros(max(1, 2 ** (bits - 3)) + 8192, np.uint8)
    for k, m in maps.collect():
        start = k * 4096
        out[start : start + len(m)] |= np.frombuffer(bytes(m), np.uint8)
    return out


def seen_often(docs: DataFrame, least: int = LEAST, bits: int = BITS) -> list[np.ndarray]:
    """Bitmaps of buckets that hold at least ``least``: of words and pairs, and of triples whose pairs both do.

    Only counts of buckets are compared with ``least``, so what a bucket holds besides leaves a phrase in, never out.
    """

    def first(batches):
        for lang, texts in runs(batches):
            at, words = cut(texts)
            h = hashes(lang.encode(), words)
            single, pair = _mixed(h, bits), buckets(at, h, 2, bits)
            n = np.bincount(at[at >= 0], minlength=len(words))
            keys, times = np.unique(pair[pair >= 0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([single, keys])), pa.array(np.concatenate([n, times]))], ["b", "n"])

    pairs = _marked(docs.select("lang", "text").mapInArrow(trimmed(first), "b long, n long"), least, bits)
    shared = docs.sparkSession.sparkContext.broadcast(pairs)

    def second(batches):
        often = shared.value
        for lang, texts in runs(batches):
            at, words = cut(texts)
            h = hashes(lang.encode(), words)
            on = is_set(often, buckets(at, h, 2, bits))
            triple = buckets(at, h, 3, bits)
            keys, times = np.unique(triple[on[: len(triple)] & on[1 : 1 + len(triple)]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(times)], ["b", "n"])

    return [pairs, _marked(docs.select("lang", "text").mapInArrow(trimmed(second), "b long, n long"), least, bits)]


def is_set(bitmap: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether buckets b are marked, by the places Spark's bitmap functions give them."""
    place = np.where(b > 0, b - 1, 0)
    k = np.where(b > 0, place // 32768 + 1, 0)
    bit = np.where(b > 0, place % 32768, 0)
    return (b >= 0) & ((bitmap[k * 4096 + bit // 8] >> (bit % 8).astype(np.uint8)) & 1).astype(bool)


def windows(docs: DataFrame, bitmaps: list[np.ndarray], bits: int = BITS) -> DataFrame:
    """(lang, w1, .., w5, n): counted longest windows, padded with null from where no phrase can be frequent."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmaps)

    def run(batches):
        pairs, triples = shared.value
        for lang, texts in runs(batches):
            at, words = cut(texts)
            if not len(at):
                continue
            h = hashes(lang.encode(), words)
            word_on = np.append(is_set(pairs, _mixed(h, bits)), False)[at]
            # The k-th word belongs to the window if the two (the three) words up to it can be frequent.
            on = np.zeros((2, len(at) + ORDER), bool)
            for row, bitmap, k in ((on[0], pairs, 2), (on[1], triples, 3)):
                b = buckets(at, h, k, bits)
                row[: len(b)] = is_set(bitmap, b)
            on[0, : len(at) - 1] &= word_on[:-1] & word_on[1:]
            lead = np.full((ORDER, len(at)), -1, np.int64)
            lead[0] = np.where(word_on, at, -1)
            still = np.ones(len(at), bool)
            ahead = np.concatenate([at, np.full(ORDER, -1)])
            for k in range(1, ORDER):
                still &= on[0, k - 1 : k - 1 + len(at)]
                if k > 1:
                    still &= on[1, k - 2 : k - 2 + len(at)]
                lead[k] = np.where(still, ahead[k : k + len(at)], -1)
            lead = lead[:, at >= 0]
            if not lead.shape[1]:
                continue
            t = pa.table({w: pa.array(c, mask=c < 0) for w, c in zip(WORDS, lead, strict=True)})
            t = t.group_by(WORDS).aggregate([([], "count_all")])
            text = words.cast(pa.string(), safe=False)  # the mark, which is no UTF-8, is never taken
            cols = [text.take(t.column(w).combine_chunks()) for w in WORDS]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(t), pa.string()), *cols, t.column("count_all").combine_chunks()], ["lang", *WORDS, "n"])

    schema = "lang string, " + ", ".join(f"{w} string" for w in WORDS) + ", n long"
    return docs.select("lang", "text").mapInArrow(trimmed(run), schema).groupBy("lang", *WORDS).agg(F.sum("n").alias("n"))


def phrase_counts(docs: DataFrame, least: int = LEAST, bits: int = BITS) -> DataFrame:
    """(lang, k, phrase, f): phrases of k = 1 to 5 words with f >= least; k = 0: all words of a language."""
    top = windows(docs, seen_often(docs, least, bits), bits)
    sums = top.rollup("lang", *WORDS).agg(F.sum("n").alias("f"), F.grouping_id().alias("g"))
    # The grouping id has a bit for each column that is summed away: 2 ** (5 - k) - 1 where k words are left.
    k = F.lit(ORDER) - F.bit_count("g")
    sums = sums.where(F.col("g") < 2**ORDER).select("lang", k.alias("k"), F.array(*WORDS).alias("w"), "f")
    # Padding stands behind the last word, so a phrase is whole when its last word is one.
    whole = (F.col("k") == 0) | (F.get("w", F.col("k") - 1).isNotNull() & (F.col("f") >= least))
    return sums.where(whole).select("lang", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("phrase"), "f")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, bits: int = BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases; see the contract of op13."""
    counts = table(phrase_counts(docs, least, bits))
    known = counts.where("k > 0").select("lang", "phrase", "f")
    all_words = counts.where("k = 0").select("lang", F.col("f").alias("n"))
    longer = counts.where("k > 1").withColumn("w", F.split("phrase", " "))
    part = lambda start, n: F.array_join(F.slice("w", start, n), " ")

    # If a longer phrase is as frequent, so is each one between: one more word to the left or right tells.
    ends = F.array(part(F.lit(1), F.col("k") - 1), part(F.lit(2), F.col("k") - 1))
    around = longer.where("k > 2").select("lang", F.explode(ends).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    kept = longer.withColumnRenamed("f", "a").join(around, ["lang", "phrase"], "left")
    kept = kept.where(F.col("around").isNull() | (F.col("around") < F.col("a")))

    cuts = kept.select("lang", "phrase", "a", "k", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = table(cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("first"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest")))
    for side, name in (("first", "l"), ("rest", "r")):
        uses = cuts.groupBy("lang", side).agg(F.count(F.lit(1)).alias("copies"))
        facts = uses.join(known.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
        cuts = attach(cuts, table(facts), ["lang", side], "copies")
    facts = all_words.join(cuts.groupBy("lang").agg(F.count(F.lit(1)).alias("copies")), "lang")
    cuts = attach(cuts, table(facts), ["lang"], "copies")
    return ranked(cuts, top)


def ranked(cuts: DataFrame, top: int) -> DataFrame:
    """The best phrases from (lang, phrase, a, cut, l, r, n). Products are decimals of 38 digits: exact for corpora of up to 1e17 words."""
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    product = (wide("a") * wide("n")).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)")
    cuts = cuts.withColumn("p", product.cast("decimal(38,0)")).withColumn("q", (wide("l") * wide("r")).cast("decimal(38,0)"))
    cuts = cuts.withColumn("score", F.expr("p div q"))
    lowest = F.min(F.struct("score", "cut", "l", "r")).alias("m")
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(lowest).select("lang", "phrase", "a", "m.l", "m.r", "n", "m.score")
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    longs = [F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")]
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", *longs)


SQL = r"""
with pieces as (
  select coalesce(lang, 'und') lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) p
  from documents)
, w as (select lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') ws from pieces)
, g as (
  select lang, k, ws[i : i + k - 1] ws, array_to_string(ws[i : i + k - 1], ' ') phrase, count(*) f
  from w, unnest(range(1, 6)) a(k), unnest(range(1, len(ws) - k + 2)) b(i) group by all)
, n as (select lang, sum(f)::bigint n from g where k = 1 group by lang)
, c as (select * from g where k > 1 and f >= 100)
, inside as (
  select lang, array_to_string(ws[i : i + j - 1], ' ') phrase, max(f) f
  from c, unnest(range(2, k)) a(j), unnest(range(1, k - j + 2)) b(i) group by all)
, good as (select c.* from c left join inside x using (lang, phrase) where x.f is null or 100 * x.f < 100 * c.f)
, cuts as (
  select c.lang, c.phrase, c.f a, p.f l, q.f r, n.n, cut, (1000::hugeint * c.f * n.n) // (p.f::hugeint * q.f) score
  from good c, unnest(range(1, c.k)) t(cut)
  join g p on p.lang = c.lang and p.phrase = array_to_string(c.ws[1 : cut], ' ')
  join g q on q.lang = c.lang and q.phrase = array_to_string(c.ws[cut + 1 : c.k], ' ')
  join n on n.lang = c.lang)
, best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, cut) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score::bigint score
from best qualify rank <= 2000
"""
