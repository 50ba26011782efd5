"""Near-duplicate documents by min-max hashing.

Every permutation yields two signature values, the minimum and the maximum of a set's hashes, so n values
cost n / 2 hash evaluations. Bands of ``rows`` values (rows / 2 permutations, both ends) are bucket keys.
Two sets with c of u elements in common agree in both ends of a permutation with probability
c (c - 1) / (u (u - 1)). With the defaults, 60 bands of 8, a pair at similarity 0.8 shares no bucket with
probability 1.6e-5 in large sets and 2.1e-5 in the smallest ones that bands are used for (44 of 55).

Sets of up to ``small`` shingles, where the ends depend on each other and nothing must be missed, and those
that could be linked with one of them, get exact keys instead: with all elements ordered by the number of
sets that hold them, two linked sets share one of their first n - ceil(0.8 n) + 1 (prefix filtering).

Equal sets are one node. In every bucket each node is paired with the bucket's smallest id, pairs are
confirmed on full sets, and components are formed. A second, exact round takes the buckets that still hold
several components and confirms every pair across components that can be a link at all, so no link in a
bucket is lost, while members of one component are never paired; the nodes of a large bucket are dealt over
several tasks. What can't be a link is known from a
parity bitmap of each set: every element in one set alone flips one bit, so the bits in which two bitmaps
differ never outnumber the symmetric difference, which similarity s allows (1 - s) / (1 + s) of both sizes.

Edge cases: a text without words (or null) has the empty set, size 0, and links with nothing; repeated
rows and equal texts form one component; a null id gets no component and is kept; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Memo, attach, components, discard, table, trimmed

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles, words lower-cased in A-Z and cut at ASCII white space."""

    def __init__(self, words: int):
        self.words = words
        self.memo = Memo(lambda new: [xxhash.xxh3_64_intdigest(w) for w in new])

    def __call__(self, text: str | None) -> np.ndarray:
        found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not found:
            return np.zeros(0, np.uint64)
        known = self.memo.learn(set(found))
        h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
        n = min(self.words, len(h))
        out = _mix(h[: len(h) - n + 1] + np.uint64(n))
        for i in range(1, n):
            out = _mix(out * _P + h[i : len(h) - n + 1 + i])
        return np.unique(out)


def _bands(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """A bucket key for each non-empty set and band."""
    cuts = np.cumsum([0, *map(len, sets)])[:-1]
    x = np.concatenate(sets)
    seeds = _mix(np.arange(1, 2 * bands * (rows // 2) + 1, dtype=np.uint64) * _Q)
    out = np.empty((len(sets), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(sets), b, np.uint64)
        for r in range(rows // 2):
            i = 2 * (b * (rows // 2) + r)
            h = (x ^ seeds[i]) * (seeds[i + 1] | np.uint64(1))
            h ^= h >> np.uint64(32)
            key = _mix(key * _P + np.minimum.reduceat(h, cuts))
            key = _mix(key * _P + np.maximum.reduceat(h, cuts))
        out[:, b] = key
    return out.view(np.int64)


BITS = 16  # longs of a parity bitmap


def _parity(sets: list[np.ndarray]) -> np.ndarray:
    """A bitmap for each set: bit h counts, modulo 2, the elements that hash there."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    bit = (_mix(np.concatenate(sets) ^ _Q) >> np.uint64(54)).astype(np.int64)
    odd = np.bincount(owner * 1024 + bit, minlength=len(sets) * 1024) & 1
    return np.packbits(odd.astype(np.uint8).reshape(len(sets), 1024), axis=1).view(np.int64)


def signatures(docs: DataFrame, words: int = 2, percent: int = 80, bands: int = 60, rows: int = 8, small: int = 40) -> DataFrame:
    """(doc_id, n_shingles, digest, keys, bits, members): set size, and 128-bit digest, bucket keys (null up to ``small``),
    parity bitmap and, where a set of up to ``small`` could be linked with it, the set itself (all null if empty)."""
    most = small * 100 // percent

    def run(batches):
        shingle = Shingler(words)
        for batch in batches:
            n = batch.num_rows
            at, size, digest, keys = 0, [], [], []
            ids = batch.column(0)
            while at < n:
                sets, held = [], 0
                while at + len(sets) < n and held < 200_000:
                    sets.append(shingle(batch.column(1)[at + len(sets)].as_py()))
                    held += len(sets[-1])
                full, large = [s for s in sets if len(s)], [s for s in sets if len(s) > small]
                found = iter(_bands(large, bands, rows)) if large else iter(())
                size = [len(s) for s in sets]
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                keys = [next(found) if len(s) > small else None for s in sets]
                own = [s.view(np.int64) if 0 < len(s) <= most else None for s in sets]
                maps = iter(_parity(full)) if full else iter(())
                bits = [next(maps) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(sets)), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64())), pa.array(own, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "keys", "bits", "members"])
                at += len(sets)

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), "doc_id long, n_shingles long, digest binary, keys array<long>, bits array<long>, members array<long>")


def prefix_keys(sets: DataFrame, percent: int) -> DataFrame:
    """(node, key) of (node, n, members): the rarest elements of each set, as many as linked sets must share one of."""
    elements = sets.select("node", "n", F.explode("members").alias("element"))
    counted = elements.groupBy("element").agg(F.count(F.lit(1)).alias("sets")).withColumn("times", F.col("sets"))
    ranked = attach(elements, counted, ["element"], "sets")
    # A node has no more than the elements of a small set.
    rank = F.row_number().over(W.partitionBy("node").orderBy("times", "element"))
    first = ranked.withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1)
    return first.select("node", F.xxhash64("element", F.lit(7)).alias("key"))


def _sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(node, digest, set) of the documents whose ids are wanted."""

    def run(batches):
        shingle = Shingler(words)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                sets = [shingle(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "members"])

    # A merge join at every size: the wanted ids grow with the documents.
    wanted = docs.select("doc_id", "text").join(ids.hint("merge"), F.col("doc_id") == F.col("node"), "left_semi")
    return wanted.mapInArrow(trimmed(run), "node long, members array<long>")


def _possible(percent: int, a: str = "a", b: str = "b"):
    """Whether sizes and bitmaps of two nodes leave room for a link."""
    n, m = F.col(f"{a}_n"), F.col(f"{b}_n")
    apart = F.lit(0)
    for k in range(BITS):
        apart = apart + F.bit_count(F.col(f"{a}_{k}").bitwiseXOR(F.col(f"{b}_{k}")))
    return (F.least(n, m) * 100 >= percent * F.greatest(n, m)) & (apart * (100 + percent) <= (n + m) * (100 - percent))


def _side(facts: DataFrame, name: str) -> DataFrame:
    return facts.select(F.col("node").alias(name), F.col("n").alias(f"{name}_n"), *[F.col(f"bits_{k}").alias(f"{name}_{k}") for k in range(BITS)])


def _confirm(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    left = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("members").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("members").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common * 100 >= percent * (F.size("x") + F.size("y") - common)).select("a", "b")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 60, rows: int = 8, small: int = 40, block: int = 512) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per document, linked at Jaccard >= percent / 100."""
    sig = table(signatures(docs, words, percent, bands, rows, small))
    full = sig.where("digest is not null and doc_id is not null")
    nodes = full.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies"))
    # A row stands for its set if it has the set's smallest id; repeated ids are harmless here.
    stand = full.join(nodes.select(F.col("digest").alias("d"), "node"), (F.col("digest") == F.col("d")) & (F.col("doc_id") == F.col("node")))
    few = stand.where("members is not null").select("node", F.col("n_shingles").alias("n"), "members").dropDuplicates(["node"])
    few = table(few)
    entries = stand.select("node", F.explode("keys").alias("key")).union(prefix_keys(few, percent))
    hubs = entries.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    shared = table(entries.join(hubs.hint("merge"), "key").select("key", "node", "low"))
    ids = shared.select("node").distinct()
    facts = table(stand.select("node", F.col("n_shingles").alias("n"), *[F.get("bits", F.lit(k)).alias(f"bits_{k}") for k in range(BITS)]).join(ids, "node", "left_semi").dropDuplicates(["node"]))
    sets = table(_sets(docs, ids, words))

    pairs = shared.where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct()
    pairs = pairs.join(_side(facts, "a"), "a").join(_side(facts, "b"), "b").where(_possible(percent))
    links = table(_confirm(sets, pairs, percent))
    found = components(links)

    root = found.withColumnRenamed("node", "n")
    label = table(shared.select("key", "node").join(root, F.col("node") == F.col("n"), "left").select("key", "node", F.coalesce("root", "node").alias("root")))
    mixed = label.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")).where("r0 <> r1").select("key", "blocks")
    left = label.join(mixed.hint("merge"), "key")
    left = table(left.join(_side(facts, "node"), "node"))
    names = {c: c.replace("node", "other").replace("root", "other_root") for c in left.columns if c not in ("key", "blocks")}
    # A node of a large bucket is in one block of it and meets all others there.
    right = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks").withColumnsRenamed(names)
    mine = left.withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int")).drop("blocks")
    # The bound is a condition of the join itself: pairs that can't be links are never made.
    across = mine.join(right.hint("merge"), (mine["key"] == right["key"]) & (mine["block"] == right["block"]) & (mine["node"] < right["other"]) & (mine["root"] != right["other_root"]) & _possible(percent, "node", "other"))
    across = across.select(F.col("node").alias("a"), F.col("other").alias("b")).distinct()
    more = table(_confirm(sets, across.join(links, ["a", "b"], "left_anti"), percent))
    if not more.isEmpty():
        found = components(links.union(more))
    discard(shared, facts, sets, left, few)

    roots = table(nodes.join(found.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select("digest", "copies", F.coalesce("root", "node").alias("root")))
    rows_ = sig.select("doc_id", "n_shingles", "digest")
    out = attach(rows_.where("digest is not null and doc_id is not null"), roots, ["digest"], "copies")
    alone = rows_.where("digest is null or doc_id is null").withColumn("root", F.lit(None).cast("long"))
    out = out.unionByName(alone)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay: one, with the smallest id, of each group of near-duplicates.

    A repeated row (same id and text) stays once; rows without an id stay.
    """
    kept = near_duplicates(docs, **options).where("kept and doc_id is not null").select("doc_id").distinct().alias("kept")
    own = docs.alias("own")
    stay = own.join(kept, F.col("own.doc_id") == F.col("kept.doc_id"), "left_semi")
    return stay.dropDuplicates(["doc_id", "text"]).union(docs.where("doc_id is null"))
