"""Nearest neighbours by multi-index hashing over learned rotated binary codes.

Codes: vectors are lifted so that the largest inner product is the smallest angle (one more coordinate
evens out the norms), centred, rotated by principal axes and an iteratively quantised rotation (ITQ), and
cut to signs. Both are fitted on a bounded sample of rows. A code is split into substrings of two bytes, each
indexed by a table. Codes within Hamming distance r of a query share, by the pigeonhole principle, a
substring within r // substrings; the buckets of such values are probed in every table, the retrieved codes are
checked against r, and what is within is reranked by the inner product of the original vectors in double
precision. Long codes make the radius selective: on vectors without any structure (see the README's figures)
256 bits rerank a few hundredths of the rows where 64 bits rerank a fifth. Where the probed buckets would hold
half as many entries as there are rows (a wide radius), the codes are checked one after the other.

The radius is stepped. The widest is the smallest that holds the wanted share of true neighbours of sample queries,
measured within the sample (true neighbours there lie farther than in the full table, so this errs on the wide side).
The sample also tells the highest cosine that codes beyond each radius had: a query stops at the first radius beyond
which nothing came near its k-th score, so queries with close neighbours never leave the index. Steps at which no
sample query could have stopped are left out.

Rows are dealt over shards, queries over blocks, by hashes. About the square root of the number of shards is
searched first; a query's k-th score there is a bound that the other shards' hits must reach, so what they pass on stays
few, and with it the radius that a query needs there. A query that finds fewer than k within r in a first shard is
widened there until it has them. Memory per task: one shard and one block of queries.

Edge cases: null, zero or non-finite vectors and rows with null ids take no part; a table with one usable
vector gives no rows; ties go to the smaller id; a repeated id is a candidate once per row and never its
own neighbour; components of any finite size are scaled before codes are made; extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import smallest_hashes, table
from .embedding_dedup import usable


COUNTS = ("reranked", "probed", "scanned")


class Codes:
    """Sign codes after a learned rotation; ``bits`` is a multiple of 64 and every byte is a substring.

    More bits than axes take further rotations, each of them fitted from a start of its own.
    """

    def __init__(self, x: np.ndarray, bits: int, rounds: int = 30):
        self.unit = float(np.abs(x).max())
        x = x / self.unit
        self.top = float((x * x).sum(1).max())
        y = self._lift(x, False)
        self.mean = y.mean(0)
        y = y - self.mean
        _, axes = np.linalg.eigh(y.T @ y)
        axes = axes[:, ::-1][:, : min(bits, y.shape[1])]
        v = y @ axes
        turns, draw = [], np.random.default_rng(3)
        while sum(t.shape[1] for t in turns) < bits:
            r, _ = np.linalg.qr(draw.standard_normal((v.shape[1], v.shape[1])))
            for _ in range(rounds):
                u, _, t = np.linalg.svd(v.T @ np.where(v @ r >= 0, 1.0, -1.0), full_matrices=False)
                r = u @ t
            turns.append(axes @ r)
        self.turn = np.hstack(turns)[:, :bits]

    def _lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        """One coordinate more, in which rows get what their length lacks; queries get 0 there and full length."""
        if query:
            x = x / np.abs(x).max(1, keepdims=True)
            return np.hstack([x * (np.sqrt(self.top) / np.linalg.norm(x, axis=1, keepdims=True)), np.zeros((len(x), 1))])
        return np.hstack([x, np.sqrt(np.maximum(0, self.top - (x * x).sum(1)))[:, None]])

    def cosines(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Cosines of lifted queries and rows: inner products over the longest length a row can have."""
        return (q / np.linalg.norm(q / np.abs(q).max(1, keepdims=True), axis=1, keepdims=True) / np.abs(q).max(1, keepdims=True)) @ (x / self.unit).T / np.sqrt(self.top)

    def __call__(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        # A row beyond the sample's lengths counts as one of the largest length.
        if not query:
            x = np.clip(x / self.unit, -1e100, 1e100)
        return np.packbits((self._lift(x, query) - self.mean) @ self.turn >= 0, axis=1)


def distances(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes.view(np.uint64) ^ code.view(np.uint64)).sum(1, dtype=np.int64)


class MultiIndex:
    """One table per substring of two bytes (of one in codes of 64 bits or less): rows in the order of their value there,
    with bucket bounds.

    ``probed`` and ``scanned`` count the codes that were looked at, through buckets and one after the other.
    """

    def __init__(self, codes: np.ndarray):
        self.codes = np.ascontiguousarray(codes)
        self.width = 16 if codes.shape[1] > 8 else 8
        self.parts = self.codes.view(np.uint16 if self.width == 16 else np.uint8)
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        self.probed = self.scanned = 0

    def probe(self, code: np.ndarray, flips: int) -> np.ndarray:
        """Rows that share some substring within ``flips`` bits with the code."""
        if not self.tables:
            for c in self.parts.T:
                order = np.argsort(c, kind="stable")
                self.tables.append((order, np.searchsorted(c[order], np.arange(2**self.width + 1))))
        hit = np.zeros(len(self.codes), bool)
        masks = flipped(flips, self.width)
        for value, (order, bounds) in zip(code.view(self.parts.dtype), self.tables, strict=True):
            v = masks ^ int(value)
            for s, e in zip(bounds[v].tolist(), bounds[v + 1].tolist(), strict=True):
                if s < e:
                    hit[order[s:e]] = True
        return np.flatnonzero(hit)

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose codes are within the radius: pigeonhole probes of every table, then the check."""
        m = self.parts.shape[1]
        flips = min(self.width, radius // m)
        if too_many(m, flips, self.width):  # the buckets hold half as many entries as there are rows, or more
            self.scanned += len(self.codes)
            return np.flatnonzero(distances(self.codes, code) <= radius)
        rows = self.probe(code, flips)
        self.probed += len(rows)
        return rows[distances(self.codes[rows], code) <= radius]


def too_many(substrings: int, flips: int, width: int) -> bool:
    """Whether the probed buckets of all tables make up half of one table or more."""
    return substrings * sum(math.comb(width, k) for k in range(flips + 1)) >= 2 ** (width - 1)


@lru_cache(maxsize=32)
def flipped(flips: int, width: int) -> np.ndarray:
    """All patterns of at most so many bits."""
    v = np.arange(2**width)
    return v[np.bitwise_count(v) <= flips]


class Reach:
    """How far to look, learnt on a sample: ``radius`` holds ``share`` of the k nearest of sample queries, and
    ``beyond[r]`` is the highest cosine (of lifted vectors) that codes farther than r had. A query whose k-th cosine is as
    high needs to look no farther than r; ``steps`` are the radii within the tables' reach at which some sample query could have stopped."""

    def __init__(self, x: np.ndarray, codes: Codes, k: int, share: float, queries: int = 200):
        c, q = codes(x), codes(x[:queries], True)
        with np.errstate(all="ignore"):
            s = codes.cosines(x[:queries], x)
        own = np.arange(len(s))
        s[own, own] = -np.inf
        top = np.argsort(-s, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
        far = np.stack([distances(c, one) for one in q]) if len(q) else np.zeros((0, len(x)), np.int64)
        d = np.sort(np.take_along_axis(far, top, 1).ravel())
        self.radius = int(d[min(len(d) - 1, int(np.ceil(share * len(d))))]) if len(d) else 0
        bits = 8 * c.shape[1]
        best = np.full(bits + 1, -np.inf)
        np.maximum.at(best, far.ravel(), s.ravel())
        self.beyond = np.append(np.maximum.accumulate(best[:0:-1])[::-1], -np.inf)  # of distances over r
        last = np.take_along_axis(s, top[:, -1:], 1)[:, 0] if top.size else np.zeros(0)
        index = MultiIndex(c)
        parts = index.parts.shape[1]
        grid = [r for r in range(parts - 1, self.radius, parts) if not too_many(parts, r // parts, index.width)]
        self.steps = [r for r in grid if (last >= self.beyond[r]).any()]

    def needed(self, cosine: float) -> int:
        """The least radius for a known k-th cosine, the common one at most."""
        ok = np.flatnonzero(self.beyond <= cosine)
        return min(self.radius, int(ok[0])) if len(ok) else self.radius


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, bits: int = 256, sample: int = 4000, share: float = 0.97, shard: int = 16_384, block: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score, reranked, probed, scanned): the k nearest found for each (query_id, embedding) of queries.

    reranked is the number of rows whose inner product with the query was taken, probed that of codes looked at through
    the index, scanned that of codes looked at one after the other.
    """
    schema = "query_id long, rank int, vec_id long, score double, " + ", ".join(f"{c} long" for c in COUNTS)
    rows = table(vectors.where(usable() & F.col("vec_id").isNotNull()).select("vec_id", F.col("embedding").cast("array<double>").alias("x"), F.size("embedding").alias("d")))
    asked = queries.where(usable() & F.col("query_id").isNotNull()).select("query_id", F.col("embedding").cast("array<double>").alias("x"), F.size("embedding").alias("d"))
    found = None
    for d, n in sorted((r[0], r[1]) for r in rows.groupBy("d").count().collect()):  # a row per length of vectors
        part = _search(rows.where(F.col("d") == d).drop("d"), asked.where(F.col("d") == d).drop("d"), n, k, bits, sample, share, shard, block)
        found = part if found is None else found.union(part)
    if found is None:
        return rows.sparkSession.createDataFrame([], schema)
    best = _best(found, k).join(found.groupBy("query_id").agg(*[F.sum(c).alias(f"all_{c}") for c in COUNTS]), "query_id")
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", *[F.col(f"all_{c}").alias(c) for c in COUNTS])


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, by shards first: no more than k rows of a shard meet."""
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.where("vec_id is not null").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _search(rows: DataFrame, asked: DataFrame, n: int, k: int, bits: int, sample: int, share: float, shard: int, block: int) -> DataFrame:
    x = np.array(smallest_hashes(rows, "vec_id", sample, 9).select("x").toArrow().column(0).to_pylist(), float)
    codes = Codes(x, bits)
    reach = Reach(x, codes, k, share)
    shards, blocks = max(12, -(-n // shard)), max(1, -(-asked.count() // block))
    first = int(np.ceil(np.sqrt(shards)))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(blocks)))
    schema = "query_id long, vec_id long, score double, " + ", ".join(f"{c} long" for c in COUNTS)

    def probe(own: pa.Table, wanted: pa.Table, quick: int) -> pa.Table:
        out = []
        if own.num_rows and wanted.num_rows:
            own = own.sort_by("vec_id")
            v, ids = _matrix(own["x"]), own["vec_id"].to_numpy()
            index = MultiIndex(codes(v))
            q = _matrix(wanted["x"])
            long = np.sqrt(codes.top) * codes.unit
            for one, code, qid, bound in zip(q, codes(q, True), wanted["query_id"].to_numpy(), wanted["bound"].to_numpy(), strict=True):
                length = np.abs(one).max() * np.linalg.norm(one / np.abs(one).max())
                cosine = lambda score: score / length / long  # noqa: E731, B023
                index.probed = index.scanned = taken = 0
                known = bound == bound
                # With a bound the radius follows from it; without one k rows are needed from here, wherever they lie.
                one_look = [quick] if quick >= 0 else [reach.needed(cosine(bound))] if known else None
                for r in one_look or [*reach.steps, *range(reach.radius, bits + 8, 8)]:
                    hit = index.within(code, min(r, bits))
                    hit = hit[ids[hit] != qid]
                    if not one_look and len(hit) < k and r < bits:
                        continue
                    score = (v[hit] * one).sum(1)
                    taken = len(hit)
                    if one_look or r >= reach.radius or cosine(np.partition(score, -k)[-k]) >= reach.beyond[r]:
                        break
                good = np.flatnonzero(~(score < bound))
                best = good[np.lexsort((ids[hit[good]], -score[good]))[:k]]
                zero = np.zeros(len(best), np.int64)
                out.append((np.full(len(best), qid), ids[hit[best]], score[best], zero, zero, zero))
                out.append((np.array([qid]), None, None, np.array([taken]), np.array([index.probed]), np.array([index.scanned])))
        cols = [pa.chunked_array([pa.array(o[i]) if o[i] is not None else pa.nulls(len(o[0]), t) for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()))]
        return pa.Table.from_arrays(cols, ["query_id", "vec_id", "score", *COUNTS])

    def met(low: int, high: int, seek: DataFrame, quick: int = -1) -> DataFrame:
        own = rows.where(F.col("shard").between(low, high - 1)).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        seek = seek.withColumn("shard", F.explode(F.sequence(F.lit(low).cast("long"), F.lit(high - 1).cast("long"))))
        own = own.select("shard", "block", "vec_id", "x").groupBy("shard", "block")
        return own.cogroup(seek.select("shard", "block", "query_id", "x", "bound").groupBy("shard", "block")).applyInArrow(lambda a, b: probe(a, b, quick), schema)

    def bounded(found: DataFrame | None) -> DataFrame:
        if found is None:
            return asked.withColumn("bound", F.lit(float("nan")))
        bounds = _best(found, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        return asked.join(bounds, "query_id", "left").withColumn("bound", F.coalesce("least", F.lit(float("nan")))).drop("least")

    # Where some queries can stop within the reach of the tables, a look at these alone gives them a bound to begin with.
    early = table(met(0, first, bounded(None), reach.steps[-1])) if reach.steps else None
    near = table(met(0, first, bounded(early)))
    out = near.unionByName(met(first, shards, bounded(near)))
    return out if early is None else out.unionByName(early.where("vec_id is null"))  # its rows are found again, its counts stay


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy().reshape(len(lists), -1)
