"""Shared plumbing: tables in the shared folder, components of a link graph, text tallies in workers."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_written: dict[str, SparkSession] = {}
_registered: list = []
_own_root: list[str] = []


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only a session in one process may do without."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own_root:
            _own_root.append("file://" + tempfile.mkdtemp(prefix="pixelweft-"))
        root = _own_root[0]
    return root.rstrip("/")


def table(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/pixelweft/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _registered:
        _registered.append(atexit.register(drop_tables))
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_written_path"] = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for t in tables:
        path = t.__dict__.get("_written_path")
        if path in _written:
            _delete(_written.pop(path), path)


def drop_tables() -> None:
    """Delete the written tables of this process; results that still read them must be consumed before."""
    while _written:
        path, spark = _written.popitem()
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            return


def fold(col: Column) -> Column:
    """0, 1 or 2: crc32 of the id's decimal text modulo 3; fold 1 is held out."""
    return F.crc32(col.cast("string")).cast("long") % 3


def held_out(col: Column) -> Column:
    """Whether an id is in the held-out fold; a null id counts as held out, so nothing is learnt from it."""
    return F.coalesce(fold(col) == 1, F.lit(True))


def sample_ids(df: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """A deterministic sample of at most n distinct ids, whatever the partitioning: those with the least hashes.

    Only ids under a bound on the hash, which some 2 n pass, are ranked at all.
    """
    return smallest_hashes(df.select(id_col), id_col, n, seed)


def smallest_hashes(df: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """The n distinct rows whose ids have the least hashes; ties go by the columns."""
    known = df.where(F.col(id_col).isNotNull())
    several = known.agg(F.approx_count_distinct(id_col, 0.02)).first()[0]
    order = F.xxhash64(F.col(id_col), F.lit(seed))
    if several > 2 * n + 200:
        known = known.where(order.cast("double") / 2.0**64 + 0.5 <= (2.0 * n + 200) / several)
    return known.distinct().orderBy(order, *df.columns).limit(n)


def attach(rows: DataFrame, facts: DataFrame, keys: list[str], copies: str, few: int = 2000) -> DataFrame:
    """rows inner-joined with facts, one row per distinct keys, of which ``copies`` says how many rows have them.

    Keys with more than a ``few``-th part of all rows, which are fewer than ``few``, are joined by broadcast,
    all others by a shuffle in which no key has more than that part. Keys are not null in rows.
    """
    total = facts.agg(F.sum(copies)).first()[0] or 0
    hot = facts.where(F.col(copies) * few > total).drop(copies)
    cold = facts.where(F.col(copies) * few <= total).drop(copies)
    near = rows.join(F.broadcast(hot), keys)
    far = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return near.unionByName(far)


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links of long ids -> (node, root): root is the smallest id that node reaches.

    Alternates large-star and small-star rounds until nothing changes, with the edges of every
    round in a written table. A hub's many edges meet only in counted minima (combined before the
    shuffle) and in sort-merge joins, which Spark splits when skewed. Roots themselves are not listed.
    """
    e = table(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        large = table(large)
        discard(e)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = table(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        discard(large)


def running(df: DataFrame, keys: list[str], bucket: Column, order: list[str], name: str, value: Column) -> DataFrame:
    """Sum of value over the earlier rows of the same keys, in the order of (bucket, *order).

    Two levels: sums by (keys, bucket) are added up over buckets, and only rows of one bucket meet in
    a window, so a key with a third of all rows is spread over its buckets.
    """
    b, t = f"{name}_bucket", f"{name}_before"
    df = df.withColumn(b, bucket).withColumn(f"{name}_value", value)
    sums = df.groupBy(*keys, b).agg(F.sum(f"{name}_value").alias(t))
    earlier = W.partitionBy(*keys).orderBy(b).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn(t, F.coalesce(F.sum(t).over(earlier), F.lit(0)))
    inner = W.partitionBy(*keys, b).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumn(name, F.coalesce(F.sum(f"{name}_value").over(inner), F.lit(0)))
    s = sums.alias("s")
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*keys, b]]
    cond = same[0]
    for x in same[1:]:
        cond = cond & x
    out = df.alias("d").join(s, cond).select("d.*", (F.col(f"d.{name}") + F.col(f"s.{t}")).cast("long").alias("_sum"))
    return out.drop(name, b, f"{name}_value").withColumnRenamed("_sum", name)


class Memo:
    """Values by word for one worker; forgets everything when it is full, so memory stays bounded.

    Full is ``limit`` words or ``chars`` characters, as values grow with their words; beyond that only the
    words of one call are held.
    """

    def __init__(self, compute: Callable[[list], Iterable], limit: int = 120_000, chars: int = 4_000_000):
        self.compute, self.limit, self.chars, self.known, self.held = compute, limit, chars, {}, 0

    def learn(self, words: Iterable) -> dict:
        """The known values, with those of words (a set) among them."""
        known = self.known
        new = [w for w in words if w not in known]
        if new:
            size = sum(map(len, new))
            if len(known) + len(new) > self.limit or self.held + size > self.chars:
                known.clear()
                new = list(words)
                self.held, size = 0, sum(map(len, new))
            self.held += size
            known.update(zip(new, self.compute(new), strict=True))
        return known


def trimmed(run: Callable) -> Callable:
    """run, and at its end freed memory goes back to the system: workers are used again by later stages."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return wrapped


def small_batches(texts: list, most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts with about ``most`` characters each; a longer text is a run of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def word_ngrams(words: list[str], sizes: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size the hashed character n-grams of the words, with a mark at both ends: (word index, feature)."""
    marked = "\x02" + "\x03\x02".join(words) + "\x03"
    chars = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
    h = np.zeros(len(chars), dtype=np.uint64)
    done = 0
    for n in sorted(sizes):
        while done < n:
            h = h[: len(chars) - done] * np.uint64(0x9E3779B97F4A7C15) + chars[done:]
            done += 1
        if len(h) == 0:
            return
        inside = owner[: len(h)] == owner[n - 1 :]
        x = h[inside] + np.uint64(n)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        yield owner[: len(inside)][inside], (x >> np.uint64(64 - bits)).astype(np.int32)
