"""Deterministic rasters from the driver tables, and the SQL that gives the same pixels.

FX1 real image, FX2 complex image, FX2M the same with a checkerboard of gains, FX3 four-channel vector,
FX4 interferometric pair, FX5 count image, FX6 label map, FX7 sparse counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .raster import Raster

SQL = {
    "fx1": "select vec_id y, i::bigint x, embedding[i+1]::double re from embeddings, range(0,64) t(i)",
    "fx2": "select vec_id y, i::bigint x, embedding[i+1]::double re, embedding[i+33]::double im from embeddings, range(0,32) t(i)",
    "fx2m": "select vec_id y, i::bigint x, g*embedding[i+1]::double re, g*embedding[i+33]::double im from (select *, case when ((vec_id//25)+(i//8))%2=0 then 1.0::double else 4.0::double end g from embeddings, range(0,32) t(i))",
    "fx3": "select c::int ch, vec_id y, i::bigint x, embedding[8*c+i+1]::double re, embedding[32+8*c+i+1]::double im from embeddings, range(0,4) a(c), range(0,8) b(i)",
    "fx4": "select vec_id y, i::bigint x, embedding[i+1]::double m_re, embedding[17+i]::double m_im, embedding[33+i]::double s_re, embedding[49+i]::double s_im from embeddings, range(0,16) t(i)",
    "fx5": "select g.y::bigint y, h.x::bigint x, coalesce(n,0)::double re from range(0,64) g(y) cross join range(0,64) h(x) left join (select l_orderkey%64 y, l_partkey%64 x, count(*) n from lineitem group by 1,2) using (y,x)",
    "fx6": "select (vec_id//20)::bigint y, (vec_id%20)::bigint x, label::double re from embeddings",
    "fx7": "select g.y::bigint y, h.x::bigint x, coalesce(n,0)::double re from range(0,15) g(y) cross join range(0,720) h(x) left join (select user_id%15 y, floor(epoch(ts))::bigint//3600 - floor(epoch(timestamp '2024-01-01'))::bigint//3600 x, count(*) n from events group by 1,2) using (y,x)",
}


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    df = spark.read.parquet(f"{d}/embeddings.parquet")
    return df, df.count()


def _cut(spark: SparkSession, d: str, n: int, *starts: int) -> tuple[DataFrame, int]:
    """(y, x, v0, v1, ..): n columns from each start of the vectors."""
    df, ny = _vectors(spark, d)
    parts = F.arrays_zip(*[F.slice("embedding", s + 1, n).cast("array<double>").alias(f"v{k}") for k, s in enumerate(starts)])
    return df.select(F.col("vec_id").alias("y"), F.posexplode(parts).alias("x", "v")).select("y", F.col("x").cast("long").alias("x"), "v.*"), ny


def fx1(spark: SparkSession, d: str) -> Raster:
    df, ny = _cut(spark, d, 64, 0)
    return Raster(df.withColumnRenamed("v0", "re"), ny, 64)


def fx2(spark: SparkSession, d: str) -> Raster:
    df, ny = _cut(spark, d, 32, 0, 32)
    return Raster(df.withColumnsRenamed({"v0": "re", "v1": "im"}), ny, 32, complex=True)


def fx2m(spark: SparkSession, d: str) -> Raster:
    r = fx2(spark, d)
    g = F.when((F.floor(F.col("y") / 25) + F.floor(F.col("x") / 8)) % 2 == 0, 1.0).otherwise(4.0)
    return r.with_df(r.df.select("y", "x", (g * F.col("re")).alias("re"), (g * F.col("im")).alias("im")))


def fx2m_abs(spark: SparkSession, d: str) -> Raster:
    r = fx2m(spark, d)
    return r.with_df(r.df.select("y", "x", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("re")), complex=False)


SQL["fx2m_abs"] = f"select y, x, sqrt(re*re+im*im) re from ({SQL['fx2m']})"


def fx3(spark: SparkSession, d: str, pol: tuple[str, ...] = ("HH", "VV", "HV", "VH")) -> Raster:
    df, ny = _vectors(spark, d)
    part = lambda s: F.array(*[F.slice("embedding", s + 8 * c + 1, 8).cast("array<double>") for c in range(4)])
    chan = F.arrays_zip(part(0).alias("a"), part(32).alias("b"))
    df = df.select(F.col("vec_id").alias("y"), F.posexplode(chan).alias("ch", "c"))
    df = df.select("ch", "y", F.posexplode(F.arrays_zip("c.a", "c.b")).alias("x", "v"))
    df = df.select(F.col("ch").cast("int").alias("ch"), "y", F.col("x").cast("long").alias("x"), F.col("v.a").alias("re"), F.col("v.b").alias("im"))
    return Raster(df, ny, 8, (4,), complex=True, meta={"CH_pol": list(pol)})


def fx3_pix(spark: SparkSession, d: str, n: int = 4) -> Raster:
    """The first n channels of FX3 in PIX form, straight from the vectors: no shuffle."""
    df, ny = _vectors(spark, d)
    part = lambda s: F.slice("embedding", s + 1, 8).cast("array<double>")
    cols = F.arrays_zip(*[part(8 * c).alias(f"a{c}") for c in range(n)], *[part(32 + 8 * c).alias(f"b{c}") for c in range(n)])
    df = df.select(F.col("vec_id").alias("y"), F.posexplode(cols).alias("x", "v"))
    df = df.select("y", F.col("x").cast("long").alias("x"), F.array(*[f"v.a{c}" for c in range(n)]).alias("re"), F.array(*[f"v.b{c}" for c in range(n)]).alias("im"))
    pol = ["HH", "VV", "HV", "VH"] if n == 4 else ["HH", "VV", "XX"][:n]
    return Raster(df, ny, 8, (n,), "pix", True, {"CH_pol": pol})


def fx4(spark: SparkSession, d: str, mix: float = 0.0) -> tuple[Raster, Raster]:
    """Master and slave; with mix, slave = mix * master + (1 - mix) * slave."""
    df, ny = _cut(spark, d, 16, 0, 16, 32, 48)
    a = df.select("y", "x", F.col("v0").alias("re"), F.col("v1").alias("im"))
    b = df.select("y", "x", (mix * F.col("v0") + (1 - mix) * F.col("v2")).alias("re"), (mix * F.col("v1") + (1 - mix) * F.col("v3")).alias("im"))
    return Raster(a, ny, 16, complex=True), Raster(b, ny, 16, complex=True)


def fx5(spark: SparkSession, d: str) -> Raster:
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    n = li.groupBy((F.col("l_orderkey") % 64).alias("y"), (F.col("l_partkey") % 64).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    grid = spark.range(64 * 64).select(F.floor(F.col("id") / 64).alias("y"), (F.col("id") % 64).alias("x"))
    return Raster(grid.join(n, ["y", "x"], "left").select("y", "x", F.coalesce("n", F.lit(0)).cast("double").alias("re")), 64, 64)


def fx6(spark: SparkSession, d: str) -> Raster:
    df, n = _vectors(spark, d)
    return Raster(df.select(F.floor(F.col("vec_id") / 20).alias("y"), (F.col("vec_id") % 20).alias("x"), F.col("label").cast("double").alias("re")), n // 20, 20)


def fx7(spark: SparkSession, d: str) -> Raster:
    ev = spark.read.parquet(f"{d}/events.parquet")
    hour = F.floor(F.unix_timestamp("ts") / 3600) - 1704067200 // 3600
    n = ev.groupBy((F.col("user_id") % 15).alias("y"), hour.alias("x")).agg(F.count(F.lit(1)).alias("n"))
    grid = spark.range(15 * 720).select(F.floor(F.col("id") / 720).alias("y"), (F.col("id") % 720).alias("x"))
    return Raster(grid.join(n, ["y", "x"], "left").select("y", "x", F.coalesce("n", F.lit(0)).cast("double").alias("re")), 15, 720)


def fx8(spark: SparkSession, d: str) -> Raster:
    r = fx2(spark, d)
    return r.with_df(r.df.select("y", "x", F.atan2("im", "re").alias("re")), complex=False)


SQL["fx8"] = f"select y, x, atan2(im, re) re from ({SQL['fx2']})"
