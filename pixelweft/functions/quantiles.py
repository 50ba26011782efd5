"""Exact quantiles in bounded memory: ranks are found by counting in ever finer bins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _ranked(df: DataFrame, value: Column, ranks: list[int], bins: int, few: int) -> dict[int, float]:
    """The values at ranks (from 0) of the non-null values: the bin that holds a rank is divided until it is small."""
    df = df.select(value.cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    out: dict[int, float] = {}
    todo = [(-math.inf, math.inf, 0, sorted(set(ranks)))]  # values from lo up to and with hi, how many are smaller, ranks
    while todo:
        lo, hi, before, wanted = todo.pop()
        part = df.where((F.col("v") >= lo) & (F.col("v") <= hi))
        low, high, n = part.agg(F.min("v"), F.max("v"), F.count(F.lit(1))).first()
        if not n:
            continue
        if low == high:
            out |= {r: low for r in wanted}
        elif n <= few:
            values = [row[0] for row in part.orderBy("v").collect()]  # ``few`` at most
            out |= {r: values[r - before] for r in wanted}
        else:
            width = high / bins - low / bins
            at = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col("v") - low) / width)))
            rows = part.groupBy(at.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("b").collect()  # a row a bin
            for row in rows:
                mine = [r for r in wanted if before <= r < before + row["n"]]
                if mine:
                    todo.append((row["lo"], row["hi"], before, mine))
                before += row["n"]
    return out


def quantiles(df: DataFrame, value: Column, shares: list[float], bins: int = 4096, few: int = 10_000) -> list[float | None]:
    """Quantiles with linear interpolation between neighbours; None without values. No task or driver holds more than
    ``bins`` counts or ``few`` values."""
    n = df.where(value.isNotNull() & ~F.isnan(value)).count()
    if not n:
        return [None] * len(shares)
    places = [s * (n - 1) for s in shares]
    found = _ranked(df, value, [k for p in places for k in (math.floor(p), math.ceil(p))], bins, few)
    return [found[math.floor(p)] + (found[math.ceil(p)] - found[math.floor(p)]) * (p - math.floor(p)) for p in places]


def grouped_quantiles(df: DataFrame, keys: list[str], value: Column, shares: list[float], bins: int = 64) -> DataFrame:
    """(*keys, share, q): quantiles of every group with linear interpolation, as many jobs for many groups as for one.

    Equal values of a group are counted before anything else, so ties never meet in one task. Approximate quantiles cut a
    group's different values into ``bins`` stretches of like size; counts of the stretches, added up, tell which stretch
    holds a rank, and running counts inside it tell the value. Null and NaN count nowhere; a group without values has no rows.
    ``keys`` are not null. What is broadcast has ``bins`` rows a group at most, so groups are channels, classes or regions.
    """
    spark, none = df.sparkSession, not keys
    keys = keys or ["_all"]
    src = df.withColumn("_all", F.lit(0)) if none else df
    v = src.select(*keys, value.cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    v = v.select(*keys, (F.col("v") + 0.0).alias("v")).groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n"))
    cuts = v.groupBy(*keys).agg(F.percentile_approx("v", [k / bins for k in range(1, bins)], 10 * bins).alias("cuts"))
    placed = v.join(F.broadcast(cuts), keys).select(*keys, "v", "n", F.size(F.filter("cuts", lambda c: c < F.col("v"))).alias("bin"))
    sums = placed.groupBy(*keys, "bin").agg(F.sum("n").alias("held"))
    before = W.partitionBy(*keys).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*keys, "bin", "held", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"), F.sum("held").over(W.partitionBy(*keys)).alias("total"))
    wanted = F.broadcast(spark.createDataFrame([(i, float(s)) for i, s in enumerate(shares)], "i int, share double"))
    place = F.col("share") * (F.col("total") - 1)
    ranks = sums.join(wanted, F.lit(True)).withColumn("low", F.floor(place))
    ranks = ranks.withColumn("rank", F.explode(F.array_distinct(F.array("low", F.least(F.col("total") - 1, F.col("low") + 1)))))
    ranks = ranks.where((F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("start") + F.col("held")))
    ranks = ranks.select(*keys, "bin", "start", "i", "share", "low", "rank", (place - F.col("low")).alias("part"))
    inside = W.partitionBy(*keys, "bin").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    run = placed.withColumn("upto", F.sum("n").over(inside))
    hit = run.join(F.broadcast(ranks), [*keys, "bin"]).where((F.col("rank") - F.col("start") < F.col("upto")) & (F.col("rank") - F.col("start") >= F.col("upto") - F.col("n")))
    lo, hi = F.min(F.struct("rank", "v"))["v"], F.max(F.struct("rank", "v"))["v"]
    out = hit.groupBy(*keys, "i", "share", "part").agg(lo.alias("lo"), hi.alias("hi"))
    out = out.select(*keys, "i", "share", F.when(F.col("part") > 0, F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")).otherwise(F.col("lo")).alias("q"))
    return out.drop("_all") if none else out
