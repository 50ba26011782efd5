"""Values between samples: irregular samples along lines, and rasters at scattered points.

Both are joins, not loops: a target finds the two samples around it by one ordered pass over samples and targets together,
and a point finds its pixels by the cell it lies in. Cells are looked up once, however many points share one, and
cells that hold a large share of all points get their values by broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans import cut
from ..raster import Raster


def cubic_irregular(samples: DataFrame, targets: DataFrame, lines: list[str]) -> DataFrame:
    """(*lines, at, v): cubic convolution of samples (*lines, x, v) of any spacing at targets (*lines, at).

    The distance between the two samples around a target is the unit of its position; beyond a line's ends the third
    differences vanish. Targets outside a line's samples, or on a line of fewer than two, are null; two samples are
    joined by a straight line. Samples at one place count with their mean; null places and values are left out.
    """
    known = samples.where(F.col("x").isNotNull() & F.col("v").isNotNull() & ~F.isnan("x"))
    known = known.groupBy(*lines, F.col("x").cast("double").alias("x")).agg(F.avg(F.col("v").cast("double")).alias("v"))
    line = W.partitionBy(*lines).orderBy("x")
    b, c = F.col("v"), F.lead("v", 1).over(line)
    before, after = F.lag("v", 1).over(line), F.lead("v", 2).over(line)
    a = F.coalesce(before, 3 * b - 3 * c + after, 2 * b - c)
    d = F.coalesce(after, 3 * c - 3 * b + before, 2 * c - b)
    spans = known.select(*lines, "x", F.struct(F.col("x").alias("x0"), F.lead("x", 1).over(line).alias("x1"), a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d")).alias("s"))
    # The last sample opens no span: a target there belongs to the span before.
    spans = spans.where(F.col("s.x1").isNotNull())
    wanted = targets.select(*lines, F.col("at").cast("double").alias("x"), F.lit(None).cast(spans.schema["s"].dataType).alias("s"), F.lit(1).alias("want"))
    both = spans.withColumn("want", F.lit(0)).unionByName(wanted)
    upto = W.partitionBy(*lines).orderBy("x", "want").rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("s", F.last("s", ignorenulls=True).over(upto)).where("want = 1")
    t = (F.col("x") - F.col("s.x0")) / (F.col("s.x1") - F.col("s.x0"))
    weights = ((2 * t - t * t - 1) * t, (3 * t - 5) * t * t + 2, ((4 - 3 * t) * t + 1) * t, (t - 1) * t * t)
    value = sum((w * F.col(f"s.{k}") for w, k in zip(weights, "abcd", strict=True)), F.lit(0.0)) / 2
    return found.select(*lines, F.col("x").alias("at"), F.when(F.col("x") <= F.col("s.x1"), value).alias("v"))


def _sinc(t: Column) -> Column:
    return F.when(F.abs(t) < 1e-12, 1.0).otherwise(F.sin(math.pi * t) / (math.pi * F.when(F.abs(t) < 1e-12, 1.0).otherwise(t)))


def _weight(t: Column, method: str, size: int) -> Column:
    """The weight of a pixel at distance t of the point along one axis."""
    u = F.abs(t)
    if method == "linear":
        return F.greatest(F.lit(0.0), 1 - u)
    if method == "cubic":
        return F.when(u <= 1, (1.5 * u - 2.5) * u * u + 1).when(u < 2, ((-0.5 * u + 2.5) * u - 4) * u + 2).otherwise(0.0)
    return F.when(u < size, _sinc(t) * _sinc(t / size)).otherwise(0.0)


def sample_at(r: Raster, points: DataFrame, method: str = "linear", size: int = 2, few: int = 2000) -> DataFrame:
    """points (y, x and any other columns but ``re``, ``im``) with the raster's value there: ``re`` (and ``im``).

    ``linear``, ``cubic`` (borders repeat) or ``lanczos`` of ``size`` (pixels outside count nothing). Null outside the image or
    at no place. Rasters of one channel. Cells with more than a ``few``-th part of the points, fewer than ``few``, meet their
    points by broadcast.
    """
    if method not in ("linear", "cubic", "lanczos"):
        raise ValueError(f"unknown method {method}")
    reach = {"linear": 1, "cubic": 2, "lanczos": size}[method]
    r = r.long()
    ny, nx, values = r.ny, r.nx, (["re", "im"] if r.complex else ["re"])
    inside = points.where((F.col("y") >= 0) & (F.col("y") <= ny - 1) & (F.col("x") >= 0) & (F.col("x") <= nx - 1))
    place = lambda c: F.floor(F.col(c)).cast("long")
    inside = inside.withColumns({"_cy": place("y"), "_cx": place("x")})
    cells = inside.groupBy("_cy", "_cx").agg(F.count(F.lit(1)).alias("_held"))
    taps = F.explode(F.sequence(F.lit(1 - reach), F.lit(reach)))
    spread = cells.select("_cy", "_cx", "_held", taps.alias("_dy")).select("*", taps.alias("_dx"))
    edge = lambda c, d, n: F.least(F.lit(n - 1), F.greatest(F.lit(0), F.col(c) + F.col(d)))
    if method == "cubic":
        spread = spread.withColumns({"y": edge("_cy", "_dy", ny), "x": edge("_cx", "_dx", nx)})
    else:
        spread = spread.withColumns({"y": F.col("_cy") + F.col("_dy"), "x": F.col("_cx") + F.col("_dx")})
    near = spread.join(r.df.select("y", "x", *values), ["y", "x"])
    # Every cell has (2 reach) ** 2 pixels at most: a row each with its values as columns.
    steps = [(dy, dx) for dy in range(1 - reach, reach + 1) for dx in range(1 - reach, reach + 1)]
    mine = lambda v, dy, dx: F.max(F.when((F.col("_dy") == dy) & (F.col("_dx") == dx), F.col(v))).alias(f"_{v}{dy}_{dx}")
    table = cut(near.groupBy("_cy", "_cx", "_held").agg(*[mine(v, dy, dx) for v in values for dy, dx in steps]))
    total = table.agg(F.sum("_held")).first()[0] or 0
    hot = table.where(F.col("_held") * few > total).drop("_held")
    cold = table.where(F.col("_held") * few <= total).drop("_held")
    cell = ["_cy", "_cx"]
    met = inside.join(F.broadcast(hot), cell).unionByName(inside.join(F.broadcast(hot.select(*cell)), cell, "left_anti").join(cold, cell))
    ty, tx = F.col("y") - F.col("_cy"), F.col("x") - F.col("_cx")
    out = {}
    for v in values:
        s = F.lit(0.0)
        for dy in range(1 - reach, reach + 1):
            along = F.lit(0.0)
            for dx in range(1 - reach, reach + 1):
                along = along + _weight(tx - dx, method, size) * F.coalesce(f"_{v}{dy}_{dx}", F.lit(0.0))
            s = s + _weight(ty - dy, method, size) * along
        out[v] = s
    names = [c for c in points.columns if c not in ("re", "im")]
    met = met.withColumns(out).select(*names, *values)
    outside = points.where(~F.coalesce((F.col("y") >= 0) & (F.col("y") <= ny - 1) & (F.col("x") >= 0) & (F.col("x") <= nx - 1), F.lit(False)))
    return met.unionByName(outside.select(*names, *[F.lit(None).cast("double").alias(v) for v in values]))
