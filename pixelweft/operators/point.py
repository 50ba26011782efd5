"""Point-wise algebra, channel algebra and scaling: projections without a shuffle."""

from __future__ import annotations

import ast
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import cplx
from ..raster import Raster


def _map(r: Raster, **cols: Column) -> Raster:
    keep = [*r.keys, "y", "x"]
    return r.with_df(r.df.select(*keep, *[c.alias(n) for n, c in cols.items()]), complex="im" in cols)


def complex2abs(r: Raster) -> Raster:
    return _map(r.long(), re=F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")))


def int2amp(r: Raster) -> Raster:
    return _map(r.long(), re=F.sqrt("re"))


def amp2int(r: Raster) -> Raster:
    return _map(r.long(), re=F.col("re") * F.col("re"))


def negate(r: Raster | list[Raster]):
    if isinstance(r, list):
        return [negate(x) for x in r]
    r = r.long()
    return _map(r, re=-F.col("re"), **({"im": -F.col("im")} if r.complex else {}))


#: Functions that an expression may call, with their Spark names (fixed values).
CALLS = {"sqrt": "sqrt", "abs": "abs", "sin": "sin", "cos": "cos", "tan": "tan", "exp": "exp", "log": "ln", "log10": "log10", "log1p": "log1p", "expm1": "expm1", "arctan": "atan", "arcsin": "asin", "arccos": "acos", "arctan2": "atan2", "sinh": "sinh", "cosh": "cosh", "tanh": "tanh", "floor": "floor", "ceil": "ceil", "where": "if"}
_BINARY = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.Mod: "%", ast.BitAnd: "and", ast.BitOr: "or"}
_COMPARE = {ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">=", ast.Eq: "=", ast.NotEq: "<>"}


def to_sql(text: str, names: set[str]) -> str:
    """A whitelisted arithmetic expression as Spark SQL; anything else is an error, nothing is evaluated."""

    def go(n: ast.expr) -> str:
        if isinstance(n, ast.BinOp) and isinstance(n.op, ast.Pow):
            return f"pow({go(n.left)}, {go(n.right)})"
        if isinstance(n, ast.BinOp) and type(n.op) in _BINARY:
            return f"({go(n.left)} {_BINARY[type(n.op)]} {go(n.right)})"
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.USub | ast.UAdd):
            return f"({'-' if isinstance(n.op, ast.USub) else '+'}{go(n.operand)})"
        if isinstance(n, ast.Compare) and len(n.ops) == 1 and type(n.ops[0]) in _COMPARE:
            return f"({go(n.left)} {_COMPARE[type(n.ops[0])]} {go(n.comparators[0])})"
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in CALLS and not n.keywords:
            return f"{CALLS[n.func.id]}({', '.join(map(go, n.args))})"
        if isinstance(n, ast.Name) and n.id in names:
            return f"`{n.id}`"
        if isinstance(n, ast.Constant) and isinstance(n.value, int | float) and not isinstance(n.value, bool):
            return f"{float(n.value)!r}D"
        raise ValueError(f"not allowed in an expression: {ast.dump(n)}")

    return go(ast.parse(text, mode="eval").body)


def mathexpr(rasters: list[Raster], text: str, dtype: str | None = None) -> Raster:
    """An expression over layers A, B, C, ..: an equi-join on the pixel, then a projection."""
    names = [chr(ord("A") + i) for i in range(len(rasters))]
    df = None
    first = rasters[0].long()
    on = [*first.keys, "y", "x"]
    for n, r in zip(names, rasters, strict=True):
        d = r.long().df.select(*on, F.col("re").alias(n))
        df = d if df is None else df.join(d, on)
    out = F.expr(to_sql(text, set(names)))
    if dtype:
        out = out.cast(dtype)
    return first.with_df(df.select(*on, out.cast("double").alias("re")), complex=False)


def phase(a: Raster, b: Raster | None = None) -> Raster:
    """The angle of a, or of a times conjugate b."""
    if not a.complex or (b is not None and not b.complex):
        raise TypeError("phase needs complex input")
    a = a.long()
    if b is None:
        return _map(a, re=F.atan2("im", "re"))
    on = [*a.keys, "y", "x"]
    d = a.df.join(b.long().df.select(*on, F.col("re").alias("br"), F.col("im").alias("bi")), on)
    re, im = cplx.mul_conj((F.col("re"), F.col("im")), (F.col("br"), F.col("bi")))
    return a.with_df(d.select(*on, F.atan2(im, re).alias("re")), complex=False)


def combine_dual(a: Raster, b: Raster) -> Raster:
    """Of two apodised images, the part of smaller magnitude where both signs agree, else 0."""
    a, on = a.long(), [*a.long().keys, "y", "x"]
    d = a.df.join(b.long().df.select(*on, F.col("re").alias("br"), F.col("im").alias("bi")), on)

    def low(p: str, q: str) -> Column:
        return F.when(F.signum(p) == F.signum(q), F.signum(p) * F.least(F.abs(F.col(p)), F.abs(F.col(q)))).otherwise(0.0)

    return a.with_df(d.select(*on, low("re", "br").alias("re"), low("im", "bi").alias("im")))


# --- scaling to bytes: one small aggregate, then a projection -----------------------------------------


def _stats(r: Raster, **aggs: Column):
    return r.df.crossJoin(F.broadcast(r.df.agg(*[c.alias(n) for n, c in aggs.items()])))  # one row


def sarscale(r: Raster, factor: float = 2.5) -> Raster:
    r = r.long()
    v = F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.col("re") * 255.0 / (factor * F.col("m"))))
    return r.with_df(_stats(r, m=F.avg("re")).select(*r.keys, "y", "x", F.floor(v).cast("double").alias("re")))


def bytescale(r: Raster, low: float | None = None, high: float | None = None) -> Raster:
    r = r.long()
    lo, hi = (F.lit(float(low)) if low is not None else F.col("lo")), (F.lit(float(high)) if high is not None else F.col("hi"))
    span = F.when(hi == lo, 1.0).otherwise(hi - lo)
    v = F.least(F.lit(255.0), F.greatest(F.lit(0.0), (F.col("re") - lo) * (255.0 / span) + 0.4999))
    return r.with_df(_stats(r, lo=F.min("re"), hi=F.max("re")).select(*r.keys, "y", "x", F.floor(v).cast("double").alias("re")))


def phascale(r: Raster) -> Raster:
    r = r.long()

    v = F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.col("re") / math.pi * 128.0 + 127.0))
    return _map(r, re=F.floor(v).cast("double"))


def cohscale(r: Raster) -> Raster:
    return _map(r.long(), re=F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("re"))) * 255.0).cast("double"))


def histscale(r: Raster, cut: float = 0.05, bins: int = 1000) -> Raster:
    """Bytes between the values below and above which a share of the pixels lies, from a histogram up to ten means."""
    r = r.long()
    mean = r.df.agg(F.avg("re")).first()[0] or 0.0
    top = 10.0 * mean
    if top <= 0:
        return _map(r, re=F.lit(0.0))
    at = F.least(F.floor(F.col("re") / (top / bins)).cast("int"), F.lit(bins - 1))
    rows = r.df.where((F.col("re") >= 0) & (F.col("re") <= top)).groupBy(at.alias("b")).count().collect()  # at most ``bins`` rows
    counts = [0] * bins
    for b, n in rows:
        counts[b] = n
    counts[0] = 0
    wanted = sum(counts) * cut
    lo = next(k for k in range(bins + 1) if sum(counts[:k]) >= wanted)
    hi = next(k for k in range(bins, -1, -1) if sum(counts[k:]) >= wanted)
    a, b = lo * top / bins, hi * top / bins
    v = F.least(F.lit(255.0), F.greatest(F.lit(0.0), (F.col("re") - a) / (b - a) * 255.0))
    return _map(r, re=F.floor(v).cast("double"))


def cart2pol(r: Raster) -> tuple[Column, Column]:
    return F.sqrt(F.col("re") ** 2 + F.col("im") ** 2), F.atan2("im", "re")


def pol2cart(rho: Column, phi: Column) -> tuple[Column, Column]:
    return rho * F.cos(phi), rho * F.sin(phi)


def sar2rgb(r: Raster, alpha: float = 3.0, gamma: float = 0.7) -> Raster:
    """Channels to bytes: amplitude over mean + alpha * std of its channel, to the power gamma."""
    r = r.long()
    st = r.df.groupBy(*r.keys).agg((F.avg(F.sqrt("re")) + alpha * F.stddev_pop(F.sqrt("re"))).alias("top"))  # a row a channel
    d = r.df.join(F.broadcast(st), r.keys) if r.keys else r.df.crossJoin(F.broadcast(st))
    v = F.pow(F.least(F.lit(1.0), F.sqrt("re") / F.col("top")), F.lit(gamma)) * 255.0
    return r.with_df(d.select(*r.keys, "y", "x", F.floor(v).cast("double").alias("re")))


#: Ramps by their anchors: place from 0 to 255, colour.
RAMPS = {
    "blue": ((0, (0, 0, 0)), (128, (0, 0, 255)), (255, (255, 255, 255))),
    "red": ((0, (0, 0, 0)), (128, (255, 0, 0)), (255, (255, 255, 255))),
    "green": ((0, (0, 0, 0)), (128, (0, 255, 0)), (255, (255, 255, 255))),
    "blue-red-yellow": ((0, (0, 0, 128)), (128, (224, 0, 32)), (255, (255, 255, 0))),
    "haze": ((0, (64, 72, 96)), (128, (168, 160, 176)), (255, (248, 240, 224))),
    "elevation": ((0, (0, 96, 72)), (64, (120, 168, 48)), (128, (236, 200, 116)), (192, (148, 92, 48)), (255, (255, 255, 255))),
    "elevation-bright": ((0, (96, 176, 160)), (85, (200, 224, 144)), (170, (248, 208, 144)), (255, (255, 248, 240))),
    "seabed": ((0, (8, 16, 80)), (127, (160, 216, 240)), (128, (0, 112, 64)), (192, (232, 208, 120)), (255, (255, 255, 255))),
    "ice": ((0, (0, 0, 40)), (128, (56, 136, 200)), (255, (255, 255, 255))),
}


def _hue(h: float, light: float = 1.0, grey: float = 0.0) -> tuple[int, int, int]:
    """A colour of the wheel (0 red, 1/3 green, 2/3 blue), darker by light, paler by grey."""
    part = lambda k: max(0.0, min(1.0, abs((6 * h + k) % 6 - 3) - 1))
    return tuple(math.floor(255 * (light * part(k) * (1 - grey) + grey) + 0.5) for k in (0, 4, 2))


def palette(name: str) -> list[tuple[int, int, int]]:
    """256 colours from a rule: grey, hot, ocean, ramps, wheels, and classes that repeat after 8 or 16 colours.

    Wheels: phase (three cosines), hues (once around) and rainbow (blue to red). Classes: ``classes8`` and ``classes16``, also with
    ``-light`` and ``-dark``: hues by steps of the golden section, so neighbours differ.
    """
    t = [i / 255 for i in range(256)]
    clip = lambda v: int(max(0, min(255, round(255 * v))))
    if name == "grey":
        return [(i, i, i) for i in range(256)]
    if name == "hot":
        return [(clip(3 * v), clip(3 * v - 1), clip(3 * v - 2)) for v in t]
    if name == "ocean":
        return [(clip(3 * v - 2), clip(1.5 * v - 0.5), clip(v)) for v in t]
    if name == "phase":
        return [tuple(clip(0.5 + 0.5 * math.cos(2 * math.pi * (v - k / 3))) for k in range(3)) for v in t]
    if name in ("hues", "rainbow"):
        return [_hue(i / 256 if name == "hues" else 2 / 3 * (1 - v)) for i, v in enumerate(t)]
    if name in RAMPS:
        out = []
        for i in range(256):
            (p, a), (q, b) = next(pair for pair in zip(RAMPS[name][:-1], RAMPS[name][1:], strict=True) if i <= pair[1][0])
            out.append(tuple(math.floor(u + (v - u) * (i - p) / (q - p) + 0.5) for u, v in zip(a, b, strict=True)))
        return out
    kind, _, shade = name.partition("-")
    if kind in ("classes8", "classes16") and shade in ("", "light", "dark"):
        n = int(kind[7:])
        light, grey = {"": (1.0, 0.0), "light": (1.0, 0.5), "dark": (0.55, 0.0)}[shade]
        return [_hue((i % n) * 0.6180339887498949 % 1, light, grey) for i in range(256)]
    raise KeyError(name)


#: All names that ``palette`` knows.
PALETTES = ("grey", "hot", "ocean", "phase", "hues", "rainbow", *RAMPS, *(f"classes{n}{s}" for n in (8, 16) for s in ("", "-light", "-dark")))


def coloured(r: Raster, name: str) -> Raster:
    """Byte values to three channels by a palette, a 256-row broadcast join."""
    r = r.long()
    spark = r.df.sparkSession
    lut = spark.createDataFrame([(i, c, float(v)) for i, rgb in enumerate(palette(name)) for c, v in enumerate(rgb)], "b int, ch int, v double")
    d = r.df.withColumn("b", F.col("re").cast("int")).drop("ch").join(F.broadcast(lut), "b")
    return r.with_df(d.select("ch", "y", "x", F.col("v").alias("re")), lshape=(3,))


def combinations(spark, values: dict[str, list], first_slowest: bool = True):
    """Every combination of the given values, one row each, numbered: index arithmetic over a range, so nothing is joined."""
    names = list(values)
    total = math.prod(len(v) for v in values.values())
    df, stride = spark.range(total), 1
    cols = {}
    for name in names[::-1] if first_slowest else names:
        n = len(values[name])
        cols[name] = F.get(F.array(*[F.lit(v) for v in values[name]]), F.floor(F.col("id") / stride) % n)
        stride *= max(1, n)
    return df.select(F.col("id").alias("i"), *[cols[n].alias(n) for n in names])


def linspace_nd(spark, axes: dict[str, tuple[float, float, int]]):
    """The grid of evenly spaced points (start, stop, number) of several axes, ends included, one row each."""
    df, stride, cols = spark.range(math.prod(n for _, _, n in axes.values())), 1, {}
    for name in list(axes)[::-1]:
        a, b, n = axes[name]
        k = F.floor(F.col("id") / stride) % n
        cols[name] = F.lit(float(a)) + k * ((b - a) / max(1, n - 1))
        stride *= n
    return df.select(F.col("id").alias("i"), *[cols[n].alias(n) for n in axes])
