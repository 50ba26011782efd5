"""Polarimetry: channel transforms, decompositions, parameters, classification and change detection.

Channels of a pixel share a row (PIX), so nothing here shuffles but joins of layers and moving windows.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cplx
from ..functions.cplx import Pair, at
from ..raster import Raster
from ..windows import box_mean, gauss as gauss_df, safe


def _pix(r: Raster, pairs: list[Pair], lshape: tuple[int, ...], **meta) -> Raster:
    df = r.df.select("y", "x", F.array(*[p[0] for p in pairs]).alias("re"), F.array(*[p[1] for p in pairs]).alias("im"))
    return r.with_df(df, lshape=lshape, form="pix", complex=True, meta=r.meta | meta)


def _real(r: Raster, cols: list[Column], **meta) -> Raster:
    return r.with_df(r.df.select("y", "x", F.array(*cols).alias("re")), lshape=(len(cols),), form="pix", complex=False, meta=r.meta | meta)


def _pol(r: Raster, *names: str) -> list[int]:
    return [r.meta["CH_pol"].index(n) for n in names]


def vec2mat(r: Raster) -> Raster:
    """out[i][j] = a[j] * conj(a[i]) over HH, VV, XX or HH, VV, HV, VH; labels as the inputs' order i, j."""
    r = r.pix()
    pol = r.meta.get("CH_pol", [str(i) for i in range(r.channels)])
    for order in (["HH", "VV", "XX"], ["HH", "VV", "HV", "VH"]):
        if sorted(order) == sorted(pol):
            pol = order
    idx = [r.meta["CH_pol"].index(p) for p in pol] if "CH_pol" in r.meta else list(range(r.channels))
    n = len(idx)
    pairs = [cplx.mul_conj(at(idx[j]), at(idx[i])) for i in range(n) for j in range(n)]
    return _pix(r, pairs, (n, n), CH_pol=[f"{a}{b}*" for a in pol for b in pol])


def rotate(r: Raster, angle: Raster) -> Raster:
    """Basis rotation R2 S R1 by an angle per pixel."""
    r = r.pix()
    d = r.df.join(angle.long().df.select("y", "x", F.col("re").alias("t")), ["y", "x"])
    r = r.with_df(d)
    pol = r.meta["CH_pol"]
    hh, vv = _pol(r, "HH", "VV")
    hv, vh = _pol(r, "XX", "XX") if "XX" in pol else _pol(r, "HV", "VH")
    c, s = F.cos("t"), F.sin("t")
    a, b, e, f = at(hh), at(hv), at(vh), at(vv)

    def mix(*terms: tuple[Column, Pair]) -> Pair:
        return tuple(reduce(lambda p, q: p + q, [k * z[i] for k, z in terms]) for i in (0, 1))

    out = {hh: mix((c * c, a), (c * s, b), (s * c, e), (s * s, f)), vv: mix((s * s, a), (-(s * c), b), (-(c * s), e), (c * c, f))}
    cross = mix((-(s * c), a), (-(s * s), b), (c * c, e), (c * s, f))
    if "XX" in pol:
        out[hv] = cross
    else:
        out[vh] = cross
        out[hv] = mix((-(c * s), a), (c * c, b), (-(s * s), e), (s * c, f))
    return _pix(r, [out[k] for k in range(len(pol))], r.lshape)


def polextract(r: Raster, pol: str = "HH") -> Raster:
    r = r.pix()
    k = r.meta["CH_pol"].index(pol)
    return r.with_df(r.df.select("y", "x", at(k)[0].alias("re"), at(k)[1].alias("im")), lshape=(), form="long")


def poltrace(r: Raster, average: bool = True) -> Raster:
    r = r.pix()
    n = r.lshape[0]
    t = reduce(lambda a, b: a + b, [F.get("re", F.lit(i * n + i)) for i in range(n)])
    return r.with_df(r.df.select("y", "x", (t / n if average else t).alias("re")), lshape=(), form="long", complex=False)


def quad2compact(r: Raster, mode: str = "CTLR") -> Raster:
    r = r.pix()
    hh, vv = _pol(r, "HH", "VV")
    hv, vh = _pol(r, "HV", "VH") if len(r.meta["CH_pol"]) == 4 else _pol(r, "XX", "XX")
    s = 1 / math.sqrt(2)
    rows = {
        "CTLR": ([(s, hh), (-1j * s, hv)], [(s, vh), (-1j * s, vv)]),
        "PI4": ([(s, hh), (s, hv)], [(s, vh), (s, vv)]),
        "DCP": ([(0.5, hh), (-0.5, vv), (0.5j, hv), (0.5j, vh)], [(0.5j, hh), (0.5j, vv), (0.5, vh), (-0.5, hv)]),
    }[mode]
    return _pix(r, [cplx.linear([(k, at(i)) for k, i in row]) for row in rows], (2,), CH_pol=[f"{mode}_1", f"{mode}_2"])


def _pauli_basis(n: int) -> np.ndarray:
    d = np.zeros((n, n), complex)
    d[0, :2], d[1, :2] = (1, 1), (1, -1)
    if n == 3:
        d[2, 2] = math.sqrt(2)
    else:
        d[2, 2:], d[3, 2:] = (1, 1), (-1j, 1j)
    return d / math.sqrt(2)


def lex2pauli(r: Raster) -> Raster:
    """Vectors and matrices from the lexicographic to the Pauli basis: literal sums, no matrix library."""
    r = r.pix()
    n = r.lshape[0]
    names = ("HH", "VV", "XX") if n == 3 else ("HH", "VV", "HV", "VH")
    if len(r.lshape) == 1:
        i = _pol(r, *names)
        s = 1 / math.sqrt(2)
        rows = [[(s, i[0]), (s, i[1])], [(s, i[0]), (-s, i[1])]]
        rows += [[(1, i[2])]] if n == 3 else [[(s, i[2]), (s, i[3])], [(s * 1j, i[2]), (-s * 1j, i[3])]]
        return _pix(r, [cplx.linear([(k, at(j)) for k, j in row]) for row in rows], r.lshape, CH_pol=[f"P{k + 1}" for k in range(n)])
    idx = [r.meta["CH_pol"].index(f"{p}{p}*") % n for p in names]
    d = _pauli_basis(n)
    pairs = []
    for i in range(n):
        for j in range(n):
            terms = [(d[i, a] * np.conj(d[j, b]), at(idx[a] * n + idx[b])) for a in range(n) for b in range(n) if d[i, a] and d[j, b]]
            pairs.append(cplx.linear(terms))
    return _pix(r, pairs, r.lshape, CH_pol=[f"P{i + 1}P{j + 1}*" for i in range(n) for j in range(n)])


def calibxsym(r: Raster, method: str = "average HV & VH") -> Raster:
    """Reciprocal channels: HV and VH to XX, for vectors and 4 x 4 matrices."""
    r = r.pix()
    s = 1 / math.sqrt(2)
    pol = r.meta["CH_pol"]
    if len(r.lshape) == 1:
        hh, vv, hv, vh = _pol(r, "HH", "VV", "HV", "VH")
        cross = {"average HV & VH": [(s, hv), (s, vh)], "take only HV": [(math.sqrt(2), hv)], "take only VH": [(math.sqrt(2), vh)]}[method]
        return _pix(r, [at(hh), at(vv), cplx.linear([(k, at(j)) for k, j in cross])], (3,), CH_pol=["HH", "VV", "XX"])
    m = {p: at(i) for i, p in enumerate(pol)}
    label = lambda p: p.replace("HV", "XX").replace("VH", "XX")
    if method == "average HV & VH":
        conj = lambda z: (z[0], -z[1])
        hx, vx = cplx.linear([(s, m["HHHV*"]), (s, m["HHVH*"])]), cplx.linear([(s, m["VVHV*"]), (s, m["VVVH*"])])
        m |= {"HHHV*": hx, "HVHH*": conj(hx), "VVHV*": vx, "HVVV*": conj(vx), "HVHV*": cplx.add(m["HVHV*"], m["VHVH*"])}
    gone = "HV" if method == "take only VH" else "VH"
    keep = [p for p in pol if gone not in (p[:2], p[2:4])]
    return _pix(r, [m[p] for p in keep], (3, 3), CH_pol=[label(p[:2]) + label(p[2:4]) + "*" for p in keep])


def _incidence(r: Raster, dem: Raster, meta: dict, apply) -> Raster:
    """Values times a function of the incidence angle, from slant range and terrain height."""
    r = r.long()
    d = r.df.join(dem.long().df.select("y", "x", F.col("re").alias("h")), ["y", "x"])
    c0 = meta["c0"]
    r0 = meta["rd"] * c0 / 2.0 + c0 / meta["rsf"] / 2.0 * F.col("x")
    ratio = (meta["h0"] - F.col("h")) / r0
    theta = F.when(F.abs(ratio) <= 1, F.acos(ratio)).otherwise(0.0)
    values = {c: F.col(c) * apply(theta) for c in (("re", "im") if r.complex else ("re",))}
    return r.with_df(d.select(*r.keys, "y", "x", *[v.alias(c) for c, v in values.items()]))


def beta2gamma(r: Raster, dem: Raster, meta: dict, intensity: bool = False) -> Raster:
    return _incidence(r, dem, meta, F.tan if intensity else lambda t: F.sqrt(F.tan(t)))


def beta2sigma(r: Raster, dem: Raster, meta: dict, intensity: bool = False) -> Raster:
    return _incidence(r, dem, meta, F.sin if intensity else lambda t: F.sqrt(F.sin(t)))


def determinant(n: int, m=at) -> Pair:
    """The determinant of a flattened n x n matrix by cofactors."""

    def det(rows: tuple[int, ...], cols: tuple[int, ...]) -> Pair:
        if len(rows) == 1:
            return m(rows[0] * n + cols[0])
        parts = []
        for k, c in enumerate(cols):
            sub = det(rows[1:], cols[:k] + cols[k + 1 :])
            re, im = cplx.mul(m(rows[0] * n + c), sub)
            parts.append((re, im) if k % 2 == 0 else (-re, -im))
        return reduce(cplx.add, parts)

    return det(tuple(range(n)), tuple(range(n)))


def block_det(r: Raster) -> Raster:
    """The modulus of each pixel's determinant; scalars are their own."""
    if not r.lshape:
        return r
    r = r.pix()
    re, im = determinant(r.lshape[0])
    return r.with_df(r.df.select("y", "x", F.sqrt(re * re + im * im).alias("re")), lshape=(), form="long", complex=False)


def smooth_matrix(r: Raster, win: tuple[int, int]) -> Raster:
    """Box mean of every element of a PIX raster, all in one pass per axis."""
    r = r.pix()
    parts = ["re", "im"] if r.complex else ["re"]
    flat = [f"{p}_{k}" for p in parts for k in range(r.channels)]
    df = r.df.select("y", "x", *[F.get(p, F.lit(k)).alias(f"{p}_{k}") for p in parts for k in range(r.channels)])
    df = box_mean(df, [], flat, r.ny, r.nx, win)
    return r.with_df(df.select("y", "x", *[F.array(*[f"{p}_{k}" for k in range(r.channels)]).alias(p) for p in parts]))


# --- decompositions ------------------------------------------------------------------------------------


def _powers(r: Raster):
    r = r.pix()
    pol = r.meta["CH_pol"]
    n = r.lshape[0]
    i = {k: pol.index(k) for k in ("HHHH*", "VVVV*", "HHVV*")}
    xx, cal = (pol.index("XXXX*"), 2.0) if n == 3 else (pol.index("HVHV*"), 1.0)
    tr = reduce(cplx.add, [at(k * n + k) for k in range(n)])
    mod = lambda z: F.sqrt(cplx.abs2(z))
    return r, mod(tr), mod(at(i["HHHH*"])), mod(at(i["VVVV*"])), mod(at(xx)) / cal, at(i["HHVV*"])


def _clip(v: Column, span: Column) -> Column:
    x = F.least(span, F.greatest(F.lit(0.0), v))
    return F.when(x.isNull() | F.isnan(x) | (v == float("inf")) | (v == float("-inf")), 0.0).otherwise(x)


def _div(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def _two_mechanisms(d: DataFrame) -> tuple[DataFrame, Column, Column]:
    """Even and odd powers of what the volume leaves: copolar powers a, b and their correlation cr + i ci.

    The correlation is shortened to what a and b allow. Its sign tells which of the two has a known ratio of one
    (Re > 0: odd, with ratio 1; else even, with ratio -1); the other's power and ratio follow. Where a or b
    is not positive (``bad``) both are 0.
    """
    a, b = F.col("a"), F.col("b")
    room, rho2 = a * b, F.col("cr") ** 2 + F.col("ci") ** 2
    d = d.withColumn("bad", (a <= 0) | (b <= 0))
    fit = F.when((rho2 > room) & ~F.col("bad"), F.sqrt(room / rho2)).otherwise(1.0)
    d = d.withColumns({"cr": F.col("cr") * fit, "ci": F.col("ci") * fit})
    cr, ci, odd_known = F.col("cr"), F.col("ci"), F.col("cr") >= 0
    sign = F.when(odd_known, 1.0).otherwise(-1.0)
    d = d.withColumn("f", _div(room - cr * cr - ci * ci, a + b + 2 * sign * cr))
    d = d.withColumn("g", b - F.col("f"))
    known, other = 2 * F.col("f"), F.col("g") * (1 + _div((F.col("f") + sign * cr) ** 2 + ci * ci, F.col("g") * F.col("g")))
    of = lambda positive, negative: F.when(F.col("bad"), 0.0).when(odd_known, positive).otherwise(negative)
    return d, of(known, other), of(other, known)


def freemandurden(r: Raster) -> Raster:
    """Even, odd and volume powers by the three-component model."""
    r, span, hh, vv, hv, c = _powers(r)
    volume = hv * 3
    d = r.df.select("y", "x", span.alias("span"), volume.alias("fv"), (hh - volume).alias("a"), (vv - volume).alias("b"), (c[0] - volume / 3).alias("cr"), c[1].alias("ci"))
    d, even, odd = _two_mechanisms(d)
    vol = F.when(F.col("bad"), F.col("span")).otherwise(8 * F.col("fv") / 3)
    return _real(r.with_df(d), [_clip(x, F.col("span")) for x in (even, odd, vol)], CH_name=["even", "odd", "volume"])


def yamaguchi3(r: Raster, strict: bool = False) -> Raster:
    """Three components with the volume model chosen by the copolar ratio.

    The modulus of the copolar correlation is used unless ``strict``, which takes its parts as published.
    """
    r, span, hh, vv, hv, c = _powers(r)
    cr, ci = c if strict else (F.sqrt(cplx.abs2(c)), F.lit(0.0))
    d = r.df.select("y", "x", span.alias("span"), hh.alias("hh"), vv.alias("vv"), hv.alias("hv"), cr.alias("cr"), ci.alias("ci"))
    ratio = 10 * F.log10(_div(F.col("vv"), F.col("hh")))
    pick = lambda x, y, z: F.when(ratio < -2.0, x).when(ratio > 2.0, y).when(ratio.between(-2.0, 2.0), z).otherwise(0.0)
    d = d.withColumn("fv", pick(15.0, 15.0, 16.0) / 4.0 * F.col("hv"))
    fv = F.col("fv")
    d = d.select("y", "x", "span", "fv", (F.col("hh") - pick(8 / 15, 3 / 15, 3 / 8) * fv).alias("a"), (F.col("vv") - pick(3 / 15, 8 / 15, 3 / 8) * fv).alias("b"), (F.col("cr") - pick(2 / 15, 2 / 15, 1 / 8) * fv).alias("cr"), "ci")
    d, even, odd = _two_mechanisms(d)
    vol = F.when(F.col("bad"), F.col("span")).otherwise(fv)
    return _real(r.with_df(d), [_clip(x, F.col("span")) for x in (even, odd, vol)], CH_name=["even", "odd", "volume"])


def _eigen(r: Raster):
    """(y, x, ew, re, im): the eigenvalues and vectors of each pixel's matrix, by one pass over Arrow batches."""
    n = r.lshape[0]

    def run(batches):
        for p in batches:
            m = (np.stack(p["re"]) + 1j * np.stack(p["im"])).reshape(-1, n, n) if len(p) else np.zeros((0, n, n), complex)
            w, v = np.linalg.eigh(m)
            w = np.where(w <= 0, 0.0, w)
            order = np.argsort(-w, axis=1, kind="stable")
            w = np.take_along_axis(w, order, 1)
            v = np.take_along_axis(v, order[:, None, :], 2).reshape(len(m), n * n)
            yield pd.DataFrame({"y": p["y"], "x": p["x"], "ew": list(w), "re": list(v.real), "im": list(v.imag)})

    return r.df.mapInPandas(run, "y long, x long, ew array<double>, re array<double>, im array<double>")


def eigen(r: Raster) -> tuple[Raster, Raster]:
    """Eigenvalues, negative ones 0, largest first, and eigenvectors; batched over Arrow.

    The values are one PIX raster (n), the vectors another (n, n): element (i, k) is component i of
    vector k. An eigenvector's phase is free; use moduli.
    """
    r = r.pix()
    n = r.lshape[0]
    both = _eigen(r)
    values = r.with_df(both.select("y", "x", F.col("ew").alias("re")), lshape=(n,), complex=False)
    return values, r.with_df(both.select("y", "x", "re", "im"), lshape=(n, n))


def entalpani(ew: Raster, ev: Raster | None = None) -> Raster:
    """Entropy, alpha of the first vector, mean alpha, anisotropy of the first two values.

    From eigenvalues and vectors, joined on (y, x), or from covariance matrices alone: then both come from
    one pass and nothing is joined.
    """
    n = ew.lshape[0]
    if ev is None:
        d = _eigen(ew.pix()).select("y", "x", F.col("ew").alias("w"), F.col("re").alias("a"), F.col("im").alias("b"))
    else:
        d = ew.pix().df.select("y", "x", F.col("re").alias("w")).join(ev.pix().df.select("y", "x", F.col("re").alias("a"), F.col("im").alias("b")), ["y", "x"])
    w = [F.get("w", F.lit(k)) for k in range(n)]
    total = reduce(lambda p, q: p + q, w)
    p = [F.when(total == 0, 1.0).otherwise(x / F.when(total == 0, 1.0).otherwise(total)) for x in w]
    # 0 * log 0 has no value; such pixels have none either.
    terms = [F.when(x > 0, -x * F.ln(x) / math.log(n)).otherwise(F.lit(float("nan"))) for x in p]
    alpha = [F.acos(F.least(F.lit(1.0), F.sqrt(cplx.abs2(at(k, "a", "b"))))) for k in range(n)]
    mean = reduce(lambda a, b: a + b, [a * x for a, x in zip(alpha, p, strict=True)])
    two = w[0] + w[1]
    aniso = (w[0] - w[1]) / F.when(two == 0, 1.0).otherwise(two)
    return _real(ew.with_df(d), [reduce(lambda a, b: a + b, terms), alpha[0], mean, aniso], CH_name=["Entropy", "AlphaMax", "AlphaMean", "Anisotropy"])


def entalpclass(r: Raster, alpha: bool = True, ordered: bool = False) -> Raster:
    """Nine classes of entropy and alpha; the default numbering leaves low entropy, 47.5 to 55 degrees at 0."""
    r = r.pix()
    h, a = F.get("re", F.lit(0)), F.degrees(F.get("re", F.lit(1 if alpha else 2)))
    lo, mid, hi = h < 0.5, (h >= 0.5) & (h < 0.9), h >= 0.9
    if ordered:
        rules = [(lo & (a < 42.5), 0), (mid & (a < 40), 1), (hi & (a < 40), 2), (lo & (a >= 42.5) & (a < 47.5), 3), (mid & (a >= 40) & (a < 50), 4), (hi & (a >= 40) & (a < 55), 5), (hi & (a >= 55), 6), (mid & (a >= 50), 7), (lo & (a >= 47.5), 8)]
    else:
        rules = [(hi & (a >= 55), 0), (hi & (a >= 40) & (a < 55), 1), (hi & (a < 40), 2), (mid & (a >= 50), 3), (mid & (a < 40), 5), (mid & (a >= 0) & (a < 50), 4), (lo & (a >= 55), 6), (lo & (a >= 42.5) & (a < 47.5), 7), (lo & (a < 42.5), 8)]
    out = F
    for cond, k in rules:
        out = out.when(cond, k)
    return r.with_df(r.df.select("y", "x", out.otherwise(0).cast("double").alias("re")), lshape=(), form="long", complex=False)


def orientationangle(r: Raster, win: tuple[int, int] = (7, 7)) -> Raster:
    r = r.pix()
    hh, vv, xx = (at(k) for k in _pol(r, "HH", "VV", "XX"))
    srr = cplx.linear([(0.5, hh), (-0.5, vv), (1j, xx)])
    sll = cplx.linear([(0.5, vv), (-0.5, hh), (1j, xx)])
    d = r.df.select("y", "x", srr[0].alias("a"), srr[1].alias("b"), sll[0].alias("c"), sll[1].alias("d"))
    re, im = cplx.mul_conj((F.col("a"), F.col("b")), (F.col("c"), F.col("d")))
    d = box_mean(d.select("y", "x", re.alias("re"), im.alias("im")), [], ["re", "im"], r.ny, r.nx, win)
    return r.with_df(d.select("y", "x", (F.atan2("im", "re") / 4).alias("re")), lshape=(), form="long", complex=False)


def neszfilter(r: Raster, gdev: float = 13.0, noise: float = 1.0) -> Raster:
    """Noise floor from the incoherence of HV and VH, taken off every channel of a vector."""
    r = r.pix()
    hv, vh = (at(k) for k in _pol(r, "HV", "VH"))
    cr, ci = cplx.mul_conj(hv, vh)
    d = r.df.select("y", "x", "re", "im", cr.alias("cr"), ci.alias("ci"), cplx.abs2(hv).alias("ih"), cplx.abs2(vh).alias("iv"))
    d = gauss_df(d, [], ["cr", "ci", "ih", "iv"], r.ny, r.nx, (gdev, gdev))
    floor = F.sqrt(F.col("ih") * F.col("iv")) - F.sqrt(F.col("cr") ** 2 + F.col("ci") ** 2)
    d = d.withColumn("n", floor)

    def gain(k: int) -> Column:
        i = cplx.abs2(at(k))
        x = safe(i - F.col("n") - noise * F.sqrt(F.greatest(F.lit(0.0), i * F.col("n"))), i)
        return F.when((x >= 0) & (F.col("n") >= 0), F.sqrt(x)).otherwise(0.0)

    n = r.channels
    return r.with_df(d.select("y", "x", F.array(*[at(k)[0] * gain(k) for k in range(n)]).alias("re"), F.array(*[at(k)[1] * gain(k) for k in range(n)]).alias("im")))


# --- classification and change -------------------------------------------------------------------------


def _centre_rows(d: DataFrame, label: Column, n: int) -> DataFrame:
    """(label, npix, re_0 .., im_0 ..): the mean matrix of each class, from partial sums per task."""
    flat = [F.avg(F.get(p, F.lit(k))).alias(f"{p}_{k}") for p in ("re", "im") for k in range(n * n)]
    return d.groupBy(label.cast("int").alias("label")).agg(F.count(F.lit(1)).alias("npix"), *flat)


def _matrices(rows: DataFrame, n: int) -> list[np.ndarray]:
    found = rows.orderBy("label").collect()  # a row a class
    return [np.array([complex(row[f"re_{k}"], row[f"im_{k}"]) for k in range(n * n)]).reshape(n, n) for row in found]


def class_means(cov: Raster, labels: Raster) -> DataFrame:
    """A row for each non-empty class: label, npix and its mean matrix, element by element."""
    r = cov.pix()
    return _centre_rows(r.df.join(labels.long().df.select("y", "x", F.col("re").alias("c")), ["y", "x"]), F.col("c"), r.lshape[0])


def class_centres(cov: Raster, labels: Raster) -> list[np.ndarray]:
    """Mean matrix of each non-empty class, by class number."""
    return _matrices(class_means(cov, labels), cov.lshape[0])


def _nearest(centres: list[np.ndarray]) -> Column:
    """The number of the centre of least Wishart distance |tr(C Z^-1)| + ln |det Z|: literal factors, no UDF."""
    dist = []
    for k, z in enumerate(centres):
        w = np.linalg.inv(z).T.ravel()
        re = " + ".join(f"re[{i}] * {v.real!r}D - im[{i}] * {v.imag!r}D" for i, v in enumerate(w.tolist()))
        im = " + ".join(f"re[{i}] * {v.imag!r}D + im[{i}] * {v.real!r}D" for i, v in enumerate(w.tolist()))
        dist.append(f"struct(sqrt(pow({re}, 2D) + pow({im}, 2D)) + {math.log(abs(np.linalg.det(z)))!r}D as d, {k} as k)")
    return F.expr(f"cast(array_min(array({', '.join(dist)})).k as double)")


def classassign(cov: Raster, centres: list[np.ndarray]) -> Raster:
    r = cov.pix()
    return r.with_df(r.df.select("y", "x", _nearest(centres).alias("re")), lshape=(), form="long", complex=False)


def wishart(cov: Raster, classes: int = 8, iterations: int = 10, start: Raster | None = None, seed: int = 0) -> tuple[Raster, list[np.ndarray]]:
    """K-means with the Wishart distance from a start or a seeded hash of the pixel, empty classes dropped.

    The matrices are checkpointed once, with the start beside them. An iteration is one pass that adds up matrices by
    nearest centre in Arrow batches, then a sum of a few rows a task: no join, no lineage, no plan to compile anew.
    """
    from ..plans import cut

    cov = cov.pix()
    n = cov.lshape[0]
    if start is None:
        d = cov.df.withColumn("c", (F.pmod(F.xxhash64("y", "x", F.lit(seed)), F.lit(classes)) + 1).cast("double"))
    else:
        d = cov.df.join(start.long().df.select("y", "x", F.col("re").alias("c")), ["y", "x"])
    d = cut(d.select("y", "x", "re", "im", "c"))
    parts = [f"{p}_{k}" for p in ("re", "im") for k in range(n * n)]
    schema = "label int, npix long, " + ", ".join(f"{p} double" for p in parts)
    centres: list[np.ndarray] = []
    for _ in range(iterations):
        factors = np.array([np.linalg.inv(z).T.ravel() for z in centres]).T
        level = np.array([math.log(abs(np.linalg.det(z))) for z in centres])

        def tally(batches, factors=factors, level=level):
            for batch in batches:
                m = [batch.column(k).flatten().to_numpy().reshape(-1, n * n) for k in (0, 1)]
                label = (np.abs((m[0] + 1j * m[1]) @ factors) + level).argmin(1) if len(level) else batch.column(2).to_numpy().astype(int)
                found, at = np.unique(label, return_inverse=True)
                sums = np.zeros((len(found), 2 * n * n))
                np.add.at(sums, at, np.hstack(m))
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(np.bincount(at, minlength=len(found))), *(pa.array(c) for c in sums.T)], ["label", "npix", *parts])

        rows = d.select("re", "im", "c").mapInArrow(tally, schema).groupBy("label").agg(*[F.sum(p).alias(p) for p in ("npix", *parts)])
        centres = _matrices(rows.select("label", *[(F.col(p) / F.col("npix")).alias(p) for p in parts]), n)
    label = _nearest(centres) if centres else F.col("c")
    return cov.with_df(d.select("y", "x", label.alias("re")), lshape=(), form="long", complex=False), centres


def classextract(labels: Raster, classes: list[int]) -> Raster:
    r = labels.long()
    keep = F.col("re").isin([float(c) for c in classes])
    meta = dict(r.meta)
    if isinstance(meta.get("labels"), dict):
        meta["labels"] = {k: v for k, v in meta["labels"].items() if k in classes}
    return r.with_df(r.df.select(*r.keys, "y", "x", F.when(keep, F.col("re")).otherwise(-9999.0).alias("re")), meta=meta)


def _chi2_cdf(x: np.ndarray, k: int) -> np.ndarray:
    """The chi-square distribution of whole degrees of freedom, by its finite series."""
    x = np.maximum(x, 0.0)
    h = x / 2
    if k % 2 == 0:
        term, total = np.exp(-h), np.exp(-h)
        for i in range(1, k // 2):
            term = term * h / i
            total = total + term
        return 1 - total
    erf = np.vectorize(math.erf)
    out = erf(np.sqrt(h))
    term = np.exp(-h) * np.sqrt(h) / math.gamma(1.5)
    for i in range(1, (k + 1) // 2):
        out = out - term
        term = term * h / (i + 0.5)
    return out


def majority3(r: Raster) -> Raster:
    """3 x 3 median of a 0/1 mask, 0 outside: five or more of nine."""
    from ..windows import slide

    total = lambda line: F.sum("re").over(line.rowsBetween(-1, 1))
    d = slide(r.df, r.keys, "x", r.nx, 0, 0, {"re": total}, reach=1)
    d = slide(d, r.keys, "y", r.ny, 0, 0, {"re": total}, reach=1)
    return r.with_df(d.withColumn("re", (F.col("re") >= 5).cast("double")))


def changedet(a: Raster, b: Raster, n1: float = 16, n2: float = 16, threshold: float = 0.99) -> tuple[Raster, Raster]:
    """Wishart likelihood-ratio test of equal covariance: probability of change, and its cleaned mask."""
    p = a.lshape[0] if a.lshape else 1
    a, b = a.pix(), b.pix()
    d = a.df.join(b.df.select("y", "x", F.col("re").alias("re2"), F.col("im").alias("im2")), ["y", "x"])
    m1, m2 = at, (lambda i: at(i, "re2", "im2"))
    both = lambda i: cplx.add(m1(i), m2(i))
    mod = lambda m: F.sqrt(cplx.abs2(determinant(p, m)))
    const = p * ((n1 + n2) * math.log(n1 + n2) - n1 * math.log(n1) - n2 * math.log(n2))
    rho = 1 - (2 * p**2 - 1) * (1 / n1 + 1 / n2 - 1 / (n1 + n2)) / (6 * p)
    o2 = p**2 * (p**2 - 1) * (1 / n1**2 + 1 / n2**2 - 1 / (n1 + n2) ** 2) / (24 * rho**2) - 0.25 * p**2 * (1 - 1 / rho) ** 2
    lnq = -2 * rho * (const + n1 * F.ln(mod(m1)) + n2 * F.ln(mod(m2)) - (n1 + n2) * F.ln(mod(both)))

    @F.pandas_udf("double")
    def probability(v: pd.Series) -> pd.Series:
        x = v.to_numpy(float)
        return pd.Series((1 - o2) * _chi2_cdf(x, p * p) + o2 * _chi2_cdf(x, p * p + 4))

    d = d.select("y", "x", lnq.alias("lnq")).withColumn("re", probability("lnq"))
    pfa = a.with_df(d.select("y", "x", "lnq", "re"), lshape=(), form="long", complex=False)
    mask = majority3(pfa.with_df(d.select("y", "x", (F.col("re") > threshold).cast("double").alias("re"))))
    return pfa, mask


def coherchangedet(cov: Raster, noise: float = 1e-3, threshold: float = 0.5) -> Raster:
    """Pixels above the noise whose best coherence over channel pairs of two dates is low, cleaned."""
    r = cov.pix()
    m = r.lshape[0]
    n = m // 2
    best, power = F.lit(0.0), F.lit(0.0)
    for k in range(n):
        c1, c2 = at(k * m + k)[0], at((k + n) * m + k + n)[0]
        coh = safe(F.sqrt(cplx.abs2(at(k * m + k + n))), F.sqrt(c1 * c2))
        up = coh > best
        best, power = F.when(up, coh).otherwise(best), F.when(up, 0.5 * (c1 + c2)).otherwise(power)
    mask = ((power > noise) & (best < threshold)).cast("double")
    return majority3(r.with_df(r.df.select("y", "x", mask.alias("re")), lshape=(), form="long", complex=False))
