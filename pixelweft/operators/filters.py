"""Moving-window filters, edges, texture and speckle filters from box means, weighted sums and shifts."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..raster import Raster
from ..tiles import map_tiles
from ..windows import box_mean, gauss as gauss_df, kernel2d, safe, shifted, slide
from .point import complex2abs, sarscale

Win = tuple[int, int]


def _values(r: Raster) -> list[str]:
    return ["re", "im"] if r.complex else ["re"]


def _clean(r: Raster) -> Raster:
    """NaN to 0."""
    r = r.long()
    return r.with_df(r.df.withColumns({c: F.nanvl(c, F.lit(0.0)) for c in _values(r)}))


def _amplitude(r: Raster) -> Raster:
    r = r.long()
    return complex2abs(r) if r.complex else r.with_df(r.df.withColumn("re", F.abs("re")))


def _only(r: Raster, df, **cols: Column) -> Raster:
    return r.with_df(df.select(*r.keys, "y", "x", *[c.alias(n) for n, c in cols.items()]), complex="im" in cols)


def _phase_mean(r: Raster, smooth) -> Raster:
    df = r.df.select(*r.keys, "y", "x", F.cos("re").alias("c"), F.sin("re").alias("s"))
    return _only(r, smooth(df, ["c", "s"]), re=F.atan2("s", "c"))


def boxcar(r: Raster, win: Win = (7, 7), phase: bool = False) -> Raster:
    """Box mean; complex parts on their own; for phase the angle of the mean phasor."""
    r = _clean(r)
    smooth = lambda df, cols: box_mean(df, r.keys, cols, r.ny, r.nx, win)
    return _phase_mean(r, smooth) if phase else r.with_df(smooth(r.df, _values(r)))


def phase_boxcar(r: Raster, win: Win = (7, 7)) -> Raster:
    """Box mean of complex values; real values are phases."""
    return boxcar(r, win, phase=not r.complex)


def gauss(r: Raster, sigma: tuple[float, float] = (7, 7), phase: bool = False) -> Raster:
    r = _clean(r)
    smooth = lambda df, cols: gauss_df(df, r.keys, cols, r.ny, r.nx, sigma)
    return _phase_mean(r, smooth) if phase else r.with_df(smooth(r.df, _values(r)))


def median(r: Raster, win: Win = (7, 7), phase: bool = False) -> Raster:
    """Median of the window, upper of the middle for even counts; phases are averaged."""
    if phase:
        return boxcar(r, win, True)
    r = _clean(r)
    a, b = win[0] // 2, win[1] // 2

    def kernel(block):
        def one(p):
            v = np.lib.stride_tricks.sliding_window_view(p, win).reshape(p.shape[0] - win[0] + 1, p.shape[1] - win[1] + 1, -1)
            out = p.copy()
            k = v.shape[-1] // 2
            out[a : a + v.shape[0], b : b + v.shape[1]] = np.partition(v, k, axis=-1)[..., k]
            return out

        return np.stack([one(c.real) + 1j * one(c.imag) if np.iscomplexobj(c) else one(c) for c in block])

    return map_tiles(r, (a, b), kernel)


def kernelfilter(r: Raster, kernel: list[list[float]], phase: bool = False) -> Raster:
    r = _clean(r)
    smooth = lambda df, cols: kernel2d(df, r.keys, cols, r.ny, r.nx, kernel)
    return _phase_mean(r, smooth) if phase else r.with_df(smooth(r.df, _values(r)))


def smooth(r: Raster, box: Win = (3, 3), phase: bool = False) -> Raster:
    return boxcar(r, box, phase)


# --- edges -------------------------------------------------------------------------------------------


def sobel(r: Raster) -> Raster:
    """Magnitude of the two Sobel derivatives of the amplitude."""
    r = _amplitude(r)
    diff = lambda c: lambda line: F.lead(c, 1).over(line) - F.lag(c, 1).over(line)
    mean = lambda c: lambda line: F.lag(c, 1).over(line) + 2.0 * F.col(c) + F.lead(c, 1).over(line)
    # Both derivatives share the pass along each axis.
    df = slide(r.df, r.keys, "y", r.ny, 1, 1, {"p": diff("re"), "q": mean("re")})
    df = slide(df, r.keys, "x", r.nx, 1, 1, {"p": mean("p"), "q": diff("q")})
    return _only(r, df, re=F.sqrt(F.col("p") * F.col("p") + F.col("q") * F.col("q")))


def roberts(r: Raster) -> Raster:
    """Roberts cross: both diagonal differences; the first row and column, without neighbours, mirror."""
    r = _amplitude(r)
    df = shifted(r.df, r.keys, r.ny, r.nx, {"a": ("re", -1, -1), "b": ("re", -1, 0), "c": ("re", 0, -1)}, mode="reflect")
    d1, d2 = F.col("re") - F.col("a"), F.col("c") - F.col("b")
    return _only(r, df, re=F.sqrt(d1 * d1 + d2 * d2) / F.sqrt(F.lit(2.0)))


def roa(r: Raster, win: int = 3) -> Raster:
    """Ratio of averages in four directions over shifted means (periodic), root of the sum of squares."""
    r = _amplitude(r)
    d = (win + 1) // 2
    df = box_mean(r.df, r.keys, ["re"], r.ny, r.nx, (win, win))
    at = {f"s{a}{b}": ("re", -da * d, -db * d) for a, da in (("p", 1), ("0", 0), ("m", -1)) for b, db in (("p", 1), ("0", 0), ("m", -1)) if (a, b) != ("0", "0")}
    df = shifted(df, r.keys, r.ny, r.nx, at)
    add = lambda *n: reduce(lambda p, q: p + q, [F.col("s" + k) for k in n])
    ratios = [(add("0p", "pp", "mp"), add("0m", "pm", "mm")), (add("pp", "p0", "0p"), add("mm", "m0", "0m")), (add("p0", "pp", "pm"), add("m0", "mm", "mp")), (add("mp", "0p", "m0"), add("pm", "p0", "0m"))]
    total, bad = F.lit(0.0), F.lit(False)
    for p, q in ratios:
        bad = bad | (p == 0) | (q == 0)
        g = F.greatest(F.try_divide(p, q), F.try_divide(q, p))
        total = total + g * g
    return _only(r, df, re=F.when(bad, 0.0).otherwise(F.sqrt(total)))


def leeroa(r: Raster, win: int = 3) -> Raster:
    """Largest of eight relative differences between shifted means and the mean."""
    r = _amplitude(r)
    d = (win + 1) // 2
    df = box_mean(r.df, r.keys, ["re"], r.ny, r.nx, (win, win))
    at = {f"s{i}{j}": ("re", -(i - 1) * d, -(j - 1) * d) for i in range(3) for j in range(3) if (i, j) != (1, 1)}
    df = shifted(df, r.keys, r.ny, r.nx, at)
    rel = [F.abs(F.try_divide(F.col(n), F.col("re")) - 1.0) for n in at]
    return _only(r, df, re=F.when(F.col("re") == 0, 0.0).otherwise(F.greatest(*rel)))


# --- texture -----------------------------------------------------------------------------------------


def covar(r: Raster, win: Win = (7, 7)) -> Raster:
    r = _amplitude(r)
    df = box_mean(r.df.withColumn("m2", F.col("re") * F.col("re")), r.keys, ["re", "m2"], r.ny, r.nx, win)
    sq = F.col("re") * F.col("re")
    return _only(r, df, re=safe(F.col("m2") - sq, sq))


def _gain(looks: float) -> Column:
    """Lee's k factor from columns m (mean) and m2 (mean square)."""
    sig2 = 1.0 / looks
    sq = F.col("m") * F.col("m")
    vary = F.greatest(F.col("m2") - sq, F.lit(1e-10))
    varx = F.greatest((vary - sq * sig2) / (1.0 + sig2), F.lit(0.0))
    return varx / vary


def inhomogeneity(r: Raster, win: Win = (7, 7), looks: float = 1.0, damp: bool = False) -> Raster:
    r = _amplitude(r)
    df = box_mean(r.df.withColumns({"m": F.col("re"), "m2": F.col("re") * F.col("re")}), r.keys, ["m", "m2"], r.ny, r.nx, win)
    k = _gain(looks)
    if damp:
        k = k * F.greatest(safe(F.col("re") - F.col("m"), F.col("re") + F.col("m")), F.lit(0.0))
    return _only(r, df, re=k)


def entropy(r: Raster, win: Win = (7, 7)) -> Raster:
    """Entropy in bits of the byte-scaled values in the window; what lies outside the image isn't counted."""
    r = sarscale(_amplitude(r))
    a, b = win[0] // 2, win[1] // 2

    def kernel(block):
        p = block[0]
        v = np.lib.stride_tricks.sliding_window_view(p, win).reshape(-1, win[0] * win[1])
        s = np.sort(v, axis=1)
        n = (s >= 0).sum(1)
        start = np.ones_like(s, bool)
        start[:, 1:] = s[:, 1:] != s[:, :-1]
        flat = np.flatnonzero(start)
        size = np.diff(np.append(flat, s.size))
        row = flat // s.shape[1]
        real = s.ravel()[flat] >= 0
        q = size[real] / n[row[real]]
        out = np.zeros_like(p)
        out[a : a + p.shape[0] - win[0] + 1, b : b + p.shape[1] - win[1] + 1] = np.bincount(row[real], -q * np.log2(q), len(s)).reshape(p.shape[0] - win[0] + 1, -1)
        return out[None]

    # Shifted by one, so that 0 outside the image becomes -1.
    up = r.with_df(r.df.withColumn("re", F.col("re") + 1.0))
    return map_tiles(up, (a, b), lambda block: kernel(block - 1.0), border="zero")


GLCM_POINT = {"contrast": lambda d: d * d, "dissimilarity": lambda d: F.abs(d), "homogeneity": lambda d: 1.0 / (1.0 + d * d)}


def glcm(r: Raster, win: int = 7, levels: int = 16, dist: int = 1, angles: tuple[int, ...] = (0, 45, 90, 135), prop: str = "contrast", symmetric: bool = True) -> Raster:
    """Co-occurrence texture of the quantised image, mean over angles; a border of half a window keeps the levels."""
    r = sarscale(_amplitude(r))
    r = r.with_df(r.df.withColumn("re", F.floor(F.col("re") / (256.0 / levels)).cast("double")))
    steps = {0: (0, dist), 45: (-dist, dist), 90: (-dist, 0), 135: (-dist, -dist)}
    h = win // 2
    inner = (F.col("y") >= h) & (F.col("y") < r.ny - (win - 1 - h)) & (F.col("x") >= h) & (F.col("x") < r.nx - (win - 1 - h))
    if prop in GLCM_POINT:
        # A function of the pair's difference: its mean over the pairs of a window is a box mean.
        names = {f"n{a}": ("re", *steps[a]) for a in angles}
        df = shifted(r.df, r.keys, r.ny, r.nx, names, mode="reflect")
        df = df.withColumns({n: GLCM_POINT[prop](F.col(n) - F.col("re")) for n in names})
        for a in angles:
            dy, dx = steps[a]
            # Pairs whose both ends lie in the window: rows and columns of the first end.
            n = f"n{a}"
            up, left = -min(0, dy), -min(0, dx)
            size = (win - abs(dy), win - abs(dx))
            df = shifted(df, r.keys, r.ny, r.nx, {n + "_s": (n, up - h + size[0] // 2, left - h + size[1] // 2)}, mode="reflect")
            df = box_mean(df.drop(n).withColumnRenamed(n + "_s", n), r.keys, [n], r.ny, r.nx, size)
        total = reduce(lambda p, q: p + q, [F.col(n) for n in names]) / len(names)
        return _only(r, df, re=F.when(inner, total).otherwise(F.col("re")))

    ny, nx = r.ny, r.nx

    def kernel(block, yy, xx):
        p = block[0].astype(int)
        v = np.lib.stride_tricks.sliding_window_view(p, (win, win))
        out = block[0].copy()
        acc = np.zeros(v.shape[:2])
        for a in angles:
            dy, dx = steps[a]
            i = v[:, :, max(0, -dy) : win - max(0, dy), max(0, -dx) : win - max(0, dx)]
            j = v[:, :, max(0, dy) : win + min(0, dy), max(0, dx) : win + min(0, dx)]
            code = (i * levels + j).reshape(*v.shape[:2], -1)
            m = np.zeros((*v.shape[:2], levels * levels))
            np.add.at(m, (*np.indices(code.shape)[:2], code), 1)
            m = m.reshape(*v.shape[:2], levels, levels)
            if symmetric:
                m = m + m.swapaxes(-1, -2)
            m /= m.sum((-1, -2), keepdims=True)
            k = np.arange(levels)
            if prop in ("ASM", "energy"):
                f = (m * m).sum((-1, -2))
                f = np.sqrt(f) if prop == "energy" else f
            else:
                mi, mj = (m.sum(-1) * k).sum(-1), (m.sum(-2) * k).sum(-1)
                si = np.sqrt((m.sum(-1) * (k - mi[..., None]) ** 2).sum(-1))
                sj = np.sqrt((m.sum(-2) * (k - mj[..., None]) ** 2).sum(-1))
                cov = (m * (k[:, None] - mi[..., None, None]) * (k[None] - mj[..., None, None])).sum((-1, -2))
                f = np.where((si < 1e-15) | (sj < 1e-15), 1.0, cov / np.where(si * sj == 0, 1, si * sj))
            acc += f
        out[h : h + v.shape[0], h : h + v.shape[1]] = acc / len(angles)
        inside = ((yy >= h) & (yy < ny - (win - 1 - h)))[:, None] & ((xx >= h) & (xx < nx - (win - 1 - h)))[None]
        return np.where(inside, out, block[0])[None]

    return map_tiles(r, (win, win), kernel, tile=(32, 64), located=True)


# --- speckle filters -----------------------------------------------------------------------------------


def _span(r: Raster):
    """The raster in PIX form or LONG, with its span column: power of all channels, or matrix trace."""
    if len(r.lshape) == 2:
        p, n = r.pix(), r.lshape[0]
        tr = reduce(lambda a, b: a + b, [F.get("re", F.lit(i * n + i)) for i in range(n)])
        ti = reduce(lambda a, b: a + b, [F.get("im", F.lit(i * n + i)) for i in range(n)]) if r.complex else F.lit(0.0)
        return p, p.df.withColumn("span", F.sqrt(tr * tr + ti * ti))
    a = _amplitude(r)
    if len(r.lshape) == 1:
        p = a.pix()
        return p, p.df.withColumn("span", F.aggregate("re", F.lit(0.0), lambda s, v: s + v * v))
    return a, a.df.withColumn("span", F.col("re") * F.col("re"))


def _adaptive(r: Raster, win: Win, gain: Column) -> Raster:
    """mean + (value - mean) * gain, the gain from window moments of the span."""
    src, df = _span(_clean(r) if r.form == "long" else r)
    values = ["re", "im"] if src.complex else ["re"]
    n = src.channels if src.form == "pix" else 0
    flat = [(f"{c}_{k}", F.get(c, F.lit(k))) for c in values for k in range(n)] if n else [(f"{c}_0", F.col(c)) for c in values]
    df = df.select("y", "x", *[e.alias(c) for c, e in flat], *[e.alias("v_" + c) for c, e in flat], F.col("span").alias("m"), (F.col("span") * F.col("span")).alias("m2"))
    df = box_mean(df, [], [c for c, _ in flat] + ["m", "m2"], src.ny, src.nx, win)
    df = df.withColumn("k", gain)
    out = lambda c: F.col(c) + (F.col("v_" + c) - F.col(c)) * F.col("k")
    if not n:
        return src.with_df(df.select("y", "x", *[out(f"{c}_0").alias(c) for c in values]))
    return src.with_df(df.select("y", "x", *[F.array(*[out(f"{c}_{k}") for k in range(n)]).alias(c) for c in values]))


def lee(r: Raster, win: Win = (7, 7), looks: float = 1.0) -> Raster:
    return _adaptive(r, win, _gain(looks))


def kuan(r: Raster, win: Win = (7, 7), looks: float = 1.0) -> Raster:
    cu2 = 1.0 / looks if looks else 0.0625
    sq = F.col("m") * F.col("m")
    vary = F.greatest(F.col("m2") - sq, F.lit(1e-10))
    return _adaptive(r, win, F.greatest(1.0 - cu2 * sq / vary, F.lit(0.0)) / max(1.0 + cu2, 1e-10))


def srad(r: Raster, looks: float = 2.0, step: float = 0.15, iterations: int = 100, scale: float = 1.0, every: int = 10) -> Raster:
    """Speckle-reducing anisotropic diffusion of an intensity image; edges are mirrored on all sides.

    An iteration reads two pixels around each, so tiles with a halo of twice ``every`` take that many iterations
    by themselves; then the plan is cut into a checkpointed table.
    """
    import math

    from ..plans import cut

    r = r.long()
    ny, nx = r.ny, r.nx

    def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.divide(a, b, out=np.zeros_like(a), where=b != 0)

    for first in range(0, iterations, every):
        rounds = range(first, min(iterations, first + every))

        def kernel(block: np.ndarray, yy: np.ndarray, xx: np.ndarray, rounds=rounds) -> np.ndarray:
            inside = np.ix_((yy >= 0) & (yy < ny), (xx >= 0) & (xx < nx))
            v = block[0][inside]
            for k in rounds:
                q0 = (math.exp(-step * k / 6.0) / math.sqrt(looks) * scale) ** 2
                p = np.pad(v, 1, "symmetric")
                north, south, west, east = p[:-2, 1:-1] - v, p[2:, 1:-1] - v, p[1:-1, :-2] - v, p[1:-1, 2:] - v
                grad = ratio(north**2 + south**2 + west**2 + east**2, v * v)
                lap = ratio(north + south + west + east, v)
                q = ratio(0.5 * grad - lap * lap / 16.0, (1.0 + 0.25 * lap) ** 2)
                c = np.clip(1.0 / (1.0 + (q - q0) / (q0 * (1.0 + q0))), 0.0, 1.0)
                p = np.pad(c, ((0, 1), (0, 1)), "symmetric")
                v = v + step / 4.0 * (p[1:, :-1] * south + c * north + p[:-1, 1:] * east + c * west)
            out = block[0].copy()
            out[inside] = v
            return out[None]

        r = map_tiles(r, (2 * len(rounds), 2 * len(rounds)), kernel, located=True)
        if rounds.stop < iterations:
            r = r.with_df(cut(r.df))
    return r
