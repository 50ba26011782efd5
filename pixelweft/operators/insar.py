"""Interferometry: coherence by box means, phase filters by overlapping patches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import cplx
from ..functions.cplx import at
from ..raster import Raster
from ..tiles import map_lines, overlap_add
from ..windows import box_mean, safe


def _joined(layers: list[Raster]):
    df = None
    for k, r in enumerate(layers):
        d = r.long().df.select("y", "x", F.col("re").alias(f"r{k}"), F.col("im").alias(f"i{k}"))
        df = d if df is None else df.join(d, ["y", "x"])
    return df


def _moments(layers: list[Raster], win: tuple[int, int]):
    """Box means of all products i <= j, in one pass per axis for all of them."""
    first, n = layers[0], len(layers)
    df, names = _joined(layers), []
    z = [(F.col(f"r{k}"), F.col(f"i{k}")) for k in range(n)]
    cols: dict[str, Column] = {}
    for i in range(n):
        cols[f"p{i}"] = cplx.abs2(z[i])
        for j in range(i + 1, n):
            cols[f"r{i}_{j}"], cols[f"i{i}_{j}"] = cplx.mul_conj(z[i], z[j])
    names = list(cols)
    df = df.select("y", "x", *[c.alias(k) for k, c in cols.items()])
    return box_mean(df, [], names, first.ny, first.nx, win)


def _unit(v: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))


def _pair(i: int, j: int) -> tuple[Column, Column, Column]:
    a, b = min(i, j), max(i, j)
    sign = 1.0 if i <= j else -1.0
    if i == j:
        return F.col(f"p{i}"), F.lit(0.0), F.col(f"p{i}")
    return F.col(f"r{a}_{b}"), sign * F.col(f"i{a}_{b}"), F.sqrt(F.col(f"p{a}") * F.col(f"p{b}"))


def coherence(a: Raster, b: Raster, win: tuple[int, int] = (7, 7)) -> Raster:
    d = _moments([a, b], win)
    re, im, den = _pair(0, 1)
    return a.with_df(d.select("y", "x", _unit(safe(F.sqrt(re * re + im * im), den)).alias("re")), lshape=(), form="long", complex=False)


def coherencemat(layers: list[Raster], win: tuple[int, int] = (7, 7)) -> Raster:
    d, n = _moments(layers, win), len(layers)
    out = []
    for i in range(n):
        for j in range(n):
            re, im, den = _pair(i, j)
            out.append(_unit(safe(F.sqrt(re * re + im * im), den)))
    return layers[0].with_df(d.select("y", "x", F.array(*out).alias("re")), lshape=(n, n), form="pix", complex=False)


def interfmat(layers: list[Raster], win: tuple[int, int] = (7, 7)) -> Raster:
    """N x N normalised complex interferograms."""
    d, n = _moments(layers, win), len(layers)
    re, im = [], []
    for i in range(n):
        for j in range(n):
            a, b, den = _pair(i, j)
            re.append(safe(a, den))
            im.append(safe(b, den))
    return layers[0].with_df(d.select("y", "x", F.array(*re).alias("re"), F.array(*im).alias("im")), lshape=(n, n), form="pix", complex=True)


def coherencecov(cov: Raster, win: tuple[int, int] = (3, 3), ch: tuple[int, int] = (0, 1)) -> Raster:
    r = cov.pix()
    n = r.lshape[0]
    i, j = ch
    d = r.df.select("y", "x", at(i * n + j)[0].alias("a"), at(i * n + j)[1].alias("b"), at(i * n + i)[0].alias("p"), at(j * n + j)[0].alias("q"))
    d = box_mean(d, [], ["a", "b", "p", "q"], r.ny, r.nx, win)
    v = _unit(safe(F.sqrt(F.col("a") ** 2 + F.col("b") ** 2), F.sqrt(F.col("p") * F.col("q"))))
    return r.with_df(d.select("y", "x", v.alias("re")), lshape=(), form="long", complex=False)


# --- phase filters -------------------------------------------------------------------------------------


def phasor(r: Raster) -> Raster:
    """Real values as unit phasors; complex ones as they are."""
    r = r.long()
    return r if r.complex else r.with_df(r.df.select("y", "x", F.cos("re").alias("re"), F.sin("re").alias("im")), complex=True)


def _angle(r: Raster) -> Raster:
    return r.with_df(r.df.select("y", "x", F.atan2("im", "re").alias("re")), complex=False)


def _box(a: np.ndarray, win) -> np.ndarray:
    """Box mean of a block, borders mirrored."""
    for axis, s in enumerate(win):
        if s > 1:
            pad = [(0, 0), (0, 0)]
            pad[axis] = (s // 2, s - s // 2 - 1)
            p = np.cumsum(np.pad(a, pad, "symmetric"), axis=axis)
            p = np.concatenate([np.zeros_like(np.take(p, [0], axis)), p], axis)
            n = a.shape[axis]
            a = (np.take(p, range(s, s + n), axis) - np.take(p, range(n), axis)) / s
    return a


def _gauss(a: np.ndarray, sigma: float, truncate: float = 3.0) -> np.ndarray:
    """Gaussian of a block, borders extended."""
    r = int(truncate * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    w /= w.sum()
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (r, r)
        p, n = np.pad(a, pad, "edge"), a.shape[axis]
        a = sum(k * np.take(p, range(i, i + n), axis) for i, k in enumerate(w))
    return a


def _power(block: np.ndarray, alpha: float, win=None) -> np.ndarray:
    s = np.fft.fft2(block)
    return np.fft.ifft2(s * np.abs(s if win is None else _box(s, win)) ** alpha)


def goldstein(phase: Raster, exp: float = 0.5, bs: int = 32, smo: bool = False, win=(3, 1)) -> Raster:
    """Spectra of half-overlapping patches times their (smoothed) modulus to a power."""
    return _angle(overlap_add([phasor(phase)], (bs, bs), (bs // 2, bs // 2), lambda b: _power(b[0], exp, win if smo else None)))


def _pseudo(b: np.ndarray) -> float:
    total = np.abs(b).sum()
    return float(np.abs(b.sum()) / total) if total else 0.0


def goldstein_iter(phase: Raster, exp: float | None = None, bsx: int = 32, bsy: int = 32, prc: float = 0.5, tol: float = 0.1, smo: bool = False, force_coh: bool = False, force_coh2: bool = False, iterate: bool = True, win=(3, 1)) -> Raster:
    """Goldstein with an exponent from the patch's pseudo-coherence, repeated while that grows by the tolerance."""

    smooth = win if smo else None

    def fixed(patch):
        """An exponent that isn't renewed, or None."""
        if exp is not None:
            return exp
        if force_coh or force_coh2:
            c = float(np.clip(np.abs(_box(np.exp(-1j * patch), (3, 3))), 0, 1).mean())
            return 1 - (c if force_coh else c * c)
        return None if iterate else 1 - _pseudo(patch)

    def kernel(blocks):
        best = blocks[0]
        alpha = fixed(best)
        if alpha is not None:
            return _power(best, alpha, smooth)
        coherence, gain = _pseudo(best), tol
        while gain >= tol:
            new = _power(best, 1 - coherence, smooth)
            gain = _pseudo(new) - coherence
            if gain >= 0:
                best, coherence = new, coherence + gain
        return best

    step = (bsx // int(1 // prc), bsy // int(1 // prc))
    return _angle(overlap_add([phasor(phase)], (bsx, bsy), step, kernel))


def _fringe(spectrum: np.ndarray) -> tuple[float, float, float]:
    m = np.abs(spectrum)
    i, j = np.unravel_index(int(m.argmax()), m.shape)
    return np.fft.fftfreq(m.shape[0])[i], np.fft.fftfreq(m.shape[1])[j], float(m.max())


def _ramp(shape, fy: float, fx: float) -> np.ndarray:
    return np.exp(2j * np.pi * (np.arange(shape[0])[:, None] * fy + np.arange(shape[1])[None] * fx))


def goldstein_lfe(r: Raster, exp: float | None = None, bs: int = 32, prc: float = 0.5, win=(3, 3), force_coh2: bool = False) -> Raster:
    """Goldstein on what is left when a patch's main fringe is taken out; the fringe is put back."""

    def kernel(blocks):
        b = blocks[0]
        fy, fx, peak = _fringe(_box(np.fft.fft2(np.exp(1j * np.angle(b))), win))
        ramp = _ramp(b.shape, fy, fx)
        s = np.fft.fft2(b * np.conj(ramp))
        c = peak / b.size
        ry, rx, _ = _fringe(s)
        alpha = exp if exp is not None else 1 - (c * c if force_coh2 else c)
        s = s * np.abs(s) ** (alpha + np.hypot(ry, rx))
        return np.fft.ifft2(s) * ramp

    step = (bs // int(1 // prc),) * 2
    out = overlap_add([phasor(r)], (bs, bs), step, kernel)
    return out if r.complex else _angle(out)


def _defringed(r: Raster, bs: int, prc: float, least: float, smooth) -> Raster:
    def kernel(blocks):
        b = blocks[0]
        fy, fx, peak = _fringe(np.fft.fft2(np.exp(1j * np.angle(b))))
        c = peak / b.size
        if c < least:
            fy = fx = 0.0
        ramp = _ramp(b.shape, fy, fx)
        return smooth(b * np.conj(ramp), c) * ramp

    step = (bs // int(1 // prc),) * 2
    out = overlap_add([phasor(r)], (bs, bs), step, kernel)
    return out if r.complex else _angle(out)


def lffe_boxcar(r: Raster, bs: int = 32, prc: float = 0.5, win=(3, 3), adaptive: bool = False) -> Raster:
    size = lambda c: tuple(max(1, min(int(1 / c), 2 * w)) for w in win) if adaptive else win
    return _defringed(r, bs, prc, 0.25, lambda b, c: _box(b, size(max(c, 1e-9))))


def lffe_gauss(r: Raster, bs: int = 32, prc: float = 0.5, sigma: float = 5.0, least: float = 0.3) -> Raster:
    return _defringed(r, bs, prc, least, lambda b, c: _gauss(b, sigma))


def baran(phase: Raster, bs: int = 32) -> Raster:
    """Goldstein whose exponent is one minus the mean coherence of the patch's middle."""
    z = phasor(phase)
    d = box_mean(z.df, [], ["re", "im"], z.ny, z.nx, (7, 7))
    d = d.select("y", "x", F.sqrt(F.col("re") ** 2 + F.col("im") ** 2).alias("re"))
    coh = Raster(box_mean(d, [], ["re"], z.ny, z.nx, (7, 7)), z.ny, z.nx)

    def kernel(blocks):
        b, c = blocks
        qy, qx = b.shape[0] // 4, b.shape[1] // 4
        return _power(b, 1.0 - float(c.real[qy : 3 * qy, qx : 3 * qx].mean()))

    return _angle(overlap_add([z, coh], (bs, bs), (bs // 2, bs // 2), kernel))


def _wrap(v: Column) -> Column:
    return F.atan2(F.sin(v), F.cos(v))


def _cosine(a: np.ndarray) -> np.ndarray:
    """The even-extension transform of each line."""
    full = np.concatenate([a, a[:, -2:0:-1]], axis=1)
    return np.fft.fft(full, axis=1)[:, : a.shape[1]].real


def _cosine_back(a: np.ndarray) -> np.ndarray:
    full = np.concatenate([a, a[:, -2:0:-1]], axis=1)
    return np.fft.ifft(full, axis=1)[:, : a.shape[1]].real


def unwrap_poisson(phase: Raster) -> Raster:
    """Least-squares unwrapping: the wrapped Laplacian, cosine transforms by lines of both axes, one division."""
    from ..windows import shifted

    r = phase.long()
    at_ = {"e": ("re", 0, 1), "w": ("re", 0, -1), "s": ("re", 1, 0), "n": ("re", -1, 0)}
    d = shifted(r.df, [], r.ny, r.nx, at_, mode="reflect")
    fwd = lambda n, axis, size: F.when(F.col(axis) == size - 1, _wrap(F.col("re") - F.col({"e": "w", "s": "n"}[n]))).otherwise(_wrap(F.col(n) - F.col("re")))
    back = lambda n, axis: F.when(F.col(axis) == 0, _wrap(F.col({"w": "e", "n": "s"}[n]) - F.col("re"))).otherwise(_wrap(F.col("re") - F.col(n)))
    lap = fwd("e", "x", r.nx) - back("w", "x") + fwd("s", "y", r.ny) - back("n", "y")
    t = map_lines(map_lines(r.with_df(d.select("y", "x", lap.alias("re"))), "y", _cosine), "x", _cosine)
    import math

    wave = F.cos(F.col("y") * math.pi / max(1, r.ny - 1)) + F.cos(F.col("x") * math.pi / max(1, r.nx - 1))
    zero = (F.col("y") == 0) & (F.col("x") == 0)
    t = t.with_df(t.df.select("y", "x", F.when(zero, 0.0).otherwise(F.col("re") / (2.0 * (F.when(zero, 0.00001).otherwise(wave) - 2.0))).alias("re")))
    return map_lines(map_lines(t, "y", _cosine_back), "x", _cosine_back)


def qef(phase: Raster, strength: float = 0.5, win: int = 5) -> Raster:
    """Fluctuations unwrapped at three scales are taken out, the rest is blended with its median, and they are put back."""
    from ..plans import cut
    from .filters import median

    r = phase.long()
    up = None
    for a1 in (21, 9, 3):
        base = r.df if up is None else r.df.join(up.df.withColumnRenamed("re", "u"), ["y", "x"]).select("y", "x", (F.col("re") - F.col("u")).alias("re"))
        z = phasor(r.with_df(base))
        z = z.with_df(box_mean(z.df, [], ["re", "im"], r.ny, r.nx, (a1, a1)))
        u = unwrap_poisson(_angle(median(z, (3, 3))))
        if up is not None:
            u = u.with_df(u.df.join(up.df.withColumnRenamed("re", "u"), ["y", "x"]).select("y", "x", (F.col("re") + F.col("u")).alias("re")))
        up = u.with_df(box_mean(u.df, [], ["re"], r.ny, r.nx, (11, 11)))
        if a1 == 3:
            up = up.with_df(box_mean(up.df, [], ["re"], r.ny, r.nx, (11, 11)))
        # Each scale is read several times by the next, the last by what follows.
        up = up.with_df(cut(up.df))
    res = up
    d = r.df.join(res.df.withColumnRenamed("re", "u"), ["y", "x"])
    z = phasor(r.with_df(d.select("y", "x", (F.col("re") - F.col("u")).alias("re"))))
    m = median(z, (win, win)).df.select("y", "x", F.col("re").alias("mr"), F.col("im").alias("mi"))
    both = z.df.join(m, ["y", "x"]).join(res.df.withColumnRenamed("re", "u"), ["y", "x"])
    re, im = F.col("mr") * strength + F.col("re") * (1 - strength), F.col("mi") * strength + F.col("im") * (1 - strength)
    out = _wrap(F.atan2(im, re) + F.col("u"))
    return r.with_df(both.select("y", "x", out.alias("re")))


