"""Non-local means of covariance matrices over several scales and patch sizes.

Two pixels are alike as far as their patches are: the mean over a patch of the likelihood ratio of Wishart matrices,
which needs log determinants only. What a dissimilarity means is learnt from noise: its quantiles over a layer of
pure speckle, for each scale and patch size, turn it into a probability, and that into a weight. Means of every scale, patch
size and search radius are corrected towards the pixel where they vary more than speckle does, and the one of the
highest equivalent number of looks is kept, pixel by pixel.

Kernels see a tile and a halo of search, patch and smoothing reach; borders mirror; results don't depend on tiles. The
quantile tables, scales x sizes x 1024 numbers, are all that passes through the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..functions.quantiles import grouped_quantiles
from ..raster import Raster
from ..tiles import map_tiles
from .despeckle import wishart_noise

#: Entries of a quantile table, from the least to the largest value.
STEPS = 1024
#: Degrees of freedom of the chi-squared law that spreads probabilities, and the decay of weights.
FREEDOM, DECAY = 49, 3.0


def chi2_quantiles(p: np.ndarray, freedom: int) -> np.ndarray:
    """Quantiles of the chi-squared law with odd degrees of freedom, by bisection of its closed distribution function."""

    def below(x):
        half = x / 2
        term, total = np.sqrt(half) / math.gamma(1.5), np.zeros_like(x)
        for k in range(1, freedom // 2 + 1):
            total, term = total + term, term * half / (k + 0.5)
        erf = np.array([math.erf(t) for t in np.sqrt(half)])
        return erf - np.exp(-half) * total

    low, high = np.zeros(len(p)), np.full(len(p), 40.0 * freedom)
    for _ in range(90):
        mid = (low + high) / 2
        up = below(mid) < p
        low, high = np.where(up, mid, low), np.where(up, high, mid)
    return np.where(p > 0, (low + high) / 2, 0.0)


def weight_table() -> np.ndarray:
    """Weight of each step of the quantile table: highest where speckle alone is as expected, 0 for the last."""
    q = chi2_quantiles(np.arange(STEPS - 1) / (STEPS - 1), FREEDOM)
    return np.append(np.exp(-DECAY * np.abs(q - FREEDOM) / FREEDOM), 0.0)


class Matrices:
    """Hermitian matrices of a block as real diagonals and complex upper elements."""

    def __init__(self, diagonal: np.ndarray, upper: np.ndarray):
        self.diagonal, self.upper, self.n = diagonal, upper, len(diagonal)

    @classmethod
    def of(cls, block: np.ndarray, n: int, least: float) -> Matrices:
        """From channels in rows; diagonal elements that are not positive get the least positive one of the image."""
        d = np.stack([block[i * n + i].real for i in range(n)])
        u = [block[i * n + j] for i in range(n) for j in range(i + 1, n)]
        return cls(np.where(d > 0, d, least), np.stack(u) if u else np.zeros((0, *block.shape[1:]), complex))

    def cut(self, y: int, x: int, h: int, w: int) -> Matrices:
        return Matrices(self.diagonal[:, y : y + h, x : x + w], self.upper[:, y : y + h, x : x + w])

    def damped(self, looks: float) -> Matrices:
        """With fewer looks than channels matrices have no inverse: off-diagonals are made smaller."""
        return self if looks >= self.n else Matrices(self.diagonal, self.upper * (looks / self.n) ** (1 / 3))

    def plus(self, o: Matrices) -> Matrices:
        return Matrices(self.diagonal + o.diagonal, self.upper + o.upper)

    def log_det(self) -> np.ndarray:
        d, u, n = self.diagonal, self.upper, self.n
        s = u.real**2 + u.imag**2
        if n == 1:
            det = d[0]
        elif n == 2:
            det = d[0] * d[1] - s[0]
        elif n == 3:
            det = d[0] * d[1] * d[2] + 2 * (u[0] * u[2] * u[1].conj()).real - d[0] * s[2] - d[1] * s[1] - d[2] * s[0]
        else:
            m = np.zeros((*d.shape[1:], n, n), complex)
            k = 0
            for i in range(n):
                m[..., i, i] = d[i]
                for j in range(i + 1, n):
                    m[..., i, j], m[..., j, i] = u[k], u[k].conj()
                    k += 1
            det = np.linalg.det(m).real
        return np.log(np.maximum(det, 1e-300))

    def values(self) -> np.ndarray:
        """Real planes: diagonals, real and imaginary parts of the upper elements."""
        return np.concatenate([self.diagonal, self.upper.real, self.upper.imag])


def matrices_from(values: np.ndarray, n: int) -> np.ndarray:
    """Channels in rows from real planes."""
    up = n * (n - 1) // 2
    out = np.zeros((n * n, *values.shape[1:]), complex)
    k = n
    for i in range(n):
        out[i * n + i] = values[i]
        for j in range(i + 1, n):
            out[i * n + j] = values[k] + 1j * values[k + up]
            out[j * n + i] = out[i * n + j].conj()
            k += 1
    return out


def smoothing_reach(scale: int) -> int:
    return int(math.ceil(3 * (scale + 0.5))) if scale else 0


def smoothed(block: np.ndarray, scale: int) -> np.ndarray:
    """Gaussian mean exp(-pi r^2 / (scale + 1/2)^2) of every channel; the rim of its reach isn't valid."""
    if not scale:
        return block
    h = smoothing_reach(scale)
    w = np.exp(-math.pi * np.arange(-h, h + 1) ** 2 / (scale + 0.5) ** 2)
    w /= w.sum()
    out = np.zeros_like(block)
    down = np.zeros_like(block)
    for k in range(-h, h + 1):
        down += w[k + h] * np.roll(block, -k, 1)
    for k in range(-h, h + 1):
        out += w[k + h] * np.roll(down, -k, 2)
    return out


def patch_means(d: np.ndarray, reach: int, radius: int) -> np.ndarray:
    """Means over (2 radius + 1)^2 windows by an integral image; d reaches ``reach`` beyond what is returned."""
    s = np.pad(d.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    n = 2 * radius + 1
    a, b = d.shape[0] - 2 * reach, d.shape[1] - 2 * reach
    y = x = reach - radius
    return (s[y + n : y + n + a, x + n : x + n + b] - s[y : y + a, x + n : x + n + b] - s[y + n : y + n + a, x : x + b] + s[y : y + a, x : x + b]) / (n * n)


class Dissimilarity:
    """Likelihood ratios of a block against itself moved, log determinants of the block taken once."""

    def __init__(self, m: Matrices, looks: float):
        self.m, self.looks = m.damped(looks), looks
        self.log = self.m.log_det()

    def at(self, y: int, x: int, h: int, w: int, dy: int, dx: int) -> np.ndarray:
        both = self.m.cut(y, x, h, w).plus(self.m.cut(y + dy, x + dx, h, w)).log_det()
        alone = self.log[y : y + h, x : x + w] + self.log[y + dy : y + dy + h, x + dx : x + dx + w]
        return self.looks * (2 * both - alone) - 2 * self.looks * self.m.n * math.log(2)


def noise_statistics(noise: Raster, looks: float, radii: list[int], scales: int, least: float) -> np.ndarray:
    """(scales x sizes, 1024): quantiles of the dissimilarity of neighbouring patches that don't overlap, over a noise layer."""
    n, top = noise.lshape[0], max(radii)
    reach = top + 2 * top + 1
    halo = reach + smoothing_reach(scales - 1)

    def kernel(block):
        h, w = block.shape[1] - 2 * halo, block.shape[2] - 2 * halo
        out = np.zeros((scales * len(radii), *block.shape[1:]))
        for s in range(scales):
            d = Dissimilarity(Matrices.of(smoothed(block, s), n, least), looks)
            for k, p in enumerate(radii):
                moved = d.at(halo - p, halo - p, h + 2 * p, w + 2 * p, 2 * p + 1, 2 * p + 1)
                out[s * len(radii) + k, halo : halo + h, halo : halo + w] = patch_means(moved, p, p)
        return out

    found = map_tiles(noise, (halo, halo), kernel, out_channels=scales * len(radii), together=True)
    df = found.df if found.keys else found.df.withColumn("ch", F.lit(0))
    # The table takes the value at the rank floor((n - 1) share): shares of whole ranks need no interpolation.
    size = noise.ny * noise.nx - 1
    shares = [int(size * k / (STEPS - 1)) / size for k in range(STEPS)]
    rows = grouped_quantiles(df, ["ch"], F.col("re"), shares).select("ch", "i", "q").collect()  # scales x sizes x 1024 numbers
    out = np.zeros((scales * len(radii), STEPS))
    for ch, i, q in rows:
        out[ch, i] = q
    return out


def noise_level(noise: Raster) -> tuple[float, float]:
    """(variance over squared mean, correlation of vertical neighbours) of the first channel's power in a noise layer."""
    p = noise.long().df.where("ch = 0").select("y", "x", F.col("re").alias("v"))
    mean, square = p.agg(F.avg("v"), F.avg(F.col("v") * F.col("v"))).first()
    below = p.select((F.col("y") - 1).alias("y"), "x", F.col("v").alias("o"))
    product = (p.join(below, ["y", "x"]).agg(F.sum(F.col("v") * F.col("o"))).first()[0] or 0.0) / (noise.ny * noise.nx)
    variance = square - mean * mean
    return variance / mean**2, abs(product - mean * mean) / variance


def _filtered(block: np.ndarray, halo: int, n: int, looks: float, search: int, radii: list[int], scales: int, tables: np.ndarray, weights: np.ndarray, eta2: float, least: float) -> np.ndarray:
    h, w = block.shape[1] - 2 * halo, block.shape[2] - 2 * halo
    reach, sizes = max(radii), len(radii)
    values = Matrices.of(block, n, least).values()
    centre = values[:, halo : halo + h, halo : halo + w]
    parts = [Dissimilarity(Matrices.of(smoothed(block, s), n, least), looks) for s in range(scales)]
    total = np.repeat(centre[None], scales * sizes, 0)
    squares = np.repeat(centre[None, :n] ** 2, scales * sizes, 0)
    weight, weight2 = np.ones((scales * sizes, h, w)), np.ones((scales * sizes, h, w))
    best, result = np.ones((h, w)), centre.copy()
    for ring in range(1, search + 1):
        for dy in range(-ring, ring + 1):
            for dx in (range(-ring, ring + 1) if abs(dy) == ring else (-ring, ring)):
                there = values[:, halo + dy : halo + dy + h, halo + dx : halo + dx + w]
                for s in range(scales):
                    d = parts[s].at(halo - reach, halo - reach, h + 2 * reach, w + 2 * reach, dy, dx)
                    for k, p in enumerate(radii):
                        j = s * sizes + k
                        step = np.searchsorted(tables[j], patch_means(d, reach, p))
                        wt = weights[np.minimum(step, STEPS - 1)]
                        total[j] += wt * there
                        squares[j] += wt * there[:n] ** 2
                        weight[j] += wt
                        weight2[j] += wt * wt
        mean = total[:, :n] / weight[:, None]
        speckle = mean * mean * eta2
        excess = np.abs(squares / weight[:, None] - mean * mean - speckle)
        back = (excess / (excess + speckle)).max(1)
        seen = 1 / ((1 - back) ** 2 * (weight2 - 1) / weight**2 + ((1 - back) / weight + back) ** 2)
        j = seen.argmax(0)  # of equals the smaller scale and patch
        pick = lambda a: np.take_along_axis(a, j[None], 0)[0]
        better = pick(seen) > best
        a = pick(back)
        mine = np.take_along_axis(total, j[None, None], 0)[0] / pick(weight)
        result = np.where(better, (1 - a) * mine + a * centre, result)
        best = np.where(better, pick(seen), best)
    return np.concatenate([matrices_from(result, n), best[None].astype(complex)])


def nlsar(cov: Raster, looks: float = 1.0, search: int = 12, patch: int = 5, scales: int = 3, noise: Raster | None = None, tile: tuple[int, int] = (128, 128)) -> tuple[Raster, Raster]:
    """Filtered covariance matrices and the map of equivalent looks. Jobs over the noise layer run at once.

    ``noise`` is a layer of pure speckle with as many channels; without it 256 x 256 matrices of the given whole number of looks are
    made from hashes. Patches have radii 1 to ``patch``. Where neighbouring noise pixels are correlated (over 0.25) they
    reach twice as far, every second radius.
    """
    n = cov.lshape[0] if cov.lshape else 1
    if cov.lshape not in ((), (1,), (n, n)):
        raise ValueError("covariance matrices or intensities are needed")
    if noise is None:
        if looks != int(looks):
            raise ValueError("a noise layer is needed for looks that are no whole number")
        noise = wishart_noise(cov.df.sparkSession, 256, 256, n, int(looks))
    src = [_with_channels(r) for r in (cov, noise)]
    least = [_least_power(r, n) for r in src]
    eta2, correlation = noise_level(src[1])
    step, patch = (2, 2 * patch) if correlation > 0.25 else (1, patch)
    radii = [1 + k * step for k in range(patch // step)]
    tables = noise_statistics(src[1], looks, radii, scales, least[1])
    weights = weight_table()
    halo = search + max(radii) + smoothing_reach(scales - 1)

    def kernel(block):
        out = np.zeros((n * n + 1, *block.shape[1:]), complex)
        out[:, halo:-halo, halo:-halo] = _filtered(block, halo, n, looks, search, radii, scales, tables, weights, eta2, least[0])
        return out

    found = map_tiles(src[0], (halo, halo), kernel, tile=tile, together=True)
    matrices = src[0].with_df(found.df.where(F.col("ch") < n * n))
    seen = found.df.where(F.col("ch") == n * n).select("y", "x", "re")
    return matrices, matrices.with_df(seen, lshape=(), complex=False)


def _with_channels(r: Raster) -> Raster:
    """LONG, complex, with channels even where there is one."""
    r = r.long()
    df = r.df if r.keys else r.df.withColumn("ch", F.lit(0))
    df = df if r.complex else df.withColumn("im", F.lit(0.0))
    return r.with_df(df.select("ch", "y", "x", "re", "im"), complex=True, lshape=r.lshape or (1,))


def _least_power(r: Raster, n: int) -> float:
    diagonal = r.df.where(F.col("ch").isin([i * n + i for i in range(n)]) & (F.col("re") > 0))
    return diagonal.agg(F.min("re")).first()[0] or 1e-12
