"""Short-time Beltrami filter of covariance matrices, and the pair statistic that sets its scale.

An image of matrices is a surface in the product of the image plane and the space of matrices. Weights of a window fall
with the length of paths from its centre over that surface: a step to one of eight neighbours costs the distance of the
two matrices in units of phi * beta. Beta is the median distance of unrelated pixels of pure speckle. Speckle is filtered
along with the image, so beta falls from round to round, until it changes by less than epsilon.

Edges of the graph are measured once a tile for all windows, in batches of matrices; path lengths are relaxed for all
pixels of the tile at once. What the rounds need to know of each other follows from the speckle alone, so the image takes
several rounds in one tile exchange. Places outside the image are in no path.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import grouped_quantiles
from ..plans import cut
from ..raster import Raster
from ..tiles import map_tiles
from .despeckle import wishart_noise


def _powers(m: np.ndarray) -> np.ndarray:
    return np.diagonal(m, axis1=-2, axis2=-1).real


def _trace(m: np.ndarray) -> np.ndarray:
    return _powers(m).sum(-1)


def _logs(m: np.ndarray) -> np.ndarray:
    value, vector = np.linalg.eigh(m)
    return (vector * np.log(value)[..., None, :]) @ vector.conj().swapaxes(-1, -2)


def _size(m: np.ndarray) -> np.ndarray:
    return np.sqrt((np.abs(m) ** 2).sum((-1, -2)))


def _inverse_roots(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(roots, full): matrices that make the identity of a, and whether a has full rank."""
    value, vector = np.linalg.eigh(a)
    full = (value > 0).all(-1)
    return vector / np.sqrt(np.where(full[..., None], value, 1.0))[..., None, :], full


def _affine_invariant(a: np.ndarray, b: np.ndarray, roots: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    root, full = _inverse_roots(a) if roots is None else roots
    out = np.full(len(a), np.inf)
    if full.any():
        root = root[full]
        relative = np.linalg.eigvalsh(root.conj().swapaxes(-1, -2) @ b[full] @ root)
        out[full] = np.sqrt((np.log(relative) ** 2).sum(-1))
    return out


def _mean_ratio(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p / q + q / p) / 2


#: Distances of batches of matrices (k, n, n).
DISTANCES: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "ai": _affine_invariant,
    "eu": lambda a, b: np.sqrt(((_powers(a) - _powers(b)) ** 2).sum(-1)),
    "fr": lambda a, b: _size(a - b) / _trace(a),
    "fbs": lambda a, b: np.log(_powers(a)).sum(-1) - np.log(_powers(b)).sum(-1),
    "rdw": lambda a, b: 2 * _mean_ratio(_powers(a), _powers(b)).sum(-1) - 2 * a.shape[-1],
    "le": lambda a, b: _size(_logs(a) - _logs(b)),
    "dg": lambda a, b: np.sqrt(((np.log(_powers(a)) - np.log(_powers(b))) ** 2).sum(-1)),
    "rws": lambda a, b: (_trace(a @ np.linalg.inv(b)) + _trace(b @ np.linalg.inv(a))) / 2,
    "drws": lambda a, b: _mean_ratio(_powers(a), _powers(b)).sum(-1),
    "sg": lambda a, b: np.log(_trace(a)) - np.log(_trace(b)),
    "srws": lambda a, b: _mean_ratio(_trace(a), _trace(b)),
}


def distance(measure: str, a: np.ndarray, b: np.ndarray, known: tuple = ()) -> np.ndarray:
    """Not negative; infinite where it isn't defined. ``known`` is what the measure takes of a that was computed before."""
    with np.errstate(all="ignore"):
        try:
            d = np.abs(DISTANCES[measure](a, b, *known))
        except np.linalg.LinAlgError:  # one singular matrix stops a batch: one by one
            d = np.array([np.inf if len(a) == 1 else distance(measure, a[k : k + 1], b[k : k + 1])[0] for k in range(len(a))])
    return np.where(np.isfinite(d), d, np.inf)


def damped(m: np.ndarray, share: float) -> np.ndarray:
    """Off-diagonal elements times share: matrices of few looks get full rank."""
    n = m.shape[-1]
    return m * np.where(np.eye(n) > 0, 1.0, share)


# --- unrelated pairs -------------------------------------------------------------------------------------


def pair_distances(cov: Raster, measure: str = "ai", multiplier: int = 1, shift: int | None = None, share: float = 1.0) -> DataFrame:
    """(i, d): distance of pixel i (counted row by row) and pixel (multiplier * i + shift) mod all, an equi-join on one number.

    A multiplier without a common factor with the number of pixels makes a permutation, so every pixel is the
    partner of one other; which one depends neither on partitions nor on chance. The default shift is half of all.
    """
    total = cov.ny * cov.nx
    if math.gcd(multiplier, total) != 1:
        raise ValueError("the multiplier shares a factor with the number of pixels")
    shift = total // 2 if shift is None else shift
    n = cov.lshape[0] if cov.lshape else 1
    r = cov.pix()
    i = F.col("y") * cov.nx + F.col("x")
    one = r.df.select(i.alias("i"), "re", (F.col("im") if r.complex else F.transform("re", lambda v: v * 0)).alias("im"))
    partner = F.pmod(F.lit(multiplier) * F.col("i") + shift, F.lit(total))
    other = one.select(F.col("i").alias("j"), F.col("re").alias("re2"), F.col("im").alias("im2"))
    both = one.withColumn("j", partner.cast("long")).join(other, "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            re1, im1, re2, im2 = (b.column(k).flatten().to_numpy().reshape(-1, n, n) for k in ("re", "im", "re2", "im2"))
            d = distance(measure, damped(re1 + 1j * im1, share), damped(re2 + 1j * im2, share))
            yield pa.RecordBatch.from_arrays([b.column("i"), pa.array(d)], ["i", "d"])

    return both.select("i", "re", "im", "re2", "im2").mapInArrow(run, "i long, d double")


def scattered_multiplier(total: int, seed: int = 1) -> int:
    """A multiplier near the golden section of total that shares no factor with it; seeds give others."""
    m = max(1, int(total * (math.sqrt(5) - 1) / 2) + seed - 1)
    while math.gcd(m, total) != 1:
        m += 1
    return m


def beta_statistic(cov: Raster, measure: str = "ai", multiplier: int = 1, shift: int | None = None, share: float = 1.0) -> DataFrame:
    """(beta, pairs): exact median of the finite distances of unrelated pairs, and how many there are."""
    d = pair_distances(cov, measure, multiplier, shift, share).where(F.col("d") < float("inf"))
    half = grouped_quantiles(d, [], F.col("d"), [0.5]).select(F.col("q").alias("beta"))
    return half.join(F.broadcast(d.agg(F.count(F.lit(1)).alias("pairs"))))


def equivalent_looks(cov: Raster) -> DataFrame:
    """(enl): squared mean over variance of each channel's power, averaged over channels."""
    n = cov.lshape[0] if cov.lshape else 1
    r = cov.long()
    ch = F.col("ch") if r.keys else F.lit(0)
    power = r.df.select(ch.alias("ch"), F.abs("re").alias("v")).where(F.col("ch").isin([k * n + k for k in range(n)]))
    each = power.groupBy("ch").agg((F.pow(F.avg("v"), F.lit(2.0)) / F.var_pop("v")).alias("looks"))
    return each.agg(F.avg("looks").alias("enl"))


# --- the filter ------------------------------------------------------------------------------------------

#: The eight neighbours; a step is measured from the pixel that comes first in one of the first four.
FORWARD = ((-1, 1), (0, 1), (1, 1), (1, 0))

#: Rounds of the image in one exchange: with a window of 7 a halo of 12 pixels.
ROUNDS = 4


def window_order(win: int) -> list[tuple[int, int]]:
    """Places that paths go on from: the window without its rim, ring by ring, row by row."""
    h = win // 2 - 1
    return sorted(((a, b) for a in range(-h, h + 1) for b in range(-h, h + 1)), key=lambda p: (max(map(abs, p)), p))


def path_weights(m: np.ndarray, inside: np.ndarray, measure: str, win: int, beta: float, phi: float, sigma: float, step: float) -> Iterator[tuple[int, int, np.ndarray]]:
    """(dy, dx, weights) of the window's places for every pixel of the core; m is (rows, columns, n, n) with a rim of win // 2."""
    half = win // 2
    h, w = m.shape[0] - 2 * half, m.shape[1] - 2 * half
    edges, roots = {}, None
    if measure == "ai":  # each matrix is the first of up to four pairs
        try:
            root, full = np.zeros_like(m), np.zeros(m.shape[:2], bool)
            root[inside], full[inside] = _inverse_roots(m[inside])
            roots = root, full
        except np.linalg.LinAlgError:
            pass
    for dy, dx in FORWARD:
        e = np.full(m.shape[:2], np.inf)
        y0, x1 = max(0, -dy), m.shape[1] - dx
        rows, cols = slice(y0, m.shape[0] - max(0, dy)), slice(0, x1)
        there = slice(y0 + dy, m.shape[0] - max(0, dy) + dy), slice(dx, x1 + dx)
        a, b = m[rows, cols], m[there]
        ok = inside[rows, cols] & inside[there]
        d = np.full(ok.shape, np.inf)
        if ok.any():
            d[ok] = distance(measure, a[ok], b[ok], () if roots is None else (tuple(k[rows, cols][ok] for k in roots),))
        e[rows, cols] = step + d / (phi * beta)
        edges[dy, dx] = e
    far = {(a, b): np.full((h, w), np.inf) for a in range(-half, half + 1) for b in range(-half, half + 1)}
    far[0, 0][:] = 0.0
    for a, b in window_order(win):
        for dy, dx in FORWARD:
            for sign in (1, -1):
                to = (a + sign * dy, b + sign * dx)
                y, x = (a, b) if sign == 1 else to
                cost = edges[dy, dx][half + y : half + y + h, half + x : half + x + w]
                np.minimum(far[to], far[a, b] + cost, out=far[to])
    for (a, b), d in far.items():
        yield a, b, np.exp(-(d**2) / sigma**2)


def beltrami_rounds(cov: Raster, steps: list[tuple[float, float, float]], measure: str = "ai", win: int = 7, phi: float = 2.1, step: float = 0.0, tile: tuple[int, int] = (256, 256)) -> Raster:
    """A round for each (beta, sigma, share), all in one exchange: matrices averaged with the path weights of their window.

    Share damps off-diagonals in distances alone. A tile's halo has what all rounds reach, and shrinks from round to round.
    """
    n, ny, nx, half = (cov.lshape[0] if cov.lshape else 1), cov.ny, cov.nx, win // 2
    halo = half * len(steps)

    def once(block, yy, xx, beta, sigma, share):
        """One round and where its pixels lie: without the rim that lacks neighbours; at an image border there are none to lack."""
        rims = [(half if t[0] == 0 else 0, half if t[-1] == size - 1 else 0) for t, size in ((yy, ny), (xx, nx))]
        block = np.pad(block, ((0, 0), *rims))
        inside = np.pad(np.ones((len(yy), len(xx)), bool), rims)
        h, w = block.shape[1] - 2 * half, block.shape[2] - 2 * half
        m = damped(block.transpose(1, 2, 0).reshape(*block.shape[1:], n, n), share)
        total, weight = np.zeros((len(block), h, w), block.dtype), np.zeros((h, w))
        for a, b, wt in path_weights(m, inside, measure, win, beta, phi, sigma, step):
            total += wt * block[:, half + a : half + a + h, half + b : half + b + w]
            weight += wt
        return total / weight, *(t[half - before : len(t) - half + after] for t, (before, after) in zip((yy, xx), rims, strict=True))

    def kernel(block, yy, xx):
        rows, cols = (yy >= 0) & (yy < ny), (xx >= 0) & (xx < nx)
        now, y, x = block[:, rows][:, :, cols], yy[rows], xx[cols]
        for beta, sigma, share in steps:
            now, y, x = once(now, y, x, beta, sigma, share)
        out = np.zeros_like(block)
        out[:, y[0] - yy[0] : y[-1] + 1 - yy[0], x[0] - xx[0] : x[-1] + 1 - xx[0]] = now
        return out

    return map_tiles(cov, (halo, halo), kernel, tile=tile, together=True, border="zero", located=True)


def beltrami_round(cov: Raster, beta: float, measure: str = "ai", win: int = 7, sigma: float = 1.0, phi: float = 2.1, step: float = 0.0, share: float = 1.0, tile: tuple[int, int] = (64, 64)) -> Raster:
    """One round."""
    return beltrami_rounds(cov, [(beta, sigma, share)], measure, win, phi, step, tile)


def matrices(r: Raster) -> Raster:
    """Covariance matrices as they are; of a vector of channels its outer products; of an image its power."""
    if len(r.lshape) == 2:
        return r
    p = r.pix()
    n = p.channels
    im = (lambda k: F.get("im", F.lit(k))) if p.complex else (lambda k: F.lit(0.0))
    re = lambda k: F.get("re", F.lit(k))
    pairs = [(i, j) for i in range(n) for j in range(n)]
    real = F.array(*[re(j) * re(i) + im(j) * im(i) for i, j in pairs])
    imag = F.array(*[im(j) * re(i) - re(j) * im(i) for i, j in pairs])
    return p.with_df(p.df.select("y", "x", real.alias("re"), imag.alias("im")), lshape=(n, n), complex=True)


def mcb(r: Raster, looks: int = 3, max_rounds: int = 25, measure: str = "ai", win: int = 7, sigma: float = 1.0, sigma_step: float = 0.5, epsilon: float = 0.01, phi: float = 2.1, step: float = 0.0, side: int = 35, seed: int = 1) -> tuple[Raster, list[float]]:
    """The filtered matrices and beta of every round. Rounds of the speckle are run at once, each from a checkpoint; those of
    the image, which nothing depends on, follow by ``ROUNDS`` in an exchange, with a checkpoint between exchanges.

    Speckle: ``side`` x ``side`` matrices of ``looks`` looks (1 for a vector), made from hashes, and filtered like the image.
    From the sixth round on the kernel widens by ``sigma_step``. For a vector, whose matrices have rank one, off-diagonal
    elements count in distances by a share that is 0 at first and then grows with the looks the speckle has reached.
    ``step`` adds to the cost of each step, which makes paths long in the plane too.
    """
    vector = len(r.lshape) < 2
    now = matrices(r)
    n = now.lshape[0]
    noise = wishart_noise(r.df.sparkSession, side, side, n, 1 if vector else int(looks), seed).pix()
    multiplier = scattered_multiplier(side * side, seed)
    old, beta, steps, share = 0.0, math.inf, [], 0.0 if vector else 1.0
    while abs(beta - old) >= epsilon and len(steps) < max_rounds:
        if len(steps) >= 5:
            sigma += sigma_step
        old, beta = beta, beta_statistic(noise, measure, multiplier, share=share).first()["beta"]
        steps.append((beta, sigma, share))
        noise = beltrami_round(noise, beta, measure, win, sigma, phi, step, share)
        noise = noise.with_df(cut(noise.df))
        if vector:
            share = min((equivalent_looks(noise).first()["enl"] / n) ** (1 / 3) / 10, 1.0)
    for k in range(0, len(steps), ROUNDS):
        now = beltrami_rounds(now, steps[k : k + ROUNDS], measure, win, phi, step)
        now = now.with_df(cut(now.df)) if k + ROUNDS < len(steps) else now
    return now, [s[0] for s in steps]
