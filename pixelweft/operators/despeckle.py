"""Speckle filters whose windows depend on the data: numpy kernels over haloed tiles.

Every kernel is a function of a window of fixed reach, so results don't depend on the tiling. Borders
mirror, where a filter's own convention leaves a border untouched it stays as it is.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions.quantiles import quantiles
from ..raster import Raster
from ..tiles import map_tiles

View = np.lib.stride_tricks.sliding_window_view


def power(r: Raster, kind: str) -> Raster:
    """Intensity of amplitudes or complex values; intensities as they are."""
    r = r.long()
    if r.complex:
        return r.with_df(r.df.select(*r.keys, "y", "x", (F.col("re") ** 2 + F.col("im") ** 2).alias("re")), complex=False)
    return r.with_df(r.df.withColumn("re", F.col("re") * F.col("re"))) if kind == "amplitude" else r


def _back(r: Raster, kind: str) -> Raster:
    return r.with_df(r.df.withColumn("re", F.sqrt(F.greatest(F.lit(0.0), F.col("re"))))) if kind == "amplitude" else r


def _windowed(r: Raster, win: tuple[int, int], f, border: float | None = None, keep: bool = False) -> Raster:
    """f(windows (rows, columns, wy, wx)) per pixel of an odd window.

    On a border of half a window pixels stay as they are (``keep``) or get the value ``border``.
    """
    a, b = win[0] // 2, win[1] // 2
    win = (2 * a + 1, 2 * b + 1)
    ny, nx = r.ny, r.nx

    def kernel(block, yy, xx):
        out = block.copy()
        v = View(block[0], win)
        for i in range(0, v.shape[0], 16):  # a few rows of windows at a time
            out[0, a + i : a + min(i + 16, v.shape[0]), b : b + v.shape[1]] = f(v[i : i + 16])
        if keep or border is not None:
            inside = ((yy >= a) & (yy < ny - a))[:, None] & ((xx >= b) & (xx < nx - b))[None]
            out[0] = np.where(inside, out[0], block[0] if keep else border)
        return out

    return map_tiles(r, (a, b), kernel, located=True)


def leesigma(r: Raster, win: tuple[int, int] = (7, 7), looks: float = 2.0, kind: str = "amplitude") -> Raster:
    """Mean of the window's pixels within two sigmas of the centre; with too few of them, of the four neighbours."""
    p = power(r, kind)
    d, a, b = 2.0 / math.sqrt(looks), win[0] // 2, win[1] // 2

    def f(v):
        c = v[:, :, a, b][..., None, None]
        ok = (v > c * (1 - d)) & (v < c * (1 + d))
        n = ok.sum((-1, -2))
        four = (v[:, :, a - 1, b] + v[:, :, a + 1, b] + v[:, :, a, b - 1] + v[:, :, a, b + 1]) / 4
        return np.where(n >= a + b, (v * ok).sum((-1, -2)) / np.maximum(n, 1), four)

    return _back(_windowed(p, win, f, keep=True), kind)


def bilateral(r: Raster, win: int = 11, looks: float = 2.0, kind: str = "amplitude") -> Raster:
    """Gaussian weights in space and value; a border of half a window is 0."""
    p, h = power(r, kind), win // 2
    y, x = np.mgrid[-h : h + 1, -h : h + 1]
    space = np.exp(-(y * y + x * x) / (win * win / 4.6051) / 2)

    def f(v):
        c = v[:, :, h, h][..., None, None]
        w = space * np.exp(-((c - v) ** 2) * looks / 2)
        return (w * v).sum((-1, -2)) / w.sum((-1, -2))

    return _back(_windowed(p, (win, win), f, border=0.0), kind)


def emdes(r: Raster, win: tuple[int, int] = (7, 7), looks: float = 2.0, kind: str = "amplitude") -> Raster:
    """Mean of the window weighted by the gamma density of the centre given each pixel."""
    p, a, b = power(r, kind), win[0] // 2, win[1] // 2

    def f(v):
        c = v[:, :, a, b][..., None, None]
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            w = looks**looks * c ** (looks - 1) / (math.gamma(looks) * v**looks) * np.exp(-looks * c / v)
        w = np.where(np.isfinite(w) & (c != 0), w, 0.0)
        s = w.sum((-1, -2))
        return np.where(s > 0, (w * v).sum((-1, -2)) / np.where(s > 0, s, 1), v[:, :, a, b])

    return _back(_windowed(p, win, f, keep=True), kind)


#: The neighbours (dy, dx) that refined Lee compares, in the order in which the first of equals is taken.
AROUND = ((0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1))


def _masks(n: int) -> np.ndarray:
    """For each neighbour the half of the window that faces away from it, centre line included; and a diamond."""
    h = n // 2
    y, x = np.mgrid[-h : h + 1, -h : h + 1]
    out = [dy * y + dx * x <= 0 for dy, dx in AROUND] + [np.abs(y) + np.abs(x) <= h]
    return np.array([m / m.sum() for m in out])


def refinedlee(r: Raster, win: int = 7, looks: float = 1.0, threshold: float = 0.5, method: str = "original") -> Raster:
    """Lee's filter in an edge-aligned part of the window: away from the neighbour that differs most, or of least variation.

    What differs is a box mean of half the window two pixels away, relative to the one here; under the threshold the
    diamond is taken. Direction and gain follow the power of all channels, which share them. Borders mirror.
    """
    if method not in ("original", "cov"):
        raise ValueError(f"unknown method {method}")
    r = r.long()
    h, masks, sig2, box = win // 2, _masks(win | 1), 1.0 / looks, win // 2
    halo = max(h, 2 + box // 2) + 1

    def kernel(block):
        span = (np.abs(block) ** 2).sum(0)
        inner = slice(halo, -halo)

        def local(a, k):
            """Weighted sums over the window of the pixels without the halo."""
            v = View(a, k.shape)
            lo = (halo - k.shape[0] // 2, halo - k.shape[1] // 2)
            rows, cols = a.shape[0] - 2 * halo, a.shape[1] - 2 * halo
            return np.einsum("ijkl,kl->ij", v[lo[0] : lo[0] + rows, lo[1] : lo[1] + cols], k)

        mean, square = np.array([local(span, m) for m in masks]), np.array([local(span * span, m) for m in masks])
        with np.errstate(divide="ignore", invalid="ignore"):
            if method == "cov":
                pick = np.abs((square - mean**2) / mean**2)[:8].argmin(0)
            else:
                k = np.ones((box, box)) / (box * box)
                # An even box reaches one pixel farther up and left; all are as large as what is compared needs.
                v = View(np.pad(span, ((box // 2, box - 1 - box // 2),) * 2, "edge"), (box, box)) if box > 1 else span[..., None, None]
                smooth = np.einsum("ijkl,kl->ij", v, k) if box > 1 else span
                here = smooth[inner, inner]
                away = np.array([smooth[halo + 2 * dy : smooth.shape[0] - halo + 2 * dy, halo + 2 * dx : smooth.shape[1] - halo + 2 * dx] for dy, dx in AROUND])
                apart = np.abs(away / here - 1.0)
                pick = np.where(apart.max(0) < threshold, 8, apart.argmax(0))
        m = np.take_along_axis(mean, pick[None], 0)[0] ** 2
        s = np.maximum(np.take_along_axis(square, pick[None], 0)[0] - m, 1e-10)
        gain = np.maximum((s - m * sig2) / (1 + sig2), 0) / s
        out = block.copy()
        for c, one in enumerate(block):
            every = np.array([local(one, k) for k in masks])
            u = np.take_along_axis(every, pick[None], 0)[0]
            out[c, inner, inner] = u + (one[inner, inner] - u) * gain
        return out

    return map_tiles(r, (halo, halo), kernel, tile=(64, 128), together=True)


def _density(i: np.ndarray, looks: float) -> np.ndarray:
    return looks**looks * i ** (looks - 1) / math.gamma(looks) * np.exp(-looks * i)


def sigma_bounds(looks: float, share: float) -> tuple[float, float, float]:
    """Bounds that hold a share of the speckle density around a mean of one, and the deviation within.

    A search over the lower bound on a fine grid: for each, the upper bound follows from the share.
    """
    grid = np.linspace(1e-6, 30, 300_001)
    pdf = _density(grid, looks)
    step = grid[1] - grid[0]
    mass = np.cumsum(pdf) * step
    first = np.cumsum(pdf * grid) * step
    second = np.cumsum(pdf * (grid - 1) ** 2) * step
    lo = np.flatnonzero(mass < (1 - share) * mass[-1])
    hi = np.minimum(np.searchsorted(mass, mass[lo] + share), len(grid) - 1)
    mean = (first[hi] - first[lo]) / np.maximum(mass[hi] - mass[lo], 1e-10)
    best = int(np.abs(mean - 1).argmin())
    return grid[lo[best]], grid[hi[best]], (second[hi[best]] - second[lo[best]]) / share


def leesigma2(r: Raster, win: tuple[int, int] = (9, 9), looks: float = 1.0, sigma: float = 0.9, perc: float = 0.02, kind: str = "amplitude") -> Raster:
    """Improved sigma filter: bright targets are kept, the sigma range is unbiased, the mean is an MMSE one.

    A pixel is a target's if it is above the global percentile and in a 3 x 3 window with six such pixels.
    """
    p, a, b = power(r, kind), win[0] // 2, win[1] // 2
    i1, i2, dev = sigma_bounds(looks, sigma)
    top = quantiles(p.df, F.col("re"), [1.0 - perc])[0]
    sig2 = 1.0 / looks
    win = (2 * a + 1 + 2, 2 * b + 1 + 2)  # one more on each side: neighbours' 3 x 3 windows

    def f(v):
        ca, cb = a + 1, b + 1
        c = v[:, :, ca, cb]
        bright = v > top
        target = np.zeros(c.shape, bool)
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                target |= bright[:, :, ca + dy - 1 : ca + dy + 2, cb + dx - 1 : cb + dx + 2].sum((-1, -2)) >= 6
        target &= c > top
        near = v[:, :, ca - 1 : ca + 2, cb - 1 : cb + 2]
        m = near.mean((-1, -2))
        s = np.maximum((near * near).mean((-1, -2)) - m * m, 1e-10)
        seed = (c - m) * np.maximum((s - m * m * sig2) / (1 + sig2), 0) / s + m
        w = v[:, :, 1:-1, 1:-1]
        ok = (w > (seed * i1)[..., None, None]) & (w < (seed * i2)[..., None, None])
        n = ok.sum((-1, -2))
        k = np.maximum(n, 1)
        m = (w * ok).sum((-1, -2)) / k
        s = np.maximum((w * w * ok).sum((-1, -2)) / k - m * m, 1e-10)
        gain = np.maximum((s - m * m * dev) / (1 + dev), 0) / s
        return np.where(target, c, np.where(n == 0, 0.0, m + (c - m) * gain))

    return _back(_windowed(p, win, f), kind)


#: Neighbours (dy, dx) in the order in which a region takes them, for idan and for idanq.
STEPS = ((0, 1), (0, -1), (-1, 0), (1, 0), (1, 1), (1, -1), (-1, 1), (-1, -1))
STEPS_Q = ((-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, 1), (1, 0), (1, -1))


def _grown(v: np.ndarray, seed: np.ndarray, start: np.ndarray, inside: np.ndarray, steps: list[int], limit: float, nmax: int, rings: bool) -> tuple[np.ndarray, np.ndarray]:
    """Regions and rejected neighbours (places, -1 where none) of all starts at once.

    v (channels, places) and seed (channels, starts): a neighbour joins if its relative distances from the seed add up to
    ``limit`` at most (below it for rings). A region is its own queue. It ends at nmax pixels, or, for rings, with the
    first ring that brings it to nmax.
    """
    k, room = len(start), 9 * nmax if rings else nmax
    region, back = np.full((k, room), -1), np.full((k, room if rings else nmax), -1)
    region[:, 0], size, refused, ring = start, np.ones(k, int), np.zeros(k, int), np.ones(k, int)
    on, at = np.arange(k), 0
    while len(on):
        for step in steps:
            q = region[on, at] + step
            known = (region[on, : size[on].max()] == q[:, None]).any(1)
            if refused[on].any():
                known |= (back[on, : refused[on].max()] == q[:, None]).any(1)
            new = np.flatnonzero(inside[q] & ~known & (rings | (size[on] < nmax)))
            if not len(new):
                continue
            who, q = on[new], q[new]
            far = (np.abs(v[:, q] - seed[:, who]) / np.maximum(np.abs(seed[:, who]), 1e-10)).sum(0)
            joins = far < limit if rings else far <= limit
            one, two = who[joins], who[~joins]
            region[one, size[one]] = q[joins]
            size[one] += 1
            fits = refused[two] < back.shape[1]
            back[two[fits], refused[two[fits]]] = q[~joins][fits]
            refused[two[fits]] += 1
        at += 1
        if rings:
            turn = on[ring[on] == at]
            done = turn[(size[turn] >= nmax) | (size[turn] == at)]
            ring[turn] = size[turn]
            on = np.setdiff1d(on, done, assume_unique=True)
        else:
            on = on[(size[on] > at) & (size[on] < nmax)]
    return region, back


def _mean_of(v: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The mean of each channel over each row of places."""
    use = places >= 0
    return np.stack([(c[places] * use).sum(1) / use.sum(1) for c in v])


def _neighbourhoods(r: Raster, nmax: int, kernel, tile: tuple[int, int]) -> Raster:
    """kernel(block, flat places of the core, inside, width) per tile; the halo holds every region that starts in the core."""
    ny, nx, halo = r.ny, r.nx, nmax + 1

    def run(block, yy, xx):
        inside = ((yy >= 0) & (yy < ny))[:, None] & ((xx >= 0) & (xx < nx))[None]
        core = np.zeros(inside.shape, bool)
        core[halo:-halo, halo:-halo] = inside[halo:-halo, halo:-halo]
        start = np.flatnonzero(core)
        out = block.copy()
        flat = out.reshape(len(out), -1)
        for a in range(0, len(start), 2048):  # so many regions at a time
            flat[:, start[a : a + 2048]] = kernel(block, start[a : a + 2048], inside.ravel(), block.shape[2])
        return out

    return map_tiles(r, (halo, halo), run, tile=tile, together=True, located=True)


def idan(r: Raster, looks: float = 1.0, nmax: int = 50, llmmse: bool = True) -> Raster:
    """Intensity-driven adaptive neighbourhood of amplitudes, vectors of amplitudes or covariance matrices.

    From each pixel a region of up to nmax pixels grows over eight neighbours, first come first taken, by their distance
    from the 3 x 3 median (of the first channel of a vector, of all diagonal elements of a matrix) within
    2 / (3 sqrt(looks)). Refused neighbours are asked again with three times that distance from the region's mean, as many
    as the region has room for. All elements are averaged over the region; the pixel is added by Lee's factor of the
    power in its 3 x 3 window. Regions stay in the image, so they lie within nmax - 1 rows and columns: so far reaches
    the halo, and no region is cut.
    """
    r = r.long()
    if len(r.lshape) < 2:
        from .filters import _amplitude

        r = _amplitude(r)
    n, limit = (r.lshape[0] if len(r.lshape) == 2 else 0), 2.0 / (3.0 * math.sqrt(looks))

    def kernel(block, start, inside, width):
        flat = block.reshape(len(block), -1)
        diagonal = [i * n + i for i in range(n)] or [0]
        v = flat[diagonal].real
        pad = lambda a: np.pad(a, 1, "edge")  # noqa: E731  the block's rim is beyond every region
        seed = np.stack([np.median(View(pad(c.reshape(block.shape[1:])), (3, 3)), axis=(-1, -2)).ravel()[start] for c in v])
        region, back = _grown(v, seed, start, inside, [dy * width + dx for dy, dx in STEPS], limit, nmax, False)
        seed, seen = _mean_of(v, region), (region >= 0).sum(1) - 1
        more = np.full_like(back, -1)
        for b in range(back.shape[1]):
            q, asked = back[:, b], back[:, b] >= 0
            seen = seen + asked
            far = (np.abs(v[:, q] - seed) / np.maximum(np.abs(seed), 1e-10)).sum(0)
            more[:, b] = np.where(asked & (seen < nmax) & (far <= 3 * limit), q, -1)
        mean = _mean_of(flat, np.hstack([region, more]))
        if not llmmse:
            return mean
        span = (np.abs(flat[diagonal].sum(0)) if n else (np.abs(flat) ** 2).sum(0)).reshape(block.shape[1:])
        m, m2 = (View(pad(a), (3, 3)).mean((-1, -2)).ravel()[start] for a in (span, span * span))
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.maximum(1 - m * m / looks / np.maximum(m2 - m * m, 1e-10), 0) / (1 + 1 / looks)
        return mean + gain * (flat[:, start] - mean)

    return _neighbourhoods(r, nmax, kernel, (64, 128))


def idanq(r: Raster, looks: float = 1.0, nmax: int = 50, llmmse: bool = True, kind: str = "amplitude") -> Raster:
    """The faster neighbourhood: regions grow on the span in whole rings, and all elements of a pixel are averaged over them.

    Amplitudes and complex values are squared first and roots are taken at the end; matrices stay as they are. Rings
    stop with the first that brings a region to nmax. The image's outermost pixels join no region and stay.
    """
    r, ny, nx = r.long(), r.ny, r.nx
    n, root = (r.lshape[0] if len(r.lshape) == 2 else 0), len(r.lshape) < 2 and (r.complex or kind == "amplitude")
    if len(r.lshape) < 2:
        square = F.col("re") ** 2 + F.col("im") ** 2 if r.complex else F.col("re") ** 2 if root else F.abs("re")
        r = r.with_df(r.df.select(*r.keys, "y", "x", square.alias("re")), complex=False)
    limit = 2.0 / (3.0 * math.sqrt(looks))

    def kernel(block, start, inside, width):
        flat = block.reshape(len(block), -1)
        span = np.abs(flat[[i * n + i for i in range(n)]].sum(0)) if n else flat.sum(0)
        # The rim of the image: places inside with a neighbour outside.
        grid = np.pad(inside.reshape(block.shape[1:]), 1)
        inner = np.logical_and.reduce([grid[1 + dy : grid.shape[0] - 1 + dy, 1 + dx : grid.shape[1] - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)]).ravel()
        out = flat[:, start].copy()
        here = np.flatnonzero(inner[start])
        if not len(here):
            return out
        start = start[here]
        seed = np.median(View(np.pad(span.reshape(block.shape[1:]), 1, "edge"), (3, 3)), axis=(-1, -2)).ravel()[start][None]
        region, back = _grown(span[None], seed, start, inner, [dy * width + dx for dy, dx in STEPS_Q], limit, nmax, True)
        seed = _mean_of(span[None], region)
        far = np.abs(span[back] - seed[0][:, None]) / np.maximum(seed[0][:, None], 1e-10)
        places = np.hstack([region, np.where((back >= 0) & (far < 3 * limit), back, -1)])
        mean = _mean_of(flat, places)
        if llmmse:
            m, m2 = _mean_of(np.stack([span, span * span]), places)
            s = np.maximum(m2 - m * m, 1e-10)
            mean = mean + np.maximum((s - m * m / looks) / (1 + 1 / looks), 0) / s * (flat[:, start] - mean)
        out[:, here] = mean
        return out

    return _back(_neighbourhoods(r, nmax, kernel, (64, 128)), "amplitude" if root else "intensity")


def nlmeans(r: Raster, looks: float = 1.0, search: int = 12, patch: int = 5, strength: float = 1.0) -> tuple[Raster, Raster]:
    """Non-local means by likelihood-ratio patch similarity of intensities; the filtered image and its number of looks.

    Patch sums come from cumulative sums; the halo is search + patch + 3.
    """
    halo, hp = search // 2 + patch // 2 + 3, patch // 2
    hs = search // 2
    p = power(r, "amplitude")

    def kernel(block):
        v = np.maximum(block[0], 1e-12)
        logs = np.log(v)
        total, weight, square = np.zeros_like(v), np.zeros_like(v), np.zeros_like(v)
        for dy in range(-hs, hs + 1):
            for dx in range(-hs, hs + 1):
                s = np.roll(v, (-dy, -dx), (0, 1))
                d = 2 * looks * np.log((v + s) / 2) - looks * (logs + np.roll(logs, (-dy, -dx), (0, 1)))
                c = np.pad(d, hp, "edge").cumsum(0).cumsum(1)
                c = np.pad(c, ((1, 0), (1, 0)))
                n = 2 * hp + 1
                sim = c[n:, n:] - c[:-n, n:] - c[n:, :-n] + c[:-n, :-n]
                w = np.exp(-strength * np.maximum(sim / (n * n) - 0.5 / looks * 0.3, 0) * n)
                total, weight, square = total + w * s, weight + w, square + w * w
        m = total / weight
        return np.stack([m, looks * weight * weight / square])

    out = map_tiles(p, (halo, halo), kernel, out_channels=2)
    pick = lambda k: p.with_df(out.df.where(F.col("ch") == k).drop("ch"), lshape=())
    return pick(0), pick(1)


def canny(r: Raster, sigma: float = 2.0, low: float = 0.1, high: float = 0.2, tile: tuple[int, int] = (256, 256)) -> Raster:
    """Canny edges: Gaussian, Sobel, thinning, and hysteresis: weak pixels joined to a strong one over neighbours stay."""
    from .filters import _amplitude

    rad = int(4 * sigma + 0.5)
    halo = rad + 3
    w = np.exp(-0.5 * (np.arange(-rad, rad + 1) / sigma) ** 2)
    w /= w.sum()

    def marks(block):
        v = block[0]
        for ax in (0, 1):
            v = np.apply_along_axis(lambda k: np.convolve(k, w, "same"), ax, v)
        p = np.pad(v, 1, "edge")
        across, down = p[:, 2:] - p[:, :-2], p[2:] - p[:-2]
        dx, dy = (across[:-2] + 2 * across[1:-1] + across[2:]), (down[:, :-2] + 2 * down[:, 1:-1] + down[:, 2:])
        m = np.hypot(dy, dx)
        a = (np.round(np.arctan2(dy, dx) / (np.pi / 4)) % 4).astype(int)
        keep = np.zeros(m.shape, bool)
        for k, (i, j) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1))):
            keep |= (a == k) & (m >= np.roll(m, (i, j), (0, 1))) & (m >= np.roll(m, (-i, -j), (0, 1)))
        return ((keep & (m >= low)).astype(float) + (keep & (m >= high)))[None]

    return hysteresis(map_tiles(_amplitude(r), (halo, halo), marks, tile=tile), tile)


def hysteresis(marked: Raster, tile: tuple[int, int] = (256, 256), count: list[int] | None = None) -> Raster:
    """1 where a pixel marked 1 or 2 is joined over eight neighbours to one marked 2, else 0.

    Tiles find their own parts, named by their first pixel; parts that meet across borders are links, and the parts of
    the whole image come from these in rounds that grow with the logarithm of their length (``count`` gets how many).
    """
    from ..functions.components import connected, labelled
    from ..plans import cut

    r = marked.long()
    ny, nx, (th, tw) = r.ny, r.nx, tile
    ch = F.col("ch") if r.keys else F.lit(0)
    weak = r.df.where("re > 0").select(ch.cast("int").alias("ch"), "y", "x", "re", F.floor(F.col("y") / th).alias("ty"), F.floor(F.col("x") / tw).alias("tx"))

    def parts(p: pa.Table) -> pa.Table:
        c, y, x, ty, tx = (p.column(k).to_numpy() for k in ("ch", "y", "x", "ty", "tx"))
        y0, x0 = int(ty[0]) * th, int(tx[0]) * tw
        mask = np.zeros((min(th, ny - y0), min(tw, nx - x0)), bool)
        mask[y - y0, x - x0] = True
        first = labelled(mask)[y - y0, x - x0]
        part = (int(c[0]) * ny + y0 + first // mask.shape[1]) * nx + x0 + first % mask.shape[1]
        return p.select(["ch", "y", "x", "re"]).append_column("part", pa.array(part, pa.int64()))

    weak = cut(weak.groupBy("ch", "ty", "tx").applyInArrow(parts, "ch int, y long, x long, re double, part long"))
    rim = weak.where((F.col("y") % th).isin(0, th - 1) | (F.col("x") % tw).isin(0, tw - 1)).select("ch", "y", "x", "part")
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1))]))
    moved = rim.select("ch", "part", "y", "x", steps.alias("d")).select("ch", F.col("part").alias("b"), (F.col("y") + F.col("d.a")).alias("y"), (F.col("x") + F.col("d.b")).alias("x"))
    links = rim.withColumnRenamed("part", "a").join(moved, ["ch", "y", "x"]).where("a <> b").select("a", "b").distinct()
    roots = connected(links, count)
    tops = weak.groupBy("part").agg(F.max("re").alias("top")).join(roots, F.col("part") == F.col("node"), "left")
    tops = tops.select("part", F.coalesce("root", "part").alias("root"), "top")
    strong = tops.where("top > 1").select("root").distinct()
    on = tops.join(strong, "root", "left_semi").select("part")
    keys = [*r.keys, "y", "x"]
    edges = weak.join(on, "part", "left_semi").select(*keys, F.lit(1.0).alias("e"))
    out = r.df.select(*keys).join(edges, keys, "left")
    return r.with_df(out.select(*keys, F.coalesce("e", F.lit(0.0)).alias("re")), complex=False)


def carfilter(r: Raster, half: float, shape: str = "box") -> Raster:
    """Periodic mean over a box, a disk or a Gaussian of half width ``half``: shifted sums, no transform."""
    from ..windows import slide

    r = r.long()
    h = int(math.ceil(half)) if shape != "gauss" else int(math.ceil(3 * (half + 0.5)))
    y, x = np.mgrid[-h : h + 1, -h : h + 1]
    k = {"box": (np.maximum(np.abs(y), np.abs(x)) <= half).astype(float), "disk": (y * y + x * x <= (half + 0.5) ** 2).astype(float), "gauss": np.exp(-math.pi * (y * y + x * x) / (half + 0.5) ** 2)}[shape]
    k /= k.sum()
    values = ["re", "im"] if r.complex else ["re"]
    cols, parts = {}, {}
    for c in values:
        for i in range(2 * h + 1):
            def across(line, c=c, row=k[i]):
                out = F.lit(0.0)
                for j, wt in enumerate(row):
                    if wt > 1e-15:
                        out = out + F.lit(float(wt)) * F.lead(c, j - h).over(line)
                return out

            parts[f"_{c}{i}"] = across

        def down(line, c=c):
            out = F.lit(0.0)
            for i in range(2 * h + 1):
                out = out + F.lead(f"_{c}{i}", i - h).over(line)
            return out

        cols[c] = down
    d = slide(r.df, r.keys, "x", r.nx, h, h, parts, "wrap")
    return r.with_df(slide(d, r.keys, "y", r.ny, h, h, cols, "wrap").drop(*parts))


def phantom(spark, ny: int = 64, nx: int = 64, looks: int = 3, seed: int = 1) -> Raster:
    """A speckled scene (disks, an oblique edge, a point target): gamma noise from a seeded hash per pixel."""
    from ..raster import generate

    def unit(y, x, k):
        return (F.pmod(F.xxhash64(y, x, F.lit(seed), F.lit(k)), F.lit(2**52)).cast("double") + 0.5) / 2.0**52

    def value(y, x):
        u, v = y / ny, x / nx
        base = F.lit(1.0)
        for cy, cx, rad, level in ((0.25, 0.25, 0.12, 4.0), (0.7, 0.3, 0.18, 0.25), (0.4, 0.75, 0.1, 9.0)):
            base = F.when((u - cy) ** 2 + (v - cx) ** 2 < rad * rad, level).otherwise(base)
        base = F.when(v > 0.85 + 0.05 * F.sin(u * 12.0), base * 3.0).otherwise(base)
        base = F.when((y == ny // 2) & (x == nx // 2), 500.0).otherwise(base)
        speckle = sum((-F.ln(unit(y, x, k)) for k in range(looks)), F.lit(0.0)) / looks
        return base * speckle

    return generate(spark, ny, nx, value)


def wishart_noise(spark, ny: int, nx: int, n: int = 3, looks: int = 3, seed: int = 1) -> Raster:
    """Looks-averaged n x n matrices of unit complex Gaussian noise, from a seeded hash per pixel."""
    y, x = F.col("y"), F.col("x")
    df = spark.range(ny * nx).select(F.floor(F.col("id") / nx).alias("y"), (F.col("id") % nx).alias("x"))
    unit = lambda k: (F.pmod(F.xxhash64(y, x, F.lit(seed), F.lit(k)), F.lit(2**52)).cast("double") + 0.5) / 2.0**52
    names = {}
    for k in range(looks * n):
        r, a = F.sqrt(-F.ln(unit(2 * k))), 2 * math.pi * unit(2 * k + 1)
        names[f"a{k}"], names[f"b{k}"] = r * F.cos(a), r * F.sin(a)
    df = df.withColumns(names)
    re, im = [], []
    for i in range(n):
        for j in range(n):
            p, q = F.lit(0.0), F.lit(0.0)
            for s in range(looks):
                u, v = s * n + i, s * n + j
                p = p + F.col(f"a{u}") * F.col(f"a{v}") + F.col(f"b{u}") * F.col(f"b{v}")
                q = q + F.col(f"b{u}") * F.col(f"a{v}") - F.col(f"a{u}") * F.col(f"b{v}")
            re.append(p / looks)
            im.append(q / looks)
    return Raster(df.select("y", "x", F.array(*re).alias("re"), F.array(*im).alias("im")), ny, nx, (n, n), "pix", True)


def plr(labels: Raster, classes: int, compatibility: float = 3.0, iterations: int = 5) -> Raster:
    """Probabilistic label relaxation: memberships 0.9 and, for every other class, 0.1 over 3 x 3 means and a compatibility matrix."""
    from ..plans import cut
    from ..windows import box_mean

    r = labels.long()
    p = [f"p{k}" for k in range(classes)]
    df = r.df.select("y", "x", *[F.when(F.col("re") == k, 0.9).otherwise(0.1).alias(p[k]) for k in range(classes)])
    for it in range(iterations):
        df = df.withColumns({f"q{k}": F.col(p[k]) for k in range(classes)})
        df = box_mean(df, [], [f"q{k}" for k in range(classes)], r.ny, r.nx, (3, 3))
        total = sum((F.col(f"q{k}") for k in range(classes)), F.lit(0.0))
        new = [F.col(p[k]) * (total + (compatibility - 1.0) * F.col(f"q{k}")) for k in range(classes)]
        df = df.select("y", "x", *[n.alias(f"n{k}") for k, n in enumerate(new)])
        norm = sum((F.col(f"n{k}") for k in range(classes)), F.lit(0.0))
        df = df.select("y", "x", *[(F.col(f"n{k}") / norm).alias(p[k]) for k in range(classes)])
        if it % 3 == 2:
            df = cut(df)
    best = F.array_max(F.array(*[F.struct(F.col(p[k]).alias("v"), F.lit(-k).alias("k")) for k in range(classes)]))["k"]
    return r.with_df(df.select("y", "x", (-best).cast("double").alias("re")))


def bilateral_matrix(cov: Raster, gamma_s: float = 2.8, gamma_r: float = 1.33, iterations: int = 1) -> Raster:
    """Bilateral filter of covariance matrices: weights fall with |A^-1/2 B A^-1/2| (Frobenius) and distance.

    The centre also gets the largest weight below one. Whole matrices share a tile; linear algebra is batched.
    """
    n = cov.lshape[0]
    reach = int(math.ceil(math.sqrt(3) * gamma_s))

    def kernel(block):
        h, w = block.shape[1:]
        m = block.reshape(n, n, h, w).transpose(2, 3, 0, 1)
        real = np.abs(np.trace(m, axis1=2, axis2=3)) > 0
        val, vec = np.linalg.eigh((m + m.conj().swapaxes(-1, -2)) / 2)
        root = (vec / np.sqrt(np.maximum(val, 1e-12))[..., None, :]) @ vec.conj().swapaxes(-1, -2)
        out, total, top = np.zeros_like(m), np.zeros((h, w)), np.zeros((h, w))
        for t in range(-reach, reach):
            for s in range(-reach, reach):
                b, ok = (np.roll(a, (-t, -s), (0, 1)) for a in (m, real))
                d = np.linalg.norm(root @ b @ root, axis=(-1, -2))
                wr = np.where(ok & np.isfinite(d), np.exp(-d / gamma_r**2), 0.0)
                top = np.where((wr > top) & (wr < 1), wr, top)
                wt = wr * math.exp(-(s * s + t * t) / gamma_s**2)
                out += wt[..., None, None] * b
                total += wt
        out += top[..., None, None] * m
        total += top
        out = np.where((total > 1e-10)[..., None, None], out / np.maximum(total, 1e-10)[..., None, None], m)
        return out.transpose(2, 3, 0, 1).reshape(n * n, h, w)

    r = cov.long()
    for _ in range(iterations):
        r = map_tiles(r, (reach, reach), kernel, tile=(48, 48), together=True, border="zero")
        r = cov.long().with_df(r.df)
    return r
