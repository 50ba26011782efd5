"""Phase filters, the matrix bilateral filter and the dual apodisation against their definitions in whole arrays and loops."""

import math

import numpy as np
import pytest

from pixelweft.operators import despeckle as ds
from pixelweft.operators import insar as ia
from pixelweft.operators import spectral as sp
from pixelweft.raster import from_numpy, generate

from .test_nlsar import scene

RNG = np.random.default_rng(21)


def fringes(ny, nx, noise=0.6):
    y, x = np.mgrid[:ny, :nx]
    return np.angle(np.exp(1j * (0.31 * x + 0.12 * y + noise * RNG.normal(size=(ny, nx)))))


def patches(a, size, step, f):
    """Each patch of the grid (the last one flush with the end, twice where the grid ends there) with triangular weights."""
    ny, nx = a.shape[-2:]

    def starts(n, b, s):
        out = list(range(0, n - b + 1, s))
        return [*out, n - b]

    def ramp(b):
        up = [0.01 + 0.99 * k / ((b + 1) // 2 - 1) for k in range((b + 1) // 2)]
        return np.array(up + up[::-1][b % 2 :])

    total, weight = np.zeros((ny, nx), complex), np.zeros((ny, nx))
    w = np.outer(ramp(size[0]), ramp(size[1]))
    for y in starts(ny, size[0], step[0]):
        for x in starts(nx, size[1], step[1]):
            here = (slice(y, y + size[0]), slice(x, x + size[1]))
            total[here] += w * f(a[(..., *here)])
            weight[here] += w
    return total / weight


def loop_box(a, win):
    """Means of a window with mirrored borders, one by one."""
    out = np.zeros_like(a)
    p = np.pad(a, [(w, w) for w in win], "symmetric")
    for i in range(a.shape[0]):
        for j in range(a.shape[1]):
            y, x = i + win[0] - win[0] // 2, j + win[1] - win[1] // 2
            out[i, j] = p[y : y + win[0], x : x + win[1]].mean()
    return out


def powered(b, e, win=None):
    s = np.fft.fft2(b)
    return np.fft.ifft2(s * np.abs(loop_box(s, win) if win else s) ** e)


def fringe(s):
    k = int(np.abs(s).argmax())
    return np.fft.fftfreq(s.shape[0])[k // s.shape[1]], np.fft.fftfreq(s.shape[1])[k % s.shape[1]], np.abs(s).max()


def ramp2(shape, fy, fx):
    return np.array([[np.exp(2j * np.pi * (i * fy + j * fx)) for j in range(shape[1])] for i in range(shape[0])])


def close(got, want):
    """Angles agree modulo a full turn."""
    assert np.abs(np.angle(np.exp(1j * (got - np.angle(want))))).max() < 1e-8


@pytest.mark.parametrize(("exp", "smo"), [(0.5, False), (0.8, True)])
def test_goldstein(spark, exp, smo):
    p = fringes(40, 37)
    close(ia.goldstein(from_numpy(spark, p), exp, 16, smo).to_numpy(), patches(np.exp(1j * p), (16, 16), (8, 8), lambda b: powered(b, exp, (3, 1) if smo else None)))


@pytest.mark.parametrize("square", [False, True])
def test_goldstein_without_the_fringe(spark, square):
    p = fringes(36, 40)

    def kernel(b):
        fy, fx, peak = fringe(loop_box(np.fft.fft2(b / np.abs(b)), (3, 3)))
        ramp = ramp2(b.shape, fy, fx)
        s = np.fft.fft2(b / ramp)
        c = peak / b.size
        ry, rx, _ = fringe(s)
        return np.fft.ifft2(s * np.abs(s) ** (1 - (c * c if square else c) + math.hypot(ry, rx))) * ramp

    close(ia.goldstein_lfe(from_numpy(spark, p), bs=16, force_coh2=square).to_numpy(), patches(np.exp(1j * p), (16, 16), (8, 8), kernel))


def defringed(b, least, smooth):
    fy, fx, peak = fringe(np.fft.fft2(b / np.abs(b)))
    if peak / b.size < least:
        fy = fx = 0.0
    ramp = ramp2(b.shape, fy, fx)
    return smooth(b / ramp) * ramp


@pytest.mark.parametrize("noise", [0.6, 3.0])
def test_boxcar_without_the_fringe(spark, noise):
    p = fringes(35, 32, noise)
    want = patches(np.exp(1j * p), (16, 16), (8, 8), lambda b: defringed(b, 0.25, lambda z: loop_box(z, (3, 3))))
    close(ia.lffe_boxcar(from_numpy(spark, p), bs=16).to_numpy(), want)


def test_gauss_without_the_fringe(spark):
    p = fringes(33, 38)
    sigma, r = 1.5, int(3 * 1.5 + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    w /= w.sum()

    def smooth(z):
        for _ in range(2):
            e = np.pad(z, ((r, r), (0, 0)), "edge")
            z = np.array([sum(k * e[i + j] for j, k in enumerate(w)) for i in range(z.shape[0])]).T
        return z

    close(ia.lffe_gauss(from_numpy(spark, p), bs=16, sigma=sigma).to_numpy(), patches(np.exp(1j * p), (16, 16), (8, 8), lambda b: defringed(b, 0.3, smooth)))


def test_baran(spark):
    p = fringes(34, 40)
    z = np.exp(1j * p)
    coherence = loop_box(np.abs(loop_box(z, (7, 7))), (7, 7))
    want = patches(np.stack([z, coherence]), (16, 16), (8, 8), lambda b: powered(b[0], 1 - b[1][4:12, 4:12].real.mean()))
    close(ia.baran(from_numpy(spark, p), 16).to_numpy(), want)


def cosines(v, back=False):
    """The even-extension cosine transform of the rows by its sums."""
    n = v.shape[1]
    m = np.array([[(1 if j in (0, n - 1) else 2) * math.cos(math.pi * j * k / (n - 1)) for k in range(n)] for j in range(n)])
    return v @ m / (2 * (n - 1) if back else 1)


def slow_unwrap(p):
    """Second differences (0 across a border) and the division of their cosine transforms."""
    ny, nx = p.shape
    wrap = lambda v: math.atan2(math.sin(v), math.cos(v))
    lap = np.zeros((ny, nx))
    for y in range(ny):
        for x in range(nx):
            if 0 < x < nx - 1:
                lap[y, x] += wrap(p[y, x + 1] - p[y, x]) - wrap(p[y, x] - p[y, x - 1])
            if 0 < y < ny - 1:
                lap[y, x] += wrap(p[y + 1, x] - p[y, x]) - wrap(p[y, x] - p[y - 1, x])
    t = cosines(cosines(lap.T).T)
    wave = np.array([[math.cos(math.pi * y / (ny - 1)) + math.cos(math.pi * x / (nx - 1)) for x in range(nx)] for y in range(ny)])
    wave[0, 0] = 0.0
    t = t / (2 * (wave - 2))
    t[0, 0] = 0
    return cosines(cosines(t.T, True).T, True)


def loop_median(a, win):
    p = np.pad(a, win // 2, "symmetric")
    f = lambda c: np.array([[np.median(c[i : i + win, j : j + win]) for j in range(a.shape[1])] for i in range(a.shape[0])])
    return f(p.real) + 1j * f(p.imag)


def test_unwrapping(spark):
    p = fringes(13, 16, 0.9)
    np.testing.assert_allclose(ia.unwrap_poisson(from_numpy(spark, p)).to_numpy(), slow_unwrap(p), atol=1e-9)


def test_qef(spark):
    p = fringes(14, 18, 0.5)
    up = np.zeros_like(p)
    for a in (21, 9, 3):
        z = np.exp(1j * (p - up))
        z = loop_box(z, (a, a)) if a <= 14 else _wide_box(z, a)
        up = loop_box(up + slow_unwrap(np.angle(loop_median(z, 3))), (11, 11))
    res = loop_box(up, (11, 11))
    z = np.exp(1j * (p - res))
    want = (0.8 * loop_median(z, 5) + 0.2 * z) * np.exp(1j * res)
    close(ia.qef(from_numpy(spark, p), 0.8).to_numpy(), want)


def _wide_box(a, win):
    """A window wider than the image: borders mirrored over and over."""
    ny, nx = a.shape
    fold = lambda t, n: t % (2 * n) if t % (2 * n) < n else 2 * n - 1 - t % (2 * n)
    h = win // 2
    return np.array([[np.mean([a[fold(y + i, ny), fold(x + j, nx)] for i in range(-h, h + 1) for j in range(-h, h + 1)]) for x in range(nx)] for y in range(ny)])


def test_bilateral_of_matrices(spark):
    c = scene(2, 9, 10, 6)
    gs, gr = 1.5, 1.33
    reach = math.ceil(math.sqrt(3) * gs)
    want = np.zeros_like(c)
    for y in range(9):
        for x in range(10):
            w, v = np.linalg.eigh(c[..., y, x])
            root = v @ np.diag(w**-0.5) @ v.conj().T
            total, out, top = 0.0, 0, 0.0
            for t in range(-reach, reach):
                for s in range(-reach, reach):
                    if 0 <= y + t < 9 and 0 <= x + s < 10:
                        b = c[..., y + t, x + s]
                        k = math.exp(-np.linalg.norm(root @ b @ root) / gr**2)
                        top = k if top < k < 1 else top
                        k *= math.exp(-(s * s + t * t) / gs**2)
                        out, total = out + k * b, total + k
            want[..., y, x] = (out + top * c[..., y, x]) / (total + top)
    got = ds.bilateral_matrix(from_numpy(spark, c), gs, gr).to_numpy()
    np.testing.assert_allclose(got, want, rtol=1e-8, atol=1e-10)


def whole_weight(a, alpha, fix, cutoff=0.1):
    """The window between the bounds of the band on both axes; the flattened image is centred too."""
    corr, centre, out = {}, {}, a
    for axis in (1, 0):
        spec, n = np.abs(np.fft.fft(a, axis=axis)).mean(1 - axis), a.shape[axis]
        peak = int(spec.argmax())
        up = next((k for k in range(n) if spec[(peak + k) % n] <= cutoff * spec[peak]), n)
        down = next((-k for k in range(1, n) if spec[(peak - k) % n] <= cutoff * spec[peak]), -n)
        w = np.zeros(n)
        for k in range(n):
            for d in ((k - peak) % n, (k - peak) % n - n):
                if d < up - 1 and d >= 0 or d > down and d < 0:
                    w[k] = 1 / spec[k] if fix else 1
            for d, inside in (((k - peak) % n, (k - peak) % n < up), ((k - peak) % n - n, (k - peak) % n - n >= down)):
                if inside:
                    w[k] *= alpha - (1 - alpha) * math.cos(2 * math.pi * (d - down) / max(1, up - down - 1))
        corr[axis] = w / w.mean()
        centre[axis] = (up + down) // 2 + (peak - n if peak > n // 2 else peak)
    for axis in (1, 0):
        s = np.fft.fft(out, axis=axis) * (corr[axis][None] if axis else corr[axis][:, None])
        out = np.fft.ifft(np.roll(s, -centre[axis] if fix else 0, axis), axis=axis)
    return out


def test_dual_apodisation_takes_the_smaller_of_both(spark):
    a = RNG.normal(size=(24, 20)) + 1j * RNG.normal(size=(24, 20))
    r = from_numpy(spark, a)
    one, two = (whole_weight(a, alpha, fix) for alpha, fix in ((1.0, True), (0.5, False)))
    pick = lambda p, q: np.where(p * q > 0, np.sign(p) * np.minimum(abs(p), abs(q)), 0)
    np.testing.assert_allclose(sp.cda(r).to_numpy(), pick(one.real, two.real) + 1j * pick(one.imag, two.imag), atol=1e-12)


def test_long_lines_are_groups_of_their_own(spark):
    """Eight lines a group made as few groups as an eighth of a long image's columns."""
    from pixelweft import tiles

    # Narrow and long: columns of tiles.GROUP pixels, rows of 16.
    n = tiles.GROUP
    r = generate(spark, n, 16, lambda y, x: (y * 31 + x * 17) % 101)
    per_group = lambda a: np.full(a.shape, float(len(a)))
    most = lambda axis: tiles.map_lines(r, axis, per_group).df.agg({"re": "max"}).first()[0]
    assert most("y") == 1 and most("x") == n // 16


@pytest.mark.parametrize("mode", ["symmetric", "wrap"])
@pytest.mark.parametrize(("before", "after"), [(0, 3), (4, 0), (3, 2), (6, 5), (17, 13)])
def test_padding_of_a_line(spark, mode, before, after):
    from pixelweft.windows import pad

    r = generate(spark, 1, 6, lambda y, x: x + 1)
    got = pad(r.df, "x", 6, before, after, "wrap" if mode == "wrap" else "reflect").orderBy("x").toPandas()
    assert list(got.x) == list(range(-before, 6 + after))
    assert np.array_equal(got.re, np.pad(np.arange(1.0, 7), (before, after), mode))
