"""Operators against slow versions of their definitions, written out pixel by pixel."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweft.functions.quantiles import quantiles
from pixelweft.operators import despeckle as ds
from pixelweft.operators import geometry as ge
from pixelweft.operators import spectral as sp
from pixelweft.raster import from_numpy
from pixelweft.tiles import foreach_tile, reduce_tiles

RNG = np.random.default_rng(11)


def around(v, y, x):
    """The 3 x 3 window with mirrored borders."""
    ny, nx = v.shape
    at = lambda t, n: -1 - t if t < 0 else 2 * n - 1 - t if t >= n else t
    return np.array([v[at(y + a, ny), at(x + b, nx)] for a in (-1, 0, 1) for b in (-1, 0, 1)])


def slow_idan(data, v, span, looks, nmax, llmmse):
    """Regions by a queue, refused neighbours asked again, means of all elements, Lee's factor of the 3 x 3 window."""
    ny, nx = v.shape[1:]
    out, limit = data.astype(complex).copy(), 2 / (3 * looks**0.5)
    for y in range(ny):
        for x in range(nx):
            seed = [np.median(around(c, y, x)) for c in v]
            far = lambda q, s: sum(abs(c[q] - k) / max(abs(k), 1e-10) for c, k in zip(v, s, strict=True))
            region, refused, at = [(y, x)], [], 0
            while at < len(region) and len(region) < nmax:
                i, j = region[at]
                at += 1
                for a, b in ds.STEPS:
                    q = (i + a, j + b)
                    if 0 <= q[0] < ny and 0 <= q[1] < nx and q not in region and q not in refused and len(region) < nmax:
                        if far(q, seed) <= limit:
                            region.append(q)
                        elif len(refused) < nmax:
                            refused.append(q)
            seed, seen = [np.mean([c[q] for q in region]) for c in v], len(region) - 1
            more = []
            for q in refused:
                seen += 1
                if seen < nmax and far(q, seed) <= 3 * limit:
                    more.append(q)
            mean = np.array([np.mean([c[q] for q in region + more]) for c in data])
            w = around(span, y, x)
            var = max((w * w).mean() - w.mean() ** 2, 1e-10)
            gain = max(0, 1 - w.mean() ** 2 / looks / var) / (1 + 1 / looks) if llmmse else 0
            out[:, y, x] = mean + gain * (data[:, y, x] - mean)
    return out


@pytest.mark.parametrize("llmmse", [True, False])
def test_idan_of_amplitudes(spark, llmmse):
    a = np.sqrt(RNG.gamma(2, 0.5, (17, 23))) * np.where(np.arange(23) > 11, 3, 1)
    got = ds.idan(from_numpy(spark, a), 2.0, 12, llmmse).to_numpy()
    assert np.allclose(got, slow_idan(a[None], a[None], a * a, 2.0, 12, llmmse)[0].real)


def _matrices(ny, nx, n=2, looks=4):
    z = RNG.standard_normal((looks, n, ny, nx)) + 1j * RNG.standard_normal((looks, n, ny, nx))
    return np.einsum("kiyx,kjyx->ijyx", z, z.conj()) / looks


def test_idan_of_matrices_keeps_every_element(spark):
    m = _matrices(9, 11)
    got = ds.idan(from_numpy(spark, m), 4.0, 8).to_numpy()
    flat = m.reshape(4, 9, 11)
    want = slow_idan(flat, flat[[0, 3]].real, np.abs(flat[0] + flat[3]), 4.0, 8, True)
    assert got.shape == m.shape and np.allclose(got.reshape(4, 9, 11), want)


def test_idanq_of_matrices_keeps_every_element(spark):
    m = _matrices(10, 9)
    got = ds.idanq(from_numpy(spark, m), 4.0, 6).to_numpy().reshape(4, 10, 9)
    flat = m.reshape(4, 10, 9)
    span, want, limit = np.abs(flat[0] + flat[3]), flat.copy(), 2 / (3 * 2.0)
    for y in range(1, 9):
        for x in range(1, 8):
            seed, region, refused, old = np.median(around(span, y, x)), [(y, x)], [], 0
            while len(region) < 6 and old < len(region):
                ring, old = region[old:], len(region)
                for i, j in ring:
                    for a, b in ds.STEPS_Q:
                        q = (i + a, j + b)
                        if 1 <= q[0] < 9 and 1 <= q[1] < 8 and q not in region and q not in refused:
                            (region if abs(span[q] - seed) / seed < limit else refused).append(q)
            seed = np.mean([span[q] for q in region])
            every = region + [q for q in refused if abs(span[q] - seed) / seed < 3 * limit]
            mean, s = np.array([np.mean([c[q] for q in every]) for c in flat]), np.array([span[q] for q in every])
            var = max(s.var(), 1e-10)
            want[:, y, x] = mean + max((var - s.mean() ** 2 / 4) / 1.25, 0) / var * (flat[:, y, x] - mean)
    assert np.allclose(got, want)


def test_canny_keeps_long_weak_edges(spark):
    """An edge that is strong at one end and weak for 600 columns, over three tiles: all of it stays, a weak one alone goes."""
    step = np.maximum(0.06, 0.5 - 0.004 * np.arange(640))
    a = np.zeros((40, 640))
    a[14:] += step
    a[30:, 300:] += 0.06
    out = ds.canny(from_numpy(spark, a), 1.0, 0.1, 1.0).to_numpy()
    assert out[12:17].max(0)[:600].all() and not out[26:34].any()


def test_refined_lee_windows(spark):
    a = np.sqrt(RNG.gamma(4, 0.25, (15, 14))) * np.where(np.arange(14) > 6, 4, 1)
    for win in (5, 7):
        h, box = win // 2, win // 2
        p = np.pad(a, 12, "symmetric")
        want = np.zeros_like(a)
        for y in range(15):
            for x in range(14):
                c = (y + 12, x + 12)
                samp = lambda i, j: np.mean([p[i + s - box // 2, j + t - box // 2] ** 2 for s in range(box) for t in range(box)])
                apart = [abs(samp(c[0] + 2 * dy, c[1] + 2 * dx) / samp(*c) - 1) for dy, dx in ds.AROUND]
                k = int(np.argmax(apart))
                take = [(i, j) for i in range(-h, h + 1) for j in range(-h, h + 1) if (abs(i) + abs(j) <= h if max(apart) < 0.5 else ds.AROUND[k][0] * i + ds.AROUND[k][1] * j <= 0)]
                v = np.array([p[c[0] + i, c[1] + j] for i, j in take])
                m, s = (v**2).mean() ** 2, max((v**4).mean() - (v**2).mean() ** 2, 1e-10)
                want[y, x] = v.mean() + (a[y, x] - v.mean()) * max((s - m / 4) / 1.25, 0) / s
        # At the rim of the image mirrored neighbours are equal, and rounding decides between them.
        assert np.allclose(ds.refinedlee(from_numpy(spark, a), win, 4.0).to_numpy()[3:-3, 3:-3], want[3:-3, 3:-3])


@pytest.mark.parametrize("fix", [False, True])
def test_weights_are_of_each_channel_and_of_the_given_image(spark, fix):
    n = 48
    shape = np.where(np.abs(np.fft.fftfreq(n, 1 / n))[None] < np.array([6, 15])[:, None], 1.0, 0.001)
    z = np.fft.ifft(np.fft.fft(RNG.standard_normal((2, 40, n)) + 1j * RNG.standard_normal((2, 40, n)), axis=2) * np.roll(shape, 5, 1)[:, None], axis=2)
    got = sp.weight(from_numpy(spark, z), alpha=0.6, fix=fix, cutoff=0.3).to_numpy()
    want = z.copy()
    for c in range(2):
        for axis in (1, 0):
            s = np.abs(np.fft.fft(z[c], axis=axis)).mean(1 - axis)
            k, peak = len(s), int(s.argmax())
            up = next((j for j in range(k) if s[(peak + j) % k] <= 0.3 * s[peak]), k)
            down = next((j for j in range(-1, -k, -1) if s[(peak + j) % k] <= 0.3 * s[peak]), -k)
            w = np.zeros(k)
            for j in range(k):
                if j < up - 1 or j - k > down:
                    at = (peak + j) % k
                    w[at] = 1 / s[at] if fix else 1
                    for t in (j, j - k):
                        if down <= t < up:
                            w[at] *= 0.6 - 0.4 * np.cos(2 * np.pi * (t - down) / (up - down - 1))
            w /= w.mean()
            want[c] = np.fft.ifft(np.fft.fft(want[c], axis=axis) * (w[None] if axis else w[:, None]), axis=axis)
    assert np.allclose(got, want)


def test_quantiles_are_exact(spark):
    v = np.concatenate([np.repeat(7.0, 5000), RNG.standard_normal(3000) * 1e6, [np.nan], RNG.random(2000)])
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    got = quantiles(df, F.col("v"), [0, 0.01, 0.3, 0.5, 0.98, 1], bins=16, few=50)
    assert np.allclose(got, np.quantile(v[~np.isnan(v)], [0, 0.01, 0.3, 0.5, 0.98, 1]))
    assert quantiles(df.where("v > 1e9"), F.col("v"), [0.5]) == [None]


def test_tiles_once_each(spark, tmp_path):
    a = RNG.standard_normal((2, 10, 13))
    folder = str(tmp_path)

    def put(y, x, block):
        np.save(f"{folder}/{y}_{x}.npy", block)

    assert foreach_tile(from_numpy(spark, a), put, (4, 5)) == 9
    assert np.array_equal(np.load(f"{folder}/8_10.npy"), a[:, 8:, 10:])
    got = reduce_tiles(from_numpy(spark, a), lambda b: {"n": b.size, "low": b.min()}, {"n": "sum", "low": "min"}, (4, 5))
    assert got == {"n": 260.0, "low": a.min()}


def test_coregister_finds_large_and_partial_shifts(spark):
    big = np.kron(RNG.random((60, 60)), np.ones((6, 6)))
    for dy, dx in ((25, -40), (-3, 7)):
        a, b = big[60:300, 60:300], big[60 - dy : 300 - dy, 60 - dx : 300 - dx]
        out = ge.coregister(from_numpy(spark, a), from_numpy(spark, b)).to_numpy()
        inner = slice(48, -48)
        assert np.abs(out[inner, inner] - a[inner, inner]).mean() < 0.01


def test_stretches_of_long_lines_change_nothing(spark, monkeypatch):
    from pixelweft import windows
    from pixelweft.operators import filters as fl

    a = RNG.standard_normal((23, 31))
    ops = [lambda r: fl.boxcar(r, (5, 4)), lambda r: fl.gauss(r, (1.0, 2.0)), fl.sobel, fl.roa, lambda r: ds.carfilter(r, 2, "disk"), lambda r: sp.sva(r)]
    whole = [f(from_numpy(spark, a)).to_numpy() for f in ops]
    monkeypatch.setattr(windows, "CHUNK", 6)
    for f, want in zip(ops, whole, strict=True):
        assert np.allclose(f(from_numpy(spark, a)).to_numpy(), want)


def test_goldstein_of_one_patch(spark):
    """One patch as large as the image: the spectrum times a power of its modulus, repeated while coherence grows."""
    from pixelweft.operators import insar as ia

    y, x = np.mgrid[:16, :16]
    phase = np.angle(np.exp(1j * (0.7 * x + 0.2 * y + RNG.standard_normal((16, 16)))))

    def power(z, alpha):
        f = np.fft.fft2(z)
        return np.fft.ifft2(f * np.abs(f) ** alpha)

    pseudo = lambda z: abs(z.sum()) / np.abs(z).sum()
    z = best = np.exp(1j * phase)
    old, new = -1.0, pseudo(z)
    while old < 0 or new - old >= 0.1:
        z, old = power(z, 1 - new), new
        new = pseudo(z)
        if new >= old:
            best = z
    got = ia.goldstein_iter(from_numpy(spark, phase), bsx=16, bsy=16, tol=0.1).to_numpy()
    assert np.allclose(np.exp(1j * got), best / np.abs(best), atol=1e-6)
    got = ia.goldstein_iter(from_numpy(spark, phase), exp=0.4, bsx=16, bsy=16).to_numpy()
    want = power(np.exp(1j * phase), 0.4)
    assert np.allclose(np.exp(1j * got), want / np.abs(want), atol=1e-6)
