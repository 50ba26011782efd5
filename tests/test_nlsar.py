"""Matrix-valued non-local means against its definition pixel by pixel; grouped quantiles against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweft.functions.quantiles import grouped_quantiles
from pixelweft.operators import nlsar as nl
from pixelweft.operators.despeckle import wishart_noise
from pixelweft.raster import from_numpy

RNG = np.random.default_rng(2)


def scene(n, ny, nx, looks):
    z = RNG.normal(size=(looks, n, ny, nx)) + 1j * RNG.normal(size=(looks, n, ny, nx))
    z *= np.where(np.arange(nx) > nx // 2, 3.0, 1.0)
    return (z[:, :, None] * z[:, None].conj()).mean(0) / 2


def at(v, y, x):
    ny, nx = v.shape[-2:]
    fold = lambda t, m: t % (2 * m) if t % (2 * m) < m else 2 * m - 1 - t % (2 * m)
    return v[..., fold(y, ny), fold(x, nx)]


def smooth(c, scale):
    if not scale:
        return c
    h = nl.smoothing_reach(scale)
    out = np.zeros_like(c)
    w = {(a, b): math.exp(-math.pi * (a * a + b * b) / (scale + 0.5) ** 2) for a in range(-h, h + 1) for b in range(-h, h + 1)}
    for y in range(c.shape[-2]):
        for x in range(c.shape[-1]):
            out[..., y, x] = sum(k * at(c, y + a, x + b) for (a, b), k in w.items()) / sum(w.values())
    return out


def ratio(c, p, q, looks):
    n = len(c)
    a, b = at(c, *p), at(c, *q)
    if looks < n:
        shrink = np.where(np.eye(n) > 0, 1, (looks / n) ** (1 / 3))
        a, b = a * shrink, b * shrink
    det = lambda m: np.linalg.det(m).real
    return looks * math.log(det(a + b) ** 2 / det(a) / det(b)) - 2 * looks * n * math.log(2)


def patch(c, p, shift, r, looks):
    return np.mean([ratio(c, (p[0] + a, p[1] + b), (p[0] + shift[0] + a, p[1] + shift[1] + b), looks) for a in range(-r, r + 1) for b in range(-r, r + 1)])


def slow_nlsar(c, noise, looks, search, radii, scales):
    n, ny, nx = len(c), *c.shape[-2:]
    q = noise[0, 0].real
    eta2 = q.var() / q.mean() ** 2
    tables = []
    for s in range(scales):
        z = smooth(noise, s)
        for r in radii:
            d = np.sort([patch(z, (y, x), (2 * r + 1, 2 * r + 1), r, looks) for y in range(z.shape[-2]) for x in range(z.shape[-1])])
            tables.append([d[int((len(d) - 1) * k / 1023)] for k in range(1024)])
    weights = nl.weight_table()
    levels = [smooth(c, s) for s in range(scales)]
    out, seen = c.copy(), np.ones((ny, nx))
    for y in range(ny):
        for x in range(nx):
            for j in range(scales * len(radii)):
                z, r = levels[j // len(radii)], radii[j % len(radii)]
                rows = [(0, 1.0, c[..., y, x])]
                for a in range(-search, search + 1):
                    for b in range(-search, search + 1):
                        if a or b:
                            d = patch(z, (y, x), (a, b), r, looks)
                            rows.append((max(abs(a), abs(b)), weights[min(np.searchsorted(tables[j], d), 1023)], at(c, y + a, x + b)))
                for ring in range(1, search + 1):
                    w = np.array([k for far, k, _ in rows if far <= ring])
                    m = np.array([v for far, _, v in rows if far <= ring])
                    mean = np.tensordot(w, m, 1) / w.sum()
                    d = np.array([m[:, i, i].real for i in range(n)])
                    mu, var = (w * d).sum(1) / w.sum(), (w * d * d).sum(1) / w.sum() - ((w * d).sum(1) / w.sum()) ** 2
                    excess = np.abs(var - mu**2 * eta2)
                    alpha = (excess / (excess + mu**2 * eta2)).max()
                    look = 1 / ((1 - alpha) ** 2 * ((w * w).sum() - 1) / w.sum() ** 2 + ((1 - alpha) / w.sum() + alpha) ** 2)
                    if look > seen[y, x] + 1e-9:
                        seen[y, x], out[..., y, x] = look, (1 - alpha) * mean + alpha * c[..., y, x]
    return out, seen


@pytest.mark.parametrize(("n", "looks"), [(2, 4), (3, 2), (1, 1)])
def test_nlsar_equals_its_definition(spark, n, looks):
    c, noise = scene(n, 6, 7, looks), scene(n, 8, 9, looks)
    got, seen = nl.nlsar(from_numpy(spark, c), looks, search=2, patch=2, scales=2, noise=from_numpy(spark, noise))
    eta2, correlation = nl.noise_level(from_numpy(spark, noise))
    radii = [1, 2] if correlation <= 0.25 else [1, 3]
    want, looks_map = slow_nlsar(c, noise, looks, 2, radii, 2)
    assert np.isclose(eta2, noise[0, 0].real.var() / noise[0, 0].real.mean() ** 2)
    np.testing.assert_allclose(seen.to_numpy(), looks_map, rtol=1e-7)
    np.testing.assert_allclose(got.to_numpy(), want, rtol=1e-7, atol=1e-9)


def test_nlsar_does_not_depend_on_tiles_and_smooths(spark):
    c = scene(3, 33, 21, 4)
    noise = wishart_noise(spark, 64, 64, 3, 4)
    run = lambda tile: [r.to_numpy() for r in nl.nlsar(from_numpy(spark, c), 4, search=4, patch=2, noise=noise, tile=tile)]
    (a, la), (b, lb) = run((128, 128)), run((10, 8))
    np.testing.assert_allclose(a, b, rtol=1e-9)
    np.testing.assert_allclose(la, lb, rtol=1e-9)
    flat = a[0, 0].real[:, 1:8]
    assert flat.std() / flat.mean() < 0.5 * c[0, 0].real[:, 1:8].std() / c[0, 0].real[:, 1:8].mean() and la.min() >= 1 and np.median(la) > 4
    assert a[1, 1].real[:, -5:].mean() > 5 * a[1, 1].real[:, :5].mean()  # the edge stays
    np.testing.assert_allclose(a, a.conj().swapaxes(0, 1))


def test_zero_power_and_amplitude_like_input(spark):
    c = scene(1, 9, 9, 1)
    c[0, 0, 2, 3] = 0
    got, seen = nl.nlsar(from_numpy(spark, c[0, 0].real), 1, search=2, patch=1, noise=wishart_noise(spark, 40, 40, 1, 1))
    assert np.isfinite(got.to_numpy()).all() and seen.to_numpy().min() >= 1
    with pytest.raises(ValueError, match="noise"):
        nl.nlsar(from_numpy(spark, c), 1.5)


def test_weight_table():
    w = nl.weight_table()
    # Fixed values of the published kernel: e^-3 at no dissimilarity, 1 at the expected one, 0 at the top.
    assert np.isclose(w[0], math.exp(-3)) and np.isclose(w[1], 0.215635, atol=1e-5) and np.isclose(w[-2], 0.107375, atol=1e-5)
    assert w[-1] == 0 and np.isclose(w.max(), 1, atol=1e-3) and len(w) == 1024


def test_grouped_quantiles(spark):
    rows = [(k, float(v)) for k, size in ((0, 1000), (1, 7), (2, 1)) for v in RNG.normal(size=size)] + [(3, 5.0)] * 900 + [(3, 6.0)] * 100 + [(4, float(v)) for v in 10.0 ** RNG.integers(-8, 9, 500)] + [(5, float("nan")), (5, None), (0, float("nan"))]
    shares = [0.0, 0.25, 0.5, 0.9, 0.95, 1.0]
    df = spark.createDataFrame(rows, "k int, v double").repartition(5)
    got = {(r.k, r.i): r.q for r in grouped_quantiles(df, ["k"], F.col("v"), shares).collect()}
    assert {k for k, _ in got} == {0, 1, 2, 3, 4}
    for k in range(5):
        v = [x for g, x in rows if g == k and x is not None and not math.isnan(x)]
        np.testing.assert_allclose([got[k, i] for i in range(6)], np.quantile(v, shares), rtol=1e-12)
    one = grouped_quantiles(df.where("k = 0"), [], F.col("v"), [0.5]).first()
    assert np.isclose(one.q, np.median([x for g, x in rows if g == 0 and not math.isnan(x)]))


def test_nlmeans_of_intensities_equals_its_sums(spark):
    from pixelweft.operators.despeckle import nlmeans

    v = RNG.gamma(2, 1, (11, 13)) * np.where(np.arange(13) > 6, 4, 1)
    looks, hs, hp = 2.0, 2, 1
    want, seen = np.zeros_like(v), np.zeros_like(v)
    at2 = lambda a, y, x: at(a, y, x)
    for y in range(11):
        for x in range(13):
            total = weight = square = 0.0
            for dy in range(-hs, hs + 1):
                for dx in range(-hs, hs + 1):
                    d = []
                    for i in range(-hp, hp + 1):
                        for j in range(-hp, hp + 1):
                            p, q = at2(v, y + i, x + j), at2(v, y + i + dy, x + j + dx)
                            d.append(2 * looks * math.log((p + q) / 2) - looks * math.log(p * q))
                    w = math.exp(-max(np.mean(d) - 0.15 / looks, 0) * (2 * hp + 1))
                    total, weight, square = total + w * at2(v, y + dy, x + dx), weight + w, square + w * w
            want[y, x], seen[y, x] = total / weight, looks * weight * weight / square
    got, number = nlmeans(from_numpy(spark, np.sqrt(v)), looks, search=2 * hs, patch=2 * hp + 1)
    np.testing.assert_allclose(got.to_numpy(), want, rtol=1e-9)
    np.testing.assert_allclose(number.to_numpy(), seen, rtol=1e-9)
