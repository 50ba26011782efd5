"""Interpolation of irregular lines and at scattered points, against the formulas value by value."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweft.operators import resample as rs
from pixelweft.operators import spectral as sp
from pixelweft.raster import from_numpy

RNG = np.random.default_rng(12)


def slow_cubic(x, y, at):
    """Bracket by search, four values, weights of the cubic convolution."""
    order = np.argsort(x)
    x, y, n = x[order], y[order], len(x)
    if n < 2 or at < x[0] or at > x[-1]:
        return None
    k = min(max(np.searchsorted(x, at, "right") - 1, 0), n - 2)
    t = (at - x[k]) / (x[k + 1] - x[k])
    if n == 2:
        return y[0] * (1 - t) + y[1] * t
    a = y[k - 1] if k else 3 * y[0] - 3 * y[1] + y[2]
    d = y[k + 2] if k + 2 < n else 3 * y[k + 1] - 3 * y[k] + y[k - 1]
    return (a * (-(t**3) + 2 * t**2 - t) + y[k] * (3 * t**3 - 5 * t**2 + 2) + y[k + 1] * (-3 * t**3 + 4 * t**2 + t) + d * (t**3 - t**2)) / 2


def test_irregular_lines(spark):
    lines = {k: (RNG.uniform(0, 50, n), RNG.normal(size=n)) for k, n in enumerate((40, 5, 3, 2, 1))}
    samples = [(k, float(x), float(v)) for k, (xs, vs) in lines.items() for x, v in zip(xs, vs, strict=True)]
    targets = [(k, float(t)) for k in lines for t in [*RNG.uniform(-5, 55, 60), *lines[k][0]]] + [(9, 3.0)]
    got = rs.cubic_irregular(spark.createDataFrame(samples + [(0, None, 3.0), (0, 2.0, None)], "k int, x double, v double"), spark.createDataFrame(targets, "k int, at double"), ["k"])
    got = {(r.k, r["at"]): r.v for r in got.collect()}
    assert len(got) == len(set(targets))
    for k, t in targets:
        want = slow_cubic(*lines[k], t) if k in lines else None
        assert (got[k, t] is None) == (want is None) and (want is None or got[k, t] == pytest.approx(want, abs=1e-9)), (k, t)


def test_equal_places_count_with_their_mean(spark):
    samples = spark.createDataFrame([(0, 0.0, 1.0), (0, 1.0, 2.0), (0, 1.0, 4.0), (0, 2.0, 5.0)], "k int, x double, v double")
    assert rs.cubic_irregular(samples, spark.createDataFrame([(0, 1.0)], "k int, at double"), ["k"]).first().v == pytest.approx(3.0)


def slow_sample(a, y, x, method, size):
    ny, nx = a.shape
    if not (0 <= y <= ny - 1 and 0 <= x <= nx - 1):
        return None
    reach = {"linear": 1, "cubic": 2, "lanczos": size}[method]

    def w(t):
        u = abs(t)
        if method == "linear":
            return max(0, 1 - u)
        if method == "cubic":
            return 1.5 * u**3 - 2.5 * u**2 + 1 if u <= 1 else -0.5 * u**3 + 2.5 * u**2 - 4 * u + 2 if u < 2 else 0
        return np.sinc(t) * np.sinc(t / size) if u < size else 0

    out = 0
    for i in range(math.floor(y) + 1 - reach, math.floor(y) + reach + 1):
        for j in range(math.floor(x) + 1 - reach, math.floor(x) + reach + 1):
            if method == "cubic" or (0 <= i < ny and 0 <= j < nx):
                out += w(y - i) * w(x - j) * a[min(max(i, 0), ny - 1), min(max(j, 0), nx - 1)]
    return out


@pytest.mark.parametrize(("method", "size"), [("linear", 1), ("cubic", 2), ("lanczos", 2), ("lanczos", 3)])
def test_scattered_points(spark, method, size):
    a = RNG.normal(size=(13, 17)) + 1j * RNG.normal(size=(13, 17))
    spots = [(i, float(y), float(x)) for i, (y, x) in enumerate(zip(RNG.uniform(-1, 13, 300), RNG.uniform(-1, 17, 300), strict=True))]
    spots += [(300 + i, 4.25, 5.5) for i in range(500)] + [(900, 0.0, 0.0), (901, 12.0, 16.0), (902, 12.0, 3.5), (903, None, 2.0), (904, float("nan"), 2.0)]
    df = spark.createDataFrame(spots, "id int, y double, x double").withColumn("few", F.lit("k"))
    for few in (2000, 4):  # dense cells by shuffle, and by broadcast
        got = {r.id: r for r in rs.sample_at(from_numpy(spark, a), df, method, size, few).collect()}
        assert len(got) == len(spots) and got[0].few == "k"
        for i, y, x in spots:
            want = None if y is None or math.isnan(y) else slow_sample(a, y, x, method, size)
            assert (got[i].re is None) == (want is None), i
            if want is not None:
                assert complex(got[i].re, got[i].im) == pytest.approx(want, abs=1e-9)


def test_cubic_at_pixels_agrees_with_lines(spark):
    a = RNG.normal(size=(4, 20))
    at = np.arange(0, 19, 0.25)
    want = np.stack([sp.interpol_cubic(line, at) for line in a])
    points = spark.createDataFrame([(int(k), int(j), float(k), float(t)) for k in range(4) for j, t in enumerate(at)], "k int, j int, y double, x double")
    got = {(r.k, r.j): r.re for r in rs.sample_at(from_numpy(spark, a), points, "cubic").collect()}
    np.testing.assert_allclose([[got[k, j] for j in range(len(at))] for k in range(4)], want, atol=1e-12)
