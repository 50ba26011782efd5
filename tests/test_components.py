"""Connected parts, hysteresis and Canny's edges against walks from pixel to pixel."""

import math

import numpy as np
import pytest

from pixelweft.functions.components import connected, labelled
from pixelweft.operators import despeckle as ds
from pixelweft.raster import from_numpy

RNG = np.random.default_rng(6)


def walk(mask):
    """The first pixel of each part, by a queue."""
    out = np.full(mask.shape, -1)
    for y, x in zip(*np.nonzero(mask), strict=True):
        if out[y, x] < 0:
            name, todo = y * mask.shape[1] + x, [(y, x)]
            out[y, x] = name
            while todo:
                i, j = todo.pop()
                for q in ((i + a, j + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
                    if 0 <= q[0] < mask.shape[0] and 0 <= q[1] < mask.shape[1] and mask[q] and out[q] < 0:
                        out[q] = name
                        todo.append(q)
    return out


def snake(ny, nx):
    """One line that fills the image in hairpins."""
    m = np.zeros((ny, nx), bool)
    m[::2] = True
    for k, y in enumerate(range(1, ny - 1, 2)):
        m[y, -1 if k % 2 == 0 else 0] = True
    return m


@pytest.mark.parametrize("mask", [RNG.random((40, 37)) < 0.4, RNG.random((40, 37)) < 0.15, snake(41, 50), np.ones((3, 4), bool), np.zeros((5, 5), bool), np.ones((1, 9), bool)])
def test_labels_of_an_array(mask):
    np.testing.assert_array_equal(labelled(mask), walk(mask))


def test_links_and_rounds(spark):
    chain = [(k, k + 1) for k in range(1000)]
    star = [(5000, 6000 + k) for k in range(300)]
    count = []
    got = dict(map(tuple, connected(spark.createDataFrame(chain + star + [(9, 9), (7000, 6999)], "a long, b long"), count).collect()))
    assert got == {**{k: 0 for k in range(1, 1001)}, **{6000 + k: 5000 for k in range(300)}, 7000: 6999}
    assert count[0] <= 3 + 2 * math.log2(1000)
    assert connected(spark.createDataFrame([], "a long, b long")).collect() == []


def slow_hysteresis(marks):
    parts = walk(marks > 0)
    return np.isin(parts, np.unique(parts[marks == 2])) & (marks > 0)


def test_hysteresis_over_many_tiles(spark):
    m = snake(61, 64).astype(float)
    m[60, 0] = 2  # only the far end is strong
    count = []
    got = ds.hysteresis(from_numpy(spark, m), (8, 8), count).to_numpy()
    np.testing.assert_array_equal(got, m > 0)
    assert count[0] <= 3 + 2 * math.log2(8 * 8 * 8)
    spots = (RNG.random((2, 45, 52)) < 0.35) * np.where(RNG.random((2, 45, 52)) < 0.03, 2.0, 1.0)
    got = ds.hysteresis(from_numpy(spark, spots), (8, 16)).to_numpy()
    np.testing.assert_array_equal(got, np.stack([slow_hysteresis(c) for c in spots]))


def slow_canny(v, sigma, low, high):
    """Every step pixel by pixel on the mirrored image."""
    ny, nx = v.shape
    fold = lambda t, n: t % (2 * n) if t % (2 * n) < n else 2 * n - 1 - t % (2 * n)
    rad = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-rad, rad + 1)]
    w = [x / sum(w) for x in w]
    at = lambda a, y, x: a[fold(y, ny), fold(x, nx)]
    down = np.array([[sum(k * at(v, y + i - rad, x) for i, k in enumerate(w)) for x in range(nx)] for y in range(ny)])
    s = np.array([[sum(k * at(down, y, x + i - rad) for i, k in enumerate(w)) for x in range(nx)] for y in range(ny)])
    size, way = np.zeros((ny, nx)), np.zeros((ny, nx), int)
    for y in range(ny):
        for x in range(nx):
            gx = sum(k * (at(s, y + i, x + 1) - at(s, y + i, x - 1)) for i, k in ((-1, 1), (0, 2), (1, 1)))
            gy = sum(k * (at(s, y + 1, x + i) - at(s, y - 1, x + i)) for i, k in ((-1, 1), (0, 2), (1, 1)))
            size[y, x], way[y, x] = math.hypot(gy, gx), round(math.atan2(gy, gx) / (math.pi / 4)) % 4
    marks = np.zeros((ny, nx))
    for y in range(ny):
        for x in range(nx):
            i, j = ((0, 1), (1, 1), (1, 0), (1, -1))[way[y, x]]
            if size[y, x] >= max(at(size, y + i, x + j), at(size, y - i, x - j)):
                marks[y, x] = int(size[y, x] >= low) + int(size[y, x] >= high)
    return slow_hysteresis(marks)


def test_canny_equals_its_steps(spark):
    y, x = np.mgrid[:34, :41]
    v = 1.0 * (np.hypot(y - 15, x - 18) < 9) + 0.4 * (x > 30) + 0.25 * (y > 28) + 0.02 * RNG.random((34, 41))
    for low, high in ((0.1, 0.5), (0.05, 1.5)):
        got = ds.canny(from_numpy(spark, v), 1.5, low, high, tile=(16, 16)).to_numpy()
        want = slow_canny(v, 1.5, low, high)
        np.testing.assert_array_equal(got, want)
        assert 0 < want.sum() < want.size / 4
