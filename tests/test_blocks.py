"""Blocked rasters: equal to rows of pixels, at a fraction of their shuffles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweft import blocks as bl
from pixelweft.operators import filters as fl
from pixelweft.raster import from_numpy, generate

RNG = np.random.default_rng(8)


def image(*shape, cplx=False):
    a = RNG.gamma(2, 1, shape)
    return a * np.exp(1j * RNG.uniform(-3, 3, shape)) if cplx else a


@pytest.mark.parametrize(("shape", "cplx"), [((23, 31), False), ((23, 31), True), ((3, 17, 9), True), ((2, 2, 12, 13), True), ((1, 40), False)])
@pytest.mark.parametrize("tile", [(8, 8), (64, 64), (5, 16)])
def test_round_trip_and_halo(spark, shape, cplx, tile):
    a = image(*shape, cplx=cplx)
    b = bl.blocked(from_numpy(spark, a), tile)
    np.testing.assert_array_equal(b.pixels().to_numpy().reshape(a.shape), a)
    halo = (min(3, tile[0]), 5)
    flat = a.reshape(-1, *shape[-2:])

    def kernel(block, yy, xx):
        fold = lambda t, n: np.where(t % (2 * n) < n, t % (2 * n), 2 * n - 1 - t % (2 * n))
        np.testing.assert_array_equal(block, flat[:, fold(yy, shape[-2])][:, :, fold(xx, shape[-1])])
        return block[:, halo[0] : -halo[0], halo[1] : -halo[1]]

    out = bl.map_blocks(b, halo, kernel, located=True)
    np.testing.assert_array_equal(out.pixels().to_numpy().reshape(a.shape), a)


@pytest.mark.parametrize("win", [(7, 7), (3, 5), (4, 6), (1, 3)])
def test_windows_equal_rows(spark, win):
    for a in (image(21, 26), image(21, 26, cplx=True), image(3, 12, 19, cplx=True)):
        r = from_numpy(spark, a)
        b = bl.blocked(r, (8, 9)).written()
        np.testing.assert_allclose(bl.box_mean(b, win).pixels().to_numpy(), fl.boxcar(r, win).to_numpy(), atol=1e-12)
        np.testing.assert_allclose(bl.median(b, win).pixels().to_numpy(), fl.median(r, win).to_numpy(), atol=1e-12)
        np.testing.assert_allclose(bl.lee(b, win, 2.0).pixels().to_numpy(), fl.lee(r, win, 2.0).to_numpy(), atol=1e-9)


def test_lee_of_matrices(spark):
    v = image(2, 15, 14, cplx=True)
    r = from_numpy(spark, v[None] * v[:, None].conj())
    np.testing.assert_allclose(bl.lee(bl.blocked(r, (8, 8)), (5, 5), 3.0).pixels().to_numpy(), fl.lee(r, (5, 5), 3.0).to_numpy(), atol=1e-9)


def test_generated_blocks_and_a_chain(spark):
    value = lambda y, x: (y * 31 + x * 17) % 101 + 1
    r = generate(spark, 70, 90, value)
    b = bl.generated(spark, 70, 90, value, (32, 32))
    np.testing.assert_array_equal(b.pixels().to_numpy(), r.to_numpy())
    got = bl.box_mean(bl.lee(bl.box_mean(b, (3, 3)), (5, 5)), (3, 3)).pixels().to_numpy()
    np.testing.assert_allclose(got, fl.boxcar(fl.lee(fl.boxcar(r, (3, 3)), (5, 5)), (3, 3)).to_numpy(), atol=1e-9)


def test_tiles_stay_where_they_are(spark):
    b = bl.generated(spark, 300, 300, lambda y, x: y + x, (32, 32)).written()
    plan = bl.lee(b).df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan and "ShuffledHashJoin" in plan
    with pytest.raises(ValueError, match="next tile"):
        bl.box_mean(b, (99, 3))


def shuffled(spark):
    """Bytes that the session has shuffled so far."""
    found, total = spark.sparkContext._jsc.sc().statusStore().executorList(True).iterator(), 0
    while found.hasNext():
        total += found.next().totalShuffleWrite()
    return total


def test_a_tenth_of_the_shuffle(spark):
    value = lambda y, x: (y * 31 + x * 17) % 101 + F.hash(y, x) / 2.0**32
    rows = generate(spark, 1024, 1024, value)
    start = shuffled(spark)
    fl.lee(rows, looks=4).df.write.format("noop").mode("overwrite").save()
    by_rows = shuffled(spark) - start
    bl.lee(bl.generated(spark, 1024, 1024, value), looks=4).df.write.format("noop").mode("overwrite").save()
    by_blocks = shuffled(spark) - start - by_rows
    assert 0 < by_blocks < by_rows / 10, (by_rows, by_blocks)
