"""The multi-index on vectors with close neighbours: queries stay in its tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweft.llm import ann


def clustered(n=6000, d=48, groups=40, spread=0.06, stray=0.0):
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(groups, d))
    x = centre[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, d))
    far = rng.random(n) < stray
    x[far] = rng.normal(size=(far.sum(), d))
    return x * rng.uniform(0.9, 1.1, (n, 1)), far


def search(spark, x, **options):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(6)
    return ann.search(df, df.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), **options).toPandas()


def recall(x, got, queries, k=20):
    found = 0
    for q in queries:
        s = x @ x[q]
        s[q] = -np.inf
        found += len(set(np.argsort(-s, kind="stable")[:k]) & set(got.loc[got.query_id == q, "vec_id"]))
    return found / (k * len(queries))


@pytest.mark.parametrize("stray", [0.0, 0.3])
def test_queries_with_close_neighbours_never_scan(spark, stray):
    """Also where a third of the rows is without any structure, for which the common radius is wide."""
    x, far = clustered(stray=stray)
    got = search(spark, x, shard=1500)
    queries = np.arange(0, len(x), 20)
    assert recall(x, got, queries) >= 0.9
    one = got.drop_duplicates("query_id").set_index("query_id")
    near = one.loc[queries[~far[queries]]]
    assert (near.scanned == 0).mean() > 0.9 and (near.probed > 0).all()
    assert near.probed.mean() < 0.35 * len(x) and near.reranked.mean() < 0.35 * len(x)


def test_what_lies_beyond_a_radius():
    x, _ = clustered(1500)
    codes = ann.Codes(x, 256)
    reach = ann.Reach(x, codes, 20, 0.97)
    c, q = codes(x), codes(x[:200], True)
    s = codes.cosines(x[:200], x)
    want = (x[:200] / np.linalg.norm(x[:200], axis=1, keepdims=True)) @ x.T / np.linalg.norm(x, axis=1).max()
    np.testing.assert_allclose(s, want, atol=1e-12)
    s[np.arange(200), np.arange(200)] = -np.inf
    far = np.stack([ann.distances(c, one) for one in q])
    for r in (0, 15, 40, 100, 200, 256):
        assert reach.beyond[r] == (s[far > r].max() if (far > r).any() else -np.inf)
    assert (reach.beyond[1:] <= reach.beyond[:-1]).all() and reach.needed(1.1) == 0 and reach.needed(-2.0) == reach.radius


def test_probes_find_every_code_within_the_radius():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 256, (40, 32), dtype=np.uint8)
    codes = np.repeat(base, 50, 0)
    for row in codes:
        for bit in rng.integers(0, 256, rng.integers(0, 50)):
            row[bit // 8] ^= 1 << (bit % 8)
    index = ann.MultiIndex(codes)
    for code in base[:10]:
        for r in (0, 7, 15, 16, 31, 47, 63):
            got = index.within(code, r)
            assert got.tolist() == np.flatnonzero(ann.distances(codes, code) <= r).tolist()
    assert index.scanned == 0 and 0 < index.probed
    index.within(base[0], 120)
    assert index.scanned == len(codes)
