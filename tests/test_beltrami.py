"""The Beltrami filter and its pair statistic against loops over pixels."""

import math

import numpy as np
import pytest

from pixelweft.operators import beltrami as be
from pixelweft.raster import from_numpy

from .test_nlsar import scene

MEASURES = sorted(be.DISTANCES)


def slow_distance(measure, a, b):
    """Each measure from its formula, for one pair; logarithms through the series-free definition by eigenvectors."""
    log = lambda m: (lambda w, v: v @ np.diag(np.log(w)) @ np.linalg.inv(v))(*np.linalg.eig(m))
    p, q, ta, tb = np.diag(a).real, np.diag(b).real, np.trace(a).real, np.trace(b).real
    return abs(
        {
            "ai": lambda: np.linalg.norm(np.log(np.linalg.eigvals(np.linalg.solve(a, b)).real)),
            "eu": lambda: np.linalg.norm(p - q),
            "fr": lambda: np.linalg.norm(a - b) / ta,
            "fbs": lambda: np.log(p).sum() - np.log(q).sum(),
            "rdw": lambda: ((p**2 + q**2) / (p * q)).sum() - 2 * len(p),
            "le": lambda: np.linalg.norm(log(a) - log(b)),
            "dg": lambda: np.linalg.norm(np.log(p) - np.log(q)),
            "rws": lambda: (np.trace(np.linalg.solve(a, b)) + np.trace(np.linalg.solve(b, a))).real / 2,
            "drws": lambda: (p / q + q / p).sum() / 2,
            "sg": lambda: math.log(ta) - math.log(tb),
            "srws": lambda: (ta / tb + tb / ta) / 2,
        }[measure]()
    )


@pytest.mark.parametrize("measure", MEASURES)
def test_distances(measure):
    c = scene(3, 4, 5, 6).reshape(3, 3, 20).transpose(2, 0, 1)
    got = be.distance(measure, c[:10], c[10:])
    np.testing.assert_allclose(got, [slow_distance(measure, a, b) for a, b in zip(c[:10], c[10:], strict=True)], rtol=1e-8)
    flat = np.zeros((1, 3, 3), complex)
    assert (be.distance(measure, np.concatenate([c[:1], flat]), np.concatenate([c[1:2], flat]))[0]) == pytest.approx(got_one := slow_distance(measure, c[0], c[1])) and got_one >= 0


def slow_round(c, measure, win, beta, phi, sigma, step, share):
    """A window at a time: places in rings reach their neighbours, weights fall with the way."""
    n, ny, nx = len(c), *c.shape[-2:]
    half = win // 2
    m = c * np.where(np.eye(n) > 0, 1.0, share)[:, :, None, None]
    out = np.zeros_like(c)
    for y in range(ny):
        for x in range(nx):
            far = {(0, 0): 0.0}
            for a, b in sorted(((a, b) for a in range(1 - half, half) for b in range(1 - half, half)), key=lambda p: (max(abs(p[0]), abs(p[1])), p)):
                if (a, b) not in far:
                    continue
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        p, q = (y + a, x + b), (y + a + dy, x + b + dx)
                        if (dy or dx) and 0 <= q[0] < ny and 0 <= q[1] < nx:
                            first, second = (p, q) if (dy, dx) in be.FORWARD else (q, p)
                            d = far[a, b] + step + slow_distance(measure, m[:, :, *first], m[:, :, *second]) / (phi * beta)
                            far[a + dy, b + dx] = min(d, far.get((a + dy, b + dx), math.inf))
            w = {k: math.exp(-(d**2) / sigma**2) for k, d in far.items()}
            out[..., y, x] = sum(v * c[..., y + a, x + b] for (a, b), v in w.items()) / sum(w.values())
    return out


@pytest.mark.parametrize(("measure", "win", "step", "share"), [("ai", 7, 0.0, 1.0), ("fr", 5, 0.4, 1.0), ("dg", 7, 0.1, 0.0), ("le", 5, 0.0, 0.5)])
def test_a_round_equals_windows_one_by_one(spark, measure, win, step, share):
    c = scene(2, 9, 8, 5)
    got = be.beltrami_round(from_numpy(spark, c), 0.9, measure, win, 1.3, 2.1, step, share, tile=(4, 5)).to_numpy()
    np.testing.assert_allclose(got, slow_round(c, measure, win, 0.9, 2.1, 1.3, step, share), rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("form", ["long", "pix"])
def test_rounds_in_one_exchange_equal_rounds_one_by_one(spark, form):
    c = scene(2, 23, 17, 5)
    r = getattr(from_numpy(spark, c), form)()
    steps = [(0.9, 1.0, 1.0), (0.7, 1.0, 0.8), (0.5, 1.5, 1.0)]
    want = c
    for beta, sigma, share in steps:
        want = be.beltrami_round(from_numpy(spark, want), beta, "ai", 5, sigma, 2.1, 0.1, share, tile=(64, 64)).to_numpy()
    for tile in ((4, 5), (8, 64), (64, 3)):
        got = be.beltrami_rounds(r, steps, "ai", 5, 2.1, 0.1, tile)
        assert got.form == form
        np.testing.assert_allclose(got.to_numpy(), want, rtol=1e-12, atol=1e-14)


def test_the_image_is_cut_once_in_several_rounds(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(be, "cut", lambda df, cut=be.cut: (cuts.append(df), cut(df))[1])
    _, betas = be.mcb(from_numpy(spark, scene(2, 6, 5, 6)), 6, max_rounds=5, epsilon=0.0, side=9)
    assert len(betas) == 5 and len(cuts) == 6  # once a round for the speckle


def test_pairs_and_beta(spark):
    c = scene(3, 10, 7, 6)
    r = from_numpy(spark, c)
    flat = c.reshape(3, 3, 70).transpose(2, 0, 1)
    for multiplier, shift in ((1, None), (be.scattered_multiplier(70), 5)):
        want = [slow_distance("ai", flat[i], flat[(multiplier * i + (35 if shift is None else shift)) % 70]) for i in range(70)]
        got = {p.i: p.d for p in be.pair_distances(r, "ai", multiplier, shift).collect()}
        np.testing.assert_allclose([got[i] for i in range(70)], want, rtol=1e-8, atol=1e-7)
        row = be.beta_statistic(from_numpy(spark, c), "ai", multiplier, shift).first()
        assert row.beta == pytest.approx(np.median(want)) and row.pairs == 70
    with pytest.raises(ValueError, match="factor"):
        be.pair_distances(r, multiplier=14)
    assert len({be.scattered_multiplier(70, s) for s in range(1, 4)}) > 1


def test_singular_matrices_are_no_pairs(spark):
    c = scene(2, 6, 6, 4)
    c[:, :, 0, :3] = 0
    row = be.beta_statistic(from_numpy(spark, c), "ai").first()
    assert row.pairs == 30 and np.isfinite(row.beta)


def test_equivalent_looks(spark):
    c = scene(2, 40, 40, 8)[..., :20]
    p = np.array([c[0, 0].real, c[1, 1].real])
    assert be.equivalent_looks(from_numpy(spark, c)).first().enl == pytest.approx((p.mean((1, 2)) ** 2 / p.var((1, 2))).mean())


def test_rounds_stop_when_beta_does(spark):
    c = scene(2, 24, 16, 6)
    got, betas = be.mcb(from_numpy(spark, c), 6, max_rounds=12, epsilon=0.05, side=12)
    moves = np.abs(np.diff([0.0, math.inf, *betas]))[1:]
    assert (moves[:-1] >= 0.05).all() and (moves[-1] < 0.05 or len(betas) == 12)
    out = got.to_numpy()
    left = lambda a: a[0, 0].real[:, 1:6]
    assert left(out).std() / left(out).mean() < 0.6 * left(c).std() / left(c).mean() and out[0, 0].real[:, -4:].mean() > 4 * left(out).mean()


def test_a_vector_becomes_matrices(spark):
    v = (scene(3, 8, 9, 1)[0] * 0 + np.random.default_rng(4).normal(size=(3, 8, 9))) * (1 + 0.5j)
    want = v[None] * v[:, None].conj()
    got = be.matrices(from_numpy(spark, v))
    np.testing.assert_allclose(got.to_numpy(), want)
    out, betas = be.mcb(from_numpy(spark, v), max_rounds=2, side=9)
    assert len(betas) == 2 and np.isfinite(out.to_numpy()).all() and out.lshape == (3, 3)
