"""Golden functions in numpy and properties that hold for any image."""

import numpy as np
import pytest

from pixelweft.operators import despeckle as ds
from pixelweft.operators import filters as fl
from pixelweft.operators import geometry as ge
from pixelweft.operators import insar as ia
from pixelweft.operators import point as pt
from pixelweft.operators import polar as po
from pixelweft.operators import spectral as sp
from pixelweft.raster import from_numpy, generate
from pixelweft.tiles import overlap_add, patch_starts

RNG = np.random.default_rng(0)
IMG = RNG.gamma(2.0, 1.0, (23, 17))
SLC = RNG.standard_normal((23, 18)) + 1j * RNG.standard_normal((23, 18))


def mirrored(a, r):
    return np.pad(a, r, "symmetric")


def box(a, wy, wx):
    p = np.pad(a, ((wy // 2, wy - wy // 2 - 1), (wx // 2, wx - wx // 2 - 1)), "symmetric")
    return np.lib.stride_tricks.sliding_window_view(p, (wy, wx)).mean((-1, -2))


@pytest.mark.parametrize("win", [(7, 7), (4, 5), (1, 3)])
def test_boxcar(spark, win):
    assert np.allclose(fl.boxcar(from_numpy(spark, IMG), win).to_numpy(), box(IMG, *win))


def test_boxcar_wider_than_image(spark):
    a = IMG[:3, :4]
    assert np.allclose(fl.boxcar(from_numpy(spark, a), (9, 11)).to_numpy(), np.lib.stride_tricks.sliding_window_view(np.pad(a, ((4, 4), (5, 5)), "symmetric"), (9, 11)).mean((-1, -2)))


def test_boxcar_of_a_constant(spark):
    r = generate(spark, 9, 8, lambda y, x: y * 0 + 3)
    assert np.allclose(fl.boxcar(r).to_numpy(), 3)


def test_vector_channels_are_filtered_alone(spark):
    v = np.stack([IMG, IMG * 2])
    assert np.allclose(fl.boxcar(from_numpy(spark, v), (3, 3)).to_numpy(), np.stack([box(c, 3, 3) for c in v]))


def test_lee_adapts(spark):
    a = IMG.copy()
    a[:, 8:] *= 5
    span = a**2
    m, m2, k = box(span, 7, 7), box(span**2, 7, 7), None
    v = np.maximum(m2 - m * m, 1e-10)
    k = np.maximum((v - m * m / 4) / 1.25, 0) / v
    u = box(a, 7, 7)
    assert ((k > 0) & (k < 1)).mean() > 0.5
    assert np.allclose(fl.lee(from_numpy(spark, a), looks=4).to_numpy(), u + (a - u) * k)


def test_median_and_tiles_agree(spark):
    p = mirrored(IMG, 1)
    want = np.median(np.lib.stride_tricks.sliding_window_view(p, (3, 3)), axis=(-1, -2))
    r = from_numpy(spark, IMG)
    assert np.allclose(fl.median(r, (3, 3)).to_numpy(), want)
    from pixelweft.tiles import map_tiles

    def kernel(b):
        out = b.copy()
        out[0, 1:-1, 1:-1] = np.median(np.lib.stride_tricks.sliding_window_view(b[0], (3, 3)), axis=(-1, -2))
        return out

    assert np.allclose(map_tiles(r, (1, 1), kernel, tile=(5, 4)).to_numpy(), want)


def test_kernel_is_flipped(spark):
    k = [[1.0, 2.0, 0.0], [0.0, -1.0, 3.0], [2.0, 0.5, 1.0]]
    w = np.lib.stride_tricks.sliding_window_view(mirrored(IMG, 1), (3, 3))
    assert np.allclose(fl.kernelfilter(from_numpy(spark, IMG), k).to_numpy(), (w * np.array(k)[::-1, ::-1]).sum((-1, -2)))


def test_srad_keeps_constants_and_smooths(spark):
    r = from_numpy(spark, IMG)
    out = fl.srad(r, iterations=3).to_numpy()
    assert out.shape == IMG.shape and out.var() < IMG.var()
    flat = fl.srad(generate(spark, 6, 7, lambda y, x: y * 0 + 2), iterations=2).to_numpy()
    assert np.allclose(flat, 2)


def test_rotations_cancel(spark):
    r = from_numpy(spark, IMG)
    assert np.array_equal(ge.rotateright(ge.rotateleft(r)).to_numpy(), IMG)
    assert np.array_equal(ge.rotateleft(r).to_numpy(), np.rot90(IMG))
    assert np.array_equal(ge.rotateright(r).to_numpy(), np.rot90(IMG, 3))


def test_crop_rules_and_geography(spark):
    r = from_numpy(spark, IMG, {"geo_min_east": 100.0, "geo_ps_east": 2.0, "geo_min_north": 0.0, "geo_ps_north": 1.0})
    c = ge.crop(r, 5, 6, 2, 0)
    assert np.array_equal(c.to_numpy(), IMG[5:11, 2:]) and c.meta["geo_min_east"] == 104.0
    assert np.array_equal(ge.crop(r, 99, 4, -1, 99).to_numpy(), IMG[:4])


def test_presum_and_pyramid(spark):
    r = from_numpy(spark, IMG)
    assert np.allclose(ge.presum(r, 4, 3).to_numpy(), IMG[:20, :15].reshape(5, 4, 5, 3).mean((1, 3)))
    assert [(p.ny, p.nx) for p in ge.pyramid(r)] == [(22, 16), (11, 8), (5, 4), (2, 2), (1, 1)]


def test_decimation_keeps_the_remainder(spark):
    r = from_numpy(spark, IMG[:21])
    out = ge.presum(r, 4, 3, decimate=True)
    assert np.array_equal(out.to_numpy(), IMG[:21:4, ::3]) and (out.ny, out.nx) == IMG[:21:4, ::3].shape
    levels = ge.pyramid(r, "labels")
    assert [(p.ny, p.nx) for p in levels] == [(20, 16), (10, 8), (5, 4), (2, 2), (1, 1)]
    assert np.array_equal(levels[3].to_numpy(), IMG[:16:8, :16:8])


@pytest.mark.parametrize("axis", ["range", "azimuth", "2D"])
def test_fft_inverse(spark, axis):
    a = SLC[:22]
    r = from_numpy(spark, a)
    assert np.allclose(sp.fft(sp.fft(r, axis), axis, inverse=True).to_numpy(), a)


def test_weight_both_axes_alone(spark):
    r = from_numpy(spark, SLC)
    for axis in ("range", "azimuth", "both"):
        out = sp.weight(r, axis=axis).to_numpy()
        assert np.isfinite(out).all() and not np.allclose(out, SLC)


def test_sva_golden(spark):
    def line(s, d):
        out = np.zeros_like(s)
        for m in range(d, len(s) - d):
            near = s[m - d] + s[m + d]
            w = -s[m] / near if near else -np.inf
            out[m] = s[m] if w <= 0 else s[m] + 0.5 * near if w >= 0.5 else 0
        return out

    one = lambda a: np.stack([line(c, 2) for c in np.stack([line(r, 2) for r in a]).T]).T
    assert np.allclose(sp.sva(from_numpy(spark, SLC)).to_numpy(), one(SLC.real) + 1j * one(SLC.imag))


def test_coherence(spark):
    a = from_numpy(spark, SLC)
    assert np.allclose(ia.coherence(a, a).to_numpy(), 1)
    c = ia.coherence(a, from_numpy(spark, SLC[::-1].copy())).to_numpy()
    assert ((c >= 0) & (c < 1)).all()


def test_overlap_add_identity_and_last_patch(spark):
    assert patch_starts(20, 8, 4) == [(0, 1), (4, 1), (8, 1), (12, 2)]
    assert patch_starts(21, 8, 4) == [(0, 1), (4, 1), (8, 1), (12, 1), (13, 1)]
    r = from_numpy(spark, SLC)
    assert np.allclose(overlap_add([r], (8, 8), (4, 4), lambda b: np.fft.ifft2(np.fft.fft2(b[0]))).to_numpy(), SLC)


@pytest.mark.parametrize("f", [ia.goldstein, ia.goldstein_iter, ia.goldstein_lfe, ia.lffe_boxcar, ia.lffe_gauss, ia.baran])
def test_phase_filters_reduce_noise(spark, f):
    y, x = np.mgrid[:32, :32]
    clean = np.angle(np.exp(1j * (0.3 * x + 0.1 * y)))
    noisy = np.angle(np.exp(1j * (clean + 0.4 * RNG.standard_normal(clean.shape))))
    size = {"bsx": 16, "bsy": 16, "exp": 0.5} if f is ia.goldstein_iter else {"bs": 16}
    out = f(from_numpy(spark, noisy), **size).to_numpy()
    err = lambda p: np.abs(np.exp(1j * (p - clean)) - 1).mean()
    assert err(out) < err(noisy)


def test_unwrapping_follows_fluctuations(spark):
    y, x = np.mgrid[:17, :17]
    want = 3 * np.cos(2 * np.pi * x / 16) * np.cos(2 * np.pi * y / 16)
    got = ia.unwrap_poisson(from_numpy(spark, np.angle(np.exp(1j * want)))).to_numpy()
    assert np.corrcoef(got.ravel(), want.ravel())[0, 1] > 0.8


def matrix(n=3, ny=4, nx=5, looks=8):
    k = RNG.standard_normal((looks, n, ny, nx)) + 1j * RNG.standard_normal((looks, n, ny, nx))
    return np.einsum("liyx,ljyx->ijyx", k, k.conj()) / looks


def covariance(spark, m):
    n = len(m)
    names = ("HH", "VV", "XX") if n == 3 else ("HH", "VV", "HV", "VH")
    return from_numpy(spark, m, {"CH_pol": [f"{a}{b}*" for a in names for b in names]})


def test_eigen_and_parameters(spark):
    m = matrix()
    ew, ev = po.eigen(covariance(spark, m))
    w = ew.to_numpy()
    assert np.allclose(w.sum(0), np.trace(m).real) and (np.diff(w, axis=0) <= 1e-12).all()
    out = po.entalpani(ew, ev).to_numpy()
    assert (out[0] >= 0).all() and (out[0] <= 1 + 1e-12).all()
    p = w / w.sum(0)
    assert np.allclose(out[0], -(p * np.log(p) / np.log(3)).sum(0)) and np.allclose(out[3], (w[0] - w[1]) / (w[0] + w[1]))


def test_pauli_keeps_span(spark):
    v = RNG.standard_normal((4, 3, 5)) + 1j * RNG.standard_normal((4, 3, 5))
    r = from_numpy(spark, v, {"CH_pol": ["HH", "VV", "HV", "VH"]})
    assert np.allclose((np.abs(po.lex2pauli(r).to_numpy()) ** 2).sum(0), (np.abs(v) ** 2).sum(0))
    m = matrix(4)
    t = po.lex2pauli(covariance(spark, m)).to_numpy()
    d = po._pauli_basis(4)
    assert np.allclose(t, np.einsum("ia,abyx,jb->ijyx", d, m, d.conj()))


def test_vec2mat_order(spark):
    v = RNG.standard_normal((3, 2, 2)) + 1j * RNG.standard_normal((3, 2, 2))
    got = po.vec2mat(from_numpy(spark, v, {"CH_pol": ["HH", "VV", "XX"]})).to_numpy()
    assert np.allclose(got, np.einsum("jyx,iyx->ijyx", v, v.conj()))


def test_determinant(spark):
    for n in (2, 3, 4):
        m = matrix(n)
        assert np.allclose(po.block_det(from_numpy(spark, m)).to_numpy(), np.abs(np.linalg.det(m.transpose(2, 3, 0, 1))))


def test_decompositions_are_powers(spark):
    r = covariance(spark, matrix())
    for f in (po.freemandurden, po.yamaguchi3):
        out = f(r).to_numpy()
        assert np.isfinite(out).all() and (out >= 0).all() and (out > 0).any(axis=(1, 2)).sum() >= 2


def test_wishart_separates_two_scales(spark):
    m = matrix(3, 6, 8)
    m[:, :, :, 4:] *= 20
    labels, centres = po.wishart(covariance(spark, m), classes=2, iterations=6, seed=3)
    got = labels.to_numpy()
    assert len(centres) == 2 and len(np.unique(got[:, :4])) == 1 and len(np.unique(got[:, 4:])) == 1 and got[0, 0] != got[0, 7]


def test_change_detection(spark):
    a = matrix(3, 8, 8, 16)
    b = a.copy()
    b[:, :, 2:6, 2:6] *= 12
    pfa, mask = po.changedet(covariance(spark, a), covariance(spark, b))
    assert pfa.to_numpy()[3, 3] > 0.99 and pfa.to_numpy()[0, 0] < 0.5
    assert mask.to_numpy()[3, 3] == 1 and mask.to_numpy()[0, 0] == 0


def test_chi2_cdf():
    x = np.array([0.5, 3.0, 9.0])
    t = np.linspace(1e-9, 9, 200_001)
    import math

    for k in (4, 9, 13):
        pdf = t ** (k / 2 - 1) * np.exp(-t / 2) / (2 ** (k / 2) * math.gamma(k / 2))
        want = np.interp(x, t, np.concatenate([[0], np.cumsum((pdf[1:] + pdf[:-1]) / 2 * np.diff(t))]))
        assert np.allclose(po._chi2_cdf(x, k), want, atol=1e-5)


def test_idan_follows_a_long_region(spark):
    """A road two pixels wide: from its end, a region of 50 pixels reaches 24 columns."""
    a = np.full((24, 80), 0.1)
    a[10:12, 20:76] = 10 + 0.05 * np.arange(20, 76)
    out = ds.idan(from_numpy(spark, a), 9.0, 50, llmmse=False).to_numpy()
    assert np.isclose(out[10, 21], a[10, 20:45].mean())


def test_idan_is_registered_on_the_whole_image(spark):
    from pixelweft import fixtures as fx
    from pixelweft import registry

    from .conftest import DATA

    assert registry.QUERIES["w21_idan"](spark, DATA).count() == fx.fx2m_abs(spark, DATA).df.count()


@pytest.mark.parametrize("f", [ds.leesigma, ds.emdes, ds.refinedlee, ds.leesigma2, lambda r: ds.nlmeans(r, 3.0)[0], lambda r: ds.idan(r, 3.0, 20)])
def test_speckle_filters_raise_the_looks(spark, f):
    scene = generate(spark, 24, 24, lambda y, x: y * 0 + 1)
    a = np.sqrt(np.random.default_rng(5).gamma(3, 1 / 3, (24, 24)))
    out = f(from_numpy(spark, a)).to_numpy()[6:18, 6:18]
    enl = lambda v: v.mean() ** 2 / v.var()
    assert scene.ny == 24 and enl(out**2) > enl(a[6:18, 6:18] ** 2)


def test_phantom_and_noise_do_not_depend_on_partitions(spark):
    a = ds.phantom(spark, 16, 16).to_numpy()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    assert np.array_equal(a, ds.phantom(spark, 16, 16).to_numpy())
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    m = ds.wishart_noise(spark, 24, 24, 2, 4).to_numpy()
    assert abs(m[0, 0].real.mean() - 1) < 0.1 and np.allclose(m[0, 1], m[1, 0].conj())


def test_mathexpr_is_closed(spark):
    r = from_numpy(spark, IMG)
    assert np.allclose(pt.mathexpr([r, r], "A**2 + where(B > 1, B, 0)").to_numpy(), IMG**2 + np.where(IMG > 1, IMG, 0))
    for bad in ("__import__('os')", "A.x", "Z", "[A]", "exec(A)", "A if B else A"):
        with pytest.raises((ValueError, SyntaxError)):
            pt.to_sql(bad, {"A", "B"})


def test_glcm_correlation_and_energy(spark):
    r = from_numpy(spark, np.kron(np.arange(16.0).reshape(4, 4), np.ones((3, 3))))
    for prop in ("energy", "ASM", "correlation"):
        assert np.isfinite(fl.glcm(r, 5, prop=prop).to_numpy()).all()


def test_palettes_by_rule():
    assert len(set(pt.PALETTES)) == len(pt.PALETTES) == 21
    for name in pt.PALETTES:
        p = pt.palette(name)
        assert len(p) == 256 and all(0 <= v <= 255 and isinstance(v, int) for c in p for v in c)
    for name, ramp in pt.RAMPS.items():
        assert all(pt.palette(name)[at] == colour for at, colour in ramp)
    assert pt.palette("rainbow")[0] == (0, 0, 255) and pt.palette("rainbow")[255] == (255, 0, 0)
    assert len(set(pt.palette("classes8"))) == 8 and len(set(pt.palette("classes16-dark"))) == 16 and pt.palette("classes16")[3] == pt.palette("classes16")[19]
    with pytest.raises(KeyError):
        pt.palette("classes9")


def test_palettes():
    for name in ("grey", "hot", "ocean", "phase"):
        p = pt.palette(name)
        assert len(p) == 256 and all(0 <= v <= 255 for rgb in p for v in rgb)


def test_interpolators_hit_their_samples():
    y = RNG.standard_normal(20)
    at = np.arange(3.0, 16.0)
    for f in (sp.interpol_cubic, sp.interpol_lanczos, *[lambda v, t, w=w: sp.interpol_sinc(v, t, 6, w) for w in sp.SINC_WINDOWS]):
        assert np.allclose(f(y, at), y[3:16])
    assert np.allclose(sp.interpol_spline1d(np.arange(20.0), y, at), y[3:16])


def test_matrix_bilateral_smooths_and_keeps_edges(spark):
    m = matrix(3, 10, 12, 4)
    m[..., 6:] *= 50
    out = ds.bilateral_matrix(covariance(spark, m), 1.0).to_numpy()
    power, before = np.trace(out).real, np.trace(m).real
    assert out.shape == m.shape and power[:, :5].var() < before[:, :5].var()
    assert power[:, :5].mean() < 2 * before[:, :5].mean() and power[:, 7:].mean() > 0.5 * before[:, 7:].mean()


def test_airsar_bands_to_a_hermitian_matrix(spark):
    from pixelweft.sources.products import airsar_matrix

    b = RNG.standard_normal((6, 2, 3)) + 1j * RNG.standard_normal((6, 2, 3))
    b[[0, 3, 5]] = b[[0, 3, 5]].real
    m = airsar_matrix(from_numpy(spark, b)).to_numpy()
    assert np.allclose(m, m.conj().swapaxes(0, 1)) and np.allclose(m[2, 1], b[4]) and np.allclose(m[0, 1], b[2])
