"""Registered raster queries: name -> (spark, sf_dir) -> DataFrame, and their SQL.

Names start with the operator's id. Results are rounded, so that both engines' sums agree.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as bl
from . import fixtures as fx
from .operators import beltrami as be
from .operators import despeckle as ds
from .operators import filters as fl
from .operators import geometry as ge
from .operators import insar as ia
from .operators import nlsar as nl
from .operators import point as pt
from .operators import polar as po
from .operators import resample as rs
from .operators import spectral as sp
from .raster import Raster, generate
from .tiles import reduce_tiles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
Q = fx.SQL
META = {"rd": 1.0e-5, "c0": 299792458.0, "rsf": 1.0e8, "h0": 1000.0, "terrain": 100.0, "nrg": 32, "ps_rg": 1.5}


def rows(r: Raster, digits: int = 6) -> DataFrame:
    r = r.long()
    vals = ["re", "im"] if r.complex else ["re"]
    return r.df.select(*([F.col("ch").cast("int").alias("ch")] if r.keys else []), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), *[(F.round(c, digits) + 0.0).alias(c) for c in vals])


def register(name: str, make: Callable[[SparkSession, str], Raster | DataFrame], sql: str | None = None, digits: int = 6) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = make(spark, sf_dir)
        return rows(out, digits) if isinstance(out, Raster) else out

    query.__name__ = name
    QUERIES[name] = query
    if sql is not None:
        ORACLE_SQL[name] = sql


# --- SQL building blocks -------------------------------------------------------------------------------


def sel(src: str, digits: int = 6, keys: str = "y::bigint y, x::bigint x", **cols: str) -> str:
    return f"select {keys}, " + ", ".join(f"round(({e})::double, {digits}) + 0.0::double {c}" for c, e in cols.items()) + f" from ({src})"


def refl(t: str, n: str) -> str:
    m = f"((({t}) % (2*{n}) + 2*{n}) % (2*{n}))"
    return f"(case when {m} < {n} then {m} else 2*{n}-1-{m} end)"


def near(src: str, wy: int, wx: int, cols: dict[str, str], keep: str = "", wrap: bool = False) -> str:
    """Aggregates cols (over b, with offsets dy, dx) in a window around each pixel a of src; keep lists columns of a."""
    at = (lambda t, n: f"((({t}) % {n} + {n}) % {n})") if wrap else refl
    kept = "".join(f", any_value(a.{k}) {k}" for k in keep.split()) if keep else ""
    agg = ", ".join(f"{e} {c}" for c, e in cols.items())
    return (
        f"(with s as materialized ({src}), n as (select max(y)+1 ny, max(x)+1 nx from s), o as materialized (select s.*, dy, dx, {at('s.y+dy', 'ny')} ty, {at('s.x+dx', 'nx')} tx from s cross join n "
        f"cross join range({-(wy // 2)}, {wy - wy // 2}) ry(dy) cross join range({-(wx // 2)}, {wx - wx // 2}) rx(dx)) "
        f"select a.y, a.x{kept}, {agg} from o a join s b on b.y = a.ty and b.x = a.tx group by a.y, a.x)"
    )


def means(src: str, win: tuple[int, int], cols: str, keep: str = "") -> str:
    return near(src, *win, {c: f"avg(b.{c})" for c in cols.split()}, keep)


def pixels(ny: int, nx: int) -> str:
    return f"select g.y::bigint y, h.x::bigint x from range({ny}) g(y) cross join range({nx}) h(x)"


AMP2M = Q["fx2m_abs"]


# --- point-wise ----------------------------------------------------------------------------------------

register("p1_complex2abs", lambda s, d: pt.complex2abs(fx.fx2(s, d)), sel(Q["fx2"], re="sqrt(re*re+im*im)"))
register("p2_int2amp", lambda s, d: pt.int2amp(fx.fx5(s, d)), sel(Q["fx5"], re="sqrt(re)"))
register("p3_amp2int", lambda s, d: pt.amp2int(fx.fx1(s, d)), sel(Q["fx1"], re="re*re"))
register("p4_negate", lambda s, d: pt.negate(fx.fx2(s, d)), sel(Q["fx2"], re="-re", im="-im"))
register("p5_mathexpr", lambda s, d: pt.mathexpr([fx.fx5(s, d), pt.int2amp(fx.fx5(s, d))], "where(A > 10, A**2 / (1 + B), -B + sqrt(A))"), sel(Q["fx5"], re="case when re > 10 then re*re/(1+sqrt(re)) else -sqrt(re)+sqrt(re) end"))
register("p6_phase", lambda s, d: pt.phase(fx.fx2(s, d)), sel(Q["fx2"], re="atan2(im, re)"))
register("p6_phase_pair", lambda s, d: pt.phase(*fx.fx4(s, d)), sel(Q["fx4"], re="atan2(m_im*s_re-m_re*s_im, m_re*s_re+m_im*s_im)"))
register("s26_generated", lambda s, d: generate(s, 64, 48, lambda y, x: (y * 31 + x * 17) % 101), sel(pixels(64, 48), re="(y*31+x*17)%101"))
register("p18_cda_combine", lambda s, d: pt.combine_dual(*fx.fx4(s, d)), sel(Q["fx4"], re="case when sign(m_re)=sign(s_re) then sign(m_re)*least(abs(m_re),abs(s_re)) else 0 end", im="case when sign(m_im)=sign(s_im) then sign(m_im)*least(abs(m_im),abs(s_im)) else 0 end"))
_all = "(select *, avg(re) over () m, min(re) over () lo, max(re) over () hi from ({}))"
register("p19_sarscale", lambda s, d: pt.sarscale(fx.fx5(s, d)), sel(_all.format(Q["fx5"]), re="floor(least(255, greatest(0, re*255.0::double/(2.5::double*m))))"))
register("p19_bytescale", lambda s, d: pt.bytescale(fx.fx5(s, d)), sel(_all.format(Q["fx5"]), re="floor(least(255, greatest(0, (re-lo)*(255.0::double/(hi-lo))+0.4999::double)))"))
register("p19_phascale", lambda s, d: pt.phascale(fx.fx8(s, d)), sel(Q["fx8"], re="floor(least(255, greatest(0, re/pi()*128+127)))"))
register("p19_cohscale", lambda s, d: pt.cohscale(fx.fx1(s, d)), sel(Q["fx1"], re="floor(least(255, greatest(0, re*255)))"))
_hs = (
    f"with v as (select *, 10*avg(re) over () top from ({Q['fx5']}))"
    ", h as (select least(floor(re/(top/1000))::int, 999) b, count(*) n from v where re between 0 and top group by 1)"
    ", c as (select k, (select coalesce(sum(n), 0) from h where b > 0 and b < k) low, (select coalesce(sum(n), 0) from h where b > 0 and b >= k) high, (select sum(n) from h where b > 0)*0.05::double wanted from range(1001) t(k))"
    ", e as (select min(k) filter (where low >= wanted) lo, max(k) filter (where high >= wanted) hi from c)"
    " select y, x, (re-lo*top/1000)/((hi-lo)*top/1000)*255 re from v cross join e"
)
register("p19_histscale", lambda s, d: pt.histscale(fx.fx5(s, d)), sel(_hs, re="floor(least(255, greatest(0, re)))"))
register("p20_cart2pol", lambda s, d: (lambda r: r.with_df(r.df.select("y", "x", pt.cart2pol(r)[0].alias("re"), pt.cart2pol(r)[1].alias("im"))))(fx.fx2(s, d)), sel(Q["fx2"], re="sqrt(re*re+im*im)", im="atan2(im,re)"))
register("p20_pol2cart", lambda s, d: (lambda r: r.with_df(r.df.select("y", "x", pt.pol2cart(F.col("re"), F.col("im"))[0].alias("re"), pt.pol2cart(F.col("re"), F.col("im"))[1].alias("im"))))(fx.fx2(s, d)), sel(Q["fx2"], re="re*cos(im)", im="re*sin(im)"))
register("p21_palette", lambda s, d: pt.coloured(pt.bytescale(fx.fx5(s, d)), "grey"), "select c::int ch, y, x, re from (" + sel(_all.format(Q["fx5"]), re="floor(least(255, greatest(0, (re-lo)*(255.0::double/(hi-lo))+0.4999::double)))") + ") cross join range(3) k(c)")
_bytes = "(floor(least(255, greatest(0, (re-lo)*(255.0::double/(hi-lo))+0.4999::double))))"
_ramp = lambda k: "case " + " ".join(f"when b <= {q} then floor({a[k]}+({b[k]}-{a[k]})*(b-{p})/{float(q - p)}::double+0.5::double)" for (p, a), (q, b) in zip(pt.RAMPS["elevation"][:-1], pt.RAMPS["elevation"][1:], strict=True)) + " end"
register("p21_palette_elevation", lambda s, d: pt.coloured(pt.bytescale(fx.fx5(s, d)), "elevation"), f"select k::int ch, y, x, (case k when 0 then {_ramp(0)} when 1 then {_ramp(1)} else {_ramp(2)} end)::double re from (select y::bigint y, x::bigint x, {_bytes} b from ({_all.format(Q['fx5'])})) cross join range(3) c(k)")
register("p23_sar2rgb", lambda s, d: pt.sar2rgb(pt.amp2int(fx.fx1(s, d))), sel(f"select *, avg(sqrt(re*re)) over () + 3.0::double*stddev_pop(sqrt(re*re)) over () t from ({Q['fx1']})", re="floor(255.0::double*pow(least(1.0::double, sqrt(re*re)/t), 0.7::double))"))

# --- channel algebra -----------------------------------------------------------------------------------

_c = [f"max(case when ch={c} then {p} end) {n}{c}" for c in range(4) for p, n in (("re", "a"), ("im", "b"))]
VEC = f"select y, x, {', '.join(_c)} from ({Q['fx3']}) group by y, x"


def unpivot(src: str, pairs: list[tuple[str, str]], digits: int = 6, real: bool = False) -> str:
    re = "[" + ", ".join(f"({p[0]})::double" for p in pairs) + "]"
    im = "[" + ", ".join(f"({p[1]})::double" for p in pairs) + "]"
    base = f"select y, x, k::int ch, {re}[k+1] re, {im}[k+1] im from ({src}) cross join range({len(pairs)}) c(k)"
    cols = {"re": "re"} if real else {"re": "re", "im": "im"}
    return sel(base, digits, keys="ch, y::bigint y, x::bigint x", **cols)


def mulc(i: int, j: int) -> tuple[str, str]:
    """a_i * conj(a_j)."""
    return f"a{i}*a{j}+b{i}*b{j}", f"b{i}*a{j}-a{i}*b{j}"


MAT4 = [mulc(j, i) for i in range(4) for j in range(4)]
register("p7_vec2mat", lambda s, d: po.vec2mat(fx.fx3_pix(s, d)), unpivot(VEC, MAT4))
register("p9_polextract", lambda s, d: po.polextract(fx.fx3_pix(s, d), "VV"), sel(f"select * from ({Q['fx3']}) where ch=1", re="re", im="im"))
register("p10_poltrace", lambda s, d: po.poltrace(po.vec2mat(fx.fx3_pix(s, d))), sel(VEC, re="(" + "+".join(f"a{i}*a{i}+b{i}*b{i}" for i in range(4)) + ")/4"))
_r2 = "/sqrt(2.0::double)"
register("p11_quad2compact_ctlr", lambda s, d: po.quad2compact(fx.fx3_pix(s, d), "CTLR"), unpivot(VEC, [(f"(a0+b2){_r2}", f"(b0-a2){_r2}"), (f"(a3+b1){_r2}", f"(b3-a1){_r2}")]))
register("p11_quad2compact_pi4", lambda s, d: po.quad2compact(fx.fx3_pix(s, d), "PI4"), unpivot(VEC, [(f"(a0+a2){_r2}", f"(b0+b2){_r2}"), (f"(a3+a1){_r2}", f"(b3+b1){_r2}")]))
register("p11_quad2compact_dcp", lambda s, d: po.quad2compact(fx.fx3_pix(s, d), "DCP"), unpivot(VEC, [("0.5::double*(a0-a1-b2-b3)", "0.5::double*(b0-b1+a2+a3)"), ("0.5::double*(-b0-b1+a3-a2)", "0.5::double*(a0+a1+b3-b2)")]))
_pauli = [(f"(a0+a1){_r2}", f"(b0+b1){_r2}"), (f"(a0-a1){_r2}", f"(b0-b1){_r2}"), (f"(a2+a3){_r2}", f"(b2+b3){_r2}"), (f"(b3-b2){_r2}", f"(a2-a3){_r2}")]
register("p12_lex2pauli_vector", lambda s, d: po.lex2pauli(fx.fx3_pix(s, d)), unpivot(VEC, _pauli))
_pv = f"select y, x, {', '.join(f'{p} a{i}, {q} b{i}' for i, (p, q) in enumerate([*_pauli[:3], (f'(b2-b3){_r2}', f'(a3-a2){_r2}')]))} from ({VEC})"
register("p12_lex2pauli_matrix", lambda s, d: po.lex2pauli(_mat_ij(s, d)), unpivot(_pv, [mulc(i, j) for i in range(4) for j in range(4)]))


def _mat_ij(s: SparkSession, d: str) -> Raster:
    """a_i * conj(a_j): vec2mat's transpose, the order that the Pauli transform of matrices expects."""
    m = po.vec2mat(fx.fx3_pix(s, d))
    order = [j * 4 + i for i in range(4) for j in range(4)]
    pick = lambda c: F.array(*[F.get(c, F.lit(k)) for k in order]).alias(c)
    return m.with_df(m.df.select("y", "x", pick("re"), pick("im")))


register("p14_calibxsym_vector", lambda s, d: po.calibxsym(fx.fx3_pix(s, d)), unpivot(VEC, [("a0", "b0"), ("a1", "b1"), (f"(a2+a3){_r2}", f"(b2+b3){_r2}")]))
register("p14_calibxsym_matrix", lambda s, d: po.calibxsym(po.vec2mat(fx.fx3_pix(s, d)), "take only HV"), unpivot(VEC, [mulc(j, i) for i in range(3) for j in range(3)]))
_ang = "(0.3::double*a0)"
_rot = {
    0: "c*c*{0}0+c*s*{0}2+s*c*{0}3+s*s*{0}1",
    1: "s*s*{0}0-s*c*{0}2-c*s*{0}3+c*c*{0}1",
    2: "-(c*s)*{0}0+c*c*{0}2-s*s*{0}3+s*c*{0}1",
    3: "-(s*c)*{0}0-s*s*{0}2+c*c*{0}3+c*s*{0}1",
}
register("p8_rotate", lambda s, d: po.rotate(fx.fx3_pix(s, d), (lambda r: r.with_df(r.df.select("y", "x", (0.3 * F.get("re", F.lit(0))).alias("re")), lshape=(), form="long", complex=False))(fx.fx3_pix(s, d))), unpivot(f"select *, cos({_ang}) c, sin({_ang}) s from ({VEC})", [(_rot[k].format("a"), _rot[k].format("b")) for k in range(4)]))


def _theta() -> str:
    m = META
    r0 = f"({m['rd'] * m['c0'] / 2.0!r}::double + {m['c0'] / m['rsf'] / 2.0!r}::double * x)"
    t = f"({m['h0']!r}::double - 10*abs(re))/{r0}"
    return f"(case when abs({t}) <= 1 then acos({t}) else 0 end)"


_dem = lambda r: r.with_df(r.df.select("y", "x", (10 * F.abs("re")).alias("re")), complex=False)
register("p15_beta2gamma", lambda s, d: po.beta2gamma(fx.fx1(s, d), _dem(fx.fx1(s, d)), META, True), sel(Q["fx1"], re=f"re*tan({_theta()})"))
register("p16_beta2sigma", lambda s, d: po.beta2sigma(fx.fx1(s, d), _dem(fx.fx1(s, d)), META, False), sel(Q["fx1"], re=f"re*sqrt(sin({_theta()}))"))

# --- covariance fixtures -------------------------------------------------------------------------------


def cov3(s: SparkSession, d: str, win: tuple[int, int] = (5, 3)) -> Raster:
    v = fx.fx3_pix(s, d, 3)
    return po.smooth_matrix(po.vec2mat(v), win)


def cov3_sql(win: tuple[int, int] = (5, 3)) -> str:
    cols = ", ".join(f"{p} r{k}, {q} i{k}" for k, (p, q) in enumerate(mulc(j, i) for i in range(3) for j in range(3)))
    return means(f"select y, x, {cols} from ({VEC})", win, " ".join(f"r{k} i{k}" for k in range(9)))


COV3 = cov3_sql()
register("fx9_covariance", lambda s, d: cov3(s, d), unpivot(COV3, [(f"r{k}", f"i{k}") for k in range(9)]))
# Hermitian 3 x 3: element k = 3 i + j.
_det3 = "(r0*(r4*r8-(r5*r5+i5*i5)) - r8*(r1*r1+i1*i1) - r4*(r2*r2+i2*i2) + 2*(r1*(r5*r2+i5*i2) - i1*(i5*r2-r5*i2)))"
register("p17_block_det", lambda s, d: po.block_det(cov3(s, d)), sel(COV3, 12, re=f"abs({_det3})"), 12)


def cov4(s: SparkSession, d: str) -> Raster:
    return po.smooth_matrix(po.vec2mat(fx.fx3_pix(s, d)), (5, 3))


COV4 = means(f"select y, x, {', '.join(f'{p} r{k}, {q} i{k}' for k, (p, q) in enumerate(MAT4))} from ({VEC})", (5, 3), " ".join(f"r{k} i{k}" for k in range(16)))


def _det4_sql() -> str:
    """The determinant by products of the 2 x 2 minors of the upper and the lower two rows."""
    pairs = [(a, b) for a in range(4) for b in range(a + 1, 4)]

    def minor(row: int, a: int, b: int, name: str) -> str:
        p, q, u, v = 4 * row + a, 4 * (row + 1) + b, 4 * row + b, 4 * (row + 1) + a
        return f"r{p}*r{q}-i{p}*i{q}-r{u}*r{v}+i{u}*i{v} {name}r, r{p}*i{q}+i{p}*r{q}-r{u}*i{v}-i{u}*r{v} {name}i"

    step = f"select y, x, {', '.join(minor(row, a, b, f'{n}{a}{b}') for row, n in ((0, 's'), (2, 'c')) for a, b in pairs)} from ({COV4})"
    terms = [("-" if (a + b) % 2 == 0 else "+", f"s{a}{b}", "c" + "".join(str(k) for k in range(4) if k not in (a, b))) for a, b in pairs]
    re = "".join(f"{g}({p}r*{q}r-{p}i*{q}i)" for g, p, q in terms)
    im = "".join(f"{g}({p}r*{q}i+{p}i*{q}r)" for g, p, q in terms)
    return f"select y, x, sqrt(pow({re}, 2)+pow({im}, 2)) re from ({step})"


register("p17_block_det4", lambda s, d: po.block_det(cov4(s, d)), sel(_det4_sql(), 12, re="re"), 12)
#: Powers of the three and of the four channel form: channels HH, VV, XX and HH, VV, HV, VH.
_powers3 = f"select *, abs(r0) hh, abs(r4) vv, sqrt(r8*r8+i8*i8)/2.0::double hv, sqrt((r0+r4+r8)*(r0+r4+r8)+(i0+i4+i8)*(i0+i4+i8)) span from ({COV3})"
_powers4 = f"select *, abs(r0) hh, abs(r5) vv, sqrt(r10*r10+i10*i10) hv, abs(r0+r5+r10+r15) span from ({COV4})"


def _decomp_sql(first: str, powers: str = _powers3) -> str:
    step = first.format(powers)
    step = f"select *, (a<=0 or b<=0) bad, cr*cr+ci*ci rho2 from ({step})"
    step = f"select *, case when rho2 > a*b and not bad then sqrt(a*b/rho2) else 1.0::double end fit from ({step})"
    step = f"select y, x, span, vol, bad, a, b, cr*fit cr, ci*fit ci from ({step})"
    step = f"select *, case when cr>=0 then (a*b-cr*cr-ci*ci)/nullif(a+b+2*cr,0) else (a*b-cr*cr-ci*ci)/nullif(a+b-2*cr,0) end f from ({step})"
    step = f"select *, b-f g from ({step})"
    step = f"select *, case when cr>=0 then ((f+cr)*(f+cr)+ci*ci)/nullif(g*g,0) else ((f-cr)*(f-cr)+ci*ci)/nullif(g*g,0) end q from ({step})"
    clip = lambda e: f"coalesce(least(span, greatest(0, {e})), 0)"
    even = "case when bad then 0 when cr>=0 then 2*f else g*(1+q) end"
    odd = "case when bad then 0 when cr>=0 then g*(1+q) else 2*f end"
    # greatest skips nulls here, so a missing value is asked for first.
    safe = lambda e: f"case when ({e}) is null then 0 else {clip(e)} end"
    return unpivot(step, [(safe(even), "0"), (safe(odd), "0"), (clip("case when bad then span else vol end"), "0")], real=True)


_fd = "select y, x, span, 8*fv/3 vol, hh-fv a, vv-fv b, r1-fv/3 cr, i1 ci from (select *, hv*3 fv from ({}))"
register("d1_freemandurden", lambda s, d: po.freemandurden(cov3(s, d)), _decomp_sql(_fd))
register("d1_freemandurden4", lambda s, d: po.freemandurden(cov4(s, d)), _decomp_sql(_fd, _powers4))
_ym = lambda p, q, r: f"(case when ratio < -2 then {p} when ratio > 2 then {q} else {r} end)"
_y3 = "select y, x, span, fv vol, hh-" + _ym("8.0::double/15", "3.0::double/15", "3.0::double/8") + "*fv a, vv-" + _ym("3.0::double/15", "8.0::double/15", "3.0::double/8") + "*fv b, sqrt(r1*r1+i1*i1)-" + _ym("2.0::double/15", "2.0::double/15", "1.0::double/8") + "*fv cr, 0.0::double ci from (select *, " + _ym("15.0::double", "15.0::double", "16.0::double") + "/4.0::double*hv fv from (select *, 10*log10(vv/hh) ratio from ({})))"
register("d2_yamaguchi3", lambda s, d: po.yamaguchi3(cov3(s, d)), _decomp_sql(_y3))
register("d2_yamaguchi4ch", lambda s, d: po.yamaguchi3(cov4(s, d)), _decomp_sql(_y3, _powers4))


def _eigen_sql(keep: str = "y, x") -> str:
    """Closed-form eigenvalues l0 >= l1 >= l2 of a Hermitian 3 x 3 matrix."""
    q = f"select *, (r0+r4+r8)/3 m, {_det3} dt from ({COV3})"
    q = f"select *, sqrt(((r0-m)*(r0-m)+(r4-m)*(r4-m)+(r8-m)*(r8-m)+2*(r1*r1+i1*i1+r2*r2+i2*i2+r5*r5+i5*i5))/6) p from ({q})"
    dd = "((r0-m)*((r4-m)*(r8-m)-(r5*r5+i5*i5)) - (r8-m)*(r1*r1+i1*i1) - (r4-m)*(r2*r2+i2*i2) + 2*(r1*(r5*r2+i5*i2) - i1*(i5*r2-r5*i2)))"
    q = f"select *, acos(greatest(-1, least(1, {dd}/(2*p*p*p))))/3 phi from ({q})"
    return f"select {keep}, " + ", ".join(f"greatest(0, m+2*p*cos(phi+{k}*2*pi()/3)) l{n}" for n, k in enumerate((0, 2, 1))) + f" from ({q})"


register("d3_eigen", lambda s, d: po.eigen(cov3(s, d))[0], unpivot(_eigen_sql(), [(f"l{k}", "0") for k in range(3)], real=True))


def _halpha(s: SparkSession, d: str) -> Raster:
    r = fx.fx1(s, d)
    a, b = F.abs(F.sin(F.col("re") * 20)), F.abs(F.cos(F.col("re") * 30)) * 1.5
    return r.with_df(r.df.select("y", "x", F.array(a, b, b).alias("re")), lshape=(3,), form="pix")


def _entalpani_sql() -> str:
    """Eigenvalues in closed form; the first component of a vector by the eigenvalues of the matrix and of its minor."""
    q = _eigen_sql("y, x, r0, r4, r8, r5, i5")
    q = f"select *, l0+l1+l2 t from ({q})"
    p = [f"(l{k}/t)" for k in range(3)]
    first = [f"((l{k}-r4)*(l{k}-r8)-(r5*r5+i5*i5))/((l{k}-l{a})*(l{k}-l{b}))" for k, a, b in ((0, 1, 2), (1, 0, 2), (2, 0, 1))]
    alpha = [f"acos(least(1.0::double, sqrt(greatest(0.0::double, {f}))))" for f in first]
    mean = "+".join(f"{a}*{x}" for a, x in zip(alpha, p, strict=True))
    return unpivot(q, [("-(" + "+".join(f"{x}*ln({x})" for x in p) + ")/ln(3.0::double)", "0"), (alpha[0], "0"), (mean, "0"), ("(l0-l1)/(l0+l1)", "0")], 5, real=True)


register("d4_entalpani", lambda s, d: po.entalpani(cov3(s, d)), _entalpani_sql(), 5)
_cls = lambda rules: "case " + " ".join(f"when {c} then {k}" for c, k in rules) + " else 0 end"
_ha = f"select y, x, abs(sin(re*20)) h, degrees(abs(cos(re*30))*1.5::double) a from ({Q['fx1']})"
register("d5_entalpclass", lambda s, d: po.entalpclass(_halpha(s, d)), sel(_ha, re=_cls([("h>=0.9 and a>=55", 0), ("h>=0.9 and a>=40 and a<55", 1), ("h>=0.9 and a<40", 2), ("h>=0.5 and h<0.9 and a>=50", 3), ("h>=0.5 and h<0.9 and a<40", 5), ("h>=0.5 and h<0.9 and a<50", 4), ("h<0.5 and a>=55", 6), ("h<0.5 and a>=42.5 and a<47.5", 7), ("h<0.5 and a<42.5", 8)])))
register("d5_entalpclass_ordered", lambda s, d: po.entalpclass(_halpha(s, d), ordered=True), sel(_ha, re=_cls([("h<0.5 and a<42.5", 0), ("h>=0.5 and h<0.9 and a<40", 1), ("h>=0.9 and a<40", 2), ("h<0.5 and a<47.5", 3), ("h>=0.5 and h<0.9 and a<50", 4), ("h>=0.9 and a<55", 5), ("h>=0.9", 6), ("h>=0.5 and h<0.9", 7), ("h<0.5", 8)])))


def _parity_labels(s: SparkSession, d: str, k: int = 4) -> Raster:
    c = cov3(s, d)
    return c.with_df(c.df.select("y", "x", (F.floor(F.col("y") / 7) % k + 1).cast("double").alias("re")), lshape=(), form="long", complex=False)


def _centres(s: SparkSession, d: str) -> DataFrame:
    g = po.class_means(cov3(s, d), _parity_labels(s, d))
    return g.select("label", "npix", *[(F.round(f"{p}_{k}", 9) + 0.0).alias(f"{q}{k}") for p, q in (("re", "r"), ("im", "i")) for k in range(9)])


register("a5_class_centres", _centres, f"select ((y//7)%4+1)::int label, count(*) npix, {', '.join(f'round(avg({q}{k}), 9)+0.0::double {q}{k}' for q in 'ri' for k in range(9))} from ({COV3}) group by 1")


def _nearest_sql(rounds: int = 1) -> str:
    """Rounds of centres and of the class of least |tr(C Z^-1)| + ln |det Z|: inverse of a Hermitian matrix by its adjugate."""
    adj = {"w0": "r4*r8-(r5*r5+i5*i5)", "w4": "r0*r8-(r2*r2+i2*i2)", "w8": "r0*r4-(r1*r1+i1*i1)", "w1": "r2*r5+i2*i5-r1*r8", "v1": "i2*r5-r2*i5-i1*r8", "w2": "r1*r5-i1*i5-r2*r4", "v2": "r1*i5+i1*r5-i2*r4", "w5": "r1*r2+i1*i2-r0*r5", "v5": "r1*i2-i1*r2-r0*i5"}
    d = "abs((r0*w0+r4*w4+r8*w8+2*(r1*w1+i1*v1+r2*w2+i2*v2+r5*w5+i5*v5))/dt)+ln(abs(dt))"
    out = [f"m as materialized ({COV3})", "l0 as (select y, x, (y//7)%4+1 c from m)"]
    for t in range(rounds):
        z = f"select dense_rank() over (order by c)-1 c, {', '.join(f'{q}{k}' for q in 'ri' for k in range(9))} from (select c, {', '.join(f'avg({q}{k}) {q}{k}' for q in 'ri' for k in range(9))} from m join l{t} using (y, x) group by 1)"
        out.append(f"z{t} as materialized (select c, {_det3} dt, {', '.join(f'{e} {n}' for n, e in adj.items())} from ({z}))")
        out.append(f"l{t + 1} as materialized (select y, x, c from (select y, x, c, row_number() over (partition by y, x order by {d}, c) k from m cross join z{t}) where k = 1)")
    return f"with {', '.join(out)} select y, x, c::double re from l{rounds}"


register("d6_wishart", lambda s, d: po.wishart(cov3(s, d), 4, start=_parity_labels(s, d))[0], sel(_nearest_sql(10), re="re"))
register("d6_wishart_step", lambda s, d: po.wishart(cov3(s, d), 4, 1, start=_parity_labels(s, d))[0], sel(_nearest_sql(), re="re"))
register("d7_classassign", lambda s, d: po.classassign(cov3(s, d), po.class_centres(cov3(s, d), _parity_labels(s, d))), sel(_nearest_sql(), re="re"))
register("g7_classextract", lambda s, d: po.classextract(fx.fx6(s, d), [1, 3, 7]), sel(Q["fx6"], re="case when re in (1,3,7) then re else -9999 end"))
_srr = "select y, x, (a0-a1)/2-b2 p, (b0-b1)/2+a2 q, (a1-a0)/2-b2 u, (b1-b0)/2+a2 v from ({})".format(VEC)
register("w30_orientationangle", lambda s, d: po.orientationangle(fx.fx3_pix(s, d, 3), (7, 5)), sel(means(f"select y, x, p*u+q*v re, q*u-p*v im from ({_srr})", (7, 5), "re im"), re="atan2(im, re)/4"))
_nz = "exp(-0.5::double*(dy*dy+dx*dx))"
_nesz = near(f"select *, a2*a3+b2*b3 cr, b2*a3-a2*b3 ci, a2*a2+b2*b2 ih, a3*a3+b3*b3 iv from ({VEC})", 9, 9, {c: f"sum(b.{c}*{_nz})/sum({_nz})" for c in ("cr", "ci", "ih", "iv")}, " ".join(f"{p}{k}" for k in range(4) for p in "ab"))
_nesz = f"select *, sqrt(ih*iv)-sqrt(cr*cr+ci*ci) n from {_nesz}"


def _nesz_gain(k: int) -> str:
    i = f"(a{k}*a{k}+b{k}*b{k})"
    x = f"coalesce(({i}-n-sqrt(greatest(0, {i}*n)))/nullif({i}, 0), 0)"
    return f"(case when {x} >= 0 and n >= 0 then sqrt({x}) else 0 end)"


register("w31_neszfilter", lambda s, d: po.neszfilter(fx.fx3_pix(s, d), 1.0), unpivot(_nesz, [(f"a{k}*{_nesz_gain(k)}", f"b{k}*{_nesz_gain(k)}") for k in range(4)]))


def _two_dates(s: SparkSession, d: str) -> tuple[Raster, Raster]:
    a = cov3(s, d)
    k = F.when(F.floor(F.col("y") / 16) % 2 == 0, 3.0).otherwise(1.0)
    scale = lambda c: F.transform(c, lambda v: v * k).alias(c)
    return a, a.with_df(a.df.select("y", "x", scale("re"), scale("im")))


def _lnq_sql() -> str:
    import math

    p, n1, n2 = 3, 16, 16
    const = p * ((n1 + n2) * math.log(n1 + n2) - n1 * math.log(n1) - n2 * math.log(n2))
    rho = 1 - (2 * p**2 - 1) * (1 / n1 + 1 / n2 - 1 / (n1 + n2)) / (6 * p)
    k = "(case when (y//16)%2=0 then 3.0::double else 1.0::double end)"
    return sel(COV3, 4, re=f"{-2 * rho!r}::double*({const!r}::double+16*ln(abs({_det3}))+16*ln(abs({_det3})*{k}*{k}*{k})-32*ln(abs({_det3})*pow(1+{k},3)))")


register("d8_changedet_lnq", lambda s, d: (lambda r: r.with_df(r.df.select("y", "x", F.col("lnq").alias("re"))))(po.changedet(*_two_dates(s, d))[0]), _lnq_sql(), 4)


def _lnq_limit(share: float = 0.99, p: int = 3, n: float = 16.0) -> float:
    """The statistic with a probability of ``share`` by its chi-square series, densities added up on a fine grid."""
    import math

    rho = 1 - (2 * p**2 - 1) * (2 / n - 1 / (2 * n)) / (6 * p)
    o2 = p**2 * (p**2 - 1) * (2 / n**2 - 1 / (2 * n) ** 2) / (24 * rho**2) - 0.25 * p**2 * (1 - 1 / rho) ** 2
    density = lambda t, k: t ** (k / 2 - 1) * math.exp(-t / 2) / (2 ** (k / 2) * math.gamma(k / 2))
    total, t, step = 0.0, 0.0, 1e-3
    while total < share:
        total += step * ((1 - o2) * density(t + step / 2, p * p) + o2 * density(t + step / 2, p * p + 4))
        t += step
    return t


def _polinsar(s: SparkSession, d: str) -> Raster:
    v = fx.fx3_pix(s, d)
    m = po.vec2mat(v.with_df(v.df, meta={}))
    return po.smooth_matrix(m, (3, 3))


_m4 = means(f"select y, x, {', '.join(f'{p} r{k}, {q} i{k}' for k, (p, q) in enumerate(MAT4))} from ({VEC})", (3, 3), " ".join(f"r{k} i{k}" for k in range(16)))
_ccd = f"select y, x, sqrt(r2*r2+i2*i2)/sqrt(r0*r10) c0, sqrt(r7*r7+i7*i7)/sqrt(r5*r15) c1, 0.5::double*(r0+r10) p0, 0.5::double*(r5+r15) p1 from ({_m4})"
_ccd = f"select y, x, ((case when c1>c0 then p1 else p0 end) > 0.001::double and greatest(c0,c1) < 0.5::double)::int::double re from ({_ccd})"
_maj = "(with s as ({0}) select a.y, a.x, (sum(b.re) >= 5)::int::double re from s a join s b on b.y between a.y-1 and a.y+1 and b.x between a.x-1 and a.x+1 group by a.y, a.x)"
register("d8_changedet_mask", lambda s, d: po.changedet(*_two_dates(s, d))[1], sel(_maj.format(f"select y, x, (re > {_lnq_limit()!r}::double)::int::double re from ({_lnq_sql()})"), re="re"))
register("d9_coherchangedet", lambda s, d: po.coherchangedet(_polinsar(s, d)), sel(_maj.format(_ccd), re="re"))
register("d10_wishart_noise", lambda s, d: ds.wishart_noise(s, 32, 32), None)
register("d11_phantom", lambda s, d: ds.phantom(s), None)

# --- geometry and aggregation --------------------------------------------------------------------------

register("g1_crop", lambda s, d: ge.crop(fx.fx1(s, d), 10, 100, 5, 20), sel(f"select y-10 y, x-5 x, re from ({Q['fx1']}) where y between 10 and 109 and x between 5 and 24", re="re"))
register("g3_block", lambda s, d: ge.block(fx.fx1(s, d), 3, 50, 7, 0), sel(f"select y-3 y, x-7 x, re from ({Q['fx1']}) where y between 3 and 49 and x >= 7", re="re"))
register("g4_rotateleft", lambda s, d: ge.rotateleft(fx.fx1(s, d)), sel(f"select 63-x y, y x, re from ({Q['fx1']})", re="re"))
register("g4_rotateright", lambda s, d: ge.rotateright(fx.fx1(s, d)), sel(f"select x y, (select max(vec_id) from embeddings)-y x, re from ({Q['fx1']})", re="re"))
register("g5_transpose", lambda s, d: ge.transpose(fx.fx1(s, d)), sel(f"select x y, y x, re from ({Q['fx1']})", re="re"))
register("g6_mirrorhorizontal", lambda s, d: ge.mirrorhorizontal(fx.fx1(s, d)), sel(f"select y, 63-x x, re from ({Q['fx1']})", re="re"))
register("g6_mirrorvertical", lambda s, d: ge.mirrorvertical(fx.fx1(s, d)), sel(f"select (select max(vec_id) from embeddings)-y y, x, re from ({Q['fx1']})", re="re"))
_cc = "(case when abs(t-m) <= 1 then 1.5::double*pow(abs(t-m),3)-2.5::double*pow(abs(t-m),2)+1 when abs(t-m) < 2 then -0.5::double*pow(abs(t-m),3)+2.5::double*pow(abs(t-m),2)-4*abs(t-m)+2 else 0 end)"
_g8 = (
    f"with r as (select i, {META['rd'] * META['c0'] / 2!r}::double+i*{META['c0'] / META['rsf'] / 2!r}::double sr from range({META['nrg']}) t(i))"
    f", g as (select i, sqrt(sr*sr-{META['h0'] - META['terrain']}::double*{META['h0'] - META['terrain']}::double) gr, sin(acos({META['h0'] - META['terrain']}::double/sr)) sn from r)"
    f", e as (select min(gr) lo, max(gr) hi, {META['ps_rg']}::double/max(sn) step from g)"
    ", o as (select j, lo+j*step pos from e, range(1000) t(j) where j < floor((hi-lo)/step))"
    ", p as (select j, a.i k, (o.pos-a.gr)/(b.gr-a.gr) t from o join g a on a.gr <= o.pos join g b on b.i = a.i+1 and o.pos < b.gr)"
    f" select v.y, p.j x, sum(v.re*{_cc}) re, sum(v.im*{_cc}) im from p cross join (values (-1), (0), (1), (2)) q(m) join ({Q['fx2']}) v on v.x = greatest(0, least({META['nrg'] - 1}, k+m)) group by 1, 2"
)
register("g8_slant2ground", lambda s, d: ge.slant2ground(fx.fx2(s, d), META, 0.0), sel(_g8, re="re", im="im"))


def _shifted(r: Raster, dy: int, dx: int) -> Raster:
    """The image moved by whole pixels, 0 where nothing moves in."""
    d = r.df.withColumns({"y": F.col("y") + dy, "x": F.col("x") + dx}).where(F.col("y").between(0, r.ny - 1) & F.col("x").between(0, r.nx - 1))
    grid = generate(r.df.sparkSession, r.ny, r.nx, lambda y, x: F.lit(0.0)).df.select("y", "x")
    return r.with_df(grid.join(d, ["y", "x"], "left").select("y", "x", F.coalesce("re", F.lit(0.0)).alias("re")))


def _scene(s: SparkSession) -> Raster:
    """Blocks of 5 x 5 pixels of a fixed pseudo-random height, 192 x 192."""
    return generate(s, 192, 192, lambda y, x: (F.floor(y / 5) * 7919 + F.floor(x / 5) * 104729 + F.floor(y / 5) * F.floor(x / 5) * 31) % 97 + 10)


_sc = f"select y, x, ((y//5)*7919+(x//5)*104729+(y//5)*(x//5)*31)%97+10 re from ({pixels(192, 192)})"
# A scene moved by (6, -4) comes back; its rim moved out and is 0.
register("g9_coregister", lambda s, d: (lambda r: r.with_df(r.df.withColumn("re", F.round("re", 1))))(ge.coregister(_scene(s), _shifted(_scene(s), 6, -4))), sel(f"select y, x, case when y < 186 and x >= 4 then re else 0 end re from ({_sc})", 1, re="re"), 1)


def _counts(s: SparkSession, d: str, n: int = 192) -> Raster:
    """Counts of line items by order and part, an image without any smoothness."""
    li = s.read.parquet(f"{d}/lineitem.parquet")
    c = li.groupBy((F.col("l_orderkey") % n).alias("y"), (F.col("l_partkey") % n).alias("x")).agg(F.count(F.lit(1)).cast("double").alias("re"))
    grid = s.range(n * n).select(F.floor(F.col("id") / n).alias("y"), (F.col("id") % n).alias("x"))
    return Raster(grid.join(c, ["y", "x"], "left").select("y", "x", F.coalesce("re", F.lit(0.0)).alias("re")), n, n)


_ct = f"select p.y, p.x, coalesce(n, 0)::double re from ({pixels(192, 192)}) p left join (select l_orderkey%192 y, l_partkey%192 x, count(*) n from lineitem group by 1, 2) using (y, x)"
# Two images of a table, one of them moved by (-5, 7).
register("g9_coregister_table", lambda s, d: (lambda r: r.with_df(r.df.withColumn("re", F.round("re", 1))))(ge.coregister(_counts(s, d), _shifted(_counts(s, d), -5, 7))), sel(f"select y, x, case when y >= 5 and x < 185 then re else 0 end re from ({_ct})", 1, re="re"), 1)
register("p22_combinations", lambda s, d: pt.combinations(s, {"a": [1, 2, 3], "b": [10, 20], "x": [0, 5, 7, 9]}), "select ((a-1)*2+b/10-1)::bigint*4+p-1 i, a::int a, b::int b, x::int x from (values (1), (2), (3)) u(a) cross join (values (10), (20)) v(b) cross join (values (1, 0), (2, 5), (3, 7), (4, 9)) w(p, x)")
register("p22_linspace", lambda s, d: pt.linspace_nd(s, {"y": (0.0, 1.0, 5), "x": (-2.0, 2.0, 9)}), "select (a*9+b)::bigint i, a*0.25::double y, -2+b*0.5::double x from range(5) u(a) cross join range(9) v(b)")
register("a6_reduce_tiles", lambda s, d: s.createDataFrame([(k, float(v[1])) for k, v in enumerate(sorted(reduce_tiles(fx.fx5(s, d), lambda b: {"top": b.max(), "total": b.sum()}, {"top": "max", "total": "sum"}, (16, 24)).items()))], "label int, value double"), f"select 0::int as \"label\", max(re)::double \"value\" from ({Q['fx5']}) union all select 1::int, sum(re)::double from ({Q['fx5']})")
_blk = "select y//4 y, x//4 x, {} from ({}) where y//4 < (select (max(y)+1)//4 from ({})) and x//4 < (select (max(x)+1)//4 from ({})) group by 1, 2"
register("a7_presum", lambda s, d: ge.presum(fx.fx2(s, d)), sel(_blk.format("avg(re) re, avg(im) im", *[Q["fx2"]] * 3), re="re", im="im"))
register("a7_presum_phase", lambda s, d: ge.presum(fx.fx8(s, d), phase=True), sel(_blk.format("atan2(avg(sin(re)), avg(cos(re))) re", *[Q["fx8"]] * 3), re="re"))
register("a7_decimate", lambda s, d: ge.presum(fx.fx1(s, d), decimate=True), sel(f"select y//4 y, x//4 x, re from ({Q['fx1']}) where y%4=0 and x%4=0", re="re"))
register("k9_pyramid_level2", lambda s, d: ge.pyramid(fx.fx5(s, d))[2], sel(_blk.format("avg(re) re", *[Q["fx5"]] * 3), re="re"))
register("a2_regionstat", lambda s, d: (lambda t: t.select("ch", "npix", *[(F.round(c, 6) + 0.0).alias(c) for c in ("min", "max", "mean", "median", "std", "enl")]))(ge.regionstat(fx.fx5(s, d))), f"select 0::int ch, count(*) npix, " + ", ".join(f"round(({e})::double, 6)+0.0::double \"{n}\"" for n, e in (("min", "min(re)"), ("max", "max(re)"), ("mean", "avg(re)"), ("median", "median(re)"), ("std", "stddev_pop(re)"), ("enl", "pow(0.5227::double/(stddev_pop(re)/avg(re)), 2)"))) + f" from ({Q['fx5']})")
_stat = lambda t: t.select("ch", "npix", *[(F.round(c, 6) + 0.0).alias(c) for c in ("min", "max", "mean", "median", "std", "enl")])
register("a2_regionstat_channels", lambda s, d: _stat(ge.regionstat(fx.fx3(s, d).with_df(fx.fx3(s, d).df.drop("im"), complex=False))), "select ch, count(*) npix, " + ", ".join(f"round(({e})::double, 6)+0.0::double \"{n}\"" for n, e in (("min", "min(re)"), ("max", "max(re)"), ("mean", "avg(re)"), ("median", "median(re)"), ("std", "stddev_pop(re)"), ("enl", "pow(0.5227::double/(stddev_pop(re)/avg(re)), 2)"))) + f" from ({Q['fx3']}) group by ch")
register("a1_flattenamp", lambda s, d: ge.flattenamp(fx.fx5(s, d)), sel(f"with p as (select x, avg(re) v from ({Q['fx5']}) group by x), f as (select regr_slope(v, x) k, regr_intercept(v, x) b, avg(v) m from p) select y, x, re/((k*x+b)/m) re from ({Q['fx5']}) cross join f", re="re"))
register("a8_histogram", lambda s, d: (lambda t: t.select("bin", (F.round("start", 6) + 0.0).alias("start"), "count"))(ge.histogram(fx.fx5(s, d), 20)), f"with v as (select sqrt(re) v from ({Q['fx5']})), q as (select quantile_cont(v, 0.01) a, quantile_cont(v, 0.99) b from v) select least(19, floor((v-a)/((b-a)/20)))::int bin, round(any_value(a)+least(19, floor((v-a)/((b-a)/20)))::int*any_value((b-a)/20), 6)+0.0::double \"start\", count(*) \"count\" from v cross join q where v between a and b group by least(19, floor((v-a)/((b-a)/20)))::int")
register("sarcat_mosaic", lambda s, d: ge.mosaic([fx.fx5(s, d), pt.negate(fx.fx5(s, d))], 2), sel(f"select y, x, re from ({Q['fx5']}) union all select y, x+64, -re from ({Q['fx5']})", re="re"))
register("sarjoin_stack", lambda s, d: ge.stack([fx.fx5(s, d), pt.int2amp(fx.fx5(s, d))]), sel(f"select 0::int ch, y, x, re from ({Q['fx5']}) union all select 1::int, y, x, sqrt(re) from ({Q['fx5']})", keys="ch, y::bigint y, x::bigint x", re="re"))

# --- moving windows ------------------------------------------------------------------------------------

register("w1_boxcar", lambda s, d: fl.boxcar(fx.fx1(s, d)), sel(means(means(Q["fx1"], (1, 7), "re"), (7, 1), "re"), re="re"))
register("w1_boxcar_complex", lambda s, d: fl.boxcar(fx.fx2(s, d), (5, 4)), sel(means(Q["fx2"], (5, 4), "re im"), re="re", im="im"))
_cs = f"select y, x, cos(re) c, sin(re) s from ({Q['fx8']})"
register("w2_phase_boxcar", lambda s, d: fl.phase_boxcar(fx.fx8(s, d)), sel(means(_cs, (7, 7), "c s"), re="atan2(s, c)"))


def _gauss_sql(src: str, sigma: float) -> str:
    n, w = 2 * int(4 * sigma + 0.5) + 1, f"exp(-0.5::double*(dy*dy+dx*dx)/{sigma * sigma}::double)"
    return near(src, n, n, {"re": f"sum(b.re*{w})/sum({w})"})


register("w3_gauss", lambda s, d: fl.gauss(fx.fx5(s, d), (1.0, 1.0)), sel(_gauss_sql(Q["fx5"], 1.0), re="re"))
register("w4_median", lambda s, d: fl.median(fx.fx1(s, d), (3, 3)), sel(near(Q["fx1"], 3, 3, {"re": "median(b.re)"}), re="re"))
_k3 = [[1.0, 2.0, 0.0], [0.0, -1.0, 3.0], [2.0, 0.5, 1.0]]
_kw = "[" + ", ".join(str(v) + "::double" for row in [r[::-1] for r in _k3[::-1]] for v in row) + "]"
register("w5_kernelfilter", lambda s, d: fl.kernelfilter(fx.fx5(s, d), _k3), sel(near(Q["fx5"], 3, 3, {"re": f"sum(b.re*{_kw}[(dy+1)*3+dx+2])"}), re="re"))


def _plr_sql(classes: int = 10, rounds: int = 5, compatibility: float = 3.0) -> str:
    """Rounds of relaxation over rows (y, x, k, p)."""
    out = [f"s as ({Q['fx6']})", "n as (select max(y)+1 ny, max(x)+1 nx from s)", f"p0 as materialized (select y, x, k, case when re = k then 0.9::double else 0.1::double end p from s cross join range({classes}) t(k))"]
    at = lambda t, n: f"(case when {t} < 0 then -1-({t}) when {t} >= {n} then 2*{n}-1-({t}) else {t} end)"
    for i in range(rounds):
        mean = f"select a.y, a.x, a.k, any_value(a.p) p, avg(b.p) m from p{i} a cross join n cross join range(-1, 2) ry(dy) cross join range(-1, 2) rx(dx) join p{i} b on b.k = a.k and b.y = {at('(a.y+dy)', 'ny')} and b.x = {at('(a.x+dx)', 'nx')} group by 1, 2, 3"
        out.append(f"q{i} as (select y, x, k, p*(sum(m) over (partition by y, x)+{compatibility - 1}::double*m) p from ({mean}))")
        out.append(f"p{i + 1} as materialized (select y, x, k, p/sum(p) over (partition by y, x) p from q{i})")
    return f"with {', '.join(out)} select y, x, arg_max(k, (p, -k))::double re from p{rounds} group by 1, 2"


register("w6_plr", lambda s, d: ds.plr(fx.fx6(s, d), 10), sel(_plr_sql(), re="re"))
_sx, _sy = "[1,2,1]", "[-1,0,1]"
register("w7_sobel", lambda s, d: fl.sobel(fx.fx1(s, d)), sel(near(f"select y, x, abs(re) re from ({Q['fx1']})", 3, 3, {"p": f"sum(b.re*{_sy}[dy+2]*{_sx}[dx+2])", "q": f"sum(b.re*{_sx}[dy+2]*{_sy}[dx+2])"}), re="sqrt(p*p+q*q)"))
_rb = near(f"select y, x, abs(re) re from ({Q['fx1']})", 3, 3, {"o": "sum(case when dy=0 and dx=0 then b.re end)", "a": "sum(case when dy=-1 and dx=-1 then b.re end)", "b": "sum(case when dy=-1 and dx=0 then b.re end)", "c": "sum(case when dy=0 and dx=-1 then b.re end)"})
register("w8_roberts", lambda s, d: fl.roberts(fx.fx1(s, d)), sel(_rb, re="sqrt((o-a)*(o-a)+(c-b)*(c-b))/sqrt(2.0::double)"))
_sm = means(f"select y, x, abs(re) re from ({Q['fx1']})", (3, 3), "re")
_pick = {f"s{a}{b}": f"sum(case when dy={-2 * i} and dx={-2 * j} then b.re end)" for a, i in (("p", 1), ("z", 0), ("m", -1)) for b, j in (("p", 1), ("z", 0), ("m", -1))}
_shift = near(_sm, 5, 5, _pick, wrap=True)
_rat = [("szp+spp+smp", "szm+spm+smm"), ("spp+spz+szp", "smm+smz+szm"), ("spz+spp+spm", "smz+smm+smp"), ("smp+szp+smz", "spm+spz+szm")]
register("w9_roa", lambda s, d: fl.roa(fx.fx1(s, d)), sel(_shift, re="sqrt(" + "+".join(f"pow(greatest(({p})/({q}),({q})/({p})),2)" for p, q in _rat) + ")"))
register("w10_leeroa", lambda s, d: fl.leeroa(fx.fx1(s, d)), sel(_shift, re="greatest(" + ", ".join(f"abs({k}/szz-1)" for k in _pick if k != "szz") + ")"))
register("w11_canny", lambda s, d: ds.canny(fx.fx5(s, d)), None)
_mm = f"select y, x, re, re m, re*re m2 from ({AMP2M})"
register("w12_covar", lambda s, d: fl.covar(fx.fx2m_abs(s, d)), sel(means(f"select y, x, re, re*re m2 from ({AMP2M})", (7, 7), "re m2"), re="(m2-re*re)/(re*re)"))
_kf = lambda looks: f"(greatest((greatest(m2-m*m,1e-10::double)-m*m/{looks}.0::double)/(1+1/{looks}.0::double),0)/greatest(m2-m*m,1e-10::double))"
register("w13_inhomogeneity", lambda s, d: fl.inhomogeneity(fx.fx2m_abs(s, d), looks=4, damp=True), sel(means(_mm, (7, 7), "m m2", "re"), re=f"{_kf(4)}*greatest((re-m)/(re+m),0)"))
_byte = f"select y, x, floor(least(255, greatest(0, re*255.0::double/(2.5::double*m)))) re from {_all.format(Q['fx5'])}"
_ent = f"with s as ({_byte}), c as (select a.y, a.x, b.re v, count(*) n from s a join s b on b.y between a.y-2 and a.y+2 and b.x between a.x-2 and a.x+2 group by 1,2,3), t as (select y, x, sum(n) n from c group by 1,2) select c.y, c.x, sum(-(c.n/t.n::double)*log2(c.n/t.n::double)) re from c join t using (y, x) group by 1,2"
register("w14_entropy", lambda s, d: fl.entropy(fx.fx5(s, d), (5, 5)), sel(_ent, re="re"))


def _glcm_sql(win: int, f: str) -> str:
    h = win // 2
    lv = f"select y, x, floor(re/16) re from ({_byte})"
    parts = []
    for dy, dx in ((0, 1), (-1, 1), (-1, 0), (-1, -1)):
        parts.append(f"select c.y, c.x, avg({f.format('(b.re-a.re)')}) v from s c join s a on a.y between c.y-{h} and c.y+{h} and a.x between c.x-{h} and c.x+{h} join s b on b.y=a.y+({dy}) and b.x=a.x+({dx}) and b.y between c.y-{h} and c.y+{h} and b.x between c.x-{h} and c.x+{h} group by 1,2")
    inner = f"y between {h} and 63-{h} and x between {h} and 63-{h}"
    return f"with s as ({lv}), g as ({' union all '.join(parts)}), m as (select y, x, avg(v) v from g group by 1,2) select s.y, s.x, case when s.{inner.replace(' and x', ' and s.x')} then v else re end re from s join m using (y, x)"


register("w15_glcm_contrast", lambda s, d: fl.glcm(fx.fx5(s, d), 5), sel(_glcm_sql(5, "{0}*{0}"), re="re"))
register("w15_glcm_dissimilarity", lambda s, d: fl.glcm(fx.fx5(s, d), 5, prop="dissimilarity"), sel(_glcm_sql(5, "abs({0})"), re="re"))
register("w15_glcm_homogeneity", lambda s, d: fl.glcm(fx.fx5(s, d), 5, prop="homogeneity"), sel(_glcm_sql(5, "1.0::double/(1+{0}*{0})"), 10, re="re"), 10)


def _glcm_pairs_sql(win: int, value: str) -> str:
    """A value of the symmetric pair counts m (sum 1) of each window and angle, averaged over angles."""
    h, lv = win // 2, f"select y, x, floor(re/16) re from ({_byte})"
    parts = []
    for k, (dy, dx) in enumerate(((0, 1), (-1, 1), (-1, 0), (-1, -1))):
        parts.append(f"select {k} g, c.y, c.x, a.re i, b.re j from s c join s a on a.y between c.y-{h} and c.y+{h} and a.x between c.x-{h} and c.x+{h} join s b on b.y=a.y+({dy}) and b.x=a.x+({dx}) and b.y between c.y-{h} and c.y+{h} and b.x between c.x-{h} and c.x+{h}")
    return (
        f"with s as ({lv}), p as ({' union all '.join(parts)}), q as (select * from p union all select g, y, x, j, i from p)"
        ", c as (select g, y, x, i, j, count(*) n from q group by all), m as (select *, n/sum(n) over (partition by g, y, x)::double m from c)"
        f", v as (select g, y, x, {value} v from m group by 1, 2, 3), w as (select y, x, avg(v) v from v group by 1, 2)"
        f" select s.y, s.x, case when s.y between {h} and 63-{h} and s.x between {h} and 63-{h} then v else re end re from s join w using (y, x)"
    )


register("w15_glcm_energy", lambda s, d: fl.glcm(fx.fx5(s, d), 5, prop="energy"), sel(_glcm_pairs_sql(5, "sqrt(sum(m*m))"), 10, re="re"), 10)
register("w15_glcm_asm", lambda s, d: fl.glcm(fx.fx5(s, d), 5, prop="ASM"), sel(_glcm_pairs_sql(5, "sum(m*m)"), 12, re="re"), 12)
_dev = "(sum(m*i*i)-sum(m*i)*sum(m*i))"
register("w15_glcm_correlation", lambda s, d: fl.glcm(fx.fx5(s, d), 5, prop="correlation"), sel(_glcm_pairs_sql(5, f"case when {_dev} < 1e-12 then 1 else (sum(m*i*j)-sum(m*i)*sum(m*j))/{_dev} end"), 5, re="re"), 5)
_lee = means(f"select y, x, re v, re u, re*re m, re*re*re*re m2 from ({AMP2M})", (7, 7), "u m m2", "v")
register("w16_lee", lambda s, d: fl.lee(fx.fx2m(s, d), looks=4), sel(_lee, re=f"u+(v-u)*{_kf(4)}"))
_vch = f"select y, x, sqrt(a0*a0+b0*b0) c0, sqrt(a1*a1+b1*b1) c1, sqrt(a2*a2+b2*b2) c2, sqrt(a3*a3+b3*b3) c3 from ({VEC})"
_vch = f"select *, c0 u0, c1 u1, c2 u2, c3 u3, c0*c0+c1*c1+c2*c2+c3*c3 m, pow(c0*c0+c1*c1+c2*c2+c3*c3, 2) m2 from ({_vch})"
register("w16_lee_vector", lambda s, d: fl.lee(fx.fx3_pix(s, d), (5, 3), 4), unpivot(means(_vch, (5, 3), "u0 u1 u2 u3 m m2", "c0 c1 c2 c3"), [(f"u{k}+(c{k}-u{k})*{_kf(4)}", "0") for k in range(4)], real=True))
register("w17_kuan", lambda s, d: fl.kuan(fx.fx2m(s, d), looks=4), sel(f"select *, greatest(1-0.25::double*m*m/greatest(m2-m*m,1e-10::double),0)/1.25::double w from {_lee}", re="v*w+u*(1-w)"))


def _refined_sql(method: str, looks: int = 4, threshold: float = 0.5) -> str:
    """Moments in eight half windows and a diamond; the direction by means two pixels away or by least variation."""
    away = ((0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1))
    part = [f"{dy}*dy+{dx}*dx <= 0" for dy, dx in away] + ["abs(dy)+abs(dx) <= 3"]
    src = f"select y, x, re v, re u, re*re p, re*re*re*re q from ({AMP2M})"
    cols = {f"{n}{k}": f"avg(b.{c}) filter (where {w})" for k, w in enumerate(part) for n, c in (("u", "u"), ("m", "p"), ("s", "q"))}
    if method == "cov":
        scores, best = [f"-abs((s{k}-m{k}*m{k})/(m{k}*m{k}))" for k in range(8)], ""
        q = f"select * from {near(src, 7, 7, cols, 'v')}"
    else:
        samp = means(src, (3, 3), "p")
        picked = near(samp, 5, 5, {"o": "sum(b.p) filter (where dy=0 and dx=0)"} | {f"g{k}": f"sum(b.p) filter (where dy={2 * dy} and dx={2 * dx})" for k, (dy, dx) in enumerate(away)})
        q = f"select * from {near(src, 7, 7, cols, 'v')} join {picked} using (y, x)"
        scores, best = [f"abs(g{k}/o-1)" for k in range(8)], f"when greatest({', '.join(f'abs(g{k}/o-1)' for k in range(8))}) < {threshold} then 8 "
    top = f"greatest({', '.join(scores)})"
    pick = "case " + best + " ".join(f"when {e} = {top} then {k}" for k, e in enumerate(scores)) + " end"
    value = lambda k: f"u{k}+(v-u{k})*greatest((greatest(s{k}-m{k}*m{k},1e-10::double)-m{k}*m{k}/{looks}.0::double)/(1+1/{looks}.0::double),0)/greatest(s{k}-m{k}*m{k},1e-10::double)"
    return sel(f"select *, {pick} k from ({q})", re="case k " + " ".join(f"when {k} then {value(k)}" for k in range(9)) + " end")


register("w18_refinedlee", lambda s, d: ds.refinedlee(fx.fx2m_abs(s, d), looks=4), _refined_sql("original"))
register("w18_refinedlee_cov", lambda s, d: ds.refinedlee(fx.fx2m_abs(s, d), looks=4, method="cov"), _refined_sql("cov"))
_pw = f"select y, x, re*re re from ({AMP2M})"
_lst = f"with s as ({_pw}), n as (select max(y)+1 ny, max(x)+1 nx from s)"
_d2 = "1.0::double"
_ls = f"{_lst} select a.y, a.x, any_value(a.re) v, count(*) filter (where b.re > a.re*0.0::double and b.re < a.re*2.0::double) n, sum(b.re) filter (where b.re > a.re*0.0::double and b.re < a.re*2.0::double) t, sum(b.re) filter (where abs(b.y-a.y)+abs(b.x-a.x)=1)/4 f from s a cross join n join s b on b.y between a.y-3 and a.y+3 and b.x between a.x-3 and a.x+3 group by 1,2"
register("w1_boxcar_blocks", lambda s, d: bl.box_mean(bl.blocked(fx.fx1(s, d), (64, 32))).pixels(), ORACLE_SQL["w1_boxcar"])
register("w4_median_blocks", lambda s, d: bl.median(bl.blocked(fx.fx1(s, d), (64, 32)), (3, 3)).pixels(), ORACLE_SQL["w4_median"])
register("w16_lee_blocks", lambda s, d: bl.lee(bl.blocked(fx.fx2m(s, d), (64, 32)), looks=4).pixels(), ORACLE_SQL["w16_lee"])
register("w19_leesigma", lambda s, d: ds.leesigma(fx.fx2m_abs(s, d), looks=4), sel(f"with n as (select max(y) my, max(x) mx from ({_pw})) select y, x, case when y<3 or x<3 or y>my-3 or x>mx-3 then sqrt(v) when n>=6 then sqrt(t/n) else sqrt(f) end re from ({_ls}) cross join n", re="re"))


def _sigma2_sql(looks: int = 2) -> str:
    """The improved sigma filter; the bounds of the speckle density come as numbers."""
    lo, hi, dev = ds.sigma_bounds(looks, 0.9)
    src = f"select *, (re > t)::int bright from ({_pw}) cross join (select quantile_cont(re, 0.98) t from ({_pw}))"
    q = near(src, 3, 3, {"n": "sum(b.bright)", "m": "avg(b.re)", "m2": "avg(b.re*b.re)"}, "re bright")
    q = near(f"select *, (n >= 6)::int many from {q}", 3, 3, {"target": "max(b.many)"}, "re bright m m2")
    gain = lambda s, m, d: f"greatest(({s}-{m}*{m}*{d})/(1+{d}), 0)/{s}"
    s0 = "greatest(m2-m*m, 1e-10::double)"
    q = f"select y, x, re, bright*target target, m+(re-m)*{gain(s0, 'm', f'{1 / looks}::double')} seed from {q}"
    ok = f"where b.re > a.seed*{float(lo)!r}::double and b.re < a.seed*{float(hi)!r}::double"
    q = near(q, 9, 9, {"n": f"count(*) filter ({ok})", "m": f"avg(b.re) filter ({ok})", "m2": f"avg(b.re*b.re) filter ({ok})"}, "re target")
    return sel(q, re=f"sqrt(greatest(0, case when target = 1 then re when n = 0 then 0 else m+(re-m)*{gain(s0, 'm', f'{float(dev)!r}::double')} end))")


register("w20_leesigma2", lambda s, d: ds.leesigma2(fx.fx2m_abs(s, d), looks=2), _sigma2_sql())
register("w21_idan", lambda s, d: ds.idan(fx.fx2m_abs(s, d), 2.0), None)
register("w21_idan_matrix", lambda s, d: ds.idan(cov3(s, d), 4.0, 20), None)
register("w22_idanq", lambda s, d: ds.idanq(fx.fx2m_abs(s, d), 2.0), None)
register("w22_idanq_matrix", lambda s, d: ds.idanq(cov3(s, d), 4.0, 20), None)
_bl = f"with s as ({_pw}) select a.y, a.x, sum(b.re*exp(-(pow(b.y-a.y,2)+pow(b.x-a.x,2))/(25/4.6051::double)/2)*exp(-pow(a.re-b.re,2)*2/2))/sum(exp(-(pow(b.y-a.y,2)+pow(b.x-a.x,2))/(25/4.6051::double)/2)*exp(-pow(a.re-b.re,2)*2/2)) re from s a join s b on b.y between a.y-2 and a.y+2 and b.x between a.x-2 and a.x+2 group by 1,2"
register("w23_bilateral", lambda s, d: ds.bilateral(fx.fx2m_abs(s, d), 5, 2.0), sel(f"with n as (select max(y) my, max(x) mx from ({_pw})) select y, x, case when y<2 or x<2 or y>my-2 or x>mx-2 then 0 else sqrt(re) end re from ({_bl}) cross join n", re="re"))
register("w24_bilateral_matrix", lambda s, d: ds.bilateral_matrix(cov3(s, d), 1.5), None)


def _srad_sql(rounds: int, looks: float = 2.0, step: float = 0.15) -> str:
    import math

    src, ratio = f"select y, x, re from ({_pw})", lambda a, b: f"coalesce(({a})/nullif({b}, 0), 0)"
    for k in range(rounds):
        q0 = (math.exp(-step * k / 6) / math.sqrt(looks)) ** 2
        pick = {n: f"sum(b.re) filter (where dy={dy} and dx={dx})-any_value(a.re)" for n, dy, dx in (("n", -1, 0), ("s", 1, 0), ("w", 0, -1), ("e", 0, 1))}
        q = f"select *, {ratio('n*n+s*s+w*w+e*e', 're*re')} g, {ratio('n+s+w+e', 're')} l from {near(src, 3, 3, pick, 're')}"
        q = f"select *, {ratio('0.5::double*g-l*l/16', 'pow(1+0.25::double*l, 2)')} q from ({q})"
        q = f"select *, least(1, greatest(0, 1/(1+(q-{q0!r}::double)/{q0 * (1 + q0)!r}::double))) c from ({q})"
        q = near(q, 3, 3, {"cs": "sum(b.c) filter (where dy=1 and dx=0)", "ce": "sum(b.c) filter (where dy=0 and dx=1)"}, "re n s w e c")
        src = f"select y, x, re+{step / 4!r}::double*(cs*s+c*n+ce*e+c*w) re from {q}"
    return src


register("w25_srad_steps", lambda s, d: fl.srad(pt.amp2int(fx.fx2m_abs(s, d)), iterations=2, every=1), sel(_srad_sql(2), re="re"))
register("w25_srad", lambda s, d: fl.srad(pt.amp2int(fx.fx2m_abs(s, d))), None)
_em = f"with s as ({_pw}) select a.y, a.x, any_value(a.re) v, sum(b.re*4*a.re/pow(b.re,2)*exp(-2*a.re/b.re))/sum(4*a.re/pow(b.re,2)*exp(-2*a.re/b.re)) re from s a join s b on b.y between a.y-2 and a.y+2 and b.x between a.x-2 and a.x+2 group by 1,2"
register("w26_emdes", lambda s, d: ds.emdes(fx.fx2m_abs(s, d), (5, 5)), sel(f"with n as (select max(y) my, max(x) mx from ({_pw})) select y, x, case when y<2 or x<2 or y>my-2 or x>mx-2 then sqrt(v) else sqrt(re) end re from ({_em}) cross join n", re="re"))
_beta_sql = f"""with p as (select y*8+x i, r0, r4, r8 from ({COV3})), n as (select count(*) n from p)
select round(median(d), 6) beta, count(*) pairs from (
  select sqrt(pow(ln(a.r0)-ln(b.r0), 2) + pow(ln(a.r4)-ln(b.r4), 2) + pow(ln(a.r8)-ln(b.r8), 2)) d
  from p a cross join n join p b on b.i = (a.i + n//2) % n) where isfinite(d)"""
register("a9_beta", lambda s, d: be.beta_statistic(cov3(s, d), "dg").select(F.round("beta", 6).alias("beta"), "pairs"), _beta_sql)
_scattered = f"""with p as (select y*8+x i, r0, r4, r8 from ({COV3})), n as (select count(*) n from p)
, m as (select n, (select min(k) from range(100) t(j), unnest([floor(n*(sqrt(5.0::double)-1)/2)::bigint+j]) u(k) where gcd(k, n) = 1) m from n)
select round(median(d), 6) beta, count(*) pairs from (
  select sqrt(pow(ln(a.r0)-ln(b.r0), 2) + pow(ln(a.r4)-ln(b.r4), 2) + pow(ln(a.r8)-ln(b.r8), 2)) d
  from p a cross join m join p b on b.i = (m*a.i + n//2) % n) where isfinite(d)"""
register("a9_beta_scattered_diagonal", lambda s, d: (lambda c: be.beta_statistic(c, "dg", be.scattered_multiplier(c.ny * c.nx)))(cov3(s, d)).select(F.round("beta", 6).alias("beta"), "pairs"), _scattered)
register("a9_beta_scattered", lambda s, d: (lambda c: be.beta_statistic(c, "ai", be.scattered_multiplier(c.ny * c.nx)))(cov3(s, d)).select(F.round("beta", 6).alias("beta"), "pairs"), None)
register("a9_enl", lambda s, d: be.equivalent_looks(cov3(s, d)).select(F.round("enl", 6).alias("enl")), f"select round(avg(e), 6) enl from (select unnest([{', '.join(f'pow(avg(r{k}), 2)/var_pop(r{k})' for k in (0, 4, 8))}]) e from ({COV3}))")
register("w27_mcb", lambda s, d: be.mcb(cov3(s, d), 4)[0], None)
register("w27_mcb_vector", lambda s, d: be.mcb(fx.fx3_pix(s, d, 3))[0], None)
register("w28_nlsar", lambda s, d: nl.nlsar(cov3(s, d), 4.0, search=4, patch=3)[0], None)
register("w28_nlsar_looks", lambda s, d: nl.nlsar(cov3(s, d), 4.0, search=4, patch=3)[1], None)
register("w28_nlmeans", lambda s, d: ds.nlmeans(fx.fx2m_abs(s, d))[0], None)
register("w29_boxcar_periodic", lambda s, d: ds.carfilter(fx.fx5(s, d), 2, "box"), sel(near(Q["fx5"], 5, 5, {"re": "avg(b.re)"}, wrap=True), re="re"))
register("w29_diskcar_periodic", lambda s, d: ds.carfilter(fx.fx5(s, d), 2, "disk"), sel(near(Q["fx5"], 5, 5, {"re": "avg(b.re) filter (where dy*dy+dx*dx <= 6.25)"}, wrap=True), re="re"))
register("w29_gausscar_periodic", lambda s, d: ds.carfilter(fx.fx5(s, d), 1.0, "gauss"), sel(near(Q["fx5"], 11, 11, {"re": "sum(b.re*exp(-pi()*(dy*dy+dx*dx)/2.25::double))/sum(exp(-pi()*(dy*dy+dx*dx)/2.25::double))"}, wrap=True), re="re"))
register("w32_smooth", lambda s, d: fl.smooth(fx.fx7(s, d), (3, 3)), sel(means(Q["fx7"], (3, 3), "re"), re="re"))

# --- interferometry ------------------------------------------------------------------------------------

_mix = f"select y, x, m_re, m_im, 0.7::double*m_re+0.3::double*s_re s_re, 0.7::double*m_im+0.3::double*s_im s_im from ({Q['fx4']})"
_prod = f"select y, x, m_re*m_re+m_im*m_im p, s_re*s_re+s_im*s_im q, m_re*s_re+m_im*s_im r, m_im*s_re-m_re*s_im i from ({_mix})"
_coh = means(_prod, (7, 7), "p q r i")
register("c1_coherence", lambda s, d: ia.coherence(*fx.fx4(s, d, 0.7)), sel(_coh, re="least(1, sqrt(r*r+i*i)/sqrt(p*q))"))
register("c2_coherencemat", lambda s, d: ia.coherencemat(list(fx.fx4(s, d, 0.7))), unpivot(_coh, [("1", "0"), ("least(1, sqrt(r*r+i*i)/sqrt(p*q))", "0"), ("least(1, sqrt(r*r+i*i)/sqrt(p*q))", "0"), ("1", "0")], real=True))
register("c3_coherencecov", lambda s, d: ia.coherencecov(po.vec2mat(fx.fx3_pix(s, d))), sel(means(f"select y, x, a1*a0+b1*b0 r, b1*a0-a1*b0 i, a0*a0+b0*b0 p, a1*a1+b1*b1 q from ({VEC})", (3, 3), "r i p q"), re="least(1, sqrt(r*r+i*i)/sqrt(p*q))"))
register("c4_interfmat", lambda s, d: ia.interfmat(list(fx.fx4(s, d, 0.7))), unpivot(_coh, [("1", "0"), ("r/sqrt(p*q)", "i/sqrt(p*q)"), ("r/sqrt(p*q)", "-i/sqrt(p*q)"), ("1", "0")]))
for _n, _f in {"c5_goldstein": lambda p: ia.goldstein(p, bs=16), "c6_goldstein_iter": lambda p: ia.goldstein_iter(p, bsx=16, bsy=16), "c7_goldstein_lfe": lambda p: ia.goldstein_lfe(p, bs=16), "c8_lffe_boxcar": lambda p: ia.lffe_boxcar(p, bs=16), "c9_lffe_gauss": lambda p: ia.lffe_gauss(p, bs=16), "c10_baran": lambda p: ia.baran(p, bs=16)}.items():
    register(_n, lambda s, d, f=_f: f(fx.fx8(s, d)))
register("c11_qef", lambda s, d: ia.qef(fx.fx8(s, d)), None)
register("c12_overlap_add", lambda s, d: ia.overlap_add([fx.fx1(s, d)], (16, 16), (8, 8), lambda b: b[0].real, out_complex=False), sel(Q["fx1"], re="re"))

# --- spectra -------------------------------------------------------------------------------------------


def _dft_sql() -> str:
    """Centred transform of 32-pixel rows by its definition."""
    ang = "2*pi()*(k*a.x)/32.0::double"
    return f"select a.y, (k+16)%32 x, sum(a.re*cos({ang})+a.im*sin({ang})) re, sum(a.im*cos({ang})-a.re*sin({ang})) im from ({Q['fx2']}) a cross join range(32) f(k) group by a.y, k"


register("f1_fft_range", lambda s, d: sp.fft(fx.fx2(s, d), "range"), sel(_dft_sql(), re="re", im="im"))


def _dft_y_sql(src: str) -> str:
    """Centred transform of the columns of any length."""
    return (
        f"with v as materialized ({src}), n as (select max(y)+1 n from v), a as (select 2*pi()*(k*y%n)/n t, k, x, re, im, n from v cross join n cross join range(100000) f(k) where k < n)"
        " select (k+n//2)%n y, x, sum(re*cos(t)+im*sin(t)) re, sum(im*cos(t)-re*sin(t)) im from a group by k, n, x"
    )


register("f1_fft_azimuth", lambda s, d: sp.fft(fx.fx2(s, d), "azimuth"), sel(_dft_y_sql(Q["fx2"]), re="re", im="im"))
register("f1_fft_2d", lambda s, d: sp.fft(fx.fx2(s, d)), sel(_dft_y_sql(_dft_sql()), 5, re="re", im="im"), 5)


def _weight_sql(alpha: float, fix: bool, cutoff: float) -> str:
    """Range spectra by their definition, the band around the peak of their mean, the window at both distances from it."""
    t = "2*pi()*(k*x%32)/32.0::double"
    win = lambda j: f"({alpha}::double-{1 - alpha}::double*cos(2*pi()*({j}-down)/greatest(1, up-down-1)))"
    return (
        f"with f as materialized (select y, k, sum(re*cos({t})+im*sin({t})) re, sum(im*cos({t})-re*sin({t})) im from ({Q['fx2']}) cross join range(32) r(k) group by 1, 2)"
        ", s as (select k, avg(sqrt(re*re+im*im)) v from f group by 1), p as (select arg_max(k, v) peak, max(v) top from s)"
        f", d as (select k, (k-peak+32)%32 a, v, v <= {cutoff}::double*top low from s cross join p)"
        ", b as (select coalesce(min(a) filter (where low), 32) up, coalesce(max(a-32) filter (where low and a > 0), -32) down from d)"
        f", c as (select k, (case when a < up-1 or a-32 > down then {'1/v' if fix else '1.0::double'} else 0 end)*(case when a < up then {win('a')} else 1 end)*(case when a-32 >= down then {win('(a-32)')} else 1 end) w from d cross join b)"
        ", m as (select k, w/(avg(w) over ()) w from c)"
        f" select y, x, sum(w*(re*cos({t})-im*sin({t})))/32 re, sum(w*(im*cos({t})+re*sin({t})))/32 im from f join m using (k) cross join range(32) r(x) group by 1, 2"
    )


register("f2_weight", lambda s, d: sp.weight(fx.fx2(s, d)), None)
register("f2_weight_range", lambda s, d: sp.weight(fx.fx2(s, d), axis="range"), sel(_weight_sql(0.54, False, 0.05), re="re", im="im"))
register("f2_weight_band", lambda s, d: sp.weight(fx.fx2(s, d), axis="range", fix=True, cutoff=0.97), sel(_weight_sql(0.54, True, 0.97), re="re", im="im"))
register("f3_unweight", lambda s, d: sp.unweight(fx.fx2(s, d)), None)
register("f3_unweight_range", lambda s, d: sp.unweight(fx.fx2(s, d), "range"), sel(_weight_sql(1.0, True, 0.05), re="re", im="im"))
register("f6_unweight2d", lambda s, d: sp.unweight2d(fx.fx2(s, d), (2, 2), (60.0, 75.0)), None)
register("f4_cda", lambda s, d: sp.cda(fx.fx2(s, d)), None)


def _sva_sql() -> str:
    def one(src: str, axis: str, other: str) -> str:
        w = f"over (partition by {other} order by {axis})"
        parts = []
        for c in ("re", "im"):
            near_ = f"(lag({c},2) {w}+lead({c},2) {w})"
            parts.append(f"{c} v_{c}, {near_} n_{c}")
        e = lambda c: f"case when n_{c} is null then 0 when n_{c}=0 then v_{c} when -v_{c}/n_{c}<=0 then v_{c} when -v_{c}/n_{c}>=0.5::double then v_{c}+0.5::double*n_{c} else 0 end {c}"
        return f"select y, x, {e('re')}, {e('im')} from (select y, x, {', '.join(parts)} from ({src}))"

    return one(one(Q["fx2"], "x", "y"), "y", "x")


register("f5_sva", lambda s, d: sp.sva(fx.fx2(s, d)), sel(_sva_sql(), re="re", im="im"))


def _lanczos_sql(n: int = 64, step: int = 4) -> str:
    sinc = lambda t: f"(case when {t} = 0 then 1 else sin(pi()*({t}))/(pi()*({t})) end)"
    c, t = f"((i+0.5::double)*{step})", f"((k+0.5::double-(i+0.5::double)*{step})/{step})"
    w = f"select i, k, {sinc(t)}*{sinc(t + '/3')} w from range({n // step}) a(i) cross join range({n}) b(k) where k >= greatest(0, trunc({c}-{3 * step}+0.5::double)) and k < least({n}, trunc({c}+{3 * step}+0.5::double)) and abs({t}) < 3"
    w = f"select i, k, w/sum(w) over (partition by i) w from ({w})"
    return f"with w as ({w}) select p.i y, q.i x, sum(v.re*p.w*q.w) re from ({Q['fx5']}) v join w p on p.k = v.y join w q on q.k = v.x group by 1, 2"


register("f7_lanczos", lambda s, d: sp.lanczos(fx.fx5(s, d)), sel(_lanczos_sql(), re="re"))
register("f8_linear", lambda s, d: sp.resample(fx.fx5(s, d), "x", np.arange(0, 63, 0.5), lambda v, at: sp.interpol_lin1d(np.arange(len(v)), v, at)), sel(f"select a.y, 2*a.x x, a.re from ({Q['fx5']}) a where a.x < 63 union all select a.y, 2*a.x+1, (a.re+b.re)/2 from ({Q['fx5']}) a join ({Q['fx5']}) b on a.y=b.y and b.x=a.x+1", re="re"))


def _sinc_sql(t: str) -> str:
    return f"(case when abs({t})<1e-12 then 1 else sin(pi()*({t}))/(pi()*({t})) end)"


_CUBIC = "(case when abs({t})<=1 then 1.5*abs({t})**3-2.5*abs({t})**2+1 when abs({t})<2 then -0.5*abs({t})**3+2.5*abs({t})**2-4*abs({t})+2 else 0 end)"


def _taps_sql(lo: int, hi: int, weight: str, total: str = "1") -> str:
    """Lines of FX5 at every third of a pixel by the pixels lo .. hi around, the border repeated; weight of the distance t."""
    return sel(
        f"with p as ({Q['fx5']}), a as (select j, j/3.0::double at_, floor(j/3.0::double)::bigint k from range(190) r(j)), "
        f"w as (select j, k+i px, {weight.format(t='(at_-k-i)')} w from a cross join range({lo},{hi + 1}) t(i)) "
        f"select y, j x, sum(w*re)/{total} re from w join p on p.x=least(63, greatest(0, px)) group by y, j", re="re")


_thirds = np.arange(190) / 3.0
_lz = lambda n: f"(case when abs({{t}})<{n} then {_sinc_sql('{t}')}*{_sinc_sql('{t}/' + str(n))} else 0 end)"
register("f8_cubic", lambda s, d: sp.resample(fx.fx5(s, d), "x", _thirds), _taps_sql(-1, 2, _CUBIC))
register("f8_lanczos", lambda s, d: sp.resample(fx.fx5(s, d), "x", _thirds, sp.interpol_lanczos), _taps_sql(-2, 3, _lz(3), "sum(w)"))
register("f8_sinc", lambda s, d: sp.resample(fx.fx5(s, d), "x", _thirds, sp.interpol_sinc), _taps_sql(-7, 8, _lz(8)))


def _event_lines(s: SparkSession, d: str) -> DataFrame:
    """Values of events by users modulo 15 at the hours they came: lines of irregular samples."""
    ev = s.read.parquet(f"{d}/events.parquet")
    return ev.select((F.col("user_id") % 15).alias("k"), ((F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 3600000000.0).alias("x"), F.col("value").alias("v"))


def _half_hours(s: SparkSession) -> DataFrame:
    return s.range(15 * 720).select(F.floor(F.col("id") / 720).alias("k"), (F.col("id") % 720 + 0.5).alias("at"))


register("f8_cubic_irregular", lambda s, d: (lambda t: t.select("k", "at", (F.round("v", 6) + 0.0).alias("v")))(rs.cubic_irregular(_event_lines(s, d), _half_hours(s), ["k"])), """
with s as (select user_id%15 k, (epoch_us(ts)-1704067200000000)/3600000000.0::double x, avg(value)::double v from events where ts is not null and value is not null group by 1, 2)
, w as (select k, x, v b, lead(x) over o x1, lead(v) over o c, lag(v) over o p, lead(v, 2) over o q from s window o as (partition by k order by x))
, z as (select *, coalesce(p, 3*b-3*c+q, 2*b-c) a, coalesce(q, 3*c-3*b+p, 2*c-b) d from w where x1 is not null)
, g as (select a.k, h+0.5::double at_ from range(15) a(k) cross join range(720) r(h))
, m as (select g.k, g.at_, x1, a, b, c, d, (at_-x)/(x1-x) t from g asof left join z on g.k=z.k and g.at_>=z.x)
select k, at_ "at", round(case when at_<=x1 then (a*(-t**3+2*t**2-t)+b*(3*t**3-5*t**2+2)+c*(-3*t**3+4*t**2+t)+d*(t**3-t**2))/2 end, 6)+0.0::double v from m""")


def _event_points(s: SparkSession, d: str) -> DataFrame:
    """A point of the unit square for every event, spread by two irrational steps, on the 64 x 64 image."""
    part = lambda step: (lambda v: 63.0 * (v - F.floor(v)))(F.col("event_id") * F.lit(step))
    return s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), part(0.7548776662466927).alias("y"), part(0.5698402909980532).alias("x"))


def _points_sql(reach: int, weight: str, repeat: bool) -> str:
    at = lambda c, k: f"least(63, greatest(0, {c}+{k}))" if repeat else f"{c}+{k}"
    return (
        f"with v as materialized ({Q['fx5']}), p as (select event_id id, 63.0::double*(event_id*0.7548776662466927::double-floor(event_id*0.7548776662466927::double)) py, "
        "63.0::double*(event_id*0.5698402909980532::double-floor(event_id*0.5698402909980532::double)) px from events) "
        f"select id, round(sum({weight.format(t='(py-floor(py)-i)')}*{weight.format(t='(px-floor(px)-j)')}*v.re), 6)+0.0::double re "
        f"from p cross join range({1 - reach},{reach + 1}) a(i) cross join range({1 - reach},{reach + 1}) b(j) "
        f"join v on v.y={at('floor(py)::bigint', 'i')} and v.x={at('floor(px)::bigint', 'j')} group by id"
    )


for _m, _n, _r, _w in (("linear", 1, 1, "greatest(0, 1-abs({t}))"), ("cubic", 2, 2, _CUBIC), ("lanczos", 2, 2, _lz(2))):
    register(f"f8_{_m}2d", lambda s, d, m=_m, n=_n: (lambda t: t.select("id", (F.round("re", 6) + 0.0).alias("re")))(rs.sample_at(fx.fx5(s, d), _event_points(s, d), m, n)), _points_sql(_r, _w, _m == "cubic"))
