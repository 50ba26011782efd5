"""Queries of sources and sinks: a test raster is written to the shared folder in a format and read again.

Flat files are written and read by tasks at offsets, so the folder must be mounted where executors run.
"""

from __future__ import annotations

import atexit
import os
import shutil
import struct
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx
from .catalog import RasterCatalog
from .operators import point as pt
from .plans import shared_folder
from .raster import Raster, from_numpy
from .registry import Q, pixels, register, sel
from .sources import formats as fm
from .sources import pictures as pc
from .sources.flat import write


_folders: list[str] = []


def _clean() -> None:
    """Files of queries go with the process: their results are read lazily."""
    while _folders:
        shutil.rmtree(_folders.pop(), ignore_errors=True)


def _path(spark: SparkSession, *parts: str) -> str:
    folder = os.path.join(shared_folder(spark), "pixelweft-files", uuid.uuid4().hex)
    path = os.path.join(folder, *parts)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    if not _folders:
        atexit.register(_clean)
    _folders.append(folder)
    return path


def _channel(r: Raster, k: int) -> Raster:
    return r.with_df(r.df.where(F.col("ch") == k).drop("ch"), lshape=())


def _headed(r: Raster, path: str, head: bytes, dtype: str, offset: int | None = None) -> None:
    """A header of ``offset`` bytes and the pixels behind it."""
    offset = len(head) if offset is None else offset
    with open(path, "wb") as f:
        f.write(head.ljust(offset, b"\0"))
    write(r, path, dtype, offset)


def _rat(s: SparkSession, d: str) -> Raster:
    path = _path(s, "a.rat")
    fm.write_rat(fx.fx3(s, d), path)
    return fm.rat(s, path)


def _envi(s: SparkSession, d: str) -> Raster:
    path = _path(s, "a.dat")
    fm.write_envi(fx.fx2(s, d), path)
    return fm.envi(s, path)


def _rat_envi(s: SparkSession, d: str) -> Raster:
    """A RAT file with an ENVI header beside it, read by that header."""
    path = _path(s, "a.rat")
    fm.write_rat(fx.fx1(s, d), path, envi=True)
    return fm.envi(s, path)


def _esar(s: SparkSession, d: str) -> Raster:
    r, paths = fx.fx3(s, d), []
    for k, pol in enumerate(("hh", "vv", "hv", "vh")):
        paths.append(_path(s, f"i_{pol}_slc.dat"))
        _headed(_channel(r, k), paths[-1], struct.pack(">ii", r.nx, r.ny), ">c8")
    return fm.esar(s, paths)


def _esar_track(s: SparkSession, d: str, n: int = 1000) -> DataFrame:
    path = _path(s, "track.dat")
    with open(path, "wb") as f:
        f.write(struct.pack(">i", n) + (np.arange(10)[:, None] * 1000.0 + np.arange(n) * 0.5).astype(">f8").tobytes())
    return fm.esar_track(s, path)


def _tracks(s: SparkSession, d: str) -> tuple[Raster, Raster]:
    """Two tracks of a sample per event, in whole and quarter steps: (samples, four columns)."""
    ev = s.read.parquet(f"{d}/events.parquet")
    n = ev.count()
    i = F.col("event_id")
    cols = lambda *v: F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("x"), c.cast("double").alias("re")) for k, c in enumerate(v)]))
    raster = lambda *v: Raster(ev.select(i.alias("y"), cols(*v).alias("v")).select("y", "v.x", "v.re"), n, 4)
    return raster(i * 0.25, i * 2, F.col("user_id"), i % 7), raster(i * 0.25, i * 2 + 1, F.col("user_id") + 0.5, i % 5)


def _fsar_track(product: str):
    def make(s: SparkSession, d: str) -> DataFrame:
        folder = {"RGI-SLC": ("RGI", "RGI-TRACK"), "INF-SLC": ("INF", "INF-TRACK")}[product]
        first = _path(s, *folder, "reftr_sar_resa_0101_Lhh_t01.rat")
        root = os.path.dirname(os.path.dirname(os.path.dirname(first)))
        ref, real = _tracks(s, d)
        fm.write_rat(ref, first, "f8")
        fm.write_rat(real, first.replace("reftr", "track"), "f8")
        if product == "INF-SLC":
            os.makedirs(os.path.join(root, "INF", "INF-AUX"))
            fm.write_rat(from_numpy(s, np.array([[0.5, 0.25, 1.0, 0.125]])), os.path.join(root, "INF", "INF-AUX", "baseline_error_constLin_0101_L.rat"), "f8")
            lines = ref.ny // 4
            each = s.range(3 * 2 * lines).select((F.col("id") % 3).cast("int").alias("ch"), (F.floor(F.col("id") / 3) % 2).alias("y"), F.floor(F.col("id") / 6).alias("x"))
            each = each.withColumn("re", ((F.col("x") % 11) * F.col("ch") + F.col("y")).cast("double"))
            fm.write_rat(Raster(each, 2, lines, (3,)), os.path.join(root, "INF", "INF-AUX", "baseline_error_0101_L.rat"), "f8")
        return fm.fsar_track(s, root, 4, "L", "hh", product, (3, 0))

    return make


def _fsar(s: SparkSession, d: str) -> Raster:
    r, first = fx.fx3(s, d), _path(s, "RGI", "RGI-SR", "x")
    for k, pol in enumerate(("hh", "vv", "hv", "vh")):
        fm.write_rat(_channel(r, k), os.path.join(os.path.dirname(first), f"slc_fsar_L{pol}_t01.rat"))
    return fm.fsar(s, os.path.dirname(os.path.dirname(os.path.dirname(first))))[0]


def _fsar_kz(s: SparkSession, d: str) -> Raster:
    r, first = fx.fx3(s, d), _path(s, "INF", "INF-SR", "x")
    for k, pol in enumerate(("hh", "vv", "hv", "vh")):
        one = _channel(r, k)
        fm.write_rat(one.with_df(one.df.drop("im"), complex=False), os.path.join(os.path.dirname(first), f"kz_2d_t01_L{pol}_t02.rat"))
    return fm.fsar_kz(s, os.path.dirname(os.path.dirname(os.path.dirname(first))), "L", sym=True)


def _fsar_mask(s: SparkSession, d: str) -> Raster:
    path, r = _path(s, "RGI", "RGI-SR", "mask_t01_L.rat"), fx.fx5(s, d)
    fm.write_rat(r.with_df(r.df.withColumn("re", (F.col("re") > 10).cast("double"))), path, "u1")
    return fm.fsar_mask(s, os.path.dirname(os.path.dirname(os.path.dirname(path))), "L", crop=(8, 60, 4, 0))


def _aux(name: str):
    """A companion product of two files, stacked in the order of their names."""

    def make(s: SparkSession, d: str) -> Raster:
        first = _path(s, "INF", "INF-AUX", f"{name}_a.rat")
        fm.write_rat(fx.fx1(s, d), first)
        fm.write_rat(pt.negate(fx.fx1(s, d)), first.replace("_a.rat", "_b.rat"))
        return fm.fsar_aux(s, os.path.dirname(os.path.dirname(os.path.dirname(first))), f"{name}*.rat")

    return make


def _uavsar(s: SparkSession, d: str) -> Raster:
    r = fx.fx2(s, d)
    cut, paths = r.ny // 3, []
    for k, (a, b) in enumerate(((0, cut), (cut, r.ny))):
        part = r.with_df(r.df.where(F.col("y").between(a, b - 1)).withColumn("y", F.col("y") - a), ny=b - a)
        paths.append(_path(s, f"scene_HHVV_s{k + 1}.slc"))
        _headed(part, paths[-1], b"", "<c8")
    note = _path(s, "scene.ann")
    with open(note, "w") as f:
        for k, n in enumerate((cut, r.ny - cut), 1):
            f.write(f"slc_{k}_1x1 Rows (pixels) = {n} ; rows\nslc_{k}_1x1 Columns (pixels) = {r.nx}\n")
    return fm.uavsar(s, [paths], note)


def _tiff(s: SparkSession, d: str) -> Raster:
    r, path = fx.fx1(s, d), _path(s, "a.tif")
    # Tag, type, count, value of one uncompressed strip of 32-bit floats.
    tags = [(256, 4, 1, r.nx), (257, 4, 1, r.ny), (258, 3, 1, 32), (259, 3, 1, 1), (273, 4, 1, 256), (277, 3, 1, 1), (279, 4, 1, 4 * r.nx * r.ny), (339, 3, 1, 3)]
    head = b"II" + struct.pack("<HI", 42, 8) + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + bytes(4)
    _headed(r, path, head, "<f4", 256)
    return fm.geotiff(s, path)


def _deflated(s: SparkSession, d: str) -> Raster:
    path = _path(s, "a.tif")
    pc.write_tiff_deflated(fx.fx3(s, d), path, "c8")
    return fm.geotiff(s, path)


def _strips(s: SparkSession, d: str) -> Raster:
    path = _path(s, "a.tif")
    pc.write_tiff(fx.fx1(s, d), path, "f4")
    return fm.geotiff(s, path)


def _predicted(s: SparkSession, d: str) -> Raster:
    path = _path(s, "a.tif")
    pc.write_tiff_deflated(fx.fx5(s, d), path, "u2")
    return fm.geotiff(s, path)


def _rolf(s: SparkSession, d: str) -> Raster:
    r, path = fx.fx1(s, d), _path(s, "a.dat")
    _headed(r, path, struct.pack(">II", r.nx, r.ny), ">f4")
    return fm.rolf(s, path)


def _pictured(writer, reader, ext: str):
    def make(s: SparkSession, d: str) -> Raster:
        path = _path(s, "a" + ext)
        writer(fx.fx5(s, d), path, method="minmax")
        return reader(s, path)

    return make


def _polsarpro(s: SparkSession, d: str) -> Raster:
    r, first, names = fx.fx3(s, d), _path(s, "x"), ["T11", "T22", "T33", "T44"]
    for k, name in enumerate(names):
        one = _channel(r, k)
        _headed(one.with_df(one.df.drop("im"), complex=False), os.path.join(os.path.dirname(first), name + ".bin"), b"", "<f4")
    return fm.polsarpro(s, os.path.dirname(first), names, r.ny, r.nx)


def _xima(s: SparkSession, d: str) -> Raster:
    r, path = fx.fx2(s, d), _path(s, "a.cxf")
    with open(path.replace(".cxf", ".dim"), "w") as f:
        f.write(f"{r.nx} {r.ny}\n")
    _headed(r, path, b"", "<c8")
    return fm.xima(s, path)


def _added(s: SparkSession, d: str) -> Raster:
    """An array on the driver and back: data of a session's size, here 4096 pixels."""
    return from_numpy(s, fx.fx5(s, d).to_numpy())


def _catalog(s: SparkSession, d: str) -> Raster:
    folder = os.path.dirname(_path(s, "x"))
    c = RasterCatalog(s)
    c.add(fx.fx1(s, d), "one")
    c.add(fx.fx3(s, d), "four")
    c.save(folder)
    return RasterCatalog.load(s, folder).get("four/D2")


_cube = sel(Q["fx3"], keys="ch, y::bigint y, x::bigint x", re="re", im="im")
_two = f"select 0::int ch, y, x, re from ({Q['fx1']}) union all select 1::int, y, x, -re from ({Q['fx1']})"
_grey = f"select c::int ch, y, x, floor(least(255, greatest(0, (re-lo)*(255.0::double/(hi-lo))+0.4999::double))) re from (select *, min(re) over () lo, max(re) over () hi from ({Q['fx5']})) cross join range(3) k(c)"

register("s1_k1_rat", _rat, _cube)
register("s2_k2_k8_catalog", _catalog, sel(f"select * from ({Q['fx3']}) where ch = 2", re="re", im="im"))
register("s3_esar", _esar, _cube)
register("s4_esar_track", _esar_track, "select i::bigint i, " + ", ".join(f"({1000 * k}+i*0.5::double)::double {n}" for k, n in ((4, "ref_x"), (5, "ref_y"), (6, "ref_z"), (1, "real_x"), (2, "real_y"), (3, "real_z"), (0, "time"))) + " from range(1000) t(i)")
register("s5_fsar", _fsar, sel(f"select (case ch when 0 then 0 when 2 then 1 when 3 then 2 else 3 end)::int ch, y, x, re, im from ({Q['fx3']})", keys="ch, y::bigint y, x::bigint x", re="re", im="im"))
register("s9_fsar_kz", _fsar_kz, sel(f"select (case ch when 0 then 0 when 2 then 1 else 2 end)::int ch, y, x, re from ({Q['fx3']}) where ch < 3", keys="ch, y::bigint y, x::bigint x", re="re"))
register("s5_fsar_mask", _fsar_mask, sel(f"select y-8 y, x-4 x, (re > 10)::int::double re from ({Q['fx5']}) where y between 8 and 59 and x >= 4", re="re"))
for _id, _name in (("s6", "slantdem_full"), ("s7", "offnadir"), ("s8", "pha_dem")):
    register(f"{_id}_fsar_{_name}", _aux(_name), sel(_two, keys="ch, y::bigint y, x::bigint x", re="re"))
register("s11_uavsar", _uavsar, sel(Q["fx2"], re="re", im="im"))
register("s13_geotiff", _tiff, sel(Q["fx1"], re="re"))
register("s13_k5_tiff_strips", _strips, sel(Q["fx1"], re="re"))
register("s13_k5_tiff_deflated", _deflated, _cube)
register("s13_k5_tiff_predicted", _predicted, sel(Q["fx5"], re="re"))
_t0 = "with n as (select count(*) // 4 lines from events), e as (select event_id - 12 j, event_id i, user_id u, lines - 3 lines from events cross join n)"
_flown = "(j*2)::double"
register("s10_fsar_track", _fsar_track("RGI-SLC"), f"{_t0} select (j // 4)::bigint i, (i*2)::double ref_x, u::double ref_y, (i%7)::double ref_z, (i*2+1)::double real_x, u+0.5::double real_y, (i%5)::double real_z, i*0.25::double \"time\" from e where j >= 0 and j < 4*lines and j % 4 = 0")
register("s10_fsar_track_corrected", _fsar_track("INF-SLC"), f"""{_t0}
select (j // 4)::bigint i, (i*2)::double ref_x, u::double ref_y, (i%7)::double ref_z, (i*2+1)::double real_x,
  u+0.5::double-(0.5+{_flown}*0.25)+((j%lines+3)%11)*2+1 real_y, (i%5)::double-(1.0+{_flown}*0.125)+((j%lines+3)%11)*4+1 real_z, i*0.25::double "time"
from e where j >= 0 and j < 4*lines and j % 4 = 0""")
register("s14_k4_envi", _envi, sel(Q["fx2"], re="re", im="im"))
register("k1_rat_with_envi_header", _rat_envi, sel(Q["fx1"], re="re"))
register("s23_rolf", _rolf, sel(Q["fx1"], re="re"))
register("s24_k5_png", _pictured(fm.write_png, fm.png, ".png"), sel(_grey, keys="ch, y::bigint y, x::bigint x", re="re"))
register("s24_k5_ppm", _pictured(fm.write_ppm, fm.ppm, ".ppm"), sel(_grey, keys="ch, y::bigint y, x::bigint x", re="re"))
register("s25_k7_adddata", _added, sel(Q["fx5"], re="re"))
register("s27_polsarpro", _polsarpro, sel(f"select ch, y, x, re from ({Q['fx3']})", keys="ch, y::bigint y, x::bigint x", re="re"))
register("s27_xima", _xima, sel(Q["fx2"], re="re", im="im"))
