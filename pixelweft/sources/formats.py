"""Headers of raster formats, read on the driver into layouts; and their writers."""

from __future__ import annotations

import glob
import os
import re
import struct
import xml.etree.ElementTree as ET
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..raster import Raster
from .flat import Layout, load, write

#: Type codes of RAT files (fixed values).
RAT_TYPES = {1: "u1", 2: "i2", 3: "i4", 4: "f4", 5: "f8", 6: "c8", 9: "c16", 12: "u2", 13: "u4", 14: "i8", 15: "u8"}
RAT_MAGIC = 844382546
#: The geographic block of a version 2 header: format and names (fixed values).
RAT_GEO = "<hddddhhddd"
RAT_GEO_NAMES = ("projection", "ps_east", "ps_north", "min_east", "min_north", "zone", "hemisphere", "long0scl", "max_axis_ell", "min_axis_ell")


def _split_shape(shape: list[int]) -> tuple[tuple[int, ...], int, int]:
    shape = shape if len(shape) > 1 else [1, *shape]
    return tuple(shape[:-2]), shape[-2], shape[-1]


def read_rat_header(path: str) -> tuple[Layout, tuple[int, ...], dict]:
    """Version 2 (1000-byte header) or version 1 (either byte order)."""
    with open(path, "rb") as f:
        head = f.read(1000)
    magic, version = struct.unpack("<if", head[:8])
    meta: dict = {}
    if magic == RAT_MAGIC and abs(version - 2.0) < 1e-6:
        ndim, _ = struct.unpack("<ii", head[8:16])
        shape = list(struct.unpack("<8i", head[16:48])[:ndim])[::-1]
        var = struct.unpack("<i", head[48:52])[0]
        info = head[200:300].split(b"\0")[0].decode("latin-1").strip()
        if info:
            meta["info"] = info
        size = struct.calcsize(RAT_GEO)
        geo = dict(zip(RAT_GEO_NAMES, struct.unpack(RAT_GEO, head[400 : 400 + size]), strict=True))
        if geo["projection"]:
            meta |= {f"geo_{k}": v for k, v in geo.items()}
        offset, order = 1000, "<"
    else:
        order = ">" if 0 < struct.unpack(">i", head[:4])[0] < 9 else "<"
        ndim = struct.unpack(order + "i", head[:4])[0]
        shape = list(struct.unpack(f"{order}{ndim}i", head[4 : 4 + 4 * ndim]))[::-1]
        var = struct.unpack(order + "i", head[4 + 4 * ndim : 8 + 4 * ndim])[0]
        offset = 4 * (ndim + 3) + (16 if order == ">" else 12) + 80
    # Channels of more than one vary fastest in shape order: pixels of channels if they come last.
    lshape, ny, nx = _split_shape(shape)
    interleave = "bsq"
    if len(shape) > 2 and max(shape[-1], shape[-2]) < min(shape[0], 10**9) and shape[-1] <= 16:
        lshape, (ny, nx), interleave = tuple(shape[2:]), shape[:2], "bip"
    n = int(np.prod(lshape)) if lshape else 1
    t = RAT_TYPES[var]
    return Layout(path, (order + t) if t != "u1" else t, ny, nx, n, offset, interleave), lshape, meta


def rat(spark: SparkSession, path: str, rows: int = 0) -> Raster:
    layout, lshape, meta = read_rat_header(path)
    return load(spark, [layout], meta, rows, lshape)


def write_rat(r: Raster, path: str, dtype: str | None = None, envi: bool = False) -> None:
    dtype = dtype or ("c8" if r.complex else "f4")
    code = next(k for k, v in RAT_TYPES.items() if v == dtype)
    shape = [*r.lshape, r.ny, r.nx][::-1]
    head = struct.pack("<ifii8i", RAT_MAGIC, 2.0, len(shape), r.channels, *(shape + [0] * 8)[:8]) + struct.pack("<i", code)
    head = head.ljust(200, b"\0") + str(r.meta.get("info", "")).encode("latin-1")[:100].ljust(100, b"\0")
    head = head.ljust(400, b"\0")
    if "geo_projection" in r.meta:
        head += struct.pack(RAT_GEO, *[r.meta.get(f"geo_{k}", 0) for k in RAT_GEO_NAMES])
    with open(path, "wb") as f:
        f.write(head.ljust(1000, b"\0"))
    write(r, path, "<" + dtype if dtype != "u1" else dtype, 1000)
    if envi:
        write_envi_header(r, path, dtype, 1000)


#: ENVI data type codes (fixed values).
ENVI_TYPES = {1: "u1", 2: "i2", 3: "i4", 4: "f4", 5: "f8", 6: "c8", 9: "c16", 12: "u2", 13: "u4", 14: "i8", 15: "u8"}


def read_envi_header(path: str) -> tuple[Layout, dict]:
    base = os.path.splitext(path)[0]
    hdr = next(p for p in (path + ".hdr", base + ".hdr") if os.path.exists(p))
    with open(hdr) as f:
        text = f.read()
    fields = {k.strip().lower(): v.strip() for k, v in re.findall(r"^([^=\n{]+?)\s*=\s*(\{[^}]*\}|[^\n]*)$", text, re.M)}
    order = ">" if fields.get("byte order", "0") == "1" else "<"
    layout = Layout(path, order + ENVI_TYPES[int(fields["data type"])], int(fields["lines"]), int(fields["samples"]), int(fields.get("bands", 1)), int(fields.get("header offset", 0)), fields.get("interleave", "bsq").lower())
    return layout, {k: v for k, v in fields.items() if k not in ("lines", "samples", "bands")}


def envi(spark: SparkSession, path: str) -> Raster:
    layout, meta = read_envi_header(path)
    return load(spark, [layout], meta)


def write_envi_header(r: Raster, path: str, dtype: str, offset: int = 0) -> None:
    code = next(k for k, v in ENVI_TYPES.items() if v == dtype)
    lines = ["ENVI", f"samples = {r.nx}", f"lines = {r.ny}", f"bands = {r.channels}", f"header offset = {offset}", "file type = ENVI Standard", f"data type = {code}", "interleave = bsq", "byte order = 0"]
    with open(path + ".hdr", "w") as f:
        f.write("\n".join(lines) + "\n")


def write_envi(r: Raster, path: str, dtype: str | None = None) -> None:
    dtype = dtype or ("c8" if r.complex else "f4")
    write(r, path, dtype)
    write_envi_header(r, path, dtype)


def rolf(spark: SparkSession, path: str, crop: tuple[int, int, int, int] = (0, 0, 0, 0), dtype: str = "f4") -> Raster:
    """Two big-endian sizes (columns, rows) and big-endian data."""
    with open(path, "rb") as f:
        nx, ny = struct.unpack(">II", f.read(8))
    return load(spark, [Layout(path, ">" + dtype, ny, nx, offset=8, y0=crop[0], y1=crop[1], x0=crop[2], x1=crop[3])])


def _pol_of(name: str) -> str:
    m = re.search(r"(?<![a-z])(hh|hv|vh|vv)(?![a-z])|_(?:ch\d+_)?[a-z]?(hh|hv|vh|vv)_", name.lower()) or re.search(r"(hh|hv|vh|vv)", name.lower())
    return (m[1] or (m[2] if m.lastindex and m.lastindex > 1 else m[1]) or "").upper() if m else ""


def esar(spark: SparkSession, files: list[str], product: str = "SLC", crop: tuple[int, int, int, int] = (0, 0, 0, 0)) -> Raster:
    """Big-endian complex files behind two (SLC) or three header integers, one channel a file."""
    n = 2 if product == "SLC" else 3
    layouts = []
    for k, path in enumerate(files):
        with open(path, "rb") as f:
            head = struct.unpack(f">{n}i", f.read(4 * n))
        layouts.append(Layout(path, ">c8", head[1], head[0] if product == "SLC" else head[2], offset=4 * n, first_channel=k, y0=crop[0], y1=crop[1], x0=crop[2], x1=crop[3]))
    return load(spark, layouts, {"sensor": "DLR E-SAR", "CH_pol": [_pol_of(os.path.basename(p)) for p in files]})


def fsar(spark: SparkSession, directory: str, product: str = "RGI-SLC", suffix: str = "", sym: bool = False, crop: tuple[int, int, int, int] = (0, 0, 0, 0)) -> list[Raster]:
    """Products of a directory, one raster a band, polarisations stacked; XML parameters become metadata."""
    folder, kind = product.split("-")
    prefix = {"SLC": "slc", "AMP": "amp", "CIR": "slc"}[kind]
    found: dict[str, list[str]] = {}
    for path in sorted(glob.glob(os.path.join(directory, folder, f"{folder}-SR", f"{prefix}*{suffix}.rat"))):
        m = re.search(r"_([A-Z])([hv]{2})_", os.path.basename(path))
        found.setdefault(m[1] if m else "?", []).append(path)
    out = []
    for band, paths in sorted(found.items()):
        layouts, pol = [], []
        for k, path in enumerate(paths):
            x, _, _ = read_rat_header(path)
            x.first_channel, x.y0, x.y1, x.x0, x.x1 = k, crop[0], crop[1] or x.ny, crop[2], crop[3] or x.nx
            layouts.append(x)
            m = re.search(r"_[A-Z]([hv]{2})_", os.path.basename(path))
            pol.append(m[1].upper() if m else "")
        meta = {"sensor": "DLR F-SAR", "band": band, "CH_pol": pol} | xml_parameters(os.path.join(directory, folder, f"{folder}-RDP"), band)
        r = load(spark, layouts, meta)
        if sym and {"HH", "VV", "HV", "VH"} <= set(pol):
            from ..operators.polar import calibxsym

            r = calibxsym(r)
        out.append(r)
    return out


def fsar_kz(spark: SparkSession, directory: str, band: str, suffix: str = "", sym: bool = False, crop: tuple[int, int, int, int] = (0, 0, 0, 0)) -> Raster:
    """Vertical wavenumbers of a band, polarisations stacked; of four, symmetrised ones (``sym``) leave VH out."""
    folder = os.path.join(directory, "INF" + (f"_{suffix}" if suffix else ""), "INF-SR")
    paths = [p for p in sorted(glob.glob(os.path.join(folder, "kz*.rat"))) if re.search(rf"_{band}[hv]{{2}}_", os.path.basename(p))]
    if not paths:
        raise FileNotFoundError(os.path.join(folder, f"kz*_{band}*.rat"))
    pol = [re.search(r"_[A-Z]([hv]{2})_", os.path.basename(p))[1].upper() for p in paths]
    if sym and len(paths) == 4:
        paths, pol = zip(*[(p, q) for p, q in zip(paths, pol, strict=True) if q != "VH"], strict=True)
    layouts = []
    for k, path in enumerate(paths):
        x, _, _ = read_rat_header(path)
        x.first_channel, x.y0, x.y1, x.x0, x.x1 = k, crop[0], crop[1] or x.ny, crop[2], crop[3] or x.nx
        layouts.append(x)
    return load(spark, layouts, {"sensor": "DLR F-SAR", "band": band, "CH_pol": list(pol)})


def fsar_mask(spark: SparkSession, directory: str, band: str, product: str = "RGI-SLC", crop: tuple[int, int, int, int] = (0, 0, 0, 0)) -> Raster:
    """The mask that goes with a band's product."""
    folder = product.split("-")[0]
    path = sorted(glob.glob(os.path.join(directory, folder, f"{folder}-SR", f"mask*{band}*.rat")))[0]
    x, _, _ = read_rat_header(path)
    x.y0, x.y1, x.x0, x.x1 = crop[0], crop[1] or x.ny, crop[2], crop[3] or x.nx
    return load(spark, [x], {"sensor": "DLR F-SAR", "band": band})


def fsar_aux(spark: SparkSession, directory: str, pattern: str) -> Raster:
    """Single-channel companions: slantdem_full*, offnadir*, pha_dem*, kz*; several are stacked."""
    layouts = []
    for k, path in enumerate(sorted(glob.glob(os.path.join(directory, "*", "*", pattern)))):
        x, _, _ = read_rat_header(path)
        x.first_channel = k
        layouts.append(x)
    if not layouts:
        raise FileNotFoundError(os.path.join(directory, "*", "*", pattern))
    return load(spark, layouts)


def xml_parameters(folder: str, band: str) -> dict:
    """Numbers and texts of a parameter file's <parameter name=..><value> entries."""
    out: dict = {}
    for path in sorted(glob.glob(os.path.join(folder, f"pp_*{band}*.xml")))[:1]:
        for p in ET.parse(path).getroot().iter("parameter"):
            value = p.findtext("value")
            if p.get("name") and value is not None:
                try:
                    out[p.get("name")] = float(value)
                except ValueError:
                    out[p.get("name")] = value
    return out


def read_annotation(path: str) -> dict:
    """key = value ; comment lines of an annotation file; units in the key are cut off."""
    out: dict = {}
    with open(path) as f:
        for line in f:
            if "=" not in line.split(";")[0]:
                continue
            key, value = line.split(";")[0].split("=", 1)
            key, value = key.split("(")[0].strip(), value.strip()
            try:
                out[key] = float(value.split()[0])
            except (ValueError, IndexError):
                out[key] = value
    return out


def uavsar(spark: SparkSession, segments: list[list[str]], annotation: str, crop: tuple[int, int, int, int] = (0, 0, 0, 0)) -> Raster:
    """Little-endian complex segments, one list a channel; segment sizes come from the annotation."""
    ann = read_annotation(annotation)
    layouts, pol = [], []
    for c, files in enumerate(segments):
        at = 0
        for k, path in enumerate(files, 1):
            ny, nx = int(ann[f"slc_{k}_1x1 Rows"]), int(ann[f"slc_{k}_1x1 Columns"])
            stop = crop[1] or 2**62
            a, b = max(0, crop[0] - at), min(ny, stop - at)
            if a < b:
                layouts.append(Layout(path, "<c8", ny, nx, first_channel=c, first_row=at + a - crop[0], y0=a, y1=b, x0=crop[2], x1=crop[3]))
            at += ny
        pol.append(_pol_of(os.path.basename(files[0])))
    return load(spark, layouts, {"sensor": "UAVSAR", "CH_pol": pol} | {k: v for k, v in ann.items() if isinstance(v, float)})


TRACK = "i long, ref_x double, ref_y double, ref_z double, real_x double, real_y double, real_z double, time double"


def esar_track(spark: SparkSession, path: str, crop: tuple[int, int] = (0, 0), setlen: int = 0) -> DataFrame:
    """A flight track: reference and real positions and times, optionally resampled to a length."""
    import pandas as pd

    with open(path, "rb") as f:
        n = struct.unpack(">i", f.read(4))[0]
        v = np.frombuffer(f.read(8 * 10 * n), ">f8").reshape(10, n)
    cols = [*v[4:7], *v[1:4], v[0]]
    if setlen:
        at = np.arange(setlen) / setlen * n
        cols = [np.interp(at, np.arange(n), c) for c in cols]
    a, b = crop[0], crop[1] or len(cols[0])
    names = [f.split()[0] for f in TRACK.split(", ")]
    return spark.createDataFrame(pd.DataFrame(dict(zip(names, [np.arange(a, b), *[np.asarray(c, float)[a:b] for c in cols]], strict=True))), TRACK)


#: Where the tracks of a product lie, and how their files' names go on behind reftr or track (fixed values).
FSAR_TRACKS = {"RGI-SLC": ("RGI", "RGI-TRACK", "_sar_resa"), "RGI-AMP": ("RGI", "RGI-TRACK", "_sar_resa"), "INF-SLC": ("INF", "INF-TRACK", "_sar_resa"), "INF-CIR": ("GTC", "GTC-AUX", "track_loc")}


def _columns(r: Raster, names: list[str]) -> DataFrame:
    """(i, names): the columns of a track file, a row per sample."""
    cols = [F.max(F.when(F.col("x") == k, F.col("re"))).alias(n) for k, n in enumerate(names) if n]
    return r.df.groupBy(F.col("y").alias("i")).agg(*cols)


def fsar_track(spark: SparkSession, directory: str, pre_az: int = 1, band: str = "L", pol: str = "hh", product: str = "RGI-SLC", crop: tuple[int, int] = (0, 0)) -> DataFrame:
    """Reference and real positions and times of a channel, a row per line of the presummed image (``crop`` in lines).

    Tracks have ``pre_az`` samples a line; both are joined by sample. For INF-SLC the real track is corrected where the
    product says so: by constants and terms linear in the distance flown, and by sums of corrections per image line, which repeat
    over the samples of the cropped track as the product's own software repeats them.
    """
    folder, sub, kind = FSAR_TRACKS[product]
    found = sorted(glob.glob(os.path.join(directory, folder, sub, f"*{kind}*_{band}{pol}_*.rat")))
    ref, real = (next((p for p in found if os.path.basename(p).startswith(n)), None) for n in ("reftr", "track"))
    if ref is None or real is None:
        raise FileNotFoundError(os.path.join(directory, folder, sub, f"*{kind}*_{band}{pol}_*.rat"))
    a = rat(spark, ref)
    lines = (crop[1] or a.ny // pre_az) - crop[0]
    inside = F.col("i").between(crop[0] * pre_az, (crop[0] + lines) * pre_az - 1)
    one = _columns(a, ["time", "ref_x", "ref_y", "ref_z"]).where(inside)
    two = _columns(rat(spark, real), ["", "real_x", "real_y", "real_z"]).where(inside)
    t = one.join(two, "i").withColumn("i", F.col("i") - crop[0] * pre_az)
    if product == "INF-SLC":
        master = os.path.basename(real).split("_")[-3]
        for path in sorted(glob.glob(os.path.join(directory, "INF", "INF-AUX", f"baseline_error_*{master}*{band}*.rat"))):
            if "constLin" in path:
                c = [row[0] for row in rat(spark, path).df.orderBy("y", "x").select("re").collect()]  # four numbers
                start = t.where("i = 0").select(F.col("real_x").alias("x0"))
                flown = F.col("real_x") - F.col("x0")
                t = t.join(F.broadcast(start)).withColumns({"real_y": F.col("real_y") - (c[0] + flown * c[1]), "real_z": F.col("real_z") - (c[2] + flown * c[3])}).drop("x0")
            else:
                r = rat(spark, path)
                sums = r.df.where(F.col("x").between(crop[0], crop[0] + lines - 1)).groupBy((F.col("x") - crop[0]).alias("line"))
                sums = sums.agg(*[F.sum(F.when(F.col("ch") == k, F.col("re"))).alias(n) for k, n in ((1, "dy"), (2, "dz"))])
                t = t.join(sums, F.col("i") % lines == F.col("line")).withColumns({"real_y": F.col("real_y") + F.col("dy"), "real_z": F.col("real_z") + F.col("dz")})
    names = [f.split()[0] for f in TRACK.split(", ")]
    return t.where(F.col("i") % pre_az == 0).withColumn("i", F.floor(F.col("i") / pre_az)).select(*names)


def polsarpro(spark: SparkSession, directory: str, names: list[str], ny: int, nx: int) -> Raster:
    """A directory of little-endian float planes, one file an element."""
    return load(spark, [Layout(os.path.join(directory, n + ".bin"), "<f4", ny, nx, first_channel=k) for k, n in enumerate(names)], {"CH_name": names})


#: Suffixes of XIMA files and their types (fixed values).
XIMA = {".ima": "u1", ".imw": "u2", ".ims": "i2", ".imf": "f4", ".imd": "f8", ".cxb": "i1", ".cxs": "i2", ".cxf": "c8", ".cxd": "c16"}


def xima(spark: SparkSession, path: str) -> Raster:
    """A flat file with its size (columns rows) in a .dim file beside it; .cxb and .cxs interleave both parts."""
    base, ext = os.path.splitext(path)
    with open(base + ".dim") as f:
        nx, ny = map(int, f.read().split()[:2])
    if ext in (".cxb", ".cxs"):
        r = load(spark, [Layout(path, XIMA[ext], ny, nx, 2, interleave="bip")])
        parts = r.df.groupBy("y", "x").agg(F.max(F.when(F.col("ch") == 0, F.col("re"))).alias("re"), F.max(F.when(F.col("ch") == 1, F.col("re"))).alias("im"))
        return Raster(parts, ny, nx, complex=True)
    return load(spark, [Layout(path, XIMA[ext], ny, nx)])


def geotiff(spark: SparkSession, path: str) -> Raster:
    """Strips or tiles, compressed or not; see ``tiff``."""
    from .tiff import geotiff as read

    return read(spark, path)


def gdalraster(spark: SparkSession, path: str) -> Raster:
    """Any raster GDAL opens; only where GDAL is installed."""
    from osgeo import gdal

    from ..raster import from_numpy

    ds = gdal.Open(path)
    return from_numpy(spark, ds.ReadAsArray(), dict(ds.GetMetadata()))


def convair_axes(r: Raster) -> Raster:
    """Bands turned by a quarter."""
    from ..operators.geometry import rotateleft

    return rotateleft(r)


# --- pictures ----------------------------------------------------


def picture(r: Raster, method: str = "amplitude", scaling: float = 2.5, palette: str = "grey", order: tuple[int, ...] = (0, 1, 2)) -> np.ndarray:
    """(rows, columns, 3) bytes: scaling in Spark, then collected."""
    from ..operators import point as pt

    r = r.long()
    if r.complex and method in ("amplitude", "intensity"):
        r = pt.complex2abs(r)
    if method in ("amplitude", "intensity"):
        power = 0.7 if method == "amplitude" else 0.35
        out = pt.sarscale(r.with_df(r.df.withColumn("re", F.pow("re", F.lit(power)))), scaling)
    else:
        out = {"phase": pt.phascale, "coherence": pt.cohscale, "minmax": pt.bytescale}[method](r)
    a = out.to_numpy().astype(np.uint8)
    if a.ndim == 2:
        return np.array(pt.palette(palette), np.uint8)[a]
    a = a.reshape(-1, *a.shape[-2:])
    return np.stack([a[k] if k < len(a) else np.zeros_like(a[0]) for k in order], -1)


def write_png(r: Raster, path: str, **options) -> None:
    """Encoded in tasks, put together band by band; see ``pictures``."""
    from .pictures import write_png as put

    put(r, path, **options)


def write_ppm(r: Raster, path: str, **options) -> None:
    from .pictures import write_ppm as put

    put(r, path, **options)


def ppm(spark: SparkSession, path: str) -> Raster:
    """A binary PPM or PGM, colour axis first."""
    with open(path, "rb") as f:
        head = f.read(200)
    m = re.match(rb"(P[56])\s+(?:#[^\n]*\n)?(\d+)\s+(\d+)\s+(\d+)\s", head)
    n = 3 if m[1] == b"P6" else 1
    return load(spark, [Layout(path, "u1", int(m[3]), int(m[2]), n, m.end(), "bip")])


def png(spark: SparkSession, path: str) -> Raster:
    """An 8-bit non-interlaced PNG (grey, RGB, with or without alpha), colour axis first."""
    from ..raster import from_numpy

    with open(path, "rb") as f:
        data = f.read()
    at, body = 8, b""
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            w, h, depth, colour, _, _, lace = struct.unpack(">IIBBBBB", part)
        body += part if kind == b"IDAT" else b""
        at += n + 12
    if depth != 8 or lace or colour not in (0, 2, 4, 6):
        raise ValueError("PNG kind not supported")
    c = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * c)
    out = np.zeros((h, w, c), np.uint8)
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:].reshape(w, c)
        up = out[y - 1] if y else np.zeros((w, c), np.uint8)
        if kind < 3:
            out[y] = [line, np.cumsum(line, 0, np.uint8), line + up][kind]
            continue
        left, corner = np.zeros(c, int), np.zeros(c, int)
        for x in range(w):  # each pixel needs the one before it
            a, b = left, up[x].astype(int)
            if kind == 3:
                near = (a + b) // 2
            else:
                p = a + b - corner
                da, db, dc = np.abs(p - a), np.abs(p - b), np.abs(p - corner)
                near = np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, corner))
            left, corner = (line[x] + near) % 256, b
            out[y, x] = left
    a = out.reshape(h, w, c).transpose(2, 0, 1).astype(float)
    return from_numpy(spark, a[0] if c == 1 else a)
