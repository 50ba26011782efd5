"""Formats: what is written is read, rows are selected before bytes are."""

import json
import struct
from dataclasses import asdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweft.catalog import RasterCatalog
from pixelweft.operators import point as pt
from pixelweft.raster import from_numpy
from pixelweft.sources import formats as fm
from pixelweft.sources.flat import FlatReader, write
from pixelweft.streaming import row_bands, run

RNG = np.random.default_rng(1)


@pytest.mark.parametrize("shape,dtype", [((30, 21), "f4"), ((30, 21), "c8"), ((3, 30, 21), "f8"), ((2, 2, 30, 21), "c16"), ((30, 21), "u1")])
def test_rat_round_trip(spark, tmp_path, shape, dtype):
    a = RNG.integers(0, 200, shape).astype(float) if dtype == "u1" else RNG.standard_normal(shape).astype(np.dtype(dtype[0].replace("c", "f") + "8"))
    if dtype[0] == "c":
        a = a + 1j * RNG.standard_normal(shape)
    path = str(tmp_path / "a.rat")
    fm.write_rat(from_numpy(spark, a, {"info": "a scene"}), path, dtype, envi=True)
    got = fm.rat(spark, path, rows=7)
    assert got.meta["info"] == "a scene" and got.df.rdd.getNumPartitions() == 5
    assert np.allclose(got.to_numpy(), a, atol=1e-6 if dtype in ("f4", "c8") else 0)
    assert np.allclose(fm.envi(spark, path).to_numpy().reshape(shape), a, atol=1e-5)


def test_rat_version_1_big_endian(spark, tmp_path):
    a = RNG.standard_normal((4, 6)).astype(">f4")
    path = str(tmp_path / "old.rat")
    with open(path, "wb") as f:
        f.write(struct.pack(">iiiii", 2, 6, 4, 4, 0) + b"\0" * 16 + b" " * 80 + a.tobytes())
    assert np.allclose(fm.rat(spark, path).to_numpy(), a)


def test_rows_are_pruned(tmp_path):
    from pyspark.sql.datasource import GreaterThanOrEqual, LessThan

    from pixelweft.sources.flat import Layout

    import json
    from dataclasses import asdict

    r = FlatReader({"layouts": json.dumps([asdict(Layout("x", "<f4", 100, 5))]), "rows": "10"})
    assert not list(r.pushFilters([GreaterThanOrEqual(("y",), 35), LessThan(("y",), 52)]))
    assert [(p.start, p.stop) for p in r.partitions()] == [(35, 45), (45, 52)]


def test_envi_interleaves(spark, tmp_path):
    a = RNG.standard_normal((3, 5, 4))
    for name, b in (("bsq", a), ("bil", a.transpose(1, 0, 2)), ("bip", a.transpose(1, 2, 0))):
        path = str(tmp_path / name)
        b.astype("<f8").tofile(path)
        with open(path + ".hdr", "w") as f:
            f.write(f"ENVI\nsamples = 4\nlines = 5\nbands = 3\ndata type = 5\ninterleave = {name}\nbyte order = 0\n")
        assert np.allclose(fm.envi(spark, path).to_numpy(), a)


def test_rolf_esar_track_uavsar(spark, tmp_path):
    a = RNG.standard_normal((9, 7)).astype("f4")
    p = str(tmp_path / "r.dat")
    with open(p, "wb") as f:
        f.write(struct.pack(">II", 7, 9) + a.astype(">f4").tobytes())
    assert np.allclose(fm.rolf(spark, p, (2, 6, 1, 0)).to_numpy(), a[2:6, 1:])
    z = (RNG.standard_normal((2, 9, 7)) + 1j).astype("c8")
    paths = []
    for k, pol in enumerate(("hh", "vv")):
        paths.append(str(tmp_path / f"i_{pol}_slc.dat"))
        with open(paths[-1], "wb") as f:
            f.write(struct.pack(">ii", 7, 9) + z[k].astype(">c8").tobytes())
    e = fm.esar(spark, paths)
    assert np.allclose(e.to_numpy(), z) and e.meta["CH_pol"] == ["HH", "VV"]
    t = RNG.standard_normal((10, 5))
    with open(p, "wb") as f:
        f.write(struct.pack(">i", 5) + t.astype(">f8").tobytes())
    rows = fm.esar_track(spark, p).orderBy("i").collect()
    assert np.allclose([r.time for r in rows], t[0]) and np.allclose([r.ref_y for r in rows], t[5]) and np.allclose([r.real_z for r in rows], t[3])
    segs = []
    for k in (0, 1):
        segs.append(str(tmp_path / f"scene_HHVV_s{k + 1}.slc"))
        z[k, : 9 - 3 * k].astype("<c8").tofile(segs[-1])
    with open(tmp_path / "a.ann", "w") as f:
        f.write("; comment\nslc_1_1x1 Rows (pixels) = 9 ; rows\nslc_1_1x1 Columns (pixels) = 7\nslc_2_1x1 Rows (pixels) = 6\nslc_2_1x1 Columns (pixels) = 7\nSite (&) = here ; x\n")
    u = fm.uavsar(spark, [segs], str(tmp_path / "a.ann"), (4, 12, 0, 0))
    assert np.allclose(u.to_numpy(), np.concatenate([z[0], z[1, :6]])[4:12])


def test_pictures(spark, tmp_path):
    a = RNG.integers(0, 255, (3, 6, 5)).astype(float)
    r = from_numpy(spark, a)
    fm.write_ppm(r, str(tmp_path / "a.ppm"), method="minmax")
    fm.write_png(r, str(tmp_path / "a.png"), method="minmax")
    p, q = fm.ppm(spark, str(tmp_path / "a.ppm")).to_numpy(), fm.png(spark, str(tmp_path / "a.png")).to_numpy()
    assert np.array_equal(p, q) and p.shape == (3, 6, 5) and p.max() == 255
    assert fm.picture(from_numpy(spark, a[0])).shape == (6, 5, 3)


def test_tiff_strips(spark, tmp_path):
    a = RNG.standard_normal((4, 3)).astype("<f4")
    tags = [(256, 4, 1, 3), (257, 4, 1, 4), (258, 3, 1, 32), (259, 3, 1, 1), (273, 4, 1, 8), (277, 3, 1, 1), (279, 4, 1, 48), (339, 3, 1, 3)]
    with open(tmp_path / "a.tif", "wb") as f:
        f.write(b"II" + struct.pack("<HI", 42, 56) + a.tobytes() + struct.pack("<H", len(tags)))
        for t in tags:
            f.write(struct.pack("<HHII", *t))
        f.write(struct.pack("<I", 0))
    assert np.allclose(fm.geotiff(spark, str(tmp_path / "a.tif")).to_numpy(), a)


def test_catalog(spark, tmp_path):
    c = RasterCatalog(spark)
    a = RNG.standard_normal((2, 6, 5))
    name = c.add(from_numpy(spark, a, {"CH_name": ["p", "q"]}))
    assert c.active == [name] and np.array_equal(c.get(f"{name}/D1").to_numpy(), a[1])
    c.set_meta({"CH_name": "r", "prf": 2.0}, channel=1)
    assert c.meta()["CH_name"] == ["p", "r"]
    c.rename(name, "scene")
    c.save(str(tmp_path / "s"))
    d = RasterCatalog.load(spark, str(tmp_path / "s"))
    assert d.list() == {"scene": (2, 6, 5)} and d.meta()["prf"] == 2.0 and np.allclose(d.get().to_numpy(), a)
    d.drop("scene")
    assert not d.active


def test_streamed_bands(spark, tmp_path):
    r = from_numpy(spark, RNG.standard_normal((6, 4)))
    r.df.write.parquet(str(tmp_path / "in"))
    run(row_bands(spark, str(tmp_path / "in"), r), pt.amp2int, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = r.with_df(spark.read.parquet(str(tmp_path / "out"))).to_numpy()
    assert np.allclose(got, r.to_numpy() ** 2)


def test_generated_source(spark):
    from pixelweft.raster import generate

    assert np.array_equal(generate(spark, 3, 4, lambda y, x: F.lit(10) * y + x).to_numpy(), [[0, 1, 2, 3], [10, 11, 12, 13], [20, 21, 22, 23]])


@pytest.mark.parametrize("interleave", ["bsq", "bil", "bip"])
def test_long_rows_are_read_in_stretches(tmp_path, interleave):
    """No batch holds much over 200,000 values and no partition over 16 MB, however long a row is."""
    from pixelweft.sources.flat import Layout

    a = np.random.default_rng(5).integers(0, 255, (3, 2, 300_000), dtype=np.uint8)
    path = str(tmp_path / "a.dat")
    a.transpose({"bsq": (0, 1, 2), "bil": (1, 0, 2), "bip": (1, 2, 0)}[interleave]).tofile(path)
    for dtype, x0, x1 in (("u1", 0, 0), ("u1", 1000, 299_000)):
        r = FlatReader({"layouts": json.dumps([asdict(Layout(path, dtype, 2, 300_000, 3, interleave=interleave, x0=x0, x1=x1))])})
        out = np.full((3, 2, (x1 or 300_000) - x0), -1.0)
        for p in r.partitions():
            for b in r.read(p):
                assert len(b) <= 200_000
                ch, y, x, re = (b.column(k).to_numpy() for k in ("ch", "y", "x", "re"))
                assert (out[ch, y, x] == -1).all()
                out[ch, y, x] = re
        assert np.array_equal(out, a[:, :, x0 : x1 or None])
    wide = FlatReader({"layouts": json.dumps([asdict(Layout(path, "f8", 2, 9_000_000, 3, interleave=interleave))])}).partitions()
    assert all((p.stop - p.start) * (p.x1 - p.x0) * 3 * 8 <= 16 << 20 for p in wide) and sum((p.stop - p.start) * (p.x1 - p.x0) for p in wide) == 18_000_000


@pytest.mark.parametrize("pixels", [1, 40, 700, 10_000])
def test_long_rows_are_written_in_stretches(spark, tmp_path, pixels):
    a = np.random.default_rng(6).normal(size=(3, 2, 101)) + 1j
    write(from_numpy(spark, a), str(tmp_path / "a.dat"), "<c16", 8, pixels)
    assert np.array_equal(np.fromfile(tmp_path / "a.dat", "<c16", offset=8).reshape(a.shape), a)
