"""TIFF of every scheme read in tasks, pictures written in bands."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweft.raster import from_numpy, generate
from pixelweft.sources import formats as fm
from pixelweft.sources import pictures as pc
from pixelweft.sources import tiff as tf

RNG = np.random.default_rng(14)


def lzw(data):
    """The encoder of the format, written from its description."""
    table, width, out, bits = {bytes([k]): k for k in range(256)}, 9, 256, 9
    new, w = 258, b""
    for k in data:
        c = bytes([k])
        if w + c in table:
            w += c
            continue
        out, bits = out << width | table[w], bits + width
        table[w + c] = new
        new += 1
        width = max(width, new.bit_length()) if new < 4095 else width
        if new == 4094:
            out, bits = out << width | 256, bits + width
            table, new, width = {bytes([k]): k for k in range(256)}, 258, 9
        w = c
    if w:
        out, bits = out << width | table[w], bits + width
        new += 1
        width = max(width, new.bit_length())
    out, bits = out << width | 257, bits + width
    pad = -bits % 8
    return (out << pad).to_bytes((bits + pad) // 8, "big")


def packbits(data):
    out, at = b"", 0
    while at < len(data):
        n = 1
        while at + n < len(data) and n < 128 and data[at + n] == data[at]:
            n += 1
        if n > 1:
            out += bytes([257 - n]) + data[at : at + 1]
        else:
            while at + n < len(data) and n < 128 and data[at + n] != data[at + n - 1]:
                n += 1
            out += bytes([n - 1]) + data[at : at + n]
        at += n
    return out + b"\x80"


CODERS = {1: bytes, 5: lzw, 8: zlib.compress, 32773: packbits}


def predicted(a, predictor):
    """Differences along rows, of values or of byte planes."""
    if predictor == 2:
        d = a.copy()
        d[:, 1:] = a[:, 1:] - a[:, :-1]
        return d.tobytes()
    if predictor == 3:
        h, w, c = a.shape
        planes = np.frombuffer(a.astype(a.dtype.newbyteorder(">")).tobytes(), np.uint8).reshape(h, w * c, -1).transpose(0, 2, 1).reshape(h, -1, c)
        d = planes.copy()
        d[:, 1:] = planes[:, 1:] - planes[:, :-1]
        return d.tobytes()
    return a.tobytes()


def write(path, a, tile=None, compression=1, predictor=1, planar=False, order="<", rows=5):
    """a is (rows, columns, channels)."""
    ny, nx, c = a.shape
    a = a.astype(a.dtype.newbyteorder(order))
    parts = []
    for block in [a[..., k : k + 1] for k in range(c)] if planar else [a]:
        th, tw = tile or (rows, nx)
        for y in range(0, ny, th):
            for x in range(0, nx, tw):
                part = block[y : y + th, x : x + tw]
                if tile:
                    part = np.pad(part, ((0, th - part.shape[0]), (0, tw - part.shape[1]), (0, 0)))
                parts.append(CODERS[compression](predicted(np.ascontiguousarray(part), predictor)))
    kind = {"u": 1, "i": 2, "f": 3, "c": 6}[a.dtype.kind]
    tags = [(256, 4, [nx]), (257, 4, [ny]), (258, 3, [8 * a.itemsize] * c), (259, 3, [compression]), (277, 3, [c]), (284, 3, [2 if planar else 1]), (317, 3, [predictor]), (339, 3, [kind] * c)]
    tags += [(322, 4, [tile[1]]), (323, 4, [tile[0]]), (324, 4, None), (325, 4, [len(p) for p in parts])] if tile else [(273, 4, None), (278, 4, [rows]), (279, 4, [len(p) for p in parts])]
    tags += [(33550, 12, [2.0, 3.0, 0.0]), (33922, 12, [0.0, 0.0, 0.0, 100.0, 500.0, 0.0])]
    tags.sort()
    size = {3: 2, 4: 4, 12: 8}
    at = 8 + 2 + 12 * len(tags) + 4
    first = at + sum(size[k] * len(v or parts) for _, k, v in tags)
    starts = [first + sum(map(len, parts[:i])) for i in range(len(parts))]
    head, more = struct.pack(order + "2sHI", {"<": b"II", ">": b"MM"}[order], 42, 8) + struct.pack(order + "H", len(tags)), b""
    for tag, k, v in tags:
        v = v or starts
        raw = struct.pack(order + f"{len(v)}{ {3: 'H', 4: 'I', 12: 'd'}[k]}", *v)
        if len(raw) > 4:
            head += struct.pack(order + "HHII", tag, k, len(v), at + len(more))
            more += raw
        else:
            head += struct.pack(order + "HHI", tag, k, len(v)) + raw.ljust(4, b"\0")
    body = (head + bytes(4) + more).ljust(first, b"\0")
    path.write_bytes(body + b"".join(parts))


@pytest.mark.parametrize("compression", [1, 5, 8, 32773])
@pytest.mark.parametrize(("dtype", "predictor", "planar", "order", "tile"), [("u1", 1, False, "<", (16, 16)), ("i2", 2, False, ">", (16, 32)), ("f4", 3, True, "<", None), ("u2", 2, True, "<", (16, 16)), ("f8", 3, False, ">", (32, 16)), ("c8", 1, False, "<", None)])
def test_tiff_of_every_scheme(spark, tmp_path, compression, dtype, predictor, planar, order, tile):
    a = (np.cumsum(RNG.normal(size=(37, 43, 3)), 1) * 20 + 90).clip(0, 250).astype(dtype)
    if dtype == "c8":
        a = a + 1j * RNG.normal(size=a.shape).astype("f4")
    path = tmp_path / "a.tif"
    write(path, a.astype(dtype), tile, compression, predictor, planar, order)
    r = tf.geotiff(spark, str(path))
    np.testing.assert_array_equal(r.to_numpy(), a.astype(dtype).transpose(2, 0, 1))
    assert r.meta["geo_ps_north"] == 3.0 and r.meta["geo_max_north"] == 500.0


def test_lzw_tables_fill_and_clear():
    for data in (b"", b"a", b"ab" * 9000, bytes(RNG.integers(0, 256, 60_000).tolist()), bytes(RNG.integers(0, 3, 60_000).tolist())):
        assert tf.unlzw(lzw(data)) == data


def test_only_wanted_tiles_are_read(spark, tmp_path):
    a = RNG.integers(0, 255, (64, 64, 1)).astype("u1")
    path = tmp_path / "a.tif"
    write(path, a, (16, 16), 8)
    raw = bytearray(path.read_bytes())
    image, _ = tf.read_header(str(path))
    keep = {1 * 4 + 2}
    for k, (at, n) in enumerate(zip(image.offsets, image.counts, strict=True)):
        if k not in keep:
            raw[at : at + n] = b"\xee" * n  # what isn't wanted can't be decoded
    path.write_bytes(bytes(raw))
    r = tf.geotiff(spark, str(path))
    rows = r.df.where((F.col("y") >= 16) & (F.col("y") < 32) & (F.col("x") > 33) & (F.col("x") <= 47)).collect()
    assert len(rows) == 16 * 14 and all(v.re == a[v.y, v.x, 0] for v in rows)


@pytest.mark.parametrize("pixels", [10**9, 700, 1])
def test_png_in_bands(spark, tmp_path, pixels):
    for a in (RNG.random((23, 31)), RNG.random((4, 9, 40))):
        r, path = from_numpy(spark, a), str(tmp_path / "a.png")
        pc.write_png(r, path, method="minmax", palette="grey", order=(2, 0, 1), pixels=pixels)
        got = fm.png(spark, path).to_numpy()
        bytes_ = pc.scaled(r, "minmax").to_numpy().astype(np.uint8).reshape(-1, *a.shape[-2:])
        want = np.repeat(bytes_, 3, 0) if len(bytes_) == 1 else bytes_[[2, 0, 1]]
        np.testing.assert_array_equal(got, want)


def test_checksums_combine():
    for _ in range(20):
        a, b = (bytes(RNG.integers(0, 256, RNG.integers(0, 70_000)).tolist()) for _ in range(2))
        assert pc.adler_combine(zlib.adler32(a), zlib.adler32(b), len(b)) == zlib.adler32(a + b)


def test_ppm_in_bands(spark, tmp_path):
    r = from_numpy(spark, RNG.random((3, 17, 22)))
    pc.write_ppm(r, str(tmp_path / "a.ppm"), method="minmax", pixels=100)
    np.testing.assert_array_equal(fm.ppm(spark, str(tmp_path / "a.ppm")).to_numpy(), pc.scaled(r, "minmax").to_numpy().astype(np.uint8))


@pytest.mark.parametrize("dtype", ["f4", "f8", "c8", "u1", "i2"])
def test_tiff_written_by_tasks(spark, tmp_path, dtype):
    a = np.round(RNG.normal(size=(2, 150, 13)) * 20 + 100) + (0.5j if dtype == "c8" else 0)
    r = from_numpy(spark, a, {"geo_ps_east": 2.0, "geo_ps_north": 2.0, "geo_min_east": 7.0, "geo_max_north": 9.0})
    for one in (r, from_numpy(spark, a[0])):
        pc.write_tiff(one, str(tmp_path / "a.tif"), dtype)
        back = tf.geotiff(spark, str(tmp_path / "a.tif"))
        np.testing.assert_allclose(back.to_numpy(), one.to_numpy(), rtol=1e-6)
        assert back.meta == one.meta


@pytest.mark.parametrize("dtype", ["f4", "f8", "c8", "u1", "i2"])
def test_tiff_deflated_by_tasks(spark, tmp_path, dtype):
    a = np.round(RNG.normal(size=(3, 70, 13)) * 20 + 100) + (0.5j if dtype == "c8" else 0)
    for one in (from_numpy(spark, a), from_numpy(spark, a[0])):
        pc.write_tiff_deflated(one, str(tmp_path / "a.tif"), dtype, rows=16)
        np.testing.assert_allclose(tf.geotiff(spark, str(tmp_path / "a.tif")).to_numpy(), one.to_numpy(), rtol=1e-6)


def test_a_large_picture_keeps_the_driver_small(spark, tmp_path):
    path = tmp_path / "a.png"
    pc.write_png(generate(spark, 1500, 2000, lambda y, x: (y * 7 + x * 3) % 256), str(path), method="minmax", pixels=200_000)
    data, at, body, sizes = path.read_bytes(), 8, b"", []
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body += data[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
        sizes.append(n)
        at += n + 12
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(1500, 6001)
    assert len(sizes) >= 15 and set(raw[:, 0]) == {0, 2}
