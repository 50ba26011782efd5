"""Tiled or striped TIFF, compressed or not: the tile directory becomes input partitions, tasks read and decode.

Filters on y and x select tiles before a byte of them is read. Compression: none, LZW, Deflate, PackBits; predictors:
none, horizontal, floating point; chunky or planar channels; either byte order. Geo tags (pixel size, tie point) go to
the metadata. Files must be visible to all executors. Not read: JPEG compression, bits that are no whole bytes, BigTIFF.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..raster import Raster

#: Tag types and their sizes; sample formats; compression codes (fixed values of the format).
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
LETTERS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
SAMPLES = {1: "u", 2: "i", 3: "f", 6: "c"}
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946


@dataclass
class Image:
    """What a TIFF's first directory says."""

    path: str
    dtype: str
    ny: int
    nx: int
    channels: int
    tile: tuple[int, int]
    planar: bool
    compression: int
    predictor: int
    offsets: list[int]
    counts: list[int]

    @property
    def grid(self) -> tuple[int, int]:
        return -(-self.ny // self.tile[0]), -(-self.nx // self.tile[1])

    def block(self, k: int) -> tuple[int, int, int, np.ndarray]:
        """(first channel, row, column, values (channels, rows, columns)) of a tile or strip, cut to the image."""
        rows, cols = self.grid
        plane, at = divmod(k, rows * cols) if self.planar else (0, k)
        y, x = at // cols * self.tile[0], at % cols * self.tile[1]
        c = 1 if self.planar else self.channels
        t = np.dtype(self.dtype)
        line = self.tile[1] * c * t.itemsize
        with open(self.path, "rb") as f:
            f.seek(self.offsets[k])
            raw = decoded(f.read(self.counts[k]), self.compression)
        h = min(self.tile[0], len(raw) // line)  # the last strip may hold fewer rows
        a = unpredicted(raw[: h * line], self.predictor, t, h, self.tile[1], c)
        return plane, y, x, a[: self.ny - y, : self.nx - x].transpose(2, 0, 1)


def read_header(path: str) -> tuple[Image, dict]:
    with open(path, "rb") as f:
        order = {b"II": "<", b"MM": ">"}[f.read(2)]
        magic, at = struct.unpack(order + "HI", f.read(6))
        if magic != 42:
            raise ValueError("no classic TIFF")
        f.seek(at)
        tags: dict[int, tuple] = {}
        for _ in range(struct.unpack(order + "H", f.read(2))[0]):
            tag, kind, n = struct.unpack(order + "HHI", f.read(8))
            raw, here = f.read(4), f.tell()
            size = SIZES.get(kind, 1) * n
            if size > 4:
                f.seek(struct.unpack(order + "I", raw)[0])
                raw = f.read(size)
                f.seek(here)
            if kind in LETTERS:
                tags[tag] = struct.unpack(f"{order}{n}{LETTERS[kind]}", raw[:size])
    one = lambda tag, default: tags.get(tag, (default,))[0]
    nx, ny, bits = one(256, 0), one(257, 0), tags.get(258, (1,))
    if bits[0] % 8 or len(set(bits)) > 1:
        raise ValueError("samples are no whole bytes of one size")
    tile = (one(323, 0), one(322, 0)) if 324 in tags else (min(one(278, ny), ny), nx)
    image = Image(path, order + SAMPLES[one(339, 1)] + str(bits[0] // 8), ny, nx, one(277, 1), tile, one(284, 1) == 2, one(259, 1), one(317, 1), list(tags.get(324) or tags[273]), list(tags.get(325) or tags.get(279) or ()))
    if image.compression not in (NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE):
        raise ValueError(f"compression {image.compression} is not read")
    if not image.counts:
        image.counts = [tile[0] * tile[1] * (1 if image.planar else image.channels) * np.dtype(image.dtype).itemsize] * len(image.offsets)
    meta = {}
    if 33550 in tags and 33922 in tags:
        scale, tie = tags[33550], tags[33922]
        meta = {"geo_ps_east": scale[0], "geo_ps_north": scale[1], "geo_min_east": tie[3] - tie[0] * scale[0], "geo_max_north": tie[4] + tie[1] * scale[1]}
    return image, meta


def decoded(raw: bytes, compression: int) -> bytes:
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(raw)
    return {NONE: bytes, LZW: unlzw, PACKBITS: unpacked}[compression](raw)


def unpacked(raw: bytes) -> bytes:
    """PackBits: runs of literals and of repeats."""
    out, at = bytearray(), 0
    while at < len(raw):
        n = raw[at]
        if n < 128:
            out += raw[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += raw[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def unlzw(raw: bytes) -> bytes:
    """LZW with codes of 9 to 12 bits, highest bit first; 256 clears the table, 257 ends."""
    clear, end = 256, 257
    start = [bytes([k]) for k in range(256)] + [b"", b""]
    table, width, last = list(start), 9, b""
    out, held, bits = [], 0, 0
    for byte in raw:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == end:
            break
        if code == clear:
            table, width, last = list(start), 9, b""
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        out.append(entry)
        if last:
            table.append(last + entry[:1])
        last = entry
        width = min(12, (len(table) + 1).bit_length())  # one code early
    return b"".join(out)


def unpredicted(raw: bytes, predictor: int, t: np.dtype, h: int, w: int, c: int) -> np.ndarray:
    """(rows, columns, channels) with differences along rows added up."""
    if predictor == 3:
        # Bytes of a row lie in planes, the highest first, and are differences of one another.
        planes = np.frombuffer(raw, np.uint8).reshape(h, -1, c)
        planes = np.cumsum(planes, axis=1, dtype=np.uint8).reshape(h, t.itemsize, w * c)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(t.newbyteorder(">")).reshape(h, w, c)
    a = np.frombuffer(raw, t).reshape(h, w, c)
    return np.cumsum(a, axis=1, dtype=a.dtype.newbyteorder("=")) if predictor == 2 else a


@dataclass
class Tiles(InputPartition):
    first: int
    numbers: list[int]


class TiffReader(DataSourceReader):
    def __init__(self, options: dict):
        self.image = Image(**json.loads(options["image"]))
        self.low, self.high = {"y": 0, "x": 0}, {"y": self.image.ny - 1, "x": self.image.nx - 1}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name, v = getattr(f, "attribute", ("",))[0], getattr(f, "value", None)
            if name in self.low and isinstance(v, int) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.low[name] = max(self.low[name], v + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    self.high[name] = min(self.high[name], v - isinstance(f, LessThan))
            yield f  # tiles are coarser than pixels: Spark still filters

    def partitions(self) -> list[Tiles]:
        x = self.image
        rows, cols = x.grid
        size = x.tile[0] * x.tile[1] * np.dtype(x.dtype).itemsize * (1 if x.planar else x.channels)
        wanted = []
        for k in range(len(x.offsets)):
            at = k % (rows * cols)
            y0, x0 = at // cols * x.tile[0], at % cols * x.tile[1]
            if y0 <= self.high["y"] and y0 + x.tile[0] > self.low["y"] and x0 <= self.high["x"] and x0 + x.tile[1] > self.low["x"]:
                wanted.append(k)
        per = max(1, (16 << 20) // max(1, size))
        return [Tiles(i, wanted[i : i + per]) for i in range(0, len(wanted), per)] or [Tiles(0, [])]

    def read(self, p: Tiles) -> Iterator[pa.RecordBatch]:
        for k in p.numbers:
            c0, y0, x0, v = self.image.block(k)
            for a in range(0, v.shape[1], max(1, 400_000 // max(1, v.shape[0] * v.shape[2]))):
                part = v[:, a : a + max(1, 400_000 // max(1, v.shape[0] * v.shape[2]))]
                c, i, j = (n.ravel() for n in np.indices(part.shape))
                flat = part.ravel()
                re, im = (flat.real, flat.imag) if np.iscomplexobj(flat) else (flat, np.zeros(len(flat)))
                re, im = (np.nan_to_num(n.astype(np.float64), nan=0.0, posinf=0.0, neginf=0.0) for n in (re, im))
                yield pa.RecordBatch.from_arrays([pa.array((c + c0).astype(np.int32)), pa.array((i + a + y0).astype(np.int64)), pa.array((j + x0).astype(np.int64)), pa.array(re), pa.array(im)], ["ch", "y", "x", "re", "im"])


class TiffSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tiffraster"

    def schema(self) -> str:
        return "ch int, y long, x long, re double, im double"

    def reader(self, schema) -> TiffReader:
        return TiffReader(self.options)


def geotiff(spark: SparkSession, path: str) -> Raster:
    """A lazy raster of a TIFF; switches on filter pushdown for Python sources in the session."""
    image, meta = read_header(path)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TiffSource)
    df = spark.read.format("tiffraster").option("image", json.dumps(asdict(image))).load()
    is_complex = np.dtype(image.dtype).kind == "c"
    df = df if is_complex else df.drop("im")
    return Raster(df if image.channels > 1 else df.drop("ch"), image.ny, image.nx, (image.channels,) if image.channels > 1 else (), "long", is_complex, meta)
