"""Pictures of any size: bands of rows are encoded where they lie and put together in order, one band at a time.

A PNG's compressed stream is cut at flush points: every task deflates whole rows and ends on a byte, so streams of
bands follow each other in one file, each in a chunk with its own checksum; the checksum of all rows is combined from those
of the bands. An uncompressed TIFF has a fixed place for every row, so tasks write it themselves. The driver sees one band
at a time, not the picture.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..operators import point as pt
from ..raster import Raster
from .flat import write

#: The modulus of Adler-32.
ADLER = 65521


def scaled(r: Raster, method: str = "amplitude", scaling: float = 2.5) -> Raster:
    """Values 0 to 255 by the rules for amplitudes, intensities, phases, coherences, or from least to most."""
    r = r.long()
    if r.complex and method in ("amplitude", "intensity"):
        r = pt.complex2abs(r)
    if method in ("amplitude", "intensity"):
        power = 0.7 if method == "amplitude" else 0.35
        return pt.sarscale(r.with_df(r.df.withColumn("re", F.pow("re", F.lit(power)))), scaling)
    return {"phase": pt.phascale, "coherence": pt.cohscale, "minmax": pt.bytescale}[method](r)


def adler_combine(a: int, b: int, length: int) -> int:
    """Adler-32 of two stretches one behind the other, from theirs and the length of the second."""
    a1, a2, b1, b2 = a & 0xFFFF, a >> 16, b & 0xFFFF, b >> 16
    low = (a1 + b1 - 1) % ADLER
    high = (a2 + b2 + (length % ADLER) * (a1 - 1)) % ADLER
    return high << 16 | low


def _coloured(block: np.ndarray, palette: np.ndarray, order: tuple[int, ...]) -> np.ndarray:
    """(rows, columns, 3) of (channels, rows, columns): a single channel by the palette, others in their order."""
    if len(block) == 1:
        return palette[block[0]]
    return np.stack([block[k] if k < len(block) else np.zeros_like(block[0]) for k in order], -1)


def _bands(r: Raster, per: int, encode, schema: str):
    """encode(first row, values (channels, rows, columns)) per band of rows, in the order of the bands."""
    n, ny, nx = r.channels, r.ny, r.nx
    ch = F.col("ch") if r.keys else F.lit(0)
    df = r.df.select(ch.cast("int").alias("ch"), "y", "x", "re", F.floor(F.col("y") / per).alias("band"))

    def run(p: pa.Table) -> pa.Table:
        y0 = p.column("band")[0].as_py() * per
        block = np.zeros((n, min(per, ny - y0), nx), np.uint8)
        block[p.column("ch").to_numpy(), p.column("y").to_numpy() - y0, p.column("x").to_numpy()] = p.column("re").to_numpy().astype(np.uint8)
        return pa.Table.from_pylist([{"band": y0 // per, **encode(y0, block)}])

    return df.groupBy("band").applyInArrow(run, "band long, " + schema).orderBy("band")


def write_png(r: Raster, path: str, method: str = "amplitude", scaling: float = 2.5, palette: str = "grey", order: tuple[int, ...] = (0, 1, 2), pixels: int = 2_000_000) -> None:
    """An RGB picture; a task holds ``pixels`` pixels, and so does the driver."""
    r = scaled(r, method, scaling)
    lut, ny, per = np.array(pt.palette(palette), np.uint8), r.ny, max(1, pixels // r.nx)

    def encode(y0: int, block: np.ndarray) -> dict:
        rgb = _coloured(block, lut, order)
        up = np.concatenate([np.zeros_like(rgb[:1]), rgb[:-1]])
        # Filter 0 for a band's first row, which doesn't know the row above; 2 (minus the row above) for the others.
        kind = np.full((len(rgb), 1), 2, np.uint8)
        kind[0] = 0
        raw = np.concatenate([kind, (rgb - up).reshape(len(rgb), -1)], 1).tobytes()
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        data = z.compress(raw) + z.flush(zlib.Z_FINISH if y0 + len(rgb) == ny else zlib.Z_FULL_FLUSH)
        return {"data": data, "adler": zlib.adler32(raw), "length": len(raw)}

    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", r.nx, r.ny, 8, 2, 0, 0, 0)) + chunk(b"IDAT", b"\x78\x9c"))
        total = 1
        for row in _bands(r, per, encode, "data binary, adler long, length long").toLocalIterator():
            f.write(chunk(b"IDAT", bytes(row["data"])))
            total = adler_combine(total, row["adler"], row["length"])
        f.write(chunk(b"IDAT", struct.pack(">I", total)) + chunk(b"IEND", b""))


def write_ppm(r: Raster, path: str, method: str = "amplitude", scaling: float = 2.5, palette: str = "grey", order: tuple[int, ...] = (0, 1, 2), pixels: int = 2_000_000) -> None:
    r = scaled(r, method, scaling)
    lut = np.array(pt.palette(palette), np.uint8)
    with open(path, "wb") as f:
        f.write(f"P6\n{r.nx} {r.ny}\n255\n".encode())
        for row in _bands(r, max(1, pixels // r.nx), lambda _, b: {"data": _coloured(b, lut, order).tobytes()}, "data binary").toLocalIterator():
            f.write(bytes(row["data"]))


def write_tiff_deflated(r: Raster, path: str, dtype: str = "f4", rows: int = 64, level: int = 6) -> None:
    """Strips of ``rows`` rows with all channels, deflated in tasks after the horizontal predictor (of whole numbers) or the
    floating point one, put together in order; the directory comes last, when all sizes are known."""
    r = r.long()
    t, n, ny, nx = np.dtype("<" + dtype), r.channels, r.ny, r.nx
    if t.kind == "c":
        predictor = 1
    else:
        predictor = 3 if t.kind == "f" else 2
    ch = F.col("ch") if r.keys else F.lit(0)
    values = ["re", "im"] if r.complex else ["re"]
    df = r.df.select(ch.cast("int").alias("ch"), "y", "x", *values, F.floor(F.col("y") / rows).alias("band"))

    def run(p: pa.Table) -> pa.Table:
        col = lambda c: p.column(c).to_numpy()
        y0 = p.column("band")[0].as_py() * rows
        a = np.zeros((min(rows, ny - y0), nx, n), complex if len(values) == 2 else float)
        a[col("y") - y0, col("x"), col("ch")] = col("re") + 1j * col("im") if len(values) == 2 else col("re")
        a = (a if t.kind == "c" else np.rint(a.real) if t.kind in "iu" else a.real).astype(t)
        if predictor == 2:
            a = np.concatenate([a[:, :1], a[:, 1:] - a[:, :-1]], 1)
        elif predictor == 3:
            planes = np.ascontiguousarray(a.astype(t.newbyteorder(">")).reshape(len(a), -1)).view(np.uint8).reshape(len(a), nx * n, -1).transpose(0, 2, 1).reshape(len(a), -1, n)
            a = np.concatenate([planes[:, :1], planes[:, 1:] - planes[:, :-1]], 1)
        return pa.Table.from_pylist([{"band": y0 // rows, "data": zlib.compress(a.tobytes(), level)}])

    starts, counts = [], []
    with open(path, "wb") as f:
        f.write(bytes(8))
        for row in df.groupBy("band").applyInArrow(run, "band long, data binary").orderBy("band").toLocalIterator():
            starts.append(f.tell())
            counts.append(len(row["data"]))
            f.write(bytes(row["data"]) + b"\0" * (len(row["data"]) % 2))
        at = f.tell()
        kind = {"u": 1, "i": 2, "f": 3, "c": 6}[t.kind]
        tags = [(256, 4, [nx]), (257, 4, [ny]), (258, 3, [8 * t.itemsize] * n), (259, 3, [8]), (262, 3, [1]), (273, 4, starts), (277, 3, [n]), (278, 4, [rows]), (279, 4, counts), (284, 3, [1]), (317, 3, [predictor]), (339, 3, [kind] * n)]
        head, more, behind = struct.pack("<H", len(tags)), b"", at + 2 + 12 * len(tags) + 4
        for tag, k, v in tags:
            raw = struct.pack(f"<{len(v)}{'H' if k == 3 else 'I'}", *v)
            if len(raw) > 4:
                head += struct.pack("<HHII", tag, k, len(v), behind + len(more))
                more += raw + b"\0" * (len(raw) % 2)
            else:
                head += struct.pack("<HHI", tag, k, len(v)) + raw.ljust(4, b"\0")
        f.write(head + bytes(4) + more)
        f.seek(0)
        f.write(struct.pack("<2sHI", b"II", 42, at))


def write_tiff(r: Raster, path: str, dtype: str = "f4", rows: int = 64) -> None:
    """Channel planes of numbers in strips of ``rows`` rows, written by tasks at their places; little-endian, uncompressed."""
    r = r.long()
    t = np.dtype("<" + dtype)
    strips = -(-r.ny // rows)
    n = strips * r.channels
    kind = {"u": 1, "i": 2, "f": 3, "c": 6}[t.kind]
    # Strip tables of more than one entry, and the geo tags, lie behind the directory.
    tags: list[tuple[int, int, int, bytes]] = []
    short = lambda tag, v: tags.append((tag, 3, 1, struct.pack("<HH", v, 0)))
    number = lambda tag, v: tags.append((tag, 4, 1, struct.pack("<I", v)))
    number(256, r.nx)
    number(257, r.ny)
    tags.append((258, 3, r.channels, struct.pack(f"<{r.channels}H", *[8 * t.itemsize] * r.channels)))
    short(259, 1)
    short(262, 1)
    line = r.nx * t.itemsize
    counts = [min(rows, r.ny - k * rows) * line for _ in range(r.channels) for k in range(strips)]
    tags.append((273, 4, n, bytes(4 * n)))
    short(277, r.channels)
    number(278, rows)
    tags.append((279, 4, n, struct.pack(f"<{n}I", *counts)))
    short(284, 2 if r.channels > 1 else 1)
    tags.append((339, 3, r.channels, struct.pack(f"<{r.channels}H", *[kind] * r.channels)))
    if {"geo_ps_east", "geo_ps_north", "geo_min_east", "geo_max_north"} <= set(r.meta):
        tags.append((33550, 12, 3, struct.pack("<3d", r.meta["geo_ps_east"], r.meta["geo_ps_north"], 0)))
        tags.append((33922, 12, 6, struct.pack("<6d", 0, 0, 0, r.meta["geo_min_east"], r.meta["geo_max_north"], 0)))
    behind = 8 + 2 + 12 * len(tags) + 4
    first = behind + sum(len(v) + len(v) % 2 for *_, v in tags if len(v) > 4)
    if first + sum(counts) >= 2**32:
        raise ValueError("more than a classic TIFF can hold")
    starts = first + np.concatenate([[0], np.cumsum(counts[:-1])]).astype(np.int64)
    head, more = struct.pack("<2sHIH", b"II", 42, 8, len(tags)), b""
    for tag, k, m, v in tags:
        v = struct.pack(f"<{n}I", *starts.tolist()) if tag == 273 else v
        if len(v) > 4:
            head += struct.pack("<HHII", tag, k, m, behind + len(more))
            more += v + b"\0" * (len(v) % 2)
        else:
            head += struct.pack("<HHI", tag, k, m) + v.ljust(4, b"\0")
    with open(path, "wb") as f:
        f.write(head + bytes(4) + more)
    write(r, path, "<" + dtype, first)
