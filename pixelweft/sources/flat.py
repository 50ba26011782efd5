"""Flat binary rasters: one data source for every format whose pixels lie in a regular file.

A format module reads a header into layouts (file, offset, type, size, interleave); partitions are row
ranges of a layout, and column ranges where a row is long, so a read never loads a file or a long row whole, and
filters on y select rows before any byte is read. Paths must be visible to all executors.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..raster import Raster


@dataclass
class Layout:
    """Where the pixels of some channels lie: channel c, row y, column x of a file."""

    path: str
    dtype: str
    ny: int
    nx: int
    channels: int = 1
    offset: int = 0
    interleave: str = "bsq"  # bsq: channel planes; bil: lines of channels; bip: pixels of channels
    first_channel: int = 0
    first_row: int = 0
    y0: int = 0
    y1: int = 0
    x0: int = 0
    x1: int = 0

    def __post_init__(self):
        self.y1, self.x1 = self.y1 or self.ny, self.x1 or self.nx

    def rows(self, a: int, b: int, x0: int | None = None, x1: int | None = None) -> np.ndarray:
        """(channels, rows, columns) of the file's rows a..b-1, cropped in x, or of its columns x0..x1-1; several rows are
        read with all their columns."""
        x0, x1 = self.x0 if x0 is None else x0, self.x1 if x1 is None else x1
        t = np.dtype(self.dtype)
        c, n = self.channels, b - a
        lo, w = (x0, x1 - x0) if n == 1 else (0, self.nx)  # what is read of each row
        with open(self.path, "rb") as f:

            def values(at: int, size: int) -> np.ndarray:
                f.seek(self.offset + at * t.itemsize)
                return np.frombuffer(f.read(size * t.itemsize), t)

            if self.interleave == "bip":
                out = values((a * self.nx + lo) * c, n * w * c).reshape(n, w, c).transpose(2, 0, 1)
            elif self.interleave == "bil" and n > 1:
                out = values(a * self.nx * c, n * w * c).reshape(n, c, w).transpose(1, 0, 2)
            else:
                line = (lambda k: k * self.ny + a) if self.interleave == "bsq" else (lambda k: a * c + k)
                out = np.stack([values(line(k) * self.nx + lo, n * w).reshape(n, w) for k in range(c)])
        return out[:, :, x0 - lo : x1 - lo]


@dataclass
class Band(InputPartition):
    layout: int
    start: int
    stop: int
    x0: int = 0
    x1: int = 0


#: Bytes of file that a partition has and values that a batch has, about.
PARTITION, BATCH = 16 << 20, 200_000


class FlatReader(DataSourceReader):
    def __init__(self, options: dict):
        self.layouts = [Layout(**x) for x in json.loads(options["layouts"])]
        self.per = int(options.get("rows", 0))
        self.low, self.high = 0, 2**62

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == ("y",) and isinstance(getattr(f, "value", None), int):
                v = f.value
                if isinstance(f, EqualTo):
                    self.low, self.high = max(self.low, v), min(self.high, v)
                elif isinstance(f, GreaterThan):
                    self.low = max(self.low, v + 1)
                elif isinstance(f, GreaterThanOrEqual):
                    self.low = max(self.low, v)
                elif isinstance(f, LessThan):
                    self.high = min(self.high, v - 1)
                elif isinstance(f, LessThanOrEqual):
                    self.high = min(self.high, v)
                else:
                    yield f
            else:
                yield f

    def partitions(self) -> list[Band]:
        out = []
        for i, x in enumerate(self.layouts):
            pixel = np.dtype(x.dtype).itemsize * x.channels
            per = self.per or max(1, PARTITION // max(1, pixel * x.nx))
            wide = max(1, PARTITION // pixel) if per == 1 else max(1, x.x1 - x.x0)
            lo = max(x.y0, self.low - x.first_row + x.y0)
            hi = min(x.y1, self.high + 1 - x.first_row + x.y0)
            out += [Band(i, a, min(a + per, hi), c, min(c + wide, x.x1)) for a in range(lo, hi, per) for c in range(x.x0, x.x1, wide)]
        return out or [Band(0, 0, 0)]

    def read(self, p: Band) -> Iterator[pa.RecordBatch]:
        x = self.layouts[p.layout]
        per = max(1, BATCH // max(1, x.nx * x.channels))
        wide = max(1, BATCH // x.channels) if per == 1 else max(1, p.x1 - p.x0)
        for a, x0 in ((a, c) for a in range(p.start, p.stop, per) for c in range(p.x0, p.x1, wide)):
            v = x.rows(a, min(a + per, p.stop), x0, min(x0 + wide, p.x1))
            c, i, j = (k.ravel() for k in np.indices(v.shape))
            v = v.ravel()
            re, im = (v.real, v.imag) if np.iscomplexobj(v) else (v, np.zeros(len(v)))
            re, im = (np.nan_to_num(k.astype(np.float64), nan=0.0, posinf=0.0, neginf=0.0) for k in (re, im))
            yield pa.RecordBatch.from_arrays([pa.array((c + x.first_channel).astype(np.int32)), pa.array((i + a - x.y0 + x.first_row).astype(np.int64)), pa.array((j + x0 - x.x0).astype(np.int64)), pa.array(re), pa.array(im)], ["ch", "y", "x", "re", "im"])


class FlatSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "flatraster"

    def schema(self) -> str:
        return "ch int, y long, x long, re double, im double"

    def reader(self, schema) -> FlatReader:
        return FlatReader(self.options)


def load(spark: SparkSession, layouts: list[Layout], meta: dict | None = None, rows: int = 0, lshape: tuple[int, ...] | None = None) -> Raster:
    """A lazy raster over the layouts; switches on filter pushdown for Python sources in the session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FlatSource)
    reader = spark.read.format("flatraster").option("layouts", json.dumps([asdict(x) for x in layouts]))
    df: DataFrame = (reader.option("rows", rows) if rows else reader).load()
    ny = max(x.first_row + x.y1 - x.y0 for x in layouts)
    nx = max(x.x1 - x.x0 for x in layouts)
    n = max(x.first_channel + x.channels for x in layouts)
    is_complex = any(np.dtype(x.dtype).kind == "c" for x in layouts)
    if lshape is None:
        lshape = (n,) if n > 1 else ()
    if not lshape:
        df = df.drop("ch")
    return Raster(df if is_complex else df.drop("im"), ny, nx, lshape, "long", is_complex, meta or {})


def write(r: Raster, path: str, dtype: str, offset: int = 0, pixels: int = 250_000) -> None:
    """Channel planes into one file on a shared folder: tasks own bands of rows, or stretches of long rows, of ``pixels``
    values at most (or a pixel's channels) and write them at their offsets.

    Writing the same bytes twice is harmless, so a retried task is too.
    """
    r = r.long()
    t, n, ny, nx = np.dtype(dtype), r.channels, r.ny, r.nx
    with open(path, "r+b" if os.path.exists(path) else "w+b") as f:
        f.truncate(offset + n * ny * nx * t.itemsize)
    per = max(1, pixels // (nx * n))  # rows and columns that a task holds
    wide = min(nx, max(1, pixels // n)) if per == 1 else nx
    from pyspark.sql import functions as F

    cols = ["re", "im"] if r.complex else ["re"]
    ch = F.col("ch") if r.keys else F.lit(0).alias("ch")

    def put(p: pa.Table) -> pa.Table:
        v = {k: p.column(k).to_numpy() for k in ("ch", "y", "x", *cols)}
        y0, x0 = int(v["y"].min()) // per * per, int(v["x"].min()) // wide * wide
        block = np.zeros((n, min(per, ny - y0), min(wide, nx - x0)), complex if "im" in v else float)
        block[v["ch"], v["y"] - y0, v["x"] - x0] = v["re"] + (1j * v["im"] if "im" in v else 0)
        block = block.astype(t) if t.kind in "fc" else np.rint(block.real).astype(t)
        with open(path, "r+b") as f:
            for c in range(n):
                f.seek(offset + ((c * ny + y0) * nx + x0) * t.itemsize)
                f.write(block[c].tobytes())
        return pa.table({"y": pa.array([], pa.int64())})

    spots = F.floor(F.col("y") / per).alias("band"), F.floor(F.col("x") / wide).alias("stretch")
    r.df.select(ch, "y", "x", *cols).groupBy(*spots).applyInArrow(put, "y long").count()
