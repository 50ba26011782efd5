"""Blocked rasters: a row per tile with all its pixels as one binary plane, and windows that exchange halo strips only.

A raster in LONG or PIX form has a row per pixel, and every window moves every row once an axis. Here a tile stays where it is:
tables of tiles are bucketed by tile, so a scan has the partitioning that a join by tile needs, and an operator shuffles
only what its window reads across the borders of tiles, a few pixels of each side. Kernels are Arrow functions of a
tile and its strips. Bucketed tables are written to the shared folder, which also cuts lineage and survives lost
executors; the last result of a chain need not be written.

``blocked`` costs one exchange of pixels, ``generated`` none, ``pixels`` none. Image borders mirror. Windows reach no
further than a tile is wide or high.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import bucketed
from .raster import Raster
from .tiles import mirror

Tile = tuple[int, int]
STRIP = "array<struct<ty:int,tx:int,dy:int,dx:int,part:binary>>"


@dataclass(frozen=True)
class Blocks:
    """df has (ty, tx, data): data holds float64 or complex128 values of (channels, rows, columns) of a tile."""

    df: DataFrame
    ny: int
    nx: int
    tile: Tile
    lshape: tuple[int, ...] = ()
    complex: bool = False
    meta: dict = field(default_factory=dict)
    buckets: int = 0  # 0: not written, so not partitioned by tile

    @property
    def channels(self) -> int:
        return int(np.prod(self.lshape)) if self.lshape else 1

    @property
    def kind(self) -> np.dtype:
        return np.dtype(complex if self.complex else float)

    @property
    def shape(self) -> Callable[[int, int], tuple[int, int]]:
        """Rows and columns of a tile: a function for workers."""
        ny, nx, (th, tw) = self.ny, self.nx, self.tile
        return lambda ty, tx: (min(th, ny - ty * th), min(tw, nx - tx * tw))

    def written(self) -> Blocks:
        """Written to a table bucketed by tile, so that windows need not move tiles; as it is if that was done."""
        if self.buckets:
            return self
        n = _buckets(self.df.sparkSession, self.ny, self.nx, self.tile)
        return replace(self, df=bucketed(self.df, n, "ty", "tx"), buckets=n)

    def pixels(self) -> Raster:
        """The raster in LONG form; every tile unfolds in place."""
        th, tw = self.tile
        kind, keyed, shape, is_complex = self.kind, bool(self.lshape), self.shape, self.complex

        def run(batches):
            for b in batches:
                for ty, tx, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                    h, w = shape(ty, tx)
                    a = np.frombuffer(data.as_buffer(), kind).reshape(-1, h, w)
                    for k, plane in enumerate(a):
                        y, x = np.indices(plane.shape)
                        cols = {"ch": np.full(plane.size, k, "int32")} if keyed else {}
                        cols |= {"y": y.ravel() + ty * th, "x": x.ravel() + tx * tw, "re": plane.real.ravel()}
                        if is_complex:
                            cols["im"] = plane.imag.ravel()
                        yield pa.RecordBatch.from_pydict({c: pa.array(np.ascontiguousarray(v)) for c, v in cols.items()})

        schema = "ch int, " * keyed + "y long, x long, re double" + ", im double" * is_complex
        return Raster(self.df.select("ty", "tx", "data").mapInArrow(run, schema), self.ny, self.nx, self.lshape, "long", self.complex, self.meta)


def _buckets(spark: SparkSession, ny: int, nx: int, tile: Tile) -> int:
    """Some 64 tiles a task, as many tasks as the session shuffles to at least."""
    tiles = -(-ny // tile[0]) * -(-nx // tile[1])
    return int(min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), tiles // 64), max(1, tiles), 100_000))


def blocked(r: Raster, tile: Tile = (256, 256)) -> Blocks:
    """Tiles of a raster: pixels meet once, by tile."""
    r = r.long()
    (th, tw), ny, nx, n, is_complex = tile, r.ny, r.nx, r.channels, r.complex
    ch = F.col("ch") if r.keys else F.lit(0)
    value = ["re", "im"] if is_complex else ["re"]
    df = r.df.select(ch.cast("int").alias("ch"), "y", "x", *value, F.floor(F.col("y") / th).cast("int").alias("ty"), F.floor(F.col("x") / tw).cast("int").alias("tx"))

    def run(p: pa.Table) -> pa.Table:
        col = lambda c: p.column(c).to_numpy()
        ty, tx = p.column("ty")[0].as_py(), p.column("tx")[0].as_py()
        a = np.zeros((n, min(th, ny - ty * th), min(tw, nx - tx * tw)), complex if is_complex else float)
        a[col("ch"), col("y") - ty * th, col("x") - tx * tw] = col("re") + 1j * col("im") if is_complex else col("re")
        return pa.table({"ty": pa.array([ty], pa.int32()), "tx": pa.array([tx], pa.int32()), "data": pa.array([a.tobytes()], pa.binary())})

    out = df.groupBy("ty", "tx").applyInArrow(run, "ty int, tx int, data binary")
    return Blocks(out, ny, nx, tile, r.lshape, is_complex, r.meta)


def generated(spark: SparkSession, ny: int, nx: int, value: Callable[[Column, Column], Column], tile: Tile = (256, 256)) -> Blocks:
    """A blocked raster from an expression of y and x, tile by tile: pixels are never rows."""
    th, tw = tile
    across = -(-nx // tw)
    n = _buckets(spark, ny, nx, tile)
    ids = spark.range(-(-ny // th) * across)
    df = ids.select(F.floor(F.col("id") / across).cast("int").alias("ty"), (F.col("id") % across).cast("int").alias("tx")).repartition(n, "ty", "tx")
    span = lambda t, size, full: F.sequence(t.cast("long") * size, F.least(F.lit(full), (t.cast("long") + 1) * size) - 1)
    rows, cols = span(F.col("ty"), th, ny), span(F.col("tx"), tw, nx)
    flat = F.flatten(F.transform(rows, lambda y: F.transform(cols, lambda x: value(y, x).cast("double"))))

    def packed(batches):
        for b in batches:
            v = b.column(2)
            # An array column's values lie together already: each row is a stretch of them.
            values, cuts = v.values.to_numpy(zero_copy_only=False), v.offsets.to_numpy()
            data = pa.array([values[s:e].tobytes() for s, e in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), data], ["ty", "tx", "data"])

    tiles = df.select("ty", "tx", flat.alias("v")).mapInArrow(packed, "ty int, tx int, data binary")
    return Blocks(tiles, ny, nx, tile)


def _strips(b: Blocks, halo: Tile) -> DataFrame:
    """(ty, tx, strips): what the eight neighbours of each tile hold of its halo; this alone is shuffled."""
    (hy, hx), (th, tw), kind, shape = halo, b.tile, b.kind, b.shape
    last = (-(-b.ny // th) - 1, -(-b.nx // tw) - 1)

    def part(a: np.ndarray, dy: int, dx: int) -> bytes:
        # What lies towards the neighbour: its halo on the side where this tile is.
        y = slice(0, hy) if dy < 0 else slice(a.shape[1] - min(hy, a.shape[1]), None) if dy > 0 else slice(None)
        x = slice(0, hx) if dx < 0 else slice(a.shape[2] - min(hx, a.shape[2]), None) if dx > 0 else slice(None)
        return np.ascontiguousarray(a[:, y, x]).tobytes()

    @F.arrow_udf(STRIP)
    def cut(ty: pa.Array, tx: pa.Array, data: pa.Array) -> pa.Array:
        out = []
        for i, j, d in zip(ty.to_pylist(), tx.to_pylist(), data, strict=True):
            a = np.frombuffer(d.as_buffer(), kind).reshape(-1, *shape(i, j))
            steps = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy or dx) and (hy or not dy) and (hx or not dx) and 0 <= i + dy <= last[0] and 0 <= j + dx <= last[1]]
            out.append([{"ty": i + dy, "tx": j + dx, "dy": -dy, "dx": -dx, "part": part(a, dy, dx)} for dy, dx in steps])
        return pa.array(out, pa.list_(pa.struct([("ty", pa.int32()), ("tx", pa.int32()), ("dy", pa.int32()), ("dx", pa.int32()), ("part", pa.binary())])))

    sent = b.df.select(F.explode(cut("ty", "tx", "data")).alias("s")).select("s.*").repartition(b.buckets, "ty", "tx")
    return sent.groupBy("ty", "tx").agg(F.collect_list(F.struct("dy", "dx", "part")).alias("strips"))  # eight at most


def map_blocks(b: Blocks, halo: Tile, kernel: Callable[..., np.ndarray], lshape: tuple[int, ...] | None = None, out_complex: bool | None = None, located: bool = False) -> Blocks:
    """Apply kernel to each tile and its halo, and keep the tile.

    kernel gets (channels, rows + 2 * halo, columns + 2 * halo), with ``located`` also the rows and columns of that block
    in the image, and returns (channels, rows, columns): what its tile becomes. Borders of the image mirror.
    """
    (hy, hx), (th, tw) = halo, b.tile
    if hy > th or hx > tw:
        raise ValueError("the window reaches over more than the next tile")
    if not (hy or hx):
        df = b.df.withColumn("strips", F.array().cast("array<struct<dy:int,dx:int,part:binary>>"))
    else:
        b = b.written()
        df = b.df.join(_strips(b, halo).hint("shuffle_hash"), ["ty", "tx"], "left")
    ny, nx, kind, shape = b.ny, b.nx, b.kind, b.shape
    out_kind = np.dtype(complex if (b.complex if out_complex is None else out_complex) else float)

    @F.arrow_udf("binary")
    def run(ty: pa.Array, tx: pa.Array, data: pa.Array, strips: pa.Array) -> pa.Array:
        out = []
        for i, j, d, around in zip(ty.to_pylist(), tx.to_pylist(), data, strips, strict=True):
            h, w = shape(i, j)
            core = np.frombuffer(d.as_buffer(), kind).reshape(-1, h, w)
            block = np.zeros((len(core), h + 2 * hy, w + 2 * hx), kind)
            block[:, hy : hy + h, hx : hx + w] = core
            for s in around if around.is_valid else ():
                dy, dx = s["dy"].as_py(), s["dx"].as_py()
                nh, nw = shape(i + dy, j + dx)
                a = np.frombuffer(s["part"].as_buffer(), kind).reshape(len(core), min(hy, nh) if dy else h, min(hx, nw) if dx else w)
                y = hy - a.shape[1] if dy < 0 else hy + h if dy > 0 else hy
                x = hx - a.shape[2] if dx < 0 else hx + w if dx > 0 else hx
                block[:, y : y + a.shape[1], x : x + a.shape[2]] = a
            yy, xx = np.arange(i * th - hy, i * th + h + hy), np.arange(j * tw - hx, j * tw + w + hx)
            my, mx = mirror(yy, ny) - yy[0], mirror(xx, nx) - xx[0]
            if (my != np.arange(len(yy))).any() or (mx != np.arange(len(xx))).any():
                block = block[:, np.clip(my, 0, len(yy) - 1)][:, :, np.clip(mx, 0, len(xx) - 1)]
            res = kernel(block, yy, xx) if located else kernel(block)
            out.append(np.ascontiguousarray(res, out_kind).tobytes())
        return pa.array(out, pa.binary())

    done = df.select("ty", "tx", run("ty", "tx", "data", "strips").alias("data"))
    return replace(b, df=done, buckets=0, complex=out_kind.kind == "c", lshape=b.lshape if lshape is None else lshape)


# --- windows ---------------------------------------------------------------------------------------------


def box(a: np.ndarray, win: Tile) -> np.ndarray:
    """Means over a window by running sums, without the rim; an even size s starts s // 2 before its pixel."""
    for axis, s in ((-2, win[0]), (-1, win[1])):
        if s > 1:
            c = np.cumsum(np.concatenate([np.zeros_like(a.take([0], axis)), a], axis), axis)
            n = a.shape[axis] - s + 1
            a = (c.take(range(s, s + n), axis) - c.take(range(n), axis)) / s
    return a


def _reach(win: Tile) -> Tile:
    return win[0] // 2, win[1] // 2


def _fit(win: Tile) -> Callable[[np.ndarray], np.ndarray]:
    """Of a window of even size the halo holds one row or column more than is read."""
    return lambda a: a[:, : a.shape[1] - (win[0] % 2 == 0), : a.shape[2] - (win[1] % 2 == 0)]


def box_mean(b: Blocks, win: Tile = (7, 7)) -> Blocks:
    fit = _fit(win)
    return map_blocks(b, _reach(win), lambda a: box(fit(np.nan_to_num(a, nan=0.0, posinf=np.inf, neginf=-np.inf)), win))


def lee(b: Blocks, win: Tile = (7, 7), looks: float = 1.0) -> Blocks:
    """Lee's filter: the gain follows the power of all channels, or the trace of a matrix."""
    (hy, hx), n, fit = _reach(win), (b.lshape[0] if len(b.lshape) == 2 else 0), _fit(win)

    def kernel(a):
        a = np.nan_to_num(a, nan=0.0, posinf=np.inf, neginf=-np.inf)
        a = a if n else np.abs(a)
        span = np.abs(a[[i * n + i for i in range(n)]].sum(0)) if n else (a * a).sum(0)
        m, m2 = box(fit(np.stack([span, span * span])), win)
        var = np.maximum(m2 - m * m, 1e-10)
        gain = np.maximum((var - m * m / looks) / (1 + 1 / looks), 0) / var
        mean = box(fit(a), win)
        return mean + gain * (a[:, hy : hy + mean.shape[1], hx : hx + mean.shape[2]] - mean)

    return map_blocks(b, (hy, hx), kernel, out_complex=bool(n) and b.complex)


def median(b: Blocks, win: Tile = (3, 3)) -> Blocks:
    """Median of real and imaginary parts, the upper of the middle for even counts."""
    fit = _fit(win)

    def one(p):
        v = np.lib.stride_tricks.sliding_window_view(p, win).reshape(p.shape[0] - win[0] + 1, p.shape[1] - win[1] + 1, -1)
        return np.partition(v, v.shape[-1] // 2, axis=-1)[..., v.shape[-1] // 2]

    return map_blocks(b, _reach(win), lambda a: np.stack([one(c.real) + 1j * one(c.imag) if np.iscomplexobj(c) else one(c) for c in fit(np.nan_to_num(a))]))
