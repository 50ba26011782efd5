"""Tiles with halos, whole lines and overlapping patches: where numpy kernels over Arrow batches are needed.

A tile's pixels and the halo around it are gathered by one exchange: each pixel is sent to its own tile and
to the neighbours whose halo it lies in. Tile size bounds what a task holds, whatever the image size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .raster import Raster


def mirror(t: np.ndarray, n: int) -> np.ndarray:
    m = np.mod(t, 2 * n)
    return np.where(m < n, m, 2 * n - 1 - m)


def _columns(p: pa.Table) -> dict[str, np.ndarray]:
    return {name: p.column(name).to_numpy() for name in p.column_names}


def map_tiles(r: Raster, halo: tuple[int, int], kernel: Callable[[np.ndarray], np.ndarray], tile: tuple[int, int] = (128, 512), out_channels: int | None = None, together: bool = False, border: str = "reflect", located: bool = False) -> Raster:
    """Apply kernel to haloed blocks and keep the core.

    kernel gets (channels, rows + 2 * halo, columns + 2 * halo) and returns (out channels, same rows and
    columns); border pixels are mirrored (``reflect``) or 0 (``zero``). Channels are tiles of their own
    unless ``together``; then PIX rasters travel and stay as rows of pixels. With ``located`` the kernel also gets the rows
    and the columns of its block in the image, which are outside it in the border.
    """
    packed = together and r.form == "pix" and out_channels is None
    r = r if packed else r.long()
    keys = r.keys
    df, ny, nx, (hy, hx) = r.df, r.ny, r.nx, halo
    group = keys if keys and not together else []
    is_complex, n_ch = r.complex, (r.channels if packed or together and keys else 1)

    def reach(axis: str, n: int, h: int, size: int):
        i = F.col(axis)
        last = (n - 1) // size
        near = F.sequence(F.greatest(F.lit(0), F.floor((i - h) / size).cast("int")), F.least(F.lit(last), F.floor((i + h) / size).cast("int")))
        return near

    value = ["re", "im"] if is_complex else ["re"]
    ch = [] if packed else [(F.col("ch") if keys else F.lit(0)).cast("int").alias("ch")]
    df = df.select(*ch, "y", "x", *value, F.explode(reach("y", ny, hy, tile[0])).alias("ty"))
    df = df.select("*", F.explode(reach("x", nx, hx, tile[1])).alias("tx"))

    def run(p: pa.Table) -> pa.Table:
        lists = {k: pc.list_flatten(p.column(k)).to_numpy().reshape(-1, n_ch).T for k in value} if packed else {}
        p = _columns(p.drop_columns(list(lists))) | lists
        ty, tx, c0 = int(p["ty"][0]), int(p["tx"][0]), 0 if not group else int(p["ch"][0])
        y0, x0 = ty * tile[0], tx * tile[1]
        h, w = min(tile[0], ny - y0), min(tile[1], nx - x0)
        yy, xx = np.arange(y0 - hy, y0 + h + hy), np.arange(x0 - hx, x0 + w + hx)
        block = np.zeros((n_ch, len(yy), len(xx)), complex if is_complex else float)
        channels = slice(None) if packed else p["ch"] - c0
        block[channels, p["y"] - yy[0], p["x"] - xx[0]] = p["re"] + 1j * p["im"] if is_complex else p["re"]
        if border == "reflect":
            my, mx = mirror(yy, ny) - yy[0], mirror(xx, nx) - xx[0]
            ok_y, ok_x = (my >= 0) & (my < len(yy)), (mx >= 0) & (mx < len(xx))
            block = block[:, np.where(ok_y, my, 0)][:, :, np.where(ok_x, mx, 0)]
        out = kernel(block, yy, xx) if located else kernel(block)
        out = out[:, hy : hy + h, hx : hx + w]
        if packed:
            i, j = (a.ravel() for a in np.indices(out.shape[1:]))
            ends = pa.array(np.arange(0, out.size + 1, len(out), dtype="int32"))
            parts = {"re": out.real, "im": out.imag} if out_complex else {"re": out.real}
            lists = {c: pa.ListArray.from_arrays(ends, pa.array(v.reshape(len(out), -1).T.ravel())) for c, v in parts.items()}
            return pa.table({"y": (i + y0).astype("int64"), "x": (j + x0).astype("int64")} | lists)
        k, i, j = (a.ravel() for a in np.indices(out.shape))
        res = {"ch": (k + c0).astype("int32"), "y": (i + y0).astype("int64"), "x": (j + x0).astype("int64"), "re": out.real.ravel().astype(float)}
        if out_complex:
            res["im"] = out.imag.ravel().astype(float)
        return pa.table(res)

    out_complex = is_complex if out_channels is None else False
    schema = "ch int, y long, x long, re double" + ", im double" * out_complex
    if packed:
        schema = "y long, x long, re array<double>" + ", im array<double>" * out_complex
    res = df.groupBy(*group, "ty", "tx").applyInArrow(run, schema)
    if packed:
        return r.with_df(res)
    if out_channels is not None and not group:
        lshape = (out_channels,) if out_channels > 1 else ()
    else:
        lshape = r.lshape
    if not lshape:
        res = res.drop("ch")
    return Raster(res, ny, nx, lshape, "long", out_complex, r.meta)


#: Pixels that a group of short lines holds; a longer line is a group of its own.
GROUP = 1 << 14


def map_lines(r: Raster, axis: str, kernel: Callable[[np.ndarray], np.ndarray], out_complex: bool | None = None, n_out: int | None = None, channel: bool = False) -> Raster:
    """Apply kernel to every whole line along an axis ("x": image rows); lines of one channel are grouped up to ``GROUP`` pixels.

    With ``channel`` the kernel also gets the number of the channel.
    """
    r = r.long()
    keys, other = r.keys, "y" if axis == "x" else "x"
    n = r.nx if axis == "x" else r.ny
    is_complex = r.complex
    out_complex = is_complex if out_complex is None else out_complex
    ch = F.col("ch") if keys else F.lit(0).alias("ch")
    df = r.df.select(ch, "y", "x", *(["re", "im"] if is_complex else ["re"])).withColumn("band", F.floor(F.col(other) / max(1, GROUP // n)))

    def run(p: pa.Table) -> pa.Table:
        p = _columns(p)
        lines, at = np.unique(p[other], return_inverse=True)
        a = np.zeros((len(lines), n), complex if is_complex else float)
        a[at, p[axis]] = p["re"] + 1j * p["im"] if is_complex else p["re"]
        out = kernel(a, int(p["ch"][0])) if channel else kernel(a)
        i, j = (k.ravel() for k in np.indices(out.shape))
        res = {"ch": np.full(len(i), int(p["ch"][0]), "int32"), other: lines[i], axis: j.astype("int64"), "re": out.real.ravel().astype(float)}
        if out_complex:
            res["im"] = out.imag.ravel().astype(float)
        return pa.table({k: res[k] for k in ("ch", "y", "x", "re", *(["im"] if out_complex else []))})

    res = df.groupBy("ch", "band").applyInArrow(run, "ch int, y long, x long, re double" + ", im double" * out_complex)
    if not keys:
        res = res.drop("ch")
    size = {} if n_out is None else ({"nx": n_out} if axis == "x" else {"ny": n_out})
    return r.with_df(res, complex=out_complex, **size)


def foreach_tile(r: Raster, f: Callable[[int, int, np.ndarray], None], tile: tuple[int, int] = (512, 512)) -> int:
    """Call f(row, column, block (channels, rows, columns)) once for each tile where it lies; the number of tiles.

    For exports: a task that is run again calls f again with the same block, so f must bear repetition.
    """
    return _by_tile(r, tile, lambda y, x, block: (f(y, x, block), 1.0)[1]).count()


def reduce_tiles(r: Raster, f: Callable[[np.ndarray], dict[str, float]], how: dict[str, str], tile: tuple[int, int] = (512, 512)) -> dict[str, float]:
    """Combine per-tile numbers f(block) by ``sum``, ``min`` or ``max``: one row a tile, combined before any shuffle."""
    names = sorted(how)
    parts = _by_tile(r, tile, lambda y, x, block: [float(f(block)[k]) for k in names])
    row = parts.agg(*[getattr(F, how[k])(F.get("v", F.lit(i))).alias(k) for i, k in enumerate(names)]).first()
    return row.asDict()


def _by_tile(r: Raster, tile: tuple[int, int], f: Callable) -> DataFrame:
    r = r.long()
    ny, nx, n, is_complex = r.ny, r.nx, r.channels, r.complex
    ch = F.col("ch") if r.keys else F.lit(0)
    df = r.df.select(ch.alias("ch"), "y", "x", *(["re", "im"] if is_complex else ["re"]), F.floor(F.col("y") / tile[0]).alias("ty"), F.floor(F.col("x") / tile[1]).alias("tx"))

    def run(p: pa.Table) -> pa.Table:
        p = _columns(p)
        y0, x0 = int(p["ty"][0]) * tile[0], int(p["tx"][0]) * tile[1]
        block = np.zeros((n, min(tile[0], ny - y0), min(tile[1], nx - x0)), complex if is_complex else float)
        block[p["ch"], p["y"] - y0, p["x"] - x0] = p["re"] + 1j * p["im"] if is_complex else p["re"]
        return pa.table({"v": pa.array([np.atleast_1d(f(y0, x0, block)).astype(float).tolist()], pa.list_(pa.float64()))})

    return df.groupBy("ty", "tx").applyInArrow(run, "v array<double>")


def patch_starts(n: int, size: int, step: int) -> list[tuple[int, int]]:
    """(start, times) of overlapping patches along an axis; the last is flush with the end.

    Where the regular grid already ends flush, the last patch counts twice.
    """
    if n <= size:
        return [(0, 1)]
    starts = list(range(0, n - size + 1, step))
    out = {s: 1 for s in starts}
    out[n - size] = out.get(n - size, 0) + 1
    return sorted(out.items())


def overlap_add(rasters: list[Raster], size: tuple[int, int], step: tuple[int, int], kernel: Callable[[list[np.ndarray]], np.ndarray], out_complex: bool = True) -> Raster:
    """Kernel over overlapping patches, put together with triangular weights.

    Inputs are joined on (y, x) first; every pixel goes to each patch that holds it, and weighted
    results are summed per pixel (partial sums before the shuffle).
    """
    first = rasters[0].long()
    ny, nx = first.ny, first.nx
    df = None
    for i, r in enumerate(rasters):
        r = r.long()
        d = r.df.select("y", "x", F.col("re").alias(f"re{i}"), (F.col("im") if r.complex else F.lit(0.0)).alias(f"im{i}"))
        df = d if df is None else df.join(d, ["y", "x"])
    bs = (min(size[0], ny), min(size[1], nx))
    grids = [patch_starts(n, b, s) for n, b, s in zip((ny, nx), bs, step, strict=True)]
    for axis, grid, b in (("y", grids[0], bs[0]), ("x", grids[1], bs[1])):
        regular = [s for s, _ in grid]
        stepping = step[0] if axis == "y" else step[1]
        i = F.col(axis)
        last = regular[-1]
        full = [s for s in regular if s % stepping == 0]
        lo = F.greatest(F.lit(0), F.ceil((i - (b - 1)) / F.lit(stepping)).cast("long"))
        hi = F.least(F.lit(full[-1] // stepping).cast("long"), F.floor(i / F.lit(stepping)).cast("long"))
        spots = F.when(lo <= hi, F.transform(F.sequence(lo, hi), lambda k: k * stepping)).otherwise(F.array().cast("array<bigint>"))
        spots = F.array_union(spots, F.when(i >= last, F.array(F.lit(last).cast("long"))).otherwise(F.array().cast("array<bigint>")))
        df = df.withColumn(f"p{axis}", F.explode(spots))
    n_in = len(rasters)
    twice = [{s: k for s, k in g} for g in grids]
    ramp = [np.concatenate([np.linspace(0.01, 1, (b + 1) // 2), np.linspace(0.01, 1, (b + 1) // 2)[::-1][b % 2 :]]) for b in bs]

    def run(p: pa.Table) -> pa.Table:
        p = _columns(p)
        py, px = int(p["py"][0]), int(p["px"][0])
        y, x = p["y"] - py, p["x"] - px
        blocks = []
        for i in range(n_in):
            a = np.zeros(bs, complex)
            a[y, x] = p[f"re{i}"] + 1j * p[f"im{i}"]
            blocks.append(a)
        out = kernel(blocks)
        w = np.outer(ramp[0], ramp[1]) * twice[0][py] * twice[1][px]
        i, j = (k.ravel() for k in np.indices(bs))
        return pa.table({"y": i + py, "x": j + px, "w": w.ravel(), "wr": (w * out.real).ravel(), "wi": (w * out.imag).ravel() if np.iscomplexobj(out) else np.zeros(len(i))})

    parts = df.groupBy("py", "px").applyInArrow(run, "y long, x long, w double, wr double, wi double")
    s = parts.groupBy("y", "x").agg(F.sum("w").alias("w"), F.sum("wr").alias("wr"), F.sum("wi").alias("wi"))
    cols = [(F.col("wr") / F.col("w")).alias("re")] + ([(F.col("wi") / F.col("w")).alias("im")] if out_complex else [])
    return Raster(s.select("y", "x", *cols), ny, nx, (), "long", out_complex, first.meta)
