"""Rasters: a DataFrame of pixels with its size and metadata.

Two forms. LONG has columns ``[ch,] y, x, re[, im]``, one row per channel and pixel. PIX has ``y, x`` and
arrays ``re, im`` of all channels of a pixel, matrices flattened row by row. All values are doubles.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Raster:
    df: DataFrame
    ny: int
    nx: int
    lshape: tuple[int, ...] = ()
    form: str = "long"
    complex: bool = False
    meta: dict = field(default_factory=dict)

    @property
    def channels(self) -> int:
        return int(np.prod(self.lshape)) if self.lshape else 1

    @property
    def keys(self) -> list[str]:
        return ["ch"] if "ch" in self.df.columns else []

    def with_df(self, df: DataFrame, **changes) -> Raster:
        return replace(self, df=df, **changes)

    def long(self) -> Raster:
        """One row per channel and pixel."""
        if self.form == "long":
            return self
        arrays = F.arrays_zip("re", "im") if self.complex else F.arrays_zip("re")
        df = self.df.select("y", "x", F.posexplode(arrays).alias("ch", "v"))
        values = ["v.re", "v.im"] if self.complex else ["v.re"]
        return self.with_df(df.select("ch", "y", "x", *values), form="long")

    def pix(self) -> Raster:
        """One row per pixel with all its channels in order; needs one shuffle on (y, x)."""
        if self.form == "pix":
            return self
        if not self.keys:
            values = [F.array(c).alias(c) for c in (("re", "im") if self.complex else ("re",))]
            return self.with_df(self.df.select("y", "x", *values), form="pix", lshape=self.lshape or (1,))
        values = ("re", "im") if self.complex else ("re",)
        # A pixel has as many rows as channels, a small fixed number.
        all_ = F.sort_array(F.collect_list(F.struct("ch", *values))).alias("v")
        df = self.df.groupBy("y", "x").agg(all_).select("y", "x", *[F.col(f"v.{c}").alias(c) for c in values])
        return self.with_df(df, form="pix")

    def to_numpy(self, most: int = 64_000_000) -> np.ndarray:
        """The whole image on the driver: for small results only, of ``most`` values at most."""
        if self.channels * self.ny * self.nx > most:
            raise ValueError(f"{self.channels} x {self.ny} x {self.nx} values are more than {most}: write the image, or crop it")
        r = self.long()
        pdf = r.df.toPandas()
        out = np.zeros((r.channels, r.ny, r.nx), complex if r.complex else float)
        ch = pdf["ch"].to_numpy() if "ch" in pdf else np.zeros(len(pdf), int)
        v = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy() if r.complex else pdf["re"].to_numpy()
        out[ch, pdf["y"].to_numpy(), pdf["x"].to_numpy()] = v
        return out.reshape(*r.lshape, r.ny, r.nx)


def from_numpy(spark: SparkSession, a: np.ndarray, meta: dict | None = None) -> Raster:
    """A raster of an array (..., rows, columns)."""
    lshape, (ny, nx) = a.shape[:-2], a.shape[-2:]
    flat = a.reshape(-1, ny, nx)
    ch, y, x = (i.ravel() for i in np.indices(flat.shape))
    import pandas as pd

    cols = {"ch": ch.astype("int32")} if lshape else {}
    cols |= {"y": y.astype("int64"), "x": x.astype("int64"), "re": flat.real.ravel().astype(float)}
    if np.iscomplexobj(a):
        cols["im"] = flat.imag.ravel().astype(float)
    return Raster(spark.createDataFrame(pd.DataFrame(cols)), ny, nx, lshape, "long", np.iscomplexobj(a), meta or {})


def generate(spark: SparkSession, ny: int, nx: int, value) -> Raster:
    """A raster from an expression of y and x, block-wise and without driver data."""
    df = spark.range(ny * nx).select(F.floor(F.col("id") / nx).alias("y"), (F.col("id") % nx).alias("x"))
    return Raster(df.withColumn("re", value(F.col("y"), F.col("x")).cast("double")), ny, nx)
