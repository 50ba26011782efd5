"""A session's named rasters: active ones, metadata, saving as Parquet and JSON and loading again."""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import SparkSession

from .raster import Raster


class RasterCatalog:
    def __init__(self, spark: SparkSession):
        self.spark, self.layers, self.active, self._next = spark, {}, [], 1

    def add(self, r: Raster, name: str | None = None, view: bool = False) -> str:
        name = name or f"L{self._next}"
        self._next += 1
        self.layers[name] = r
        self.active = [name]
        if view:
            r.df.createOrReplaceTempView(name)
        return name

    def get(self, name: str | None = None) -> Raster:
        """A raster; ``name/Dk`` is channel k alone."""
        name = name or self.active[0]
        if "/D" in name:
            base, k = name.rsplit("/D", 1)
            r = self.layers[base].long()
            return r.with_df(r.df.where(f"ch = {int(k)}").drop("ch"), lshape=())
        return self.layers[name]

    def activate(self, *names: str) -> None:
        missing = [n for n in names if n not in self.layers]
        if missing:
            raise KeyError(missing)
        self.active = list(names)

    def drop(self, name: str) -> None:
        del self.layers[name]
        self.active = [n for n in self.active if n != name]

    def rename(self, old: str, new: str) -> None:
        self.layers[new] = self.layers.pop(old)
        self.active = [new if n == old else n for n in self.active]

    def describe(self, name: str | None = None) -> dict:
        r = self.get(name)
        return {"shape": (*r.lshape, r.ny, r.nx), "ndim": len(r.lshape) + 2, "dtype": "complex" if r.complex else "double", "form": r.form, "meta": r.meta}

    def list(self) -> dict[str, tuple[int, ...]]:
        return {n: (*r.lshape, r.ny, r.nx) for n, r in self.layers.items()}

    def meta(self, name: str | None = None) -> dict:
        return dict(self.get(name).meta)

    def set_meta(self, values: dict, name: str | None = None, channel: int | None = None) -> None:
        """Add metadata; with a channel, keys that start with CH_ set that element of a list."""
        name = name or self.active[0]
        r = self.layers[name]
        meta = dict(r.meta)
        for k, v in values.items():
            if channel is not None and k.startswith("CH_"):
                row = list(meta.get(k, [None] * r.channels))
                row[channel] = v
                v = row
            meta[k] = v
        self.layers[name] = replace(r, meta=meta)

    def save(self, folder: str) -> None:
        """Parquet partitioned by row band, and one JSON text; nothing executable is stored. Any folder that Spark can write."""
        from pyspark.sql import functions as F

        index = {}
        for name, r in self.layers.items():
            r.df.withColumn("band", F.floor(F.col("y") / 512)).write.mode("overwrite").partitionBy("band").parquet(f"{folder}/{name}.parquet")
            index[name] = {"ny": r.ny, "nx": r.nx, "lshape": list(r.lshape), "form": r.form, "complex": r.complex, "meta": r.meta}
        text = json.dumps({"layers": index, "active": self.active}, default=str)
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/catalog.json")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> RasterCatalog:
        out = cls(spark)
        index = json.loads(spark.read.text(f"{folder}/catalog.json", wholetext=True).first()[0])
        for name, x in index["layers"].items():
            df = spark.read.parquet(f"{folder}/{name}.parquet").drop("band")
            out.layers[name] = Raster(df, x["ny"], x["nx"], tuple(x["lshape"]), x["form"], x["complex"], x["meta"])
        out.active = index["active"]
        return out
