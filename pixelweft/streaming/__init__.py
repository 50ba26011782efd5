"""Point-wise operators over streamed row bands: they keep no state, so the batch code applies as it is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..raster import Raster


def row_bands(spark: SparkSession, folder: str, like: Raster) -> Raster:
    """A raster whose pixels arrive as Parquet files in a folder."""
    return like.with_df(spark.readStream.schema(like.df.schema).parquet(folder))


def run(r: Raster, op: Callable[[Raster], Raster], target: str, checkpoint: str) -> StreamingQuery:
    """Apply op to every arriving band and append to a folder; ends when what is there is done."""
    return op(r).df.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
