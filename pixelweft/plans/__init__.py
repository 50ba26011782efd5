"""Cutting long lineages by a checkpointed copy in the shared folder; that folder's path for flat files."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The mounted folder of spark.checkpoint.dir, for flat files; a temporary one only for a session in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        if "://" in root and not root.startswith("file://"):
            raise RuntimeError("flat files need spark.checkpoint.dir on a mounted folder")
        return root.removeprefix("file://").removeprefix("file:")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="pixelweft-"))
    return _own[0]


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in spark.checkpoint.dir. Only a session in one process may do without the setting."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and not sc._jsc.sc().getCheckpointDir().isDefined():
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="pixelweft-"))
    return df.checkpoint()


_tables: dict[str, SparkSession] = {}


def bucketed(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """df written to a table of n buckets by keys in the shared folder: scans of it have that partitioning, joins by the keys
    move only the other side. The table goes with the process, or by ``drop``."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or "file://" + shared_folder(spark)
    name = f"pixelweft_{uuid.uuid4().hex}"
    path = f"{root.rstrip('/')}/{name}"
    df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(n, *keys).saveAsTable(name)
    if not _tables:
        atexit.register(drop)
    _tables[name] = spark
    return spark.table(name)


def drop(*names: str) -> None:
    """Drop bucketed tables and their files; all of this process without names."""
    for name in names or tuple(_tables):
        spark = _tables.pop(name, None)
        try:
            path = spark.sql(f"describe formatted {name}").where("col_name = 'Location'").first()[1]
            spark.sql(f"drop table if exists {name}")
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001, S112  the session may be gone at exit
            continue
