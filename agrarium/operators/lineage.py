"""Cutting a plan's lineage by a table in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def saved(df: DataFrame) -> DataFrame:
    """``df`` as a table written once to the shared folder, so that it survives lost executors and isn't computed twice."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of this name in the shared folder; what is written there goes with ``clear_saved``."""
    path = f"{shared_folder(spark)}/{name}"
    _written.append(path)
    return path


def shared_folder(spark: SparkSession) -> str:
    """That of spark.checkpoint.dir, else the context's checkpoint folder; a folder of this machine only where all of Spark runs on it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        return _own_folder()
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def clear_saved(spark: SparkSession) -> int:
    """Deletes the tables and folders that ``saved`` and ``scratch`` have named in this process, and returns how many; results that still read them are gone with them."""
    files = spark._jvm.org.apache.hadoop.fs
    deleted = 0
    while _written:
        path = files.Path(_written.pop())
        deleted += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return deleted


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-")
