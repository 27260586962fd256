"""Reading the engine's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``; any path that Spark can read."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Readers by the end of a file's or folder's name; what has another end is CSV.
ENDS = {"parquet": "parquet", "json": "json", "jsonl": "json", "orc": "orc"}


def frame(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """A table of the format that its name tells. Without a schema, CSV and JSON files are read once more to infer one."""
    kind = ENDS.get(path.rstrip("/").rpartition(".")[2].lower(), "csv")
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "csv":
        reader = reader.option("header", "true").option("inferSchema", str(schema is None).lower())
    return reader.format(kind).load(path)
