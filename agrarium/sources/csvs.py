"""CSV tables: discovery, encoding, scans, previews, streams, catalogs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Byte order marks, longest first.
MARKS = ((b"\xff\xfe\x00\x00", "UTF-32LE"), (b"\x00\x00\xfe\xff", "UTF-32BE"), (b"\xef\xbb\xbf", "UTF-8"), (b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE"))


def discover(spark: SparkSession, root: str, pattern: str = "*.{csv,txt}") -> DataFrame:
    """(path, name, length, modified) of the files below ``root``, by path; their content isn't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    name = F.regexp_extract("path", r"([^/]+?)\.[^./]+$", 1)
    return files.select("path", name.alias("name"), "length", F.col("modificationTime").alias("modified")).orderBy("path")


def encoding_of(spark: SparkSession, path: str, most: int = 1 << 16) -> str:
    """By byte order mark, else UTF-8 if the head is valid, else Latin-1; Spark reads the head."""
    head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, most).alias("head")).first()
    raw = bytes(head["head"]) if head else b""
    for bom, name in MARKS:
        if raw.startswith(bom):
            return name
    try:
        raw.decode("utf-8")
    except UnicodeDecodeError as e:
        # A character cut off at the end of a full head is no error.
        return "UTF-8" if len(raw) == most and e.start >= most - 3 else "ISO-8859-1"
    return "UTF-8"


def scan(spark: SparkSession, path: str | list[str], schema: str | T.StructType | None = None, columns: list[str] | None = None, encoding: str = "UTF-8", types: dict[str, str] | None = None) -> DataFrame:
    """A CSV table with its header; without a schema all columns are strings, ``types`` casts some (what can't be cast is null)."""
    reader = spark.read.option("header", "true").option("encoding", encoding)
    df = (reader.schema(schema) if schema else reader).csv(path)
    df = df.select(*columns) if columns else df
    return df.withColumns({c: F.col(f"`{c}`").try_cast(kind) for c, kind in (types or {}).items()})


def preview(df: DataFrame, rows: int = 5) -> list[Row]:
    return df.take(rows)


def stream(df: DataFrame) -> Iterator[Row]:
    """Rows one partition at a time, the next one prefetched."""
    return df.toLocalIterator(prefetchPartitions=True)


def register(spark: SparkSession, root: str, pattern: str = "*.csv") -> list[str]:
    """A temporary view for each file below ``root``, named by its stem."""
    names = []
    for r in discover(spark, root, pattern).collect():
        scan(spark, r["path"]).createOrReplaceTempView(r["name"])
        names.append(r["name"])
    return names


def widest(tables: dict[str, DataFrame]) -> str:
    """The name of the table with the most columns, the first of equals."""
    return max(tables, key=lambda n: (len(tables[n].columns), -list(tables).index(n)))


def tree_signature(files: DataFrame) -> DataFrame:
    """(files, bytes, newest): changes when a file of the listing does."""
    return files.agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.max("modified").alias("newest"))


def points(df: DataFrame, name: str, lat: str, lon: str, kind: str) -> DataFrame:
    """(kind, name, lat, lon) of rows with a name and numeric coordinates."""
    rows = df.select(F.lit(kind).alias("kind"), F.trim(F.col(name)).alias("name"), F.col(lat).try_cast("double").alias("lat"), F.col(lon).try_cast("double").alias("lon"))
    return rows.where("name <> '' AND lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon)")


def located(*sources: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, sources)


#: Parts of column names that tell coordinates, places and years.
HINTS = {"lat": ("latitude", "lat"), "lon": ("longitude", "lon", "lng"), "name": ("village", "district", "name"), "year": ("year",)}


def inferred(columns: list[str]) -> dict[str, str | None]:
    """The first column whose lower-cased name is, else holds, one of each hint's words."""
    low = {c: c.lower() for c in columns}
    found = {}
    for role, words in HINTS.items():
        exact = [c for w in words for c in columns if low[c] == w]
        part = [c for w in words for c in columns if w in low[c]]
        found[role] = next(iter(exact + part), None)
    return found
