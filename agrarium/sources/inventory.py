"""Inventories of data files: classified, counted, checked and kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agrarium.functions.names import date_of, index_type_of, resolution_of, year_of


def scan(spark: SparkSession, root: str, excluded: tuple[str, ...] = (".git", "__pycache__"), checksum: bool = False) -> DataFrame:
    """One row per file below ``root``: path, extension, size, category, index type, resolution, year, date and, if asked, SHA-256."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    for name in excluded:
        files = files.where(~F.col("path").contains(f"/{name}/"))
    return classified(files, checksum)


def classified(files: DataFrame, checksum: bool = False) -> DataFrame:
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    raster = extension.isin("tif", "tiff")
    category = F.when(extension.isin("csv", "txt"), "CSV").when(raster, "GEOTIFF").otherwise("OTHER")
    only = lambda c: F.when(raster, c)
    path = F.col("path")
    columns = {"path": path, "name": F.regexp_extract("path", r"([^/]+)$", 1), "extension": extension, "length": F.col("length"), "modified": F.col("modificationTime"), "category": category, "index_type": only(index_type_of(path)), "resolution": only(resolution_of(path)), "year": only(year_of(path)), "date": only(date_of(path))}
    if checksum:
        columns["sha256"] = F.sha2("content", 256)
    return files.select(*(c.alias(n) for n, c in columns.items()))


def counts(inventory: DataFrame) -> DataFrame:
    return inventory.agg(F.count("*").alias("files"), *(F.count_if(F.col("category") == k).alias(k.lower()) for k in ("CSV", "GEOTIFF")), *(F.count_if(F.col("index_type") == k).alias(k.lower()) for k in ("NDVI", "EVI")), *(F.count_if(F.col("resolution") == k).alias(k.lower()) for k in ("R10m", "R20m")), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def catalog(inventory: DataFrame) -> DataFrame:
    return inventory.where("category = 'GEOTIFF'").groupBy("index_type", "resolution", "year").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))


def duplicates(inventory: DataFrame) -> DataFrame:
    """(name, length, n, first) of files that share name and size."""
    return inventory.groupBy("name", "length").agg(F.count("*").alias("n"), F.min("path").alias("first")).where("n > 1")


def unique(inventory: DataFrame) -> DataFrame:
    first = F.row_number().over(Window.partitionBy("name", "length").orderBy("path"))
    return inventory.withColumn("_r", first).where("_r = 1").drop("_r")


def structure_issues(inventory: DataFrame, index_types: list[str], years: list[int]) -> DataFrame:
    """(severity, code, what): empty files, and index types and years without any file."""
    spark = inventory.sparkSession
    wanted = spark.createDataFrame([("missing_index", x) for x in index_types] + [("missing_year", str(y)) for y in years], "code string, what string")
    held = inventory.select(F.explode(F.array(F.struct(F.lit("missing_index").alias("code"), F.col("index_type").alias("what")), F.struct(F.lit("missing_year").alias("code"), F.col("year").cast("string").alias("what")))).alias("x")).select("x.*").where("what IS NOT NULL").distinct()
    missing = wanted.join(held, ["code", "what"], "left_anti").select(F.lit("warning").alias("severity"), "code", "what")
    empty = inventory.where("length = 0").select(F.lit("error").alias("severity"), F.lit("empty_file").alias("code"), F.col("path").alias("what"))
    return missing.unionByName(empty)


def changed(inventory: DataFrame, stored: DataFrame) -> DataFrame:
    """Files that the stored metadata doesn't have at this size; others needn't be read again."""
    return inventory.where("category <> 'OTHER'").join(stored.select("path", "length"), ["path", "length"], "left_anti")


def verified(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, status) of a manifest (path, sha256): ok, changed or missing."""
    own = files.select("path", F.col("sha256").alias("_own"))
    status = F.when(F.col("_own").isNull(), "missing").when(F.col("_own") == F.col("sha256"), "ok").otherwise("changed")
    return manifest.join(own, "path", "left").select("path", status.alias("status"))
