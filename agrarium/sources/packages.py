"""Real files: incremental metadata of data folders, and release packages held against their checksums.

Paths, sizes and times come from the listing alone; contents are read for files
that are new or have changed, and for checksums.
"""

from __future__ import annotations

import datetime as dt
import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agrarium.operators.lineage import saved
from agrarium.operators.store import KeyedStore, _Files
from agrarium.sources.inventory import classified

HEAD = 1 << 16  # bytes in which a CSV file's header must end
PATHS = 50_000  # that one read is given
RECORD = "path string, relative string, category string, index_type string, resolution string, year int, length long, modified timestamp, sha256 string, row_count long, column_count int, columns array<string>, encoding string"


def loaded(spark: SparkSession, where: str | list[str]) -> DataFrame:
    """(path, length, modificationTime, content) of files, or of all below a folder; what isn't selected isn't read.

    Spark's scans leave out files without bytes. Those are taken from the list
    of the scan's files, which is with the driver in any case.
    """
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(where).select("path", "length", "modificationTime", "content")
    plain = lambda p: re.sub("^file:/+", "file:/", p)
    names = spark.createDataFrame([(plain(unquote(p)),) for p in scan.inputFiles()], "name string")
    left = names.join(scan.select(F.regexp_replace("path", "^file:/+", "file:/").alias("name")), "name", "left_anti")
    empty = [(r.name, _Files(spark, r.name).status(r.name)) for r in left.collect()]
    rows = [(name, 0, dt.datetime.fromtimestamp(s.getModificationTime() / 1000, dt.timezone.utc), bytearray()) for name, s in empty if not s.getLen()]
    return scan.unionByName(spark.createDataFrame(rows, scan.schema)) if rows else scan


def _root(spark: SparkSession, root: str) -> str:
    files = _Files(spark, root)
    return files.fs.makeQualified(files.path(root)).toString().rstrip("/")


def _relative(spark: SparkSession, root: str) -> Column:
    """A path below ``root``, without the scheme's empty host."""
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    return F.substring_index(plain(F.col("path")), _root(spark, root).replace("file:///", "file:/") + "/", -1)


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(path, relative, length, modificationTime) of all files below ``root``; no content is read. An empty or missing folder has none."""
    files = _Files(spark, root)
    if not files.fs.exists(files.path(root)) or not files.names(root):
        return spark.createDataFrame([], "path string, relative string, length long, modificationTime timestamp")
    return loaded(spark, root).select("path", _relative(spark, root).alias("relative"), "length", "modificationTime")


def changes(listing: DataFrame, known: DataFrame) -> DataFrame:
    """(relative, status): new, changed, deleted or same, by size and time of the files and of what is known of them."""
    now = listing.select("relative", F.struct("length", F.col("modificationTime").alias("modified")).alias("now"))
    then = known.select("relative", F.struct("length", "modified").alias("then"))
    status = F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("now") == F.col("then"), "same").otherwise("changed")
    return now.join(then, "relative", "full_outer").select("relative", status.alias("status"))


def contents(spark: SparkSession, paths: list[str], root: str) -> DataFrame:
    """Metadata (RECORD) of files, by reading them: checksum, and of CSV files the encoding, the columns and the rows."""
    out = []
    for lo in range(0, len(paths), PATHS):
        own = paths[lo : lo + PATHS]
        files = loaded(spark, own)
        head = F.substring("content", 1, HEAD)
        utf = F.is_valid_utf8(F.decode(F.col("content"), "ISO-8859-1")) & F.try_validate_utf8(F.col("content").cast("string")).isNotNull()
        text = F.when(utf, F.decode(head, "UTF-8")).otherwise(F.decode(head, "ISO-8859-1"))
        header = F.regexp_replace(F.substring_index(text, "\n", 1), "^﻿|\r$", "")
        # Lines by the bytes between them: quoted breaks count as the listing's quick count does.
        breaks = F.length("content") - F.length(F.regexp_replace(F.decode("content", "ISO-8859-1"), "\n", ""))
        ends = (F.length("content") > 0) & (F.substring("content", -1, 1) != F.lit(b"\n"))
        csv = F.col("category") == "CSV"
        kinds = classified(files).select("path", "category", "index_type", "resolution", "year")
        read = files.select("path", "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"), header.alias("header"), (breaks + F.when(ends, 1).otherwise(0)).cast("long").alias("lines"), F.when(utf, "UTF-8").otherwise("ISO-8859-1").alias("enc"))
        found = read.join(kinds, "path").withColumn("columns", F.when(csv & (F.col("header") != ""), F.transform(F.split("header", ","), lambda c: F.trim(F.regexp_replace(c, '^"|"$', "")))))
        rows = F.when(csv, F.greatest(F.col("lines") - 1, F.lit(0)))
        out.append(found.select("path", _relative(spark, root).alias("relative"), "category", "index_type", "resolution", F.col("year").cast("int").alias("year"), "length", "modified", "sha256", rows.alias("row_count"), F.when(csv, F.coalesce(F.size("columns"), F.lit(0))).alias("column_count"), "columns", F.when(csv, F.col("enc")).alias("encoding")))
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], RECORD)


def index(spark: SparkSession, root: str, store: KeyedStore, force: bool = False) -> DataFrame:
    """Brings a store of metadata (RECORD, by relative path) up to date with a folder, and returns (relative, status).

    Files that are new or have another size or time are read, or with ``force``
    all; those that are gone are deleted; of the others nothing is read. Their
    paths pass through the driver, as those of any listing do. Files that are
    neither tables nor images are left out.
    """
    listing = saved(classified(listed(spark, root)).where("category <> 'OTHER'").select("path", _relative(spark, root).alias("relative"), "length", F.col("modified").alias("modificationTime")))
    status = saved(changes(listing, store.read()))
    wanted = status.where(F.lit(force) & (F.col("status") != "deleted") | F.col("status").isin("new", "changed"))
    paths = [r[0] for r in listing.join(wanted, "relative", "left_semi").select("path").toLocalIterator()]
    if paths:
        store.upsert(contents(spark, sorted(paths), root))
    gone = status.where("status = 'deleted'").select("relative")
    if not gone.isEmpty():
        store.delete(gone)
    return status


def metadata_store(spark: SparkSession, root: str, buckets: int = 16) -> KeyedStore:
    """A new store for ``index``."""
    return KeyedStore.create(spark, root, spark.createDataFrame([], RECORD).schema, ["relative"], buckets)


def manifest_of(spark: SparkSession, root: str) -> DataFrame:
    """(path, sha256) of the files of a package, by their contents."""
    return loaded(spark, root).select(_relative(spark, root).alias("path"), F.sha2("content", 256).alias("sha256"))


def verified(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """(path, status) of a package against its manifest (path, sha256): ok, changed, missing, or extra."""
    own = manifest_of(spark, root).withColumnRenamed("sha256", "own")
    status = F.when(F.col("own").isNull(), "missing").when(F.col("sha256").isNull(), "extra").when(F.lower("sha256") == F.col("own"), "ok").otherwise("changed")
    return manifest.join(own, "path", "full_outer").select("path", status.alias("status"))


def load_release(spark: SparkSession, root: str, manifest: DataFrame, name: str) -> DataFrame:
    """A table (Parquet or CSV) of a package, once all of the package's files are as the manifest says."""
    bad = verified(spark, root, manifest).where("status IN ('changed', 'missing')").limit(5).collect()
    if bad:
        raise ValueError("package is damaged: " + ", ".join(f"{r.path} {r.status}" for r in bad))
    path = f"{root}/{name}"
    return spark.read.option("header", "true").option("inferSchema", "true").csv(path) if name.endswith(".csv") else spark.read.parquet(path)


def write_files(rows: DataFrame, column: str, root: str, extension: str = "csv") -> None:
    """A file for each value of ``column``, named after it: written by partition, then moved up under its name."""
    spark, files = rows.sparkSession, _Files(rows.sparkSession, root)
    beside = f"{root}.parts"
    rows.repartition(column).write.mode("overwrite").option("header", "true").partitionBy(column).format(extension).save(beside)
    files.fs.mkdirs(files.path(root))
    for folder in files.names(beside):
        parts = [n for n in files.names(f"{beside}/{folder}") if n.startswith("part-")]
        for part in parts:
            target = files.path(f"{root}/{folder.partition('=')[2]}.{extension}")
            files.fs.delete(target, False)
            files.fs.rename(files.path(f"{beside}/{folder}/{part}"), target)
    files.delete(beside)
    spark.catalog.refreshByPath(root)
