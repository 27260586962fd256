"""Files that are written from the orders, altered and deleted on purpose, and what an index and a manifest say of them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agrarium.operators.lineage import saved, scratch
from agrarium.operators.store import _Files
from agrarium.plans.registry import query
from agrarium.sources import packages
from agrarium.sources.tables import table

FILES = "(SELECT o_orderstatus || '-' || CAST(year(o_orderdate) AS INT) AS name, CAST(year(o_orderdate) AS INT) AS y, count(*) AS n FROM orders GROUP BY ALL)"


def _orders(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat("o_orderstatus", F.lit("-"), F.year("o_orderdate"))
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice", name.alias("name"), F.year("o_orderdate").alias("y"))


def _altered(spark: SparkSession, d: str, root: str) -> None:
    """Files of 1996 get another row, those of 1997 are deleted, and one file is added."""
    rows, files = _orders(spark, d), _Files(spark, root)
    more = rows.where("y = 1996").select(F.lit(-1).cast("long").alias("o_orderkey"), F.lit(0.5).alias("o_totalprice"), "name").distinct()
    packages.write_files(rows.where("y = 1996").drop("y").unionByName(more), "name", root)
    for name in files.names(root):
        if name.endswith("-1997.csv"):
            files.delete(f"{root}/{name}")
    packages.write_files(table(spark, d, "region").select("r_name", F.lit("added").alias("name")), "name", root)


@query(f"SELECT name || '.csv' AS path, CASE y WHEN 1996 THEN 'changed' WHEN 1997 THEN 'missing' ELSE 'ok' END AS status FROM {FILES} UNION ALL SELECT 'added.csv', 'extra'")
def package_statuses(spark: SparkSession, d: str) -> DataFrame:
    """A package's files against the checksums of what they held before."""
    root = scratch(spark, f"package-{uuid.uuid4().hex}")
    packages.write_files(_orders(spark, d).drop("y"), "name", root)
    manifest = saved(packages.manifest_of(spark, root))
    _altered(spark, d, root)
    return packages.verified(spark, root, manifest)


INDEXED_SQL = f"SELECT name || '.csv' AS relative, n + CASE WHEN y = 1996 THEN 1 ELSE 0 END AS row_count, 2 AS column_count, CASE WHEN y = 1996 THEN 'changed' ELSE 'same' END AS status FROM {FILES} WHERE y <> 1997 UNION ALL SELECT 'added.csv', count(*), 1, 'new' FROM region"


@query(INDEXED_SQL)
def indexed_files(spark: SparkSession, d: str) -> DataFrame:
    """The metadata of a folder after it has changed: only new and changed files are read again."""
    root = scratch(spark, f"folder-{uuid.uuid4().hex}")
    store = packages.metadata_store(spark, scratch(spark, f"index-{uuid.uuid4().hex}"))
    packages.write_files(_orders(spark, d).drop("y"), "name", root)
    packages.index(spark, root, store)
    _altered(spark, d, root)
    status = packages.index(spark, root, store)
    return store.read().join(status, "relative").select("relative", "row_count", "column_count", "status")


@query(f"SELECT CASE WHEN y = 1996 THEN 'changed' WHEN y = 1997 THEN 'deleted' ELSE 'same' END AS status, count(*) AS n FROM {FILES} GROUP BY 1 UNION ALL SELECT 'new', 1")
def folder_changes(spark: SparkSession, d: str) -> DataFrame:
    """How many files of a folder are new, changed, deleted or the same since it was indexed."""
    root = scratch(spark, f"folder-{uuid.uuid4().hex}")
    store = packages.metadata_store(spark, scratch(spark, f"index-{uuid.uuid4().hex}"))
    packages.write_files(_orders(spark, d).drop("y"), "name", root)
    packages.index(spark, root, store)
    _altered(spark, d, root)
    return packages.changes(packages.listed(spark, root).where("relative LIKE '%.csv'"), store.read()).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def loaded_release(spark: SparkSession, d: str) -> DataFrame:
    """A table of a release package, read after all files have been verified."""
    root = scratch(spark, f"release-{uuid.uuid4().hex}")
    table(spark, d, "orders").select("o_orderpriority", "o_totalprice").write.parquet(f"{root}/orders")
    manifest = saved(packages.manifest_of(spark, root))
    rows = packages.load_release(spark, root, manifest, "orders")
    return rows.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
