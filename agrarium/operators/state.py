"""Upserts, versions, model stages, settings and expiry as table rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(table: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with the rows of ``batch`` in place of those of equal keys; of a key given twice the batch's greatest row counts."""
    newest = batch.groupBy(*keys).agg(F.max(F.struct(*(c for c in table.columns if c not in keys))).alias("_x")).select(*keys, "_x.*").select(*table.columns)
    return table.join(newest.select(*keys), keys, "left_anti").unionByName(newest)


def upsert_ingested(table: DataFrame, batch: DataFrame, keys: list[str], ingested: str) -> DataFrame:
    """``table`` with the rows of ``batch`` in place of those of equal keys; of a key given twice the row ingested last counts.

    ``ingested`` is a column of ``batch`` that grows with arrival; it isn't kept.
    """
    rest = [c for c in table.columns if c not in keys]
    newest = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), ingested).alias("_x")).select(*keys, "_x.*").select(*table.columns)
    return table.join(newest.select(*keys), keys, "left_anti").unionByName(newest)


def upsert_latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of the greatest ``order`` of each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, *rest)).alias("_x")).select(*keys, "_x.*").select(*rows.columns)


def versions(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``version`` from 1 by ``order``, and whether it is the key's current one."""
    by = Window.partitionBy(key)
    return rows.withColumn("version", F.row_number().over(by.orderBy(*order))).withColumn("is_current", F.col("version") == F.count("*").over(by))


def rolled_back(rows: DataFrame, key: str, name: str, version: int) -> DataFrame:
    """Another version of one key is the current one."""
    return rows.withColumn("is_current", F.when(F.col(key) == name, F.col("version") == version).otherwise(F.col("is_current")))


def promoted(registry: DataFrame, name: str, version: int, at: str) -> DataFrame:
    """One version of a model in production; the one before it is archived."""
    own = F.col("name") == name
    stage = F.when(own & (F.col("version") == version), "production").when(own & (F.col("stage") == "production"), "archived").otherwise(F.col("stage"))
    return registry.withColumn("promoted_at", F.when(own & (F.col("version") == version), F.lit(at).cast("timestamp")).otherwise(F.col("promoted_at"))).withColumn("stage", stage)


def newest_promoted(registry: DataFrame, key: str, version: str) -> DataFrame:
    """Each key's newest version in production; what was in production before is archived."""
    last = registry.groupBy(key).agg(F.max(version).alias("_last"))
    stage = F.when(F.col(version) == F.col("_last"), "production").when(F.col("stage") == "production", "archived").otherwise(F.col("stage"))
    return registry.join(last, key).withColumn("stage", stage).drop("_last")


def surplus_archived(registry: DataFrame, key: str, order: str, keep: int) -> DataFrame:
    """``stage`` of all but the ``keep`` newest rows of a key is archived."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return registry.withColumn("_r", rank).withColumn("stage", F.when(F.col("_r") > keep, "archived").otherwise(F.col("stage"))).drop("_r")


def setting(table: DataFrame, key: str, value: str, category: str = "", description: str = "") -> DataFrame:
    """A setting at version 1, or with its version raised; blank category and description keep what there was."""
    new = table.sparkSession.createDataFrame([(key, value, category, description, 1)], "key string, value string, category string, description string, version int")
    old = table.select("key", F.col("category").alias("_c"), F.col("description").alias("_d"), F.col("version").alias("_v"))
    row = new.join(old, "key", "left").select("key", "value", F.coalesce(F.nullif("category", F.lit("")), "_c").alias("category"), F.coalesce(F.nullif("description", F.lit("")), "_d").alias("description"), (F.coalesce("_v", F.lit(0)) + 1).alias("version"))
    return table.join(new.select("key"), "key", "left_anti").unionByName(row)


def settings(table: DataFrame, batch: DataFrame) -> DataFrame:
    """A table of settings (key, value, category, version) with a batch (key, value, category) put in: as ``setting``, for many keys."""
    old = table.select("key", F.col("category").alias("_c"), F.col("version").alias("_v"))
    rows = batch.join(old, "key", "left").select("key", "value", F.coalesce(F.nullif("category", F.lit("")), "_c", F.lit("")).alias("category"), (F.coalesce("_v", F.lit(0)) + 1).alias("version"))
    return table.join(batch.select("key"), "key", "left_anti").unionByName(rows)


def alive(cache: DataFrame, now: str, expires: str = "expires_at") -> DataFrame:
    """Entries that haven't expired; null never does."""
    return cache.where(F.col(expires).isNull() | (F.col(expires) > F.lit(now).cast("timestamp")))


def newest(rows: DataFrame, order: list[str], most: int) -> DataFrame:
    """At most ``most`` rows, the newest."""
    return rows.orderBy(*(F.desc(c) for c in order)).limit(most)
