"""Keyed stores on shared storage: upserts, deletes, rollback and what the versions hold."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agrarium.operators.lineage import scratch
from agrarium.operators.store import KeyedStore
from agrarium.plans.registry import query
from agrarium.sources.tables import table

BALANCES = "c_custkey long, name string, balance double, source string"
FIRST = "(SELECT o_custkey AS k, arg_max(o_totalprice, o_orderkey) AS b FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)"
SECOND = "(SELECT o_custkey AS k, arg_max(o_totalprice, o_orderkey) AS b FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)"


def _balances(spark: SparkSession, d: str) -> tuple[KeyedStore, DataFrame]:
    """A store of customers, and their orders as rows to put in it."""
    customers = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.lit("customer").alias("source"))
    schema = spark.createDataFrame([], BALANCES).schema
    store = KeyedStore.create(spark, scratch(spark, f"store-{uuid.uuid4().hex}"), schema, ["c_custkey"], buckets=16)
    store.upsert(customers)
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.concat(F.lit("order of "), "o_custkey").alias("name"), F.col("o_totalprice").alias("balance"), F.lit("orders").alias("source"), "o_orderkey", "o_orderstatus")
    return store, orders


@query(f"SELECT c_custkey, CASE WHEN s.b IS NULL AND f.b IS NULL THEN c_name ELSE 'order of ' || c_custkey END AS name, coalesce(s.b, f.b, c_acctbal) AS balance, CASE WHEN s.b IS NULL AND f.b IS NULL THEN 'customer' ELSE 'orders' END AS source FROM customer LEFT JOIN {FIRST} f ON f.k = c_custkey LEFT JOIN {SECOND} s ON s.k = c_custkey")
def stored_upserts(spark: SparkSession, d: str) -> DataFrame:
    """Customers with two batches of their orders put in their place; the last order of each batch counts."""
    store, orders = _balances(spark, d)
    for state in ("o_orderstatus = 'F'", "o_orderstatus <> 'F'"):
        store.upsert(orders.where(state).drop("o_orderstatus"), ingested="o_orderkey")
    return store.read()


@query(f"SELECT c_custkey, coalesce(f.b, c_acctbal) AS balance FROM customer LEFT JOIN {FIRST} f ON f.k = c_custkey")
def stored_rollback(spark: SparkSession, d: str) -> DataFrame:
    """The same after the second batch is rolled back."""
    store, orders = _balances(spark, d)
    first = store.upsert(orders.where("o_orderstatus = 'F'").drop("o_orderstatus"), ingested="o_orderkey")
    store.upsert(orders.where("o_orderstatus <> 'F'").drop("o_orderstatus"), ingested="o_orderkey")
    store.rollback(first)
    return store.read().select("c_custkey", "balance")


@query("SELECT * FROM (VALUES (0, 'create', 0)) t(version, action, rows) UNION ALL SELECT 1, 'upsert', count(*) FROM customer UNION ALL SELECT 2, 'delete', count(*) FILTER (NOT coalesce(c_acctbal < 0, false)) FROM customer UNION ALL SELECT 3, 'upsert', count(*) FILTER (NOT coalesce(c_acctbal < 0, false) OR c_custkey IN (SELECT o_custkey FROM orders)) FROM customer UNION ALL SELECT 4, 'rollback 1', count(*) FROM customer")
def store_versions(spark: SparkSession, d: str) -> DataFrame:
    """What each version of a store holds, deletes and a rollback among them."""
    store, orders = _balances(spark, d)
    store.delete_where("balance < 0")
    store.upsert(orders.drop("o_orderstatus"), ingested="o_orderkey")
    store.rollback(1)
    return store.versions().select(F.col("version").cast("int").alias("version"), "action", "rows")


@query("SELECT event_type AS name, CAST(year(ts) AS INT) AS year, count(*) AS n, round(max(value), 2) AS top FROM events GROUP BY ALL HAVING max(value) >= 100")
def stored_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Metadata by (name, year), stored poorer at first, then whole, exported as Parquet, and read with a filter."""
    root = scratch(spark, f"store-{uuid.uuid4().hex}")
    events = table(spark, d, "events").select(F.col("event_type").alias("name"), F.year("ts").alias("year"), "value", "event_id")
    found = lambda rows: rows.groupBy("name", "year").agg(F.count("*").alias("n"), F.round(F.max("value"), 2).alias("top"))
    whole = found(events)
    store = KeyedStore.create(spark, f"{root}/store", whole.schema, ["name", "year"], buckets=8)
    store.upsert(found(events.where("event_id % 3 = 0")))
    store.upsert(whole)
    store.export(f"{root}/exported")
    return spark.read.parquet(f"{root}/exported").where("top >= 100")
