"""Versions, upserts, expiry, perturbations and scoring over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agrarium.operators import inference, state
from agrarium.plans.registry import query
from agrarium.sources.tables import table


@query("SELECT o_custkey, o_orderkey, CAST(row_number() OVER w AS INT) AS version, row_number() OVER w = count(*) OVER (PARTITION BY o_custkey) AS is_current FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def scd_versions(spark: SparkSession, d: str) -> DataFrame:
    return state.versions(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def active_latest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return state.upsert_latest(rows, ["o_custkey"], "o_orderdate").drop("o_orderdate")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT c_custkey, c_acctbal + 100 FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT s_suppkey + 10000000, s_acctbal FROM supplier")
def upsert_by_key(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    new = table(spark, d, "supplier").select((F.col("s_suppkey") + 10_000_000).alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal"))
    batch = base.where("c_custkey % 5 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 100).unionByName(new)
    return state.upsert(base, batch, ["c_custkey"])


@query("SELECT o_orderkey, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) > 3 THEN 'archived' ELSE 'staging' END AS stage FROM (SELECT o_orderkey, o_custkey, o_orderdate + INTERVAL 1 MICROSECOND * o_orderkey AS o_orderdate FROM orders)")
def surplus_archived(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.struct("o_orderdate", "o_orderkey").alias("at"), F.lit("staging").alias("stage"))
    return state.surplus_archived(rows, "o_custkey", "at", 3).select("o_orderkey", "stage")


@query("SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-20 12:00:00'")
def cache_alive(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("expires_at", F.col("ts").cast("timestamp"))
    return state.alive(rows, "2024-01-20 12:00:00").select("event_id")


PRICE = "l_extendedprice * (1 - l_discount) * (1 + l_tax)"


@query(f"WITH s AS (SELECT unnest([{{'name': 'no_discount', 'f': 'l_discount'}}, {{'name': 'double_tax', 'f': 'l_tax'}}, {{'name': 'price_up', 'f': 'l_extendedprice'}}], recursive := true)) SELECT l_orderkey, l_linenumber, name AS change, round(CASE name WHEN 'no_discount' THEN l_extendedprice * (1 + l_tax) WHEN 'double_tax' THEN l_extendedprice * (1 - l_discount) * (1 + l_tax * 2) ELSE (l_extendedprice + 10) * (1 - l_discount) * (1 + l_tax) END - {PRICE}, 4) AS effect FROM lineitem, s")
def counterfactual(spark: SparkSession, d: str) -> DataFrame:
    changes = {"no_discount": ("l_discount", "set", 0.0), "double_tax": ("l_tax", "multiply", 2.0), "price_up": ("l_extendedprice", "add", 10.0)}
    score = lambda c: c("l_extendedprice") * (1 - c("l_discount")) * (1 + c("l_tax"))
    found = inference.counterfactuals(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], changes, score)
    return found.withColumn("effect", F.round("effect", 4))


@query("SELECT vec_id, round(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: CAST(embedding[i] AS DOUBLE) * cos(CAST(i - 1 AS DOUBLE)))), 6) AS prediction FROM embeddings WHERE embedding IS NOT NULL")
def batch_scores(spark: SparkSession, d: str) -> DataFrame:
    """A linear model over embeddings."""
    weights = F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: F.cos(i.cast("double")))
    rows = table(spark, d, "embeddings").where(F.col("embedding").isNotNull())
    return rows.select("vec_id", F.round(inference.linear(F.col("embedding"), weights), 6).alias("prediction"))


@query("SELECT feature, round(avg(abs(v * w)), 6) AS importance FROM (SELECT unnest(range(0, 64)) AS feature, unnest(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS v, cos(CAST(unnest(range(0, 64)) AS DOUBLE)) AS w FROM embeddings) GROUP BY 1")
def global_importance(spark: SparkSession, d: str) -> DataFrame:
    shares = table(spark, d, "embeddings").select(F.transform("embedding", lambda x, i: x.cast("double") * F.cos(i.cast("double"))).alias("s"))
    return inference.importance(shares, "s").select(F.col("feature").cast("long").alias("feature"), F.round("importance", 6).alias("importance"))


@query("WITH p AS (SELECT l_suppkey, avg(l_discount) AS mean, stddev_pop(l_discount) AS std FROM lineitem GROUP BY 1) SELECT l_suppkey, round(mean, 6) AS mean, round(std, 6) AS std, round(greatest(0, least(1, 1 - std / 0.1)), 6) AS confidence FROM p")
def pass_uncertainty(spark: SparkSession, d: str) -> DataFrame:
    found = inference.uncertainty(table(spark, d, "lineitem"), ["l_suppkey"], "l_discount", scale=0.1)
    return found.select("l_suppkey", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), F.round("confidence", 6).alias("confidence"))


@query("WITH b AS (SELECT avg(c_acctbal) AS a, avg(c_nationkey) AS n FROM customer) SELECT c_custkey, round(0.5 * (c_acctbal - a), 3) + 0.0 AS balance, round(2.0 * (c_nationkey - n), 3) + 0.0 AS nation, CAST(4 - c_custkey % 10 AS DOUBLE) AS digit FROM customer, b")
def shapley_values(spark: SparkSession, d: str) -> DataFrame:
    """Kernel SHAP of a linear model against the mean customer; for such a model the values are its terms."""
    import numpy as np

    rows = table(spark, d, "customer").select("c_custkey", F.array(F.col("c_acctbal"), F.col("c_nationkey").cast("double"), (F.col("c_custkey") % 10).cast("double")).alias("x"))
    mean = table(spark, d, "customer").agg(F.avg("c_acctbal"), F.avg("c_nationkey")).first()
    weights = np.array([0.5, 2.0, -1.0])
    found = inference.shapley(rows, "c_custkey", "x", lambda x: x @ weights, np.array([mean[0] or 0.0, mean[1] or 0.0, 4.0]))
    return found.select("c_custkey", *((F.round(F.col("values")[i], 3) + 0.0).alias(name) for i, name in enumerate(("balance", "nation", "digit"))))


@query("WITH e AS (SELECT vec_id, list_transform(embedding[1:12], lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE len(embedding) >= 12) SELECT vec_id, CAST(i AS INT) AS feature, round(v[i + 1] * (i - 5.5), 5) + 0.0 AS value FROM e, (SELECT unnest(range(12)) AS i)")
def shapley_sampled(spark: SparkSession, d: str) -> DataFrame:
    """Kernel SHAP of twelve features from a sample of coalitions; those of a linear model are its terms all the same."""
    import numpy as np

    rows = table(spark, d, "embeddings").where(F.size("embedding") >= 12).select("vec_id", F.slice("embedding", 1, 12).alias("x"))
    weights = np.arange(12) - 5.5
    found = inference.shapley(rows, "vec_id", "x", lambda x: x @ weights, np.zeros(12))
    return found.select("vec_id", F.posexplode("values").alias("feature", "value")).withColumn("value", F.round("value", 5) + 0.0)


@query("WITH c AS (SELECT c_custkey, c_acctbal / 997 AS a, c_nationkey / 11 AS b, CAST(c_custkey % 10 AS DOUBLE) AS g FROM customer) SELECT c_custkey, round((a - 4) * (b + 1) / 2, 5) + 0.0 AS balance, round((b - 1) * (a + 4) / 2, 5) + 0.0 AS nation, round(g * g - 16, 5) + 0.0 AS digit FROM c")
def shapley_interaction(spark: SparkSession, d: str) -> DataFrame:
    """Kernel SHAP of a model with a product and a square: the product's effect is shared by both of its features."""
    import numpy as np

    rows = table(spark, d, "customer").select("c_custkey", F.array(F.col("c_acctbal") / 997, F.col("c_nationkey") / 11, (F.col("c_custkey") % 10).cast("double")).alias("x"))
    found = inference.shapley(rows, "c_custkey", "x", lambda x: x[:, 0] * x[:, 1] + x[:, 2] ** 2, np.array([4.0, 1.0, 4.0]))
    return found.select("c_custkey", *((F.round(F.col("values")[i], 5) + 0.0).alias(name) for i, name in enumerate(("balance", "nation", "digit"))))
