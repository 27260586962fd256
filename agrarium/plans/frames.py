"""Frames by format, their schemas, reports as files, encodings that are learned, and places that are thinned."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agrarium.operators import drift, prepare, profile, spatial
from agrarium.operators.lineage import scratch
from agrarium.plans.alignment import KM, place, place_sql
from agrarium.plans.registry import query
from agrarium.sources import csvs, sinks
from agrarium.sources.tables import frame, table


@query("""SELECT 'o_orderkey' AS "column", 'same' AS change, 'bigint' AS kind_old, 'bigint' AS kind_new, count(*) AS n_old, count(*) AS n_new FROM orders
UNION ALL SELECT 'o_totalprice', 'retyped', 'double', 'string', count(o_totalprice), count(o_totalprice) FROM orders
UNION ALL SELECT 'o_orderpriority', 'removed', 'string', NULL, count(o_orderpriority), NULL FROM orders
UNION ALL SELECT 'large', 'added', NULL, 'double', NULL, count(*) FILTER (o_totalprice > 100000) FROM orders""")
def schema_report(spark: SparkSession, d: str) -> DataFrame:
    """What has changed between two versions of the orders, and how many values each column holds in both."""
    old = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    new = old.select("o_orderkey", F.col("o_totalprice").cast("string").alias("o_totalprice"), F.when(F.col("o_totalprice") > 100_000, F.col("o_totalprice")).alias("large"))
    return profile.schema_report(old, new)


@query("SELECT 'customer' AS name, (SELECT count(*) FROM (DESCRIBE customer)) AS columns, count(*) AS n FROM customer")
def widest_csv(spark: SparkSession, d: str) -> DataFrame:
    """Of the CSV files of a folder the one with the most columns, and how many rows it has."""
    root = scratch(spark, f"widest-{uuid.uuid4().hex}")
    names = ("nation", "customer", "region")
    for name in names:
        sinks.write(table(spark, d, name), f"{root}/{name}", "csv")
    tables = {name: csvs.scan(spark, f"{root}/{name}") for name in names}
    name = csvs.widest(tables)
    return tables[name].agg(F.lit(name).alias("name"), F.lit(len(tables[name].columns)).cast("long").alias("columns"), F.count("*").alias("n"))


_SHARES = "SELECT event_type, count(*) FILTER (event_id % 2 = 0) AS n_ref, count(*) FILTER (event_id % 2 <> 0) AS n_cur FROM events GROUP BY 1"


@query(f"WITH s AS ({_SHARES}) SELECT event_type, n_ref, n_cur, round(n_cur / (SELECT sum(n_cur) FROM s) - n_ref / (SELECT sum(n_ref) FROM s), 6) + 0.0 AS shift FROM s")
def monitoring_frames(spark: SparkSession, d: str) -> DataFrame:
    """Shares of kinds in a reference kept as Parquet and a current table that comes as CSV."""
    root = scratch(spark, f"frames-{uuid.uuid4().hex}")
    events = table(spark, d, "events").select("event_id", "event_type")
    sinks.write(events.where("event_id % 2 = 0"), f"{root}/reference.parquet", "parquet")
    sinks.write(events.where("event_id % 2 <> 0"), f"{root}/current.csv", "csv")
    shares = drift.category_shares(frame(spark, f"{root}/reference.parquet"), frame(spark, f"{root}/current.csv", "event_id long, event_type string"), "event_type")
    return shares.select("event_type", "n_ref", "n_cur", (F.round("shift", 6) + 0.0).alias("shift"))


@query(f"WITH s AS ({_SHARES}), r AS (SELECT event_type AS key, n_cur - n_ref AS value FROM s) SELECT format, key, CAST(value AS BIGINT) AS value FROM r, (SELECT unnest(['csv', 'html', 'json']) AS format)")
def written_reports(spark: SparkSession, d: str) -> DataFrame:
    """A drift report as CSV, HTML and JSON, each read again."""
    root = scratch(spark, f"reports-{uuid.uuid4().hex}")
    events = table(spark, d, "events")
    shares = drift.category_shares(events.where("event_id % 2 = 0"), events.where("event_id % 2 <> 0"), "event_type")
    report = shares.select(F.lit("categories").alias("section"), F.col("event_type").alias("key"), (F.col("n_cur") - F.col("n_ref")).alias("value"))
    schema = "section string, key string, value long"
    for kind in ("csv", "json"):
        sinks.write(report, f"{root}/report.{kind}", kind)
    sinks.html(report, f"{root}/report.html")
    cells = F.regexp_extract_all("value", F.lit("<td>([^<]*)</td>"), 1)
    page = spark.read.text(f"{root}/report.html").where(F.col("value").startswith("<tr>")).select(cells.alias("c"))
    back = {kind: frame(spark, f"{root}/report.{kind}", schema) for kind in ("csv", "json")} | {"html": page.select(F.col("c")[1].alias("key"), F.col("c")[2].cast("long").alias("value"))}
    return reduce(DataFrame.unionByName, (df.select(F.lit(kind).alias("format"), "key", "value") for kind, df in back.items()))


@query("SELECT o_orderkey, p AS category, CASE WHEN o_orderpriority = p THEN 1::DOUBLE ELSE 0::DOUBLE END AS hot FROM orders, (SELECT DISTINCT o_orderpriority AS p FROM orders)")
def onehot_learned(spark: SparkSession, d: str) -> DataFrame:
    """One-hot columns of the categories that a pipeline has found in the orders, a row for each."""
    rows = table(spark, d, "orders")
    fitted = prepare.TabularPipeline([], ["o_orderpriority"], "o_orderkey").fit(rows)
    names = fitted.fitted["names"]["o_orderpriority"]
    pairs = [F.struct(F.lit(n).alias("category"), c.alias("hot")) for n, c in zip(names, prepare.one_hot("o_orderpriority", names), strict=True)]
    return rows.select("o_orderkey", F.inline(F.array(*pairs)))


@query(f"""WITH RECURSIVE p AS (SELECT s_suppkey, lon, lat, row_number() OVER (ORDER BY s_suppkey) AS n FROM (SELECT s_suppkey, {place_sql('s_suppkey')} FROM supplier)),
k AS (SELECT n, [s_suppkey] AS held FROM p WHERE n = 1 UNION ALL SELECT p.n, CASE WHEN (SELECT count(*) FROM p AS b WHERE list_contains(k.held, b.s_suppkey) AND {KM.format(a='p', b='b')} <= 1000) = 0 THEN list_append(k.held, p.s_suppkey) ELSE k.held END FROM k JOIN p ON p.n = k.n + 1)
SELECT unnest(held) AS s_suppkey FROM (SELECT held FROM k ORDER BY n DESC LIMIT 1)""")
def thinned_places(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' places without those within 1,000 km of one that was kept before."""
    points = table(spark, d, "supplier").select("s_suppkey", *(v.alias(n) for n, v in place("s_suppkey").items()))
    return spatial.thinned(points, "s_suppkey", 1_000_000).select("s_suppkey")
