"""File listings, CSV tables and formats, over files that Spark writes from the given tables or lists from their rows."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agrarium.operators.lineage import scratch
from agrarium.plans.registry import query
from agrarium.sources import csvs, inventory, sinks
from agrarium.sources.tables import table

LISTED = "(SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'csv' WHEN 1 THEN 'txt' WHEN 2 THEN 'json' ELSE 'tif' END AS ext, CASE event_id % 3 WHEN 0 THEN 'NDVI' ELSE 'EVI' END AS kind, CASE event_id % 2 WHEN 0 THEN 'R10m' ELSE 'R20m' END AS res, CAST(2018 + event_id % 6 AS INT) AS y, CAST(floor(value) AS BIGINT) AS length, event_type, user_id FROM events)"
FILES = f"(SELECT *, event_type || '_' || user_id || '.' || ext AS name, '/data/' || kind || '/' || res || '/' || y || '/' || event_id || '/' || event_type || '_' || user_id || '.' || ext AS path, CASE WHEN ext IN ('csv', 'txt') THEN 'CSV' WHEN ext = 'tif' THEN 'GEOTIFF' ELSE 'OTHER' END AS category FROM {LISTED})"


def _listing(spark: SparkSession, d: str) -> DataFrame:
    """A listing (path, length, modificationTime) with a file for each event."""
    k = F.col("event_id")
    extension = F.when(k % 5 == 0, "csv").when(k % 5 == 1, "txt").when(k % 5 == 2, "json").otherwise("tif")
    folder = F.concat_ws("/", F.lit("/data"), F.when(k % 3 == 0, "NDVI").otherwise("EVI"), F.when(k % 2 == 0, "R10m").otherwise("R20m"), 2018 + k % 6, k)
    path = F.concat(folder, F.lit("/"), F.col("event_type"), F.lit("_"), F.col("user_id"), F.lit("."), extension)
    return table(spark, d, "events").select(path.alias("path"), F.floor("value").cast("long").alias("length"), F.col("ts").alias("modificationTime"))


def _inventory(spark: SparkSession, d: str) -> DataFrame:
    return inventory.classified(_listing(spark, d))


@query(f"SELECT path, name, ext AS extension, length, category, CASE WHEN ext = 'tif' THEN kind END AS index_type, CASE WHEN ext = 'tif' THEN res END AS resolution, CASE WHEN ext = 'tif' THEN y END AS year FROM {FILES}")
def file_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Files classified by what their paths tell."""
    return _inventory(spark, d).select("path", "name", "extension", "length", "category", "index_type", "resolution", "year")


@query(f"SELECT count(*) AS files, count(*) FILTER (category = 'CSV') AS csv, count(*) FILTER (category = 'GEOTIFF') AS geotiff, count(*) FILTER (ext = 'tif' AND kind = 'NDVI') AS ndvi, count(*) FILTER (ext = 'tif' AND kind = 'EVI') AS evi, count(*) FILTER (ext = 'tif' AND res = 'R10m') AS r10m, count(*) FILTER (ext = 'tif' AND res = 'R20m') AS r20m, CAST(sum(length) AS BIGINT) AS bytes FROM {FILES}")
def inventory_counts(spark: SparkSession, d: str) -> DataFrame:
    return inventory.counts(_inventory(spark, d))


@query(f"SELECT 'category' AS dimension, category AS key, count(*) AS n, CAST(sum(length) AS BIGINT) AS bytes FROM {FILES} GROUP BY 2 UNION ALL SELECT 'year', CASE WHEN ext = 'tif' THEN CAST(y AS VARCHAR) ELSE 'unknown' END, count(*), CAST(sum(length) AS BIGINT) FROM {FILES} GROUP BY 2 UNION ALL SELECT 'resolution', CASE WHEN ext = 'tif' THEN res ELSE 'unknown' END, count(*), CAST(sum(length) AS BIGINT) FROM {FILES} GROUP BY 2")
def inventory_groups(spark: SparkSession, d: str) -> DataFrame:
    """Files and bytes by category, year and resolution, in one pass."""
    from agrarium.operators.summaries import slices

    return slices(_inventory(spark, d).withColumn("year", F.col("year").cast("string")), ["category", "year", "resolution"], {"n": F.count("*"), "bytes": F.sum("length")})


@query(f"SELECT kind AS index_type, res AS resolution, y AS year, count(*) AS n, CAST(sum(length) AS BIGINT) AS bytes FROM {FILES} WHERE ext = 'tif' GROUP BY ALL")
def image_catalog(spark: SparkSession, d: str) -> DataFrame:
    return inventory.catalog(_inventory(spark, d))


@query(f"SELECT DISTINCT kind AS index_type, y AS year FROM {FILES} WHERE ext = 'tif' AND res = 'R10m' AND y >= 2020")
def image_years(spark: SparkSession, d: str) -> DataFrame:
    """Index types and years of images of one resolution."""
    return _inventory(spark, d).where("resolution = 'R10m' AND year >= 2020").select("index_type", "year").distinct()


@query(f"SELECT name, length, count(*) AS n, min(path) AS first FROM {FILES} GROUP BY ALL HAVING count(*) > 1")
def duplicate_files(spark: SparkSession, d: str) -> DataFrame:
    return inventory.duplicates(_inventory(spark, d))


@query(f"SELECT min(path) AS path FROM {FILES} GROUP BY name, length")
def unique_files(spark: SparkSession, d: str) -> DataFrame:
    return inventory.unique(_inventory(spark, d)).select("path")


@query("SELECT count(*) AS files, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS bytes, max(ts) AS newest FROM events")
def tree_signature(spark: SparkSession, d: str) -> DataFrame:
    """What changes when a file of a listing does."""
    return csvs.tree_signature(_listing(spark, d).withColumnRenamed("modificationTime", "modified"))


@query(f"SELECT path FROM {FILES} WHERE category <> 'OTHER' AND (event_id % 7 = 0 OR event_id % 11 = 0)")
def changed_files(spark: SparkSession, d: str) -> DataFrame:
    """Files that stored metadata lacks, or knows at another size."""
    files = _inventory(spark, d)
    k = F.regexp_extract("path", r"/(\d+)/[^/]+$", 1).cast("long")
    stored = files.where(k % 7 != 0).select("path", (F.col("length") + F.when(k % 11 == 0, 1).otherwise(0)).alias("length"))
    return inventory.changed(files, stored).select("path")


@query(f"SELECT path, CASE WHEN event_id % 7 = 0 THEN 'missing' WHEN event_id % 11 = 0 THEN 'changed' ELSE 'ok' END AS status FROM {FILES}")
def verified_files(spark: SparkSession, d: str) -> DataFrame:
    """A package's files against its manifest of checksums."""
    k = F.regexp_extract("path", r"/(\d+)/[^/]+$", 1).cast("long")
    rows = _listing(spark, d).select("path", F.sha2("path", 256).alias("sha256"), k.alias("k"))
    held = rows.where("k % 7 <> 0").select("path", F.when(F.col("k") % 11 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.col("sha256")).alias("sha256"))
    return inventory.verified(held, rows.select("path", "sha256"))


@query(f"SELECT 'error' AS severity, 'empty_file' AS code, path AS what FROM {FILES} WHERE length = 0 UNION ALL SELECT 'warning', 'missing_year', CAST(w AS VARCHAR) FROM (SELECT unnest(range(2016, 2026)) AS w) WHERE w NOT IN (SELECT y FROM {FILES} WHERE ext = 'tif') UNION ALL SELECT 'warning', 'missing_index', w FROM (SELECT unnest(['NDVI', 'EVI', 'SAVI']) AS w) WHERE w NOT IN (SELECT kind FROM {FILES} WHERE ext = 'tif')")
def structure_issues(spark: SparkSession, d: str) -> DataFrame:
    """Empty files, and years and index types without any image."""
    return inventory.structure_issues(_inventory(spark, d), ["NDVI", "EVI", "SAVI"], list(range(2016, 2026)))


def _written(spark: SparkSession, d: str, *names: str) -> str:
    """A new shared folder with tables written as CSV."""
    root = scratch(spark, f"csv-{uuid.uuid4().hex}")
    for name in names:
        sinks.write(table(spark, d, name), f"{root}/{name}.csv", "csv")
    return root


@query("SELECT c_custkey, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal > 0")
def csv_scan(spark: SparkSession, d: str) -> DataFrame:
    """Some typed columns of a CSV table."""
    rows = csvs.scan(spark, f"{_written(spark, d, 'customer')}/customer.csv", columns=["c_custkey", "c_acctbal", "c_mktsegment"], types={"c_custkey": "bigint", "c_acctbal": "double"})
    return rows.where("c_acctbal > 0")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus FROM orders ORDER BY orders.o_orderkey DESC LIMIT 5")
def csv_preview(spark: SparkSession, d: str) -> DataFrame:
    """The last five orders of a CSV table, as text."""
    rows = csvs.scan(spark, f"{_written(spark, d, 'orders')}/orders.csv", columns=["o_orderkey", "o_orderstatus"])
    return rows.orderBy(F.desc(F.col("o_orderkey").cast("long"))).limit(5)


@query("SELECT 'customer' AS name, count(*) AS n, 5::BIGINT AS columns FROM customer UNION ALL SELECT 'supplier', count(*), 4 FROM supplier UNION ALL SELECT 'orders', count(*), 6 FROM orders")
def csv_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Row and column counts of CSV tables found below a folder; headers aren't rows."""
    root = _written(spark, d, "customer", "supplier", "orders")
    # A table that Spark writes is a folder of files; its name is the folder's.
    names = csvs.discover(spark, root, "*.csv").select(F.regexp_extract("path", r"/([^/]+)\.csv/[^/]+$", 1).alias("name")).distinct()
    tables = {r["name"]: csvs.scan(spark, f"{root}/{r['name']}.csv") for r in names.collect()}
    counted = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.lit(len(df.columns)).cast("long").alias("columns")) for name, df in sorted(tables.items())]
    return reduce(DataFrame.unionByName, counted)


@query("SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def adhoc_sql(spark: SparkSession, d: str) -> DataFrame:
    """SQL with a parameter over CSV tables as views."""
    root = _written(spark, d, "customer", "orders")
    for name in ("customer", "orders"):
        csvs.scan(spark, f"{root}/{name}.csv").createOrReplaceTempView(f"csv_{name}")
    return spark.sql("SELECT c_mktsegment, count(*) AS n, round(sum(CAST(o_totalprice AS DOUBLE)), :digits) AS total FROM csv_customer JOIN csv_orders ON c_custkey = o_custkey GROUP BY 1", args={"digits": 2})


@query("WITH r AS (SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, count(CASE WHEN o_orderkey % 9 > 0 THEN o_totalprice END) AS numbers FROM orders) SELECT unnest(['parquet', 'json', 'csv', 'orc']) AS format, n, total, numbers FROM r")
def format_roundtrips(spark: SparkSession, d: str) -> DataFrame:
    """Orders written in each format and read again; what isn't finite is null in text formats, and doesn't count."""
    root = scratch(spark, f"formats-{uuid.uuid4().hex}")
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.when(F.col("o_orderkey") % 9 == 0, float("nan")).otherwise(F.col("o_totalprice")).alias("x"))
    schema, out = "o_orderkey long, o_totalprice double, x double", []
    for kind in ("parquet", "json", "csv", "orc"):
        sinks.write(rows, f"{root}/{kind}", kind)
        reader = spark.read.schema(schema)
        back = (reader.option("header", "true") if kind == "csv" else reader).format(kind).load(f"{root}/{kind}")
        out.append(back.agg(F.lit(kind).alias("format"), F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.count(F.nanvl("x", F.lit(None).cast("double"))).alias("numbers")))
    return reduce(DataFrame.unionByName, out)


@query("SELECT 'customer' AS kind, trim(c_name) AS name, CAST(c_custkey % 90 AS DOUBLE) AS lat, CAST(c_custkey % 180 AS DOUBLE) AS lon FROM customer WHERE c_custkey % 10 > 1 UNION ALL SELECT 'supplier', s_name, CAST(s_suppkey % 90 AS DOUBLE), CAST(s_suppkey % 180 AS DOUBLE) FROM supplier")
def point_records(spark: SparkSession, d: str) -> DataFrame:
    """Places of two tables with usable names and coordinates, under each other; the columns are told by their names."""
    k = F.col("c_custkey")
    a = table(spark, d, "customer").select(F.when(k % 10 == 0, " ").otherwise(F.concat(F.lit(" "), "c_name")).alias("Village Name"), F.when(k % 10 == 1, "n/a").otherwise((k % 90).cast("string")).alias("Latitude"), (k % 180).alias("Longitude"))
    b = table(spark, d, "supplier").select(F.col("s_name").alias("name"), (F.col("s_suppkey") % 90).alias("lat"), (F.col("s_suppkey") % 180).alias("lng"))
    one = lambda df, kind: csvs.points(df, *(csvs.inferred(df.columns)[c] for c in ("name", "lat", "lon")), kind)
    return csvs.located(one(a, "customer"), one(b, "supplier"))


@query("SELECT c_custkey, round(c_acctbal * 2, 2) AS feature, CAST(2 AS INT) AS version FROM customer")
def feature_store(spark: SparkSession, d: str) -> DataFrame:
    """Features put at their fingerprint in two versions, and the newest read; those of another fingerprint don't match."""
    from agrarium.operators.profile import schema_fingerprint

    root = scratch(spark, f"features-{uuid.uuid4().hex}")
    rows = table(spark, d, "customer")
    own = schema_fingerprint(rows)[:16]
    for version, fingerprint in ((1, own), (2, own), (1, "another")):
        sinks.put_version(rows.select("c_custkey", F.round(F.col("c_acctbal") * version, 2).alias("feature")), root, "customers", fingerprint, version)
    held = spark.read.parquet(f"{root}/customers/fingerprint={own}")
    newest = held.agg(F.max("version").alias("version"))
    return held.join(F.broadcast(newest), "version").select("c_custkey", "feature", F.col("version").cast("int").alias("version"))


@query("SELECT e AS encoding, count(*) AS n, max('Zoné ' || n_name) AS last FROM nation, (SELECT unnest(['UTF-8', 'ISO-8859-1']) AS e) GROUP BY 1")
def encoded_csv(spark: SparkSession, d: str) -> DataFrame:
    """CSV tables in two encodings, each read in the one that its head tells."""
    root = scratch(spark, f"encoded-{uuid.uuid4().hex}")
    rows = table(spark, d, "nation").select(F.concat(F.lit("Zoné "), "n_name").alias("name")).coalesce(1)
    out = []
    for kind in ("UTF-8", "ISO-8859-1"):
        rows.write.option("header", "true").option("encoding", kind).csv(f"{root}/{kind}")
        found = csvs.encoding_of(spark, csvs.discover(spark, f"{root}/{kind}", "*.csv").first()["path"])
        out.append(csvs.scan(spark, f"{root}/{kind}", encoding=found).agg(F.lit(found).alias("encoding"), F.count("*").alias("n"), F.max("name").alias("last")))
    return reduce(DataFrame.unionByName, out)


@query("SELECT CAST(year(o_orderdate) AS INT) AS year, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE year(o_orderdate) >= 1998 GROUP BY 1")
def exported_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Metadata written as Parquet by year, and the later years read; an empty table isn't exported."""
    root = scratch(spark, f"metadata-{uuid.uuid4().hex}")
    rows = table(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    sinks.write(sinks.not_empty(rows), root, "parquet", partition=("year",))
    back = spark.read.parquet(root).where("year >= 1998")
    return back.groupBy("year").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT p_brand AS model, count(*) AS runs, round(sum(p_retailprice), 2) AS total FROM part GROUP BY 1")
def run_log(spark: SparkSession, d: str) -> DataFrame:
    """Runs appended to a log in two batches; each has an id and a time of its own."""
    root = scratch(spark, f"log-{uuid.uuid4().hex}")
    runs = table(spark, d, "part").select(F.col("p_brand").alias("model"), F.col("p_retailprice").alias("metric"), "p_partkey")
    for half in (0, 1):
        sinks.append_log(runs.where(F.col("p_partkey") % 2 == half).drop("p_partkey"), root)
    back = spark.read.schema("model string, metric double, run_id string, logged_at timestamp").json(root)
    return back.where("logged_at IS NOT NULL").groupBy("model").agg(F.count_distinct("run_id").alias("runs"), F.round(F.sum("metric"), 2).alias("total"))


RULES = {"price": "o_totalprice <= 0 OR o_totalprice > 400000", "priority": "o_orderpriority NOT LIKE '_-%'", "status": "o_orderstatus = 'P'", "day": "o_orderdate < TIMESTAMP '1995-03-01'"}


@query(" UNION ALL ".join(f"SELECT '{name}' AS validator, count(*) FILTER ({rule}) AS failed, count(*) AS checked, count(*) FILTER ({rule}) = 0 AS passed FROM orders" for name, rule in RULES.items()))
def validator_results(spark: SparkSession, d: str) -> DataFrame:
    """A list of validators run in one pass."""
    from agrarium.operators.profile import validated

    rules = {name: F.expr(rule.replace("TIMESTAMP ", "TIMESTAMP_NTZ ")) for name, rule in RULES.items()}
    return validated(table(spark, d, "orders"), rules)
