"""Joins by key, date, season, place and name over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agrarium.functions import geo, seasons
from agrarium.operators import filters, joins, spatial
from agrarium.plans.registry import query
from agrarium.sources.tables import table


def place(key: str) -> dict[str, Column]:
    """Coordinates that follow from a key, for tables without any."""
    k = F.col(key)
    return {"lon": (k * 3701 % 36000) / 100.0 - 180, "lat": (k * 5309 % 17000) / 100.0 - 85}


def place_sql(key: str) -> str:
    return f"({key} * 3701 % 36000) / 100.0 - 180 AS lon, ({key} * 5309 % 17000) / 100.0 - 85 AS lat"


KM = "2 * 6371.0088 * asin(sqrt(least(1, pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"


@query("SELECT c_custkey, c_name, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def join_chain_left(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    nation = table(spark, d, "nation").withColumnRenamed("n_regionkey", "r_regionkey")
    return joins.chain(base, [(nation, ["n_nationkey"], "left", "_n"), (table(spark, d, "region"), ["r_regionkey"], "left", "_r")]).select("c_custkey", "c_name", "n_name", "r_name")


@query("SELECT k, s.s_name, c.c_name FROM (SELECT s_suppkey AS k, s_name FROM supplier) s FULL JOIN (SELECT c_custkey * 2 AS k, c_name FROM customer) c USING (k)")
def join_chain_outer(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), "s_name")
    right = table(spark, d, "customer").select((F.col("c_custkey") * 2).alias("k"), "c_name")
    return joins.chain(left, [(right, ["k"], "full_outer", "_c")]).select("k", "s_name", "c_name")


@query("SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey")
def orphans_left(spark: SparkSession, d: str) -> DataFrame:
    return joins.orphans(table(spark, d, "customer"), table(spark, d, "orders"), "c_custkey", "o_custkey").select("c_custkey")


@query("SELECT o_orderkey FROM orders ANTI JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def orphans_right(spark: SparkSession, d: str) -> DataFrame:
    return joins.orphans(table(spark, d, "orders"), table(spark, d, "customer").where("c_acctbal > 0"), "o_custkey", "c_custkey").select("o_orderkey")


SEASON_WINDOWS = "SELECT unnest([{'season': 'Kharif', 'year': y, 's': make_date(y, 6, 1), 'e': make_date(y, 10, 31)}, {'season': 'Rabi', 'year': y, 's': make_date(y, 11, 1), 'e': make_date(y + 1, 3, 31)}, {'season': 'Summer', 'year': y, 's': make_date(y, 4, 1), 'e': make_date(y, 5, 31)}], recursive := true) FROM (SELECT CAST(unnest(generate_series(CAST(min(year(o_orderdate)) AS INT) - 1, CAST(max(year(o_orderdate)) AS INT))) AS INT) AS y FROM orders)"


@query(f"SELECT o_orderkey, season, year FROM orders JOIN ({SEASON_WINDOWS}) ON CAST(o_orderdate AS DATE) BETWEEN s AND e")
def interval_join(spark: SparkSession, d: str) -> DataFrame:
    """Orders in the seasons' windows of all years they reach into."""
    orders = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    years = orders.agg(F.explode(F.sequence(F.year(F.min("day")) - 1, F.year(F.max("day")))).alias("year"))
    return joins.interval_join(orders, "day", seasons.windows(years)).select("o_orderkey", "season", "year")


@query("SELECT season, year, count(*) AS n FROM (SELECT CASE WHEN month(o_orderdate) BETWEEN 6 AND 10 THEN 'Kharif' WHEN month(o_orderdate) BETWEEN 4 AND 5 THEN 'Summer' ELSE 'Rabi' END AS season, CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) <= 3 THEN 1 ELSE 0 END AS INT) AS year FROM orders) GROUP BY ALL")
def season_of_date(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(seasons.season_of(F.to_date("o_orderdate")).alias("s")).groupBy("s.season", "s.year").agg(F.count("*").alias("n"))


@query("WITH l AS (SELECT event_id, user_id, TIMESTAMP '1995-01-01' + (ts - TIMESTAMP '2024-01-01') * 40 AS moment FROM events) SELECT event_id, o_orderkey, o_orderdate FROM (SELECT event_id, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY event_id ORDER BY abs(epoch_us(moment) - epoch_us(o_orderdate)), o_orderdate, o_orderkey DESC) AS r FROM l JOIN orders ON user_id = o_custkey) WHERE r = 1")
def asof_nearest(spark: SparkSession, d: str) -> DataFrame:
    moved = F.timestamp_micros(F.unix_micros(F.lit("1995-01-01").cast("timestamp")) + (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) * 40)
    left = table(spark, d, "events").select("event_id", F.col("user_id").alias("k"), moved.cast("timestamp_ntz").alias("at"))
    right = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", "o_orderdate")
    # Of orders at one time the largest key counts, before and after alike.
    right = right.groupBy("k", "o_orderdate").agg(F.max("o_orderkey").alias("o_orderkey"))
    return joins.nearest_date(left, right, "k", "at", "o_orderdate", "event_id", ["o_orderkey", "o_orderdate"]).select("event_id", "o_orderkey", "o_orderdate")


@query(f"WITH s AS (SELECT s_suppkey, {place_sql('s_suppkey')} FROM supplier), c AS (SELECT c_custkey, {place_sql('c_custkey')} FROM customer) SELECT c_custkey, s_suppkey, rank, round(km, 6) AS distance_km FROM (SELECT c_custkey, s_suppkey, km, row_number() OVER (PARTITION BY c_custkey ORDER BY km, s_suppkey) AS rank FROM (SELECT c_custkey, s_suppkey, {KM.format(a='c', b='s')} AS km FROM c, s) WHERE km <= 1500) WHERE rank <= 3")
def knn_join(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "customer").select("c_custkey", *(v.alias(k) for k, v in place("c_custkey").items()))
    offered = table(spark, d, "supplier").select("s_suppkey", *(v.alias(f"place_{k}") for k, v in place("s_suppkey").items()))
    return spatial.nearest(asked, offered, "c_custkey", "s_suppkey", k=3, km=1500).select("c_custkey", "s_suppkey", "rank", F.round("distance_km", 6).alias("distance_km"))


@query(f"WITH s AS (SELECT s_suppkey, {place_sql('s_suppkey')} FROM supplier), c AS (SELECT c_custkey, {place_sql('c_custkey')} FROM customer) SELECT s_suppkey, count(*) AS n FROM (SELECT s_suppkey, {KM.format(a='c', b='s')} AS km FROM c, s) WHERE km <= 800 GROUP BY 1")
def radius_counts(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "customer").select("c_custkey", *(v.alias(k) for k, v in place("c_custkey").items()))
    offered = table(spark, d, "supplier").select("s_suppkey", *(v.alias(f"place_{k}") for k, v in place("s_suppkey").items()))
    return spatial.counts_within(asked, offered, "s_suppkey", 800)


@query(f"WITH c AS (SELECT c_custkey, {place_sql('c_custkey')} FROM customer), t AS (SELECT n_nationkey, (n_nationkey * 14.0 - 180) AS x, (n_nationkey * 6.0 - 80) AS y FROM nation) SELECT c_custkey, n_nationkey FROM c, t WHERE lon >= x AND lat >= y AND (lon - x) / 60 + (lat - y) / 40 <= 1")
def pip_join(spark: SparkSession, d: str) -> DataFrame:
    """Customers in the right triangle of each nation."""
    points = table(spark, d, "customer").select("c_custkey", *(v.alias(k) for k, v in place("c_custkey").items()))
    x, y = F.col("n_nationkey") * 14.0 - 180, F.col("n_nationkey") * 6.0 - 80
    corner = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    ring = F.array(corner(0, 0), corner(60, 0), corner(0, 40), corner(0, 0))
    shapes = table(spark, d, "nation").select("n_nationkey", x.alias("min_lon"), (x + 60).alias("max_lon"), y.alias("min_lat"), (y + 40).alias("max_lat"), ring.alias("ring"))
    return spatial.containing(points, shapes, size=10.0).select("c_custkey", "n_nationkey")


@query(f"SELECT c_custkey FROM (SELECT c_custkey, {place_sql('c_custkey')} FROM customer) WHERE lon BETWEEN -20 AND 60 AND lat BETWEEN -10 AND 50")
def bbox_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", *(v.alias(k) for k, v in place("c_custkey").items()))
    return rows.where(geo.valid_coordinates(F.col("lon"), F.col("lat")) & F.col("lon").between(-20, 60) & F.col("lat").between(-10, 50)).select("c_custkey")


@query(f"SELECT c_custkey, round(lon - 50 / (111.32 * greatest(cos(radians(lat)), 0.01)), 6) AS min_lon, round(lat - 50 / 111.32, 6) AS min_lat, CAST(floor(lon / 0.5) AS BIGINT) AS x FROM (SELECT c_custkey, {place_sql('c_custkey')} FROM customer)")
def boxes_and_cells(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", *(v.alias(k) for k, v in place("c_custkey").items()))
    box = geo.box_around(F.col("lon"), F.col("lat"), F.lit(50.0))
    return rows.select("c_custkey", F.round(box["min_lon"], 6).alias("min_lon"), F.round(box["min_lat"], 6).alias("min_lat"), geo.cell(F.col("lon"), 0.5).alias("x"))


@query("WITH p AS (SELECT DISTINCT n_name AS probe FROM nation), t AS (SELECT r_regionkey AS pos, r_name AS name FROM region UNION ALL SELECT 100 + s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN n_name || '/' || s_name ELSE s_name || ' of ' || n_name END FROM supplier JOIN nation ON s_nationkey = n_nationkey), m AS (SELECT probe, pos, name, CASE WHEN name = probe THEN 1 WHEN list_contains(list_transform(string_split_regex(name, '[/|]'), lambda x: trim(x)), probe) THEN 2 WHEN contains(lower(name), lower(probe)) THEN 3 END AS stage FROM p, t) SELECT probe, name AS matched, stage FROM (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY stage, pos) AS r FROM m WHERE stage IS NOT NULL) WHERE r = 1")
def staged_name_match(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation")
    named = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select((F.col("s_suppkey") + 100).alias("pos"), F.when(F.col("s_suppkey") % 2 == 0, F.concat_ws("/", "n_name", "s_name")).otherwise(F.concat_ws(" of ", "s_name", "n_name")).alias("name"))
    known = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("pos"), F.col("r_name").alias("name")).unionByName(named)
    return joins.staged_name_match(nation.select(F.col("n_name").alias("probe")).distinct(), known, "probe", "name", "pos")


@query("""WITH n AS (SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey), p AS (SELECT '^' || lower(n_name[1]) || '.* of .*' || lower(n_name[-1]) || '$' AS probe FROM n UNION SELECT '(' || n_name || '|' || r_name || ')\\d*$' FROM n UNION SELECT '^.+#.*' || lower(n_name[1:2]) || '[a-z]+$' FROM n UNION SELECT '('),
t AS (SELECT 100 + s_suppkey AS pos, s_name || ' of ' || n_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey), m AS (SELECT probe, pos, name FROM p, t WHERE probe <> '(' AND regexp_matches(name, probe, 'i'))
SELECT probe, arg_min(name, pos) AS matched, 4 AS stage FROM m GROUP BY 1""")
def staged_expressions(spark: SparkSession, d: str) -> DataFrame:
    """Probes that are regular expressions: the first supplier that each is found in."""
    nation = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    first, last = F.lower(F.substring("n_name", 1, 1)), F.lower(F.substring("n_name", -1, 1))
    forms = F.array(F.concat(F.lit("^"), first, F.lit(".* of .*"), last, F.lit("$")), F.concat(F.lit("("), "n_name", F.lit("|"), "r_name", F.lit(")\\d*$")), F.concat(F.lit("^.+#.*"), F.lower(F.substring("n_name", 1, 2)), F.lit("[a-z]+$")), F.lit("("))
    probes = nation.select(F.explode(forms).alias("probe")).distinct()
    named = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select((F.col("s_suppkey") + 100).alias("pos"), F.concat_ws(" of ", "s_name", "n_name").alias("name"))
    return joins.staged_name_match(probes, named, "probe", "name", "pos", raw="name")


@query("WITH e AS (SELECT event_id, CAST(ts AS DATE) AS day, user_id, event_type, value FROM events), a AS (SELECT day, user_id, arg_min(value, event_id) AS left_value FROM e WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY ALL), b AS (SELECT day, user_id, arg_min(value, event_id) AS right_value FROM e WHERE event_type = (SELECT max(event_type) FROM events) GROUP BY ALL) SELECT day, user_id, left_value, right_value FROM a FULL JOIN b USING (day, user_id)")
def outer_pairing(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    ends = rows.agg(F.min("event_type").alias("a"), F.max("event_type").alias("b")).first()
    return joins.outer_pairs(rows.where(F.col("event_type") == ends["a"]), rows.where(F.col("event_type") == ends["b"]), ["day", "user_id"], "event_id", ["value"])


@query("SELECT c_custkey AS node, concat_ws('>', c_name, n_name, r_name) AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def boundary_chain(spark: SparkSession, d: str) -> DataFrame:
    level = lambda name, key, parent, title, base, up: table(spark, d, name).select((F.col(key) + base).alias("node"), (F.col(parent) + up if parent else F.lit(None).cast("long")).alias("parent"), F.col(title).alias("name"))
    far = 10**12
    nodes = level("customer", "c_custkey", "c_nationkey", "c_name", 0, far).unionByName(level("nation", "n_nationkey", "n_regionkey", "n_name", far, 2 * far)).unionByName(level("region", "r_regionkey", None, "r_name", 2 * far, 0))
    return joins.parent_chain(nodes, "node", "parent", "name", 3).where(F.col("node") < far).select("node", F.array_join("path", ">").alias("path"))


@query(f"WITH o AS (SELECT o_custkey, CASE WHEN month(o_orderdate) BETWEEN 6 AND 10 THEN 'Kharif' WHEN month(o_orderdate) BETWEEN 4 AND 5 THEN 'Summer' ELSE 'Rabi' END AS season, CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) <= 3 THEN 1 ELSE 0 END AS INT) AS year, count(*) AS n_images, round(sum(o_totalprice), 2) AS total, min(CAST(o_orderdate AS DATE)) AS first_day FROM orders GROUP BY ALL), cell AS (SELECT c_custkey, {place_sql('c_custkey')}, year, season FROM customer, (SELECT DISTINCT year FROM o), (SELECT DISTINCT season FROM o)), r AS (SELECT c_custkey, cell.year, cell.season, coalesce(n_images, 0) AS n_images, total, first_day, lon, lat, n_name FROM cell LEFT JOIN o ON c_custkey = o_custkey AND cell.year = o.year AND cell.season = o.season JOIN customer c USING (c_custkey) LEFT JOIN nation ON c.c_nationkey = n_nationkey) SELECT c_custkey, year, season, n_name, n_images, total, first_day, 100 - CASE WHEN n_images = 0 THEN 25 ELSE 0 END - CASE WHEN n_images = 1 THEN 10 ELSE 0 END - CASE WHEN abs(lat) > 60 THEN 2 ELSE 0 END AS quality, n_images > 0 AS accepted FROM r")
def build_observations(spark: SparkSession, d: str) -> DataFrame:
    """The alignment of places with records, with a quality score for each cell; years and seasons are those of the orders."""
    places = table(spark, d, "customer").select("c_custkey", "c_nationkey", *(v.alias(k) for k, v in place("c_custkey").items()))
    dated = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), seasons.season_of(F.to_date("o_orderdate")).alias("s"), "o_totalprice", F.to_date("o_orderdate").alias("day"))
    found = dated.groupBy("c_custkey", F.col("s.season").alias("season"), F.col("s.year").alias("year")).agg(F.count("*").alias("n_images"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.min("day").alias("first_day"))
    cells = places.crossJoin(F.broadcast(found.select("year").distinct())).crossJoin(F.broadcast(found.select("season").distinct()))
    rows = cells.join(found, ["c_custkey", "year", "season"], "left").na.fill(0, ["n_images"]).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    issues = F.array_compact(F.array(F.when(F.col("n_images") == 0, "error"), F.when(F.col("n_images") == 1, "warning"), F.when(F.abs("lat") > 60, "info")))
    return rows.select("c_custkey", "year", "season", "n_name", "n_images", "total", "first_day", filters.quality_score(issues).alias("quality"), (F.col("n_images") > 0).alias("accepted"))
