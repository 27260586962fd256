"""Names, paths, dates, versions, distances and array expressions over the given tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agrarium.functions import arrays, geo, names, seasons
from agrarium.operators import prepare
from agrarium.plans.alignment import place, place_sql
from agrarium.plans.registry import query
from agrarium.sources.tables import table

ALIASES = {"cold widget": "Widget, cold", "hot bolt": "Bolt, hot"}
RAW = "'  ' || replace(p_name, ' ', '   ') || CASE WHEN p_partkey % 2 = 0 THEN '  (' || p_brand || ') x' ELSE ' ' END"
ALIAS_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ALIASES.items())


@query(f"WITH r AS (SELECT p_partkey, p_name AS plain FROM part) SELECT p_partkey, CASE lower(plain) {ALIAS_SQL} ELSE plain END AS name, CASE WHEN lower(plain) IN ({', '.join(repr(k) for k in ALIASES)}) THEN 'special' WHEN plain LIKE '%widget%' THEN 'matched' ELSE 'unmatched' END AS status FROM r")
def place_names(spark: SparkSession, d: str) -> DataFrame:
    """Names cleaned and replaced by aliases, and how each was resolved."""
    raw = F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit("   ")), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("  ("), "p_brand", F.lit(") x"))).otherwise(" "))
    plain = names.normal_name(raw)
    status = F.when(F.lower(plain).isin(*ALIASES), "special").when(F.lower(plain).contains("widget"), "matched").otherwise("unmatched")
    return table(spark, d, "part").select("p_partkey", names.normal_name(raw, ALIASES).alias("name"), status.alias("status"))


FILES = {"FURNITURE": "furniture.csv", "MACHINERY": "machines.csv"}


@query("SELECT c_custkey, CASE c_mktsegment " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FILES.items()) + " END AS file FROM customer")
def name_to_file(spark: SparkSession, d: str) -> DataFrame:
    """Names looked up in a fixed map, else null."""
    known = F.create_map(*(F.lit(x) for kv in FILES.items() for x in kv))
    return table(spark, d, "customer").select("c_custkey", F.try_element_at(known, F.col("c_mktsegment")).alias("file"))


PATHS = "(SELECT event_id, '/data/' || CASE event_id % 4 WHEN 0 THEN 'NDVI' WHEN 1 THEN 'evi' WHEN 2 THEN 'raw' ELSE 'EVI/ndvi' END || '/' || CASE event_id % 3 WHEN 0 THEN 'R10m' WHEN 1 THEN 'r_20 M' ELSE 'full' END || '/x' || CASE WHEN event_id % 5 = 0 THEN strftime(ts, '%Y_%m_%d') WHEN event_id % 5 = 1 THEN '2024-02-31' WHEN event_id % 5 = 2 THEN '120241' ELSE strftime(ts, '%Y-%m-%d') END || '.tif' AS path, ts FROM events)"


def _paths(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    kind = F.when(k % 4 == 0, "NDVI").when(k % 4 == 1, "evi").when(k % 4 == 2, "raw").otherwise("EVI/ndvi")
    resolution = F.when(k % 3 == 0, "R10m").when(k % 3 == 1, "r_20 M").otherwise("full")
    day = F.when(k % 5 == 0, F.date_format("ts", "yyyy_MM_dd")).when(k % 5 == 1, "2024-02-31").when(k % 5 == 2, "120241").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return table(spark, d, "events").select("event_id", F.concat(F.lit("/data/"), kind, F.lit("/"), resolution, F.lit("/x"), day, F.lit(".tif")).alias("path"))


@query(f"SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'NDVI' WHEN 1 THEN 'EVI' WHEN 3 THEN 'NDVI' END AS index_type, CASE event_id % 3 WHEN 0 THEN 'R10m' WHEN 1 THEN 'R20m' END AS resolution, CASE WHEN event_id % 5 <> 2 THEN CAST(year(ts) AS INT) END AS year, CASE WHEN event_id % 5 NOT IN (1, 2) THEN CAST(ts AS DATE) END AS day FROM {PATHS}")
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    """Index type, resolution, year and day told by a path."""
    path = F.col("path")
    return _paths(spark, d).select("event_id", names.index_type_of(path).alias("index_type"), names.resolution_of(path).alias("resolution"), names.year_of(path).alias("year"), names.date_of(path).alias("day"))


@query("SELECT p_partkey, p_size || '.' || (p_partkey % 20) || '.' || (p_partkey % 7) AS version, (p_size + 1) || '.0.0' AS major, p_size || '.' || (p_partkey % 20 + 1) || '.0' AS minor, p_size || '.' || (p_partkey % 20) || '.' || (p_partkey % 7 + 1) AS patch, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey % 20, p_partkey % 7, p_partkey) = 1 AS least FROM part")
def version_bumps(spark: SparkSession, d: str) -> DataFrame:
    """Versions raised in each part, and the least of each brand by its numbers."""
    version = F.concat_ws(".", "p_size", F.col("p_partkey") % 20, F.col("p_partkey") % 7)
    rows = table(spark, d, "part").select("p_partkey", "p_brand", version.alias("version"))
    first = rows.groupBy("p_brand").agg(F.min(F.struct(names.version_key(F.col("version")), F.col("p_partkey").alias("k"))).alias("x")).select("p_brand", F.col("x.k").alias("_k"))
    bumps = [names.bumped(F.col("version"), part).alias(part) for part in ("major", "minor", "patch")]
    return rows.join(first, "p_brand").select("p_partkey", "version", *bumps, (F.col("p_partkey") == F.col("_k")).alias("least"))


@query("SELECT event_id, CASE WHEN event_id % 4 IN (0, 1) THEN round(value, 4) END AS number, CASE WHEN event_id % 3 = 0 THEN CAST(1890 + event_id % 300 AS INT) END AS raw_year, CASE WHEN event_id % 3 = 0 AND 1890 + event_id % 300 BETWEEN 1900 AND 2100 THEN CAST(1890 + event_id % 300 AS INT) END AS year FROM events")
def loose_values(spark: SparkSession, d: str) -> DataFrame:
    """Numbers and years from loosely typed text; blanks, words and infinities are null."""
    k = F.col("event_id")
    text = F.when(k % 4 == 0, F.col("value").cast("string")).when(k % 4 == 1, F.concat(F.lit("  "), F.col("value").cast("string"), F.lit(" "))).when(k % 4 == 2, "n/a").otherwise("Infinity")
    year = F.when(k % 3 == 0, F.concat((1890 + k % 300).cast("string"), F.lit(".0"))).when(k % 3 == 1, "").otherwise("year")
    return table(spark, d, "events").select("event_id", F.round(names.as_double(text), 4).alias("number"), names.as_double(year).cast("int").alias("raw_year"), names.as_year(year).alias("year"))


DAY = "CAST(o_orderdate AS DATE)"


@query(f"SELECT o_orderkey, CASE WHEN month({DAY}) BETWEEN 6 AND 10 THEN 'Kharif' WHEN month({DAY}) >= 11 OR month({DAY}) <= 3 THEN 'Rabi' ELSE 'Zaid' END AS label, {DAY} BETWEEN DATE '1996-03-01' AND DATE '1998-02-28' AS inside, abs(datediff('day', DATE '1997-06-01', {DAY})) <= 45 AS near FROM orders")
def day_labels(spark: SparkSession, d: str) -> DataFrame:
    """The service's name of a month's season, days of a range, and days near another."""
    day = F.to_date("o_orderdate")
    month = F.month(day)
    label = F.when(month.between(6, 10), "Kharif").when((month >= 11) | (month <= 3), "Rabi").otherwise("Zaid")
    return table(spark, d, "orders").select("o_orderkey", label.alias("label"), day.between("1996-03-01", "1998-02-28").alias("inside"), (F.abs(F.datediff(day, F.lit("1997-06-01").cast("date"))) <= 45).alias("near"))


@query("SELECT o_orderkey, month(o_orderdate) IN (6, 7, 8, 9, 10) AS kharif, month(o_orderdate) IN (11, 12, 1, 2, 3) AS rabi, month(o_orderdate) IN (4, 5) AS summer FROM orders")
def season_months(spark: SparkSession, d: str) -> DataFrame:
    """Orders by the months of each season, over the year's end."""
    month = F.month("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", *(month.isin(*seasons.months(s)).alias(s.name.lower()) for s in seasons.SEASONS))


@query("SELECT CAST(y AS INT) AS year, season, s AS start, e AS \"end\" FROM (SELECT y, unnest([{'season': 'Kharif', 's': make_date(y, 6, 1), 'e': make_date(y, 10, 31)}, {'season': 'Rabi', 's': make_date(y, 11, 1), 'e': make_date(y + 1, 3, 31)}, {'season': 'Summer', 's': make_date(y, 4, 1), 'e': make_date(y, 5, 31)}, {'season': 'Late', 's': make_date(y, 12, 1), 'e': last_day(make_date(y + 1, 2, 1))}], recursive := true) FROM (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS y FROM orders))")
def season_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of each season in each year of the orders; a day that its month lacks is the month's last."""
    years = table(spark, d, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    return seasons.windows(years, seasons=(*seasons.SEASONS, seasons.Season("Late", 12, 1, 2, 31))).select("year", "season", "start", "end")


CALENDAR = json.dumps([[s.name, s.start_month, s.start_day, s.end_month, s.end_day] for s in seasons.SEASONS], separators=(",", ":"))


@query(f"SELECT n_nationkey, '1.' || substr(sha256('{CALENDAR}'), 1, 8) AS calendar, substr(sha256(n_name || '|' || n_nationkey), 1, 16) AS stable FROM nation")
def calendar_version(spark: SparkSession, d: str) -> DataFrame:
    """The calendar's version from a hash of its definition, and stable hashes of parts."""
    version = F.concat(F.lit("1."), names.stable_hash(F.lit(CALENDAR), digits=8))
    return table(spark, d, "nation").select("n_nationkey", version.alias("calendar"), names.stable_hash(F.col("n_name"), F.col("n_nationkey").cast("string")).alias("stable"))


DIST = "2 * {r} * asin(sqrt(least(1, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"


@query(f"WITH a AS (SELECT c_custkey, c_nationkey, {place_sql('c_custkey')} FROM customer), b AS (SELECT n_nationkey, {place_sql('n_nationkey')} FROM nation) SELECT c_custkey, round({DIST.format(r=6371.0088)}, 6) AS km, round({DIST.format(r=6371.0)}, 6) AS km_service FROM a JOIN b ON c_nationkey = n_nationkey")
def distances(spark: SparkSession, d: str) -> DataFrame:
    """Great-circle distances on both radii in use."""
    here = table(spark, d, "customer").select("c_custkey", "c_nationkey", *(v.alias(k) for k, v in place("c_custkey").items()))
    there = table(spark, d, "nation").select("n_nationkey", *(v.alias(f"n_{k}") for k, v in place("n_nationkey").items()))
    args = [F.col(c) for c in ("lon", "lat", "n_lon", "n_lat")]
    return here.join(there, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.round(geo.haversine(*args), 6).alias("km"), F.round(geo.haversine(*args, radius=6371.0), 6).alias("km_service"))


@query(f"WITH a AS (SELECT c_custkey, {place_sql('c_custkey')} FROM customer), p AS (SELECT c_custkey, CAST(floor((85 - lat) / 0.25) AS INT) AS r, CAST(floor((lon + 180) / 0.25) AS INT) AS c FROM a) SELECT c_custkey, r AS pixel_row, c AS pixel_col, greatest(r - 8, 0) AS row_off, greatest(c - 8, 0) AS col_off, greatest(least(r + 8, 680) - greatest(r - 8, 0), 0) AS height, greatest(least(c + 8, 1440) - greatest(c - 8, 0), 0) AS width, greatest(8 - r, 0) AS pad_top, greatest(8 - c, 0) AS pad_left FROM p")
def pixel_windows(spark: SparkSession, d: str) -> DataFrame:
    """Pixels of places in a north-up raster, and windows about them clipped to it."""
    rows = table(spark, d, "customer").select("c_custkey", *(v.alias(k) for k, v in place("c_custkey").items()))
    pixel = geo.pixel_of(F.col("lon"), F.col("lat"), F.lit(-180.0), F.lit(85.0), F.lit(0.25), F.lit(0.25))
    rows = rows.select("c_custkey", pixel["row"].alias("pixel_row"), pixel["col"].alias("pixel_col"))
    window = geo.clamped_window(F.col("pixel_row"), F.col("pixel_col"), 16, F.lit(680), F.lit(1440))
    return rows.select("*", *(c.alias(n) for n, c in window.items()))


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'EPSG:4326' WHEN 1 THEN 'EPSG:4326' ELSE 'EPSG:32643' END AS crs, s_suppkey % 3 <> 2 AS same FROM supplier")
def crs_equality(spark: SparkSession, d: str) -> DataFrame:
    """Reference systems compared however they are spaced and cased."""
    raw = F.when(F.col("s_suppkey") % 3 == 0, "epsg:4326").when(F.col("s_suppkey") % 3 == 1, " EPSG: 4326 ").otherwise("Epsg:32643")
    crs = geo.normal_crs(raw)
    return table(spark, d, "supplier").select("s_suppkey", crs.alias("crs"), (crs == geo.normal_crs(F.lit("EPSG :4326"))).alias("same"))


@query("WITH r AS (SELECT event_id, least(greatest(value / 500, 0), 1) AS c FROM events), p AS (SELECT event_id, c, (1 - c) / 3 AS rest FROM r) SELECT event_id, round(c, 6) AS first, round(rest, 6) AS others, round(-(CASE WHEN c > 0 THEN c * log2(greatest(c, 1e-12)) ELSE 0 END) - 3 * rest * log2(greatest(rest, 1e-12)), 6) AS bits FROM p")
def confidence_rows(spark: SparkSession, d: str) -> DataFrame:
    """A confidence as probabilities of four classes, the rest shared evenly, and their entropy."""
    c = F.least(F.greatest(F.col("value") / 500, F.lit(0.0)), F.lit(1.0))
    rows = table(spark, d, "events").select("event_id", arrays.from_confidence(c, 4).alias("p"))
    return rows.select("event_id", F.round(F.col("p")[0], 6).alias("first"), F.round(F.col("p")[1], 6).alias("others"), F.round(arrays.entropy(F.col("p")), 6).alias("bits"))


@query("WITH n AS (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS side FROM nation) SELECT n_nationkey, CAST(68.0 + (n_nationkey % side) * 0.5 AS DOUBLE) AS min_lon, CAST(8.0 + (n_nationkey // side) * 0.5 AS DOUBLE) AS min_lat, substr(md5(n_name), 1, 8) AS tag FROM nation, n")
def seeded_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes laid out on a square grid by their number, with a tag from the name."""
    rows = table(spark, d, "nation")
    side = rows.agg(F.ceil(F.sqrt(F.count("*"))).cast("long").alias("side"))
    k = F.col("n_nationkey")
    return rows.crossJoin(F.broadcast(side)).select("n_nationkey", (68.0 + F.pmod(k, "side") * 0.5).alias("min_lon"), (8.0 + F.floor(k / F.col("side")) * 0.5).alias("min_lat"), F.substring(F.md5("n_name"), 1, 8).alias("tag"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(event_id % 12 + 1 AS INT) AS first_month, 3::BIGINT AS n_months FROM events")
def json_lists(spark: SparkSession, d: str) -> DataFrame:
    """Fields and lists held as JSON text."""
    months = F.format_string("[%d, 6, 7]", F.col("event_id") % 12 + 1)
    decoded = F.from_json(months, "array<int>")
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), decoded[0].alias("first_month"), F.size(decoded).cast("long").alias("n_months"))


@query("SELECT CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 7 = 1 THEN '__missing__' ELSE o_orderpriority END AS category, count(*) AS n FROM orders GROUP BY 1")
def named_categories(spark: SparkSession, d: str) -> DataFrame:
    """Categories with nulls and blanks as one of their own."""
    raw = F.when(F.col("o_orderkey") % 7 == 0, F.lit(None).cast("string")).when(F.col("o_orderkey") % 7 == 1, "  ").otherwise(F.col("o_orderpriority"))
    return table(spark, d, "orders").select(prepare.category(raw).alias("category")).groupBy("category").agg(F.count("*").alias("n"))


@query("WITH e AS (SELECT user_id, list_sort(list_distinct(list(CAST(ts AS DATE)))) AS d FROM events GROUP BY 1), g AS (SELECT user_id, d, list_transform(range(1, len(d)), lambda i: datediff('day', d[i], d[i + 1])) AS g FROM e) SELECT user_id, len(d) AS n_days, datediff('day', d[1], d[len(d)]) AS span, round(len(d) / (datediff('day', d[1], d[len(d)]) + 1), 6) AS coverage, coalesce(list_max(g), 0) AS max_gap, round(coalesce(list_avg(g), 0), 6) AS mean_gap FROM g")
def temporal_features(spark: SparkSession, d: str) -> DataFrame:
    """Counts, span, coverage and gaps of each user's days; only distinct days are gathered."""
    days = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day")).distinct()
    rows = days.groupBy("user_id").agg(F.count("*").alias("n_days"), F.min("day").alias("a"), F.max("day").alias("b"))
    from agrarium.operators.sequences import gaps

    held = gaps(days, "user_id", "day").groupBy("user_id").agg(F.max("gap").alias("max_gap"), F.avg("gap").alias("mean_gap"))
    span = F.datediff("b", "a").cast("long")
    return rows.join(held, "user_id", "left").select("user_id", "n_days", span.alias("span"), F.round(F.col("n_days") / (span + 1), 6).alias("coverage"), F.coalesce("max_gap", F.lit(0)).cast("long").alias("max_gap"), F.round(F.coalesce("mean_gap", F.lit(0.0)), 6).alias("mean_gap"))


@query("WITH c AS (SELECT vec_id, label, embedding[64] AS z, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), p AS (SELECT vec_id, label % 64 AS y, list_transform(v, lambda x: exp(x)) AS e FROM c), q AS (SELECT vec_id, y, e, list_sum(e) AS s FROM p), r AS (SELECT vec_id, greatest(e[y + 1] / s, 1e-12) AS py, list_sum(list_transform(e, lambda x: ln(greatest(x / s, 1e-12)))) AS whole FROM q) SELECT vec_id, round(-ln(py), 6) AS ce, round(-(0.9 * ln(py) + 0.1 / 64 * whole), 6) AS smoothed, round(-pow(1 - py, 2) * ln(py), 6) AS focal FROM r")
def class_losses(spark: SparkSession, d: str) -> DataFrame:
    """Cross-entropy, with smoothed labels too, and focal loss of scores of 64 classes."""
    from agrarium.operators import evaluation

    rows = table(spark, d, "embeddings").select("vec_id", (F.col("label") % 64).alias("y"), arrays.softmax(F.col("embedding")).alias("p"))
    p, y = F.col("p"), F.col("y")
    return rows.select("vec_id", F.round(evaluation.cross_entropy(p, y), 6).alias("ce"), F.round(evaluation.cross_entropy(p, y, 0.1), 6).alias("smoothed"), F.round(evaluation.focal_loss(p, y), 6).alias("focal"))


@query("SELECT l_returnflag, round(avg(e * e), 2) AS mse, round(avg(CASE WHEN e <= 5000 THEN e * e / 2 ELSE 5000 * (e - 2500) END), 2) AS huber, round(0.7 * avg(e * e) + 0.3 * avg(CASE WHEN e <= 5000 THEN e * e / 2 ELSE 5000 * (e - 2500) END), 2) AS multi_task FROM (SELECT l_returnflag, abs(l_extendedprice - l_quantity * 1500) AS e FROM lineitem) GROUP BY 1")
def number_losses(spark: SparkSession, d: str) -> DataFrame:
    """Squared and Huber losses, and a weighted sum of two tasks."""
    from agrarium.operators import evaluation

    y, p = F.col("l_extendedprice"), F.col("l_quantity") * 1500
    mse, huber = F.avg((y - p) * (y - p)), F.avg(evaluation.huber(y, p, 5000.0))
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(mse, 2).alias("mse"), F.round(huber, 2).alias("huber"), F.round(0.7 * mse + 0.3 * huber, 2).alias("multi_task"))
