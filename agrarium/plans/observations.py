"""Places resolved, matched and composed into observations, over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agrarium.functions import seasons
from agrarium.functions.names import normal_name
from agrarium.operators import joins, resolve, spatial
from agrarium.plans.alignment import KM, place, place_sql
from agrarium.plans.registry import query
from agrarium.sources.tables import table


def _points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", *(v.alias(k) for k, v in place("c_custkey").items()))


def _spots(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", *(v.alias(f"place_{k}") for k, v in place("s_suppkey").items()))


BOTH = f"c AS (SELECT c_custkey, {place_sql('c_custkey')} FROM customer), s AS (SELECT s_suppkey, {place_sql('s_suppkey')} FROM supplier)"


@query(f"WITH {BOTH}, p AS (SELECT c_custkey, s_suppkey, {KM.format(a='c', b='s')} AS km FROM c, s) SELECT c_custkey, s_suppkey, CAST(r AS INT) AS rank, round(km, 6) AS distance_km FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY km, s_suppkey) AS r FROM p) WHERE r <= 2")
def knn_any(spark: SparkSession, d: str) -> DataFrame:
    """The two nearest suppliers of each customer, however far."""
    found = spatial.nearest(_points(spark, d), _spots(spark, d), "c_custkey", "s_suppkey", 2)
    return found.select("c_custkey", "s_suppkey", "rank", F.round("distance_km", 6).alias("distance_km"))


@query(f"WITH {BOTH}, p AS (SELECT c_custkey, s_suppkey, sqrt(pow(c.lon - s.lon, 2) + pow(c.lat - s.lat, 2)) AS deg FROM c, s) SELECT c_custkey, s_suppkey, CAST(r AS INT) AS rank, round(deg, 6) AS degrees FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY deg, s_suppkey) AS r FROM p) WHERE r <= 2")
def knn_degrees(spark: SparkSession, d: str) -> DataFrame:
    """The two nearest suppliers by plain distance in degrees."""
    found = spatial.nearest_degrees(_points(spark, d), _spots(spark, d), "c_custkey", "s_suppkey", 2)
    return found.select("c_custkey", "s_suppkey", "rank", F.round("degrees", 6).alias("degrees"))


@query(f"WITH c AS (SELECT c_custkey, {place_sql('c_custkey')} FROM customer), t AS (SELECT n_nationkey, (n_nationkey * 14.0 - 180) AS x, (n_nationkey * 6.0 - 80) AS y FROM nation) SELECT c_custkey, CAST(min(n_nationkey) AS INT) AS n_nationkey FROM c, t WHERE lon >= x AND lat >= y AND (lon - x) / 60 + (lat - y) / 40 <= 1 GROUP BY 1")
def pip_first(spark: SparkSession, d: str) -> DataFrame:
    """The first nation whose triangle holds a customer."""
    from agrarium.plans.alignment import pip_join

    return pip_join(spark, d).groupBy("c_custkey").agg(F.min("n_nationkey").cast("int").alias("n_nationkey"))


BOXES = "SELECT 'taluk' AS level, n_name AS name, n_nationkey * 14.0 - 180 AS x1, n_nationkey * 14.0 - 150 AS x2, n_nationkey * 6.0 - 80 AS y1, n_nationkey * 6.0 - 60 AS y2 FROM nation UNION ALL SELECT 'district', r_name, r_regionkey * 60.0 - 180, r_regionkey * 60.0 - 80, -70.0, 60.0 FROM region"


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    n, r = F.col("n_nationkey"), F.col("r_regionkey")
    a = table(spark, d, "nation").select(F.lit("taluk").alias("level"), F.col("n_name").alias("name"), (n * 14.0 - 180).alias("min_lon"), (n * 14.0 - 150).alias("max_lon"), (n * 6.0 - 80).alias("min_lat"), (n * 6.0 - 60).alias("max_lat"))
    b = table(spark, d, "region").select(F.lit("district").alias("level"), F.col("r_name").alias("name"), (r * 60.0 - 180).alias("min_lon"), (r * 60.0 - 80).alias("max_lon"), F.lit(-70.0).alias("min_lat"), F.lit(60.0).alias("max_lat"))
    return a.unionByName(b)


LEVELS_SQL = f"SELECT c_custkey, arg_min(name, ((x2 - x1) * (y2 - y1), name)) FILTER (level = 'taluk') AS taluk, arg_min(name, ((x2 - x1) * (y2 - y1), name)) FILTER (level = 'district') AS district FROM (SELECT c_custkey, {place_sql('c_custkey')} FROM customer) LEFT JOIN ({BOXES}) ON lon BETWEEN x1 AND x2 AND lat BETWEEN y1 AND y2 GROUP BY 1"


@query(f"SELECT *, coalesce(taluk, district) AS deepest FROM ({LEVELS_SQL})")
def smallest_boxes(spark: SparkSession, d: str) -> DataFrame:
    """The smallest box of each level that holds a customer, and the deepest level there is."""
    return spatial.smallest_boxes(_points(spark, d), _boxes(spark, d), "c_custkey", "level", "name", ["taluk", "district"])


@query("SELECT n_name AS name, 'taluk' AS level, round(n_nationkey * 14.0 - 160, 6)::DOUBLE AS lon, round(n_nationkey * 6.0 - 80 + 40.0 / 3, 6)::DOUBLE AS lat FROM nation UNION ALL SELECT r_name, 'district', (r_regionkey * 60.0 - 130)::DOUBLE, -5.0::DOUBLE FROM region")
def boundary_union(spark: SparkSession, d: str) -> DataFrame:
    """Boundaries of two sources under one schema, with their centroids."""
    from agrarium.sources import boundaries

    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    n, r = F.col("n_nationkey"), F.col("r_regionkey")
    x, y, a = n * 14.0 - 180, n * 6.0 - 80, r * 60.0 - 180
    triangles = table(spark, d, "nation").select("n_name", F.array(corner(x, y), corner(x + 60, y), corner(x, y + 40), corner(x, y)).alias("ring"))
    boxes = table(spark, d, "region").select("r_name", F.array(*(corner(a + dx, F.lit(dy)) for dx, dy in ((0, -70), (100, -70), (100, 60), (0, 60), (0, -70)))).alias("ring"))
    found = boundaries.union(boundaries.normalised(triangles, "n_name", "taluk"), boundaries.normalised(boxes, "r_name", "district"))
    return boundaries.centroids(found).select("name", "level", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query(f"WITH c AS (SELECT c_custkey, {place_sql('c_custkey')} FROM customer), h AS (SELECT c_custkey, CASE n_nationkey % 3 WHEN 0 THEN 'village' WHEN 1 THEN 'taluk' ELSE 'district' END AS level, n_name FROM c, nation WHERE lon >= n_nationkey * 14.0 - 180 AND lat >= n_nationkey * 6.0 - 80 AND (lon - (n_nationkey * 14.0 - 180)) / 60 + (lat - (n_nationkey * 6.0 - 80)) / 40 <= 1), w AS (SELECT c_custkey, max(n_name) FILTER (level = 'village') AS village, max(n_name) FILTER (level = 'taluk') AS taluk, max(n_name) FILTER (level = 'district') AS district FROM h GROUP BY 1) SELECT *, coalesce(village, taluk, district) AS deepest FROM w")
def admin_levels(spark: SparkSession, d: str) -> DataFrame:
    """The boundaries that hold a customer, one column for each level, and the deepest."""
    from agrarium.plans.alignment import pip_join

    hits = pip_join(spark, d).join(table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey")
    k = F.col("n_nationkey")
    hits = hits.withColumn("level", F.when(k % 3 == 0, "village").when(k % 3 == 1, "taluk").otherwise("district"))
    return spatial.levels_of(hits, "c_custkey", "level", "n_name", ["village", "taluk", "district"])


@query("WITH RECURSIVE n AS (SELECT s_suppkey + 1 AS k, CASE WHEN s_suppkey > 0 THEN (s_suppkey + 1) // 2 END AS p, s_name AS name FROM supplier), w AS (SELECT k, p, name AS path FROM n UNION ALL SELECT w.k, n.p, w.path || '>' || n.name FROM w JOIN n ON w.p = n.k) SELECT k AS node, path FROM w WHERE p IS NULL")
def root_paths(spark: SparkSession, d: str) -> DataFrame:
    """Names from each supplier up to the root of a tree of any depth."""
    k = F.col("s_suppkey")
    nodes = table(spark, d, "supplier").select((k + 1).alias("node"), F.when(k > 0, F.floor((k + 1) / 2)).alias("parent"), F.col("s_name").alias("name"))
    return joins.root_paths(nodes, "node", "parent", "name").select("node", F.array_join("path", ">").alias("path"))


@query("""WITH h AS (SELECT c_mktsegment AS place, c_nationkey % 3 AS district, CASE WHEN month(o_orderdate) < 7 THEN 'a' ELSE 'b' END AS season, year(o_orderdate) AS year, min(o_orderkey) AS k FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 3 = 0 GROUP BY ALL),
p AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'FURNITURE' WHEN 1 THEN 'MACHINERY' WHEN 2 THEN 'BUILDING' ELSE 'NOWHERE' END AS place, s_nationkey % 5 AS district, CASE WHEN s_suppkey % 2 = 0 THEN 'a' ELSE 'b' END AS season, 1990 + s_suppkey % 15 AS year FROM supplier)
SELECT s_suppkey, CAST(years_off AS INT) AS years_off, k FROM (SELECT p.*, abs(p.year - h.year) AS years_off, h.k, row_number() OVER (PARTITION BY s_suppkey ORDER BY (p.district <> h.district)::INT, (p.season <> h.season)::INT, abs(p.year - h.year), h.year, h.k) AS r FROM p LEFT JOIN h USING (place)) WHERE r = 1""")
def historical_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The history's nearest year of the same place, first of the same district and season."""
    history = table(spark, d, "orders").where("o_orderkey % 3 = 0").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("place"), (F.col("c_nationkey") % 3).alias("district"), F.when(F.month("o_orderdate") < 7, "a").otherwise("b").alias("season"), F.year("o_orderdate").alias("year"), F.col("o_orderkey").alias("k"))
    s = F.col("s_suppkey")
    named = F.when(s % 4 == 0, "FURNITURE").when(s % 4 == 1, "MACHINERY").when(s % 4 == 2, "BUILDING").otherwise("NOWHERE")
    probes = table(spark, d, "supplier").select("s_suppkey", named.alias("place"), (F.col("s_nationkey") % 5).alias("district"), F.when(s % 2 == 0, "a").otherwise("b").alias("season"), (1990 + s % 15).cast("int").alias("year"))
    return joins.historical_lookup(probes, history, "place", "district", "season", "year", ["k"]).select("s_suppkey", "years_off", "k")


@query("""WITH t AS (SELECT n_nationkey AS k, n_name AS name, n_nationkey % 2 AS kind FROM nation), p AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN n_name WHEN 1 THEN '  ' || lower(n_name) WHEN 2 THEN substr(n_name, 1, 4) ELSE 'zz' || s_suppkey END AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
c AS (SELECT s_suppkey, k, CASE WHEN lower(trim(t.name)) = lower(trim(p.name)) THEN 1 WHEN starts_with(lower(trim(t.name)), lower(trim(p.name))) THEN 2 END AS s FROM p, t)
SELECT s_suppkey, CAST(arg_min(k, (s, k)) AS INT) AS place, CASE min(s) WHEN 1 THEN 'name' ELSE 'prefix' END AS strategy FROM c WHERE s IS NOT NULL GROUP BY 1""")
def name_or_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Places by name, else by the beginning of the name."""
    nation = table(spark, d, "nation")
    s = F.col("s_suppkey")
    named = F.when(s % 4 == 0, F.col("n_name")).when(s % 4 == 1, F.concat(F.lit("  "), F.lower("n_name"))).when(s % 4 == 2, F.substring("n_name", 1, 4)).otherwise(F.concat(F.lit("zz"), s))
    probes = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", named.alias("name"))
    places = nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("place_name"))
    found = resolve.by_name(probes, places, "name", "place_name").groupBy("s_suppkey").agg(F.min(F.struct("strategy", "k")).alias("x"))
    return found.select("s_suppkey", F.col("x.k").cast("int").alias("place"), F.when(F.col("x.strategy") == 1, "name").otherwise("prefix").alias("strategy"))


@query(f"""WITH t AS (SELECT n_nationkey AS k, n_name AS name, {place_sql('n_nationkey')} FROM nation), p AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN n_name END AS name, {place_sql('s_suppkey')} FROM supplier JOIN nation ON s_nationkey = n_nationkey),
c AS (SELECT s_suppkey, k, 1 AS s, 0.0 AS km FROM p JOIN t ON p.name = t.name UNION ALL SELECT s_suppkey, k, CASE WHEN {KM.format(a='p', b='t')} <= 400 THEN 3 WHEN abs(p.lon - t.lon) <= 2 AND abs(p.lat - t.lat) <= 2 THEN 4 ELSE 5 END, {KM.format(a='p', b='t')} FROM p, t WHERE p.name IS NULL)
SELECT s_suppkey, CAST(k AS INT) AS place, ['name', 'prefix', 'radius', 'box', 'nearest'][s] AS strategy, CASE WHEN s > 1 THEN round(km, 4) END AS distance_km FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY s, km, k) AS r FROM c) WHERE r = 1""")
def located_places(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' places by name, else by radius, box or the nearest one."""
    nation = table(spark, d, "nation")
    probes = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.col("n_name")).alias("name"), F.lit("x").alias("kind"), *(v.alias(k) for k, v in place("s_suppkey").items()))
    places = nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("place_name"), F.lit("x").alias("place_kind"), *(v.alias(f"place_{k}") for k, v in place("n_nationkey").items()))
    found = resolve.located(probes, places, "s_suppkey", "k", km=400.0, tolerance=2.0).where("rank = 1")
    return found.select("s_suppkey", F.col("k").cast("int").alias("place"), "strategy", F.round("distance_km", 4).alias("distance_km"))


TABULAR = "SELECT p_partkey AS pos, p_name AS village, p_brand AS taluk, p_type AS district, CAST(1995 + p_partkey % 3 AS INT) AS year, CASE WHEN p_partkey % 2 = 0 THEN 'Kharif' ELSE 'Rabi' END AS season, p_retailprice AS price, p_partkey % 4 = 0 AS second FROM part"
ASKED = "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'cold widget' WHEN 1 THEN 'WIDGET' WHEN 2 THEN 'no such village' ELSE 'bolt' END AS village, CASE WHEN c_custkey % 3 = 0 THEN 'Brand#13' ELSE 'Brand#99' END AS taluk, CASE WHEN c_custkey % 5 = 0 THEN 'ECONOMY' ELSE 'nothing' END AS district, CAST(1995 + c_custkey % 4 AS INT) AS year, CASE WHEN c_custkey % 2 = 0 THEN 'Kharif' ELSE 'Rabi' END AS season FROM customer"
MATCH_SQL = f"""WITH t AS ({TABULAR}), p AS ({ASKED}), l AS (SELECT c_custkey, year, season, 0 AS j, village AS name FROM p UNION ALL SELECT c_custkey, year, season, 1, taluk FROM p WHERE taluk <> village UNION ALL SELECT c_custkey, year, season, 2, district FROM p),
m AS (SELECT c_custkey, CASE WHEN second THEN 1 ELSE 0 END AS i, j, pos, CASE WHEN v = name THEN 1 WHEN list_contains(list_transform(string_split_regex(v, '[/|]'), lambda x: trim(x)), name) THEN 2 WHEN contains(lower(v), lower(name)) THEN 3 END AS stage FROM (SELECT l.*, t.pos, t.second, CASE j WHEN 0 THEN t.village WHEN 1 THEN t.taluk ELSE t.district END AS v FROM l JOIN t USING (year, season))),
k AS (SELECT c_custkey, 0 AS last, i, j, arg_min(pos, (stage, pos)) AS pos FROM m WHERE stage IS NOT NULL GROUP BY ALL UNION ALL SELECT c_custkey, 1, CASE WHEN second THEN 1 ELSE 0 END, -1, min(pos) FROM p JOIN t USING (year, season) GROUP BY ALL),
b AS (SELECT c_custkey, arg_min(j, (last, i, j, pos)) AS j, arg_min(i, (last, i, j, pos)) AS i, arg_min(pos, (last, i, j, pos)) AS pos FROM k GROUP BY 1)
SELECT c_custkey, CASE j WHEN 0 THEN 'village' WHEN 1 THEN 'taluk' WHEN 2 THEN 'district' WHEN -1 THEN 'none' END AS level, CAST(i AS INT) AS source, price FROM p LEFT JOIN b USING (c_custkey) LEFT JOIN t USING (pos)"""


def _tabular(spark: SparkSession, d: str) -> list[DataFrame]:
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(k.alias("pos"), F.col("p_name").alias("village"), F.col("p_brand").alias("taluk"), F.col("p_type").alias("district"), (1995 + k % 3).cast("int").alias("year"), F.when(k % 2 == 0, "Kharif").otherwise("Rabi").alias("season"), F.col("p_retailprice").alias("price"))
    return [rows.where("pos % 4 <> 0"), rows.where("pos % 4 = 0")]


def _asked(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    village = F.when(k % 4 == 0, "cold widget").when(k % 4 == 1, "WIDGET").when(k % 4 == 2, "no such village").otherwise("bolt")
    return table(spark, d, "customer").select(k, village.alias("village"), F.when(k % 3 == 0, "Brand#13").otherwise("Brand#99").alias("taluk"), F.when(k % 5 == 0, "ECONOMY").otherwise("nothing").alias("district"), (1995 + k % 4).cast("int").alias("year"), F.when(k % 2 == 0, "Kharif").otherwise("Rabi").alias("season"))


@query(MATCH_SQL)
def tabular_match(spark: SparkSession, d: str) -> DataFrame:
    """Tabular rows by village, taluk, district, over two tables in order; any row of the season at last."""
    found = resolve.tabular_match(_asked(spark, d), _tabular(spark, d), "c_custkey", ["village", "taluk", "district"], ["year", "season"], "pos", ["price"])
    return found.select("c_custkey", "level", "source", "price")


def _plain_sql(x: str) -> str:
    plain = rf"trim(regexp_replace(regexp_replace(trim({x}), '\s+', ' ', 'g'), '\s*\(.*$', ''))"
    return f"CASE lower({plain}) WHEN 'spindle' THEN 'hot ring' WHEN 'brand#99' THEN 'Brand#12' ELSE {plain} END"


#: Names that stand for others in the query below.
ALIASES = {"spindle": "hot ring", "brand#99": "Brand#12"}
FEATURES_SQL = f"""WITH t0 AS (SELECT p_partkey AS pos, CASE WHEN p_partkey % 3 = 0 THEN p_name || '  (North)' WHEN p_partkey % 3 = 1 THEN p_name || ' / x' || p_partkey % 40 ELSE p_name END AS village, p_brand AS taluk, p_type AS district, CAST(1995 + p_partkey % 3 AS INT) AS year, CASE WHEN p_partkey % 2 = 0 THEN 'KHARIF 2' WHEN p_partkey % 5 = 0 THEN 'Rabi/Summer' ELSE 'Rabi' END AS season, p_retailprice AS price, p_size AS size, p_partkey % 4 AS i, CAST(p_size - 25 AS DOUBLE) AS ra, CAST(p_partkey % 29 - 8 AS DOUBLE) AS ma, CAST(p_partkey % 100 AS DOUBLE) AS ry, CAST(p_retailprice AS DOUBLE) AS my FROM part),
t AS (SELECT * REPLACE (CASE WHEN i = 0 THEN 1 ELSE 0 END AS i), {_plain_sql('village')} AS n0, {_plain_sql('taluk')} AS n1, {_plain_sql('district')} AS n2 FROM t0),
p AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'cold widget (South)' WHEN 1 THEN 'WIDGET' WHEN 2 THEN 'Spindle' WHEN 3 THEN 'x' || c_custkey % 40 WHEN 4 THEN 'w.dget /' ELSE '(none)' END AS village, CASE WHEN c_custkey % 3 = 0 THEN 'Brand#13' ELSE 'brand#99' END AS taluk, CASE WHEN c_custkey % 5 = 0 THEN 'ECONOMY' ELSE 'nothing' END AS district, CAST(1995 + c_custkey % 4 AS INT) AS year, CASE c_custkey % 4 WHEN 0 THEN 'kharif' WHEN 1 THEN 'Rabi' WHEN 2 THEN 'summer ' ELSE ' ' END AS season FROM customer),
l AS (SELECT c_custkey, year, season, 0 AS j, village AS name FROM p UNION ALL SELECT c_custkey, year, season, 1, taluk FROM p UNION ALL SELECT c_custkey, year, season, 2, district FROM p),
q AS (SELECT *, nullif({_plain_sql('name')}, '') AS n FROM l),
m AS (SELECT c_custkey, i, j, pos, CASE WHEN v = n THEN 1 WHEN list_contains(list_transform(string_split_regex(v, '[/|]'), lambda x: trim(x)), n) THEN 2 WHEN contains(lower(v), lower(n)) THEN 3 WHEN regexp_matches(raw, name, 'i') THEN 4 END AS stage FROM (SELECT q.*, t.pos, t.i, CASE j WHEN 0 THEN t.n0 WHEN 1 THEN t.n1 ELSE t.n2 END AS v, CASE j WHEN 0 THEN t.village WHEN 1 THEN t.taluk ELSE t.district END AS raw FROM q JOIN t ON q.year = t.year AND contains(lower(t.season), lower(trim(q.season))))),
k AS (SELECT c_custkey, 0 AS last, i, j, arg_min(pos, (stage, pos)) AS pos FROM m WHERE stage IS NOT NULL GROUP BY ALL UNION ALL SELECT c_custkey, 1, i, -1, min(pos) FROM p JOIN t ON p.year = t.year AND contains(lower(t.season), lower(trim(p.season))) GROUP BY ALL),
b AS (SELECT c_custkey, arg_min(j, (last, i, j, pos)) AS j, arg_min(i, (last, i, j, pos)) AS i, arg_min(pos, (last, i, j, pos)) AS pos FROM k GROUP BY 1),
w AS (SELECT *, CASE WHEN ra > 0 AND ra >= ma THEN 'Rice' WHEN ma > 0 THEN 'Maize' WHEN ry >= my AND ry > 0 THEN 'Rice' ELSE 'Maize' END AS wide FROM t)
SELECT c_custkey, CASE j WHEN 0 THEN 'village' WHEN 1 THEN 'taluk' WHEN 2 THEN 'district' WHEN -1 THEN 'none' END AS level, CAST(b.i AS INT) AS source, CASE WHEN b.i = 0 THEN taluk ELSE wide END AS crop, round(CASE WHEN b.i = 0 THEN price WHEN wide = 'Rice' THEN ry ELSE my END, 4) AS yield_value, CAST(CASE WHEN b.i = 0 THEN CAST(size AS DOUBLE) WHEN greatest(ra, ma) > 0 THEN greatest(ra, ma) END AS DOUBLE) AS feature
FROM (SELECT c_custkey FROM p) LEFT JOIN b USING (c_custkey) LEFT JOIN w USING (pos)"""


@query(FEATURES_SQL)
def tabular_features(spark: SparkSession, d: str) -> DataFrame:
    """Crop, yield and a feature of the tabular row by village, taluk, district: a table with a crop column, then a wide one; seasons by what their text holds, names by aliases."""
    k, c = F.col("p_partkey"), F.col("c_custkey")
    village = F.when(k % 3 == 0, F.concat("p_name", F.lit("  (North)"))).when(k % 3 == 1, F.concat("p_name", F.lit(" / x"), k % 40)).otherwise(F.col("p_name"))
    season = F.when(k % 2 == 0, "KHARIF 2").when(k % 5 == 0, "Rabi/Summer").otherwise("Rabi")
    names = [k.alias("pos"), village.alias("village"), F.col("p_brand").alias("taluk"), F.col("p_type").alias("district"), (1995 + k % 3).cast("int").alias("year"), season.alias("season")]
    part = table(spark, d, "part")
    long = part.where(k % 4 != 0).select(*names, F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"))
    wide = part.where(k % 4 == 0).select(*names, (F.col("p_size") - 25).alias("RICE AREA (1000 ha)"), (k % 29 - 8).alias("MAIZE AREA (1000 ha)"), (k % 100).alias("RICE YIELD (Kg per ha)"), F.col("p_retailprice").alias("MAIZE YIELD (Kg per ha)"))
    village = F.when(c % 6 == 0, "cold widget (South)").when(c % 6 == 1, "WIDGET").when(c % 6 == 2, "Spindle").when(c % 6 == 3, F.concat(F.lit("x"), c % 40)).when(c % 6 == 4, "w.dget /").otherwise("(none)")
    season = F.when(c % 4 == 0, "kharif").when(c % 4 == 1, "Rabi").when(c % 4 == 2, "summer ").otherwise(" ")
    asked = table(spark, d, "customer").select(c, village.alias("village"), F.when(c % 3 == 0, "Brand#13").otherwise("brand#99").alias("taluk"), F.when(c % 5 == 0, "ECONOMY").otherwise("nothing").alias("district"), (1995 + c % 4).cast("int").alias("year"), season.alias("season"))
    sources = [resolve.Tabular(long, "taluk", "price", ("size", "no such column")), resolve.Tabular(wide)]
    found = resolve.tabular_features(asked, sources, "c_custkey", ["village", "taluk", "district"], "year", "season", "pos", plain=lambda x: normal_name(x, ALIASES))
    feature = F.coalesce(F.col("fields")["size"], F.col("fields")["area"]).cast("double")
    return found.select("c_custkey", "level", "source", "crop", F.round("yield_value", 4).alias("yield_value"), feature.alias("feature"))


@query("""WITH o AS (SELECT *, CAST(year(o_orderdate) AS INT) AS y FROM orders), r AS (SELECT 0 AS source, 'c' || o_custkey % 50 AS place, y AS year, o_orderkey AS k FROM o WHERE o_orderkey % 3 = 0 AND o_custkey % 50 >= 10 UNION ALL SELECT 1, 'c' || o_custkey % 70, y, o_orderkey FROM o UNION ALL SELECT 2, 'c' || c_custkey % 100, 0, c_custkey FROM customer),
p AS (SELECT s_suppkey, 'c' || s_suppkey % 120 AS place FROM supplier), f AS (SELECT place, min(source) AS source FROM r GROUP BY 1)
SELECT s_suppkey, CAST(source AS INT) AS source, CAST(year AS INT) AS year, min(k) AS k FROM p JOIN f USING (place) JOIN r USING (place, source) GROUP BY ALL""")
def first_table_years(spark: SparkSession, d: str) -> DataFrame:
    """Each label's years with their first row, from the first of three tables that knows the place: one with unreadable years, one of all orders, one without years."""
    orders, s = table(spark, d, "orders"), F.col("s_suppkey")
    place = lambda key, n: F.concat(F.lit(" C"), F.col(key) % n).alias("place")
    year = F.year("o_orderdate").cast("string")
    some = orders.where("o_orderkey % 3 = 0").select(place("o_custkey", 50), F.when(F.col("o_custkey") % 50 < 10, "n/a").otherwise(F.concat(year, F.lit(".0"))).alias("when"), F.col("o_orderkey").alias("k"))
    every = orders.select(place("o_custkey", 70), year.alias("when"), F.col("o_orderkey").alias("k"))
    rest = table(spark, d, "customer").select(place("c_custkey", 100), F.col("c_custkey").alias("k"))
    labels = table(spark, d, "supplier").select(s, F.concat(F.when(s % 2 == 0, "c").otherwise("C"), s % 120, F.lit(" ")).alias("label"))
    found = resolve.first_table_years(labels, [resolve.Years(some, "place", "when", "k"), resolve.Years(every, "place", "when", "k"), resolve.Years(rest, "place", None, "k")], "label", ["k"])
    return labels.join(found, "label").select("s_suppkey", "source", "year", "k")


@query(f"""WITH t AS (SELECT CASE n_nationkey % 2 WHEN 0 THEN 'village' ELSE 'district' END AS kind, n_name AS name, {place_sql('n_nationkey')} FROM nation), p AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN lower(n_name) || ' ' WHEN 1 THEN ' ' WHEN 2 THEN substr(n_name, 1, 2) WHEN 3 THEN 'nowhere' END AS village, CASE c_custkey % 3 WHEN 0 THEN n_name WHEN 1 THEN 'none' END AS district, CASE WHEN c_custkey % 7 > 2 THEN c_custkey % 90 / 2 END AS lon, CASE WHEN c_custkey % 7 > 1 THEN c_custkey % 40 / 2 END AS lat FROM customer JOIN nation ON c_nationkey = n_nationkey),
q AS (SELECT *, coalesce(nullif(trim(village), ''), nullif(trim(district), '')) AS l, CASE WHEN nullif(trim(village), '') IS NULL THEN 'district' ELSE 'village' END AS want FROM p),
m AS (SELECT q.c_custkey, arg_min({{'name': t.name, 'lon': t.lon, 'lat': t.lat}}, (CASE WHEN lower(t.name) = lower(q.l) THEN 1 ELSE 2 END, (t.kind <> q.want)::INT, t.name)) AS x FROM q JOIN t ON starts_with(lower(t.name), lower(q.l)) GROUP BY 1),
r AS (SELECT q.*, x, CASE WHEN x IS NOT NULL THEN 'place' WHEN l IS NOT NULL AND lon IS NOT NULL AND lat IS NOT NULL THEN 'given' WHEN l IS NOT NULL AND nullif(trim(district), '') IS NOT NULL THEN 'name' WHEN l IS NULL AND lon IS NOT NULL AND lat IS NOT NULL THEN 'coordinates' END AS way FROM q LEFT JOIN m USING (c_custkey))
SELECT c_custkey, CASE way WHEN 'place' THEN x.name WHEN 'coordinates' THEN lat || ', ' || lon WHEN 'given' THEN l WHEN 'name' THEN l END AS label, round(CASE way WHEN 'place' THEN x.lon WHEN 'given' THEN lon WHEN 'coordinates' THEN lon END, 6) AS lon, round(CASE way WHEN 'place' THEN x.lat WHEN 'given' THEN lat WHEN 'coordinates' THEN lat END, 6) AS lat, way FROM r""")
def settled_places(spark: SparkSession, d: str) -> DataFrame:
    """Where each customer is: a known place of the village's or the district's name, else the customer's own coordinates or name."""
    nation, c = table(spark, d, "nation"), F.col("c_custkey")
    n = F.col("n_nationkey")
    places = nation.select(F.when(n % 2 == 0, "village").otherwise("district").alias("place_kind"), F.col("n_name").alias("place_name"), *(v.alias(f"place_{k}") for k, v in place("n_nationkey").items()))
    village = F.when(c % 5 == 0, F.concat(F.lower("n_name"), F.lit(" "))).when(c % 5 == 1, " ").when(c % 5 == 2, F.substring("n_name", 1, 2)).when(c % 5 == 3, "nowhere")
    asked = table(spark, d, "customer").join(nation, F.col("c_nationkey") == n).select(c, village.alias("village"), F.when(c % 3 == 0, F.col("n_name")).when(c % 3 == 1, "none").alias("district"), F.when(c % 7 > 2, c % 90 / 2).alias("lon"), F.when(c % 7 > 1, c % 40 / 2).alias("lat"))
    found = resolve.settled(asked, places, "c_custkey")
    return found.select("c_custkey", "label", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "way")


@query("""WITH o AS (SELECT o_custkey, CAST(year(o_orderdate) AS INT) AS year, o_orderkey, o_orderkey % 2 = 0 AS ndvi, o_totalprice FROM orders), a AS (SELECT o_custkey, year, arg_min(o_totalprice, o_orderkey) AS first_total FROM o WHERE o_orderkey % 3 = 0 GROUP BY ALL), b AS (SELECT o_custkey, year, count(*) FILTER (ndvi) AS n_ndvi, count(*) FILTER (NOT ndvi) AS n_evi, array_to_string(list_sort(list(o_orderkey)), ',') AS records FROM o GROUP BY ALL),
y AS (SELECT o_custkey, unnest(range(min(year), max(year) + 1)) AS year FROM o GROUP BY 1) SELECT o_custkey, CAST(year AS INT) AS year, first_total, coalesce(n_ndvi, 0) AS n_ndvi, coalesce(n_evi, 0) AS n_evi, coalesce(records, '') AS records, first_total IS NULL AND records IS NULL AS missing FROM y LEFT JOIN a USING (o_custkey, year) LEFT JOIN b USING (o_custkey, year)""")
def yearly_history(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's years, first to last: the first tabular row, the records of both kinds, and whether both sides miss it."""
    orders = table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), "o_orderkey", "o_totalprice")
    records = orders.select("o_custkey", "year", "o_orderkey", (F.col("o_orderkey") % 2 == 0).alias("ndvi"))
    found = resolve.yearly(orders.where("o_orderkey % 3 = 0"), records, ["o_custkey", "year"], "o_orderkey", ["o_totalprice"], ["o_orderkey"])
    years = orders.groupBy("o_custkey").agg(F.min("year").alias("a"), F.max("year").alias("b")).select("o_custkey", F.explode(F.sequence("a", "b")).alias("year"))
    held = F.coalesce("records", F.array().cast(found.schema["records"].dataType))
    n = lambda want: F.size(F.filter(held, lambda r: r["ndvi"] == want)).cast("long")
    shown = F.array_join(F.transform(held, lambda r: r["o_orderkey"].cast("string")), ",")
    return years.join(found, ["o_custkey", "year"], "left").select("o_custkey", "year", F.col("first.o_totalprice").alias("first_total"), n(True).alias("n_ndvi"), n(False).alias("n_evi"), shown.alias("records"), (F.col("first").isNull() & F.col("records").isNull()).alias("missing"))


PAIR_SQL = """WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, event_id, event_id % 2 = 0 AS ndvi, CASE WHEN event_id % 3 = 0 THEN 'R10m' ELSE 'R20m' END AS resolution, CASE WHEN event_id % 5 = 0 THEN 'epsg:4326' ELSE 'EPSG:4326' END AS crs, event_id % 4 AS bounds FROM events),
f AS (SELECT user_id, day, ndvi, arg_min({'id': event_id, 'r': resolution, 'c': crs, 'b': bounds}, event_id) AS x FROM e GROUP BY ALL), p AS (SELECT user_id, day, a.x AS n, b.x AS v FROM (SELECT * FROM f WHERE ndvi) a FULL JOIN (SELECT * FROM f WHERE NOT ndvi) b USING (user_id, day))
SELECT user_id, day, n.id AS ndvi, v.id AS evi, concat_ws(',', CASE WHEN n IS NULL THEN 'no_ndvi' END, CASE WHEN v IS NULL THEN 'no_evi' END, CASE WHEN n.r <> v.r THEN 'resolution' END, CASE WHEN lower(n.c) <> lower(v.c) THEN 'crs' END, CASE WHEN n.b <> v.b THEN 'bounds' END) AS issues FROM p"""


@query(PAIR_SQL)
def pair_issues(spark: SparkSession, d: str) -> DataFrame:
    """The first record of each day and kind, paired by day, and in what a pair's sides differ."""
    k = F.col("event_id")
    rows = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), k, F.when(k % 3 == 0, "R10m").otherwise("R20m").alias("resolution"), F.when(k % 5 == 0, "epsg:4326").otherwise("EPSG:4326").alias("crs"), (k % 4).alias("bounds"))
    found = joins.outer_pairs(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 <> 0"), ["user_id", "day"], "event_id", ["event_id", "resolution", "crs", "bounds"])
    return found.select("user_id", "day", F.col("left_event_id").alias("ndvi"), F.col("right_event_id").alias("evi"), F.array_join(joins.pair_issues(["resolution", "crs", "bounds"]), ",").alias("issues"))


@query(f"SELECT user_id, count(*) AS n_dates, count(*) FILTER (ndvi IS NOT NULL AND evi IS NOT NULL) AS n_pairs, count(*) FILTER (ndvi IS NULL) AS no_ndvi, count(*) FILTER (evi IS NULL) AS no_evi, min(day) AS first_day, max(day) AS last_day, datediff('day', min(day), max(day)) AS span, count(*) FILTER (ndvi IS NOT NULL AND evi IS NOT NULL) > 0 AS has_pairs FROM ({PAIR_SQL}) GROUP BY 1")
def sequence_features(spark: SparkSession, d: str) -> DataFrame:
    """Counts of dates, pairs and missing sides, and the span of each user's image sequence."""
    ndvi, evi = F.col("ndvi").isNotNull(), F.col("evi").isNotNull()
    rows = pair_issues(spark, d).groupBy("user_id").agg(F.count("*").alias("n_dates"), F.count_if(ndvi & evi).alias("n_pairs"), F.count_if(~ndvi).alias("no_ndvi"), F.count_if(~evi).alias("no_evi"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    return rows.withColumns({"span": F.datediff("last_day", "first_day").cast("long"), "has_pairs": F.col("n_pairs") > 0})


@query(f"""WITH p AS (SELECT c_custkey, c_acctbal, {place_sql('c_custkey')} FROM customer), f AS (SELECT c_custkey, c_acctbal / 1000 AS a, lon / 100 AS b, lat / 100 AS c FROM p), s AS (SELECT c_custkey, list_transform(range(0, 5), lambda k: exp(a * cos(CAST(k AS DOUBLE)) + b * cos(k + 1.0::DOUBLE) + c * cos(k + 2.0::DOUBLE))) AS e FROM f),
t AS (SELECT c_custkey, list_sort(list_transform(range(0, 5), lambda k: {{'p': -e[k + 1] / list_sum(e), 'k': k}}))[1:3] AS top FROM s), l AS ({LEVELS_SQL}) SELECT t.c_custkey, coalesce(taluk, district) AS boundary, array_to_string(list_transform(top, lambda x: x.k), ',') AS classes, round(-top[1].p, 6) AS confidence FROM t JOIN l USING (c_custkey)""")
def point_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Places resolved, made into features, scored, and their three likeliest classes."""
    from agrarium.functions import arrays
    from agrarium.operators import inference

    points = _points(spark, d)
    features = F.array(F.col("c_acctbal") / 1000, F.col("lon") / 100, F.col("lat") / 100)
    scores = F.array(*(inference.linear(features, F.array(*(F.cos(F.lit(float(k + j))) for j in range(3)))) for k in range(5)))
    scored = points.join(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey").select("c_custkey", arrays.top_classes(arrays.softmax(scores), 3).alias("top"))
    places = spatial.smallest_boxes(points, _boxes(spark, d), "c_custkey", "level", "name", ["taluk", "district"]).select("c_custkey", F.col("deepest").alias("boundary"))
    shown = F.array_join(F.transform("top", lambda x: x["i"].cast("string")), ",")
    return scored.join(places, "c_custkey").select("c_custkey", "boundary", shown.alias("classes"), F.round(F.col("top")[0]["p"], 6).alias("confidence"))


@query("SELECT o_orderkey FROM orders WHERE year(o_orderdate) IN (1996, 1998, 2000) AND month(o_orderdate) IN (6, 7, 8, 9, 10)")
def year_month_window(spark: SparkSession, d: str) -> DataFrame:
    """Records of some years within a season's months."""
    day = F.col("o_orderdate")
    return table(spark, d, "orders").where(F.year(day).isin(1996, 1998, 2000) & F.month(day).isin(seasons.months(seasons.SEASONS[0]))).select("o_orderkey")


@query("WITH m AS (SELECT CAST(max(CASE WHEN month(o_orderdate) <= 3 THEN year(o_orderdate) - 1 ELSE year(o_orderdate) END) AS INT) AS y FROM orders), p AS (SELECT c_custkey, c_custkey % 4 AS k, DATE '1995-01-01' + CAST(c_custkey % 2000 AS INT) AS day FROM customer) SELECT c_custkey, CASE k WHEN 0 THEN 'Summer' WHEN 1 THEN CASE WHEN month(day) BETWEEN 6 AND 10 THEN 'Kharif' WHEN month(day) BETWEEN 4 AND 5 THEN 'Summer' ELSE 'Rabi' END ELSE 'Kharif' END AS season, CASE k WHEN 0 THEN 1999 WHEN 1 THEN CAST(CASE WHEN month(day) <= 3 THEN year(day) - 1 ELSE year(day) END AS INT) ELSE y END AS year FROM p, m")
def temporal_context(spark: SparkSession, d: str) -> DataFrame:
    """Season and year as given, else of the reference date, else the latest year there is."""
    k = F.col("c_custkey")
    day = F.date_add(F.lit("1995-01-01").cast("date"), (k % 2000).cast("int"))
    latest = table(spark, d, "orders").agg(F.max(seasons.season_of(F.to_date("o_orderdate"))["year"]).alias("latest"))
    asked = table(spark, d, "customer").select(k, F.when(k % 4 == 0, "Summer").alias("season"), F.when(k % 4 == 0, 1999).alias("year"), F.when(k % 4 <= 1, day).alias("day"))
    return resolve.temporal(asked.crossJoin(F.broadcast(latest)), "season", "year", "day", "latest", "Kharif", 2025).select("c_custkey", "season", "year")


CELL_SEASON = "CASE WHEN month(o_orderdate) BETWEEN 6 AND 10 THEN 'Kharif' WHEN month(o_orderdate) BETWEEN 4 AND 5 THEN 'Summer' ELSE 'Rabi' END"
CELL_YEAR = "CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) <= 3 THEN 1 ELSE 0 END AS INT)"


@query(f"""WITH o AS (SELECT o_custkey AS c_custkey, {CELL_SEASON} AS season, {CELL_YEAR} AS year, CAST(o_orderdate AS DATE) AS day, o_orderkey, o_orderkey % 2 = 0 AS ndvi, o_orderkey % 3 AS bounds FROM orders),
f AS (SELECT c_custkey, season, year, day, arg_min({{'k': o_orderkey, 'b': bounds}}, o_orderkey) FILTER (ndvi) AS n, arg_min({{'k': o_orderkey, 'b': bounds}}, o_orderkey) FILTER (NOT ndvi) AS e FROM o GROUP BY ALL),
i AS (SELECT c_custkey, season, year, count(*) AS n_dates, count(*) FILTER (n IS NOT NULL AND e IS NOT NULL) AS n_pairs, count(*) FILTER (n.b <> e.b) AS n_mismatched, min(day) AS first_day FROM f GROUP BY ALL),
y AS (SELECT DISTINCT year FROM o), s AS (SELECT DISTINCT season FROM o), lv AS MATERIALIZED ({LEVELS_SQL}), a AS ({ASKED}), cell AS MATERIALIZED (SELECT a.c_custkey, a.village, a.taluk, a.district, y.year, s.season FROM a, y, s),
t AS MATERIALIZED ({TABULAR}), l AS MATERIALIZED (SELECT c_custkey, year, season, 0 AS j, village AS name FROM cell UNION ALL SELECT c_custkey, year, season, 1, taluk FROM cell WHERE taluk <> village UNION ALL SELECT c_custkey, year, season, 2, district FROM cell),
nm AS MATERIALIZED (SELECT DISTINCT year, season, j, name FROM l), m AS (SELECT year, season, j, name, pos, CASE WHEN second THEN 1 ELSE 0 END AS i, CASE WHEN v = name THEN 1 WHEN list_contains(list_transform(string_split_regex(v, '[/|]'), lambda x: trim(x)), name) THEN 2 WHEN contains(lower(v), lower(name)) THEN 3 END AS stage FROM (SELECT nm.*, t.pos, t.second, CASE j WHEN 0 THEN t.village WHEN 1 THEN t.taluk ELSE t.district END AS v FROM nm JOIN t USING (year, season))),
pk AS MATERIALIZED (SELECT year, season, j, name, i, arg_min(pos, (stage, pos)) AS pos FROM m WHERE stage IS NOT NULL GROUP BY ALL), k AS (SELECT c_custkey, year, season, 0 AS last, i, j, pos FROM l JOIN pk USING (year, season, j, name) UNION ALL SELECT c_custkey, year, season, 1, i, -1, pos FROM cell JOIN (SELECT year, season, CASE WHEN second THEN 1 ELSE 0 END AS i, min(pos) AS pos FROM t GROUP BY ALL) USING (year, season)),
b AS MATERIALIZED (SELECT c_custkey, year, season, arg_min(j, (last, i, j, pos)) AS j, arg_min(pos, (last, i, j, pos)) AS pos FROM k GROUP BY ALL),
r AS MATERIALIZED (SELECT cell.c_custkey, cell.year, cell.season, coalesce(lv.taluk, lv.district) AS boundary, CASE j WHEN 0 THEN 'village' WHEN 1 THEN 'taluk' WHEN 2 THEN 'district' WHEN -1 THEN 'none' END AS tab_level, price, coalesce(n_dates, 0) AS n_dates, coalesce(n_pairs, 0) AS n_pairs, coalesce(n_mismatched, 0) AS n_mismatched, first_day FROM cell LEFT JOIN lv USING (c_custkey) LEFT JOIN i ON cell.c_custkey = i.c_custkey AND cell.year = i.year AND cell.season = i.season LEFT JOIN b ON cell.c_custkey = b.c_custkey AND cell.year = b.year AND cell.season = b.season LEFT JOIN t USING (pos)),
q AS (SELECT *, concat_ws(',', CASE WHEN n_dates = 0 THEN 'no_images' END, CASE WHEN n_dates > n_pairs THEN 'unpaired' END, CASE WHEN n_mismatched > 0 THEN 'mismatched' END, CASE WHEN tab_level IS NULL THEN 'no_tabular' END, CASE WHEN tab_level = 'none' THEN 'fallback' END, CASE WHEN boundary IS NULL THEN 'no_boundary' END) AS issues FROM r)
SELECT c_custkey, year, season, boundary, tab_level, price, n_dates, n_pairs, n_mismatched, first_day, issues, CAST(greatest(0, 100 - CASE WHEN n_dates = 0 THEN 25 ELSE 0 END - CASE WHEN n_dates > n_pairs THEN 10 ELSE 0 END - CASE WHEN n_mismatched > 0 THEN 10 ELSE 0 END - CASE WHEN tab_level IS NULL THEN 25 ELSE 0 END - CASE WHEN tab_level = 'none' THEN 10 ELSE 0 END - CASE WHEN boundary IS NULL THEN 2 ELSE 0 END) AS INT) AS quality, n_dates > 0 AND tab_level IS NOT NULL AS accepted FROM q""")
def full_observations(spark: SparkSession, d: str) -> DataFrame:
    """Observations of every place, year and season: boundary, staged tabular match, image pairs, issues, quality, acceptance."""
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.to_date("o_orderdate").alias("day"), "o_orderkey", (F.col("o_orderkey") % 3).alias("bounds"))
    dated = orders.withColumn("s", seasons.season_of(F.col("day"))).select("c_custkey", "s.season", "s.year", "day", "o_orderkey", "bounds")
    return resolve.observations(
        places=_asked(spark, d).drop("year", "season").join(_points(spark, d), "c_custkey"), key="c_custkey", ndvi=dated.where("o_orderkey % 2 = 0"), evi=dated.where("o_orderkey % 2 <> 0"),
        record="o_orderkey", compared=["bounds"], boxes=_boxes(spark, d), tables=_tabular(spark, d), carry=["price"],
    )
