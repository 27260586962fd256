"""Projections, boundaries with holes, resized patches and season calendars from files."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agrarium.functions import arrays, projection, seasons
from agrarium.operators import spatial
from agrarium.operators.lineage import saved, scratch
from agrarium.operators.store import _Files
from agrarium.plans.alignment import place, place_sql
from agrarium.plans.registry import query
from agrarium.sources import boundaries, shapefiles
from agrarium.sources.tables import table

_E, _K = projection.ECCENTRICITY, projection.SCALE * projection.RADIUS


def _series(coefficients: tuple[float, ...], first: str, second: str, x: str, y: str) -> str:
    return " + ".join(f"{c!r} * {first}({2 * j} * {x}) * {second}({2 * j} * {y})" for j, c in enumerate(coefficients, 1))


UTM_SQL = f"""WITH c AS (SELECT c_custkey, {place_sql('c_custkey')} FROM customer), z AS (SELECT *, CAST(least(greatest(floor((lon + 180) / 6) + 1, 1), 60) + CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END AS INT) AS epsg FROM c),
a AS (SELECT *, sinh(atanh(sin(radians(lat))) - {_E!r} * atanh({_E!r} * sin(radians(lat)))) AS t, radians(lon) - radians((epsg % 100) * 6 - 183) AS l FROM z), b AS (SELECT *, atan2(t, cos(l)) AS xi, atanh(sin(l) / sqrt(1 + t * t)) AS eta FROM a)
SELECT c_custkey, epsg, round(500000 + {_K!r} * (eta + {_series(projection.FORWARD, 'cos', 'sinh', 'xi', 'eta')}), 3) AS x, round(CASE WHEN lat < 0 THEN 10000000 ELSE 0 END + {_K!r} * (xi + {_series(projection.FORWARD, 'sin', 'cosh', 'xi', 'eta')}), 3) AS y, round(lon, 7) AS lon, round(lat, 7) AS lat FROM b"""


@query(UTM_SQL)
def reprojected_places(spark: SparkSession, d: str) -> DataFrame:
    """Places in metres of their zone, and what these are in degrees again."""
    rows = table(spark, d, "customer").select("c_custkey", *(v.alias(k) for k, v in place("c_custkey").items()))
    rows = rows.withColumn("epsg", projection.utm_epsg(F.col("lon"), F.col("lat")))
    rows = rows.withColumn("m", projection.to_utm(F.col("lon"), F.col("lat"), F.col("epsg")))
    back = projection.to_4326(F.col("m.x"), F.col("m.y"), F.col("epsg"))
    return rows.withColumn("g", back).select("c_custkey", "epsg", F.round("m.x", 3).alias("x"), F.round("m.y", 3).alias("y"), F.round("g.lon", 7).alias("lon"), F.round("g.lat", 7).alias("lat"))


def _box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A closed ring in web Mercator as GeoJSON has it."""
    corner = lambda x, y: (lambda p: F.array(p["x"], p["y"]))(projection.to_web(x, y))
    return F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1), corner(x0, y0))


@query(f"""WITH c AS (SELECT c_custkey, {place_sql('c_custkey')} FROM customer), n AS (SELECT n_name AS name, n_nationkey % 2 = 0 AS one, n_nationkey * 13.0 - 179.995 AS x, n_nationkey * 4.0 - 79.995 AS y FROM nation)
SELECT c_custkey, name FROM c, n WHERE lon BETWEEN x AND x + 40 AND lat BETWEEN y AND y + 40 AND NOT (lon BETWEEN x + 10 AND x + 30 AND lat BETWEEN y + 10 AND y + 30)
UNION ALL SELECT c_custkey, name FROM c, n WHERE NOT one AND lon BETWEEN x + 15 AND x + 25 AND lat BETWEEN y + 15 AND y + 25""")
def holed_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """Places in boundaries with a hole, half of which have an island in it, read from a file in web Mercator with a feature on each line."""
    root = scratch(spark, f"boundaries-{uuid.uuid4().hex}")
    k = F.col("n_nationkey")
    x, y = k * 13.0 - 179.995, k * 4.0 - 79.995
    outer, hole, island = (_box(x + a, y + a, x + b, y + b) for a, b in ((0, 40), (10, 30), (15, 25)))
    shape = lambda kind, rings: F.to_json(F.struct(F.lit("Feature").alias("type"), F.create_map(F.lit("name"), F.col("n_name")).alias("properties"), F.struct(F.lit(kind).alias("type"), rings.alias("coordinates")).alias("geometry")))
    lines = F.when(k % 2 == 0, shape("Polygon", F.array(outer, hole))).otherwise(shape("MultiPolygon", F.array(F.array(outer, hole), F.array(island))))
    table(spark, d, "nation").select(lines.alias("value")).write.text(root)
    shapes = boundaries.features(spark, root, "nation", epsg=3857, lines=True)
    points = table(spark, d, "customer").select("c_custkey", *(v.alias(n) for n, v in place("c_custkey").items()))
    return spatial.containing(points, shapes, rings="rings", size=10.0).select("c_custkey", "name")


@query(f"""WITH c AS (SELECT c_custkey, {place_sql('c_custkey')} FROM customer), s AS (SELECT s_suppkey, trim(s_name) AS name, (s_suppkey * 37 % 320) - 159.995 AS x, (s_suppkey * 23 % 140) - 79.995 AS y FROM supplier)
SELECT c_custkey, name FROM c, s WHERE lon BETWEEN x AND x + 8 AND lat BETWEEN y AND y + 8 AND NOT (lon BETWEEN x + 2 AND x + 4 AND lat BETWEEN y + 2 AND y + 4)""")
def shapefile_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """Places in boundaries with a hole for each supplier, written as shapefiles in web Mercator by the tasks and read in parts."""
    root = scratch(spark, f"shapefiles-{uuid.uuid4().hex}")
    shapefiles.register(spark)
    k = F.col("s_suppkey")
    x, y = k * 37 % 320 - 159.995, k * 23 % 140 - 79.995
    rings = F.array(_box(x, y, x + 8, y + 8), _box(x + 2, y + 2, x + 4, y + 4))
    table(spark, d, "supplier").select(rings.alias("rings"), F.create_map(F.lit("name"), F.trim("s_name")).alias("properties")).repartition(16).write.format("shapefile").mode("append").save(root)
    shapes = saved(boundaries.shapefile(spark, root, "supplier", epsg=3857))
    points = table(spark, d, "customer").select("c_custkey", *(v.alias(n) for n, v in place("c_custkey").items()))
    return spatial.containing(points, shapes, rings="rings", size=10.0).select("c_custkey", "name")


@query(f"""WITH c AS (SELECT c_custkey, {place_sql('c_custkey')} FROM customer), s AS (SELECT s_suppkey, lon AS x, lat AS y FROM (SELECT s_suppkey, {place_sql('s_suppkey')} FROM supplier)), p AS (SELECT c_custkey, s_suppkey, abs(lon - x) + abs(lat - y) AS m FROM c, s)
SELECT c_custkey, s_suppkey, round(m, 6) AS manhattan FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY m, s_suppkey) AS r FROM p) WHERE r = 1""")
def nearest_centres(spark: SparkSession, d: str) -> DataFrame:
    """The raster whose centre is nearest to each place by the sum of both differences."""
    points = table(spark, d, "customer").select("c_custkey", *(v.alias(n) for n, v in place("c_custkey").items()))
    centres = table(spark, d, "supplier").select("s_suppkey", *(v.alias(f"place_{n}") for n, v in place("s_suppkey").items()))
    return spatial.nearest_manhattan(points, centres, "c_custkey", "s_suppkey", 1).select("c_custkey", "s_suppkey", F.round("manhattan", 6).alias("manhattan"))


def _weights_sql(n: int, m: int) -> str:
    rows = []
    for i in range(m):
        at = min(max((i + 0.5) * n / m - 0.5, 0.0), n - 1.0)
        rows.append(f"({i}, {int(at)}, {min(int(at) + 1, n - 1)}, {at - int(at)!r})")
    return ", ".join(rows)


@query(f"""WITH r(i, lo, hi, f) AS (VALUES {_weights_sql(8, 12)}), c(i, lo, hi, f) AS (VALUES {_weights_sql(8, 5)}), v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE len(embedding) = 64),
p AS (SELECT vec_id, r.i * 5 + c.i AS i, (v[r.lo * 8 + c.lo + 1] * (1 - c.f) + v[r.lo * 8 + c.hi + 1] * c.f) * (1 - r.f) + (v[r.hi * 8 + c.lo + 1] * (1 - c.f) + v[r.hi * 8 + c.hi + 1] * c.f) * r.f AS x FROM v, r, c)
SELECT vec_id, count(*) AS cells, round(sum(x), 6) AS total, round(sum(x * i), 5) AS weighted, round(max(x), 6) AS most FROM p GROUP BY 1""")
def resized_patches(spark: SparkSession, d: str) -> DataFrame:
    """Patches of 8 by 8 made 12 by 5."""
    rows = table(spark, d, "embeddings").where(F.size("embedding") == 64).select("vec_id", arrays.resized(F.col("embedding"), (8, 8), (12, 5)).alias("v"))
    weighted = F.aggregate(F.transform("v", lambda x, i: x * i), F.lit(0.0), lambda s, x: s + x)
    return rows.select("vec_id", F.size("v").cast("long").alias("cells"), F.round(arrays.array_sum(F.col("v")), 6).alias("total"), F.round(weighted, 5).alias("weighted"), F.round(F.array_max("v"), 6).alias("most"))


#: A calendar of four seasons, one of them over the year's end, with a gap of five days.
FOUR = [("Wet", 6, 16, 9, 15), ("Autumn", 9, 16, 11, 30), ("Cold", 12, 1, 2, 29), ("Dry", 3, 6, 6, 15)]


@query("""WITH o AS (SELECT CAST(o_orderdate AS DATE) AS d, month(o_orderdate) * 100 + day(o_orderdate) AS k, year(o_orderdate) AS y, o_totalprice FROM orders),
s AS (SELECT *, CASE WHEN k BETWEEN 616 AND 915 THEN 'Wet' WHEN k BETWEEN 916 AND 1130 THEN 'Autumn' WHEN k >= 1201 OR k <= 229 THEN 'Cold' WHEN k BETWEEN 306 AND 615 THEN 'Dry' END AS season FROM o)
SELECT season, CAST(CASE WHEN season = 'Cold' AND k <= 229 THEN y - 1 WHEN season IS NOT NULL THEN y END AS INT) AS season_year, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM s GROUP BY ALL""")
def seasons_from_a_file(spark: SparkSession, d: str) -> DataFrame:
    """Orders by the seasons of a calendar of four that is read from a file; those of the gap have none."""
    path = scratch(spark, f"calendar-{uuid.uuid4().hex}.json")
    _Files(spark, path).put(path, json.dumps({"version": "1", "seasons": [dict(zip(("name", "start_month", "start_day", "end_month", "end_day"), s, strict=True)) for s in FOUR]}))
    rows = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"), "o_totalprice")
    found = seasons.with_season(rows, "day", seasons.load(spark, path))
    return found.groupBy("season", F.col("season_year").cast("int").alias("season_year")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
