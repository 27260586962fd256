"""Boundaries from GeoJSON and shapefiles, as rings with their boxes: outer rings alone, or shapes with all of their parts and holes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agrarium.functions.projection import to_4326
from agrarium.sources import shapefiles

FEATURES = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"


def geojson(spark: SparkSession, path: str, level: str, name: str = "name") -> DataFrame:
    """(name, level, ring, box) for each outer ring of the polygons of a feature collection."""
    f = spark.read.schema(FEATURES).json(path, multiLine=True).select(F.explode("features").alias("f")).select("f.*")
    polygon = F.from_json("geometry.coordinates", "array<array<array<double>>>")
    many = F.from_json("geometry.coordinates", "array<array<array<array<double>>>>")
    outer = F.when(F.col("geometry.type") == "Polygon", F.array(polygon[0])).when(F.col("geometry.type") == "MultiPolygon", F.transform(many, lambda p: p[0]))
    rings = f.select(F.col("properties")[name].alias("name"), F.explode(outer).alias("points"))
    return boxed(rings.select("name", F.lit(level).alias("level"), F.transform("points", lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("ring")))


def boxed(rings: DataFrame) -> DataFrame:
    """The box of each ring beside it."""
    side = lambda f, axis: f(F.transform("ring", lambda p: p[axis]))
    return rings.withColumns({"min_lon": side(F.array_min, "x"), "min_lat": side(F.array_min, "y"), "max_lon": side(F.array_max, "x"), "max_lat": side(F.array_max, "y")})


def centroids(shapes: DataFrame) -> DataFrame:
    """(name, level, lon, lat) of the rings' area centroids."""
    edges = F.zip_with(F.slice("ring", 1, F.size("ring") - 1), F.slice("ring", 2, F.size("ring") - 1), lambda a, b: F.struct((a["x"] * b["y"] - b["x"] * a["y"]).alias("w"), (a["x"] + b["x"]).alias("x"), (a["y"] + b["y"]).alias("y")))
    total = lambda g: F.aggregate(edges, F.lit(0.0), lambda s, e: s + g(e))
    area = total(lambda e: e["w"])
    return shapes.select("name", "level", (total(lambda e: e["x"] * e["w"]) / (3 * area)).alias("lon"), (total(lambda e: e["y"] * e["w"]) / (3 * area)).alias("lat"))


def normalised(shapes: DataFrame, name: str, level: str) -> DataFrame:
    """(name, level, ring) of a source whose names are in the column ``name``."""
    return shapes.select(F.trim(F.col(name)).alias("name"), F.lit(level).alias("level"), "ring")


def union(*levels: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, levels)


def _in_degrees(read: DataFrame, epsg: int) -> DataFrame:
    """(name, level, rings, box) of (name, level, r) in a file's coordinates."""

    def degrees(ring: Column) -> Column:
        points = F.transform(ring, lambda p: to_4326(p[0], p[1], F.lit(epsg)))
        points = F.transform(points, lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))
        return F.when(points[0] == F.element_at(points, -1), points).otherwise(F.concat(points, F.slice(points, 1, 1)))

    shapes = read.withColumn("rings", F.transform(F.filter("r", lambda r: F.size(r) >= 4), degrees)).drop("r").where(F.size("rings") > 0)
    side = lambda f, axis: f(F.transform(F.flatten("rings"), lambda p: p[axis]))
    return shapes.withColumns({"min_lon": side(F.array_min, "x"), "min_lat": side(F.array_min, "y"), "max_lon": side(F.array_max, "x"), "max_lat": side(F.array_max, "y")})


def features(spark: SparkSession, path: str, level: str, name: str = "name", epsg: int = 4326, lines: bool = False) -> DataFrame:
    """(name, level, rings, box) for each feature: all rings of its polygons, holes too, in degrees.

    ``epsg`` is the code of the file's coordinates (4326, 3857, 326xx, 327xx).
    With ``lines`` a file has a feature on each line, so that large ones are
    read in parts; else it is one collection. Features without polygons, and
    rings of fewer than four points, are left out; a ring that isn't closed is.
    """
    if lines:
        one = "properties map<string,string>, geometry struct<type:string,coordinates:string>"
        f = spark.read.schema(one).json(path)
    else:
        f = spark.read.schema(FEATURES).json(path, multiLine=True).select(F.explode("features").alias("f")).select("f.*")
    polygon = F.from_json("geometry.coordinates", "array<array<array<double>>>")
    many = F.from_json("geometry.coordinates", "array<array<array<array<double>>>>")
    rings = F.when(F.col("geometry.type") == "Polygon", polygon).when(F.col("geometry.type") == "MultiPolygon", F.flatten(many))
    read = f.select(F.col("properties")[name].alias("name"), F.lit(level).alias("level"), rings.alias("r")).where("r IS NOT NULL")
    return _in_degrees(read, epsg)


def shapefile(spark: SparkSession, path: str, level: str, name: str = "name", epsg: int = 4326) -> DataFrame:
    """As ``features``, of a shapefile or a folder of such, read in parts by record offsets; ``epsg`` is the code of its coordinates."""
    shapefiles.register(spark)
    f = spark.read.format("shapefile").load(path).where("rings IS NOT NULL")
    return _in_degrees(f.select(F.element_at("properties", name).alias("name"), F.lit(level).alias("level"), F.col("rings").alias("r")), epsg)
