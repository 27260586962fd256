"""Parts that no query needs: widest tables, tensors, boundaries, previews and streams of rows."""

from pyspark.sql import functions as F

from agrarium.sources import boundaries, csvs, sinks


def test_widest(spark):
    one, two = spark.range(1).toDF("a"), spark.range(1).select(F.lit(1).alias("a"), F.lit(2).alias("b"))
    assert csvs.widest({"x": one, "y": two, "z": two}) == "y"


def test_tensor_columns(spark):
    df = spark.createDataFrame([(1, 2.5, True, "t"), (None, float("nan"), None, "u")], "a int, b double, c boolean, d string")
    rows = [r.features for r in sinks.tensor_columns(df, ["a", "b", "c"]).collect()]
    assert rows[0] == [1.0, 2.5, 1.0] and rows[1][0] == 0.0 and rows[1][2] == 0.0


def test_boundary_union(spark):
    ring = "array(named_struct('x', 0D, 'y', 0D), named_struct('x', 2D, 'y', 0D), named_struct('x', 2D, 'y', 2D), named_struct('x', 0D, 'y', 0D))"
    a = spark.sql(f"SELECT 'A' AS district, {ring} AS ring")
    b = spark.sql(f"SELECT 'B' AS name, {ring} AS ring")
    found = boundaries.union(boundaries.normalised(a, "district", "district"), boundaries.normalised(b, "name", "taluk"))
    assert sorted((r.name, r.level) for r in found.select("name", "level").collect()) == [("A", "district"), ("B", "taluk")]


def test_previews_and_streams(spark):
    df = spark.range(20).repartition(3).toDF("x")
    assert len(csvs.preview(df, 4)) == 4 and sorted(r.x for r in csvs.stream(df)) == list(range(20))
