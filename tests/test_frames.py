"""Frames by their names, reports as HTML, schemas of two versions."""

from pyspark.sql import functions as F

from agrarium.operators import profile
from agrarium.sources import sinks
from agrarium.sources.tables import frame


def test_frames_by_name(spark, tmp_path):
    df = spark.range(20).select("id", (F.col("id") / 4).alias("x"), F.concat(F.lit("a,"), F.col("id")).alias("t"))
    for kind in ("parquet", "orc", "json", "jsonl", "csv"):
        sinks.write(df, f"{tmp_path}/f.{kind}", kind)
        back = frame(spark, f"{tmp_path}/f.{kind}").select("id", "x", "t")
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert frame(spark, f"{tmp_path}/f.csv", "id string, x string, t string").dtypes == [("id", "string"), ("x", "string"), ("t", "string")]


def test_html(spark, tmp_path):
    df = spark.createDataFrame([("b", "1 < 2 & 3", None), ("a", None, [1.5])], "k string, t string, v array<double>")
    sinks.html(df, str(tmp_path / "r.html"))
    (part,) = (tmp_path / "r.html").glob("part-*")
    assert part.read_text().splitlines() == [
        "<!DOCTYPE html><table><tr><th>k</th><th>t</th><th>v</th></tr>",
        "<tr><td>a</td><td></td><td>[1.5]</td></tr>",
        "<tr><td>b</td><td>1 &lt; 2 &amp; 3</td><td></td></tr>",
        "</table>",
    ]


def test_schema_report(spark):
    old = spark.createDataFrame([(1, "a", None), (2, None, None)], "`a.b` int, t string, gone double")
    new = old.select(F.col("`a.b`").cast("long").alias("a.b"), "t", F.lit(1).alias("more"))
    found = {r["column"]: tuple(r)[1:] for r in profile.schema_report(old, new).collect()}
    assert found == {"a.b": ("retyped", "int", "bigint", 2, 2), "t": ("same", "string", "string", 1, 1), "gone": ("removed", "double", None, 0, None), "more": ("added", None, "int", None, 2)}
