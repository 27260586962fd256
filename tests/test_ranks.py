"""Exact quantiles and ranks in ranges, whatever the values' distribution; tables saved in the shared folder."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from agrarium.operators import lineage, monitor, ranks, spatial


def values(seed=1, n=4000):
    rng = random.Random(seed)
    return [rng.choice((rng.random(), 1e12 * rng.random() ** 9, round(rng.random(), 1), 7.0, None)) for _ in range(n)]


@pytest.mark.parametrize("key", ["a", "b", "c"])
def test_quantiles(spark, key):
    rows = [("a", v) for v in values()] + [("b", v) for v in values(2, 50)] + [("c", 3.0)] + [("d", None)]
    shares = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    found = {r.k: (r.n, r.q) for r in ranks.quantiles_by(spark.createDataFrame(rows, "k string, v double"), ["k"], F.col("v"), shares).collect()}
    own = [v for k, v in rows if k == key and v is not None]
    assert found[key][0] == len(own) and np.allclose(found[key][1], np.quantile(own, shares), rtol=1e-12)
    assert "d" not in found


def test_whole_column_and_empty(spark):
    df = spark.createDataFrame([(v,) for v in values()], "v double")
    own = [v for v in values() if v is not None]
    got = ranks.quantiles(df, {"v": F.col("v"), "w": F.lit(None).cast("double")}, [0.3, 0.5])
    assert set(got) == {"v"} and np.allclose(got["v"], np.quantile(own, [0.3, 0.5]))
    assert ranks.quantiles(df.limit(0), {"v": F.col("v")}, [0.5]) == {}
    at = ranks.values_at(df, [], F.col("v"), {"m": F.floor((F.col("n") - 1) / 2)}).first()
    assert at.m == sorted(own)[(len(own) - 1) // 2]


def test_running(spark):
    rows = [("x", i % 3000, i % 5) for i in range(9000)]
    counts = spark.createDataFrame(rows, "k string, v int, n int").groupBy("k", "v").agg(F.sum("n").alias("n"))
    got = {r.v: r._before_n for r in ranks.running(counts, ["k"], "v", ["n"]).collect()}
    total, want = 0, {}
    sums = {}
    for _, v, n in rows:
        sums[v] = sums.get(v, 0) + n
    for v in sorted(sums):
        want[v] = total
        total += sums[v]
    assert got == want


def test_nearest_degrees(spark):
    rng = np.random.default_rng(3)
    a, b = rng.uniform(-170, 170, (40, 2)), rng.uniform(-80, 80, (9, 2))
    points = spark.createDataFrame([(i, float(x), float(y) / 3) for i, (x, y) in enumerate(a)], "p long, lon double, lat double")
    places = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(b)], "q long, place_lon double, place_lat double")
    got = {}
    for r in spatial.nearest_degrees(points, places, "p", "q", 3).collect():
        got.setdefault(r.p, []).append((r["rank"], r.q))
    for i, (x, y) in enumerate(a):
        d = np.hypot(b[:, 0] - x, b[:, 1] - y / 3)
        assert [q for _, q in sorted(got[i])] == np.argsort(d)[:3].tolist()


def test_few_rows_have_no_drift(spark):
    df = spark.createDataFrame([(float(i),) for i in range(20)], "x double")
    row = monitor.numeric(monitor.sides_of(df, df.select((F.col("x") + 100).alias("x")), ["x"])).first()
    assert row.severity is None and row.drifted is False and row.psi > 1
    same = spark.createDataFrame([(float(i % 50),) for i in range(500)], "x double")
    row = monitor.numeric(monitor.sides_of(same, same, ["x"])).first()
    assert abs(row.psi) < 1e-9 and row.ks == 0 and row.p == 1.0 and row.severity == "low" and not row.drifted


def test_saved_tables(spark):
    assert lineage.shared_folder(spark) == (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir())
    kept = lineage.saved(spark.range(5).toDF("x"))
    assert kept.count() == 5 and kept.inputFiles()[0].startswith("file:")
    path = kept.inputFiles()[0]

    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"getCheckpointDir": staticmethod(lambda: None), "master": "spark://host:7077"})

    with pytest.raises(ValueError):
        lineage.shared_folder(Cluster)
    before = list(lineage._written)
    lineage._written[:] = [p for p in before if p in path]
    assert lineage.clear_saved(spark) == 1
    lineage._written[:] = [p for p in before if p not in path]
