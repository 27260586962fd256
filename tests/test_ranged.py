"""Ranges are found inside the JVM and rows of a drift are read once."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from agrarium.operators import monitor, ranks


@pytest.fixture
def narrow(monkeypatch):
    monkeypatch.setattr(ranks, "SMALL", 5)
    monkeypatch.setattr(ranks, "RANGES", 64)


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_ranges_need_no_python(spark, narrow, keys):
    rng = random.Random(5)
    own = [rng.choice((rng.gauss(0, 1), -0.0, 0.0, 1e9 + rng.random(), -1e300 * rng.random())) for _ in range(3_000)] + [float("inf"), float("-inf"), float("nan")] * 9
    rows = spark.createDataFrame([(k, v) for v in own for k in ("a", "b")] + [("c", float("nan"))] * 40 + [("a", None), ("d", 1.0)], "k string, v double")
    part = ranks.ranged(rows, keys, "v")
    assert "Python" not in part._jdf.queryExecution().executedPlan().toString()
    found = part.groupBy(*keys, "_p").agg(F.count("*").alias("n"), F.countDistinct("v").alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy(*keys, "_p").collect()
    assert sum(r.n for r in found) == rows.count() and len(found) > 30
    for a, b in zip(found, found[1:]):
        if not keys or a.k == b.k:
            # Ranges follow one another, and equal values, zeros of both signs too, share one.
            assert a.hi is None or a.hi < b.lo or np.isnan(b.lo) and not np.isnan(a.hi)
    assert max(r.m for r in found) < 300


def counted(spark, df):
    """``df`` and how many of its rows have been made so far."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def one():
        made.add(1)
        return True

    return df.where(one.asNondeterministic()()), made


def test_drift_reads_rows_once(spark, narrow):
    rng = random.Random(6)
    rows = spark.createDataFrame([("f", rng.choice(("ref", "cur")), round(rng.gauss(0, 1), 3)) for _ in range(2_000)], "feature string, side string, x double")
    sides, made = counted(spark, rows)
    assert monitor.numeric(sides).first().n_ref > 900
    assert made.value == 2_000


def test_report_takes_sections_once(spark):
    rows = spark.createDataFrame([("s", "k", "high", True, "m", 1.0)] * 10, ", ".join(f"{c} {t}" for c, t in zip(monitor.TIDY, ("string", "string", "string", "boolean", "string", "double"))))
    section, made = counted(spark, rows)
    assert monitor.monitor(section).count() == 11
    assert made.value == 10
