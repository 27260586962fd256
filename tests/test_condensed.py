"""Ranks, bins and distances where only the ranges that matter are counted value by value."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from agrarium.operators import drift, monitor, ranks


@pytest.fixture
def narrow(monkeypatch):
    monkeypatch.setattr(ranks, "SMALL", 5)
    monkeypatch.setattr(ranks, "RANGES", 64)


def drawn(seed, n, shift=0.0):
    rng = random.Random(seed)
    return [rng.choice((rng.gauss(shift, 1), round(rng.random(), 1), 1e9 * rng.random() ** 5, 7.0, -0.0)) for _ in range(n)]


def sides(spark, ref, cur, feature="f"):
    return spark.createDataFrame([(feature, "ref", x) for x in ref] + [(feature, "cur", x) for x in cur], "feature string, side string, x double")


def test_few_values_are_counted(spark, narrow):
    own = drawn(1, 6_000)
    rows = spark.createDataFrame([("a", v, 1) for v in own] + [("b", 2.0, 1)] * 50 + [("c", v, 1) for v in own[:4]], "k string, v double, n int")
    runs = ranks.condensed(rows, ["k"], "v", ["n"], ranks.holds_quantiles([0.25, 0.75]))
    found = {r.k: r.q for r in ranks.quantiles_of(runs, ["k"], "v", [0.25, 0.75]).collect()}
    for k, v in (("a", own), ("b", [2.0] * 50), ("c", own[:4])):
        assert np.allclose(found[k], np.quantile(v, [0.25, 0.75]), rtol=1e-12)
    assert runs.count() < len(set(own)) / 4
    at = sorted(own)
    for r in runs.where("k = 'a'").collect():
        assert r._before_n == np.searchsorted(at, r.v) and r.n >= 1


def test_many_keys(spark, narrow):
    rng = random.Random(2)
    rows = [(rng.randrange(300), rng.random()) for _ in range(9_000)]
    got = {r.k: r.q[0] for r in ranks.quantiles_by(spark.createDataFrame(rows, "k int, v double"), ["k"], F.col("v"), [0.4]).collect()}
    assert set(got) == {k for k, _ in rows}
    assert all(got[k] == pytest.approx(np.quantile([v for j, v in rows if j == k], 0.4), rel=1e-12) for k in got)


@pytest.mark.parametrize("shift", [0.0, 0.3, 5.0])
def test_distance_and_bins(spark, narrow, shift):
    ref, cur = drawn(3, 3_000), drawn(4, 2_000, shift)
    row = monitor.numeric(sides(spark, ref, cur)).first()
    every = np.unique(ref + cur)
    upto = lambda v: np.searchsorted(np.sort(v), every, side="right") / len(v)
    assert row.ks == pytest.approx(np.abs(upto(ref) - upto(cur)).max(), abs=1e-12) and (row.n_ref, row.n_cur) == (3_000, 2_000)
    e = np.unique(np.quantile(ref + cur, [i / 10 for i in range(11)]))
    share = lambda v: np.maximum(np.bincount(np.clip(np.searchsorted(e, v, side="right"), 1, len(e) - 1), minlength=len(e))[1:] / len(v), drift.FLOOR)
    r, c = share(ref), share(cur)
    assert row.psi == pytest.approx(((c - r) * np.log(c / r)).sum(), abs=1e-9)
    bins = sorted(drift.binned_shares(sides(spark, ref, cur).select("x", "side")).collect())
    assert np.allclose([b.ref for b in bins], r) and np.allclose([b.cur for b in bins], c)


def test_values_of_nulls_and_nan(spark, narrow):
    rows = spark.createDataFrame([(float(i % 40),) for i in range(400)] + [(None,), (float("nan"),)], "v double")
    at = ranks.values_at(rows, [], F.col("v"), {"last": F.col("n") - 1, "first": F.lit(0), "middle": F.floor(F.col("n") / 2)}).first()
    assert np.isnan(at["last"]) and at["first"] == 0.0 and at["middle"] == 20.0
