"""Drift states that add up, and keyed state that ends."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from agrarium.operators import drift, sketches
from agrarium.streaming import keyed
from agrarium.streaming.monitoring import BatchMonitor


def numbers(spark, seed, n, shift=0.0):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, float(x), None if i % 10 == 0 else math.nan if i % 10 == 1 else float(i % 7)) for i, x in enumerate(rng.normal(shift, 1, n))], "id long, x double, y double")


@pytest.fixture(scope="module")
def reference(spark):
    return sketches.Reference(numbers(spark, 1, 4_000), ["x", "y"], F.col("id"), k=400)


def test_report_agrees_with_the_exact_one(spark, reference):
    before, now = numbers(spark, 1, 4_000), numbers(spark, 2, 3_000, 0.4)
    got = {r.feature: r for r in reference.report(reference.state(now)).collect()}
    exact = drift.ks_and_wasserstein(drift.both(before, now, "x")).first()
    assert abs(got["x"].ks - exact.ks) <= got["x"].ks_error < 0.08
    assert (got["x"].n, got["x"].nulls, got["y"].n, got["y"].nulls) == (3_000, 0, 2_400, 600)
    x, y = (np.array([r.x for r in df.collect()]) for df in (before, now))
    e = reference.edges["x"][1:-1]
    share = lambda v: np.maximum(np.bincount(np.searchsorted(e, v, side="right"), minlength=10) / len(v), drift.FLOOR)
    psi = ((share(y) - share(x)) * np.log(share(y) / share(x))).sum()
    assert got["x"].psi == pytest.approx(psi) and got["x"].psi_low < psi < got["x"].psi_high and got["x"].severity == "moderate"
    assert got["y"].severity == "low" and got["y"].ks <= got["y"].ks_error


def test_bounds_cover_and_weights_are_poisson(spark, reference):
    w = spark.range(20_000).select(F.array(*sketches.weights(F.col("id"), 6)).alias("w")).select(F.explode("w").alias("w"))
    r = w.agg(F.avg("w").alias("m"), F.var_pop("w").alias("v"), F.avg((F.col("w") == 0).cast("int")).alias("z")).first()
    assert r.m == pytest.approx(1, abs=0.02) and r.v == pytest.approx(1, abs=0.03) and r.z == pytest.approx(math.exp(-1), abs=0.01)


def test_batches_add_up_and_may_run_again(spark, reference, tmp_path):
    now = numbers(spark, 3, 2_000)
    monitor = BatchMonitor(reference, str(tmp_path / "m"))
    assert monitor.report(now).count() == 0
    for n in range(4):
        monitor(now.where(F.col("id") % 4 == n), n)
    monitor(now.where("id % 4 = 3"), 3)
    monitor(now.limit(0), 4)
    want = {r.feature: r for r in reference.report(reference.state(now)).collect()}
    for r in monitor.report(now).collect():
        assert (r.n, r.nulls) == (want[r.feature].n, want[r.feature].nulls) and r.batch == 4
        assert (r.psi, r.psi_low, r.psi_high) == pytest.approx((want[r.feature].psi, want[r.feature].psi_low, want[r.feature].psi_high))
    assert monitor.report(now, 0).where("feature = 'x'").first().n == 500


def test_empty_and_constant_references(spark):
    now = numbers(spark, 4, 50)
    empty = sketches.Reference(now.limit(0), ["x"], F.col("id"))
    assert [(r.feature, r.n, r.psi, r.ks, r.severity) for r in empty.report(empty.state(now)).collect()] == [("x", 50, None, None, None)]
    flat = sketches.Reference(now.withColumn("x", F.lit(1.0)), ["x"], F.col("id"))
    (r,) = flat.report(flat.state(now)).collect()
    assert r.psi is None and 0 < r.ks <= 1


T0 = 1_700_000_000


def streamed(spark, tmp_path, steps, schema, build):
    """Rows of each step, given to a stream that is started anew for each."""
    out = []
    with keyed.rocksdb(spark):
        for i, rows in enumerate(steps):
            spark.createDataFrame(rows, schema).withColumn("at", F.timestamp_seconds("s")).write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema(f"{schema}, at timestamp").parquet(f"{tmp_path}/in")
            build(stream).writeStream.option("checkpointLocation", f"{tmp_path}/state").format("parquet").option("path", f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination()
            out.append(i)
    return spark.read.parquet(f"{tmp_path}/out").collect()


def test_sliding_window_over_restarts(spark, tmp_path):
    at = lambda *s: [("a", i, float(T0 + t)) for i, t in s]
    steps = [at((0, 0), (1, 4), (2, 5)) + [("b", 9, float(T0))], at((3, 11), (4, 12), (5, 14.5)), at((6, 5_000), (7, 5_001), (8, 5_002))]
    got = {(r.k, r.id): r.allowed for r in streamed(spark, tmp_path, steps, "k string, id long, s double", lambda s: keyed.limited(s, "k", "at", "id", 2, 10.0, late="0 seconds"))}
    assert got == {("a", 0): True, ("a", 1): True, ("a", 2): False, ("a", 3): True, ("a", 4): False, ("a", 5): True, ("a", 6): True, ("a", 7): True, ("a", 8): False, ("b", 9): True}


def test_cache_sets_expires_prunes_and_deletes(spark, tmp_path):
    row = lambda i, t, op, key, value=None, ttl=None: ("n", i, float(T0 + t), op, key, value, ttl)
    steps = [
        [row(0, 0, "set", "u:1", "one", 10.0), row(1, 1, "set", "u:2", "two"), row(2, 2, "set", "v:1", "three", 0.0), row(3, 5, "get", "u:1"), row(4, 10, "get", "u:1"), row(5, 10.5, "get", "u:1")],
        [row(6, 20, "set", "u:1", "again", 5.0), row(7, 21, "get", "u:1"), row(8, 22, "prefix", "u:"), row(9, 23, "get", "u:1"), row(10, 23, "get", "u:2"), row(11, 24, "get", "v:1")],
        [row(12, 9_000, "delete", "v:1"), row(13, 9_001, "get", "v:1"), row(14, 9_002, "delete", "never"), row(15, 9_003, "get", "u:2")],
    ]
    got = {r.id: r.value for r in streamed(spark, tmp_path, steps, "space string, id long, s double, op string, key string, value string, ttl double", lambda s: keyed.cached(s.drop("s"), "space", late="0 seconds"))}
    assert got == {3: "one", 4: "one", 5: None, 7: "again", 9: None, 10: None, 11: "three", 13: None, 15: None}
