"""Keyed stores: untouched buckets keep their files, versions roll back, writers conflict, and what is no longer named goes."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from agrarium.operators.store import Conflict, KeyedStore

SCHEMA = "k long, x string, n int"


@pytest.fixture
def store(spark, tmp_path):
    rows = spark.range(200).selectExpr("id k", "concat('a', id) x", "cast(1 as int) n")
    store = KeyedStore.create(spark, str(tmp_path / "s"), spark.createDataFrame([], SCHEMA).schema, ["k"], buckets=16)
    store.upsert(rows)
    return store


def state(store, version=None):
    return {r.k: (r.x, r.n) for r in store.read(version).collect()}


def files(store):
    return {p: p.stat().st_mtime_ns for p in Path(store.root).glob("data/*/*/part-*")}


def test_a_batch_rewrites_its_buckets_only(spark, store):
    before, m = files(store), store.manifest()
    store.upsert(spark.createDataFrame([(3, "new", 2), (5, "new", 2), (777, "new", 2)], SCHEMA))
    after = store.manifest()
    touched = {b for b in after["folders"] if after["folders"][b] != m["folders"].get(b)}
    assert 1 <= len(touched) <= 3
    assert {b: f for b, f in after["folders"].items() if b not in touched} == {b: f for b, f in m["folders"].items() if b not in touched}
    assert all(files(store)[p] == t for p, t in before.items())
    want = {k: (f"a{k}", 1) for k in range(200)} | {k: ("new", 2) for k in (3, 5, 777)}
    assert state(store) == want and store.count() == 201 and state(store, 1) == {k: (f"a{k}", 1) for k in range(200)}


def test_rollback_and_versions(spark, store):
    store.upsert(spark.createDataFrame([(3, "b", 2)], SCHEMA))
    store.upsert(spark.createDataFrame([(3, "c", 3), (900, "c", 3)], SCHEMA))
    written = files(store)
    assert store.rollback(2) == 4 and state(store)[3] == ("b", 2) and 900 not in state(store)
    assert files(store) == written
    assert state(store, 3)[3] == ("c", 3)
    assert [(r.version, r.action, r.rows) for r in store.versions().collect()] == [(0, "create", 0), (1, "upsert", 200), (2, "upsert", 200), (3, "upsert", 201), (4, "rollback 2", 200)]
    store.upsert(spark.createDataFrame([(3, "d", 4)], SCHEMA))
    assert state(store)[3] == ("d", 4)
    with pytest.raises(ValueError):
        store.read(99)


def test_a_version_is_taken_once(spark, store):
    m = store.manifest()
    store.upsert(spark.createDataFrame([(1, "first", 2)], SCHEMA))
    with pytest.raises(Conflict):
        store._rewrite(m, "upsert", spark.createDataFrame([(1, "second", 2)], SCHEMA), F.lit(True))
    assert state(store)[1] == ("first", 2)
    assert not list(Path(store.root).glob("manifests/*.tmp"))


def test_deletes_and_single_keys(spark, store):
    store.delete(spark.createDataFrame([(1,), (2,), (5_000,)], "k long"))
    store.delete_where("k >= 150")
    assert set(state(store)) == {0, *range(3, 150)} and store.count() == 148
    assert [tuple(r) for r in store.get(k=7).collect()] == [(7, "a7", 1)] and store.get(k=1).count() == 0
    assert store.query(x="a9", n=None).count() == 1
    for wrong in ({"y": 1},):
        with pytest.raises(ValueError):
            store.query(**wrong)
    store.delete_where("true")
    assert store.count() == 0 and store.read().count() == 0 and store.manifest()["folders"] == {}


def test_hot_and_null_keys_and_missing_columns(spark, tmp_path):
    store = KeyedStore.create(spark, str(tmp_path / "s"), spark.createDataFrame([], SCHEMA).schema, ["k", "x"], buckets=4)
    batch = spark.range(5_000).selectExpr("if(id % 3 = 0, null, 7) k", "'hot' x", "cast(id as int) n", "id at")
    store.upsert(batch, ingested="at")
    assert sorted(map(tuple, store.read().collect()), key=str) == sorted([(7, "hot", 4999), (None, "hot", 4998)], key=str)
    store.upsert(spark.createDataFrame([(None, "hot"), (8, "hot")], "k int, x string"))
    assert sorted(map(tuple, store.read().collect()), key=str) == sorted([(7, "hot", 4999), (None, "hot", None), (8, "hot", None)], key=str)
    assert store.get(k=None, x="hot").count() == 1
    store.upsert(store.read().limit(0))
    assert store.count() == 3
    for bad in (spark.createDataFrame([(1, "a", 2.0)], "k long, x string, z double"), spark.createDataFrame([(1,)], "k long")):
        with pytest.raises(ValueError):
            store.upsert(bad)
    with pytest.raises(ValueError):
        KeyedStore.create(spark, str(tmp_path / "t"), spark.createDataFrame([], SCHEMA).schema, ["nothing"])
    with pytest.raises(ValueError):
        KeyedStore(spark, str(tmp_path / "none")).read()


def test_vacuum_and_export(spark, store, tmp_path):
    for n in range(2, 5):
        store.upsert(spark.createDataFrame([(3, "b", n)], SCHEMA))
    held = len(files(store))
    assert store.vacuum(keep=2) == 2 and len(files(store)) < held
    assert state(store)[3] == ("b", 4) and state(store, 3)[3] == ("b", 3)
    with pytest.raises(ValueError):
        store.read(1)
    store.export(str(tmp_path / "csv"), "csv")
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).count() == 200
