"""Operator 11: the descent by hand, movement, slots, and odd tables."""

import math
import struct
import zlib
from collections import Counter

import pytest
import xxhash

from agrarium.llm import op11_sharding as op
from agrarium.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, shard string, bucket_ int, number_ int"


def by_hand(key, tree):
    def draw(path, w):
        h = xxhash.xxh64(path.encode(), seed=42).intdigest()
        h = xxhash.xxh64(struct.pack("<q", key), seed=h).intdigest() if key is not None else h
        return -math.log(((h >> 11) + 0.5) * 2.0**-53) / w

    def best(children):
        return min((draw(p, w), i) for i, (p, w) in enumerate(children) if w > 0)[1] if sum(w > 0 for _, w in children) > 1 else next(i for i, (_, w) in enumerate(children) if w > 0)

    region = list(tree)[best([(r, sum(sum(k.values()) for k in f.values())) for r, f in tree.items()])]
    rack = list(tree[region])[best([(f"{region}/{k}", sum(f.values())) for k, f in tree[region].items()])]
    shards = list(tree[region][rack].items())
    return shards[best([(f"{region}/{rack}/{s}", w) for s, w in shards])][0]


def test_query_against_hand(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    found = QUERIES["op11_sharding"](spark, sf).collect()
    tree = op.even_tree(16)
    assert len(found) == len(want)
    for r in found:
        text = (want[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(text) + 1, zlib.crc32(text), "key")
        assert r.shard == by_hand(r.doc_id, tree) and r.grown_shard == by_hand(r.doc_id, op.grown(tree))
    for s in range(16):
        own = sorted(r.slot for r in found if r.shard == s)
        assert own == list(range(len(own)))


def shards(spark, tree, n=4_000):
    return {r.doc_id: r.shard for r in op.assigned(spark.range(n).withColumnRenamed("id", "doc_id"), tree).collect()}


def test_growth_takes_rows_only_into_the_new_shard(spark):
    tree = op.even_tree(16)
    now = shards(spark, tree)
    for _ in range(3):
        tree = op.grown(tree)
        new = max(op.shards_of(tree))
        then = shards(spark, tree)
        moved = {k for k in now if now[k] != then[k]}
        assert {then[k] for k in moved} == {new}
        assert 0.5 * 4_000 / (new + 1) < len(moved) < 1.7 * 4_000 / (new + 1)
        now = then


def test_weights_and_confined_movement(spark):
    tree = op.even_tree(16)
    heavy = op.reweighted(tree, 5, 4.0)  # region0/rack1
    a, b = shards(spark, tree), shards(spark, heavy)
    share = Counter(b.values())
    assert share[5] / 4_000 == pytest.approx(4 / 19, rel=0.2) and share[9] / 4_000 == pytest.approx(1 / 19, rel=0.3)
    rack, region = lambda s: s // 4, lambda s: s // 8
    moved = [(a[k], b[k]) for k in a if a[k] != b[k]]
    assert moved
    for was, now in moved:
        # Into the changed region, or within it into the changed rack, or within that into the changed shard.
        assert region(now) == 0 and (region(was) != 0 or rack(now) == 1 and (rack(was) != 1 or now == 5))
    empty = op.reweighted(tree, 5, 0.0)
    assert 5 not in set(shards(spark, empty).values())
    report = op.moves(spark.range(500).selectExpr("id doc_id", "'ab' text"), tree, op.grown(tree)).collect()
    assert {r.target_shard for r in report} == {16} and sum(r.n_bytes for r in report) == 3 * sum(r.n_rows for r in report)


def test_odd_rows(spark):
    rows = [(None, None, "x", 1, 1)] * 500 + [(7, "é" * 50_000, "y", 1, 1)] * 3 + [(8, "", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = op.digests(docs, 16, bucket_rows=20).collect()
    assert len(found) == 504 and len({r.shard for r in found if r.doc_id is None}) == 1
    assert {(r.size, r.text_crc32) for r in found if r.doc_id is None} == {(1, 0)} and {r.size for r in found if r.doc_id == 7} == {100_001}
    for s in {r.shard for r in found}:
        own = sorted(r.slot for r in found if r.shard == s)
        assert own == list(range(len(own)))
    whole = op.sharded(docs, op.even_tree(4), bucket_rows=50)
    assert set(whole.columns) == {"doc_id", "text", "shard", "bucket_", "number_", "slot"} and whole.count() == 504
    assert op.digests(docs.limit(0)).count() == 0


def test_written_shards_and_bad_trees(spark, tmp_path):
    docs = spark.range(300).selectExpr("id doc_id", "concat('t', id) text")
    op.write_shards(docs, op.even_tree(4), str(tmp_path / "out"), file_rows=50)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.doc_id, r.shard) for r in back.collect()} == {(k, s) for k, s in shards(spark, op.even_tree(4), 300).items()}
    for tree in ({"a": {"b": {0: 0.0}}}, {"a": {"b": {0: 1.0}, "c": {0: 1.0}}}, {"a": {"b": {0: math.nan}}}, {}):
        with pytest.raises(ValueError):
            op.assigned(docs, tree)


def test_no_python_in_the_plan(spark, sf, capsys):
    QUERIES["op11_sharding"](spark, sf).explain()
    assert "Python" not in (plan := capsys.readouterr().out) and "Arrow" not in plan
