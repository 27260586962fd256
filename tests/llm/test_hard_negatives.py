"""Operator 13: against all pairs in plain integers, with pruning at work, and odd tables."""

import math

import numpy as np
from pyspark.sql import functions as F

from agrarium.llm import op13_hard_negatives as op

SCHEMA = "vec_id long, embedding array<float>, label int, row long, size int, peers string"


def brute(rows, positives=5, negatives=10):
    used = [(v, [math.floor(256 * float(np.float32(x))) for x in e], n) for v, e, n in rows if n is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, (anchor, a, label) in enumerate(used):
        if anchor is None or anchor % 10:
            continue
        scored = [(-sum(x * y for x, y in zip(a, b)), v is None, v or 0, v, n) for j, (v, b, n) in enumerate(used) if j != i and len(a) == len(b)]
        for p in sorted(x[:4] for x in scored if x[4] == label)[:positives]:
            s = -p[0]
            fits = sorted(x[:4] for x in scored if x[4] != label and 30 * s <= -100 * x[0] <= 90 * s)
            out += [(anchor, p[3], r, n[3], s, -n[0]) for r, n in enumerate(fits[:negatives], 1)]
    return sorted(out, key=str)


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in op.hard_negatives(df, F.col("vec_id") % 10 == 0, **options).collect()), key=str)


def table(seed, n, d):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, d)) + 0.5 * rng.normal(size=d)
    v[: n // 3] = v[0] + 0.05 * rng.normal(size=(n // 3, d))  # a third are near copies
    v[5:9] = v[5]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return [(i, x.astype(np.float32).tolist(), int(rng.integers(0, 4)) if i > n // 4 else 1) for i, x in enumerate(v)]


def test_equals_all_pairs(spark):
    rows = table(3, 400, 12)
    rows += [(50, rows[51][1], 2), (None, rows[7][1], 1), (None, rows[8][1], 3), (410, [1.0] * 12, None), (420, None, 1), (430, [1.0, None] * 6, 1), (440, [float("nan")] * 12, 1), (450, [float("inf")] * 12, 1), (460, [0.0] * 12, 2), (470, [0.5, 0.25], 1), (471, [0.5, 0.2], 1), (472, [0.3, 0.1], 0), (480, [], 1), (481, [], 1), (482, [], 2), (490, [-1.0] * 12, 9)]
    want = brute(rows)
    assert len(want) > 500 and any(r[0] == 470 for r in want) and any(r[0] == 480 for r in want)
    assert found(spark, rows) == want
    assert found(spark, rows, cells=160) == want


def test_norms_prune():
    """Few pairs are scored whole, dimensions are left out of the index, and no pair above its threshold is lost."""
    rng = np.random.default_rng(4)
    scale = 1 / np.arange(1, 65)
    whole = np.floor(256 * rng.normal(size=(1_100, 64)) * scale).astype("<i8")

    def rows(x, first):
        n = len(x)
        return op.Rows(64, np.arange(first, first + n).astype("<i8").tobytes(), np.arange(n).astype("<i8").tobytes(), np.ones(n, bool).tobytes(), (np.arange(n) % 3).astype("<i8").tobytes(), x.tobytes(), np.arange(64))

    a, r = rows(whole[:100], 0), rows(whole[100:], 100)
    scores = whole[:100] @ whole[100:].T
    alike = a.label[:, None] == r.label[None, :]
    least = np.sort(np.where(alike, scores, -(10**9)), axis=1)[:, -5].astype(float)
    own, other, score, scored = op.reaching(a, r, least, True)
    want = np.nonzero(alike & (scores >= least[:, None]))
    assert set(zip(own.tolist(), other.tolist())) == set(zip(want[0].tolist(), want[1].tolist()))
    assert (score == scores[own, other]).all() and scored < 0.3 * alike.sum()


def test_few_rows_and_none(spark):
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1)]) == []
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 0.0], 2), (3, [0.91, 0.0], 2), (10, [-1.0, 0.0], 1)]
    assert found(spark, rows) == brute(rows)


def test_grid_does_not_pass_through_the_driver(spark):
    """Anchors are few bytes in their file, but stand in each column of the grid: they must not be broadcast."""
    rows = op.numbered(op.usable(spark.createDataFrame([(*r, 1, 2, "x") for r in table(5, 200, 8)], SCHEMA), F.col("label")))
    blocks = op.packed_blocks(rows, 8 * 16)
    asked = rows.where("vec_id % 10 = 0").withColumns({"order": F.lit(np.arange(8).astype("<i8").tobytes()), "low": F.lit(np.array([-np.inf]).tobytes()), "high": F.lit(np.array([np.inf]).tobytes())})
    hits = op.threshold_join(op.packed_blocks(asked, 8 * 4), blocks, False, 10_000, (5, 2))
    assert "Broadcast" not in hits._jdf.queryExecution().toString()
    labels = [n for _, _, n in table(5, 200, 8)]
    assert sorted((r.vec_id, r.score) for r in hits.where("window = 0").collect()) == sorted((b, int(x)) for a in range(0, 200, 10) for b, x in _others(a, labels))


def _others(a, labels):
    v = [[math.floor(256 * float(np.float32(x))) for x in e] for _, e, _ in table(5, 200, 8)]
    return [(b, sum(x * y for x, y in zip(v[a], v[b]))) for b in range(200) if labels[b] != labels[a]]
