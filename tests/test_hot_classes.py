"""Ranks within a class and running counts over scores that no single task sorts."""

import random
import re

from pyspark.sql import functions as F

from agrarium.operators import evaluation, splits


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def labelled(spark):
    return spark.createDataFrame([(i * 7919, None if i % 50 == 0 else "hot" if i % 10 else "cold") for i in range(2000)], "id long, label string")


def test_stratified_ranks(spark):
    df = labelled(spark)
    rows = sorted(((r.label, r.m, r.id) for r in df.withColumn("m", splits.mark(F.col("id"), 42)).collect()), key=lambda r: (str(r[0]), r[1:]))
    want, fold, seen = {}, {}, {}
    sizes = {x: sum(r[0] == x for r in rows) for x in (None, "hot", "cold")}
    for label, _, i in rows:
        r = seen[label] = seen.get(label, 0) + 1
        first, second = round(sizes[label] * 0.2), round(sizes[label] * 0.1)
        want[i], fold[i] = "test" if r <= first else "validation" if r <= first + second else "train", (r - 1) % 5
    split, folds = splits.stratified_split(df, "id", "label", 0.2, 0.1), splits.folds(df, "id", 5, within="label")
    assert split.columns == ["id", "label", "split"] and folds.columns == ["id", "label", "fold"]
    assert {r.id: r.split for r in split.collect()} == want and {r.id: r.fold for r in folds.collect()} == fold
    for df in (split, folds):
        assert re.findall(r"row_number\(\) windowspecdefinition\(label#\d+, _b#\d+L", plan_of(df)) and not re.search(r"windowspecdefinition\(label#\d+, (?!_b)", plan_of(df))


def test_auc_of_continuous_scores(spark):
    rng = random.Random(4)
    rows = [(rng.choice((rng.random(), 1e12 * rng.random(), round(rng.random(), 1))), rng.randint(0, 1)) for _ in range(1500)]
    found = evaluation.roc_auc(spark.createDataFrame(rows, "score double, y int"), "score", "y")
    up, down = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((a > b) + (a == b) / 2 for a in up for b in down) / len(up) / len(down)
    got = found.first()
    assert abs(got.auc - want) < 1e-12 and (got.positives, got.negatives) == (len(up), len(down))
    assert not re.search(r"windowspecdefinition\(s#\d+ ASC", plan_of(found))
    none = evaluation.roc_auc(spark.createDataFrame([], "score double, y int"), "score", "y").first()
    assert none.auc == 0
