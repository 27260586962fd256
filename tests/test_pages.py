"""Pages by key and by counts, against sorted lists."""

import pytest
from pyspark.sql import functions as F

from agrarium.operators import sequences


@pytest.fixture(scope="module")
def ties(spark):
    """A third of all rows share one value, and some have none."""
    k = F.col("id")
    grade = F.when(k % 3 == 0, "b").when(k % 11 == 0, None).otherwise(F.chr(97 + k % 5))
    return spark.range(600).select(k.alias("k"), grade.alias("g"), F.when(k % 7 == 0, None).when(k % 13 == 0, float("nan")).otherwise((k % 10) / 4).alias("x")).cache()


def in_order(df, order):
    return [tuple(r) for r in df.orderBy(*sequences.ordered(order)).collect()]


def same(a, b):
    return repr(a) == repr(b)


@pytest.mark.parametrize("order", [["g", "x", "k"], ["-g", "-x", "k"], ["-x", "g", "-k"], ["k"]])
def test_pages_follow_each_other(ties, order):
    want, got, last = in_order(ties, order), [], None
    for _ in range(5):
        part = sequences.next_page(ties, order, last, 150).collect()
        got += [tuple(r) for r in part]
        last = tuple(part[-1][c.lstrip("-")] for c in order) if part else last
    assert same(got, want)


@pytest.mark.parametrize("order", [["g", "x", "k"], ["-g", "-x", "k"], ["-x", "g"]])
@pytest.mark.parametrize("number", [1, 9, 30])
def test_pages_by_counts(ties, order, number):
    want = in_order(ties, order)[(number - 1) * 20 : number * 20]
    got = sequences.page(ties, order, number, 20, near=0).collect()
    assert [r["total"] for r in got] == [600] * 20
    columns = [c.lstrip("-") for c in order]
    assert same([tuple(r[c] for c in columns) for r in got], [tuple(dict(zip(("k", "g", "x"), w))[c] for c in columns) for w in want])


def test_rank_and_end(ties):
    assert sequences.row_at(ties, ["k"], 600) == ((599,), 0)
    assert sequences.row_at(ties, ["k"], 601) is None
    assert sequences.page(ties, ["k"], 31, 20, near=0).count() == 0
    assert sequences.page(ties.limit(0), ["k"], 1, 20, near=0).count() == 0
    # Rows that are equal in all order columns are counted off.
    value, behind = sequences.row_at(ties, ["g"], 300)
    assert [r["g"] for r in ties.orderBy("g").collect()][299] == value[0]
    assert behind == 299 - ties.where(F.col("g").isNull() | (F.col("g") < value[0])).count()


def test_the_bound_reaches_the_scan(ties, spark, tmp_path):
    ties.write.parquet(str(tmp_path / "t"))
    plan = sequences.next_page(spark.read.parquet(str(tmp_path / "t")), ["k"], (300,), 10)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(k,300)" in plan
