"""Kernel SHAP against the sum over all orders of features."""

from itertools import permutations

import numpy as np
import pytest

from agrarium.operators import inference


def by_orders(model, x, background):
    k, total = len(x), np.zeros(len(x))
    orders = list(permutations(range(k)))
    for order in orders:
        row = background.copy()
        for i in order:
            before = model(row[None])[0]
            row[i] = x[i]
            total[i] += model(row[None])[0] - before
    return total / len(orders)


def test_all_coalitions(spark):
    model = lambda x: x[:, 0] * x[:, 1] * x[:, 2] + np.sin(x[:, 3]) - x[:, 1] ** 2
    rng = np.random.default_rng(1)
    xs, background = rng.normal(size=(30, 4)), rng.normal(size=4)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(xs)] + [(99, None)], "id int, x array<double>")
    got = {r["id"]: r["values"] for r in inference.shapley(df, "id", "x", model, background).collect()}
    assert sorted(got) == list(range(30))
    for i, x in enumerate(xs):
        assert got[i] == pytest.approx(by_orders(model, x, background), abs=1e-9)


def test_sampled_coalitions_are_seeded_and_add_up(spark):
    model = lambda x: np.tanh(x).sum(axis=1) + x[:, 0] * x[:, 9]
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(600, 10)))], "id int, x array<double>")
    a, b = ({r["id"]: r["values"] for r in inference.shapley(df.repartition(n), "id", "x", model, np.zeros(10), samples=512).collect()} for n in (1, 3))
    for r in df.limit(20).collect():
        assert a[r["id"]] == pytest.approx(b[r["id"]], abs=1e-12)
        assert sum(a[r["id"]]) == pytest.approx(model(np.array([r["x"]]))[0], abs=1e-9)


def test_one_feature(spark):
    df = spark.createDataFrame([(1, [3.0])], "id int, x array<double>")
    assert inference.shapley(df, "id", "x", lambda x: x[:, 0] ** 2, np.array([1.0])).first()["values"] == [8.0]
