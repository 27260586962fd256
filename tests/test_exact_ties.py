"""Queries against their SQL where sums, signs and halves decide."""

import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from agrarium.plans.catalog import ORACLES, QUERIES


@pytest.fixture
def compare(spark, sf, tmp_path):
    """Rows of a query and of its SQL as texts, over the small tables with some in place of theirs."""

    def run(name, **tables):
        for t in {f.removesuffix(".parquet") for f in os.listdir(sf)} - set(tables):
            os.symlink(f"{sf}/{t}.parquet", tmp_path / f"{t}.parquet")
        for t, columns in tables.items():
            pq.write_table(pa.table(columns), tmp_path / f"{t}.parquet")
        con = duckdb.connect()
        for f in os.listdir(tmp_path):
            con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{tmp_path}/{f}'")
        found = QUERIES[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(found.columns)} FROM ({ORACLES[name]})").fetchall()
        return sorted(map(repr, map(tuple, found.collect()))), sorted(map(repr, want))

    return run


def test_curves_know_one_zero_and_halves(compare):
    """Scores of both zeros are one threshold without a sign; shares such as 3/640 are rounded alike."""
    n = 640
    vectors = [[[-0.0, 0.0, 4e-8, -4e-8][i % 4] if j == 3 else 0.25 if j == 4 else i / 8192 for j in range(64)] for i in range(n)]
    labels = [4 if i in (5, 77, 200) else 3 if i < 3 else 7 for i in range(n)]
    got, want = compare("class_pr_curves", embeddings={"vec_id": list(range(n)), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array(labels, pa.int32())})
    assert not [r for r in got if "-0.0" in r] and got == want


def test_gates_by_sums_in_any_order(compare):
    """Means that equal their limits pass, whatever the order of the sums."""
    discounts, rows = [0.01, 0.1, 0.07, 0.03, 0.06, 0.02, 0.09, 0.04, 0.05, 0.08, 0.01, 0.1, 0.07, 0.03, 0.06, 0.02, 0.09, 0.04, 0.02, 0.02], []
    for supplier in range(60):
        turned = discounts[supplier % 20 :] + discounts[: supplier % 20]
        rows += [(supplier, x) for x in (turned if supplier < 30 else turned[::-1])]
    assert round(sum(discounts) * 100) == 101
    k = range(len(rows))
    items = {"l_orderkey": list(k), "l_suppkey": [s for s, _ in rows], "l_discount": [x for _, x in rows], "l_tax": [0.0418] * len(rows), "l_returnflag": ["R" if i % 2 else "N" for i in k]}
    got, want = compare("promotion_gates", lineitem=items)
    assert got == want and not [r for r in got if "drift" in r]


def test_features_round_halves_alike(compare):
    """Prices with a deviation of 16/9, so that 1 becomes 0.5625, half-way between two texts."""
    prices = [4.0, -4.0] * 6 + [1.0, -1.0] * 32 + [0.0] * 10 + [4.0, -4.0] * 6 + [1.0, -1.0] * 32
    n = len(prices)
    orders = {"o_orderkey": list(range(n)), "o_custkey": [i * 7 % 100 for i in range(n)], "o_orderstatus": ["O" if i % 3 else "F" for i in range(n)], "o_totalprice": prices}
    got, want = compare("tabular_pipeline", orders=orders)
    assert got == want and any("'0.563 " in r for r in got) and any("'-0.563 " in r for r in got)
