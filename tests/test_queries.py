"""Every named query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from agrarium.plans.catalog import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture
def duck(sf, tmp_path):
    """A database of its own for each case, with bounds, so that a fatal error stays with the case that made it."""
    con = duckdb.connect(config={"memory_limit": "3GB", "threads": "2", "temp_directory": str(tmp_path)})
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    yield con
    con.close()


def rows(found):
    plain = lambda v: round(v, 7) if isinstance(v, float) else v.replace(tzinfo=None) if getattr(v, "tzinfo", None) else v
    return sorted((tuple(map(plain, r)) for r in found), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, duck, name):
    df, want = QUERIES[name](spark, sf), duck.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    got, expected = rows(df.select(*columns).collect()), rows(want.select(*(f'"{c}"' for c in columns)).fetchall())
    assert len(got) == len(expected)
    for a, b in zip(got, expected):
        assert a == pytest.approx(b, rel=1e-6, abs=1e-6) if all(isinstance(v, (int, float)) for v in a + b) else all(u == v or (isinstance(u, float) and u == pytest.approx(v, rel=1e-6)) for u, v in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 4
    assert set(e.oracle_sql()) <= set(e.queries())
