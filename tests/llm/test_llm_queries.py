"""The package's queries: names, SQL where there is any, and that the rest of the library doesn't need them."""

import re
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from agrarium.llm.queries import ORACLES, QUERIES

ROOT = Path(__file__).resolve().parent.parent.parent


def test_each_operator_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, len(QUERIES) + 1))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df, want = QUERIES[name](spark, sf), con.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(want.select(*columns).fetchall())


def test_nothing_else_imports_it(tmp_path):
    """The rest imports and lists its queries where this package and the pipeline are missing."""
    (tmp_path / "agrarium").mkdir()
    for p in (ROOT / "agrarium").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "agrarium" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; assert not [n for n in e.queries() if n.startswith('op1')]; assert 'pipeline' not in e.queries(); print(len(e.queries()))"
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) > 100
