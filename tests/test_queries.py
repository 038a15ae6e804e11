"""Every query with SQL gives what DuckDB gives for it."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from loomwright import cell_queries, lifecycle_queries  # noqa: F401  register their queries
from loomwright.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {Path(name).stem} AS SELECT * FROM '{DATA}/{name}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, db, name):
    df, expected = QUERIES[name](spark, DATA), db.sql(SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    at = [expected.columns.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in expected.fetchall()), key=str)
    assert sorted((tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=str) == want


def test_no_python_in_plans(spark):
    for name in SQL:
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name
