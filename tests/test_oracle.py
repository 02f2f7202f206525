"""Every query against its SQL in DuckDB on the smallest tables."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

from quillon import plans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def norm(v):
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def same(a, b):
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return abs(a - b) <= 2e-6
    return a == b


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str)
    sql = plans.oracle_sql().get(name)
    if sql:
        rel = duck.sql(sql)
        assert sorted(rel.columns) == cols
        want = sorted((tuple(norm(dict(zip(rel.columns, x, strict=True))[c]) for c in cols) for x in rel.fetchall()), key=str)
        assert len(got) == len(want)
        assert all(map(same, got, want))


def test_queries_are_listed_without_a_session():
    """The lists of queries and SQL texts need no Spark, so importing builds no column."""
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and len(q) > 100"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
