"""Every registered query of the engine against its SQL in DuckDB."""

import os

import duckdb
import pytest
from graphsieve.plans import queries as q

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return c


def text(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    try:
        f = float(v)
        return str(int(f)) if f == int(f) else f"{f:.9g}"
    except (TypeError, ValueError):
        return str(v)


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, con, name):
    df = q.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(tuple(text(r[c]) for c in columns) for r in df.collect())
    if name not in q.ORACLE_SQL:
        assert got
        return
    result = con.execute(q.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(tuple(text(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert got == want


def test_scan_reads_only_what_it_needs(spark):
    plan = q.QUERIES["q_scan_call_regex"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "value" not in plan.split("ReadSchema")[-1]
