"""Every query with SQL against DuckDB on the smallest tables; the others must run."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
Q, O = entry.queries(), entry.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return c


def shown(v):
    if isinstance(v, float):
        return f"{v:.6f}"
    if isinstance(v, list):
        return str([shown(x) for x in v])
    return str(v)


@pytest.mark.parametrize("name", sorted(n for n in Q if not n.startswith("p")  or n in O))
def test_query(spark, duck, name):
    df = Q[name](spark, DATA)
    cols = sorted(df.columns)
    rows = sorted(tuple(shown(r[c]) for c in cols) for r in df.collect())
    if name in O:
        rel = duck.execute(O[name])
        theirs = [x[0] for x in rel.description]
        assert sorted(theirs) == cols
        at = [theirs.index(c) for c in cols]
        assert rows == sorted(tuple(shown(r[i]) for i in at) for r in rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "link_id"


def test_no_sql_without_query():
    assert set(O) <= set(Q)
