"""Registered queries against their SQL on the smallest data; and what the entry promises."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no data")
ALL = {name: q for m in entry._MODULES if not m.__name__.split(".")[1] == "llm" for name, q in m.QUERIES.items()}
SQL = {name: q for m in entry._MODULES if not m.__name__.split(".")[1] == "llm" for name, q in m.SQL.items()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, duck, name):
    df = ALL[name](spark, DATA)
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(plain(v) for v in r) for r in result.fetchall())
    got = sorted(tuple(plain(v) for v in r) for r in df.select(*names).collect())
    assert got == want


def test_entry(spark):
    assert SQL.keys() <= ALL.keys() and entry.oracle_sql().keys() <= entry.queries().keys()
    assert entry.entry(spark).columns == ["target_id", "mission", "quarter_no", "idx"]
