"""Registered queries of this subpackage against their SQL on the smallest data."""

import glob
import os

import duckdb
import pytest

from dipweave.llm import entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no data")


@pytest.mark.parametrize("name", sorted(entry.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    df = entry.QUERIES[name](spark, DATA)
    result = con.execute(entry.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    plain = lambda r: tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r)
    assert sorted(map(plain, df.select(*names).collect())) == sorted(map(plain, result.fetchall()))
