"""Every query with SQL against DuckDB at the smallest scale."""

import glob
import os

import pytest

from flowspark import queries as Q

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(spark, duck, name):
    have, want = Q.QUERIES[name](spark, DATA).toPandas(), duck.execute(Q.SQL[name]).df()
    columns = sorted(have.columns)
    assert columns == sorted(want.columns)
    text = lambda t: sorted(map(tuple, t[columns].astype(str).to_numpy().tolist()))
    assert text(have) == text(want)


def test_each_sql_has_a_query():
    assert set(Q.SQL) <= set(Q.QUERIES)
