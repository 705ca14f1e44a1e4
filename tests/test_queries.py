"""Every document query against its SQL oracle, on the smallest tables."""

import os

import pytest

import __spark_entry__
from docweave import queries
from jobs import queries as jobs

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


ALL = queries.QUERIES | jobs.QUERIES


@pytest.mark.parametrize("name", [n for n, (_, sql) in ALL.items() if sql])
def test_matches_oracle(spark, duck, name):
    query, sql = ALL[name]
    got, want = query(spark, SF).toPandas(), duck.sql(sql).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    key = lambda df: sorted(map(str, df[cols].itertuples(index=False, name=None)))
    assert key(got) == key(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
