"""Every registered query against its SQL on the smallest data."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
KEYS = list(entry.oracle_sql())


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("key", KEYS)
def test_query_equals_sql(spark, con, key):
    df = entry.queries()[key](spark, SF)
    rel = con.execute(entry.oracle_sql()[key])
    names = [d[0] for d in rel.description]
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, rel.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 1
