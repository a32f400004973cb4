"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(DIR + "/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_all_sql_agrees(spark, duck):
    wrong = []
    for name, sql in entry.oracle_sql().items():
        df = entry.queries()[name](spark, DIR)
        cols = sorted(df.columns)
        got = Counter(tuple(str(r[c]) for c in cols) for r in df.collect())
        rel = duck.sql(sql)
        at = [rel.columns.index(c) for c in cols] if sorted(rel.columns) == cols else None
        if at is None or got != Counter(tuple(str(r[k]) for k in at) for r in rel.fetchall()):
            wrong.append(name)
    assert not wrong


def test_flagship(spark):
    assert entry.entry(spark).count() >= 0
