"""Every query runs; those with SQL give what DuckDB gives on the same files."""

import datetime
import glob
import math
import os
from collections import Counter

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry

CORE = [n for n in entry.registry.QUERIES]


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (float, np.floating)):
        return round(float(v), 5)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="session")
def duck(data):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", CORE)
def test_query(spark, data, duck, name):
    df = entry.queries()[name](spark, data)
    cols = sorted(df.columns)
    assert len(set(cols)) == len(cols)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    cur = duck.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert got == Counter(tuple(plain(dict(zip(names, row, strict=True))[c]) for c in cols) for row in cur.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns[0] == "cluster_id"


def test_sql_has_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
