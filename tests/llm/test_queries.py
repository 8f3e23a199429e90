"""Every query of the subpackage runs with a stable schema; those with SQL agree with DuckDB."""

import glob
import os

import duckdb
import pytest

from skein.llm import queries
from skein.session import ship_package


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, data, name):
    ship_package(spark)
    rows = queries.QUERIES[name](spark, data).collect()
    if name not in queries.SQL:
        return
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    cur = con.execute(queries.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(tuple(r[c] for c in names) for r in rows) == sorted(cur.fetchall())
