"""Every registered query of the core against DuckDB on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from ripplemark.queries import ORACLE_SQL, QUERIES

TABLES = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not glob.glob(f"{TABLES}/*.parquet"), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{TABLES}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    return str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, TABLES)
    columns = sorted(df.columns)
    got = sorted("|".join(plain(r[c]) for c in columns) for r in df.collect())
    if name not in ORACLE_SQL:
        return
    answer = con.execute(ORACLE_SQL[name])
    theirs = [d[0] for d in answer.description]
    assert sorted(theirs) == columns
    assert got == sorted("|".join(plain(r[theirs.index(c)]) for c in columns) for r in answer.fetchall())
