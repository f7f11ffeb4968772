"""Registered queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from evloom.plans import catalog

DATA = "/root/testdata/sf0.001"
SOME = sorted(catalog.oracle_sql())[::4]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", SOME)
def test_same_rows(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    mine = catalog.queries()[name](spark, DATA)
    cols = sorted(mine.columns)
    theirs = con.sql(f"select {', '.join(cols)} from ({catalog.oracle_sql()[name]}) q").fetchall()
    norm = lambda rows: sorted(tuple(repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else repr(v) for v in r) for r in rows)
    assert norm(map(tuple, mine.select(*cols).collect())) == norm(theirs)


def test_registry():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
