"""Every query with SQL gives the SQL's rows on the smallest driver tables (skipped where these are missing)."""

from __future__ import annotations

import glob
import math
import os

import pytest

import __spark_entry__ as entry
from factgraph.plans import registry

SF = "/root/testdata/sf0.001"
NAMES = sorted(registry.oracle_sql())


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    return str([plain(x) for x in v]) if isinstance(v, list) else str(v)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no driver tables")
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    out = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in out.fetchall())
    assert got == want


def test_entry(spark):
    if not os.path.isdir(SF):
        pytest.skip("no driver tables")
    assert entry.entry(spark).limit(1).count() == 1
