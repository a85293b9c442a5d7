"""Every registered query against its SQL in DuckDB, on the driver's small tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from lorestone.plans import catalogue, parsing  # noqa: F401  importing it registers its queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr([plain(v) for v in r]) for r in df.select(*columns).collect())
    want = duck.sql(catalogue.ORACLE_SQL[name])
    order = [want.columns.index(c) for c in columns]
    assert columns == sorted(want.columns)
    assert got == sorted(repr([plain(r[i]) for i in order]) for r in want.fetchall())
