"""Queries against their SQL over the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from blockml.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    key = lambda r: [(v is not None, str(v)) for v in r]
    got = sorted((tuple(map(plain, r)) for r in df.select(columns).collect()), key=key)
    want = sorted((tuple(map(plain, r)) for r in con.execute("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({catalogue.ORACLE_SQL[name]})").fetchall()), key=key)
    assert got == want
