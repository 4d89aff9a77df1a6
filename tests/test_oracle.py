"""Every query with SQL against DuckDB on the smallest tables."""

import math
from decimal import Decimal

import duckdb
import pytest

from gridloom.plans.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, name):
    if name == "scene_pipeline":
        pytest.skip("no SQL")
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    mine = sorted((tuple(plain(v) for v in r) for r in df.select(*cols).collect()), key=repr)
    found = duck.sql(ORACLE_SQL[name])
    at = [found.columns.index(c) for c in cols]
    assert mine == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
