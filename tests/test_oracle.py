"""Every core query against DuckDB on the smallest tables: names, row count and values."""

import math
import os

import duckdb
import pytest

from lodestream import plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem".split():
        db.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return db


def plain(v):
    return round(v, 9) if isinstance(v, float) and not math.isnan(v) else v


def rows(names, found):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in at) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_equal(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    want = duck.execute(plans.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, want.fetchall())
