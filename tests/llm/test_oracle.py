"""The registered queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from lodestream.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equal(spark, name):
    db = duckdb.connect()
    db.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    want = db.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(r) for r in df.select(*names).collect()) == sorted(want.fetchall())
