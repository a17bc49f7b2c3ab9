"""The queries that SQL can say, against it."""

import os

import duckdb
import pytest

from framewright.llm import queries


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_its_sql(spark, small, name):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{small}/{f}'")
    df, rel = queries.QUERIES[name](spark, small), con.sql(queries.ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    assert got == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)
