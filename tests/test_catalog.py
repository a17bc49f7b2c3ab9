"""Every registered query of the core engine against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from framewright.plans import catalog, frame_catalog  # noqa: F401  registers its queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(v):
    return ("nan" if v != v else round(v, 7)) if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_query_equals_its_sql(spark, sql, name):
    df, rel = catalog.QUERIES[name](spark, DATA), sql.sql(catalog.ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)


@pytest.mark.parametrize(("name", "f"), [("str_title", str.title), ("str_swapcase", lambda t: t.capitalize().swapcase())])
def test_python_text_functions(spark, name, f):
    from framewright.plans.catalog import parts

    names = {r.p_partkey: r.t for r in parts(spark, DATA).collect()}
    for r in catalog.QUERIES[name](spark, DATA).collect():
        assert r.x == (None if names[r.p_partkey] is None else f(names[r.p_partkey]))


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalog.QUERIES["filter_mask"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,200000.0)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in plan


def test_top_k_is_not_a_full_sort(spark):
    plan = catalog.QUERIES["nlargest"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
