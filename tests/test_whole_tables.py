"""Registered queries that have to show every row of their tables."""

from framewright.plans import catalog

DATA = "/root/testdata/sf0.001"


def ids(spark, table, name):
    return sorted(r[0] for r in spark.read.parquet(f"{DATA}/{table}.parquet").select(name).collect())


def test_merge_null_keys_keeps_every_row_of_both_tables(spark):
    rows = catalog.QUERIES["merge_null_keys"](spark, DATA).collect()
    assert sorted(r.o_orderkey for r in rows if r.o_orderkey is not None) == ids(spark, "orders", "o_orderkey")
    assert sorted({r.c_custkey for r in rows if r.c_custkey is not None}) == ids(spark, "customer", "c_custkey")
    assert {(r.o_orderkey is None, r.c_custkey is None) for r in rows if r.k is None} == {(True, False), (False, True)}


def test_merges_take_whole_tables(spark):
    orders, customers = ids(spark, "orders", "o_orderkey"), ids(spark, "customer", "c_custkey")
    got = {how: catalog.QUERIES[f"merge_{how}"](spark, DATA).collect() for how in ("inner", "left", "right", "outer", "indicator")}
    for how in ("left", "outer", "indicator"):
        assert sorted(r.o_orderkey for r in got[how] if r.o_orderkey is not None) == orders
    for how in ("right", "outer", "indicator"):
        assert len({r.k for r in got[how] if r[3] is not None}) == len(customers)  # the right side's value
    assert {r._merge for r in got["indicator"]} == {"both", "left_only", "right_only"}
    assert sorted(r.o_orderkey for r in got["inner"]) == sorted(r.o_orderkey for r in got["indicator"] if r._merge == "both")


def test_cumprod_takes_every_event(spark):
    rows = catalog.QUERIES["cumprod"](spark, DATA).collect()
    assert sorted(r.event_id for r in rows) == ids(spark, "events", "event_id")
    assert {r.x for r in rows} == {1, -1}


def test_sort_nulls_last_shows_the_nulls(spark):
    rows = sorted(catalog.QUERIES["sort_nulls_last"](spark, DATA).collect(), key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(1, len(ids(spark, "events", "event_id")) + 1))
    assert [(r.n, r.event_id) for r in rows] == sorted(((r.n, r.event_id) for r in rows), key=lambda x: (x[0] is None, -(x[0] or 0), -x[1]))
    assert rows[-1].n is None


def test_csv_missing_values_takes_every_part(spark):
    rows = catalog.QUERIES["csv_missing_values"](spark, DATA).collect()
    assert sorted(r.p_partkey for r in rows) == ids(spark, "part", "p_partkey")
