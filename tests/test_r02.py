"""Queries against their SQL on tables that the given ones aren't like: values near halves, rows of one key."""

import duckdb
import pytest

from framewright.plans import catalog, frame_catalog  # noqa: F401  registers its queries


def differing(spark, folder, name: str) -> list:
    """Rows that a query and its SQL don't share, over the folder's events."""
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    want = con.sql(catalog.ORACLES[name])
    got = catalog.QUERIES[name](spark, str(folder)).select(*[f"`{c}`" for c in want.columns])
    key = lambda row: tuple("nan" if v != v else v for v in row)  # noqa: E731  null is None, NaN equals NaN
    return sorted(set(map(key, got.collect())) ^ set(map(key, want.fetchall())), key=repr)


@pytest.mark.parametrize("name", ["divide_by_zero", "arithmetic"])
def test_fractions_near_halves_are_rounded_as_by_the_sql(spark, tmp_path, name):
    # by event_id: n is 1, 2 and 4, 0 (and the value 0, so NaN), 0; none of these values is a half in binary
    rows = [(1, 263.9233675), (2, 263.923367), (4, 8278.71201), (37, 33.263138), (11, 0.0), (22, 3.0), (26, 65.21999)]
    spark.createDataFrame([(i, 1, "view", v) for i, v in rows], "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    assert differing(spark, tmp_path, name) == []


def test_rounding_of_great_and_nearly_half_fractions(spark):
    from framewright.functions import scalar as S
    from framewright.types import FLOAT

    values = [0.49999999999999994, 0.5, -0.5, 2.5, 4503599627370497.0, 1e300, float("inf")]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(S.round_half_away(catalog.C("v"), FLOAT).alias("x")).collect()
    assert [x.x for x in got] == [0.0, 1.0, -1.0, 3.0, 4503599627370497.0, 1e300, float("inf")]


WHOLE = {
    "lead": lambda s: s.shift(-20, 0), "pct": lambda s: s.pct_change(2), "rolling": lambda s: s.rolling(18).std(), "cumsum": lambda s: s.cumsum(), "cummin": lambda s: s.cummin(),
    "expanding": lambda s: s.expanding().std(), "mean": lambda s: s.expanding().mean(), "count": lambda s: s.expanding().count(),
}


@pytest.mark.parametrize("name", WHOLE)
def test_windows_over_whole_tables_in_blocks_are_those_of_one_partition(spark, monkeypatch, name):
    from framewright.operators import windows
    from framewright.plans.frame import Frame

    def values() -> list:
        f = Frame(catalog.events(spark, "/root/testdata/sf0.001").select("event_id", "value", catalog.F.lit(None).alias("gone")), "event_id")
        return [(r.event_id, r.gone, r.x is None, pytest.approx(r.x or 0, 1e-9, 1e-9)) for r in f.assign(x=WHOLE[name](f["value"])).df.orderBy("event_id").collect()]

    want = values()
    monkeypatch.setattr(windows, "ROWS", 300)
    assert [(*r[:3], r[3].expected) for r in values()] == want


@pytest.mark.parametrize("name", ["mask_by_window", "reset_index_series", "head_negative", "head_negative_ties", "equals_repeated_keys"])
def test_no_step_gathers_a_great_table_in_one_partition(spark, monkeypatch, name):
    from framewright.operators import windows

    monkeypatch.setattr(windows, "ROWS", 100, raising=False)
    assert "SinglePartition" not in catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_head_and_tail_of_negative_n_among_equal_rows(spark, monkeypatch):
    from framewright.operators import ordering, windows

    monkeypatch.setattr(windows, "ROWS", 100, raising=False)
    rows = spark.range(200).selectExpr("1 AS k", "IF(id % 2 = 0, 0D, -0D) AS v", "null AS gone")
    assert [f(rows, -7, ["k"]).count() for f in (ordering.head, ordering.tail)] == [193, 193]
    assert [f(rows, -300, ["k"]).count() for f in (ordering.head, ordering.tail)] == [0, 0]


@pytest.mark.parametrize("name", ["str_normalize_nfc", "str_normalize", "str_title", "str_swapcase", "str_wrap"])
def test_texts_travel_to_python_in_small_batches(spark, name):
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan


def test_rows_of_compared_frames_are_dealt_by_their_number(spark, monkeypatch):
    from framewright.operators import ordering, windows

    monkeypatch.setattr(windows, "ROWS", 100)
    rows = spark.range(1000).selectExpr("id % 300 AS k", "IF(id % 2 = 0, cast('0' AS double), cast('-0' AS double)) AS v", "IF(id % 3 = 0, double('NaN'), null) AS w", "map('m', id % 5) AS m", "null AS gone")
    other = rows.selectExpr("cast(k AS int) AS k", "-v AS v", "w", "m", "gone").repartition(2)
    found = ordering.differences(rows, other)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and ", 11)" in plan and "RoundRobin" not in plan
    assert plan.count("Exchange hashpartitioning") == 2  # no further one for the counts
    assert found.first()[0] == 0
    assert ordering.differences(rows, other.where("k > 0")).first()[0] == 4
    assert ordering.differences(rows.unionAll(rows.limit(7)), other).first()[0] == 7


def test_no_task_counts_more_rows_of_compared_frames_as_they_grow(spark, monkeypatch):
    from framewright.operators import ordering, windows

    seen, plain = [], ordering.differences

    def differences(*args, **named):
        found = plain(*args, **named)
        seen.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(windows, "ROWS", 100)
    monkeypatch.setattr(ordering, "differences", differences)
    assert [tuple(r) for r in catalog.QUERIES["equals_repeated_keys"](spark, "/root/testdata/sf0.001").collect()] == [(True, False)]
    assert len(seen) == 2
    for plan in seen:
        assert plan.count("REPARTITION_BY_NUM") == plan.count("Exchange hashpartitioning") > 0
        assert "RoundRobin" not in plan
