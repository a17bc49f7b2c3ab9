"""Registered queries of the Frame and Series interface: values in and out, alignment, windows, places and errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright import api
from framewright.plans.catalog import EVENTS, C, events, query, r, rounded, table
from framewright.plans.frame import Frame, Series
from framewright.session import scratch
from framewright.sources import csv


def _frame(spark, sf_dir, name: str, order: str, *columns: str) -> Frame:
    return Frame(table(spark, sf_dir, name).select(order, *columns), order)


def _events(spark, sf_dir) -> Frame:
    return Frame(events(spark, sf_dir), "event_id")


# -- values in and out (small tables: what passes the driver is a result) ---------------------------------------------------


@query("SELECT n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def frame_from_dict(spark, sf_dir):
    return api.DataFrame(_frame(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey").to_dict()).df


@query("SELECT n_nationkey, n_name FROM nation")
def frame_from_records(spark, sf_dir):
    return api.DataFrame(_frame(spark, sf_dir, "nation", "n_nationkey", "n_name").to_dict("records")).df


@query("SELECT n_nationkey * 10 AS v FROM nation")
def series_from_list(spark, sf_dir):
    return (api.series(_frame(spark, sf_dir, "nation", "n_nationkey")["n_nationkey"].tolist(), "v") * 10).df


@query("SELECT n_nationkey::DOUBLE AS \"0\", n_regionkey::DOUBLE AS \"1\" FROM nation")
def frame_from_numpy(spark, sf_dir):
    return api.DataFrame(_frame(spark, sf_dir, "nation", "n_nationkey", "n_regionkey").to_numpy()).df


@query("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS at, n_nationkey, n_name FROM nation")
def iterate_rows(spark, sf_dir):
    f = _frame(spark, sf_dir, "nation", "n_nationkey", "n_name")
    assert [t[1:] for t in f.itertuples()] == [tuple(row.values()) for _, row in f.iterrows()]
    return api.DataFrame([{"at": i, **row} for i, row in f.iterrows()]).df


@query("SELECT 'n_nationkey: ' || count(n_nationkey) || ' non-null int64' AS line FROM nation UNION ALL SELECT 'n_name: ' || count(n_name) || ' non-null object' FROM nation")
def frame_info(spark, sf_dir):
    return api.series(_frame(spark, sf_dir, "nation", "n_nationkey", "n_name").info().split("\n"), "line").df


@query("SELECT r_regionkey || '  ' || r_name AS line FROM region UNION ALL SELECT 'r_regionkey  r_name' UNION ALL SELECT '[' || count(*) || ' rows x 2 columns]' FROM region")
def frame_to_string(spark, sf_dir):
    return api.series(_frame(spark, sf_dir, "region", "r_regionkey", "r_name").to_string().split("\n"), "line").df


@query("SELECT s_acctbal AS bal FROM supplier")
def series_to_frame(spark, sf_dir):
    return _frame(spark, sf_dir, "supplier", "s_suppkey", "s_acctbal")["s_acctbal"].to_frame("bal")[["bal"]].df


@query("SELECT count(*) AS n, 5 AS width, 'int64' AS kind, false AS empty FROM " + EVENTS)
def frame_shape(spark, sf_dir):
    f = _events(spark, sf_dir)
    return api.DataFrame({"n": [f.shape[0]], "width": [f.shape[1]], "kind": [f.dtypes["n"]], "empty": [f.empty]}).df.select("n", C("width").cast("int").alias("width"), "kind", "empty")


# -- selection --------------------------------------------------------------------------------------------------------------


@query("SELECT event_id, user_id, event_type, n, value * 2 AS twice FROM " + EVENTS)
def pop_column(spark, sf_dir):
    f = _events(spark, sf_dir)
    value, rest = f.pop("value")
    return rest.assign(twice=value * 2).df


@query("SELECT n_name FROM nation WHERE n_nationkey BETWEEN 3 AND 7")
def loc_slice(spark, sf_dir):
    return _frame(spark, sf_dir, "nation", "n_nationkey", "n_name").loc[3:7, ["n_name"]].df


@query(f"SELECT event_id, value FROM {EVENTS} WHERE n > 5")
def loc_mask(spark, sf_dir):
    f = _events(spark, sf_dir)
    return f.loc[f["n"] > 5, ["event_id", "value"]].df


@query("SELECT n_nationkey, CASE WHEN n_nationkey = 24 THEN 'LAST' WHEN n_regionkey = 2 THEN 'TWO' ELSE n_name END AS n_name FROM nation")
def loc_set(spark, sf_dir):
    f = _frame(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey")
    f.loc[f["n_regionkey"] == 2, "n_name"] = "TWO"
    f.iloc[-1, "n_name"] = "LAST"
    return f[["n_nationkey", "n_name"]].df


@query("SELECT event_id, n FROM " + EVENTS)
def sample_all(spark, sf_dir):
    return _events(spark, sf_dir).sample(frac=1.0, random_state=3)[["event_id", "n"]].df


@query(f"SELECT max(event_id) AS last, round(avg(value), 6) AS mean FROM {EVENTS}")
def pipe_item_squeeze(spark, sf_dir):
    f = _events(spark, sf_dir).copy()
    mean = f.pipe(lambda x: x[["value"]].squeeze().mean())
    last = f.tail(1)["event_id"].item()
    return api.DataFrame({"last": [last], "mean": [mean]}).df.select("last", r(C("mean"), 6).alias("mean"))


@query('SELECT row_number() OVER (ORDER BY event_id) - 1 AS "index", n FROM ' + EVENTS)
def reset_index_series(spark, sf_dir):
    return _events(spark, sf_dir)["n"].reset_index().df.select(C("index").cast("long").alias("index"), "n")


@query("SELECT n_name, n_regionkey FROM nation")
def set_index_frame(spark, sf_dir):
    return _frame(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey").set_index("n_nationkey").reset_index().df


@query(f"SELECT event_id, n FROM (SELECT *, row_number() OVER (ORDER BY n DESC NULLS LAST, event_id DESC) AS k FROM {EVENTS}) WHERE k > 10")
def head_negative_ties(spark, sf_dir):
    # by a key that rows repeat: every row but ten counts, whichever of the equal ones are left out
    f = Frame(events(spark, sf_dir).select("event_id", "n", F.struct(C("n").isNotNull(), "n", "event_id").alias("key")), "key")
    return f.head(-10)[["event_id", "n"]].df


@query("SELECT count(*) - 10 AS n FROM events")
def tail_negative_repeated_keys(spark, sf_dir):
    f = Frame(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id")
    return f.tail(-10).df.agg(F.count(F.lit(1)).alias("n"))


# -- alignment and windows --------------------------------------------------------------------------------------------------


@query(f"SELECT a.event_id, round(a.value + b.n * 2, 6) AS v, coalesce(a.n = b.user_id % 11, false) AS same FROM {EVENTS} a JOIN {EVENTS} b USING (event_id)")
def series_two_frames(spark, sf_dir):
    f, g = _events(spark, sf_dir), Frame(events(spark, sf_dir).withColumn("u", C("user_id") % 11), "event_id")
    out = f.assign(v=f["value"] + g["n"] * 2, same=f["n"] == g["u"])
    return out.df.select("event_id", r(C("v"), 6).alias("v"), F.coalesce("same", F.lit(False)).alias("same"))


@query(f"""SELECT event_id, CASE WHEN n IS NOT NULL THEN sum(n) OVER w END::BIGINT AS total, n - lag(n) OVER w AS step, round(CASE WHEN row_number() OVER w >= 3 THEN
avg(n) OVER (ORDER BY event_id ROWS 2 PRECEDING) END, 6) AS mean FROM {EVENTS} WINDOW w AS (ORDER BY event_id)""")
def assign_window(spark, sf_dir):
    f = _events(spark, sf_dir)
    out = f.assign(total=f["n"].cumsum(), step=f["n"] - f["n"].shift(), mean=f["n"].rolling(3).mean())
    return rounded(out[["event_id", "total", "step", "mean"]].df, ["mean"], 6)


@query(f"SELECT event_id, n FROM (SELECT event_id, n, n - lag(n) OVER (ORDER BY event_id) AS d FROM {EVENTS}) WHERE d > 0")
def mask_by_window(spark, sf_dir):
    f = _events(spark, sf_dir)
    return f[f["n"].diff() > 0][["event_id", "n"]].df


@query(f"SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, n ORDER BY event_id) AS k FROM {EVENTS}) WHERE k > 1")
def mask_by_duplicated(spark, sf_dir):
    f = _events(spark, sf_dir)
    return f[f.duplicated(["user_id", "n"])][["event_id"]].df


@query(f"SELECT event_id, n + 1 AS n, 'x' AS t, round(value, 6) AS v FROM {EVENTS}")
def set_columns(spark, sf_dir):
    f = _events(spark, sf_dir)[["event_id", "n", "value"]]
    f["v"] = f["value"]
    f["n"] = f["n"] + 1
    f["t"] = "x"
    return rounded(f.drop("value").df, ["v"], 6)


@query(f"SELECT event_id, CASE WHEN a.n > 4 THEN a.n ELSE 0 END AS n, CASE WHEN a.value > 4 THEN a.value ELSE 0 END AS value FROM {EVENTS} a")
def where_frame(spark, sf_dir):
    f = _events(spark, sf_dir)[["event_id", "n", "value"]]
    return f.where(f.gt(4), 0).df


@query("SELECT true AS same, false AS other FROM region LIMIT 1")
def equals_repeated_keys(spark, sf_dir):
    f = Frame(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id")
    return api.DataFrame({"same": [f.equals(Frame(f.df.repartition(7), "user_id"))], "other": [f.equals(f.head(-1))]}).df


# -- functions of the module, groups, joins, errors ---------------------------------------------------------------------------


@query("SELECT event_id, n IS NULL AS gone, value IS NOT NULL AS there FROM " + EVENTS)
def module_isna(spark, sf_dir):
    f = _events(spark, sf_dir)
    return f.assign(gone=api.isna(f["n"]), there=api.notna(f["value"]))[["event_id", "gone", "there"]].df


@query(f"SELECT event_type, round(avg(value), 6) AS value FROM {EVENTS} GROUP BY 1")
def groupby_picked_column(spark, sf_dir):
    return rounded(_events(spark, sf_dir).groupby("event_type")["value"].mean().df, ["value"], 6)


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def module_merge(spark, sf_dir):
    c, n = Frame(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey"), Frame(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    return api.merge(c, n, left_on="c_nationkey", right_on="n_nationkey")[["c_custkey", "n_name"]].df


def _raised(f) -> str:
    try:
        f()
    except Exception as e:  # noqa: BLE001  its name is the result
        return type(e).__name__
    return "nothing"


@query("SELECT 'TypeError' AS merge_kinds, 'NotImplementedError' AS encode, 'KeyError' AS unknown, 'ValueError' AS lengths")
def errors(spark, sf_dir):
    c, n = Frame(table(spark, sf_dir, "customer")), Frame(table(spark, sf_dir, "nation"))
    return api.DataFrame({
        "merge_kinds": [_raised(lambda: c.merge(n, left_on="c_name", right_on="n_nationkey"))], "encode": [_raised(lambda: n["n_name"].str.encode("utf-8"))],
        "unknown": [_raised(lambda: n["none"])], "lengths": [_raised(lambda: api.DataFrame({"a": [1], "b": [1, 2]}))],
    }).df


@query(f"SELECT round(max(value) - min(value), 6) AS value, (max(n) - min(n))::DOUBLE AS n FROM {EVENTS}")
def apply_columns(spark, sf_dir):
    spread = _events(spark, sf_dir)[["value", "n"]].apply(lambda s: s.max() - s.min())
    return rounded(api.DataFrame({k: [float(v)] for k, v in spread.items()}).df, ["value"], 6)


# -- texts --------------------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, regexp_full_match(p_name, '[A-Za-z]+') AS bare, false AS broken FROM part")
def str_isalpha_line_break(spark, sf_dir):
    f = _frame(spark, sf_dir, "part", "p_partkey", "p_name")
    broken = Series(f, F.concat(F.regexp_replace(C("p_name"), " ", ""), F.lit("\n")), "t")
    return f.assign(bare=f["p_name"].str.isalpha(), broken=broken.str.isalpha())[["p_partkey", "bare", "broken"]].df


@query("SELECT p_partkey, p_name || chr(10) || '\"' || p_brand || '\", x' AS t FROM part")
def csv_line_breaks(spark, sf_dir):
    path = scratch(spark, "breaks-csv")
    p = table(spark, sf_dir, "part")
    csv.write_csv(p.select("p_partkey", F.concat(C("p_name"), F.lit('\n"'), C("p_brand"), F.lit('", x')).alias("t")), path)
    return csv.read_csv(spark, path)
