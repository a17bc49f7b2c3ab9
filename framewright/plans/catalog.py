"""Registered queries of the core engine, each with the DuckDB SQL that gives the same rows.

Every query calls the operators; the SQL says independently what they should give. Fractions are rounded on both sides,
since sums depend on the order of addition. Nulls are made where the tables have none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import scalar as S
from framewright.functions import strings as X
from framewright.operators import aggregate, grouping, joins, ordering, query_expr, reshape, select, udf, windows
from framewright.plans.frame import Frame
from framewright.session import scratch
from framewright.sources import csv
from framewright.types import FLOAT, INT, column

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
C = column


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL twin if it has one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c, digits: int = 4):
    """Binary rounding of a fraction, as the SQL's; Spark's own rounds the shortest decimal, which differs near halves."""
    return S.round_half_away(c, FLOAT, digits)


def rounded(df: DataFrame, names: list[str], digits: int = 4) -> DataFrame:
    return df.select(*[r(C(c), digits).alias(c) if c in names else C(c) for c in df.columns])


def holes(df: DataFrame) -> DataFrame:
    """Lineitem with nulls in quantity (line 3) and discount (line 2)."""
    return df.select("*", F.when(C("l_linenumber") != 3, C("l_quantity")).alias("q"), F.when(C("l_linenumber") != 2, C("l_discount")).alias("d"))


HOLES = "(SELECT *, CASE WHEN l_linenumber <> 3 THEN l_quantity END AS q, CASE WHEN l_linenumber <> 2 THEN l_discount END AS d FROM lineitem)"
EVENTS = "(SELECT event_id, user_id, event_type, CASE WHEN event_id % 7 <> 0 THEN value END AS value, CASE WHEN event_id % 5 <> 0 THEN event_id % 11 END AS n FROM events)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", F.when(C("event_id") % 7 != 0, C("value")).alias("value"), F.when(C("event_id") % 5 != 0, C("event_id") % 11).alias("n"))


# -- flagship -------------------------------------------------------------------------------------------------------------


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
round(avg(l_extendedprice), 4) AS avg_price, count(*) AS n FROM lineitem WHERE l_quantity < 45 GROUP BY 1, 2 ORDER BY 1, 2""")
def pricing_summary(spark, sf_dir):
    li = select.keep_rows(table(spark, sf_dir, "lineitem"), C("l_quantity") < 45)
    li = select.assign(li, revenue=C("l_extendedprice") * (1 - C("l_discount")))
    g = li.groupBy("l_returnflag", "l_linestatus").agg(r(F.sum("l_quantity"), 2).alias("sum_qty"), r(F.sum("revenue"), 2).alias("revenue"), r(F.avg("l_extendedprice")).alias("avg_price"), F.count(F.lit(1)).alias("n"))
    return ordering.sort(g, ["l_returnflag", "l_linestatus"])


# -- selection ------------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'O'")
def filter_mask(spark, sf_dir):
    f = Frame(table(spark, sf_dir, "orders"))
    return f[(f["o_totalprice"] > 200000.0) & (f["o_orderstatus"] == "O")][["o_orderkey", "o_totalprice"]].df


@query("SELECT event_id, n FROM " + EVENTS + " WHERE (n > 3 AND value < 50) OR NOT (n <> 1) OR (2 < n AND n <= 4)")
def query_and_or(spark, sf_dir):
    return query_expr.query(events(spark, sf_dir), "(n > 3 and value < 50) or not (n != 1) or 2 < n <= 4").select("event_id", "n")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW') AND o_custkey % 3 = 1")
def query_in_mod(spark, sf_dir):
    return query_expr.query(table(spark, sf_dir, "orders"), "o_orderpriority not in ['1-URGENT', '5-LOW'] and o_custkey % 3 == 1").select("o_orderkey", "o_orderpriority")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem
WHERE floor((l_linenumber - 5) / 2) = -1 AND ((l_partkey - 500) % 7 + 7) % 7 = 3 AND l_linenumber * l_linenumber < 16 OR l_quantity = 2 * 2 * 2 AND l_linenumber = 1""")
def query_floor_power(spark, sf_dir):
    text = "(l_linenumber - 5) // 2 == -1 and (l_partkey - 500) % 7 == 3 and l_linenumber ** 2 < 16 or l_quantity == 2 ** 3 and l_linenumber == 1"
    return query_expr.query(table(spark, sf_dir, "lineitem"), text).select("l_orderkey", "l_linenumber")


@query("""SELECT event_id, coalesce(n BETWEEN 3 AND 7, false) AS b_both, coalesce(n >= 3 AND n < 7, false) AS b_left, coalesce(n > 3 AND n <= 7, false) AS b_right,
coalesce(n > 3 AND n < 7, false) AS b_neither FROM """ + EVENTS)
def between_modes(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", *[S.between(C("n"), 3, 7, m).alias(f"b_{m}") for m in ("both", "left", "right", "neither")])


@query("SELECT event_id, coalesce(n IN (1, 4, 9), false) AS in_n, event_type IN ('click', 'view') AS in_t FROM " + EVENTS)
def isin_values(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.select("event_id", S.is_in(C("n"), INT, [1, 4.0, 9]).alias("in_n"), S.is_in(C("event_type"), "object", ["click", "view", 3]).alias("in_t"))


@query("SELECT c_custkey, c_acctbal AS c_acctbal_v2, c_acctbal * 2 AS twice, c_acctbal * 2 + 1 AS more FROM customer")
def assign_rename(spark, sf_dir):
    c = select.assign(table(spark, sf_dir, "customer"), twice=C("c_acctbal") * 2, more=lambda d: d["twice"] + 1)
    return select.rename(select.drop(c, ["c_name", "c_nationkey", "c_mktsegment", "unknown"]), {"c_acctbal": "c_acctbal_v2"})


@query("SELECT p_partkey AS pre_p_partkey_z, p_size AS pre_p_size_z FROM part")
def add_prefix_suffix(spark, sf_dir):
    return Frame(table(spark, sf_dir, "part")).filter(items=["p_partkey", "p_size", "none"]).add_prefix("pre_").add_suffix("_z").df


@query("SELECT p_partkey, p_retailprice FROM part")
def filter_names_regex(spark, sf_dir):
    return select.filter_names(table(spark, sf_dir, "part"), regex="key$|price$")


@query("SELECT p_partkey, p_size, p_retailprice FROM part")
def select_dtypes_number(spark, sf_dir):
    return select.select_dtypes(table(spark, sf_dir, "part"), include="number")


@query("SELECT r_name, CAST(NULL AS DOUBLE) AS missing, r_regionkey FROM region")
def reindex_columns(spark, sf_dir):
    return select.reindex(table(spark, sf_dir, "region"), ["r_name", "missing", "r_regionkey"])


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 7")
def head_rows(spark, sf_dir):
    return Frame(table(spark, sf_dir, "customer"), "c_custkey").head(7)[["c_custkey", "c_name"]].df


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey DESC LIMIT 7")
def tail_rows(spark, sf_dir):
    return Frame(table(spark, sf_dir, "customer"), "c_custkey").tail(7)[["c_custkey", "c_name"]].df


@query("SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey DESC) AS k FROM customer) WHERE k > 5")
def head_negative(spark, sf_dir):
    return Frame(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").head(-5).df


@query("SELECT n_nationkey, n_name FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS k FROM nation) WHERE k >= 2 AND k < 20 AND (k - 2) % 3 = 0")
def iloc_slice(spark, sf_dir):
    return select.at_places(table(spark, sf_dir, "nation"), ["n_nationkey"], slice(2, 20, 3)).select("n_nationkey", "n_name")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (0, 3, 24)")
def iloc_list(spark, sf_dir):
    return select.at_places(table(spark, sf_dir, "nation"), ["n_nationkey"], [3, 0, -1]).select("n_nationkey", "n_name")


@query("SELECT n_nationkey, CASE WHEN n_nationkey = 4 THEN 'changed' ELSE n_name END AS n_name FROM nation")
def set_cell(spark, sf_dir):
    return select.set_at(table(spark, sf_dir, "nation"), ["n_nationkey"], 4, {"n_name": "changed"}).select("n_nationkey", "n_name")


@query("SELECT event_id, CASE WHEN coalesce(n > 5, false) THEN n ELSE -1 END AS w, CASE WHEN coalesce(n > 5, false) THEN -1 ELSE n END AS m FROM " + EVENTS)
def where_mask(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.select("event_id", S.where(C("n"), C("n") > 5, -1).alias("w"), S.mask(C("n"), C("n") > 5, -1).alias("m"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'c' ELSE event_type END AS event_type, CASE n WHEN 4 THEN 40 ELSE n END AS n FROM " + EVENTS)
def replace_values(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.select("event_id", S.replace(C("event_type"), "object", "click", "c").alias("event_type"), S.replace(C("n"), INT, 4, 40).alias("n"))


@query("""SELECT e.event_id, e.user_id, coalesce(o.value, e.value) AS value FROM events e
LEFT JOIN (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0.5 END AS value FROM events WHERE event_id % 2 = 0) o USING (event_id)""")
def update_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    other = e.where("event_id % 2 = 0").select("event_id", F.when(C("event_id") % 4 == 0, F.lit(0.5)).alias("value"))
    return select.update(e, other, ["event_id"])


# -- scalar functions -----------------------------------------------------------------------------------------------------


@query("SELECT event_id, n + 2 AS a, n - user_id AS b, n * 3 AS c, 10 - n AS d, -n AS e, round(value / 4, 6) AS f, round(value * n, 6) AS g FROM " + EVENTS)
def arithmetic(spark, sf_dir):
    f = Frame(events(spark, sf_dir))
    n, u, v = f["n"], f["user_id"], f["value"]
    return f.df.select("event_id", (n + 2).expr.alias("a"), (n - u).expr.alias("b"), (n * 3).expr.alias("c"), (10 - n).expr.alias("d"), (-n).expr.alias("e"), r((v / 4).expr, 6).alias("f"), r((v * n).expr, 6).alias("g"))


@query("""SELECT event_id, CASE WHEN n IS NULL OR value IS NULL THEN NULL WHEN n = 0 AND value > 0 THEN 'Infinity'::DOUBLE WHEN n = 0 AND value < 0 THEN '-Infinity'::DOUBLE
WHEN n = 0 THEN 'NaN'::DOUBLE ELSE round(value / n, 6) END AS x FROM """ + EVENTS)
def divide_by_zero(spark, sf_dir):
    out = S.arithmetic("/", C("value"), C("n"), FLOAT, INT)
    return events(spark, sf_dir).select("event_id", r(out, 6).alias("x"))


@query("SELECT event_id, n = 4 AS eq, n <> 4 AS ne, n < value AS lt, n <= 4 AS le, n > value AS gt, n >= 4 AS ge FROM " + EVENTS)
def comparisons(spark, sf_dir):
    f = Frame(events(spark, sf_dir))
    n, v = f["n"], f["value"]
    return f.df.select("event_id", *[x.expr.alias(k) for k, x in {"eq": n == 4, "ne": n != 4, "lt": n < v, "le": n <= 4, "gt": n > v, "ge": n >= 4}.items()])


@query("SELECT event_id, coalesce(n > 4, false) AND coalesce(value > 50, false) AS a, coalesce(n > 4, false) OR coalesce(value > 50, false) AS o, NOT coalesce(n > 4, false) AS x FROM " + EVENTS)
def null_false_logic(spark, sf_dir):
    a, b = C("n") > 4, C("value") > 50
    return events(spark, sf_dir).select("event_id", S.both(a, b).alias("a"), S.either(a, b).alias("o"), S.negate(a).alias("x"))


@query("SELECT c_custkey, abs(c_acctbal) AS a, CASE WHEN c_acctbal < 0 THEN 0.0 WHEN c_acctbal > 5000 THEN 5000.0 ELSE c_acctbal END AS c FROM customer")
def abs_clip(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", S.absolute(C("c_acctbal")).alias("a"), S.clip(C("c_acctbal"), FLOAT, 0, 5000).alias("c"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN -floor(-c_acctbal * 10.0 + 0.5) / 10.0 ELSE floor(c_acctbal * 10.0 + 0.5) / 10.0 END AS x FROM customer")
def round_binary(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", S.round_half_away(C("c_acctbal"), FLOAT, 1).alias("x"))


@query("SELECT event_id, n IS NULL AS missing, n IS NOT NULL AS there, coalesce(n, -5) AS filled, coalesce(value, 0.0) AS filled_value FROM " + EVENTS)
def nulls_fill(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", C("n").isNull().alias("missing"), C("n").isNotNull().alias("there"), S.fill(C("n"), INT, -5).alias("filled"), S.fill(C("value"), FLOAT, 0).alias("filled_value"))


@query("SELECT event_id FROM " + EVENTS + " WHERE n IS NOT NULL AND value IS NOT NULL")
def dropna_any(spark, sf_dir):
    return select.dropna(events(spark, sf_dir), "any", ["n", "value"]).select("event_id")


@query("SELECT event_id FROM " + EVENTS + " WHERE n IS NOT NULL OR value IS NOT NULL")
def dropna_all(spark, sf_dir):
    return select.dropna(events(spark, sf_dir), "all", ["n", "value"]).select("event_id")


@query("""SELECT event_id, CAST(trunc(value) AS BIGINT) AS i, CAST(n AS DOUBLE) AS f, CAST(n AS VARCHAR) AS s, n <> 0 AS b,
CASE WHEN n > 4 THEN 'True' WHEN n <= 4 THEN 'False' END AS t FROM """ + EVENTS)
def casts(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", S.cast(C("value"), FLOAT, "int64").alias("i"), S.cast(C("n"), INT, float).alias("f"), S.cast(C("n"), INT, "str").alias("s"), S.cast(C("n"), INT, bool).alias("b"), S.cast(C("n") > 4, "bool", "str").alias("t"))


# -- aggregates -----------------------------------------------------------------------------------------------------------


@query("""SELECT round(sum(q), 2) AS s, round(avg(q), 6) AS mean, min(q) AS lo, max(q) AS hi, count(q) AS n, round(var_samp(q), 6) AS v, round(stddev_samp(q), 6) AS sd,
median(q) AS med, quantile_cont(q, 0.9) AS q90, round(stddev_samp(q) / sqrt(count(q)), 8) AS sem, count(DISTINCT q) AS u FROM """ + HOLES)
def aggregates(spark, sf_dir):
    e = lambda f, **k: aggregate.expression(f, C("q"), FLOAT, **k)
    return holes(table(spark, sf_dir, "lineitem")).agg(
        r(e("sum"), 2).alias("s"), r(e("mean"), 6).alias("mean"), e("min").alias("lo"), e("max").alias("hi"), e("count").alias("n"), r(e("var"), 6).alias("v"), r(e("std"), 6).alias("sd"),
        e("median").alias("med"), e("quantile", q=0.9).alias("q90"), r(e("sem"), 8).alias("sem"), e("nunique").alias("u"),
    )


@query("SELECT count(l_orderkey) AS l_orderkey, count(q) AS q, count(d) AS d, count(l_returnflag) AS l_returnflag FROM " + HOLES)
def count_columns(spark, sf_dir):
    return aggregate.aggregate(holes(table(spark, sf_dir, "lineitem")), "count", ["l_orderkey", "q", "d", "l_returnflag"])


@query("SELECT CAST(product(CASE WHEN n_nationkey < 12 THEN n_nationkey + 1 ELSE 1 END) AS BIGINT) AS p FROM nation")
def product_int(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.when(C("n_nationkey") < 12, C("n_nationkey").cast("long") + 1).otherwise(F.lit(1)).alias("p"))
    return aggregate.aggregate(n, "prod")


for _f, _sql in {
    "sum": "coalesce(q, 0) + coalesce(d, 0)", "mean": "(coalesce(q, 0) + coalesce(d, 0)) / (CASE WHEN q IS NULL THEN 0 ELSE 1 END + CASE WHEN d IS NULL THEN 0 ELSE 1 END)",
    "min": "least(q, d)", "max": "greatest(q, d)", "prod": "coalesce(q, 1) * coalesce(d, 1)",
    "median": "list_aggregate(list_value(q, d), 'median')", "var": "coalesce(list_aggregate(list_value(q, d), 'var_samp'), 0)", "std": "coalesce(list_aggregate(list_value(q, d), 'stddev_samp'), 0)",
}.items():

    def _across(spark, sf_dir, f=_f):
        li = holes(table(spark, sf_dir, "lineitem")).select("q", "d")
        return aggregate.across(li, f, "x").groupBy(r(C("x"), 5).alias("x")).agg(F.count(F.lit(1)).alias("n"))

    QUERIES[f"axis1_{_f}"] = _across
    ORACLES[f"axis1_{_f}"] = f"SELECT round({_sql}, 5) AS x, count(*) AS n FROM {HOLES} GROUP BY 1"


@query("SELECT bool_or(coalesce(n <> 0, false)) AS n, bool_or(coalesce(value <> 0, false)) AS value FROM " + EVENTS)
def any_columns(spark, sf_dir):
    return aggregate.any_all(events(spark, sf_dir).select("n", "value"), "any")


@query("SELECT bool_and(coalesce(n <> 0, true)) AS n, bool_and(coalesce(value <> 0, true)) AS value FROM " + EVENTS)
def all_columns(spark, sf_dir):
    return aggregate.any_all(events(spark, sf_dir).select("n", "value"), "all")


@query(" UNION ALL ".join(f"SELECT '{s}' AS stat, round(CAST({f.format('q')} AS DOUBLE), 6) AS q, round(CAST({f.format('d')} AS DOUBLE), 6) AS d FROM {HOLES}" for s, f in {"count": "count({})", "mean": "avg({})", "std": "stddev_samp({})", "min": "min({})", "max": "max({})"}.items()))
def describe_num(spark, sf_dir):
    return rounded(aggregate.describe(holes(table(spark, sf_dir, "lineitem")).select("q", "d")), ["q", "d"], 6)


@query(f"""SELECT CAST(count(q) AS DOUBLE) AS count, round(avg(q), 6) AS mean, round(stddev_samp(q), 6) AS std, min(q) AS min, quantile_cont(q, 0.25) AS "25%",
quantile_cont(q, 0.5) AS "50%", quantile_cont(q, 0.75) AS "75%", max(q) AS max FROM {HOLES}""")
def describe_series(spark, sf_dir):
    return rounded(aggregate.describe_column(holes(table(spark, sf_dir, "lineitem")), "q"), ["mean", "std"], 6)


@query(f"""WITH m AS (SELECT covar_samp(q, q) AS qq, covar_samp(q, d) AS qd, covar_samp(d, d) AS dd FROM {HOLES})
SELECT 'q' AS "column", round(qq, 6) AS q, round(qd, 6) AS d FROM m UNION ALL SELECT 'd', round(qd, 6), round(dd, 6) FROM m""")
def cov_matrix(spark, sf_dir):
    return rounded(aggregate.matrix(holes(table(spark, sf_dir, "lineitem")).select("q", "d"), "cov"), ["q", "d"], 6)


@query(f"""WITH m AS (SELECT corr(q, d) AS qd FROM {HOLES})
SELECT 'q' AS "column", 1.0::DOUBLE AS q, round(qd, 6) AS d FROM m UNION ALL SELECT 'd', round(qd, 6), 1.0::DOUBLE FROM m""")
def corr_matrix(spark, sf_dir):
    return rounded(aggregate.matrix(holes(table(spark, sf_dir, "lineitem")).select("q", "d"), "corr"), ["q", "d"], 6)


@query(f"WITH c AS (SELECT n, count(*) AS k FROM {EVENTS} WHERE n IS NOT NULL GROUP BY n) SELECT n FROM c WHERE k = (SELECT max(k) FROM c)")
def mode_values(spark, sf_dir):
    return aggregate.mode(events(spark, sf_dir), "n")


@query("SELECT o_totalprice AS value, (SELECT count(*) FROM orders p WHERE p.o_orderkey < o.o_orderkey) AS idx FROM orders o ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def idxmax_place(spark, sf_dir):
    return aggregate.extreme_place(table(spark, sf_dir, "orders"), "o_totalprice", [C("o_orderkey")])


@query("SELECT o_totalprice AS value, (SELECT count(*) FROM orders p WHERE p.o_orderkey < o.o_orderkey) AS idx FROM orders o ORDER BY o_totalprice, o_orderkey LIMIT 1")
def idxmin_place(spark, sf_dir):
    return aggregate.extreme_place(table(spark, sf_dir, "orders"), "o_totalprice", [C("o_orderkey")], "min")


@query(f"SELECT round(sum(q), 2) AS q_sum, round(avg(q), 6) AS q_mean, max(d) AS d_max FROM {HOLES}")
def agg_dict(spark, sf_dir):
    out = aggregate.several(holes(table(spark, sf_dir, "lineitem")), {"q": ["sum", "mean"], "d": "max"})
    return out.select(r(C("q_sum"), 2).alias("q_sum"), r(C("q_mean"), 6).alias("q_mean"), "d_max")


@query("SELECT count(*) = count(DISTINCT o_orderkey) AS is_unique FROM orders")
def unique_flag(spark, sf_dir):
    return aggregate.is_unique(table(spark, sf_dir, "orders"), "o_orderkey")


@query("SELECT bool_and(coalesce(ts >= before, true)) AS monotonic FROM (SELECT ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)")
def monotonic_flag(spark, sf_dir):
    return ordering.monotonic(table(spark, sf_dir, "events"), "ts", ["event_id"], True, ["user_id"])


# -- groups ---------------------------------------------------------------------------------------------------------------

_BY = "l_returnflag, l_linestatus"
for _f, _sql in {
    "sum": "sum({})", "mean": "avg({})", "std": "stddev_samp({})", "var": "var_samp({})", "median": "median({})", "min": "min({})", "max": "max({})", "count": "count({})", "prod": None, "nunique": "count(DISTINCT {})",
}.items():
    if _sql is None:
        continue

    def _grouped(spark, sf_dir, f=_f):
        li = holes(table(spark, sf_dir, "lineitem"))
        out = grouping.aggregate(li, ["l_returnflag", "l_linestatus"], f, ["q", "d"])
        return out if f in ("count", "nunique") else rounded(out, ["q", "d"], 4)

    QUERIES[f"groupby_{_f}"] = _grouped
    _one = "{}" if _f in ("count", "nunique") else "round({}, 4)"
    ORACLES[f"groupby_{_f}"] = f"SELECT {_BY}, {_one.format(_sql.format('q'))} AS q, {_one.format(_sql.format('d'))} AS d FROM {HOLES} GROUP BY {_BY}"


@query(f"SELECT user_id, arg_min(n, event_id) FILTER (WHERE n IS NOT NULL) AS n_first, arg_max(n, event_id) FILTER (WHERE n IS NOT NULL) AS n_last FROM {EVENTS} GROUP BY user_id")
def groupby_first_last(spark, sf_dir):
    return grouping.several(events(spark, sf_dir), "user_id", {"n": ["first", "last"]}, [C("event_id")])


@query("SELECT o_custkey, count(*) AS o_orderkey, count(*) AS o_totalprice FROM orders GROUP BY o_custkey")
def groupby_size(spark, sf_dir):
    return grouping.size(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey")


@query(f"SELECT n, count(value) AS value FROM {EVENTS} WHERE n IS NOT NULL GROUP BY n")
def groupby_null_keys(spark, sf_dir):
    return grouping.aggregate(events(spark, sf_dir), "n", "count", ["value"])


@query("SELECT o_orderkey, o_custkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS o_totalprice FROM orders")
def groupby_transform_sum(spark, sf_dir):
    out = grouping.transform(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_custkey", "sum", ["o_totalprice"])
    return rounded(out, ["o_totalprice"], 2)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 10)")
def groupby_filter_size(spark, sf_dir):
    return grouping.keep_groups(table(spark, sf_dir, "orders"), "o_custkey", F.count(F.lit(1)) > 10).select("o_orderkey", "o_custkey")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey IN (SELECT n_regionkey FROM nation GROUP BY 1 HAVING max(n_nationkey) > 20)")
def groupby_filter_python(spark, sf_dir):
    return grouping.filter_python(table(spark, sf_dir, "nation"), "n_regionkey", lambda g: g.n_nationkey.max() > 20)


@query("SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n, max(c_acctbal) - min(c_acctbal) AS spread FROM customer GROUP BY c_mktsegment")
def groupby_apply_python(spark, sf_dir):
    def spread(g):
        import pandas as pd

        return pd.DataFrame({"c_mktsegment": [g.c_mktsegment.iloc[0]], "n": [len(g)], "spread": [g.c_acctbal.max() - g.c_acctbal.min()]})

    return grouping.apply_python(table(spark, sf_dir, "customer"), "c_mktsegment", spread, "c_mktsegment string, n long, spread double")


@query("SELECT count(DISTINCT o_custkey) AS groups FROM orders")
def groupby_len(spark, sf_dir):
    return grouping.count_groups(table(spark, sf_dir, "orders"), "o_custkey")


@query(f"SELECT event_type, round(sum(value), 4) AS value, max(n) AS n FROM {EVENTS} GROUP BY event_type")
def groupby_agg_dict(spark, sf_dir):
    return rounded(grouping.several(events(spark, sf_dir), "event_type", {"value": "sum", "n": "max"}), ["value"])


# -- joins ----------------------------------------------------------------------------------------------------------------

#: Orders and customers; every tenth key of each side is moved away, so that both have unmatched rows.
_L = "(SELECT CASE WHEN o_orderkey % 10 = 0 THEN -o_custkey ELSE o_custkey END AS k, o_orderkey, o_totalprice AS v FROM orders)"
_R = "(SELECT CASE WHEN c_custkey % 10 = 0 THEN c_custkey + 1000000000000 ELSE c_custkey END AS k, c_acctbal AS v FROM customer)"


def _sides(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.when(C("o_orderkey") % 10 == 0, -C("o_custkey")).otherwise(C("o_custkey")).alias("k"), "o_orderkey", C("o_totalprice").alias("v"))
    c = table(spark, sf_dir, "customer").select(F.when(C("c_custkey") % 10 == 0, C("c_custkey") + 10**12).otherwise(C("c_custkey")).alias("k"), C("c_acctbal").alias("v"))
    return o, c


for _how, _sql in {"inner": "JOIN", "left": "LEFT JOIN", "right": "RIGHT JOIN", "outer": "FULL JOIN"}.items():

    def _merged(spark, sf_dir, how=_how):
        return joins.merge(*_sides(spark, sf_dir), on="k", how=how)

    QUERIES[f"merge_{_how}"] = _merged
    ORACLES[f"merge_{_how}"] = f"SELECT k, o_orderkey, l.v AS v_x, r.v AS v_y FROM {_L} l {_sql} {_R} r USING (k)"


@query(f"SELECT k, o_orderkey, l.v AS v_l, r.v AS v_r, CASE WHEN l.o_orderkey IS NULL THEN 'right_only' WHEN r.v IS NULL THEN 'left_only' ELSE 'both' END AS _merge FROM {_L} l FULL JOIN {_R} r USING (k)")
def merge_indicator(spark, sf_dir):
    return joins.merge(*_sides(spark, sf_dir), on="k", how="outer", suffixes=("_l", "_r"), indicator=True)


@query("SELECT c_custkey, c_nationkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def merge_left_on_right_on(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return joins.merge(c, table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), left_on="c_nationkey", right_on="n_nationkey")


@query("""SELECT l_orderkey, l_linenumber, a.l_quantity AS q1, b.n FROM lineitem a JOIN
(SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2) b USING (l_orderkey, l_linenumber)""")
def merge_multi_key(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", C("l_quantity").alias("q1"))
    counts = li.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    return joins.merge(li, counts, on=["l_orderkey", "l_linenumber"])


@query("""SELECT coalesce(l.k, r.k) AS k, o_orderkey, c_custkey FROM (SELECT CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS k, o_orderkey FROM orders) l
FULL JOIN (SELECT CASE WHEN c_custkey % 5 <> 0 THEN c_custkey END AS k, c_custkey FROM customer) r ON l.k = r.k""")
def merge_null_keys(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.when(C("o_orderkey") % 7 != 0, C("o_custkey")).alias("k"), "o_orderkey")
    c = table(spark, sf_dir, "customer").select(F.when(C("c_custkey") % 5 != 0, C("c_custkey")).alias("k"), "c_custkey")
    return joins.merge(o, c, on="k", how="outer")


@query("SELECT a.n_nationkey AS n_nationkey_0, a.n_name, b.n_nationkey AS n_nationkey_1, b.big FROM nation a JOIN (SELECT n_nationkey, n_nationkey * 10 AS big FROM nation) b USING (n_nationkey)")
def concat_columns(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return joins.side_by_side([n.select("n_nationkey", "n_name"), n.select("n_nationkey", (C("n_nationkey") * 10).alias("big"))], [["n_nationkey"], ["n_nationkey"]])


# -- order, distinct ------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 50")
def sort_multi_limit(spark, sf_dir):
    return ordering.sort(table(spark, sf_dir, "orders"), ["o_orderpriority", "o_totalprice"], [True, False], ["o_orderkey"]).limit(50).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query(f"SELECT event_id, n, row_number() OVER (ORDER BY n DESC NULLS LAST, event_id DESC) AS position FROM {EVENTS}")
def sort_nulls_last(spark, sf_dir):
    return ordering.positions(events(spark, sf_dir).select("event_id", "n"), "n", False, ["event_id"])


@query(f"SELECT event_id, n FROM {EVENTS} ORDER BY n DESC NULLS LAST, event_id DESC LIMIT 25")
def nlargest(spark, sf_dir):
    return ordering.largest(events(spark, sf_dir), 25, "n", ["event_id"]).select("event_id", "n")


@query(f"SELECT event_id, n FROM {EVENTS} ORDER BY n NULLS LAST, event_id LIMIT 25")
def nsmallest(spark, sf_dir):
    return ordering.smallest(events(spark, sf_dir), 25, "n", ["event_id"]).select("event_id", "n")


@query(f"SELECT DISTINCT n FROM {EVENTS}")
def unique_values(spark, sf_dir):
    return ordering.unique(events(spark, sf_dir), "n")


for _keep, _sql in {"first": "row_number() OVER (PARTITION BY user_id, n ORDER BY event_id) > 1", "last": "row_number() OVER (PARTITION BY user_id, n ORDER BY event_id DESC) > 1", "none": "count(*) OVER (PARTITION BY user_id, n) > 1"}.items():

    def _dup(spark, sf_dir, keep=_keep):
        return ordering.duplicated(events(spark, sf_dir), ["user_id", "n"], False if keep == "none" else keep, ["event_id"]).select("event_id", "duplicated")

    def _dropped(spark, sf_dir, keep=_keep):
        return ordering.drop_duplicates(events(spark, sf_dir), ["user_id", "n"], False if keep == "none" else keep, ["event_id"]).select("event_id", "user_id", "n")

    QUERIES[f"duplicated_{_keep}"], QUERIES[f"drop_duplicates_{_keep}"] = _dup, _dropped
    ORACLES[f"duplicated_{_keep}"] = f"SELECT event_id, {_sql} AS duplicated FROM {EVENTS}"
    ORACLES[f"drop_duplicates_{_keep}"] = f"SELECT event_id, user_id, n FROM (SELECT *, {_sql} AS dup FROM {EVENTS}) WHERE NOT dup"


@query("SELECT event_type AS value, count(*) AS count FROM events GROUP BY 1")
def value_counts(spark, sf_dir):
    return Frame(table(spark, sf_dir, "events"))["event_type"].value_counts().df


@query(f"SELECT event_type, n, round(count(*) / (SELECT count(*) FROM {EVENTS} WHERE n IS NOT NULL), 8) AS count FROM {EVENTS} WHERE n IS NOT NULL GROUP BY 1, 2")
def value_counts_norm(spark, sf_dir):
    return rounded(ordering.value_counts(events(spark, sf_dir), ["event_type", "n"], normalize=True), ["count"], 8)


@query("SELECT count(*) AS differences FROM orders WHERE o_orderkey % 10 = 0")
def equals_differences(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return ordering.differences(o, o.withColumn("o_totalprice", F.when(C("o_orderkey") % 10 == 0, F.lit(-1.0)).otherwise(C("o_totalprice"))), ["o_orderkey"])


# -- reshaping ------------------------------------------------------------------------------------------------------------


@query("""SELECT c_custkey AS k, c_acctbal AS bal, c_name AS cname, NULL AS sname FROM customer UNION ALL SELECT s_suppkey, CAST(s_nationkey AS DOUBLE), NULL, s_name FROM supplier""")
def concat_rows(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(C("c_custkey").alias("k"), C("c_acctbal").alias("bal"), C("c_name").alias("cname"))
    return reshape.concat([a, table(spark, sf_dir, "supplier").select(C("s_suppkey").alias("k"), C("s_nationkey").alias("bal"), C("s_name").alias("sname"))])


@query("SELECT event_id, 'value' AS variable, value FROM " + EVENTS + " UNION ALL SELECT event_id, 'n', CAST(n AS DOUBLE) FROM " + EVENTS)
def melt_columns(spark, sf_dir):
    return reshape.melt(events(spark, sf_dir).select("event_id", "value", "n"), ["event_id"])


@query("SELECT event_id, CAST(0 AS INT) AS place, CAST(user_id AS BIGINT) AS v FROM " + EVENTS + " UNION ALL SELECT event_id, 1, n FROM " + EVENTS)
def stack_values(spark, sf_dir):
    return reshape.stack(events(spark, sf_dir).select("event_id", "user_id", "n"), ["event_id"], "v")


@query("SELECT c_mktsegment, round(avg(c_acctbal), 4) AS c_acctbal FROM customer GROUP BY 1")
def pivot_table_mean(spark, sf_dir):
    return rounded(reshape.pivot_table(table(spark, sf_dir, "customer"), "c_acctbal", "c_mktsegment"), ["c_acctbal"])


@query("SELECT o_orderpriority, " + ", ".join(f"round(sum(o_totalprice) FILTER (WHERE o_orderstatus = '{s}'), 2) AS \"{s}\"" for s in "FOP") + " FROM orders GROUP BY 1")
def pivot_table_columns(spark, sf_dir):
    return rounded(reshape.pivot_table(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderpriority", "o_orderstatus", "sum", ["F", "O", "P"]), ["F", "O", "P"], 2)


@query("""SELECT 'n_regionkey' AS "column", """ + ", ".join(f"max(n_regionkey) FILTER (WHERE n_nationkey = {i}) AS \"{i}\"" for i in range(25)) + " FROM nation")
def transpose_small(spark, sf_dir):
    return reshape.transpose(table(spark, sf_dir, "nation").select("n_nationkey", C("n_regionkey").cast("int")), ["n_nationkey"]).select("column", *[C(str(i)).cast("int").alias(str(i)) for i in range(25)])


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part")
def explode_words(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return reshape.explode(p.select("p_partkey", X.split(C("p_name"), " ").alias("w")), "w")


# -- windows --------------------------------------------------------------------------------------------------------------

_W = "OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)"
_O = "OVER (PARTITION BY user_id ORDER BY event_id)"


def _windowed(make, digits: int | None = 4):
    def run(spark, sf_dir):
        e = events(spark, sf_dir)
        out = make(e)
        return e.select("event_id", (out if digits is None else r(out, digits)).alias("x"))

    return run


_KEYS = {"order": "event_id", "partition_by": "user_id"}
for _name, (_make, _sql) in {
    "cumsum": (lambda e: windows.cumulative(e, "sum", "value", **_KEYS), f"CASE WHEN value IS NOT NULL THEN round(sum(value) {_W}, 4) END"),
    "cumsum_int": (lambda e: windows.cumulative(e, "sum", "n", **_KEYS), f"CASE WHEN n IS NOT NULL THEN CAST(sum(n) {_W} AS BIGINT) END"),
    "cummax": (lambda e: windows.cumulative(e, "max", "value", **_KEYS), f"CASE WHEN value IS NOT NULL THEN round(max(value) {_W}, 4) END"),
    "cummin": (lambda e: windows.cumulative(e, "min", "value", **_KEYS), f"CASE WHEN value IS NOT NULL THEN round(min(value) {_W}, 4) END"),
    "shift": (lambda e: windows.shift("value", periods=2, **_KEYS), f"round(lag(value, 2) {_O}, 4)"),
    "shift_back": (lambda e: windows.shift("value", periods=-1, **_KEYS), f"round(lead(value, 1) {_O}, 4)"),
    "diff": (lambda e: windows.diff(e, "value", periods=1, **_KEYS), f"round(value - lag(value, 1) {_O}, 4)"),
    "diff_neg": (lambda e: windows.diff(e, "value", periods=-2, **_KEYS), f"round(lead(value, 2) {_O} - value, 4)"),
    "pct_change": (lambda e: windows.pct_change("n", **_KEYS), f"CASE WHEN lag(n) {_O} <> 0 THEN round((n - lag(n) {_O}) / CAST(lag(n) {_O} AS DOUBLE), 4) END"),
    **{f"rolling_{f}": (lambda e, f=f: windows.rolling(e, f, "value", 3, **_KEYS), f"CASE WHEN row_number() {_O} >= 3 THEN round(CAST({g}(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE), 4) END") for f, g in {"mean": "avg", "sum": "sum", "min": "min", "max": "max", "std": "stddev_samp", "count": "count"}.items()},
    **{f"expanding_{f}": (lambda e, f=f: windows.expanding(e, f, "value", **_KEYS), f"round(CAST({g} AS DOUBLE), 4)") for f, g in {"mean": f"avg(value) {_W}", "sum": f"coalesce(sum(value) {_W}, 0)", "min": f"min(value) {_W}", "max": f"max(value) {_W}"}.items()},
    "expanding_count": (lambda e: windows.expanding(e, "count", "value", **_KEYS), f"count(value) {_W}"),
    **{f"rank_{m}": (lambda e, m=m: windows.rank(e, "n", m, True, **_KEYS), f"CASE WHEN n IS NOT NULL THEN CAST({g} AS DOUBLE) END") for m, g in {"average": "rank() OVER (PARTITION BY user_id ORDER BY n NULLS LAST) + (count(*) OVER (PARTITION BY user_id, n) - 1) / 2.0", "min": "rank() OVER (PARTITION BY user_id ORDER BY n NULLS LAST)", "max": "rank() OVER (PARTITION BY user_id ORDER BY n NULLS LAST) + count(*) OVER (PARTITION BY user_id, n) - 1", "first": "row_number() OVER (PARTITION BY user_id ORDER BY n NULLS LAST, event_id)", "dense": "dense_rank() OVER (PARTITION BY user_id ORDER BY n NULLS LAST)"}.items()},
    "rank_descending": (lambda e: windows.rank(e, "n", "min", False, **_KEYS), "CASE WHEN n IS NOT NULL THEN CAST(rank() OVER (PARTITION BY user_id ORDER BY n DESC NULLS LAST) AS DOUBLE) END"),
}.items():
    _sql = _sql.replace(", 4)", ", 9)") if _name.endswith("mean") else _sql
    QUERIES[_name] = _windowed(_make, 9 if _name.endswith("mean") else None if _name.startswith(("rank", "cumsum_int", "expanding_count")) else 4)
    ORACLES[_name] = f"SELECT event_id, {_sql} AS x FROM {EVENTS}"


@query("SELECT event_id, CAST(product(CASE WHEN event_id % 9 = 0 THEN -1 ELSE 1 END) OVER (PARTITION BY user_id, event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS x FROM events")
def cumprod(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("sign", F.when(C("event_id") % 9 == 0, F.lit(-1)).otherwise(F.lit(1)).cast("long"))
    return e.select("event_id", windows.cumulative(e, "prod", "sign", "event_id", ["user_id", "event_type"]).alias("x"))


# -- texts ----------------------------------------------------------------------------------------------------------------

_T = "(SELECT p_partkey, CASE WHEN p_partkey % 9 <> 0 THEN '  ' || p_name || chr(9) END AS s, CASE WHEN p_partkey % 9 <> 0 THEN p_name END AS t, CASE WHEN p_partkey % 2 = 0 THEN '-' ELSE '' END || CAST(p_size AS VARCHAR) AS z FROM part)"


def parts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    some = C("p_partkey") % 9 != 0
    sign = F.when(C("p_partkey") % 2 == 0, F.lit("-")).otherwise(F.lit(""))
    return p.select("p_partkey", F.when(some, F.concat(F.lit("  "), C("p_name"), F.lit("\t"))).alias("s"), F.when(some, C("p_name")).alias("t"), F.concat(sign, C("p_size").cast("string")).alias("z"))


for _name, (_c, _sql) in {
    "upper": (lambda: X.upper(C("t")), "upper(t)"),
    "lower": (lambda: X.lower(C("t")), "lower(t)"),
    "strip": (lambda: X.strip(C("s")), "t"),
    "lstrip": (lambda: X.lstrip(C("s")), "t || chr(9)"),
    "rstrip": (lambda: X.rstrip(C("s")), "'  ' || t"),
    "len": (lambda: X.length(C("s")), "length(s)"),
    "contains": (lambda: X.contains(C("t"), "E", case=False), "coalesce(contains(lower(t), 'e'), false)"),
    "startswith": (lambda: X.startswith(C("t"), "a"), "coalesce(starts_with(t, 'a'), false)"),
    "endswith": (lambda: X.endswith(C("t"), "e"), "coalesce(ends_with(t, 'e'), false)"),
    "replace": (lambda: X.replace(C("t"), "e", "<.>"), "replace(t, 'e', '<.>')"),
    "split_join": (lambda: X.join(X.split(C("s")), "-"), "CASE WHEN s IS NOT NULL THEN array_to_string(list_filter(string_split_regex(s, '\\s+'), lambda x: x <> ''), '-') END"),
    "slice": (lambda: X.slice_(C("t"), 1, -2), "CASE WHEN t IS NOT NULL THEN substring(t, 2, greatest(length(t) - 3, 0)) END"),
    "slice_step": (lambda: X.slice_(C("t"), None, None, -1), "reverse(t)"),
    "get": (lambda: X.get(C("t"), 3), "CASE WHEN length(t) > 3 THEN substring(t, 4, 1) END"),
    "find": (lambda: X.find(C("t"), "e", 2), "CASE WHEN t IS NULL OR strpos(substring(t, 3), 'e') = 0 THEN -1 ELSE strpos(substring(t, 3), 'e') + 1 END"),
    "zfill": (lambda: X.zfill(C("z"), 5), "CASE WHEN starts_with(z, '-') THEN '-' || lpad(substring(z, 2), 4, '0') ELSE lpad(z, 5, '0') END"),
    "capitalize": (lambda: X.capitalize(C("t")), "upper(substring(t, 1, 1)) || lower(substring(t, 2))"),
    "isnumeric": (lambda: X.isnumeric(C("z")), "regexp_full_match(z, '[0-9]+')"),
    "isalpha": (lambda: X.isalpha(C("t")), "coalesce(regexp_full_match(t, '[A-Za-z]+'), false)"),
    "isdigit": (lambda: X.isdigit(C("z")), "regexp_full_match(z, '[0-9]+')"),
    "isalnum": (lambda: X.isalnum(C("z")), "regexp_full_match(z, '[A-Za-z0-9]+')"),
    "isupper": (lambda: X.isupper(F.upper(C("t"))), "t IS NOT NULL"),
    "islower": (lambda: X.islower(C("t")), "coalesce(t = lower(t) AND t <> upper(t), false)"),
    "count": (lambda: X.count(C("t"), "e"), "CASE WHEN t IS NULL THEN 0 ELSE length(t) - length(replace(t, 'e', '')) END"),
    "match": (lambda: X.match(C("t"), "[a-m]+"), "coalesce(regexp_matches(t, '^[a-m]+'), false)"),
    "fullmatch": (lambda: X.fullmatch(C("t"), "[a-z]+ [a-m].*"), "coalesce(regexp_full_match(t, '[a-z]+ [a-m].*'), false)"),
    "extract": (lambda: X.extract(C("t"), "[n-z]+"), "CASE WHEN regexp_matches(t, '[n-z]+') THEN regexp_extract(t, '[n-z]+') END"),
    "pad": (lambda: X.pad(C("z"), 5, "left", "*"), "lpad(z, 5, '*')"),
    "center": (lambda: X.center(C("z"), 8, "*"), "repeat('*', (8 - length(z)) // 2) || z || repeat('*', 8 - length(z) - (8 - length(z)) // 2)"),
    "ljust": (lambda: X.ljust(C("z"), 5, "*"), "rpad(z, 5, '*')"),
    "rjust": (lambda: X.rjust(C("z"), 5, "*"), "lpad(z, 5, '*')"),
    "repeat": (lambda: X.repeat(C("z"), 3), "repeat(z, 3)"),
}.items():

    def _text(spark, sf_dir, c=_c):
        return parts(spark, sf_dir).select("p_partkey", c().alias("x"))

    QUERIES[f"str_{_name}"] = _text
    ORACLES[f"str_{_name}"] = f"SELECT p_partkey, {_sql} AS x FROM {_T}"


@query("SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_nationkey) AS x FROM nation GROUP BY 1")
def str_cat(spark, sf_dir):
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(X.cat(C("n_name"), "|", [C("n_nationkey")]).alias("x"))


@query(f"SELECT p_partkey, array_to_string(list_transform(string_split(t, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS x FROM {_T}")
def str_title(spark, sf_dir):
    return parts(spark, sf_dir).select("p_partkey", X.title(C("t")).alias("x"))


@query(f"SELECT p_partkey, lower(substring(t, 1, 1)) || upper(substring(t, 2)) AS x FROM {_T}")
def str_swapcase(spark, sf_dir):
    return parts(spark, sf_dir).select("p_partkey", X.swapcase(X.capitalize(C("t"))).alias("x"))


@query(f"""SELECT p_partkey, list_reduce(string_split(t, ' '), lambda a, w: a || CASE WHEN length(regexp_extract(a, '[^\n]*$')) + 1 + length(w) <= 8 THEN ' ' ELSE chr(10) END || w) AS x FROM {_T}""")
def str_wrap(spark, sf_dir):
    return parts(spark, sf_dir).select("p_partkey", X.wrap(C("t"), 8).alias("x"))


@query()
def str_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.normalize(C("text"), "NFKD").alias("x"))


@query("SELECT doc_id, nfc_normalize(text) AS x FROM documents")
def str_normalize_nfc(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.normalize(C("text"), "NFC").alias("x"))


# -- user functions -------------------------------------------------------------------------------------------------------


@query(f"SELECT event_id, CASE WHEN n IS NULL THEN -1 ELSE n * n END AS x FROM {EVENTS}")
def apply_values(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", udf.map_values(C("n"), lambda v: -1 if v is None else v * v, "int64").alias("x"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 END AS x FROM events")
def map_dict(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", udf.map_values(C("event_type"), {"click": 1, "view": 2}).alias("x"))


@query("SELECT n_name || ':' || CAST(n_regionkey AS VARCHAR) AS x FROM nation")
def apply_rows(spark, sf_dir):
    return udf.map_rows(table(spark, sf_dir, "nation"), lambda row: f"{row['n_name']}:{row['n_regionkey']}", "str", "x")


@query("SELECT CAST(length(n_name) AS BIGINT) AS n_name, CAST(length(n_comment) AS BIGINT) AS n_comment FROM (SELECT n_name, n_name || '!' AS n_comment FROM nation)")
def map_cells(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_name", F.concat("n_name", F.lit("!")).alias("n_comment"))
    return udf.map_cells(n, len, "int64")


# -- a workflow -----------------------------------------------------------------------------------------------------------


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'O' GROUP BY 1 ORDER BY 2 DESC LIMIT 10""")
def workflow_revenue(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", (C("l_extendedprice") * (1 - C("l_discount"))).alias("revenue"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = joins.merge(joins.merge(joins.merge(li, o, left_on="l_orderkey", right_on="o_orderkey"), c, left_on="o_custkey", right_on="c_custkey"), n, left_on="c_nationkey", right_on="n_nationkey")
    g = joined.groupBy("n_name").agg(r(F.sum("revenue"), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))
    return ordering.sort(g, "revenue", False, ["n_name"]).limit(10)


# -- whole frames ---------------------------------------------------------------------------------------------------------


@query("SELECT count(DISTINCT user_id) AS user_id, count(DISTINCT event_type) AS event_type, count(DISTINCT n) AS n FROM " + EVENTS)
def nunique_all(spark, sf_dir):
    return aggregate.aggregate(events(spark, sf_dir).select("user_id", "event_type", "n"), "nunique")


@query("SELECT sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END)::BIGINT AS value, sum(CASE WHEN n IS NULL THEN 1 ELSE 0 END)::BIGINT AS n FROM " + EVENTS)
def isna_cells(spark, sf_dir):
    return aggregate.aggregate(Frame(events(spark, sf_dir).select("value", "n")).isna().astype("int64").df, "sum")


@query("SELECT event_id, n * 2 + 1 AS n, round(value * 2 + 1, 6) AS value FROM " + EVENTS)
def frame_arithmetic(spark, sf_dir):
    f = Frame(events(spark, sf_dir).select("event_id", "n", "value"), "event_id")
    return rounded((f * 2 + 1).df, ["value"], 6)


@query(f"SELECT event_id, a.n + b.n AS n, round(a.value + b.value, 6) AS value FROM {EVENTS} a JOIN {EVENTS} b USING (event_id)")
def frame_plus_frame(spark, sf_dir):
    f = Frame(events(spark, sf_dir).select("event_id", "n", "value"), "event_id")
    return rounded((f + f).df, ["value"], 6)


@query("SELECT event_id, n >= 4 AS n, value >= 4 AS value FROM " + EVENTS)
def frame_compare(spark, sf_dir):
    return Frame(events(spark, sf_dir).select("event_id", "n", "value"), "event_id").ge(4).df


@query("SELECT event_id, coalesce(n, 7) AS n, coalesce(value, 0.5) AS value FROM " + EVENTS)
def fillna_dict(spark, sf_dir):
    return Frame(events(spark, sf_dir)).fillna({"n": 7, "value": 0.5, "unknown": 1})[["event_id", "n", "value"]].df


@query("SELECT event_id, CAST(n AS VARCHAR) AS n, CAST(user_id AS DOUBLE) AS user_id FROM " + EVENTS)
def astype_dict(spark, sf_dir):
    return Frame(events(spark, sf_dir)).astype({"n": "str", "user_id": float})[["event_id", "n", "user_id"]].df


@query(" UNION ALL ".join(f"SELECT '{f}' AS stat, CAST({f}(n) AS DOUBLE) AS n, CAST({f}(user_id) AS DOUBLE) AS user_id FROM {EVENTS}" for f in ("sum", "min", "max")))
def agg_list(spark, sf_dir):
    return Frame(events(spark, sf_dir).select("n", "user_id")).agg(["sum", "min", "max"]).df


@query(f"SELECT round(corr(a.value, b.value + a.n), 6) AS corr FROM {EVENTS} a JOIN {EVENTS} b USING (event_id)")
def corr_columns(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("other", C("value") + C("n"))
    return rounded(aggregate.covariance(e, "value", "other", "corr"), ["corr"], 6)


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (1, 5)")
def drop_places(spark, sf_dir):
    return select.drop_places(table(spark, sf_dir, "nation"), ["n_nationkey"], [1, 5]).select("n_nationkey", "n_name")


@query("SELECT event_id, coalesce(n IN (1, 2), false) AS n, event_type IN ('click') AS event_type FROM (SELECT event_id, n, event_type FROM " + EVENTS + ")")
def isin_dict(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", "n", "event_type")
    return e.select("event_id", S.is_in(C("n"), INT, [1, 2]).alias("n"), S.is_in(C("event_type"), "object", ["click"]).alias("event_type"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS count FROM lineitem GROUP BY 1, 2")
def value_counts_frame(spark, sf_dir):
    return ordering.value_counts(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(spark, sf_dir):
    path = scratch(spark, "customer-csv")
    csv.write_csv(table(spark, sf_dir, "customer"), path)
    return select.assign(csv.read_csv(spark, path), c_nationkey=C("c_nationkey").cast("int"))


@query("SELECT p_partkey, NULL::DOUBLE AS a, CAST(p_size AS BIGINT) AS p_size FROM part")
def csv_missing_values(spark, sf_dir):
    path = scratch(spark, "part-csv")
    csv.write_csv(table(spark, sf_dir, "part").select("p_partkey", F.lit(None).cast("double").alias("a"), "p_size"), path, delimiter=";", na_rep="NA")
    return csv.read_csv(spark, path, delimiter=";", dtypes={"a": "float64"})
