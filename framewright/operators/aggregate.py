"""Whole-frame aggregates: every function is one lazy aggregation over all its columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions.scalar import no_nan, truthy
from framewright.types import BOOL, FLOAT, INT, SPARK, TEXT, as_list, column, kind, kinds, numeric, require

#: Kinds of columns that a function takes; others are left out.
TAKES = {
    "sum": (INT, FLOAT), "mean": (INT, FLOAT), "std": (INT, FLOAT), "var": (INT, FLOAT), "median": (INT, FLOAT), "prod": (INT, FLOAT), "sem": (INT, FLOAT),
    "quantile": (INT, FLOAT), "min": (INT, FLOAT, TEXT), "max": (INT, FLOAT, TEXT), "count": (BOOL, INT, FLOAT, TEXT), "nunique": (BOOL, INT, FLOAT, TEXT),
    "first": (BOOL, INT, FLOAT, TEXT), "last": (BOOL, INT, FLOAT, TEXT),
}


def expression(func: str, c: Column, of: str, ddof: int = 1, q: float = 0.5, order: list[Column] | None = None) -> Column:
    """The aggregate of a column. Nulls are skipped, all null gives null; sum and mean carry NaN, the others leave it out."""
    clean = no_nan(c, of)
    if func == "sum":
        return F.sum(c.cast("long") if of == BOOL else c)
    if func == "mean":
        return F.avg(c)
    if func in ("min", "max"):
        return getattr(F, func)(clean)
    if func == "count":
        return F.count(c)
    if func == "var":
        return F.var_samp(clean) if ddof == 1 else F.var_pop(clean)
    if func == "std":
        return F.stddev_samp(clean) if ddof == 1 else F.stddev_pop(clean)
    if func == "median":
        return F.median(clean)
    if func == "quantile":
        if not 0 <= q <= 1:
            raise ValueError(f"quantile {q}")
        return F.percentile(clean, F.lit(q))
    if func == "prod":
        return F.product(c).cast(SPARK[of])
    if func == "sem":
        return F.stddev_samp(clean) / F.sqrt(F.count(c))
    if func == "nunique":
        return F.count_distinct(c)
    if func in ("first", "last"):
        if not order:
            raise ValueError(f"{func} needs an order")
        key = F.when(c.isNotNull(), F.struct(*order))  # a null key is never the least or greatest
        return (F.min_by if func == "first" else F.max_by)(c, key)
    raise ValueError(f"unknown function {func!r}")


def aggregate(df: DataFrame, func: str, columns: list[str] | None = None, **options) -> DataFrame:
    """One row with the function of each column that takes it; integer products of no values are 1."""
    own = kinds(df)
    require(df, columns or [])
    used = [c for c in columns or df.columns if own[c] in TAKES[func]]
    one = {c: expression(func, column(c), own[c], **options) for c in used}
    if func == "prod":
        one = {c: F.coalesce(e, F.lit(1).cast(SPARK[own[c]])) for c, e in one.items()}
    return df.agg(*[e.alias(c) for c, e in one.items()]) if one else df.sparkSession.range(1).select()


def across(df: DataFrame, func: str, name: str = "0") -> DataFrame:
    """One value for each row, over its numeric columns (axis=1); a row without values gives null."""
    used = numeric(df)
    cols = [column(c) for c in used]
    if not cols:
        return df.select(F.lit(None).cast("double").alias(name))
    clean = [no_nan(column(c), kind(df, c)) for c in used]
    count = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), 1).otherwise(0) for c in cols])
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in cols])
    none = F.lit(None)
    values = F.filter(F.array(*[c.cast("double") for c in clean]), lambda x: x.isNotNull())
    mean = F.when(count > 0, total.cast("double") / F.when(count > 0, count))
    if func == "sum":
        out = F.when(count > 0, total).otherwise(none)
    elif func == "mean":
        out = mean
    elif func in ("min", "max"):
        pick = F.least if func == "min" else F.greatest
        out = pick(*clean) if len(clean) > 1 else clean[0]
    elif func == "prod":
        out = F.when(count > 0, reduce(lambda a, b: a * b, [F.coalesce(c, F.lit(1)) for c in cols])).otherwise(none)
    elif func in ("var", "std"):
        n = F.size(values)
        centre = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.when(n > 0, n)
        var = F.when(n == 0, none).when(n == 1, F.lit(0.0)).otherwise(F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - centre) * (x - centre)) / F.when(n > 1, n - 1))
        out = F.sqrt(var) if func == "std" else var
    elif func == "median":
        ordered, n = F.array_sort(values), F.size(values)
        out = F.when(n > 0, (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2)
    else:
        raise ValueError(f"unknown function {func!r}")
    return df.select(out.alias(name))


def any_all(df: DataFrame, which: str, axis: int = 0) -> DataFrame:
    """any or all of the values' truth: null is left out, no values give False for any and True for all."""
    own = kinds(df)
    if axis == 1:
        fold = (lambda a, b: a | b) if which == "any" else (lambda a, b: a & b)
        parts = [truthy(column(c), k) if which == "any" else truthy(column(c), k) | column(c).isNull() for c, k in own.items()]
        return df.select(reduce(fold, parts).alias("0"))
    f, empty = (F.bool_or, False) if which == "any" else (F.bool_and, True)
    return df.agg(*[F.coalesce(f(F.when(column(c).isNotNull(), truthy(column(c), k))), F.lit(empty)).alias(c) for c, k in own.items()])


def describe(df: DataFrame) -> DataFrame:
    """Five rows (stat: count, mean, std, min, max) of the numeric columns, in one pass."""
    used, stats = numeric(df), ("count", "mean", "std", "min", "max")
    one = df.agg(*[expression(s, column(c), kind(df, c)).cast("double").alias(f"{c}\0{s}") for c in used for s in stats])
    rows = F.array(*[F.struct(F.lit(s).alias("stat"), *[column(f"{c}\0{s}").alias(c) for c in used]) for s in stats])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def describe_column(df: DataFrame, name: str) -> DataFrame:
    """count, mean, std, min, 25%, 50%, 75%, max of a numeric column; count and unique of another."""
    of, c = kind(df, name), column(name)
    if of not in (INT, FLOAT):
        return df.agg(F.count(c).alias("count"), F.count_distinct(c).alias("unique"))
    clean = no_nan(c, of)
    quarters = {f"{round(100 * q)}%": F.percentile(clean, F.lit(q)) for q in (0.25, 0.5, 0.75)}
    return df.agg(*[expression(s, c, of).cast("double").alias(s) for s in ("count", "mean", "std", "min")], *[e.alias(k) for k, e in quarters.items()], expression("max", c, of).cast("double").alias("max"))


def _pair(a: Column, b: Column, which: str) -> Column:
    if which == "cov":
        return F.covar_samp(a, b)
    seen = a.isNotNull() & b.isNotNull()
    x, y = F.when(seen, a), F.when(seen, b)
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(x) * F.stddev_samp(y))


def matrix(df: DataFrame, which: str) -> DataFrame:
    """cov or corr of every two numeric columns, over rows where both are there: `column`, then one column each, from one pass."""
    used = numeric(df)
    pairs = {(a, b): F.coalesce(_pair(column(a).cast("double"), column(b).cast("double"), which), F.lit(float("nan")) if which == "corr" else F.lit(0.0)) for i, a in enumerate(used) for b in used[i:]}
    one = df.agg(*[e.alias(f"{a}\0{b}") for (a, b), e in pairs.items()])
    cell = lambda a, b: column(f"{a}\0{b}" if (a, b) in pairs else f"{b}\0{a}").alias(b)
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("column"), *[cell(a, b) for b in used]) for a in used])).alias("r")).select("r.*")


def covariance(df: DataFrame, a: str, b: str, which: str = "cov") -> DataFrame:
    return df.agg(_pair(column(a).cast("double"), column(b).cast("double"), which).alias(which))


def mode(df: DataFrame, name: str) -> DataFrame:
    """All most frequent values that aren't null, ascending; counted before the comparison, which sees distinct values only."""
    counts = df.where(column(name).isNotNull()).groupBy(column(name).alias(name)).agg(F.count(F.lit(1)).alias("\0n"))
    top = F.broadcast(counts.agg(F.max("`\0n`").alias("\0top")))  # one row
    return counts.join(top, F.col("`\0n`") == F.col("`\0top`")).select(column(name)).orderBy(column(name))


def extreme_place(df: DataFrame, name: str, order: list[Column], which: str = "max") -> DataFrame:
    """Row with the greatest (or least) value, the first of equal ones, and its place by `order`: value and idx.

    The place is the number of rows before it, counted in one aggregation, so no global window is needed.
    """
    c = no_nan(column(name), kind(df, name))
    key = F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)])
    best = df.where(c.isNotNull()).orderBy(c.desc() if which == "max" else c.asc(), *[o.asc() for o in order]).limit(1).select(c.alias("value"), key.alias("key"))
    return df.select(key.alias("own")).join(F.broadcast(best), F.col("own") < F.col("key"), "right").groupBy("value").agg(F.count("own").alias("idx"))


def is_unique(df: DataFrame, name: str) -> DataFrame:
    return df.agg((F.count(F.lit(1)) == F.count_distinct(column(name)) + F.max(column(name).isNull().cast("int"))).alias("is_unique"))


def several(df: DataFrame, spec: dict[str, list[str] | str], order: list[Column] | None = None) -> DataFrame:
    """One row: `column_function` for every listed function of every column, in one aggregation."""
    require(df, spec)
    return df.agg(*[expression(f, column(c), kind(df, c), order=order).alias(f"{c}_{f}") for c, fs in spec.items() for f in as_list(fs)])
