"""Sorting, top-k, distinct and duplicates. Order is never implied: operators that depend on it take an order key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.operators import windows
from framewright.session import scratch
from framewright.types import FLOAT, as_list, column, kind, require


def sort_keys(df: DataFrame, by: list[str], ascending: list[bool] | bool = True) -> list[Column]:
    """Nulls last in both directions; a single fraction key puts NaN after all values in both."""
    require(df, by)
    flags = [ascending] * len(by) if isinstance(ascending, bool) else [*ascending, *[True] * len(by)][: len(by)]
    out = []
    for c, up in zip(by, flags, strict=True):
        if not up and len(by) == 1 and kind(df, c) == FLOAT:
            out += [column(c).isNull().asc(), F.isnan(column(c)).asc()]
        out.append(column(c).asc_nulls_last() if up else column(c).desc_nulls_last())
    return out


def sort(df: DataFrame, by: str | list[str], ascending: list[bool] | bool = True, order: list[str] | None = None) -> DataFrame:
    """Sorted by the keys; ties by `order`, backwards for a single descending key."""
    by = as_list(by)
    if not by:
        return df
    down = len(by) == 1 and (ascending is False or ascending == [False])
    ties = [column(c).desc() if down else column(c).asc() for c in order or []]
    return df.orderBy(*sort_keys(df, by, ascending), *ties)


def positions(df: DataFrame, by: str | list[str], ascending: list[bool] | bool = True, order: list[str] | None = None, name: str = "position") -> DataFrame:
    """All rows with their places in the sort, from 1. The sorted rows are written once; only rows a partition are summed in one place."""
    path = scratch(df.sparkSession, "positions")
    sort(df, by, ascending, order).withColumn("\0id", F.monotonically_increasing_id()).write.parquet(path)
    # the id is the number of the partition and, in the lower 33 bits, that of the row in it
    rows = df.sparkSession.read.parquet(path).withColumn("\0p", F.shiftright("\0id", 33))
    before = Window.orderBy("\0p").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("\0p").agg(F.count(F.lit(1)).alias("\0n")).select("\0p", F.coalesce(F.sum("\0n").over(before), F.lit(0)).alias("\0before"))
    within = F.col("\0id").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(counts, "\0p").withColumn(name, F.col("\0before") + within + 1).drop("\0id", "\0p", "\0before")


def largest(df: DataFrame, n: int, by: str, order: list[str]) -> DataFrame:
    """The n greatest; of equal values the last by `order` first."""
    return sort(df, by, False, order).limit(n)


def smallest(df: DataFrame, n: int, by: str, order: list[str]) -> DataFrame:
    return sort(df, by, True, order).limit(n)


def head(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first n rows by `order`; a negative n leaves the last -n out, by the rows' places."""
    if n >= 0:
        return df.orderBy(*[column(c).asc() for c in order]).limit(n)
    rows, many = windows.placed(df, [column(c).asc() for c in order], "\0from")
    return rows.where(F.col("`\0from`") < many + n).drop("\0from")


def tail(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The last n rows by `order`; a negative n leaves the first -n out, by the rows' places."""
    if n >= 0:
        return df.orderBy(*[column(c).desc() for c in order]).limit(n)
    rows, _ = windows.placed(df, [column(c).asc() for c in order], "\0from")
    return rows.where(F.col("`\0from`") >= -n).drop("\0from")


def sample(df: DataFrame, n: int | None = None, frac: float | None = None, seed: int | None = None) -> DataFrame:
    """Exactly min(n, rows) rows (frac: that share, rounded down; 1 by default), without replacement."""
    n = int(df.count() * frac) if frac is not None else 1 if n is None else n
    return df.orderBy(F.rand(seed)).limit(n)


def duplicated(df: DataFrame, subset: list[str] | None = None, keep: str | bool = "first", order: list[str] | None = None, name: str = "duplicated") -> DataFrame:
    """A column that is true for rows that repeat another's subset; nulls are equal."""
    return df.withColumn(name, repeats(df, subset, keep, order))


def repeats(df: DataFrame, subset: list[str] | None = None, keep: str | bool = "first", order: list[str] | None = None) -> Column:
    keys = as_list(subset) or df.columns
    require(df, keys)
    w = Window.partitionBy(*map(column, keys))
    if keep is False:
        return F.count(F.lit(1)).over(w) > 1
    if keep not in ("first", "last"):
        raise ValueError(f"keep: {keep!r}")
    by = [column(c).asc() if keep == "first" else column(c).desc() for c in order or df.columns]
    return F.row_number().over(w.orderBy(*by)) > 1


def drop_duplicates(df: DataFrame, subset: list[str] | None = None, keep: str | bool = "first", order: list[str] | None = None) -> DataFrame:
    """One row of those with equal subset, or none of them. Reduced before the shuffle: a hot key sends one row per task."""
    keys = as_list(subset) or df.columns
    require(df, keys)
    if set(keys) == set(df.columns) and keep is not False:
        return df.distinct()
    whole = F.struct(*[column(c).alias(f"c{i}") for i, c in enumerate(df.columns)])
    groups = df.groupBy(*[column(c).alias(f"\0{c}") for c in keys])
    if keep is False:
        one = groups.agg(F.count(F.lit(1)).alias("n"), F.first(whole).alias("r")).where("n = 1")
    else:
        key = F.struct(*[column(c).alias(f"k{i}") for i, c in enumerate(order or df.columns)])
        one = groups.agg((F.min_by if keep == "first" else F.max_by)(whole, key).alias("r"))
    return one.select(*[F.col(f"r.c{i}").alias(c) for i, c in enumerate(df.columns)])


def unique(df: DataFrame, name: str) -> DataFrame:
    return df.select(column(name)).distinct()


def value_counts(df: DataFrame, subset: str | list[str], normalize: bool = False, dropna: bool = True, sort: bool = True, ascending: bool = False) -> DataFrame:
    """Each value (or tuple) with its count, or its share of all that are counted."""
    keys = as_list(subset)
    if dropna:
        df = df.dropna(subset=keys, how="any") if not any(isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)) for c in keys) else df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in keys))
    counts = df.groupBy(*map(column, keys)).agg(F.count(F.lit(1)).alias("count"))
    if normalize:
        total = F.broadcast(counts.agg(F.sum("count").alias("\0all")))  # one row
        counts = counts.join(total, F.lit(True)).withColumn("count", F.col("count") / F.col("`\0all`")).drop("\0all")
    return counts.orderBy(F.col("count").asc() if ascending else F.col("count").desc(), *map(column, keys)) if sort else counts


def monotonic(df: DataFrame, name: str, order: list[str], increasing: bool = True, partition_by: list[str] | None = None) -> DataFrame:
    """Whether values never fall (or rise) in the given order; any null gives False."""
    v = column(name)
    before = F.lag(v).over(Window.partitionBy(*map(column, partition_by or [])).orderBy(*map(column, order)))
    fine = v.isNotNull() & (before.isNull() | ((v >= before) if increasing else (v <= before)))
    return df.select(fine.alias("ok")).agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("monotonic"))


def differences(a: DataFrame, b: DataFrame, order: list[str] | None = None, of: tuple[list[Column], list[Column]] | None = None) -> DataFrame:
    """The number of rows that one frame has more often than the other (the larger of the two); null equals null, NaN equals NaN. 0: equal.

    Whole rows are counted, so an order that rows repeat, or that is null, does no harm; `order` is part of them. of: what makes the
    rows of each frame, in place of all columns.

    The rows of both are dealt by their hashes into parts of about ROWS of each before they are counted, so that no task counts more
    of them as the frames grow. They are dealt as they come: what a frame's rows were dealt by before is left out by Spark. Copies of
    a row meet in one part, as one number.
    """
    if of is None and a.columns != b.columns:
        return a.sparkSession.createDataFrame([(1,)], "differences long")
    of = of or ([column(c) for c in a.columns], [column(c) for c in b.columns])
    types = [f.dataType for f in a.select(*of[0]).unionAll(b.select(*of[1])).schema.fields]
    parts = (a.count() + b.count()) // (2 * windows.ROWS) + 1

    def dealt(df: DataFrame, cells: list[Column], sign: int) -> DataFrame:
        own = [f.dataType for f in df.select(*cells).schema.fields]
        cells = [c if t == to else c.cast(to) for c, t, to in zip(cells, own, types, strict=True)]
        # types without hashes, or whose equal values have different ones, take no part in the dealing
        hashed = [c for c, t in zip(cells, types, strict=True) if not any(x in t.simpleString() for x in ("map<", "variant", " collate "))]
        part = F.xxhash64(*hashed) if hashed else F.lit(0).cast("long")
        # rows as structs: only by the hash can Spark tell that both are dealt alike, and it deals the union no more
        return df.repartition(parts, part).select(part.alias("part"), F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cells)]).alias("row"), F.lit(sign).alias("sign"))

    counts = dealt(a, of[0], 1).unionAll(dealt(b, of[1], -1)).groupBy("part", "row").agg(F.sum("sign").alias("d"))
    more = [F.coalesce(F.sum(F.greatest(F.lit(sign) * F.col("d"), F.lit(0))), F.lit(0)) for sign in (1, -1)]
    return counts.agg(F.greatest(*more).cast("long").alias("differences"))
