"""Ordered analytics. The columns take an order key and, at scale, partition keys: without them all rows are one partition.

Over whole tables, `placed` numbers the rows, and `near` and `running` compute in blocks of ROWS places, of which each gets what it
needs of the others: the rows beside it, or one row of totals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.functions.scalar import no_nan
from framewright.session import scratch
from framewright.types import FLOAT, INT, TEXT, as_list, column, kind

#: Tables of no more rows are one partition; greater ones are dealt into parts of about as many.
ROWS = 1 << 18
BLOCK = "\0block"


def _window(order, partition_by=None):
    keys = [order] if isinstance(order, Column) else [column(c) if isinstance(c, str) else c for c in as_list(order)]
    return Window.partitionBy(*[column(c) for c in as_list(partition_by)]).orderBy(*keys)


def cumulative(df: DataFrame, func: str, name: str, order, partition_by=None) -> Column:
    """sum, prod, max or min so far; null where the value is null, which doesn't stop it."""
    c, of = column(name), kind(df, name)
    if func in ("sum", "prod") and of not in (INT, FLOAT):
        raise TypeError(f"cum{func} of {of}")
    own = {"sum": F.sum(c), "prod": F.product(c), "max": F.max(no_nan(c, of)), "min": F.min(c)}[func]
    out = own.over(_window(order, partition_by).rowsBetween(Window.unboundedPreceding, 0))
    return F.when(c.isNotNull(), out.cast("long") if func == "prod" and of == INT else out)


def shift(name: str, order, periods: int = 1, fill=None, partition_by=None) -> Column:
    w = _window(order, partition_by)
    return F.lag(column(name), periods, fill).over(w) if periods >= 0 else F.lead(column(name), -periods, fill).over(w)


def diff(df: DataFrame, name: str, order, periods: int = 1, partition_by=None) -> Column:
    """v[i] - v[i - p]; for a negative p, v[i + |p|] - v[i]."""
    if kind(df, name) not in (INT, FLOAT):
        raise TypeError(f"diff of {kind(df, name)}")
    other = shift(name, order, periods, None, partition_by)
    return column(name) - other if periods >= 0 else other - column(name)


def pct_change(name: str, order, periods: int = 1, partition_by=None) -> Column:
    """(v - before) / before; null where either is null or before is 0."""
    before = shift(name, order, periods, None, partition_by)
    return F.try_divide((column(name) - before).cast("double"), before.cast("double"))


def rank(df: DataFrame, name: str, method: str = "average", ascending: bool = True, order=None, partition_by=None) -> Column:
    """1-based ranks as fractions; null has none. average, min, max, first (ties by `order`) or dense."""
    c, of = column(name), kind(df, name)
    if of == TEXT:
        raise TypeError("rank of texts")
    by = c.asc_nulls_last() if ascending else c.desc_nulls_last()
    w = _window(by, partition_by)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*[column(p) for p in as_list(partition_by)], c))
    if method == "average":
        out = F.rank().over(w) + (ties - 1) / F.lit(2)
    elif method == "min":
        out = F.rank().over(w)
    elif method == "max":
        out = F.rank().over(w) + ties - 1
    elif method == "first":
        out = F.row_number().over(_window([by, *[column(o) for o in as_list(order)]], partition_by))
    elif method == "dense":
        out = F.dense_rank().over(w)
    else:
        raise ValueError(f"method: {method!r}")
    return F.when(c.isNotNull(), out.cast("double"))


def _statistic(func: str, c: Column, of: str) -> Column:
    return {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_samp, "count": F.count}[func](no_nan(c, of) if func in ("min", "max") else c)


def rolling(df: DataFrame, func: str, name: str, window: int, order, partition_by=None) -> Column:
    """Over the last `window` rows' values that aren't null; null in the first window - 1 rows. count is a fraction."""
    c, w = column(name), _window(order, partition_by)
    out = _statistic(func, c, kind(df, name)).over(w.rowsBetween(1 - window, 0))
    return F.when(F.row_number().over(w) >= window, out.cast("double") if func == "count" else out)


def expanding(df: DataFrame, func: str, name: str, order, partition_by=None) -> Column:
    """Over all rows so far; a value on every row, and the sum starts at 0."""
    own = kind(df, name)
    out = _statistic(func, column(name), own).over(_window(order, partition_by).rowsBetween(Window.unboundedPreceding, 0))
    return F.coalesce(out, F.lit(0).cast("long" if own == INT else "double")) if func == "sum" else out


def position(order, partition_by=None) -> Column:
    """0-based place of a row."""
    return F.row_number().over(_window(order, partition_by)) - 1


# -- over whole tables ------------------------------------------------------------------------------------------------------


def placed(df: DataFrame, keys: list[Column], name: str) -> tuple[DataFrame, int]:
    """With the 0-based place of each row by the keys, and the number of rows. Equal keys may come in any order.

    More than ROWS rows are sorted in ranges (rows of equal keys are told apart, so they share no range) and written once; places
    are counted from the rows of each range.
    """
    n = df.count()
    if n <= ROWS:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*keys)) - 1), n
    spark, path = df.sparkSession, scratch(df.sparkSession, "placed")
    own = [f"c{i}" for i in range(len(df.columns))]
    void = {c for c, f in zip(own, df.schema.fields, strict=True) if isinstance(f.dataType, T.NullType)}  # files have no such type
    told = df.withColumn("\0tie", F.monotonically_increasing_id())
    dealt = told.repartitionByRange(n // ROWS + 1, *keys, F.col("`\0tie`")).sortWithinPartitions(*keys, F.col("`\0tie`"))
    cells = [(column(c).cast("string") if k in void else column(c)).alias(k) for c, k in zip(df.columns, own, strict=True)]
    dealt.select(*cells, F.monotonically_increasing_id().alias("id")).write.parquet(path)
    rows = spark.read.parquet(path)
    # the id is the number of the range and, in the lower 33 bits, that of the row in it
    counts = dict(rows.groupBy(F.shiftright("id", 33).cast("int").alias("p")).agg(F.count(F.lit(1))).collect())
    before = [0]
    for p in range(max(counts)):
        before.append(before[-1] + counts.get(p, 0))
    at = F.element_at(F.lit(before).cast("array<bigint>"), F.shiftright("id", 33).cast("int") + 1) + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.select(*[(F.lit(None) if k in void else F.col(k)).alias(c) for c, k in zip(df.columns, own, strict=True)], at.alias(name)), n


def _dealt(df: DataFrame, block: Column, n: int) -> DataFrame:
    return df.withColumn(BLOCK, block).repartition(n // ROWS + 1, column(BLOCK))


def near(df: DataFrame, make: Callable[[str, str], Column], name: str, place: str, n: int, before: int = 0, after: int = 0) -> DataFrame:
    """With make(order, partition_by), which depends on the rows from `before` places back to `after` ahead. n: the rows of df."""
    at, size = column(place), max(ROWS, before, after)
    own = at - at % size
    blocks = [own]
    if before:
        blocks.append(F.when(at % size >= size - before, own + size))
    if after:
        blocks.append(F.when(at % size < after, own - size))
    dealt = _dealt(df, F.explode(F.array_compact(F.array(*blocks))) if len(blocks) > 1 else own, n)
    return dealt.withColumn(name, make(place, BLOCK)).where(column(BLOCK) == own).drop(BLOCK)


def running(df: DataFrame, func: str, value: Column, name: str, place: str, n: int) -> DataFrame:
    """With the sum, prod, max, min, count, mean or std of the values so far, null if there are none (count: 0). n: the rows of df.

    The totals of the blocks before are added to the block's own; of squares, as deviations from the mean of all.
    """
    at, x = column(place), value.cast("double") if func in ("mean", "std") else value
    fold = {"prod": F.product, "max": F.max, "min": F.min}.get(func, F.sum)
    parts = {"count": {"n": F.count(x)}, "mean": {"n": F.count(x), "s": F.sum(x)}, "std": {"n": F.count(x), "s": F.sum(x), "v": F.var_pop(x) * F.count(x)}}.get(func, {"s": fold(x)})
    so_far = Window.partitionBy(BLOCK).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    block = at - at % ROWS
    totals = df.groupBy(block.alias(BLOCK)).agg(*[p.alias(k) for k, p in parts.items()])
    if func == "std":
        center = F.sum("s").over(Window.partitionBy()) / F.sum("n").over(Window.partitionBy())
        totals = totals.withColumn("g", F.when(F.sum("n").over(Window.partitionBy()) > 0, center))
        off = F.when(F.col("n") > 0, F.col("v") + F.col("n") * (F.try_divide("s", "n") - F.col("g")) ** 2)
        totals = totals.select(BLOCK, F.sum("n").over(earlier).alias("\0n"), F.sum("s").over(earlier).alias("\0s"), F.sum(off).over(earlier).alias("\0o"), F.col("g").alias("\0g"))
    else:
        totals = totals.select(BLOCK, *[fold(k).over(earlier).alias(f"\0{k}") for k in parts])
    hidden = [c for c in totals.columns if c != BLOCK]
    dealt = _dealt(df, block, n)
    for k, p in parts.items():
        own = p.over(so_far) if k != "v" else F.var_pop(x).over(so_far) * F.count(x).over(so_far)
        dealt = dealt.withColumn(f"\0own{k}", own)
    dealt = dealt.join(F.broadcast(totals), BLOCK)  # a row for each block
    mine, theirs = (lambda k: column(f"\0own{k}")), (lambda k: column(f"\0{k}"))
    added = lambda k: F.coalesce(mine(k) + theirs(k), mine(k), theirs(k))
    if func == "count":
        out = added("n")
    elif func == "mean":
        out = F.try_divide(added("s"), added("n"))
    elif func == "prod":
        out = F.coalesce(mine("s") * theirs("s"), mine("s"), theirs("s"))
    elif func == "max":
        out = F.greatest(mine("s"), theirs("s"))
    elif func == "min":
        out = F.least(mine("s"), theirs("s"))
    elif func == "std":
        g, count = column("\0g"), added("n")
        off = F.when(mine("n") > 0, mine("v") + mine("n") * (F.try_divide(mine("s"), mine("n")) - g) ** 2)
        squares = F.coalesce(off + column("\0o"), off, column("\0o")) - count * (F.try_divide(added("s"), count) - g) ** 2
        out = F.when(count > 1, F.sqrt(F.when(squares < 0, F.lit(0.0)).otherwise(squares) / (count - 1)))
    else:
        out = added("s")
    return dealt.withColumn(name, out).drop(BLOCK, *hidden, *[f"\0own{k}" for k in parts])


def cumulative_whole(df: DataFrame, func: str, name: str, out: str, place: str, n: int) -> DataFrame:
    """`cumulative` of a whole table, as column `out`."""
    c, of = column(name), kind(df, name)
    if func in ("sum", "prod") and of not in (INT, FLOAT):
        raise TypeError(f"cum{func} of {of}")
    got = running(df, func, no_nan(c, of) if func == "max" else c, out, place, n)
    x = column(out)
    return got.withColumn(out, F.when(c.isNotNull(), x.cast("long") if func == "prod" and of == INT else x))


def expanding_whole(df: DataFrame, func: str, name: str, out: str, place: str, n: int) -> DataFrame:
    """`expanding` of a whole table, as column `out`."""
    c, own = column(name), kind(df, name)
    got = running(df, func, no_nan(c, own) if func in ("min", "max") else c, out, place, n)
    return got.withColumn(out, F.coalesce(column(out), F.lit(0).cast("long" if own == INT else "double"))) if func == "sum" else got
