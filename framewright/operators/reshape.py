"""Concatenation and reshaping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.operators.aggregate import expression
from framewright.operators.grouping import aggregate
from framewright.types import FLOAT, INT, SPARK, as_list, column, kind, kind_of, kinds, require


def concat(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL by name, columns in the order first seen, missing ones null. Integers meet fractions as fractions; other
    mixes take the kind of the frame that has the column first."""
    if not frames:
        raise ValueError("nothing to concatenate")
    target: dict[str, T.DataType] = {}
    for f in frames:
        for x in f.schema.fields:
            if x.name not in target:
                target[x.name] = x.dataType
            elif {kind_of(target[x.name]), kind_of(x.dataType)} == {INT, FLOAT}:
                target[x.name] = SPARK[FLOAT]
    fit = lambda f: f.select(*[column(c).cast(t).alias(c) if c in f.columns and f.schema[c].dataType != t else column(c) if c in f.columns else F.lit(None).cast(t).alias(c) for c, t in target.items()])
    return reduce(DataFrame.union, map(fit, frames))


def common_type(df: DataFrame, names: list[str]) -> str:
    found = {kind(df, c) for c in names}
    if found <= {INT, FLOAT}:
        return FLOAT if FLOAT in found else INT
    if len(found) > 1:
        raise TypeError(f"columns of different dtypes: {sorted(found)}")
    return found.pop()


def melt(df: DataFrame, id_vars=None, value_vars=None, var_name: str = "variable", value_name: str = "value") -> DataFrame:
    ids = as_list(id_vars)
    values = as_list(value_vars) or [c for c in df.columns if c not in ids]
    require(df, [*ids, *values])
    to = SPARK[common_type(df, values)]
    return df.select(*map(column, ids), *[column(c).cast(to).alias(c) for c in values]).unpivot(ids, values, var_name, value_name)


def stack(df: DataFrame, order: list[str], name: str = "0") -> DataFrame:
    """All values row by row, left to right: order keys, place in the row, value."""
    values = [c for c in df.columns if c not in order]
    to = SPARK[common_type(df, values)]
    return df.select(*map(column, order), F.posexplode(F.array(*[column(c).cast(to) for c in values])).alias("place", name))


def pivot_table(df: DataFrame, values=None, index=None, columns: str | None = None, aggfunc: str = "mean", column_values: list | None = None) -> DataFrame:
    """Grouped by index; with `columns`, one column for each of its values (given, or found by a pass of their own)."""
    index, values = as_list(index), as_list(values)
    if columns is None:
        return aggregate(df, index, aggfunc, values or None)
    own = kinds(df)
    for k in index:
        df = df.where(column(k).isNotNull())
    grouped = df.groupBy(*map(column, index)).pivot(columns, column_values) if column_values else df.groupBy(*map(column, index)).pivot(columns)
    return grouped.agg(*[expression(aggfunc, column(c), own[c]).alias(c) for c in values])


def transpose(df: DataFrame, order: list[str], most: int = 10_000) -> DataFrame:
    """Rows become columns "0", "1", ... in the given order; `column` holds the old names. For small frames: ValueError above `most` rows."""
    values = [c for c in df.columns if c not in order]
    to = SPARK[common_type(df, values)]
    n = df.count()
    if n > most:
        raise ValueError(f"{n} rows would become columns; at most {most}")
    long = melt(df.select(*map(column, order), *[column(c).cast(to).alias(c) for c in values]), order, values)
    place = {c: i for i, c in enumerate(values)}
    rows = long.groupBy("variable").agg(F.sort_array(F.collect_list(F.struct(*map(column, order), F.col("value").alias("\0v")))).alias("r"))
    at = F.create_map(*[x for c, i in place.items() for x in (F.lit(c), F.lit(i))])
    return rows.select("variable", at[F.col("variable")].alias("\0at"), *[F.get(F.col("r"), F.lit(i))["\0v"].alias(str(i)) for i in range(n)]).orderBy("`\0at`").drop("\0at").withColumnRenamed("variable", "column")


def explode(df: DataFrame, name: str) -> DataFrame:
    """A row for each element of a list; an empty list gives no row, a null one gives a null."""
    require(df, [name])
    t = df.schema[name].dataType
    if not isinstance(t, T.ArrayType):
        return df
    kept: Column = F.coalesce(column(name), F.array(F.lit(None).cast(t.elementType)))
    return df.withColumn(name, F.explode(kept))
