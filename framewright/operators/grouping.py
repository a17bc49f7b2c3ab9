"""Grouped aggregation, transformation, filtering and application. Rows with a null in any key are left out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.operators.aggregate import TAKES, expression
from framewright.types import as_list, column, kinds, require


def _keyed(df: DataFrame, by: list[str]) -> DataFrame:
    require(df, by)
    for k in by:
        df = df.where(column(k).isNotNull())
    return df


def aggregate(df: DataFrame, by: str | list[str], func: str, columns: list[str] | None = None, keep_keys: bool = True, **options) -> DataFrame:
    """Keys, then the function of each column that takes it under the column's own name."""
    by, own = as_list(by), kinds(df)
    require(df, columns or [])
    used = [c for c in (columns or df.columns) if c not in by and own[c] in TAKES[func]]
    out = _keyed(df, by).groupBy(*map(column, by)).agg(*[expression(func, column(c), own[c], **options).alias(c) for c in used]) if used else _keyed(df, by).select(*map(column, by)).distinct()
    return out if keep_keys else out.drop(*by)


def size(df: DataFrame, by: str | list[str], name: str | None = None) -> DataFrame:
    """The number of rows of each group, in every other column, or in one column `name`."""
    by = as_list(by)
    names = [name] if name else [c for c in df.columns if c not in by]
    counted = _keyed(df, by).groupBy(*map(column, by)).agg(F.count(F.lit(1)).alias("\0n"))
    return counted.select(*map(column, by), *[F.col("`\0n`").alias(c) for c in names])


def several(df: DataFrame, by: str | list[str], spec: dict[str, str | list[str]], order: list[Column] | None = None, keep_keys: bool = True) -> DataFrame:
    """A function for each listed column, under the column's name; of a list, each as `column_function`. One shuffle for all."""
    by, own = as_list(by), kinds(df)
    require(df, spec)
    exprs = [expression(f, column(c), own[c], order=order).alias(c if isinstance(fs, str) else f"{c}_{f}") for c, fs in spec.items() for f in as_list(fs)]
    out = _keyed(df, by).groupBy(*map(column, by)).agg(*exprs)
    return out if keep_keys else out.drop(*by)


def transform(df: DataFrame, by: str | list[str], func: str, columns: list[str] | None = None, order: list[Column] | None = None) -> DataFrame:
    """The group's aggregate on every row in place of the value; null where a key is null. All other columns stay.

    Aggregates before it joins, so that a hot group is not gathered in one task.
    """
    by, own = as_list(by), kinds(df)
    used = columns or [c for c in df.columns if c not in by]
    for c in used:
        if own[c] not in TAKES[func]:
            raise KeyError(c)
    sums = _keyed(df, by).groupBy(*map(column, by)).agg(*[expression(func, column(c), own[c], order=order).alias(f"\0{c}") for c in used])
    joined = df.join(sums, by, "left")
    return joined.select(*[column(f"\0{c}").alias(c) if c in used else column(c) for c in df.columns])


def keep_groups(df: DataFrame, by: str | list[str], condition: Column) -> DataFrame:
    """All rows of the groups for which an aggregate condition holds, such as F.count("*") > 2."""
    by = as_list(by)
    passing = _keyed(df, by).groupBy(*map(column, by)).agg(condition.alias("\0ok")).where(F.col("`\0ok`")).drop("\0ok")
    return df.join(passing, by, "left_semi")


def filter_python(df: DataFrame, by: str | list[str], predicate: Callable) -> DataFrame:
    """All rows of the groups for which predicate(pandas frame) holds. A group is one task's: for aggregates use keep_groups."""
    by = as_list(by)
    return _keyed(df, by).groupBy(*map(column, by)).applyInPandas(lambda g: g if predicate(g) else g.iloc[:0], df.schema)


def apply_python(df: DataFrame, by: str | list[str], func: Callable, schema: str) -> DataFrame:
    """func(pandas frame) -> pandas frame of `schema`, group by group."""
    by = as_list(by)
    return _keyed(df, by).groupBy(*map(column, by)).applyInPandas(func, schema)


def count_groups(df: DataFrame, by: str | list[str]) -> DataFrame:
    by = as_list(by)
    return _keyed(df, by).select(*map(column, by)).distinct().agg(F.count(F.lit(1)).alias("groups"))


def numbered(df: DataFrame, by: list[str], order: list[Column], name: str = "row") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*map(column, by)).orderBy(*order)))
