"""User functions. Return types are declared; functions see None for null. Rows travel in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.types import SPARK, TEXT, column, kind_named


def _type(t):
    return SPARK[kind_named(t)] if isinstance(t, (str, type)) else t


def map_values(c: Column, func: Callable | dict, returns="object") -> Column:
    """func of each value; a dict looks the value up, and what it lacks becomes null (no Python runs then)."""
    if isinstance(func, dict):
        return F.try_element_at(F.create_map(*[F.lit(x) for kv in func.items() for x in kv]), c) if func else F.lit(None).cast(_type(returns))

    @F.pandas_udf(_type(returns))
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([func(None if v is None or v is pd.NA else v) for v in s.astype(object).where(s.notna(), None)], dtype=object)

    return run(c)


def map_rows(df: DataFrame, func: Callable[[dict], object], returns=TEXT, name: str = "0") -> DataFrame:
    """func(row as dict) -> value, as a single column."""
    plain = F.udf(lambda r: func(r.asDict()), _type(returns), useArrow=True)
    return df.select(plain(F.struct(*map(column, df.columns))).alias(name))


def map_cells(df: DataFrame, func: Callable, returns=TEXT) -> DataFrame:
    return df.select(*[map_values(column(c), func, returns).alias(c) for c in df.columns])
