"""The four kinds of values that the engine tells apart, their names, and schema checks that raise Python's own errors."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOOL, INT, FLOAT, TEXT = "bool", "int64", "float64", "object"
SPARK = {BOOL: T.BooleanType(), INT: T.LongType(), FLOAT: T.DoubleType(), TEXT: T.StringType()}
# The names by which a kind may be asked for.
ALIASES = {
    "bool": BOOL, "int64": INT, "int": INT, "i64": INT, "float64": FLOAT, "float": FLOAT, "f64": FLOAT, "object": TEXT, "str": TEXT, "string": TEXT,
    bool: BOOL, int: INT, float: FLOAT, str: TEXT,
}


def kind_named(name: str | type) -> str:
    if name not in ALIASES:
        raise TypeError(f"unknown dtype {name!r}")
    return ALIASES[name]


def kind_of(t: T.DataType) -> str:
    """Integers of any width are int64, fractions float64; all that is neither those nor bool is object."""
    if isinstance(t, T.BooleanType):
        return BOOL
    if isinstance(t, T.IntegralType):
        return INT
    return FLOAT if isinstance(t, T.FractionalType) else TEXT


def kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: kind_of(f.dataType) for f in df.schema.fields}


def kind(df: DataFrame, name: str) -> str:
    require(df, [name])
    return kind_of(df.schema[name].dataType)


def numeric(df: DataFrame, names: Iterable[str] | None = None) -> list[str]:
    own = kinds(df)
    return [c for c in (df.columns if names is None else names) if own[c] in (INT, FLOAT)]


def require(df: DataFrame, names: Iterable[str]) -> None:
    """KeyError for a column that isn't there."""
    for c in names:
        if c not in df.columns:
            raise KeyError(c)


def require_numeric(df: DataFrame, names: Iterable[str]) -> None:
    own = kinds(df)
    for c in names:
        if own[c] not in (INT, FLOAT):
            raise TypeError(f"column {c!r} of dtype {own[c]} is not numeric")


def column(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def infer(values: Iterable) -> str:
    """A list's kind is that of its first value that isn't None; of none, float64."""
    first = next((v for v in values if v is not None), None)
    if isinstance(first, bool):
        return BOOL
    if isinstance(first, int):
        return INT
    return TEXT if isinstance(first, str) else FLOAT


def as_list(x) -> list:
    return [] if x is None else [x] if isinstance(x, str) else list(x)
