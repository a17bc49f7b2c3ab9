"""Projection, selection by name, kind or place, and point updates."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions.scalar import is_in
from framewright.operators import windows
from framewright.types import BOOL, FLOAT, INT, TEXT, as_list, column, kinds, require

# Names of categories that select_dtypes accepts.
CATEGORIES = {
    "number": (INT, FLOAT), "int": (INT,), "int64": (INT,), "integer": (INT,), "float": (FLOAT,), "float64": (FLOAT,), "object": (TEXT,), "str": (TEXT,), "string": (TEXT,), "bool": (BOOL,),
    int: (INT,), float: (FLOAT,), str: (TEXT,), bool: (BOOL,),
}


def columns(df: DataFrame, names: list[str]) -> DataFrame:
    require(df, names)
    return df.select(*map(column, names))


def assign(df: DataFrame, **new) -> DataFrame:
    """Columns added or replaced in turn; a callable gets the frame so far, a scalar is repeated."""
    for name, v in new.items():
        v = v(df) if callable(v) and not isinstance(v, Column) else v
        df = df.withColumn(name, v if isinstance(v, Column) else F.lit(v))
    return df


def drop(df: DataFrame, names: str | list[str]) -> DataFrame:
    """Unknown names are ignored."""
    gone = set(as_list(names))
    return df.select(*[column(c) for c in df.columns if c not in gone])


def rename(df: DataFrame, how: dict[str, str] | Callable[[str], str]) -> DataFrame:
    new = how if callable(how) else lambda c: how.get(c, c)
    return df.toDF(*[new(c) for c in df.columns])


def set_names(df: DataFrame, names: list[str]) -> DataFrame:
    if len(names) != len(df.columns):
        raise ValueError(f"{len(names)} names for {len(df.columns)} columns")
    return df.toDF(*names)


def filter_names(df: DataFrame, items: list[str] | None = None, like: str | None = None, regex: str | None = None) -> DataFrame:
    """Columns by name: listed ones in that order (missing ones skipped), those with a substring, or those that match."""
    if items is not None:
        kept = [c for c in items if c in df.columns]
    elif like is not None:
        kept = [c for c in df.columns if like in c]
    elif regex is not None:
        kept = [c for c in df.columns if re.search(regex, c)]
    else:
        raise TypeError("filter needs items, like or regex")
    return df.select(*map(column, kept))


def select_dtypes(df: DataFrame, include=None, exclude=None) -> DataFrame:
    """Columns of (or but for) the kinds; if none is kept, all columns without rows."""
    sets = [{k for x in ([v] if isinstance(v, (str, type)) else list(v or [])) for k in CATEGORIES.get(x, ())} for v in (include, exclude)]
    kept = [c for c, k in kinds(df).items() if (include is None or k in sets[0]) and (exclude is None or k not in sets[1])]
    return df.select(*map(column, kept)) if kept else df.where(F.lit(False))


def reindex(df: DataFrame, names: list[str]) -> DataFrame:
    """Columns in this order; missing ones are null fractions."""
    return df.select(*[column(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in names])


def keep_rows(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition holds and isn't null."""
    return df.where(condition)


def dropna(df: DataFrame, how: str = "any", subset: list[str] | None = None) -> DataFrame:
    """Rows without nulls in the subset, or with one value at least (how="all"). NaN is a value."""
    names = as_list(subset) or df.columns
    require(df, names)
    there = [column(c).isNotNull() for c in names]
    test = there[0]
    for t in there[1:]:
        test = (test & t) if how == "any" else (test | t)
    return df.where(test)


def isin(df: DataFrame, values: list | dict[str, list]) -> DataFrame:
    """Truth values for every cell; with a dict, columns it doesn't name are False."""
    own = kinds(df)
    one = lambda c: is_in(column(c), own[c], values) if not isinstance(values, dict) else is_in(column(c), own[c], values[c]) if c in values else F.lit(False)
    return df.select(*[one(c).alias(c) for c in df.columns])


def placed(df: DataFrame, order: list[str], name: str = "\0at") -> DataFrame:
    """With the 0-based place of each row."""
    return windows.placed(df, [column(k) for k in order], name)[0]


def at_places(df: DataFrame, order: list[str], places: int | slice | list[int], name: str | None = None) -> DataFrame:
    """Rows by place: one, a slice (with step and negative bounds), or a list, in the order of the places, which `name` numbers if given."""
    if name is not None:
        out = _at_places(df, order, places)
        return out.withColumn(name, F.col("`\0order`")).drop("\0order")
    return _at_places(df, order, places).drop("\0order")


def _at_places(df: DataFrame, order: list[str], places: int | slice | list[int]) -> DataFrame:
    if isinstance(places, slice) and places.step in (None, 1) and places.start in (None, 0) and (places.stop or 0) > 0:
        return df.orderBy(*map(column, order)).limit(places.stop)  # no numbering needed
    at = F.col("`\0at`")
    numbered, many = windows.placed(df, [column(k) for k in order], "\0at")
    n = F.lit(many)
    if isinstance(places, slice):
        step = places.step or 1
        bound = lambda x, d: d if x is None else F.greatest(F.lit(0), F.least(n, F.lit(x) if x >= 0 else n + x))
        if step > 0:
            start, stop = bound(places.start, F.lit(0)), bound(places.stop, n)
            hit = (at >= start) & (at < stop) & ((at - start) % step == 0)
        else:
            start = n - 1 if places.start is None else F.least(n - 1, F.lit(places.start) if places.start >= 0 else n + places.start)
            stop = F.lit(-1) if places.stop is None else (F.lit(places.stop) if places.stop >= 0 else n + places.stop)
            hit = (at <= start) & (at > stop) & ((start - at) % -step == 0)
        return numbered.where(hit).orderBy(at.asc() if step > 0 else at.desc()).withColumn("\0order", at if step > 0 else -at).drop("\0at")
    wanted = F.array(*[F.lit(p) if p >= 0 else n + p for p in ([places] if isinstance(places, int) else places)]).cast("array<long>")
    return numbered.withColumn("\0w", F.explode(F.filter(F.transform(wanted, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"] == at))).orderBy("`\0w`.i").withColumn("\0order", F.col("`\0w`.i")).drop("\0at", "\0w")


def set_at(df: DataFrame, order: list[str], place: int, values: dict) -> DataFrame:
    """Cells of one row replaced, by place (a negative one from the end)."""
    require(df, values)
    out, n = windows.placed(df, [column(k) for k in order], "\0at")
    place = place if place >= 0 else n + place
    for c, v in values.items():
        out = out.withColumn(c, F.when(F.col("`\0at`") == place, F.lit(v)).otherwise(column(c)))
    return out.drop("\0at")


def drop_places(df: DataFrame, order: list[str], places: list[int]) -> DataFrame:
    return placed(df, order).where(~F.col("`\0at`").isin(places)).drop("\0at")


def update(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """Values of columns in both replaced by the other's non-null ones, rows matched by key."""
    both = [c for c in df.columns if c in other.columns and c not in on]
    o = other.select(*map(column, on), *[column(c).alias(f"\0{c}") for c in both])
    return df.join(o, on, "left").select(*[F.coalesce(column(f"\0{c}"), column(c)).alias(c) if c in both else column(c) for c in df.columns])
