"""Equi-joins by name. Null keys never match; Catalyst and AQE choose broadcast, sort-merge or hash, and split hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.types import as_list, column, kind, require

HOW = {"inner": "inner", "left": "left", "right": "right", "outer": "full"}


def merge(left: DataFrame, right: DataFrame, on=None, how: str = "inner", left_on=None, right_on=None, suffixes: tuple[str, str] = ("_x", "_y"), indicator: bool = False) -> DataFrame:
    """Keys (under the left names), the left's other columns, the right's; names on both sides get the suffixes.

    Keys of different kinds raise TypeError, unknown keys KeyError, another `how` ValueError, no keys TypeError.
    indicator: a column _merge of left_only, right_only or both.
    """
    if how not in HOW:
        raise ValueError(f"how: {how!r}")
    mine, other = (as_list(on), as_list(on)) if on is not None else (as_list(left_on), as_list(right_on))
    if not mine or len(mine) != len(other):
        raise TypeError("merge needs keys: on, or left_on and right_on")
    require(left, mine)
    require(right, other)
    for a, b in zip(mine, other, strict=True):
        if kind(left, a) != kind(right, b):
            raise TypeError(f"keys {a!r} ({kind(left, a)}) and {b!r} ({kind(right, b)})")
    a_rest, b_rest = [c for c in left.columns if c not in mine], [c for c in right.columns if c not in other]
    both = set(a_rest) & set(b_rest)
    clash = lambda c, s: c + s if c in both else c
    a = left.select(*map(column, mine), *[column(c).alias(clash(c, suffixes[0])) for c in a_rest])
    b = right.select(*[column(y).alias(x) for x, y in zip(mine, other, strict=True)], *[column(c).alias(clash(c, suffixes[1])) for c in b_rest])
    if not indicator:
        return a.join(b, mine, HOW[how])
    joined = a.withColumn("\0l", F.lit(True)).join(b.withColumn("\0r", F.lit(True)), mine, HOW[how])
    side = F.when(F.col("`\0l`").isNull(), "right_only").when(F.col("`\0r`").isNull(), "left_only").otherwise("both")
    return joined.withColumn("_merge", side).drop("\0l", "\0r")


def side_by_side(frames: list[DataFrame], orders: list[list[str]], hidden: str = "\0") -> DataFrame:
    """Rows of equal place beside each other, each frame ordered by its own keys; names that repeat get _0, _1, ... Columns
    whose names begin with `hidden` only order.

    Frames of unequal length raise (at run time). Places need a total order, so this is a single-partition window over
    each frame: meant for results, not for tables at scale, where a join on a key serves.
    """
    shown = [[c for c in f.columns if not c.startswith(hidden)] for f in frames]
    names = [c for own in shown for c in own]
    seen: dict[str, int] = {}
    placed = []
    for f, order, own in zip(frames, orders, shown, strict=True):
        cols = []
        for c in own:
            k = seen[c] = seen.get(c, -1) + 1
            cols.append(column(c).alias(f"{c}_{k}" if names.count(c) > 1 else c))
        placed.append(f.select(F.row_number().over(Window.orderBy(*map(column, order))).alias("\0row"), *cols).withColumn(f"\0in{len(placed)}", F.lit(True)))
    out = placed[0]
    for p in placed[1:]:
        out = out.join(p, "\0row", "full")
    ok = F.lit(True)
    for i in range(len(placed)):
        ok = ok & F.coalesce(F.col(f"`\0in{i}`"), F.lit(False))
    checked = out.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("frames of unequal length")).cast("boolean")))
    return checked.drop("\0row", *[f"\0in{i}" for i in range(len(placed))])
