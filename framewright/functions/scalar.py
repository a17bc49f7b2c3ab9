"""Column expressions with the engine's rules for nulls, NaN, division and rounding. All stay inside Catalyst."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from framewright.types import BOOL, FLOAT, INT, SPARK, TEXT, kind_named

INF, NAN = float("inf"), float("nan")


def literal(value, of: str) -> Column:
    """A scalar beside a column of kind `of`: whole numbers keep integer columns integer."""
    if of == INT and isinstance(value, float) and value.is_integer():
        return F.lit(int(value))
    return F.lit(value)


def arithmetic(op: str, a: Column, b: Column, a_kind: str, b_kind: str, b_scalar: bool = False) -> Column:
    """a op b for + - * /; null if either is null; TypeError unless both are numeric."""
    for k in (a_kind, b_kind):
        if k not in (INT, FLOAT):
            raise TypeError(f"arithmetic on {k}")
    if op == "/":
        x, y = a.cast("double"), b.cast("double")
        if a_kind == b_kind == INT and not b_scalar:
            return x / y  # an integer column divided by an integer zero raises
        at_zero = F.when(F.isnan(x) | (x == 0), F.lit(NAN)).when(x > 0, F.lit(INF)).otherwise(F.lit(-INF))
        return F.when(x.isNull() | y.isNull(), F.lit(None).cast("double")).when(y == 0, at_zero).otherwise(F.try_divide(x, y))
    return {"+": a + b, "-": a - b, "*": a * b}[op]


def compare(op: str, a: Column, b: Column, a_kind: str, b_kind: str) -> Column:
    """Null if either is null; integers meet fractions, texts texts; truth values have == and != only."""
    same = a_kind == b_kind or {a_kind, b_kind} == {INT, FLOAT}
    if not same or (a_kind == BOOL and op not in ("==", "!=")):
        raise TypeError(f"{a_kind} {op} {b_kind}")
    return {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def truthy(c: Column, of: str) -> Column:
    """Python's truth of a value; null is false."""
    own = {BOOL: c, TEXT: F.length(c) > 0}.get(of, c != 0)
    return F.coalesce(own, F.lit(False))


def both(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(False)) & F.coalesce(b, F.lit(False))


def either(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False))


def negate(a: Column) -> Column:
    return ~F.coalesce(a, F.lit(False))


def absolute(c: Column) -> Column:
    return F.abs(c)


def clip(c: Column, of: str, lower=None, upper=None) -> Column:
    """Bounds of integer columns are cut to integers; null and NaN pass."""
    for bound, beyond in ((lower, lambda x, b: x < b), (upper, lambda x, b: x > b)):
        if bound is not None:
            b = F.lit(int(bound)) if of == INT else F.lit(float(bound))
            out = beyond(c, b) & ~F.isnan(c) if of == FLOAT else beyond(c, b)
            c = F.when(out, b).otherwise(c)
    return c


def round_half_away(c: Column, of: str, decimals: int = 0) -> Column:
    """Binary rounding, halves away from zero, as C's round of c * 10^decimals; integers stay."""
    if of != FLOAT:
        return c
    scale = float(10**decimals)
    size = F.abs(c * scale)
    rest = size % 1.0  # exact, unlike size + 0.5
    whole = size - rest + F.when(rest >= 0.5, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(F.isnan(c) | (size == INF), c).otherwise(F.signum(c) * whole / scale)


def is_in(c: Column, of: str, values: list) -> Column:
    """Null is in no list; values of another type are never equal, but integers meet fractions."""
    if any(v is None for v in values):
        raise TypeError("None in the list of values")
    fits = {BOOL: (bool,), TEXT: (str,)}.get(of, (int, float))
    own = [v for v in values if isinstance(v, fits) and (of == BOOL or not isinstance(v, bool))]
    return F.coalesce(c.isin(own), F.lit(False)) if own else F.lit(False)


def between(c: Column, left, right, inclusive: str = "both") -> Column:
    """inclusive: both, left, right or neither; null gives false."""
    if inclusive not in ("both", "left", "right", "neither"):
        raise ValueError(f"inclusive: {inclusive!r}")
    low = c >= left if inclusive in ("both", "left") else c > left
    high = c <= right if inclusive in ("both", "right") else c < right
    return both(low, high)


def where(c: Column, condition: Column, other=None) -> Column:
    """The value where the condition holds, else `other`; a null condition doesn't hold."""
    return F.when(F.coalesce(condition, F.lit(False)), c).otherwise(other if isinstance(other, Column) else F.lit(other))


def mask(c: Column, condition: Column, other=None) -> Column:
    return where(c, ~F.coalesce(condition, F.lit(False)), other)


def replace(c: Column, of: str, old, new) -> Column:
    """Exact matches of the same type; nulls stay."""
    fits = {BOOL: bool, TEXT: str, INT: int, FLOAT: float}[of]
    if not isinstance(old, fits) or (of != BOOL and isinstance(old, bool)):
        return c
    return F.when(c == F.lit(old), F.lit(new).cast(SPARK[of])).otherwise(c)


def fill(c: Column, of: str, value) -> Column:
    """Null replaced. A whole number put into an integer column keeps it integer; kinds that don't fit raise TypeError."""
    fits = {BOOL: bool, TEXT: str}.get(of, (int, float))
    if not isinstance(value, fits) or (of in (INT, FLOAT) and isinstance(value, bool)):
        raise TypeError(f"fill {of} with {value!r}")
    if of == INT:
        return F.coalesce(c, F.lit(int(value))) if float(value).is_integer() else F.coalesce(c.cast("double"), F.lit(value))
    return F.coalesce(c, F.lit(value).cast(SPARK[of]))


def float_text(c: Column) -> Column:
    """Fractions as text: without exponent, and without a point where whole."""
    plain = F.regexp_replace(c.cast("decimal(38,15)").cast("string"), r"\.?0+$", "")
    whole = F.when(c == 0, F.lit("0")).otherwise(c.cast("decimal(38,0)").cast("string"))
    shortest = F.when(c.cast("string").contains("E"), plain).otherwise(c.cast("string"))
    special = F.when(F.isnan(c), F.lit("NaN")).when(F.abs(c) == INF, F.when(c > 0, F.lit("inf")).otherwise(F.lit("-inf")))
    return special.when(F.abs(c) >= 1e18, F.format_string("%.0f", c)).when(c == F.floor(c), whole).otherwise(shortest)


def cast(c: Column, of: str, to: str | type) -> Column:
    """Casts: bad texts, NaN and infinities into integers raise at run time, float into bool raises TypeError at once."""
    to = kind_named(to)
    if of == to:
        return c.cast(SPARK[to])
    if (of, to) == (FLOAT, BOOL):
        raise TypeError("float64 to bool")
    if (of, to) == (BOOL, TEXT):
        return F.initcap(c.cast("string"))
    if (of, to) == (FLOAT, TEXT):
        return float_text(c)
    if (of, to) == (TEXT, BOOL):
        bad = F.raise_error(F.concat(F.lit("not a bool: "), c)).cast("boolean")
        return F.when(c.isNull(), F.lit(None).cast("boolean")).when(c.isin("true", "True", "1"), F.lit(True)).when(c.isin("false", "False", "0"), F.lit(False)).otherwise(bad)
    return c.cast(SPARK[to])


def no_nan(c: Column, of: str) -> Column:
    """NaN as null, for aggregates that leave NaN out."""
    return F.when(~F.isnan(c), c) if of == FLOAT else c


def scalar_is_null(x) -> bool:
    return x is None or (isinstance(x, float) and math.isnan(x))
