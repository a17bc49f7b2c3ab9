"""Text functions. Patterns of contains, replace, split and count are literal; null gives null unless said otherwise.

Python runs only where Catalyst has no exact equivalent: title, swapcase, wrap and normalize. Their rows travel in the small batches
of plain functions (100 rows), since texts may be long: Arrow's hold 10,000 rows of any length.
"""

from __future__ import annotations

import re
import textwrap
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "[\\s\\x0B\\x1C-\\x1F\\x85\\p{Z}]"


def _false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def upper(c: Column) -> Column:
    return F.upper(c)


def lower(c: Column) -> Column:
    return F.lower(c)


def strip(c: Column) -> Column:
    return rstrip(lstrip(c))


def lstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"\\A{SPACE}+", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"{SPACE}+\\z", "")


def length(c: Column) -> Column:
    """Code points."""
    return F.length(c).cast("long")


def contains(c: Column, pat: str, case: bool = True, na: bool = False) -> Column:
    return F.coalesce(c.contains(pat) if case else F.lower(c).contains(pat.lower()), F.lit(na))


def startswith(c: Column, pat: str) -> Column:
    return _false(c.startswith(pat))


def endswith(c: Column, pat: str) -> Column:
    return _false(c.endswith(pat))


def replace(c: Column, pat: str, repl: str) -> Column:
    """All occurrences; an empty pattern puts the replacement around every character, as in Python."""
    return F.replace(c, F.lit(pat), F.lit(repl)) if pat else F.regexp_replace(c, "", re.sub(r"([\\$])", r"\\\1", repl))


def split(c: Column, pat: str | None = None) -> Column:
    """A list column; None: at runs of white space, without empty parts."""
    if pat is None:
        return F.filter(F.split(c, f"{SPACE}+"), lambda x: x != "")
    if not pat:
        raise ValueError("empty separator")
    return F.split(c, "\\Q" + pat.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)


def join(c: Column, sep: str, is_list: bool = True) -> Column:
    return F.array_join(c, sep) if is_list else c


def cat(c: Column, sep: str, order: list[Column]) -> Column:
    """Aggregate: the non-null texts in order, as one."""
    kept = F.sort_array(F.collect_list(F.when(c.isNotNull(), F.struct(*[k.alias(f"k{i}") for i, k in enumerate(order)], c.alias("v")))))
    return F.array_join(F.transform(kept, lambda x: x["v"]), sep)


def slice_(c: Column, start: int | None = None, stop: int | None = None, step: int | None = None) -> Column:
    """Python slicing by code points."""
    n, step = F.length(c), 1 if step is None else step
    if step == 0:
        raise ValueError("slice step cannot be zero")

    def bound(x: int | None, default: Column) -> Column:
        if x is None:
            return default
        low, high = (F.lit(0), n) if step > 0 else (F.lit(-1), n - 1)
        at = F.lit(x) if x >= 0 else n + x
        return F.greatest(low, F.least(high, at))

    first, last = bound(start, F.lit(0) if step > 0 else n - 1), bound(stop, n if step > 0 else F.lit(-1))
    if step == 1:
        return F.substring(c, first + 1, F.greatest(last - first, F.lit(0)))
    reaches = (first < last) if step > 0 else (first > last)
    places = F.when(reaches, F.sequence(first, last + (-1 if step > 0 else 1), F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.when(c.isNotNull(), F.array_join(F.transform(places, lambda i: F.substring(c, i + 1, F.lit(1))), ""))


def get(c: Column, i: int) -> Column:
    """The i-th character; null where there is none, or i is negative."""
    return F.when(F.length(c) > i, F.substring(c, i + 1, 1)) if i >= 0 else F.when(F.lit(False), c)


def find(c: Column, sub: str, start: int = 0, end: int | None = None) -> Column:
    """0-based place of the first occurrence, -1 if there is none (or the text is null)."""
    body = c if end is None else slice_(c, 0, end)
    return F.coalesce(F.locate(sub, body, start + 1) - 1, F.lit(-1)).cast("long")


def zfill(c: Column, width: int) -> Column:
    signed = c.startswith("+") | c.startswith("-")
    rest = F.when(signed, F.substring(c, 2, 1 << 30)).otherwise(c)
    sign = F.when(signed, F.substring(c, 1, 1)).otherwise(F.lit(""))
    return F.when(F.length(c) >= width, c).otherwise(F.concat(sign, F.repeat(F.lit("0"), F.lit(width) - F.length(c)), rest))


def capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def isnumeric(c: Column) -> Column:
    return _false(c.rlike("\\A\\p{N}+\\z"))


def isalpha(c: Column) -> Column:
    return _false(c.rlike("\\A\\p{L}+\\z"))


def isdigit(c: Column) -> Column:
    """Decimal digits and superscripts."""
    return _false(c.rlike("\\A[\\p{Nd}\\u00B2\\u00B3\\u00B9\\u2070\\u2074-\\u2079\\u2080-\\u2089]+\\z"))


def isalnum(c: Column) -> Column:
    return _false(c.rlike("\\A[\\p{L}\\p{N}]+\\z"))


def isupper(c: Column) -> Column:
    return _false((c == F.upper(c)) & (c != F.lower(c)))


def islower(c: Column) -> Column:
    return _false((c == F.lower(c)) & (c != F.upper(c)))


def count(c: Column, pat: str) -> Column:
    """Occurrences that don't overlap; null counts 0."""
    if not pat:
        return F.coalesce(F.length(c) + 1, F.lit(0)).cast("long")
    return F.coalesce((F.length(c) - F.length(F.replace(c, F.lit(pat), F.lit("")))) / F.lit(len(pat)), F.lit(0)).cast("long")


def match(c: Column, pat: str) -> Column:
    """A regular expression (Java's dialect) at the start."""
    return _false(c.rlike(f"\\A(?:{pat})"))


def fullmatch(c: Column, pat: str) -> Column:
    return _false(c.rlike(f"\\A(?:{pat})\\z"))


def extract(c: Column, pat: str) -> Column:
    """The whole first match; null if there is none."""
    return F.when(c.rlike(pat), F.regexp_extract(c, pat, 0))


def repeat(c: Column, n: int) -> Column:
    return F.repeat(c, n)


def ljust(c: Column, width: int, fillchar: str = " ") -> Column:
    return F.when(F.length(c) >= width, c).otherwise(F.concat(c, F.repeat(F.lit(fillchar), F.lit(width) - F.length(c))))


def rjust(c: Column, width: int, fillchar: str = " ") -> Column:
    return F.when(F.length(c) >= width, c).otherwise(F.concat(F.repeat(F.lit(fillchar), F.lit(width) - F.length(c)), c))


def center(c: Column, width: int, fillchar: str = " ") -> Column:
    """Python's rule: of an odd rest, the left side gets more only if the width is odd too."""
    rest = F.lit(width) - F.length(c)
    left = F.floor(rest / 2).cast("int") + rest.bitwiseAND(F.lit(width & 1))
    return F.when(F.length(c) >= width, c).otherwise(F.concat(F.repeat(F.lit(fillchar), left), c, F.repeat(F.lit(fillchar), rest - left)))


def pad(c: Column, width: int, side: str = "left", fillchar: str = " ") -> Column:
    return {"right": ljust, "both": center}.get(side, rjust)(c, width, fillchar)


def _python(f):
    return F.udf(lambda x: None if x is None else f(x), T.StringType(), useArrow=False)


def title(c: Column) -> Column:
    return _python(str.title)(c)


def swapcase(c: Column) -> Column:
    return _python(str.swapcase)(c)


def wrap(c: Column, width: int) -> Column:
    return _python(lambda x: "\n".join(textwrap.wrap(x, width)))(c)


def normalize(c: Column, form: str) -> Column:
    return _python(lambda x: unicodedata.normalize(form, x))(c)


def encode(c: Column, *_: object) -> Column:
    raise NotImplementedError("encode")
