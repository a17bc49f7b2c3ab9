"""Frame and Series: chained methods over lazy Spark plans.

A Frame holds a DataFrame and the keys that order its rows, which every positional method needs; frames of values have a
hidden one. A Series is a named Column of a Frame as it was when the Series was taken: arithmetic, comparisons and functions
build expressions, and nothing runs until a scalar or rows are asked for. Methods return new Frames; only `frame[...] =` and the
setters of loc and iloc change the Frame itself.

What needs a column of its own (a window's result, values of another frame) is put beside a Frame's rows in an extension: a
Frame with a hidden column and its parent. Series of one frame and of its extensions go together without a join.
"""

from __future__ import annotations

import itertools
import weakref
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions import scalar, strings
from framewright.operators import aggregate, grouping, joins, ordering, query_expr, reshape, select, udf, windows
from framewright.sources import csv, literals
from framewright.types import FLOAT, INT, as_list, column, kind_of, kinds, numeric, require, require_numeric


#: Hidden columns begin with this.
HIDDEN = "\0"
PLACE = "\0place"
_numbers = itertools.count()
#: Of tables whose rows were counted: by their order, the numbered rows (of great ones), the places' column and the number of rows.
_placed: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
#: Of numbered rows: by their order, the places' column and the number of rows.
_places: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def _hidden_name() -> str:
    return f"{HIDDEN}{next(_numbers)}"


class Series:
    def __init__(self, frame: Frame, expr: Column, name: str = "0", condition: Column | None = None) -> None:
        self.frame, self.expr, self.name, self._condition = frame, expr, name, condition

    @property
    def condition(self) -> Column:
        """What a filter by this series tests. A filter takes null as false anyway, so comparisons stay bare and reach the scan."""
        if self._condition is not None:
            return self._condition
        return self.expr if self.kind == "bool" else scalar.truthy(self.expr, self.kind)

    # -- shape and values
    @property
    def df(self) -> DataFrame:
        return self.frame._all.select(self.expr.alias(self.name))

    @property
    def kind(self) -> str:
        return kind_of(self.df.schema[self.name].dataType)

    dtype = kind

    def _with(self, expr: Column, name: str | None = None) -> Series:
        return Series(self.frame, expr, self.name if name is None else name)

    def _frame(self) -> Frame:
        """This series beside the order keys, to hand to operators that name columns."""
        order = self.frame.order
        at = {k: _hidden_name() if k == self.name else k for k in order}
        return Frame(self.frame._all.select(self.expr.alias(self.name), *[column(k).alias(at[k]) for k in order]), [at[k] for k in order])

    def _beside(self, x: Series, f: Callable[[Column, Column], Column]) -> Series:
        """f of this series' and x's values, row by row; x may belong to another frame of as many rows."""
        frame, other = self.frame._align(x)
        return Series(frame, f(self.expr, other), self.name)

    def to_frame(self, name: str | None = None) -> Frame:
        return self._frame() if name is None else self.rename(name)._frame()

    def reset_index(self, drop: bool = False) -> Series | Frame:
        """A frame with the places as column `index`, or (drop) the series as it is."""
        if drop:
            return self
        f = self._frame()
        return f._new(select.placed(f._all, f._need_order(), "index").select("index", column(self.name), *map(column, f._hidden)))

    def rename(self, name: str) -> Series:
        return self._with(self.expr, name)

    def tolist(self) -> list:
        return [r[0] for r in self.frame._in_order().select(self.expr.alias("v")).collect()]

    to_list = tolist

    def to_numpy(self):
        import numpy as np

        values = self.tolist()
        return np.array(["" if v is None and self.kind == "object" else float("nan") if v is None else v for v in values])

    values = property(to_numpy)

    def to_dict(self) -> dict:
        return dict(enumerate(self.tolist()))

    def items(self) -> Iterator[tuple[int, object]]:
        return iter(enumerate(self.tolist()))

    def __iter__(self) -> Iterator:
        return iter(self.tolist())

    def __len__(self) -> int:
        return self.frame._all.count()

    def item(self):
        values = self.df.take(2)
        if len(values) != 1:
            raise ValueError("item() needs exactly one value")
        return values[0][0]

    def __getitem__(self, i):
        if isinstance(i, (Series, list)) and (isinstance(i, Series) or all(isinstance(x, bool) for x in i)):
            frame = self.frame._extend(self.expr)
            return Series(frame[i], column(frame._step[0]), self.name)
        return self.iloc[i]

    @property
    def iloc(self) -> Places:
        return Places(self._at)

    @property
    def loc(self) -> Places:
        return Places(lambda x: self[x] if isinstance(x, Series) else self._at(_inclusive(x)))

    def _at(self, places):
        f = self._frame()
        if isinstance(places, int):
            rows = f._at(places).collect()
            if not rows:
                raise IndexError(places)
            return rows[0][self.name]
        return f._placed_at(places)[self.name]

    def head(self, n: int = 5) -> Series:
        return self._frame().head(n)[self.name]

    def tail(self, n: int = 5) -> Series:
        return self._frame().tail(n)[self.name]

    def drop(self, places: int | list[int]) -> Series:
        f = self._frame()
        return f._new(select.drop_places(f._all, f._need_order(), [places] if isinstance(places, int) else places))[self.name]

    # -- arithmetic, comparison, logic
    def _other(self, x) -> tuple[Column, str, bool]:
        of = {bool: "bool", int: INT, float: FLOAT, str: "object"}.get(type(x))
        if of is None:
            raise TypeError(f"operand {x!r}")
        whole = self.kind == INT and of == FLOAT and x.is_integer()
        return (F.lit(int(x)), INT, True) if whole else (F.lit(x), of, True)

    def _arith(self, op: str, x) -> Series:
        if isinstance(x, Series):
            return self._beside(x, lambda a, b: scalar.arithmetic(op, a, b, self.kind, x.kind, False))
        b, k, is_scalar = self._other(x)
        return self._with(scalar.arithmetic(op, self.expr, b, self.kind, k, is_scalar))

    def __add__(self, x):
        return self._arith("+", x)

    __radd__ = __add__

    def __sub__(self, x):
        return self._arith("-", x)

    def __rsub__(self, x):
        return self._arith("*", -1)._arith("+", x)

    def __mul__(self, x):
        return self._arith("*", x)

    __rmul__ = __mul__

    def __truediv__(self, x):
        return self._arith("/", x)

    def __neg__(self):
        require_numeric(self.df, [self.name])
        return self._with(-self.expr)

    def _compare(self, op: str, x) -> Series:
        if isinstance(x, Series):
            return self._beside(x, lambda a, b: scalar.compare(op, a, b, self.kind, x.kind))
        b, k, _ = self._other(x)
        return self._with(scalar.compare(op, self.expr, b, self.kind, k))

    def __eq__(self, x):  # type: ignore[override]
        return self._compare("==", x)

    def __ne__(self, x):  # type: ignore[override]
        return self._compare("!=", x)

    def __lt__(self, x):
        return self._compare("<", x)

    def __le__(self, x):
        return self._compare("<=", x)

    def __gt__(self, x):
        return self._compare(">", x)

    def __ge__(self, x):
        return self._compare(">=", x)

    __hash__ = None  # type: ignore[assignment]
    eq, ne, lt, le, gt, ge = __eq__, __ne__, __lt__, __le__, __gt__, __ge__

    def __and__(self, x: Series) -> Series:
        frame, other = self.frame._align(x)
        also = x.condition if other is x.expr else other if x.kind == "bool" else scalar.truthy(other, x.kind)
        return Series(frame, scalar.truthy(self.expr, self.kind) & scalar.truthy(other, x.kind), self.name, self.condition & also)

    def __or__(self, x: Series) -> Series:
        frame, other = self.frame._align(x)
        also = x.condition if other is x.expr else other if x.kind == "bool" else scalar.truthy(other, x.kind)
        return Series(frame, scalar.truthy(self.expr, self.kind) | scalar.truthy(other, x.kind), self.name, self.condition | also)

    def __invert__(self) -> Series:
        return self._with(~scalar.truthy(self.expr, self.kind))

    # -- values one by one
    def abs(self) -> Series:
        require_numeric(self.df, [self.name])
        return self._with(F.abs(self.expr))

    def clip(self, lower=None, upper=None) -> Series:
        return self._with(scalar.clip(self.expr, self.kind, lower, upper))

    def round(self, decimals: int = 0) -> Series:
        return self._with(scalar.round_half_away(self.expr, self.kind, decimals))

    def isna(self) -> Series:
        return self._with(self.expr.isNull())

    def notna(self) -> Series:
        return self._with(self.expr.isNotNull())

    isnull, notnull = isna, notna

    def fillna(self, value) -> Series:
        return self._with(scalar.fill(self.expr, self.kind, value))

    def dropna(self) -> Series:
        return Series(self.frame._new(self.frame._all.where(self.expr.isNotNull())), self.expr, self.name)

    def astype(self, to) -> Series:
        return self._with(scalar.cast(self.expr, self.kind, to))

    def isin(self, values: list) -> Series:
        return self._with(scalar.is_in(self.expr, self.kind, values))

    def between(self, left, right, inclusive: str = "both") -> Series:
        return self._with(scalar.between(self.expr, left, right, inclusive))

    def where(self, cond: Series | list, other=None) -> Series:
        frame, test = self.frame._align(self.frame._condition(cond))
        if isinstance(other, Series):
            frame, other = frame._align(other)
        return Series(frame, scalar.where(self.expr, test, other), self.name)

    def mask(self, cond: Series | list, other=None) -> Series:
        frame, test = self.frame._align(self.frame._condition(cond))
        if isinstance(other, Series):
            frame, other = frame._align(other)
        return Series(frame, scalar.mask(self.expr, test, other), self.name)

    def replace(self, old, new=None) -> Series:
        out = self.expr
        for a, b in (old.items() if isinstance(old, dict) else [(old, new)]):
            out = scalar.replace(out, self.kind, a, b)
        return self._with(out)

    def map(self, func, returns="object") -> Series:
        return self._with(udf.map_values(self.expr, func, returns))

    def apply(self, func: Callable, returns="object") -> Series:
        return self._with(udf.map_values(self.expr, func, returns), "0")

    @property
    def str(self) -> Texts:
        return Texts(self)

    # -- aggregates
    def _scalar(self, expr: Column):
        return self.frame._all.agg(expr).first()[0]

    def _agg(self, func: str, **options):
        return self._scalar(aggregate.expression(func, self.expr, self.kind, **options))

    def sum(self):
        return self._agg("sum")

    def mean(self):
        return self._agg("mean")

    def min(self):
        return self._agg("min")

    def max(self):
        return self._agg("max")

    def count(self):
        return self._agg("count")

    def std(self, ddof: int = 1):
        return self._agg("std", ddof=ddof)

    def var(self, ddof: int = 1):
        return self._agg("var", ddof=ddof)

    def median(self):
        return self._agg("median")

    def quantile(self, q: float = 0.5):
        return self._agg("quantile", q=q)

    def prod(self):
        return self._agg("prod")

    product = prod

    def sem(self):
        return self._agg("sem")

    def nunique(self, dropna: bool = True):
        return self._scalar(F.count_distinct(self.expr) + (F.lit(0) if dropna else F.coalesce(F.max(self.expr.isNull().cast("int")), F.lit(0))))

    def any(self) -> bool:
        return self._scalar(F.coalesce(F.bool_or(scalar.truthy(self.expr, self.kind)), F.lit(False)))

    def all(self) -> bool:
        return self._scalar(F.coalesce(F.bool_and(scalar.truthy(self.expr, self.kind) | self.expr.isNull()), F.lit(True)))

    def cov(self, other: Series):
        frame, b = self.frame._align(other)
        return Series(frame, self.expr)._scalar(F.covar_samp(self.expr.cast("double"), b.cast("double")))

    def corr(self, other: Series):
        frame, b = self.frame._align(other)
        both = self.expr.isNotNull() & b.isNotNull()
        a, b = self.expr.cast("double"), b.cast("double")
        return Series(frame, self.expr)._scalar(F.try_divide(F.covar_samp(a, b), F.stddev_samp(F.when(both, a)) * F.stddev_samp(F.when(both, b))))

    def mode(self) -> list:
        return [r[0] for r in aggregate.mode(self.df, self.name).collect()]

    def unique(self) -> list:
        return [r[0] for r in ordering.unique(self.df, self.name).collect()]

    def value_counts(self, sort: bool = True, ascending: bool = False, dropna: bool = True, normalize: bool = False) -> Frame:
        return Frame(ordering.value_counts(self.df.withColumnRenamed(self.name, "value"), "value", normalize, dropna, sort, ascending))

    def idxmax(self) -> int:
        return self._place("max")

    def idxmin(self) -> int:
        return self._place("min")

    argmax, argmin = idxmax, idxmin

    def _place(self, which: str) -> int:
        f = self._frame()
        row = aggregate.extreme_place(f._all, self.name, [column(k) for k in f.order], which).first()
        if row is None:
            raise IndexError("no values")
        return row["idx"]

    def describe(self) -> Frame:
        return Frame(aggregate.describe_column(self.df, self.name))

    @property
    def is_unique(self) -> bool:
        return aggregate.is_unique(self.df, self.name).first()[0]

    @property
    def is_monotonic_increasing(self) -> bool:
        return self._monotonic(True).first()[0]

    @property
    def is_monotonic_decreasing(self) -> bool:
        return self._monotonic(False).first()[0]

    def _monotonic(self, increasing: bool) -> DataFrame:
        f = self._frame()
        return ordering.monotonic(f._all, self.name, f.order, increasing)

    def equals(self, other: Series) -> bool:
        return self._frame().equals(other.rename(self.name)._frame())

    # -- order and windows
    def sort_values(self, ascending: bool = True) -> Series:
        return self._frame().sort_values(self.name, ascending)[self.name]

    def nlargest(self, n: int = 5) -> Series:
        return self._frame().nlargest(n, self.name)[self.name]

    def nsmallest(self, n: int = 5) -> Series:
        return self._frame().nsmallest(n, self.name)[self.name]

    def duplicated(self, keep="first") -> Series:
        frame = self.frame._extend(self.expr)
        return frame._flagged([frame._step[0]], keep).rename(self.name)

    def drop_duplicates(self, keep="first") -> Series:
        return self[~self.duplicated(keep)]

    def _window(self, make: Callable[[DataFrame, str], Column], whole: Callable | None = None) -> Series:
        """A window's result, in a column beside the frame's rows. whole: see `Frame._whole`; without it they are one partition."""
        placed, *at = self.frame._placed() if whole else (self.frame, None, 0)
        frame = placed._extend(self.expr)
        name = frame._step[0]
        if at[1] > windows.ROWS:
            out = _hidden_name()
            step = lambda d: whole(d, name, out, *at)
            return Frame(step(frame._all), frame._order, frame, (out, step))._last(self.name)
        return frame._extend(make(frame._all, name))._last(self.name)

    def _cumulative(self, func: str, partition_by) -> Series:
        make = lambda d, c: windows.cumulative(d, func, c, self.frame._need_order(), partition_by)
        return self._window(make, None if partition_by else lambda d, c, *to: windows.cumulative_whole(d, func, c, *to))

    def cumsum(self, partition_by=None) -> Series:
        return self._cumulative("sum", partition_by)

    def cumprod(self, partition_by=None) -> Series:
        return self._cumulative("prod", partition_by)

    def cummax(self, partition_by=None) -> Series:
        return self._cumulative("max", partition_by)

    def cummin(self, partition_by=None) -> Series:
        return self._cumulative("min", partition_by)

    def shift(self, periods: int = 1, fill_value=None) -> Series:
        make = lambda d, c, order, by=None: windows.shift(c, order, periods, fill_value, by)
        return self._window(lambda d, c: make(d, c, self.frame._need_order()), _near(make, periods, -periods))

    def diff(self, periods: int = 1) -> Series:
        make = lambda d, c, order, by=None: windows.diff(d, c, order, periods, by)
        return self._window(lambda d, c: make(d, c, self.frame._need_order()), _near(make, periods, -periods))

    def pct_change(self, periods: int = 1) -> Series:
        make = lambda d, c, order, by=None: windows.pct_change(c, order, periods, by)
        return self._window(lambda d, c: make(d, c, self.frame._need_order()), _near(make, periods, -periods))

    def rank(self, method: str = "average", ascending: bool = True) -> Series:
        return self._window(lambda d, c: windows.rank(d, c, method, ascending, self.frame._need_order()))

    def rolling(self, window: int) -> Rolling:
        return Rolling(self.frame, window, self)

    def expanding(self) -> Rolling:
        return Rolling(self.frame, None, self)

    def explode(self) -> Series:
        return Frame(reshape.explode(self.df, self.name))[self.name]


class Texts:
    """`series.str`: every function of framewright.functions.strings."""

    def __init__(self, series: Series) -> None:
        self.series = series

    def __getattr__(self, name: str):
        name = {"len": "length", "slice": "slice_"}.get(name, name)
        f = getattr(strings, name)
        return lambda *a, **k: self.series._with(f(self.series.expr, *a, **k))

    def cat(self, sep: str = "") -> str:
        s = self.series
        return s.frame._all.agg(strings.cat(s.expr, sep, [column(k) for k in s.frame.order])).first()[0]


class Places:
    """`loc` and `iloc`: rows by [], or by a call; `put` sets cells."""

    def __init__(self, get: Callable, put: Callable | None = None) -> None:
        self._get, self._put = get, put

    def __getitem__(self, key):
        return self._get(key)

    def __call__(self, rows, columns=None):
        return self._get(rows if columns is None else (rows, columns))

    def __setitem__(self, key, value) -> None:
        if self._put is None:
            raise TypeError("cells of a Series can't be set")
        self._put(key, value)


def _inclusive(rows):
    """loc's slices include their end."""
    return slice(rows.start, None if rows.stop is None else rows.stop + 1, rows.step) if isinstance(rows, slice) else rows


def _near(make: Callable, before: int, after: int = 0) -> Callable:
    """make(frame, name, order, partition_by) for whole tables; it depends on rows so far before and after."""
    return lambda d, c, out, place, n: windows.near(d, lambda order, by: make(d, c, order, by), out, place, n, max(before, 0), max(after, 0))


class Rolling:
    """Statistics over the last rows, or (window None) over all rows so far, of a Series or of all numeric columns."""

    def __init__(self, frame: Frame, window: int | None, series: Series | None = None) -> None:
        self.frame, self.window, self.series = frame, window, series

    def _stat(self, func: str):
        order = self.frame._need_order()
        if self.window:
            make = lambda d, c, order, by=None: windows.rolling(d, func, c, self.window, order, by)
            whole = _near(make, self.window - 1)
        else:
            make = lambda d, c, order, by=None: windows.expanding(d, func, c, order, by)
            whole = lambda d, c, *to: windows.expanding_whole(d, func, c, *to)
        plain = lambda d, c: make(d, c, order)
        return self.series._window(plain, whole) if self.series is not None else self.frame._windows(plain, True, whole)

    def mean(self):
        return self._stat("mean")

    def sum(self):
        return self._stat("sum")

    def min(self):
        return self._stat("min")

    def max(self):
        return self._stat("max")

    def std(self):
        return self._stat("std")

    def count(self):
        return self._stat("count")


class Grouped:
    """`frame.groupby(by)`; a column or list of columns may be picked by []."""

    def __init__(self, frame: Frame, by: list[str], picked: list[str] | None = None) -> None:
        self.frame, self.by, self.picked = frame, by, picked

    def __getitem__(self, names: str | list[str]) -> Grouped:
        return Grouped(self.frame, self.by, as_list(names))

    def __len__(self) -> int:
        return grouping.count_groups(self.frame.df, self.by).first()[0]

    def _order(self, *funcs: str) -> list[Column]:
        """The order's keys, where a function depends on them."""
        return [column(k) for k in self.frame.order] if {"first", "last"} & set(funcs) else []

    def _agg(self, func: str) -> Frame:
        options = {"order": self._order(func)} if func in ("first", "last") else {}
        return Frame(grouping.aggregate(self.frame._all, self.by, func, self.picked, **options).drop(*self.frame._hidden), self.by)

    def __getattr__(self, func: str):
        if func not in ("sum", "mean", "std", "var", "median", "min", "max", "count", "first", "last", "prod", "nunique"):
            raise AttributeError(func)
        return lambda: self._agg(func)

    def size(self) -> Frame:
        return Frame(grouping.size(self.frame.df, self.by), self.by)

    def agg(self, spec: str | dict) -> Frame:
        if isinstance(spec, str):
            return self._agg(spec)
        return Frame(grouping.several(self.frame._all, self.by, spec, self._order(*[f for x in spec.values() for f in as_list(x)])), self.by)

    aggregate = agg

    def transform(self, func: str) -> Frame:
        return Frame(grouping.transform(self.frame._all, self.by, func, self.picked or [c for c in self.frame.columns if c not in self.by], self._order(func)), self.frame.order)

    def filter(self, test: Column | Callable) -> Frame:
        f = grouping.keep_groups if isinstance(test, Column) else grouping.filter_python
        return Frame(f(self.frame._all, self.by, test), self.frame.order)

    def apply(self, func: Callable, schema: str) -> Frame:
        return Frame(grouping.apply_python(self.frame.df, self.by, func, schema))


class Frame:
    def __init__(self, df: DataFrame, order: str | list[str] | None = None, parent: Frame | None = None, step: tuple[str, Column | Callable] | None = None, sort: tuple[list[str], list[Column]] | None = None) -> None:
        """parent, step: of an extension, the frame beside whose rows it has one more hidden column, and that column, or what adds it to rows. sort: see `_sorted`."""
        self._rows, self._order, self._parent, self._step, self._sort = df, as_list(order), parent, step, sort
        require(df, self._order)

    @property
    def df(self) -> DataFrame:
        """The rows, without hidden columns; sorted if that was the last thing done to them."""
        out = self._in_order() if self._sort else self._rows
        return out.select(*map(column, self.columns)) if len(self.columns) < len(out.columns) else out

    @property
    def _all(self) -> DataFrame:
        """The rows with all columns, after a sort with one that numbers them."""
        self.order  # noqa: B018
        return self._rows

    @property
    def order(self) -> list[str]:
        """The columns that order the rows. After a sort, the first use of it numbers them in one partition."""
        if self._sort:
            name = _hidden_name()
            self._rows = self._rows.withColumn(name, F.row_number().over(Window.orderBy(*self._sort[1])))
            self._order, self._sort = [name], None
        return self._order

    @property
    def _hidden(self) -> list[str]:
        """Hidden columns of the order."""
        return [k for k in self._order if k.startswith(HIDDEN)]

    def _new(self, df: DataFrame) -> Frame:
        if self._sort:
            return Frame(df, [k for k in self._order if k in df.columns], sort=self._sort if set(self._sort[0]) <= set(df.columns) else None)
        return Frame(df, [k for k in self._order if k in df.columns])

    def _sorted(self, by: list[str], ascending) -> Frame:
        """Sorted rows; they are numbered only when something needs their places."""
        down = len(by) == 1 and (ascending is False or ascending == [False])
        ties = self.order
        keys = ordering.sort_keys(self._all, by, ascending) + [column(c).desc() if down else column(c).asc() for c in ties]
        return Frame(self._rows, self._order, sort=([*by, *ties], keys))

    def _need_order(self) -> list[str]:
        if not self.order:
            raise ValueError("this needs an order: Frame(df, order=[...])")
        return self.order

    def _in_order(self) -> DataFrame:
        keys = self._sort[1] if self._sort else [*map(column, self._order)]
        return self._rows.orderBy(*keys) if keys else self._rows

    # -- rows of several frames
    def _extend(self, expr: Column) -> Frame:
        name = _hidden_name()
        return Frame(self._all.withColumn(name, expr), self._order, self, (name, expr))

    def _placed(self) -> tuple[Frame, str | None, int]:
        """This frame (a great one: extended by its rows' places, once for all that share its rows), the places' column, and the number of rows."""
        order = tuple(self._need_order())
        for f in self._chain():
            for name, n in _places.get(f._all, {}).values():
                if name in self._all.columns and f._order == self._order:
                    return self, name, n
        if order not in _placed.setdefault(self._all, {}):
            name = _hidden_name()
            table, n = windows.placed(self._all, [column(k) for k in order], name)
            _placed[self._all][order] = (table, name, n) if n > windows.ROWS else (None, None, n)
            if n > windows.ROWS:
                _places[table] = {order: (name, n)}
        table, name, n = _placed[self._all][order]
        return (self if table is None else Frame(table, self._order, self, (name, self._placing(name)))), name, n

    def _placing(self, name: str) -> Callable:
        keys = [column(k) for k in self._order]
        return lambda d: windows.placed(d, keys, name)[0]

    def _last(self, name: str) -> Series:
        """An extension's own column."""
        return Series(self, column(self._step[0]), name)

    def _chain(self) -> list[Frame]:
        out, f = [], self
        while f is not None:
            out.append(f)
            f = f._parent
        return out

    def _align(self, x: Series | Column) -> tuple[Frame, Column]:
        """This frame, or an extension of it, in which the column holds x's values.

        Frames that are no extensions of each other are joined: by their order where it has the same names (of rows with equal
        keys the n-th with the n-th), else by place. Rows without a partner raise.
        """
        if isinstance(x, Column):
            return self, x
        mine, theirs = self._chain(), x.frame._chain()
        same = lambda f, fs: next((g for g in fs if g._all is f._all), None)
        if same(x.frame, mine):
            return self, x.expr
        if same(self, theirs):
            return x.frame, x.expr
        at = next((i for i, f in enumerate(theirs) if same(f, mine)), None)
        if at is not None and all(f._step for f in theirs[:at]):
            frame = self
            for f in theirs[:at][::-1]:
                name, expr = f._step
                if name not in frame._all.columns:
                    frame = Frame(frame._all.withColumn(name, expr) if isinstance(expr, Column) else expr(frame._all), frame._order, frame, f._step)
            return frame, x.expr
        name = _hidden_name()
        return Frame(self._joined(x.frame._all.select(*map(column, x.frame._need_order()), x.expr.alias(name)), x.frame.order), self.order, self), column(name)

    def _joined(self, other: DataFrame, order: list[str]) -> DataFrame:
        """All columns of both, less the other's order."""
        own = self._need_order()
        if own == order:
            numbered = lambda df, ks: df.withColumn("\0n", F.row_number().over(Window.partitionBy(*map(column, ks)).orderBy(*map(column, ks))))
        else:
            numbered = lambda df, ks: df.withColumn("\0n", F.row_number().over(Window.orderBy(*map(column, ks))))
        keys = {k: _hidden_name() for k in ["\0n", *(own if own == order else [])]}
        left = numbered(self._all, own).withColumn("\0l", F.lit(True))
        right = numbered(other, order).withColumn("\0r", F.lit(True))
        right = right.select(*[column(k).alias(v) for k, v in keys.items()], *[column(c) for c in right.columns if c not in keys and c not in order])
        test = F.lit(True)
        for k, v in keys.items():
            test = test & column(k).eqNullSafe(column(v))
        both = left.join(right, test, "full")
        ok = column("\0l").isNotNull() & column("\0r").isNotNull()
        return both.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("rows without a partner: the lengths or the orders differ")).cast("boolean"))).drop("\0n", "\0l", "\0r", *keys.values())

    def _values(self, values: list) -> Series:
        """A list's values, beside rows by place."""
        data = literals.frame(self._all.sparkSession, {PLACE: list(range(len(values))), "v": list(values)})
        return Frame(data, PLACE)["v"]

    def _condition(self, cond: Series | list | Column) -> Series | Column:
        return self._values(cond) if isinstance(cond, list) else cond

    # -- metadata
    @property
    def columns(self) -> list[str]:
        return [c for c in self._rows.columns if not c.startswith(HIDDEN)]

    @property
    def dtypes(self) -> dict[str, str]:
        return {c: k for c, k in kinds(self._rows).items() if not c.startswith(HIDDEN)}

    @property
    def shape(self) -> tuple[int, int]:
        return self._rows.count(), len(self.columns)

    @property
    def size(self) -> int:
        return self._all.count() * len(self.columns)

    ndim = 2

    @property
    def empty(self) -> bool:
        return not self.columns or self._all.isEmpty()

    @property
    def axes(self) -> list:
        return [range(self._all.count()), self.columns]

    def __len__(self) -> int:
        return self._all.count()

    def __contains__(self, name: str) -> bool:
        return name in self.columns

    def __iter__(self) -> Iterator[str]:
        return iter(self.columns)

    def __repr__(self) -> str:
        return self.to_string(10)

    def to_string(self, n: int = 10) -> str:
        rows = self._in_order().select(*map(column, self.columns)).limit(n).collect()
        return "\n".join(["  ".join(self.columns), *["  ".join("NaN" if v is None else str(v) for v in r) for r in rows], f"[{self._all.count()} rows x {len(self.columns)} columns]"])

    def info(self) -> str:
        counts = self.df.agg(*[F.count(column(c)).alias(c) for c in self.columns]).first()
        return "\n".join(f"{c}: {counts[c]} non-null {k}" for c, k in self.dtypes.items())

    # -- selection
    def __getitem__(self, x):
        if isinstance(x, str):
            require(self._all, [x])
            return Series(self.copy(), column(x), x)
        if isinstance(x, list) and x and all(isinstance(v, bool) for v in x):
            x = self._values(x)
        if isinstance(x, Series):
            frame, test = self._align(x)
            kept = frame._all.where(x.condition if test is x.expr else test)
            return self._new(kept.select(*map(column, self._all.columns)) if frame is not self else kept)
        if isinstance(x, slice):
            return self.iloc[x]
        return self._new(select.columns(self._all, [*x, *self._hidden]))

    def __setitem__(self, name: str, value) -> None:
        """Adds or replaces a column of this Frame: a Series or list of as many rows, a Column, or one value for all."""
        self._become(self.assign(**{name: value}))

    def _become(self, other: Frame) -> None:
        self._rows, self._order, self._parent, self._step, self._sort = other._rows, other._order, other._parent, other._step, other._sort

    def __getattr__(self, name: str):
        if name.startswith("_") or name not in self.columns:
            raise AttributeError(name)
        return self[name]

    def assign(self, **new) -> Frame:
        """Columns added or replaced in turn. Series and lists that follow each other are put beside the rows first, then all picked at once."""
        out, frame, beside = self, self, {}

        def picked() -> Frame:
            rows = frame._all.select(*[beside[c].alias(c) if c in beside else column(c) for c in out._all.columns], *[v.alias(k) for k, v in beside.items() if k not in out._all.columns])
            return out._new(rows) if beside else out

        for k, v in new.items():
            if isinstance(v, (Series, list)):
                frame, beside[k] = frame._align(out._values(v) if isinstance(v, list) else v)
                continue
            out = picked()
            v = v(out) if callable(v) and not isinstance(v, Column) else v
            if isinstance(v, (Series, list)):
                frame, v = out._align(out._values(v) if isinstance(v, list) else v)
                beside = {k: v}
                out = picked()
            else:
                out = out._new(select.assign(out._all, **{k: v}))
            frame, beside = out, {}
        return picked()

    def drop(self, columns=None, labels=None) -> Frame:
        return self._new(select.drop(self._all, columns if columns is not None else labels))

    def pop(self, name: str) -> tuple[Series, Frame]:
        return self[name], self.drop(name)

    def rename(self, columns) -> Frame:
        new = lambda c: c if c.startswith(HIDDEN) else columns(c) if callable(columns) else columns.get(c, c)
        return Frame(select.rename(self._all, new), [new(k) for k in self.order])

    def set_axis(self, names: list[str]) -> Frame:
        if len(names) != len(self.columns):
            raise ValueError(f"{len(names)} names for {len(self.columns)} columns")
        return self.rename(dict(zip(self.columns, names, strict=True)))

    def _picked(self, visible: DataFrame) -> Frame:
        """The columns that an operator left of the visible ones."""
        return self._new(self._all.select(*map(column, [*visible.columns, *self._hidden])))

    def add_prefix(self, prefix: str) -> Frame:
        return self.rename(lambda c: prefix + c)

    def add_suffix(self, suffix: str) -> Frame:
        return self.rename(lambda c: c + suffix)

    def filter(self, items=None, like=None, regex=None) -> Frame:
        return self._picked(select.filter_names(self.df, items, like, regex))

    def select_dtypes(self, include=None, exclude=None) -> Frame:
        out = select.select_dtypes(self.df, include, exclude)
        return self._picked(out) if out.columns != self.columns else self._new(select.select_dtypes(self._all, include, exclude)) if not self._hidden else Frame(out)

    def reindex(self, columns: list[str]) -> Frame:
        return self._new(select.reindex(self._all, [*columns, *self._hidden]))

    def query(self, text: str) -> Frame:
        return self._new(query_expr.query(self._all, text))

    def _at(self, places) -> DataFrame:
        return select.at_places(self._all, self._need_order(), places)

    def _placed_at(self, places) -> Frame:
        """Rows by place, in the order of the places."""
        if isinstance(places, slice) and (places.step or 1) > 0:
            return self._new(self._at(places))
        name = _hidden_name()  # a list, or a slice that goes back, has an order of its own
        return Frame(select.at_places(self._all, self._need_order(), places, name), name)

    @property
    def iloc(self) -> Places:
        """Rows by place: an int gives a dict (with a column, one cell), a slice or list a Frame."""
        return Places(lambda key: self._located(key, lambda rows: rows), self._put)

    @property
    def loc(self) -> Places:
        """Rows by place (the end of a slice included) or by condition, and columns by name."""
        return Places(lambda key: self._located(key, _inclusive), self._put)

    def _located(self, key, of: Callable):
        rows, columns = key if isinstance(key, tuple) else (key, None)
        if isinstance(columns, int):
            columns = self.columns[columns]
        elif isinstance(columns, slice):
            columns = self.columns[columns]
        elif isinstance(columns, list):
            columns = [self.columns[c] if isinstance(c, int) else c for c in columns]
        if isinstance(rows, int) and not isinstance(rows, bool):
            found = self._at(rows).collect()
            if not found:
                raise IndexError(rows)
            row = {c: found[0][c] for c in self.columns}
            return row if columns is None else row[columns] if isinstance(columns, str) else {c: row[c] for c in columns}
        if isinstance(rows, (Series, list)) and (isinstance(rows, Series) or (rows and all(isinstance(x, bool) for x in rows))):
            out = self[rows]
        elif isinstance(rows, (slice, list)):
            whole = isinstance(rows, slice) and rows == slice(None)
            out = self if whole else self._placed_at(of(rows))
        else:
            raise TypeError(f"rows: {rows!r}")
        return out if columns is None else out[columns]

    def _put(self, key, value) -> None:
        """Sets cells: [place, column], [condition, column], [place] with a dict."""
        rows, columns = key if isinstance(key, tuple) else (key, None)
        values = value if columns is None else {self.columns[columns] if isinstance(columns, int) else columns: value}
        if not isinstance(values, dict):
            raise TypeError("a row is set by a dict")
        if isinstance(rows, (Series, list)):
            self._become(self.assign(**{c: self[c].mask(rows, v) for c, v in values.items()}))
        else:
            self._become(self.set_at(rows, values))

    def set_at(self, place: int, values: dict) -> Frame:
        return self._new(select.set_at(self._all, self._need_order(), place, values))

    def head(self, n: int = 5) -> Frame:
        if self._sort and n >= 0:
            return self._new(self._in_order().limit(n))
        return self._new(ordering.head(self._all, n, self._need_order()))

    def tail(self, n: int = 5) -> Frame:
        return self._new(ordering.tail(self._all, n, self._need_order()))

    def sample(self, n=None, frac=None, random_state=None) -> Frame:
        return self._new(ordering.sample(self._all, n, frac, random_state))

    def isin(self, values) -> Frame:
        return Frame(select.isin(self.df, values))

    def update(self, other: Frame) -> Frame:
        return self._new(select.update(self._all, other._all, self._need_order()))

    def copy(self) -> Frame:
        return Frame(self._rows, self._order, self._parent, self._step, self._sort)

    reset_index = sort_index = rename_axis = copy

    def set_index(self, keys) -> Frame:
        return self.drop(keys)

    def pipe(self, f: Callable, *a, **k):
        return f(self, *a, **k)

    def squeeze(self):
        return self[self.columns[0]] if len(self.columns) == 1 else self

    # -- cells
    def _each(self, f: Callable[[Column, str], Column]) -> Frame:
        return self._cells(lambda c, k: column(c) if c in self.order else f(column(c), k))

    def _cells(self, f: Callable[[str, str], Column]) -> Frame:
        """f(name, kind) for every column; hidden ones stay."""
        own = self.dtypes
        order = self.order
        return self._new(self._all.select(*[f(c, own[c]).alias(c) if c in own else column(c) for c in self._all.columns if c in own or c in order]))

    def _with_cells(self, x: Frame, f: Callable[[Column, Column, str, str], Column]) -> Frame:
        """f of the cells of this frame's columns, but for its order, and of x's of the same names; the rows must be as many."""
        own, theirs = self.dtypes, x.dtypes
        rest = [c for c in self.columns if c not in self._need_order()]
        require(x._all, rest)
        hidden = {c: _hidden_name() for c in rest}
        joined = self._joined(x._all.select(*map(column, x._need_order()), *[column(c).alias(h) for c, h in hidden.items()]), x.order)
        return self._new(joined.select(*[f(column(c), column(hidden[c]), own[c], theirs[c]).alias(c) if c in hidden else column(c) for c in self._all.columns]))

    def _arith(self, op: str, x) -> Frame:
        if isinstance(x, Frame):
            return self._with_cells(x, lambda a, b, of, k: scalar.arithmetic(op, a, b, of, k))
        k = {int: INT, float: FLOAT}.get(type(x))
        if k is None:
            raise TypeError(f"operand {x!r}")
        return self._each(lambda c, of: scalar.arithmetic(op, c, scalar.literal(x, of), of, INT if of == INT and float(x).is_integer() else k, True))

    def __add__(self, x):
        return self._arith("+", x)

    __radd__ = __add__

    def __sub__(self, x):
        return self._arith("-", x)

    def __mul__(self, x):
        return self._arith("*", x)

    __rmul__ = __mul__

    def __truediv__(self, x):
        return self._arith("/", x)

    def _compare(self, op: str, x) -> Frame:
        if isinstance(x, Frame):
            return self._with_cells(x, lambda a, b, of, k: scalar.compare(op, a, b, of, k))
        k = {bool: "bool", int: INT, float: FLOAT, str: "object"}.get(type(x))
        if k is None:
            raise TypeError(f"operand {x!r}")
        return self._each(lambda c, of: scalar.compare(op, c, F.lit(x), of, k))

    def eq(self, x):
        return self._compare("==", x)

    def ne(self, x):
        return self._compare("!=", x)

    def lt(self, x):
        return self._compare("<", x)

    def le(self, x):
        return self._compare("<=", x)

    def gt(self, x):
        return self._compare(">", x)

    def ge(self, x):
        return self._compare(">=", x)

    __lt__, __le__, __gt__, __ge__ = lt, le, gt, ge

    def abs(self) -> Frame:
        return self._each(lambda c, k: F.abs(c) if k in (INT, FLOAT) else c)

    def clip(self, lower=None, upper=None) -> Frame:
        return self._each(lambda c, k: scalar.clip(c, k, lower, upper) if k in (INT, FLOAT) else c)

    def round(self, decimals: int = 0) -> Frame:
        return self._each(lambda c, k: scalar.round_half_away(c, k, decimals))

    def isna(self) -> Frame:
        return self._cells(lambda c, k: column(c).isNull())._placeless(self)

    def notna(self) -> Frame:
        return self._cells(lambda c, k: column(c).isNotNull())._placeless(self)

    def _placeless(self, before: Frame) -> Frame:
        """Without the order keys that are visible, whose values are other ones now."""
        return Frame(self._all, before._hidden)

    isnull, notnull = isna, notna

    def fillna(self, value) -> Frame:
        own = self.dtypes
        by = value if isinstance(value, dict) else dict.fromkeys(self.columns, value)
        return self._cells(lambda c, k: scalar.fill(column(c), own[c], by[c]) if c in by else column(c))

    def dropna(self, how: str = "any", subset=None) -> Frame:
        return self._new(select.dropna(self._all, how, as_list(subset) or self.columns))

    def astype(self, to) -> Frame:
        by = to if isinstance(to, dict) else dict.fromkeys(self.columns, to)
        return self._cells(lambda c, k: scalar.cast(column(c), k, by[c]) if c in by else column(c))

    def where(self, cond: Series | Frame | list, other=None) -> Frame:
        """cond: a Series or list, for the rows, or a Frame of truth values with the same names, for the cells."""
        if isinstance(cond, Frame):
            return self._with_cells(cond, lambda a, b, of, k: scalar.where(a, b if k == "bool" else scalar.truthy(b, k), other))
        frame, test = self._align(self._condition(cond))
        beside = Frame(frame._all, self.order)._cells(lambda c, k: column(c) if c in self.order else scalar.where(column(c), test, other))
        return self._new(beside._all.select(*map(column, self._all.columns)))

    def mask(self, cond: Series | Frame | list, other=None) -> Frame:
        """cond: a Series or list, for the rows, or a Frame of truth values with the same names, for the cells."""
        if isinstance(cond, Frame):
            return self._with_cells(cond, lambda a, b, of, k: scalar.mask(a, b if k == "bool" else scalar.truthy(b, k), other))
        frame, test = self._align(self._condition(cond))
        beside = Frame(frame._all, self.order)._cells(lambda c, k: column(c) if c in self.order else scalar.mask(column(c), test, other))
        return self._new(beside._all.select(*map(column, self._all.columns)))

    def replace(self, old, new=None) -> Frame:
        if isinstance(old, dict) and all(isinstance(v, dict) for v in old.values()):
            out = self
            for c, pairs in old.items():
                out = out.assign(**{c: out[c].replace(pairs)})
            return out
        pairs = old if isinstance(old, dict) else {old: new}
        out = self
        for a, b in pairs.items():
            out = out._each(lambda c, k, a=a, b=b: scalar.replace(c, k, a, b))
        return out

    def map(self, func: Callable, returns="object") -> Frame:
        return Frame(udf.map_cells(self.df, func, returns))

    applymap = map

    def apply(self, func: Callable, axis: int = 0, returns="object"):
        """axis 0: func(Series) for each column, as a dict; axis 1: func(row as dict) as a Series."""
        if axis == 0:
            return {c: func(self[c]) for c in self.columns}
        return Frame(udf.map_rows(self.df, func, returns))["0"]

    # -- aggregates: dicts of scalars from one pass, or (axis=1) a value for each row
    def _agg(self, func: str, axis: int = 0, **options):
        if axis == 1:
            return Frame(aggregate.across(self.df, func))["0"]
        return aggregate.aggregate(self.df, func, **options).first().asDict()

    def sum(self, axis: int = 0):
        return self._agg("sum", axis)

    def mean(self, axis: int = 0):
        return self._agg("mean", axis)

    def min(self, axis: int = 0):
        return self._agg("min", axis)

    def max(self, axis: int = 0):
        return self._agg("max", axis)

    def count(self):
        return self._agg("count")

    def std(self, axis: int = 0):
        return self._agg("std", axis)

    def var(self, axis: int = 0):
        return self._agg("var", axis)

    def median(self, axis: int = 0):
        return self._agg("median", axis)

    def prod(self, axis: int = 0):
        return self._agg("prod", axis)

    product = prod

    def quantile(self, q: float = 0.5):
        return self._agg("quantile", q=q)

    def nunique(self):
        return self._agg("nunique")

    def any(self, axis: int = 0):
        return Frame(aggregate.any_all(self.df, "any", 1))["0"] if axis else aggregate.any_all(self.df, "any").first().asDict()

    def all(self, axis: int = 0):
        return Frame(aggregate.any_all(self.df, "all", 1))["0"] if axis else aggregate.any_all(self.df, "all").first().asDict()

    def idxmax(self) -> dict:
        return {c: self[c].idxmax() for c in numeric(self.df)}

    def idxmin(self) -> dict:
        return {c: self[c].idxmin() for c in numeric(self.df)}

    def describe(self) -> Frame:
        return Frame(aggregate.describe(self.df))

    def cov(self) -> Frame:
        return Frame(aggregate.matrix(self.df, "cov"))

    def corr(self) -> Frame:
        return Frame(aggregate.matrix(self.df, "corr"))

    def corrwith(self, other: Frame) -> dict:
        names = [c for c in numeric(self.df) if c in other.columns and c not in self._need_order()]
        hidden = {c: _hidden_name() for c in names}
        joined = self._joined(other._all.select(*map(column, other._need_order()), *[column(c).alias(h) for c, h in hidden.items()]), other.order)
        return joined.agg(*[aggregate._pair(column(c).cast("double"), column(h).cast("double"), "corr").alias(c) for c, h in hidden.items()]).first().asDict()

    def agg(self, spec):
        """A name: a dict; names: a Frame with a row for each; a dict of names: one row of column_function."""
        if isinstance(spec, str):
            return self._agg(spec)
        if isinstance(spec, dict):
            return Frame(aggregate.several(self._all, spec, [column(k) for k in self.order]))
        used = numeric(self.df)
        one = aggregate.several(self.df, {c: list(spec) for c in used})
        rows = F.array(*[F.struct(F.lit(f).alias("stat"), *[column(f"{c}_{f}").cast("double").alias(c) for c in used]) for f in spec])
        return Frame(one.select(F.explode(rows).alias("r")).select("r.*"))

    aggregate = agg

    def value_counts(self, subset=None, normalize: bool = False, sort: bool = True, ascending: bool = False, dropna: bool = True) -> dict:
        keys = as_list(subset) or self.columns
        rows = ordering.value_counts(self.df, keys, normalize, dropna, sort, ascending).collect()
        return {(r[0] if len(keys) == 1 else tuple(r[: len(keys)])): r["count"] for r in rows}

    def equals(self, other: Frame) -> bool:
        if self.columns != other.columns:
            return False
        rows = tuple([*map(column, f.columns), *map(column, f._need_order())] for f in (self, other))
        if any(k.startswith(HIDDEN) for k in [*self.order, *other.order]):  # frames by place
            numbered = lambda f: f._all.select(*map(column, f.columns), F.row_number().over(Window.orderBy(*map(column, f.order))).alias(PLACE))
            return ordering.differences(numbered(self), numbered(other)).first()[0] == 0
        return len(rows[0]) == len(rows[1]) and ordering.differences(self._all, other._all, of=rows).first()[0] == 0

    # -- rows in order
    def sort_values(self, by, ascending=True) -> Frame:
        by = as_list(by)
        require(self._all, by)
        return self._sorted(by, ascending) if by else self

    def nlargest(self, n: int, columns: str) -> Frame:
        self._need_order()
        return self._sorted([columns], False).head(n)

    def nsmallest(self, n: int, columns: str) -> Frame:
        self._need_order()
        return self._sorted([columns], True).head(n)

    def duplicated(self, subset=None, keep="first") -> Series:
        return self._flagged(as_list(subset) or self.columns, keep)

    def _flagged(self, keys: list[str], keep) -> Series:
        name = _hidden_name()
        return Series(Frame(ordering.duplicated(self._all, keys, keep, self.order, name), self.order, self, (name, ordering.repeats(self._all, keys, keep, self.order))), column(name), "duplicated")

    def drop_duplicates(self, subset=None, keep="first") -> Frame:
        return self._new(ordering.drop_duplicates(self._all, as_list(subset) or self.columns, keep, self.order))

    def _windows(self, make: Callable[[DataFrame, str], Column], only_numeric: bool = True, whole: Callable | None = None) -> Frame:
        """whole: adds the same as a column to the numbered rows of a great table; without it they are one partition."""
        order = self._need_order()
        used = [c for c in (numeric(self.df) if only_numeric else self.columns) if c not in order]
        placed, *at = self._placed() if whole else (self, None, 0)
        if at[1] <= windows.ROWS:
            return self._new(self._all.select(*map(column, order), *[make(self._all, c).alias(c) for c in used]))
        names = {c: _hidden_name() for c in used}
        out = placed._all.select(*map(column, dict.fromkeys([*order, *used, at[0]])))
        for c, name in names.items():
            out = whole(out, c, name, *at)
        return self._new(out.select(*map(column, order), *[column(name).alias(c) for c, name in names.items()]))

    def _cumulative(self, func: str, only_numeric: bool = True) -> Frame:
        make = lambda d, c: windows.cumulative(d, func, c, self._need_order())
        return self._windows(make, only_numeric, lambda d, c, *to: windows.cumulative_whole(d, func, c, *to))

    def cumsum(self) -> Frame:
        return self._cumulative("sum")

    def cumprod(self) -> Frame:
        return self._cumulative("prod")

    def cummax(self) -> Frame:
        return self._cumulative("max", False)

    def cummin(self) -> Frame:
        return self._cumulative("min", False)

    def shift(self, periods: int = 1, fill_value=None) -> Frame:
        make = lambda d, c, order, by=None: windows.shift(c, order, periods, fill_value, by)
        return self._windows(lambda d, c: make(d, c, self.order), False, _near(make, periods, -periods))

    def diff(self, periods: int = 1) -> Frame:
        make = lambda d, c, order, by=None: windows.diff(d, c, order, periods, by)
        return self._windows(lambda d, c: make(d, c, self.order), False, _near(make, periods, -periods))

    def pct_change(self, periods: int = 1) -> Frame:
        make = lambda d, c, order, by=None: windows.pct_change(c, order, periods, by)
        return self._windows(lambda d, c: make(d, c, self.order), True, _near(make, periods, -periods))

    def rank(self, method: str = "average", ascending: bool = True) -> Frame:
        return self._windows(lambda d, c: windows.rank(d, c, method, ascending, self.order))

    def rolling(self, window: int) -> Rolling:
        return Rolling(self, window)

    def expanding(self) -> Rolling:
        return Rolling(self, None)

    # -- groups, joins, reshaping
    def groupby(self, by, sort: bool = True, as_index: bool = True) -> Grouped:
        return Grouped(self, as_list(by))

    def merge(self, right: Frame, on=None, how: str = "inner", left_on=None, right_on=None, suffixes=("_x", "_y"), indicator: bool = False) -> Frame:
        return self._new(joins.merge(self.df, right.df, on, how, left_on, right_on, suffixes, indicator))

    def join(self, other: Frame) -> Frame:
        return Frame(joins.side_by_side([self._all, other._all], [self._need_order(), other._need_order()], HIDDEN))

    def melt(self, id_vars=None, value_vars=None, var_name: str = "variable", value_name: str = "value") -> Frame:
        return Frame(reshape.melt(self.df, id_vars, value_vars, var_name, value_name))

    def stack(self) -> Frame:
        return Frame(reshape.stack(self._all, self._need_order()), [*self.order, "place"])

    def pivot_table(self, values=None, index=None, columns=None, aggfunc: str = "mean") -> Frame:
        return Frame(reshape.pivot_table(self.df, values, index, columns, aggfunc))

    def transpose(self) -> Frame:
        return Frame(reshape.transpose(self._all, self._need_order()))

    T = property(transpose)

    def explode(self, name: str) -> Frame:
        return self._new(reshape.explode(self._all, name))

    # -- out
    def _shown(self) -> DataFrame:
        return self._in_order().select(*map(column, self.columns))

    def to_dict(self, orient: str = "dict"):
        rows = self._shown().collect()
        return [r.asDict() for r in rows] if orient == "records" else {c: [r[c] for r in rows] for c in self.columns}

    def to_numpy(self):
        import numpy as np

        if any(k == "object" for k in self.dtypes.values()):
            raise TypeError("text columns have no numeric values")
        return np.array([[float("nan") if v is None else float(v) for v in r] for r in self._shown().collect()])

    values = property(to_numpy)

    def iterrows(self) -> Iterator[tuple[int, dict]]:
        return ((i, r.asDict()) for i, r in enumerate(self._shown().toLocalIterator()))

    def itertuples(self, index: bool = True) -> Iterator[tuple]:
        return ((i, *r) if index else tuple(r) for i, r in enumerate(self._shown().toLocalIterator()))

    def items(self) -> Iterator[tuple[str, Series]]:
        return ((c, self[c]) for c in self.columns)

    def to_csv(self, path: str | None = None, index: bool = True, **options) -> str | None:
        return csv.to_csv_string(self._shown(), **options) if path is None else csv.write_csv(self.df, path, **options)


def concat(frames: list[Frame], axis: int = 0) -> Frame:
    if axis == 1:
        return Frame(joins.side_by_side([f._all for f in frames], [f._need_order() for f in frames], HIDDEN))
    return Frame(reshape.concat([f.df for f in frames]))


def merge(left: Frame, right: Frame, **options) -> Frame:
    return left.merge(right, **options)


def isna(x):
    return x.isna() if isinstance(x, (Frame, Series)) else scalar.scalar_is_null(x)


def notna(x):
    return x.notna() if isinstance(x, (Frame, Series)) else not scalar.scalar_is_null(x)


isnull, notnull = isna, notna


def to_numeric(x, errors: str = "raise"):
    """Fractions of a Series, a list or one value; errors "coerce": null for what is no number, in place of ValueError."""
    if isinstance(x, Series):
        return x._with(x.expr.try_cast("double")) if errors == "coerce" and x.kind == "object" else x.astype("float64")
    if isinstance(x, (list, tuple)):
        return [to_numeric(v, errors) for v in x]
    try:
        return None if x is None else float(x)
    except (TypeError, ValueError):
        if errors == "coerce":
            return None
        raise


def assert_frame_equal(left: Frame, right: Frame, tolerance: float = 1e-10) -> None:
    """AssertionError unless columns, kinds and rows (by order, fractions within the tolerance, null with null) are equal."""
    assert left.columns == right.columns, f"{left.columns} != {right.columns}"
    assert left.dtypes == right.dtypes, f"{left.dtypes} != {right.dtypes}"
    a, b = left.to_dict("records"), right.to_dict("records")
    assert len(a) == len(b), f"{len(a)} rows != {len(b)}"
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        for c in left.columns:
            u, v = x[c], y[c]
            same = u == v or (isinstance(u, float) and isinstance(v, float) and (abs(u - v) <= tolerance or (u != u and v != v)))
            assert same, f"row {i}, {c}: {u!r} != {v!r}"


def assert_series_equal(left: Series, right: Series, tolerance: float = 1e-10) -> None:
    assert_frame_equal(left._frame(), right.rename(left.name)._frame(), tolerance)
