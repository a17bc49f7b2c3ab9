"""The engine's front door: frames from values or CSV, and functions of frames.

    import framewright.api as fw
    f = fw.DataFrame({"k": ["a", "b"], "v": [1, 2]}, order="v")
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from framewright.plans.frame import PLACE, Frame, Series, assert_frame_equal, assert_series_equal, concat, isna, isnull, merge, notna, notnull, to_numeric  # noqa: F401
from framewright.session import session
from framewright.sources import csv, literals

NA = None


def _spark() -> SparkSession:
    return SparkSession.getActiveSession() or session()


def DataFrame(data, columns: list[str] | None = None, order=None) -> Frame:  # noqa: N802
    """A Frame of Python values, in their order, or in that of the columns that `order` names."""
    df = literals.frame(_spark(), data, columns, None if order is not None else PLACE)
    return Frame(df, order if order is not None else PLACE)


def from_dict(data: dict, order=None) -> Frame:
    return DataFrame(data, order=order)


def series(values, name: str = "0") -> Series:
    """A Series of Python values, in their order."""
    values = list(values) if not isinstance(values, (str, int, float, bool)) else [values]
    return DataFrame({name: values})[name]


def read_csv(path: str, order=None, **options) -> Frame:
    return Frame(csv.read_csv(_spark(), path, **options), order)


def read_parquet(path: str, order=None) -> Frame:
    return Frame(_spark().read.parquet(path), order)


def melt(frame: Frame, **options) -> Frame:
    return frame.melt(**options)
