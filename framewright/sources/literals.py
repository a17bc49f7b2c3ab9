"""Frames from Python values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from framewright.types import FLOAT, INT, SPARK, infer


def _field(name: str, values: list) -> T.StructField:
    first = next((v for v in values if v is not None), None)
    if isinstance(first, (list, tuple)):
        flat = [x for v in values if v is not None for x in v]
        return T.StructField(name, T.ArrayType(SPARK[infer(flat)]))
    return T.StructField(name, SPARK[infer(values)])


def _fit(v, t: T.DataType):
    if v is None:
        return None
    if isinstance(t, T.ArrayType):
        return [_fit(x, t.elementType) for x in v]
    return float(v) if t == SPARK[FLOAT] else int(v) if t == SPARK[INT] and not isinstance(v, str) else v


def frame(spark: SparkSession, data, columns: list[str] | None = None, place: str | None = None) -> DataFrame:
    """From a dict of lists (scalars are repeated), a list of dicts (missing keys null), a list of rows, or a numpy array.

    place: the name of a column with the rows' places, if wanted. A column's kind is that of its first value. Lists of unequal length raise ValueError.
    """
    if hasattr(data, "tolist") and not isinstance(data, dict):
        data = data.tolist()
    if isinstance(data, dict):
        own = {k: (v.tolist() if hasattr(v, "tolist") else list(v)) if isinstance(v, (list, tuple, range)) or hasattr(v, "tolist") else v for k, v in data.items()}
        n = max((len(v) for v in own.values() if isinstance(v, list)), default=1 if own else 0)
        own = {k: v if isinstance(v, list) else [v] * n for k, v in own.items()}
    elif data and isinstance(data[0], dict):
        names = list(dict.fromkeys(k for r in data for k in r))
        own, n = {k: [r.get(k) for r in data] for k in names}, len(data)
    else:
        rows = [list(r) if isinstance(r, (list, tuple)) else [r] for r in data or []]
        width = max(map(len, rows), default=len(columns or []))
        names = columns or [str(i) for i in range(width)]
        own, n = {k: [r[i] if i < len(r) else None for r in rows] for i, k in enumerate(names)}, len(rows)
    if any(len(v) != n for v in own.values()):
        raise ValueError("columns of unequal length")
    if place is not None:
        own[place] = list(range(n))
    schema = T.StructType([_field(k, v) for k, v in own.items()])
    return spark.createDataFrame([tuple(_fit(v[i], f.dataType) for v, f in zip(own.values(), schema.fields, strict=True)) for i in range(n)], schema)
