"""CSV in and out. Types are inferred from all cells in one aggregation: bool, then integer, then fraction, else text."""

from __future__ import annotations

import csv
import io

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.scalar import float_text
from framewright.types import BOOL, FLOAT, INT, SPARK, TEXT, column, kind_named, kinds

# Cells that count as missing.
MISSING = ("", "NA", "NaN", "null", "None")
INTEGER = r"^[+-]?[0-9]{1,19}$"
FRACTION = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|inf|infinity|nan)$"


def infer(df: DataFrame, skip: tuple[str, ...] = ()) -> dict[str, str]:
    """The kind of each text column; a column without values is text."""
    tests = {
        BOOL: lambda c: F.lower(c).isin("true", "false"),
        INT: lambda c: F.when(c.isNotNull(), c.rlike(INTEGER) & c.try_cast("bigint").isNotNull()),
        FLOAT: lambda c: F.lower(c).rlike(FRACTION),
    }
    names = [c for c in df.columns if c not in skip]
    if not names:
        return {}
    row = df.agg(*[F.bool_and(t(column(c))).alias(f"{i}_{k}") for i, c in enumerate(names) for k, t in tests.items()]).first()
    return {c: next((k for k in tests if row[f"{i}_{k}"]), TEXT) for i, c in enumerate(names)}


def _parsed(c: Column, kind: str) -> Column:
    if kind == FLOAT:
        low = F.lower(c)
        word = F.when(low.rlike("^[+]?inf(inity)?$"), "Infinity").when(low.rlike("^-inf(inity)?$"), "-Infinity").when(low.rlike("^[+-]?nan$"), "NaN")
        return F.coalesce(word, c).cast("double")
    return c.cast(SPARK[kind])


def read_csv(
    spark: SparkSession, path: str, delimiter: str = ",", header: bool = True, columns: list[str] | None = None, dtypes: dict[str, str] | None = None,
    na_values: tuple[str, ...] | list[str] = MISSING, max_rows: int | None = None, multiline: bool | None = None,
) -> DataFrame:
    """A typed frame. Without a header columns are "0", "1", ...; short rows end in nulls; an unknown column raises KeyError.

    max_rows keeps that many rows (of a single file: the first). multiline reads quoted line ends, at the price of
    unsplit files; by default it is on where a line has an odd number of quotes, which a scan of the text tells.
    """
    if len(delimiter) != 1:
        raise ValueError("the delimiter must be one character")
    if multiline is None:
        multiline = not spark.read.text(path).where((F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))) % 2 == 1).isEmpty()
    raw = spark.read.csv(path, header=header, sep=delimiter, quote='"', escape='"', multiLine=multiline, inferSchema=False, mode="PERMISSIVE", emptyValue="")
    if not header:
        raw = raw.toDF(*[str(i) for i in range(len(raw.columns))])
    for c in columns or []:
        if c not in raw.columns:
            raise KeyError(c)
    raw = raw.select(*map(column, columns)) if columns else raw
    raw = raw.limit(max_rows) if max_rows is not None else raw
    named = raw.select(*[F.when(~column(c).isin(*na_values), column(c)).alias(c) for c in raw.columns])
    given = {c: kind_named(k) for c, k in (dtypes or {}).items()}
    found = infer(named, tuple(given)) | given
    return named.select(*[_parsed(column(c), found[c]).alias(c) for c in named.columns])


def as_text(df: DataFrame) -> DataFrame:
    """Cells as CSV has them: fractions without a needless point, bools lower-case."""
    return df.select(*[(float_text(column(c)) if k == FLOAT else column(c).cast("string")).alias(c) for c, k in kinds(df).items()])


def write_csv(df: DataFrame, path: str, delimiter: str = ",", header: bool = True, na_rep: str = "") -> None:
    """A directory of CSV files, one for each partition."""
    as_text(df).write.csv(path, header=header, sep=delimiter, quote='"', escape='"', nullValue=na_rep, emptyValue='""' if na_rep else "")


def to_csv_string(df: DataFrame, delimiter: str = ",", header: bool = True, na_rep: str = "") -> str:
    """The whole frame as one text: for results."""
    out = io.StringIO()
    writer = csv.writer(out, delimiter=delimiter, lineterminator="\n")
    if header:
        writer.writerow(df.columns)
    for r in as_text(df).toLocalIterator():
        writer.writerow([na_rep if v is None else v for v in r])
    return out.getvalue()
