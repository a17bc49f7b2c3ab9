"""Row conditions written as Python expressions, translated into Columns by syntax tree; nothing is evaluated as code."""

from __future__ import annotations

import ast

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.types import column

COMPARE = {ast.Eq: "__eq__", ast.NotEq: "__ne__", ast.Lt: "__lt__", ast.LtE: "__le__", ast.Gt: "__gt__", ast.GtE: "__ge__"}


def modulo(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor; null by zero."""
    rest = F.try_mod(a, b)
    return F.when((rest != 0) & ((rest < 0) != (b < 0)), rest + b).otherwise(rest)


def floor_divide(a: Column, b: Column) -> Column:
    """The quotient that goes with `modulo`, as a double (exact up to 2^53); null by zero."""
    return F.rint(F.try_divide((a - modulo(a, b)).cast("double"), b.cast("double")))


def power(a: Column, b: Column) -> Column:
    """a to the b, as a double (exact up to 2^53); null where the result is no real number, or is beyond a double."""
    a, b = a.cast("double"), b.cast("double")
    out, finite = F.pow(a, b), ~F.isnan(a) & ~F.isnan(b) & (F.abs(a) != float("inf")) & (F.abs(b) != float("inf"))
    return F.when(finite & (F.isnan(out) | (F.abs(out) == float("inf"))), F.lit(None)).otherwise(out)


def translate(df: DataFrame, text: str) -> Column:
    """and, or, not, & | ~, chained comparisons, + - * / // % **, in and not in of literals, names of columns, literals."""

    def visit(x: ast.AST) -> Column:
        if isinstance(x, ast.Expression):
            return visit(x.body)
        if isinstance(x, ast.Name):
            if x.id not in df.columns:
                raise KeyError(x.id)
            return column(x.id)
        if isinstance(x, ast.Constant):
            return F.lit(x.value)
        if isinstance(x, ast.BoolOp):
            parts = [visit(v) for v in x.values]
            out = parts[0]
            for p in parts[1:]:
                out = out & p if isinstance(x.op, ast.And) else out | p
            return out
        if isinstance(x, ast.UnaryOp):
            v = visit(x.operand)
            if isinstance(x.op, (ast.Not, ast.Invert)):
                return ~v
            return -v if isinstance(x.op, ast.USub) else v
        if isinstance(x, ast.BinOp):
            a, b = visit(x.left), visit(x.right)
            if isinstance(x.op, ast.Div):
                return F.try_divide(a.cast("double"), b.cast("double"))
            ops = {ast.Add: lambda: a + b, ast.Sub: lambda: a - b, ast.Mult: lambda: a * b, ast.FloorDiv: lambda: floor_divide(a, b), ast.Mod: lambda: modulo(a, b), ast.Pow: lambda: power(a, b), ast.BitAnd: lambda: a & b, ast.BitOr: lambda: a | b}
            if type(x.op) not in ops:
                raise ValueError(f"operator {type(x.op).__name__} in {text!r}")
            return ops[type(x.op)]()
        if isinstance(x, ast.Compare):
            out, left = None, x.left
            for op, right in zip(x.ops, x.comparators, strict=True):
                if isinstance(op, (ast.In, ast.NotIn)):
                    one = visit(left).isin(list(ast.literal_eval(right)))
                    one = ~one if isinstance(op, ast.NotIn) else one
                else:
                    one = getattr(visit(left), COMPARE[type(op)])(visit(right))
                out, left = one if out is None else out & one, right
            return out
        raise ValueError(f"{type(x).__name__} in {text!r}")

    return visit(ast.parse(text.strip(), mode="eval"))


def query(df: DataFrame, text: str) -> DataFrame:
    """Rows for which the expression is true; rows where it is null go."""
    return df.where(translate(df, text))
