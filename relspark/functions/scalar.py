"""Typed scalar expressions: the dialect's rules as Spark columns.

Where these rules differ from Spark's: integer literals are BIGINT; arithmetic has the
wider type of its operands, FLOAT being 32 bits; integer division truncates; FLOAT
division by zero is infinite or NaN; a FLOAT operand makes a comparison one of FLOATs;
BOOLEAN and text compare as text; numbers compare with nothing but numbers.

Known differences that are kept: integer overflow is an error (as is division of an
integer by zero); -0.0 equals 0.0; text is ordered by code point.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from relspark.types import BIGINT, BOOLEAN, DOUBLE, FLOAT, INT, NUMBERS, STRING, TEXTS, spark_type, wider


class TypeMismatch(ValueError):
    """Operands that an operator doesn't take."""


@dataclass(frozen=True)
class Typed:
    """A Spark column and the dialect's type of it."""

    column: Column
    kind: str
    length: int | None = None

    def to(self, kind: str) -> Column:
        return self.column if self.kind == kind else self.column.cast(spark_type(kind))


_ARITHMETIC = {"+": operator.add, "-": operator.sub, "*": operator.mul}
_COMPARISONS = {"=": operator.eq, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def literal(value: int | str | bool | float) -> Typed:
    if isinstance(value, bool):
        return Typed(F.lit(value), BOOLEAN)
    if isinstance(value, int):
        return Typed(F.lit(value).cast(spark_type(BIGINT)), BIGINT)
    if isinstance(value, float):
        return Typed(F.lit(value).cast(spark_type(FLOAT)), FLOAT)
    return Typed(F.lit(value), STRING)


def _divided(a: Column, b: Column, kind: str) -> Column:
    if kind in (INT, BIGINT):
        return F.call_function("div", a, b)
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when(F.isnan(a), a).when(a > 0, float("inf")).when(a < 0, float("-inf")).otherwise(float("nan"))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def arithmetic(symbol: str, a: Typed, b: Typed) -> Typed:
    if symbol == "||":
        return concat(a, b)
    if a.kind not in NUMBERS or b.kind not in NUMBERS:
        raise TypeMismatch(f"Arithmetic wants numbers, not {a.kind} and {b.kind}")
    kind = wider(a.kind, b.kind)
    left, right = a.to(kind), b.to(kind)
    value = _divided(left, right, kind) if symbol == "/" else _ARITHMETIC[symbol](left, right)
    return Typed(value.cast(spark_type(kind)), kind)


def concat(a: Typed, b: Typed) -> Typed:
    """Both sides as text, joined. It has no syntax in the dialect's SQL."""
    return Typed(F.concat(a.column.cast("string"), b.column.cast("string")), STRING)


def comparison(symbol: str, a: Typed, b: Typed) -> Typed:
    if a.kind in NUMBERS and b.kind in NUMBERS:
        kinds = (a.kind, b.kind)
        kind = DOUBLE if DOUBLE in kinds else FLOAT if FLOAT in kinds else None
        left, right = (a.to(kind), b.to(kind)) if kind else (a.column, b.column)
    elif a.kind == b.kind or (a.kind in TEXTS and b.kind in TEXTS):
        left, right = a.column, b.column
    elif {a.kind, b.kind} & set(TEXTS) and BOOLEAN in (a.kind, b.kind):
        left, right = a.column.cast("string"), b.column.cast("string")
    else:
        raise TypeMismatch(f"Can't compare {a.kind} with {b.kind}")
    return Typed(_COMPARISONS[symbol](left, right), BOOLEAN)


def _boolean(x: Typed, symbol: str) -> Column:
    if x.kind != BOOLEAN:
        raise TypeMismatch(f"{symbol} wants BOOLEAN, not {x.kind}")
    return x.column


def logical(symbol: str, a: Typed, b: Typed) -> Typed:
    left, right = _boolean(a, symbol), _boolean(b, symbol)
    return Typed(left & right if symbol == "AND" else left | right, BOOLEAN)


def negation(a: Typed) -> Typed:
    return Typed(~_boolean(a, "NOT"), BOOLEAN)
