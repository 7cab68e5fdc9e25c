"""The five aggregate functions. Spark computes partial results before the shuffle."""

from __future__ import annotations

from pyspark.sql import functions as F

from relspark.functions.scalar import Typed, TypeMismatch
from relspark.types import BIGINT, DOUBLE, FLOAT, INT, NUMBERS

AGGREGATES = frozenset({"COUNT", "SUM", "AVG", "MIN", "MAX"})


def is_aggregate(name: str) -> bool:
    return name.upper() in AGGREGATES


def aggregate(name: str, argument: Typed | None) -> Typed:
    """argument None: COUNT(*). Sums of whole numbers are BIGINT, of FLOATs FLOAT
    (summed in 64 bits); averages are FLOAT, of outside DOUBLE columns DOUBLE."""
    name = name.upper()
    if name not in AGGREGATES:
        raise TypeMismatch(f"No such aggregate: {name}")
    if name == "COUNT":
        return Typed(F.count(F.lit(1) if argument is None else argument.column), BIGINT)
    if argument is None:
        raise TypeMismatch("An aggregate takes one argument")
    if name in ("MIN", "MAX"):
        return Typed((F.min if name == "MIN" else F.max)(argument.column), argument.kind, argument.length)
    if argument.kind not in NUMBERS:
        raise TypeMismatch(f"{name} wants a number, not {argument.kind}")
    if name == "SUM":
        total = F.sum(argument.column)
        return Typed(total, BIGINT) if argument.kind in (INT, BIGINT) else Typed(total, DOUBLE) if argument.kind == DOUBLE else Typed(total.cast("float"), FLOAT)
    mean = F.avg(argument.column)
    return Typed(mean, DOUBLE) if argument.kind == DOUBLE else Typed(mean.cast("float"), FLOAT)
