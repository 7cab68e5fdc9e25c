"""Project, filter, join and aggregate over DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Join algorithms by name, and the hint that asks Spark for each. Without a strategy
#: Spark decides by size, and broadcasts only what it has measured to be small. Asked to
#: broadcast, it does so up to BROADCAST_BYTES by its own estimate; beyond, it decides.
STRATEGIES = {
    "nested_loop": "shuffle_replicate_nl",
    "hash": "shuffle_hash",
    "sort_merge": "merge",
    "broadcast": "broadcast",
}
BROADCAST_BYTES = 256 << 20


def estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def project(df: DataFrame, items: Sequence[tuple[Column, str]]) -> DataFrame:
    return df.select(*(value.alias(name) for value, name in items))


def select_rows(df: DataFrame, condition: Column) -> DataFrame:
    return df.filter(condition)


def cross(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.crossJoin(right)


def join(left: DataFrame, right: DataFrame, condition: Column | None, strategy: str | None = None) -> DataFrame:
    """Inner join; every pair, if there is no condition. The strategy is for the right
    side, and is a wish: Spark can't hash or merge without an equality."""
    if strategy and not (strategy == "broadcast" and estimated_bytes(right) > BROADCAST_BYTES):
        right = right.hint(STRATEGIES[strategy])
    return left.join(right, condition, "inner") if condition is not None else cross(left, right)


def distinct_keys(df: DataFrame, keys: Sequence[tuple[Column, str]]) -> DataFrame:
    return project(df, keys).distinct()


def aggregate(df: DataFrame, keys: Sequence[Column], items: Sequence[tuple[Column | int, str]]) -> DataFrame:
    """Groups by keys and keeps only items: aggregates, or the numbers of keys. Without keys
    there is one row, even for an empty input."""
    named = [value.alias(f"{i}\x1fout") for i, (value, _) in enumerate(items) if not isinstance(value, int)]
    grouped = df.groupBy(*(k.alias(f"{i}\x1fkey") for i, k in enumerate(keys))) if keys else df.groupBy()
    rows = grouped.agg(*named) if named else grouped.agg(F.count(F.lit(1)))
    place = lambda i, value: f"`{value}\x1fkey`" if isinstance(value, int) else f"`{i}\x1fout`"
    return rows.select(*(F.col(place(i, value)).alias(name) for i, (value, name) in enumerate(items)))
