"""Row counts and column statistics of a table, in one pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ORDERED = ("int", "bigint", "float", "double", "string", "timestamp", "date", "boolean")


@dataclass(frozen=True)
class ColumnStatistics:
    distinct: int  # approximate
    least: object
    most: object


@dataclass(frozen=True)
class TableStatistics:
    rows: int
    columns: dict[str, ColumnStatistics]


def to_json(found: TableStatistics) -> dict:
    """For the catalog's log; columns whose bounds JSON can't hold keep their counts."""
    plain = lambda v: v if isinstance(v, int | float | str | None) else None
    return {"rows": found.rows, "columns": {n: [c.distinct, plain(c.least), plain(c.most)] for n, c in found.columns.items()}}


def from_json(stored: dict) -> TableStatistics:
    return TableStatistics(stored["rows"], {n: ColumnStatistics(*c) for n, c in stored["columns"].items()})


def statistics(df: DataFrame) -> TableStatistics:
    names = [n for n, kind in df.dtypes if kind in _ORDERED]
    items = [F.count(F.lit(1))]
    for n in names:
        c = F.col(f"`{n}`")
        items += [F.approx_count_distinct(c), F.min(c), F.max(c)]
    row = df.agg(*(x.alias(f"s{i}") for i, x in enumerate(items))).first()
    return TableStatistics(row[0], {n: ColumnStatistics(*row[1 + 3 * i : 4 + 3 * i]) for i, n in enumerate(names)})
