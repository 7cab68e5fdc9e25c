"""Planning: a bound query as one DataFrame, which Catalyst optimises.

Scans, filters, joins, grouping and projection are plain DataFrame operations; pushdown,
pruning, join order, join algorithms, partial aggregation and spilling are Spark's. A
strategy names the join algorithm to ask for instead, to compare them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relspark.operators import relational as ops
from relspark.plans.binder import BoundSelect


def plan_select(query: BoundSelect, scan: Callable[[str], DataFrame], strategy: str | None = None) -> DataFrame:
    """scan gives a table's DataFrame; strategy is one of relational.STRATEGIES."""
    typed = query.scope.typed

    def source(i: int) -> DataFrame:
        one = query.inputs[i]
        df = scan(one.table)
        return df.toDF(*(one.internal(c) for c in one.schema.columns))

    if query.outputs is None and not query.residual:
        return scan(query.inputs[0].table)
    df = source(0)
    for i, on in enumerate(query.joins, 1):
        condition = reduce(lambda a, b: a & b, (typed(e).column for e in on)) if on else None
        df = ops.join(df, source(i), condition, strategy)
    for e in query.residual:
        df = ops.select_rows(df, typed(e).column)
    if query.outputs is None:
        one = query.inputs[0]
        return ops.project(df, [(F.col(f"`{one.internal(c)}`"), c.name) for c in one.schema.columns])
    if query.groups is None:
        return ops.project(df, [(o.value.column, o.name) for o in query.outputs])
    # A value that its group determines is the key itself, or that of any row of the group.
    items = [(o.key if o.key is not None else F.first(o.value.column) if o.constant_in_group else o.value.column, o.name) for o in query.outputs]
    return ops.aggregate(df, [g.column for g in query.groups], items)
