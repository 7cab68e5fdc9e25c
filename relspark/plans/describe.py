"""A bound query as text: which operators there are, from the result down to the scans."""

from __future__ import annotations

from relspark.plans.binder import BoundSelect
from relspark.sql import tree


def expression(e: tree.Expression) -> str:
    match e:
        case tree.Literal():
            return f"'{e.value}'" if isinstance(e.value, str) else str(e.value).upper()
        case tree.Reference():
            return f"{e.qualifier}.{e.name}" if e.qualifier else e.name
        case tree.Negation():
            return f"NOT {expression(e.operand)}"
        case tree.Call():
            return f"{e.name}({'*' if e.star else ', '.join(map(expression, e.arguments))})"
    return f"({expression(e.left)} {e.operator} {expression(e.right)})"


def describe(query: BoundSelect) -> str:
    """For example Project[id](Filter[(age > 20)](Scan users))."""
    scans = [f"Scan {x.table}" + (f" AS {x.shown}" if x.shown != x.table else "") for x in query.inputs]
    out = scans[0]
    for on, scan in zip(query.joins, scans[1:], strict=True):
        out = f"Join[{' AND '.join(map(expression, on)) or 'TRUE'}]({out}, {scan})"
    if query.residual:
        out = f"Filter[{' AND '.join(map(expression, query.residual))}]({out})"
    if query.outputs is None:
        return out
    names = ", ".join(o.name for o in query.outputs)
    return f"Aggregate[{len(query.groups)} keys: {names}]({out})" if query.groups is not None else f"Project[{names}]({out})"
