"""The relational operators, as functions of DataFrames."""

from relspark.operators.relational import STRATEGIES, aggregate, cross, distinct_keys, join, project, select_rows

__all__ = ["STRATEGIES", "aggregate", "cross", "distinct_keys", "join", "project", "select_rows"]
