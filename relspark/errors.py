"""Errors of the dialect. Each knows where in the statement it arose."""

from __future__ import annotations

from typing import NamedTuple


class Position(NamedTuple):
    """Line and column, both from 1."""

    line: int
    column: int


class SqlError(ValueError):
    """A statement that can't be parsed or bound."""

    def __init__(self, message: str, position: Position | None = None):
        super().__init__(f"{message} at {position.line}:{position.column}" if position else message)
        self.message, self.position = message, position


class ParseError(SqlError):
    """The text isn't a statement of the dialect."""


class BindError(SqlError):
    """Names, types or shapes don't fit the catalog."""


class CatalogError(ValueError):
    """A table operation that the catalog refuses."""
