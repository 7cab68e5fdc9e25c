"""relspark: a PySpark-native relational engine with a strict SQL dialect."""

from relspark.engine import Engine, EngineConfig
from relspark.errors import BindError, CatalogError, ParseError, SqlError
from relspark.types import Column, Schema

__all__ = ["BindError", "CatalogError", "Column", "Engine", "EngineConfig", "ParseError", "Schema", "SqlError"]
