"""The dialect's types and schemas, and how they map to Spark's.

Six types can be declared; none of them holds NULL. Columns of outside Parquet tables
may have other types, which are carried along: DOUBLE counts as a number wider than
FLOAT, everything else can only be selected, grouped and compared with its own kind.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from relspark.errors import CatalogError

INT, BIGINT, FLOAT, DOUBLE = "INT", "BIGINT", "FLOAT", "DOUBLE"
BOOLEAN, STRING, VARCHAR = "BOOLEAN", "STRING", "VARCHAR"
DECLARABLE = (INT, BIGINT, BOOLEAN, FLOAT, STRING, VARCHAR)
#: Numbers from narrow to wide; arithmetic takes the wider type of its operands.
NUMBERS = (INT, BIGINT, FLOAT, DOUBLE)
TEXTS = (STRING, VARCHAR)

_SPARK = {
    INT: T.IntegerType(),
    BIGINT: T.LongType(),
    BOOLEAN: T.BooleanType(),
    FLOAT: T.FloatType(),
    DOUBLE: T.DoubleType(),
    STRING: T.StringType(),
    VARCHAR: T.StringType(),
}
_NAMES = {"int": INT, "bigint": BIGINT, "boolean": BOOLEAN, "float": FLOAT, "double": DOUBLE, "string": STRING, "smallint": INT, "tinyint": INT}


def wider(a: str, b: str) -> str:
    return max(a, b, key=NUMBERS.index)


def spark_type(kind: str) -> T.DataType:
    return _SPARK[kind]


def kind_of(data_type: T.DataType) -> str:
    """The dialect's name for a Spark type; types beyond it keep Spark's name."""
    name = data_type.simpleString()
    return VARCHAR if name.startswith("varchar") else _NAMES.get(name, name)


@dataclass(frozen=True)
class Column:
    name: str
    kind: str
    length: int | None = None

    def __post_init__(self) -> None:
        if not self.name:
            raise CatalogError("a column needs a name")
        if self.kind == VARCHAR and not (self.length and self.length > 0):
            raise CatalogError(f"a VARCHAR is one unit long at least: {self.name}")
        if self.kind != VARCHAR and self.length is not None:
            raise CatalogError(f"{self.kind} has no length: {self.name}")


@dataclass(frozen=True)
class Schema:
    columns: tuple[Column, ...]

    def __post_init__(self) -> None:
        if not self.columns:
            raise CatalogError("a schema needs a column")
        seen: set[str] = set()
        for c in self.columns:
            if c.name.lower() in seen:
                raise CatalogError(f"Duplicate column: {c.name}")
            seen.add(c.name.lower())

    @staticmethod
    def of(*columns: tuple) -> Schema:
        """Schema.of(("id", "INT"), ("name", "VARCHAR", 10))"""
        return Schema(tuple(Column(*c) for c in columns))

    @staticmethod
    def from_spark(struct: T.StructType) -> Schema:
        return Schema(tuple(Column(f.name, STRING if (k := kind_of(f.dataType)) == VARCHAR else k) for f in struct.fields))

    def find(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name.lower() == name.lower()), None)

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def to_spark(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, spark_type(c.kind), True) for c in self.columns])
