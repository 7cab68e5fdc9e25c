"""A catalog table: scans, appends, and single rows by their ids."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Mapping, Sequence
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relspark.errors import CatalogError
from relspark.types import BIGINT, BOOLEAN, FLOAT, INT, VARCHAR, Column, Schema, spark_type

if TYPE_CHECKING:
    from relspark.sources.catalog import Catalog, TableMeta

ROW_ID = "_rid"


def utf16_units(text: str) -> int:
    return len(text.encode("utf-16-le", "surrogatepass")) // 2


def checked(value: object, column: Column) -> object:
    """The value, if the column can hold it. NULL can't be held."""
    if value is None:
        raise CatalogError(f"{column.name} can't be NULL")
    whole = isinstance(value, int) and not isinstance(value, bool)
    bits = {INT: 31, BIGINT: 63}.get(column.kind)
    if bits is not None:
        ok = whole and -(1 << bits) <= value < 1 << bits
    elif column.kind == FLOAT:
        ok = whole or isinstance(value, float)
        value = float(value) if ok else value
    elif column.kind == BOOLEAN:
        ok = isinstance(value, bool)
    else:
        ok = isinstance(value, str)
    if not ok:
        raise CatalogError(f"{column.name} expects {column.kind}, not {value!r}")
    if column.kind == VARCHAR and utf16_units(value) > column.length:
        raise CatalogError(f"{column.name} exceeds VARCHAR({column.length})")
    return value


class Table:
    """A handle by table id; it always reads what the log says by then."""

    def __init__(self, catalog: Catalog, table_id: int):
        self.catalog, self.id = catalog, table_id

    @property
    def schema(self) -> Schema:
        return self.catalog.by_id(self.id).schema

    @property
    def path(self) -> str:
        return f"{self.catalog.data_dir}/{self._now().folder}"

    def _now(self) -> TableMeta:
        self.catalog.refresh()
        return self.catalog.by_id(self.id)

    def _stored(self) -> T.StructType:
        return T.StructType([T.StructField(ROW_ID, T.StringType()), *self.schema.to_spark().fields])

    def _rows(self, meta: TableMeta) -> DataFrame:
        spark = self.catalog.spark
        if not meta.folders:
            return spark.createDataFrame([], self._stored())
        return spark.read.schema(self._stored()).parquet(*(f"{self.catalog.data_dir}/{f}" for f in meta.folders))

    def scan_with_ids(self) -> DataFrame:
        return self._rows(self._now())

    def scan(self) -> DataFrame:
        return self.scan_with_ids().drop(ROW_ID)

    def tuples(self) -> Iterable[Row]:
        """Rows one after the other, a partition at a time."""
        return self.scan().toLocalIterator()

    # -- writing

    def _values(self, row: Sequence | Mapping) -> list:
        columns = self.schema.columns
        if isinstance(row, Mapping):
            lowered = {k.lower(): v for k, v in row.items()}
            row = [lowered.get(c.name.lower()) for c in columns]
        if len(row) != len(columns):
            raise CatalogError(f"a row has {len(columns)} values, not {len(row)}")
        return [checked(v, c) for v, c in zip(row, columns, strict=True)]

    def insert(self, *rows: Sequence | Mapping) -> list[str]:
        """Appends rows, all or none; returns their ids."""
        values = [self._values(r) for r in rows]
        batch = uuid.uuid4().hex
        ids = [f"{batch}:{i}" for i in range(len(values))]
        if values:
            local = [(i, *v) for i, v in zip(ids, values, strict=True)]
            self._add(self.catalog.spark.createDataFrame(local, self._stored()).coalesce(1), batch, None)
        return ids

    def _add(self, df: DataFrame, name: str, batch: str | None) -> None:
        """Writes a folder, which counts once it is logged. Of a batch, an earlier attempt's
        folder is overwritten."""
        folder = f"{self._now().folder}/b{name}"
        df.write.mode("overwrite").parquet(f"{self.catalog.data_dir}/{folder}")
        self.catalog.log_append(self.id, folder, batch)

    def append(self, df: DataFrame, batch: str | None = None) -> None:
        """Appends a DataFrame, columns by name, all or nothing. NULLs and too long texts fail
        the write. A batch's name makes it count once, however often it is appended."""
        if batch and batch in self._now().batches:
            return
        name = hashlib.md5(batch.encode(), usedforsecurity=False).hexdigest() if batch else uuid.uuid4().hex
        items = [F.concat(F.lit(f"{name}:"), F.monotonically_increasing_id().cast("string")).alias(ROW_ID)]
        items += [guarded(F.col(f"`{c.name}`"), c).alias(c.name) for c in self.schema.columns]
        self._add(df.select(*items), name, batch)

    def read(self, row_id: str) -> Row | None:
        return self.scan_with_ids().where(F.col(ROW_ID) == row_id).drop(ROW_ID).first()

    def _rewrite(self, before: TableMeta, df: DataFrame) -> None:
        folder = f"t_{self.id}/e{before.epoch + 1}/g{uuid.uuid4().hex}"
        df.write.parquet(f"{self.catalog.data_dir}/{folder}")
        try:
            self.catalog.log_rewrite(before, folder)
        except CatalogError:
            self.catalog.store.delete(folder)
            raise

    def _with_row(self, row_id: str) -> tuple[TableMeta, DataFrame]:
        before = self._now()
        rows = self._rows(before)
        if rows.where(F.col(ROW_ID) == row_id).isEmpty():
            raise CatalogError(f"No such row: {row_id}")
        return before, rows

    def update(self, row_id: str, row: Sequence | Mapping) -> str:
        """Replaces a row; it keeps its id. An error, and nothing changed, if another writer
        changes the table meanwhile."""
        values, here = self._values(row), F.col(ROW_ID) == row_id
        before, rows = self._with_row(row_id)
        new = [F.when(here, F.lit(v).cast(spark_type(c.kind))).otherwise(F.col(f"`{c.name}`")).alias(c.name) for v, c in zip(values, self.schema.columns, strict=True)]
        self._rewrite(before, rows.select(ROW_ID, *new))
        return row_id

    def delete(self, row_id: str) -> None:
        before, rows = self._with_row(row_id)
        self._rewrite(before, rows.where(F.col(ROW_ID) != row_id))


def guarded(value, column: Column):
    """The column as its declared type; a value that it can't hold raises an error."""
    out = value.cast(spark_type(column.kind))
    out = F.when(value.isNull(), F.raise_error(F.lit(f"{column.name} can't be NULL"))).otherwise(out)
    if column.kind == VARCHAR:
        units = F.octet_length(F.encode(value, "UTF-16LE")) / 2
        out = F.when(units > column.length, F.raise_error(F.lit(f"{column.name} exceeds VARCHAR({column.length})"))).otherwise(out)
    return out.cast(spark_type(column.kind))
