"""Catalog tables as ends of Structured Streaming.

The dialect itself has no streaming operators; its tables can be followed and fed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from relspark.sources.table import ROW_ID, Table


def follow(table: Table) -> DataFrame:
    """Rows of the table as it is, and those appended to it later, until rows are changed.
    Files are seen as they come, also those of an append that fails before it is logged."""
    spark = table.catalog.spark
    return spark.readStream.schema(table._stored()).option("recursiveFileLookup", "true").parquet(table.path).drop(ROW_ID)


def feed(stream: DataFrame, table: Table, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Appends a stream's batches to the table, each once, as the table's log knows them by
    checkpoint and number."""

    def write(batch: DataFrame, number: int) -> None:
        table.append(batch, f"{checkpoint}#{number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).queryName(f"feed-{uuid.uuid4().hex[:8]}")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
