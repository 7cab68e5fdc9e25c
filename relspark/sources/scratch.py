"""Where queries that write keep their tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: list[str] = []


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder in the one that driver and executors share, spark.checkpoint.dir;
    where that is unset and both are one process, as in tests, in a folder of our own."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="relspark-tables-"))
        shared = _OWN[0]
    return f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"
