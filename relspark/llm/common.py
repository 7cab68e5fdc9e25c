"""Helpers that all operators of this subpackage share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, as a character class of either engine.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
_SCRATCH: dict[str, str] = {}


#: Bytes of an Arrow batch on its way to Python; a single longer text is a batch of its own.
BATCH_BYTES = "4m"


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the batches that Python workers get by bytes, as texts may be long, and
    sees to it that the workers can import this package."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    ship_package(spark)


def ship_package(spark: SparkSession) -> None:
    """Sends the package to the executors, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SCRATCH:
        return
    _SCRATCH[sc.applicationId] = "shipped"
    package = Path(__file__).resolve().parent.parent
    archive = os.path.realpath(tempfile.mkdtemp(prefix="relspark-code-")) + "/relspark-code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    sc.addPyFile(archive)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the
    session, or, where that is unset and driver and executors are one process (tests), a
    folder of our own. A cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = _SCRATCH.setdefault("own", tempfile.mkdtemp(prefix="relspark-"))
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    app = spark.sparkContext.applicationId
    root = f"{shared_dir(spark)}/relspark-{app}"
    if root not in _SCRATCH:
        _SCRATCH[root] = root
        atexit.register(_remove, spark, root)
    return f"{root}/{label}-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder through Hadoop, if the session is still up."""
    sc = spark.sparkContext
    if sc._jsc is None or sc._jsc.sc().isStopped():
        return
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage: writes df as a table in the shared folder and reads it
    back, so that a lost executor costs only the tasks that ran on it."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words_of(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def in_class(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id's decimal text leaves the remainder."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


def hashed_share(key: Column, share: float) -> Column:
    """Whether a row is among the given share of all, by the hash of its key."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 30)) < max(1, int(min(1.0, share) * (1 << 30)))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---- sets of ids of bounded size --------------------------------------------

#: Bits of a filter: FILTER_SHARE for each id, FILTER_BITS at most (16 MB).
FILTER_SHARE = 16
FILTER_BITS = 1 << 27


@dataclass(frozen=True)
class IdFilter:
    """A bitmap of hashed ids, or, where there are too many for one, nothing."""

    bits: int
    bitmap: bytes | None


def id_filter(ids: DataFrame, most_bits: int = FILTER_BITS) -> IdFilter:
    """A filter of ids (column id, long), as large as their number asks for. It may let
    through more ids than were put in, so it serves to leave out most of what a join would
    drop, never to decide. Above most_bits / 4 ids there is none, and joins get all rows:
    a table in which so many rows are touched is shuffled once. bits / 64 words at most are
    sent to the driver."""
    n = ids.agg(F.approx_count_distinct("id")).first()[0]
    bits = 1 << max(16, (FILTER_SHARE * n - 1).bit_length())
    if n > most_bits // 4:
        return IdFilter(0, None)
    bits = min(bits, most_bits)
    at = F.pmod(F.xxhash64("id"), F.lit(bits))
    words = ids.select((at / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (at % 64).cast("int")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(bits // 64, np.int64)
    found = words.toArrow()
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return IdFilter(bits, out.tobytes())


def maybe_in(df: DataFrame, ids: IdFilter, member: bool = True, key: str = "doc_id") -> DataFrame:
    """Rows of df whose key may be among the ids, or those that surely aren't."""
    if ids.bitmap is None:
        return df if member else df.where(F.lit(False))
    held = df.sparkSession.sparkContext.broadcast(ids.bitmap)
    columns = df.columns

    def keep(batches):
        words = np.frombuffer(held.value, np.int64)
        for batch in batches:
            at = batch.column("_at").to_numpy()
            inside = (words[at >> 6] >> (at & 63) & 1).astype(bool)
            yield batch.select(columns).filter(pa.array(inside if member else ~inside))

    at = F.pmod(F.xxhash64(key), F.lit(ids.bits)).cast("bigint")
    return df.withColumn("_at", at).mapInArrow(keep, df.schema)
