"""Sharding by fixed virtual slots.

Records are hashed into thousands of slots once and for all; only the small,
versioned slot-to-shard map changes when shards are added or drift apart. Maps are
stored, a folder per version, and documents are placed by the stored one. The
first map is built from the bytes that each slot holds, largest slot first to the
least loaded shard, so shards hold nearly equal bytes. Everything is made of
DataFrame functions; the largest thing that one task ever holds is the map.

Nulls: a null text has no bytes (size 1), a null id hashes as the text 'null'.
Repeated rows are kept, each with a place of its own. An empty table gives an
empty result. Columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relspark.llm.common import cut, scratch_path

SLOTS = 4096
SHARDS = 8


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a record: 32 bits of MD5 of its key, modulo the slot count."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")), 1, 8), 16, 10).cast("bigint") % slots


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        slot_of(F.col("doc_id"), slots).alias("virtual_slot"),
    )


def slot_totals(rows: DataFrame) -> DataFrame:
    """Bytes and rows per slot: at most `slots` rows, whatever the input."""
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("slot_bytes"), F.count(F.lit(1)).alias("slot_rows"))


def _entry() -> Column:
    return F.struct((-F.col("slot_bytes")).alias("k"), F.col("virtual_slot").alias("s"), F.col("slot_rows").alias("r"))


def _filled(gathered: DataFrame) -> DataFrame:
    """Slots (array of entries) by falling bytes (ties: smaller slot), each to the shard
    with the fewest bytes so far (ties: smaller shard); load: bytes that shards begin with.
    The fold runs over one array with an entry per slot, a fixed bound."""
    start = F.struct("load", F.array().cast("array<struct<shard:int,virtual_slot:bigint,slot_bytes:bigint,slot_rows:bigint>>").alias("out"))

    def place(state: Column, x: Column) -> Column:
        at = F.array_position(state["load"], F.array_min(state["load"])).cast("int")
        load = F.transform(state["load"], lambda v, i: F.when(i + 1 == at, v - x["k"]).otherwise(v))
        row = F.struct((at - 1).alias("shard"), x["s"].alias("virtual_slot"), (-x["k"]).alias("slot_bytes"), x["r"].alias("slot_rows"))
        return F.struct(load.alias("load"), F.concat(state["out"], F.array(row)).alias("out"))

    return gathered.select("version", F.explode(F.aggregate("slots", start, place, lambda s: s["out"])).alias("o")).select("version", "o.*")


def build_map(totals: DataFrame, shards: int = SHARDS, version: int = 1) -> DataFrame:
    """A slot-to-shard map made from nothing."""
    gathered = totals.agg(F.array_sort(F.collect_list(_entry())).alias("slots")).withColumns({"load": F.array_repeat(F.lit(0).cast("bigint"), shards), "version": F.lit(version)})
    return _filled(gathered)


def rebalanced(slot_map: DataFrame, totals: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The next version of a map whose slots hold other bytes by now. Shards above the mean
    give up slots, in hash order, as long as these fit into what is above it; given-up slots
    and new ones go, the largest first, to the shard with the fewest bytes. All other slots
    stay where they are."""
    now = totals.join(F.broadcast(slot_map.select("virtual_slot", "shard", "version")), "virtual_slot", "left")
    whole, everything = Window.partitionBy("shard"), Window.partitionBy(F.lit(0))  # a row per slot
    order = whole.orderBy(slot_of(F.col("virtual_slot")), "virtual_slot")
    size = F.col("slot_bytes")
    loose = now.withColumns(
        {
            "version": F.max("version").over(everything) + 1,
            "loose": F.col("shard").isNull() | (F.sum(size).over(order) <= F.sum(size).over(whole) - F.sum(size).over(everything) / shards),
        }
    ).withColumn("held", F.sum(F.when(~F.col("loose"), size).otherwise(0)).over(whole))
    gathered = loose.agg(
        F.array_sort(F.collect_list(F.when(F.col("loose"), _entry()))).alias("slots"),
        F.map_from_entries(F.collect_set(F.when(F.col("shard").isNotNull(), F.struct("shard", "held")))).alias("held"),
        F.max("version").alias("version"),
    )
    load = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.coalesce(F.col("held")[i], F.lit(0).cast("bigint")))
    stay = loose.where("not loose").select("version", "shard", "virtual_slot", "slot_bytes", "slot_rows")
    return stay.union(_filled(gathered.withColumn("load", load)).select("version", "shard", "virtual_slot", "slot_bytes", "slot_rows"))


def add_shard(slot_map: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The next version of a map for one more shard: from each shard, slots in
    hash order move to the new shard as long as they fit into a share of
    1 / (shards + 1) of that shard's bytes. No slot moves between old shards."""
    order = Window.partitionBy("shard").orderBy(slot_of(F.col("virtual_slot")), "virtual_slot")
    whole = Window.partitionBy("shard")
    moved = F.sum("slot_bytes").over(order) * (shards + 1) <= F.sum("slot_bytes").over(whole)
    return slot_map.select(
        (F.col("version") + 1).alias("version"),
        F.when(moved, F.lit(shards)).otherwise(F.col("shard")).alias("shard"),
        "virtual_slot",
        "slot_bytes",
        "slot_rows",
    )


_MAP = "shard int, virtual_slot bigint, slot_bytes bigint, slot_rows bigint, version int"


def write_map(slot_map: DataFrame, path: str, version: int) -> None:
    """Stores a version of the map in a folder of its own; earlier versions stay readable.
    A version that is written again, by a job that is retried, replaces itself."""
    slot_map.where(F.col("version") == version).drop("version").coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The stored map, of the latest version or the one asked for."""
    stored = spark.read.schema(_MAP).parquet(path)
    if version is None:
        latest = stored.agg(F.max("version").alias("version"))
        stored = stored.join(F.broadcast(latest), "version")
    else:
        stored = stored.where(F.col("version") == version)
    return stored.select("version", "shard", "virtual_slot", "slot_bytes", "slot_rows")


def assign(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Rows with shard and place in the shard, gapless from 0.

    A slot's rows are numbered in the slot; a prefix sum over the map (a row
    per slot) gives where the slot begins in its shard. No task sorts a shard.
    The map has at most `slots` rows, so it is broadcast."""
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slot_map.select("version", "shard", "virtual_slot", F.coalesce(F.sum("slot_rows").over(before), F.lit(0)).alias("slot_start"))
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("place", F.row_number().over(within) - 1)
    return numbered.join(F.broadcast(starts), "virtual_slot").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("slot_start") + F.col("place")).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        F.col("version").alias("map_version"),
    )


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """Documents with their shards. The map is stored under path (default: the scratch
    folder) as version 1, or, where maps are stored there already, edited for the bytes
    that slots hold now and stored as the next; documents go by the stored map. The sized
    rows are cut once, so texts are read once for both the totals and the assignment."""
    spark = docs.sparkSession
    rows = cut(sized(docs, slots), "sized")
    totals, version = slot_totals(rows), 1
    if path is None:
        path = scratch_path(spark, "slot-maps")
        new = build_map(totals, shards)
    else:
        last = latest_version(spark, path)
        version = last + 1
        new = rebalanced(read_map(spark, path, last), totals, shards) if last else build_map(totals, shards)
    write_map(new, path, version)
    return assign(rows, read_map(spark, path, version))


def latest_version(spark: SparkSession, path: str) -> int:
    """0 where no map is stored."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return (spark.read.schema(_MAP).parquet(path).agg(F.max("version")).first()[0] or 0) if fs.exists(where) else 0
