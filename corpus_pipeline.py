"""From raw documents to packed training sequences, in five stages.

Each stage takes all that its predecessor kept. Between stages documents are written
as Parquet in the shared folder and read again, so a lost executor never costs more
than the stage that is running.

1. quality: documents that the base rules or the robust outlier test reject go.
2. near_duplicates: one document of each near-duplicate class, by shingles of five
   words, stays.
3. repeats: passages of 100 bytes and more that occurred before are cut out.
4. mixing: sources are mixed by temperature; every document is emitted at least once,
   small sources up to twice.
5. packing: documents are tokenised and packed into sequences of 2048.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from relspark.llm import minhash, mixing, packing, quality, suffix
from relspark.llm.common import bounded_batches, cut, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return quality.reject(docs)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return minhash.deduplicate(docs)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return suffix.remove(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("repeats", repeats_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Tokenising can't be expressed in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
