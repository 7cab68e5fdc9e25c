"""The queries of this subpackage: each applies one operator, with production
parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from relspark.llm import boosting, lm, minhash, mixing, packing, quality, sharding, suffix, topk, warc
from relspark.llm.common import table


def op1_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(topk.quantised(table(spark, sf_dir, "embeddings")), lambda vec_id: vec_id % 50 == 0, 5)


def op2_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op3_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"))


def op4_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boosting.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_minhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents"), width=2)


def op6_gru_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.log_probabilities(table(spark, sf_dir, "documents"))


def op7_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op9_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_bwt_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.measured(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pivot_topk, op2_temperature_mixing, op3_robust_outliers, op4_boosted_quality, op5_minhash_classes, op6_gru_language_model, op7_nnls_packing, op8_virtual_slots, op9_arc_to_warc, op10_bwt_repeats)}
