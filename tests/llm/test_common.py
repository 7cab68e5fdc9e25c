from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from relspark.llm import common


@pytest.mark.parametrize("n", [0, 1, 5000, 300_000])
def test_a_filter_is_as_large_as_its_ids_ask_for(spark, n):
    """All ids pass, and of the others few, also beyond the least number of bits."""
    ids = common.id_filter(spark.range(n).select((F.col("id") * 3).alias("id")))
    rows = spark.range(1_000_000, numPartitions=4).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    inside, outside = common.maybe_in(rows, ids), common.maybe_in(rows, ids, member=False)
    wanted = inside.where((F.col("doc_id") % 3 == 0) & (F.col("doc_id") < 3 * n)).count()
    assert wanted == n
    kept = inside.count()
    assert kept + outside.count() == 1_000_000
    assert kept - n < 0.13 * 1_000_000


def test_beyond_its_bound_there_is_no_filter(spark):
    """More ids than a bounded filter serves: joins get all rows, none is lost."""
    ids = common.id_filter(spark.range(100_000), most_bits=1 << 16)
    assert ids.bitmap is None
    rows = spark.range(1000).select(F.col("id").alias("doc_id"))
    assert common.maybe_in(rows, ids).count() == 1000
    assert common.maybe_in(rows, ids, member=False).count() == 0


def test_a_cluster_must_name_its_shared_folder(spark):
    class Elsewhere:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: Elsewhere.conf)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Elsewhere)
