"""Connected components of a distributed edge list by alternating large-star and
small-star steps, which end after a few rounds of grouped minima and joins. No
neighbourhood is ever collected: minima are summed up before the shuffle, and the
joins that send them back can be split by adaptive execution where a node is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from relspark.llm.common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).union(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
    least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
    return both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("x"), F.least("u", "v").alias("y"))
    least = down.groupBy("x").agg(F.min("y").alias("m"))
    moved = down.join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.union(least.select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges: u, v (long). Returns node, component: the smallest id reachable, a
    row for each node that isn't its own component's smallest."""
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    before = None
    for _ in range(rounds):
        seen = Observation()  # tells whether edges changed, without a job of its own
        marks = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("a"), F.sum(F.xxhash64("v", "u") % 1000003).alias("b")]
        now = cut(_small_star(_large_star(now)).observe(seen, *marks), "edges")
        if seen.get == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = seen.get
    raise RuntimeError(f"no components after {rounds} rounds")


def relabelled(found: DataFrame, moved: DataFrame) -> DataFrame:
    """Components found, after those named in moved (node, component: another one's
    smallest id) have joined others."""
    new = moved.select(F.col("node").alias("component"), F.col("component").alias("_to"))
    return found.join(new, "component", "left").select("node", F.coalesce("_to", "component").alias("component")).union(moved.select("node", "component"))
