"""Connected components by alternating large-star and small-star steps.

Each step is a shuffle-and-aggregate over the edges alone; nothing is
collected and every round is written to the shared folder, so a lost
executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.llm.scratch import cut


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the undirected `edges` (a, b).

    component is the smallest node id that can be reached.  Self-links and
    repeated links are ignored; null ends are ignored; no edges give no rows.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = cut(_small(e))
    for _ in range(rounds):
        # a forest of stars: no node has two targets and no target has one itself
        seen = e.select(F.col("u").alias("n"), F.lit(1).alias("as_u"), F.lit(0).alias("as_v")).unionByName(
            e.select(F.col("v").alias("n"), F.lit(0).alias("as_u"), F.lit(1).alias("as_v")))
        if seen.groupBy("n").agg(F.sum("as_u").alias("us"), F.max("as_v").alias("vs")).where("us > 1 or (us = 1 and vs = 1)").isEmpty():
            break
        e = cut(_small(_large(e)))
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
