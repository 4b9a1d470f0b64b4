"""G1: connected components by alternating large-star and small-star steps.

Each step is one aggregation and one equi-join on the edge list. The list is cut off from its lineage by a
table written to the shared folder, and its state is compared by a count and an order-free hash sum, so no
edge ever reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from kgloom.session import discard, staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with v < u. Returns edges of the same form, with the same components.

    The join's key is a struct of u: the aggregated side's own partitioning is then no answer to it, both sides come from
    plain exchanges, and Spark splits the partition of a hub.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    pairs = both.withColumn("k", F.struct("u")).join(low.select(F.struct("u").alias("k"), "m"), "k").drop("k")
    if large:
        moved = pairs.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = pairs.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return moved.where("u != v")


def _kept(spark: SparkSession, edges: DataFrame, label: str) -> tuple[DataFrame, tuple]:
    """The distinct edges as a staged table, and their count and hash sum, observed while they are written."""
    seen = Observation()
    out = staged(spark, edges.distinct().observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), label)
    return out, (seen.get["n"], seen.get["h"])


def connected_components(spark: SparkSession, edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node reachable. Nodes without an edge do not occur.

    Null endpoints and self-loops are ignored, repeated and mirrored edges count once. Raises RuntimeError
    when max_rounds are not enough; a partial answer is never returned.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a != b")
    e, before = _kept(spark, e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    for _ in range(max_rounds):
        if not before[0]:
            break
        last = e
        e, after = _kept(spark, _star(_star(last, True), False), "stars")
        discard(last)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
