"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum and a join on the vertex, so a hub's edges can
be split by the skewed-join handling; nothing is collected but a count a round.
Edges that are stars already, as forests are, take no round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltlake.llm.common import drop_materialised, join_key, materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.where("v < u")
    lowest = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    near, by = near.withColumn("j", join_key("u")), lowest.select(join_key("u").alias("j"), "m")
    if large:
        linked = near.where("v > u").join(by, "j").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = near.join(by, "j").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v")))
    return linked.where("u != v").distinct()


def _unsettled(edges: DataFrame) -> int:
    """How many vertices keep distinct edges (u, v) from being stars around roots: those of two edges up, and of edges both up and down."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("root")))
    return ends.groupBy("x").agg((F.sum("up") + F.max("root")).alias("n")).agg(F.count_if(F.col("n") > 1)).first()[0]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``vertex``, ``component`` (its least vertex) for every vertex of ``edges`` (u, v as long); self-loops and nulls are ignored."""
    now = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct())
    for _ in range(max_rounds):
        if not _unsettled(now):
            break
        new = materialise(_star(_star(now, True), False))
        drop_materialised(now.sparkSession, now)
        now = new
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct())
