"""Connected components over an edge table, by alternating large-star and small-star steps.

Every step is a minimum per node (combined map-side) and a join with those minima; no
neighbour list, component or edge set is ever collected in one task or on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestore.session import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over (a > b) edges, each once."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        out = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = edges.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    return out.filter("a > b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges(a long, b long)``; component is the smallest node reachable.

    Nulls and self-loops are ignored; repeated edges count once; no edges give no rows.
    The loop ends when the edge set no longer changes (then every edge joins a node to its
    component's smallest node); ``max_rounds`` only guards against a defect and raises.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    now = materialize(now, "cc")
    mark = None
    for _ in range(max_rounds):
        nxt = materialize(_star(_star(now, True), False), "cc")
        discard(now)
        now = nxt
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark or seen[0] == 0:
            break
        mark = seen
    else:
        raise RuntimeError("connected components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
