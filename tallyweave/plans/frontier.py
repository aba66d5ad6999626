"""Bounded fan-out over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyweave.operators.filtering import top_per
from tallyweave.session import cut_lineage


def expand_frontier(seeds: DataFrame, edges: DataFrame, width: int = 3, depth: int = 3) -> DataFrame:
    """(seed, node, level): every node that the fan-out from each seed finds, with the first level.

    A level keeps the `width` heaviest children of each node (ties by child); the next level keeps half as
    many, rounded up. Parallel edges add up. A node with no edges adds nothing. The edges are cut to the
    widest level once, so each level joins a table of at most `width` rows per node.
    """
    summed = edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    best = cut_lineage(top_per(summed, ["src"], [F.col("weight").desc(), F.col("dst")], width, "place"))
    frontier = seeds.select("seed", F.col("seed").alias("node"))
    found = None
    if depth < 1:
        return frontier.select("seed", "node", F.lit(0).alias("level")).limit(0)
    for level in range(1, depth + 1):
        step = best.where(F.col("place") <= width).select(F.col("src").alias("node"), "dst")
        frontier = cut_lineage(frontier.join(step, "node").select("seed", F.col("dst").alias("node")).distinct())
        at_level = frontier.withColumn("level", F.lit(level))
        found = at_level if found is None else found.unionByName(at_level)
        width = -(-width // 2)
    return found.groupBy("seed", "node").agg(F.min("level").alias("level"))
