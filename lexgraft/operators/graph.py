"""Closures over typed edges: a loop of joins with a visited set, each hop a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgraft.sources.files import kept


def closure(start: DataFrame, edges: DataFrame, depth: int | None = None) -> DataFrame:
    """(root, node, hops): what start (root) reaches over edges (src, dst), itself at 0; cycles are visited once.

    Each hop is a written table in the shared scratch folder; those before it are read, never written again.
    """
    seen = front = kept(start.select("root", F.col("root").alias("node"), F.lit(0).alias("hops")).distinct())
    hops = 0
    while depth is None or hops < depth:
        hops += 1
        step = front.join(edges, front.node == edges.src).select("root", F.col("dst").alias("node")).distinct()
        front = kept(step.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("hops", F.lit(hops)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen
