"""Connected components by alternating large-star and small-star.

Works on an edge table alone: each step finds every node's least neighbour with map-side
minima and joins it back to the edges, so no node's neighbours are ever gathered in one
task. Every step is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bondflow.llm import shared


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b) with a > b. Large: neighbours above a node move to its least neighbour; small: those below do, and the node itself."""
    down = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    near = down.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))) if large else down
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    least, _ = shared.kept(least, "least")  # written, so that Spark can split a hot node in the join
    moved = near.join(least, "u")
    moved = moved.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if large else moved.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    moved = moved.where("a <> b")
    return moved if large else moved.distinct()  # what a large step repeats, the small step after it merges


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """From edges (a, b) of any direction: (node, component) for every node of an edge; a component is named by its least node."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, path = shared.kept(edges, "edges")
    mark = _mark(edges)
    while True:
        large, between = shared.kept(_star(edges, True), "edges")
        shared.delete(edges.sparkSession, path)
        edges, path = shared.kept(_star(large, False), "edges")
        shared.delete(edges.sparkSession, between)
        if (new := _mark(edges)) == mark:
            break
        mark = new
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
