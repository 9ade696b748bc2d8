"""Connected components of a graph of any size: alternating large and small stars.

Each round is two joins and aggregations over the edges, written to the shared folder so that the
lineage stays short and a lost executor costs one round at most. Minima are combined before the
shuffle; the joins leave a hub's edges to adaptive skew splitting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from standflow.session import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = both.join(least, "u").where("v > u")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return moved.unionByName(own).where("u != v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v), both long: root is the component's smallest
    node. Self-loops and repeated edges are ignored; no edges give no rows."""
    edges = materialise(edges.where("u != v").distinct(), "edges")
    before = None
    while True:
        edges = materialise(_small_star(_large_star(edges)), "edges")
        state = edges.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if state == before:
            break
        before = state
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return nodes.unionByName(roots)
