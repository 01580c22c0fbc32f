"""Connected components of an edge table, by contraction.

Every node points to its smallest neighbour if that is smaller than itself; pointers are doubled until they reach a root,
the edges between roots are contracted, and so on until no edge is left.  A path of n nodes takes log2(n) doublings,
and each contraction leaves at most a part of the nodes that still have edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut_lineage, release


def _doubled(pointers: DataFrame) -> DataFrame:
    """Pointers (node, root) that reach the last root of their chain."""
    while True:
        at = pointers.select(F.col("node").alias("root"), F.col("root").alias("next"))
        stepped = cut_lineage(pointers.join(at, "root", "left").select(
            "node", F.coalesce("next", "root").alias("root"), (F.col("next") < F.col("root")).alias("moved")))
        release(pointers)
        pointers = stepped
        if pointers.where("moved").isEmpty():
            return pointers


def connected_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) for every row of ``nodes`` (node: long); edges: a, b (any direction,
    loops and repeats allowed, both ends among the nodes)."""
    known = nodes.select("node", F.col("node").alias("root")).distinct()
    while True:
        both = edges.where("a <> b").select("a", "b")
        both = cut_lineage(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
        if both.isEmpty():
            return known
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b"))
        roots = _doubled(cut_lineage(least.select("node", F.least("node", "b").alias("root"))))
        to = roots.select(F.col("node").alias("root"), F.col("root").alias("top"))
        known = cut_lineage(known.join(to, "root", "left").select("node", F.coalesce("top", "root").alias("root")))
        edges = both.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(
            roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b").select(
            F.col("ra").alias("a"), F.col("rb").alias("b"))
