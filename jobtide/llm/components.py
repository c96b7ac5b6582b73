"""Connected components of a graph given as edges, by hooking and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .workspace import Workspace


def _relabel(edges: DataFrame, parent: DataFrame) -> DataFrame:
    """Edges between the roots of their ends, without loops and repeats."""
    for end in ("a", "b"):
        edges = edges.join(parent.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")), end)
    a, b = F.col("a_root"), F.col("b_root")
    return edges.where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _flatter(parent: DataFrame) -> DataFrame:
    """Every node under its root's root."""
    above = parent.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return parent.join(above, "root").select("node", F.col("top").alias("root"))


def components(work: Workspace, edges: DataFrame, name: str) -> DataFrame:
    """node, root (the smallest node of its component) for every node that has an edge (columns a, b).

    Each round lets every node hook on its smallest neighbour, flattens the trees by doubling, and
    contracts them; rounds go on until no edge is left.  A node with many neighbours is aggregated where its
    edges lie before anything is shuffled, and no list of neighbours is ever made.
    """
    a, b = F.col("a"), F.col("b")
    ordered = edges.where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    open_, trees = work.settle_narrow(ordered.distinct(), f"{name}-edges-0"), []
    while not open_.isEmpty():
        step = len(trees) + 1
        both = open_.unionByName(open_.select(b.alias("a"), a.alias("b")))
        smallest = both.groupBy(a.alias("node")).agg(F.min("b").alias("root"))
        parent, depth = smallest.select("node", F.least("node", "root").alias("root")), 0
        while True:
            parent, depth = work.settle_narrow(_flatter(_flatter(parent)), f"{name}-tree-{step}-{depth}"), depth + 1
            above = parent.select(F.col("node").alias("root"), F.col("root").alias("top"))
            if parent.join(above, "root").where(F.col("top") != F.col("root")).isEmpty():
                break
        trees.append(parent)
        open_ = work.settle_narrow(_relabel(open_, parent), f"{name}-edges-{step}")
    if not trees:
        return open_.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = trees[0]
    for later in trees[1:]:
        later = later.select(F.col("node").alias("root"), F.col("root").alias("top"))
        found = found.join(later, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return work.settle_narrow(found, name)
