"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktide.llm.frames import materialise


def _lower(edges: DataFrame) -> DataFrame:
    """Edges from the larger to the smaller end, without loops or repeats."""
    return edges.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("node"), F.least("a", "b").alias("to")
    ).distinct()


def _roots(parents: DataFrame) -> DataFrame:
    """Follow (node, to) pointers, which always lead to smaller ids, to their ends by doubling."""
    while True:
        above = parents.select(F.col("node").alias("to"), F.col("to").alias("next"))
        step = materialise(parents.join(above, "to", "left").select(
            "node", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        parents = step.select("node", "to")
        if step.filter("moved").isEmpty():
            return parents


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); the root is its smallest reachable id.

    Every round points each node to its smallest neighbour, follows the pointers to
    their ends and keeps only edges between ends. Nodes with a smaller neighbour leave
    in every round, and the rounds grow with the logarithm of a component's size. A node with very many
    neighbours is reduced by a partial minimum; rounds are cut by written tables.
    """
    left = materialise(_lower(edges))
    found = None
    while not left.isEmpty():
        roots = _roots(left.groupBy("node").agg(F.min("to").alias("to")))
        if found is None:
            found = roots
        else:
            moved = found.join(roots.select(F.col("node").alias("to"), F.col("to").alias("next")), "to", "left")
            older = moved.select("node", F.coalesce("next", "to").alias("to"))
            found = materialise(older.unionByName(roots))
        ends = roots.select(F.col("node").alias("n"), F.col("to").alias("r"))
        first = left.join(ends, F.col("node") == F.col("n"), "left").select(
            F.coalesce("r", "node").alias("a"), "to")
        both = first.join(ends, F.col("to") == F.col("n"), "left").select(
            "a", F.coalesce("r", "to").alias("b"))
        left = materialise(_lower(both))
    if found is None:
        return left.select("node", F.col("to").alias("root"))
    tops = found.select(F.col("to").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return found.select("node", F.col("to").alias("root")).unionByName(tops)
