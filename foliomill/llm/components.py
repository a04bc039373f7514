"""Connected components of a graph given as a table of edges, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise


def connected(edges: DataFrame, nodes: str = "node") -> DataFrame:
    """Component of every node that has an edge: (node, root), root the same within a component.

    ``edges`` has the columns a and b.  In each round every node points to its smallest
    neighbour or itself, pointers are followed twice, and the edges are rewritten to
    what their ends point to; every component that still has an edge at least halves.
    The minimum by node is pre-aggregated in each task and the joins are plain equi
    joins, so a node with very many edges is split like any skewed key.  Each round is
    written to the shared folder; nothing is collected but the number of edges left.
    """
    edges = edges.filter("a <> b").select("a", "b")
    both = materialise(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = None
    while not both.isEmpty():
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to"))
        low = materialise(low, "pointers")
        for _ in range(2):
            far = low.select(F.col("a").alias("to"), F.col("to").alias("beyond"))
            low = low.join(far, "to", "left").select("a", F.coalesce("beyond", "to").alias("to"))
        low = materialise(low, "pointers")
        if labels is None:
            labels = low.select(F.col("a").alias(nodes), F.col("to").alias("root"))
        else:
            step = low.select(F.col("a").alias("root"), "to")
            labels = materialise(
                labels.join(step, "root", "left").select(nodes, F.coalesce("to", "root").alias("root")), "labels"
            )
        of_b = low.select(F.col("a").alias("b"), F.col("to").alias("to_b"))
        both = both.join(low, "a").join(of_b, "b").select(F.col("to").alias("a"), F.col("to_b").alias("b"))
        both = materialise(both.filter("a <> b").distinct(), "edges")
    if labels is None:
        return both.select(F.col("a").alias(nodes), F.col("b").alias("root"))
    return labels
