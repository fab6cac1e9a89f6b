"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from foliospark.llm import common


def connected_components(edges: DataFrame) -> DataFrame:
    """Each node of ``edges`` (a, b) with the least node that it can reach: columns node, root.

    Every round each node points at the neighbour that comes first in a scrambled order (or at itself), follows four such
    pointers, and the edges between the nodes arrived at go into the next round. In a scrambled order pointers
    seldom form long chains, whatever the numbers of the nodes, so a constant share of the nodes goes each round.
    Rounds are stored, so a lost executor costs no earlier round. Loops and repeated edges do no harm; an empty table
    gives an empty one.
    """
    edges = common.stored(
        edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    labels = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    first = True
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy(F.col("a").alias("x")).agg(F.min_by("b", F.xxhash64("b")).alias("b"))
        ahead = F.xxhash64("b") < F.xxhash64("x")
        hop = common.stored(nearest.select("x", F.when(ahead, F.col("b")).otherwise(F.col("x")).alias("y")))
        for _ in range(2):
            hop = common.stored(_follow(hop, "y", hop).select("x", "y"))
        labels = hop.select(F.col("x").alias("node"), F.col("y").alias("root")) if first else common.stored(_follow(labels, "root", hop))
        first = False
        moved = _follow(_follow(edges, "a", hop), "b", hop).filter("a <> b")
        edges = common.stored(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    least = labels.groupBy("root").agg(F.min("node").alias("least"))
    return labels.join(least, "root").select("node", F.least("least", "root").alias("root"))


def _follow(rows: DataFrame, column: str, hop: DataFrame) -> DataFrame:
    """The rows with ``column`` moved along one pointer where it has one."""
    to = hop.select(F.col("x").alias(column), F.col("y").alias("_to"))
    return rows.join(to, column, "left").withColumn(column, F.coalesce("_to", column)).select(*rows.columns)
