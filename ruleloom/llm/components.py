"""Connected components of large graphs by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``a, b`` edges; the component is its smallest node.

    Large and small stars in turn: every node links its larger neighbours, then its smaller ones, to the smallest
    node around it, until nothing changes; the number of rounds grows with the logarithm of the longest
    path.  Smallest neighbours are aggregated within tasks first, and both sides of each join are stored tables, so a
    node with very many neighbours is split.
    """

    def smallest(graph: DataFrame) -> DataFrame:
        return stored(graph.groupBy("u").agg(F.min("v").alias("least")), "graph-least")

    def signature(graph: DataFrame):
        return graph.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    larger, smaller = F.greatest("a", "b"), F.least("a", "b")
    graph = stored(edges.select(larger.alias("u"), smaller.alias("v")).filter("u <> v").distinct(), "graph")
    before = None
    while (now := signature(graph)) != before:
        before = now
        both = stored(graph.union(graph.select(F.col("v").alias("u"), F.col("u").alias("v"))), "graph-both")
        least = smallest(both).withColumn("least", F.least("least", "u"))
        linked = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        graph = stored(linked.filter("u <> v").distinct(), "graph-large")
        least = smallest(graph)
        linked = graph.join(least, "u")
        near = linked.select("u", F.col("least").alias("v")).union(
            linked.filter("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
        )
        graph = stored(near.distinct(), "graph-small")
    return graph.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        graph.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
