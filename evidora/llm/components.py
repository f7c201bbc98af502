"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import forget, store


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the component's smallest node.

    Alternating large-star and small-star steps: each step keeps the
    components, never makes more edges than there were, and ends in stars.  A
    step is two aggregations by node that combine before they shuffle and a join
    whose hot keys adaptive execution can split.  Edges that are stars already
    take no step.  Nodes may be of any orderable type; null nodes and loops are
    ignored.
    """
    now = store(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _are_stars(now):
        before = now
        both = now.union(now.select(F.col("b"), F.col("a"))).toDF("u", "v")
        # kept as a table, so that both sides of the join are plain exchanges and a hub's edges can be split
        hubs = store(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "hubs")
        large = both.join(hubs, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select("a", "b", "m")
        now = store(small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        forget(before, hubs)  # the new edges no longer need them
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether each a > b has one edge only and is no other's b, so that each b is its component's smallest node."""
    one, none = F.lit(1), F.lit(0)
    ends = edges.select(F.col("a").alias("u"), one.alias("up"), none.alias("down")).union(edges.select("b", none, one))
    deep = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).agg(F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))))
    return not deep.first()[0]
