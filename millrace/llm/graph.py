"""Connected components over edge tables, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of the edges ``(a, b)``; a component is named by its smallest node.

    In each round every node is merged into its smallest neighbour, and the edges between merged nodes remain. A star is
    done in one round, and each component loses at least half its nodes a round. A hub's neighbours are reduced before
    the shuffle (a minimum), and the joins are plain equality joins, which Spark splits when a key is hot. Only the test
    for emptiness reaches the driver. Edges from a node to itself and repeated edges don't matter.
    """
    left = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    found: DataFrame | None = None
    while True:
        both = left.union(left.select("b", "a")).toDF("node", "other")
        parent = stored(both.groupBy("node").agg(F.min("other").alias("parent")).select("node", F.least("node", "parent").alias("parent")), "parents")
        if found is None:
            found = parent.withColumnRenamed("parent", "component")
        else:
            step = parent.withColumnsRenamed({"node": "n", "parent": "p"})
            found = stored(found.join(step, F.col("component") == F.col("n"), "left").select("node", F.coalesce("p", "component").alias("component")), "labels")
        pa, pb = parent.toDF("a", "pa"), parent.toDF("b", "pb")
        moved = left.join(pa, "a").join(pb, "b").filter("pa <> pb")
        left = stored(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        if left.isEmpty():
            return found
