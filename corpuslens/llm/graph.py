"""Connected components of an edge table, as Spark joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import hinted, staged


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of the undirected ``edges(a long, b long)``.

    Returns one row per node of an edge: ``node, root`` with root the smallest
    node of its component; an empty edge table gives no rows. Self loops,
    repeated and reversed edges are allowed; a null end makes no edge.

    Large-star and small-star steps alternate until nothing changes, so the
    number of passes follows the logarithm of the longest path. A node's
    neighbours are never gathered: each step is a minimum per node (combined
    map-side), staged as a table of its own, and a join on the node, which sends
    that table where it is small and else lets AQE split a hub's rows.
    """
    e = staged(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
               .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-edges")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = hinted(staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-low"))
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        large = staged(large, "cc-large")
        least = hinted(staged(large.groupBy("u").agg(F.min("v").alias("m")), "cc-least"))
        small = (large.join(least, "u")
                 .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                         F.col("m").alias("v")).where("u <> v").distinct())
        small = staged(small, "cc-small")
        changed = small.exceptAll(e).limit(1).count() or e.exceptAll(small).limit(1).count()
        e = small
        if not changed:
            break
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
