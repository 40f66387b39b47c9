"""Connected components of a table of links, by joins and aggregations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenary.runtime import checkpointed


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): each linked node's smallest reachable node; links has a and b, a != b.

    Large-star and small-star rounds: every node sends its larger, then its smaller neighbours
    to the least one it knows, which keeps components whole and ends in stars after about the
    logarithm of their width. A node with many neighbours is never collected: its least
    neighbour is an aggregate, joined back. Rounds are cut by checkpoints.
    """
    edges = checkpointed(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = checkpointed(small.where("u <> v").distinct())
        if new.count() == edges.count() and not new.join(edges, ["u", "v"], "left_anti").head(1):
            return new.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").unionByName(new.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        edges = new
    raise RuntimeError(f"components not settled after {rounds} rounds")
