"""Connected components of a link table, by contraction: no group of links or nodes is gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import checkpointed


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of every node of links (a, b), comp being the smallest node reachable.

    Each round hooks every root to its smallest smaller neighbour, flattens the hooks by pointer jumping and relabels
    what is left of the links; the number of rounds grows with the logarithm of the longest chain.
    """
    edges = checkpointed(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    nodes = checkpointed(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("comp", F.col("node")))
    while not edges.isEmpty():
        hooks = checkpointed(edges.groupBy("a").agg(F.min("b").alias("b")))
        while True:
            up = hooks.select(F.col("a").alias("b"), F.col("b").alias("c"))
            jumped = checkpointed(hooks.join(up, "b", "left").select("a", F.coalesce("c", "b").alias("b"), F.col("c").isNotNull().alias("moved")))
            hooks = jumped.select("a", "b")
            if jumped.where("moved").isEmpty():
                break
        to_root = hooks.select(F.col("a").alias("of"), F.col("b").alias("root"))
        nodes = checkpointed(nodes.join(to_root, F.col("comp") == F.col("of"), "left").select("node", F.coalesce("root", "comp").alias("comp")))
        left = edges.join(to_root, F.col("a") == F.col("of"), "left").select(F.coalesce("root", "a").alias("a"), "b")
        both = left.join(to_root, F.col("b") == F.col("of"), "left").select("a", F.coalesce("root", "b").alias("b"))
        edges = checkpointed(both.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    return nodes
