"""Compressed call trees: equal subtrees of all processes become one node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import checkpointed


def structural_hashes(paths: DataFrame) -> DataFrame:
    """process, path, hash: of a node's function and its children's hashes, level by level from the deepest."""
    nodes = checkpointed(paths.select("process", "path", F.size("path").alias("depth")).distinct())
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    out, below = None, None
    for depth in range(deepest, 0, -1):
        own = nodes.where(F.col("depth") == depth)
        if below is None:
            level = own.withColumn("children", F.array().cast("array<string>"))
        else:
            up = below.groupBy("process", F.slice("path", 1, depth).alias("path")).agg(F.sort_array(F.collect_list("hash")).alias("children"))
            level = own.join(up, ["process", "path"], "left").withColumn("children", F.coalesce("children", F.array().cast("array<string>")))
        level = checkpointed(level.select("process", "path", F.sha2(F.concat_ws("|", F.element_at("path", -1).cast("string"), F.array_join("children", ",")), 256).alias("hash")))
        out, below = level if out is None else out.unionByName(level), level
    return out if out is not None else nodes.select("process", "path", F.lit("").alias("hash"))


def compressed(paths: DataFrame) -> DataFrame:
    """node, function and how many tree nodes it stands for."""
    return structural_hashes(paths).groupBy(F.col("hash").alias("node")).agg(F.first(F.element_at("path", -1)).alias("function"), F.count(F.lit(1)).alias("stands_for"))


def compressed_edges(paths: DataFrame) -> DataFrame:
    """(parent, child) of the compressed tree; a process's root is `process <id>`."""
    h = structural_hashes(paths)
    up = h.select("process", F.col("path").alias("above"), F.col("hash").alias("parent"))
    child = h.withColumn("above", F.slice("path", 1, F.size("path") - 1))
    root = F.concat(F.lit("process "), F.col("process").cast("string"))
    return child.join(up, ["process", "above"], "left").select(F.coalesce("parent", root).alias("parent"), F.col("hash").alias("child")).distinct()


def compressed_node_count(paths: DataFrame) -> DataFrame:
    """Nodes after compression, one root for each process included."""
    return compressed(paths).agg(F.count(F.lit(1)).alias("c")).crossJoin(paths.agg(F.countDistinct("process").alias("p"))).select((F.col("c") + F.col("p")).alias("nodes"))
