"""Call lists, call matrices, call trees and profiles across processes, from calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measure import folded, measures
from ..plans.session import checkpointed


def _times() -> dict:
    return {"exc": F.col("exclusive"), "inc": F.col("inclusive")}


def call_list(calls: DataFrame) -> DataFrame:
    """By process and function: invocations, exclusive and inclusive time."""
    return measures(calls, ["process", "function"], _times())


def call_matrix(calls: DataFrame) -> DataFrame:
    """By process, caller and callee; calls from outside have the root for caller."""
    return measures(calls, ["process", "caller", "function"], _times())


def call_tree(paths: DataFrame) -> DataFrame:
    """By process and call path."""
    return measures(paths, ["process", "path"], _times())


def accumulated(calls: DataFrame, keys: list[str]) -> DataFrame:
    """As one process: keys without the process."""
    return measures(calls, keys, _times())


def rolled_up(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Invocations and times by process and keys, and over all processes (null process)."""
    both = calls.select(F.explode(F.array(F.col("process"), F.lit(None).cast(calls.schema["process"].dataType))).alias("process"), *keys, "exclusive", "inclusive")
    return both.groupBy("process", *keys).agg(F.count(F.lit(1)).alias("invocations"), F.sum("exclusive").alias("exc_accumulated"), F.sum("inclusive").alias("inc_accumulated"))


def neighbours(calls: DataFrame) -> DataFrame:
    """By process and function: sorted sets of callees and of callers (0: root)."""
    pairs = calls.select("process", "caller", "function").distinct()
    callers = pairs.groupBy("process", "function").agg(F.sort_array(F.collect_set("caller")).alias("callers"))
    callees = pairs.where("caller <> 0").groupBy("process", F.col("caller").alias("function")).agg(F.sort_array(F.collect_set("function")).alias("callees"))
    empty = F.array().cast("array<int>")
    return callers.join(callees, ["process", "function"], "full").select("process", "function", F.coalesce("callers", empty).alias("callers"), F.coalesce("callees", empty).alias("callees"))


def subtree_edges(paths: DataFrame) -> DataFrame:
    """By process and path: how many distinct paths lie strictly below (the empty path is the root)."""
    own = paths.select("process", "path").distinct()
    above = own.select("process", F.explode(F.sequence(F.lit(0), F.size("path") - 1)).alias("k"), "path")
    below = above.select("process", F.when(F.col("k") == 0, F.array().cast("array<int>")).otherwise(F.slice("path", 1, F.col("k"))).alias("path")).groupBy("process", "path").agg(F.count(F.lit(1)).alias("edges"))
    every = own.union(own.select("process", F.array().cast("array<int>")).distinct())
    return every.join(below, ["process", "path"], "left").select("process", "path", F.coalesce("edges", F.lit(0)).alias("sub_tree_edges"))


def node_count(paths: DataFrame) -> DataFrame:
    """Nodes of all call trees, one root for each process included."""
    own = paths.select("process", "path").distinct()
    return own.agg((F.count(F.lit(1)) + F.countDistinct("process")).alias("nodes"))


def profile(calls: DataFrame, keys: list[str], processes: DataFrame | None = None) -> DataFrame:
    """Distributions across processes of each process's invocations, exclusive and inclusive sums.

    Every process counts for every key, with zeros where it has none. Zeros are added as counts of a weight, not as
    rows: keys times processes are never materialised.
    """
    per = checkpointed(calls.groupBy("process", *keys).agg(F.count(F.lit(1)).alias("invocations"), F.sum("exclusive").alias("exclusive"), F.sum("inclusive").alias("inclusive")))
    everyone = (processes if processes is not None else per).select("process").distinct().count()
    return _filled(per, keys, everyone, {"inv": "invocations", "exc": "exclusive", "inc": "inclusive"})


def _filled(per: DataFrame, keys: list[str], everyone: int, values: dict[str, str]) -> DataFrame:
    long = per.select(*keys, F.explode(F.array(*[F.struct(F.lit(k).alias("which"), F.col(v).cast("long").alias("v")) for k, v in values.items()])).alias("x"))
    counted = checkpointed(long.groupBy(*keys, "x.which", "x.v").agg(F.count(F.lit(1)).alias("c")))
    missing = F.lit(everyone) - F.sum("c")
    zeros = counted.groupBy(*keys, "which").agg(missing.alias("c")).where("c > 0").select(*keys, "which", F.lit(0).cast("long").alias("v"), "c")
    merged = counted.unionByName(zeros).groupBy(*keys, "which", "v").agg(F.sum("c").alias("c"))
    return folded(merged, keys, list(values))


def weighted_medians(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Across processes: medians weighed by invocations, total invocations, and the largest 98 % points.

    stats: a call list or matrix; ordered by weighted median of exclusive time, ties by key.
    """
    w = F.col("invocations")
    return (
        stats.groupBy(*keys)
        .agg(
            F.sum(w).alias("invocations"),
            (F.sum(F.col("exc.median") * w) / F.sum(w)).alias("exc_weighted_median"),
            (F.sum(F.col("inc.median") * w) / F.sum(w)).alias("inc_weighted_median"),
            F.max("exc.p98").alias("exc_max_p98"),
            F.max("inc.p98").alias("inc_max_p98"),
            F.max(w).alias("max_invocations"),
        )
        .orderBy(F.desc("exc_weighted_median"), *keys)
    )


def entries_in_selection(matrix: DataFrame, callers: list[int] | None = None, callees: list[int] | None = None) -> DataFrame:
    """Cells of the selected rows and columns; rows and columns without a cell vanish by themselves."""
    out = matrix if not callers else matrix.where(F.col("caller").isin(callers))
    return out if not callees else out.where(F.col("function").isin(callees))
