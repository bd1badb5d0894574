"""Formal contexts: which object (process) has which attribute (function, or pair of caller and callee)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import checkpointed


def function_context(calls: DataFrame) -> DataFrame:
    return calls.select(F.col("process").alias("object"), F.col("function").alias("attr")).distinct()


def pair_context(calls: DataFrame) -> DataFrame:
    return calls.select(F.col("process").alias("object"), F.struct(F.col("caller").alias("from"), F.col("function").alias("to")).alias("attr")).distinct()


def intents(context: DataFrame) -> DataFrame:
    """object and its sorted attributes."""
    return context.groupBy("object").agg(F.sort_array(F.collect_set("attr")).alias("intent"))


def distinct_intents(context: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(first, intent and n of each group of objects with equal attributes; object, first). Groups of any size stay rows."""
    own = checkpointed(intents(context))
    groups = checkpointed(own.groupBy("intent").agg(F.min("object").alias("first"), F.count(F.lit(1)).alias("n")))
    members = own.join(groups.select("intent", "first"), "intent").select("object", "first")
    return groups, members


def numbered(rows: DataFrame) -> DataFrame:
    """rows (attr, ...) with `at`, the number of the attribute from 0 in order."""
    every = rows.agg(F.sort_array(F.collect_set("attr")).alias("every"))
    return rows.join(every.select(F.posexplode("every").alias("at", "attr")), "attr")


def equality_groups(context: DataFrame) -> DataFrame:
    """For display: intent, sorted objects, least object."""
    return intents(context).groupBy("intent").agg(F.sort_array(F.collect_list("object")).alias("objects"), F.min("object").alias("first"))


def transitive(context: DataFrame) -> DataFrame:
    """The pairs of each object closed under (a, b), (b, c) -> (a, c).

    Closed once for each distinct set of pairs. New pairs only are extended in each round, along known ones of any
    length, so the rounds grow with the logarithm of the longest path.
    """
    groups = checkpointed(intents(context).withColumn("group", F.sha2(F.to_json("intent"), 256)))
    known = checkpointed(groups.dropDuplicates(["group"]).select("group", F.explode("intent").alias("p")).select("group", F.col("p.from").alias("a"), F.col("p.to").alias("b")))
    fresh = known
    while True:
        left = fresh.select("group", "a", F.col("b").alias("m")).join(known.select("group", F.col("a").alias("m"), "b"), ["group", "m"]).select("group", "a", "b")
        right = known.select("group", "a", F.col("b").alias("m")).join(fresh.select("group", F.col("a").alias("m"), "b"), ["group", "m"]).select("group", "a", "b")
        fresh = checkpointed(left.union(right).distinct().join(known, ["group", "a", "b"], "left_anti"))
        if fresh.isEmpty():
            break
        known = checkpointed(known.union(fresh))
    return groups.select("object", "group").join(known, "group").select("object", F.struct(F.col("a").alias("from"), F.col("b").alias("to")).alias("attr"))
