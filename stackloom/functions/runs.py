"""Timings of repeated runs, rolled up: one row a run and part, as the command line prints them with -%2."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a run reports besides seconds; repetitions must agree in them.
COUNTS = ("attributes", "nodes_with_empty", "nodes", "groups")


def roll_up(runs: DataFrame, keys: list[str], parts: list[str]) -> DataFrame:
    """keys, part, runs, min, avg, med, max: of the seconds in the columns `parts`; the median is the value at index floor(n / 2)."""
    long = runs.select(*keys, F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.col(p).cast("double").alias("s")) for p in parts])).alias("x")).select(*keys, "x.*")
    return long.groupBy(*keys, "part").agg(
        F.count("s").alias("runs"), F.min("s").alias("min"), F.avg("s").alias("avg"), F.element_at(F.sort_array(F.collect_list("s")), (F.floor(F.count("s") / 2) + 1).cast("int")).alias("med"), F.max("s").alias("max")
    )


def disagreeing(runs: DataFrame, keys: list[str], counts: tuple[str, ...] = COUNTS) -> DataFrame:
    """keys and the names of the counts in which repetitions differ."""
    wrong = [F.when(F.min(c) != F.max(c), F.lit(c)) for c in counts]
    return runs.groupBy(*keys).agg(F.filter(F.array(*wrong), lambda x: x.isNotNull()).alias("wrong")).where(F.size("wrong") > 0)
