"""Distributions: sum, count, mean, extremes and index percentiles of values per key.

The percentile q of n sorted values is the one at index floor(n * q), counted from 0. It is read off counted distinct
values, so equal values are combined before the shuffle and no group is held as one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERCENTILES = {"p2": 0.02, "p25": 0.25, "median": 0.50, "p75": 0.75, "p98": 0.98}
FIELDS = ("accumulated", *PERCENTILES, "min", "max", "mean", "n")


def measures(rows: DataFrame, keys: list[str], values: dict[str, Column], invocations: str | None = "invocations") -> DataFrame:
    """keys, optionally the number of rows, and for each value a struct of FIELDS."""
    long = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(k).alias("which"), v.cast("long").alias("v")) for k, v in values.items()])).alias("x"))
    counted = long.groupBy(*keys, "x.which", "x.v").agg(F.count(F.lit(1)).alias("c"))
    wide = folded(counted, keys, list(values))
    if invocations:
        some = next(iter(values))
        wide = wide.withColumn(invocations, F.col(f"{some}.n"))
    return wide


def folded(counted: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Measures from rows of keys, which (a name), v (a value) and c (how often)."""
    group = Window.partitionBy(*keys, "which")
    ranked = counted.withColumn("upto", F.sum("c").over(group.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("c").over(group))
    at = {k: F.min(F.when(F.col("upto") > F.floor(F.col("all") * F.lit(q)), F.col("v"))).alias(k) for k, q in PERCENTILES.items()}
    total = F.sum(F.col("v") * F.col("c"))
    n = F.sum("c")
    each = ranked.groupBy(*keys, "which").agg(
        F.struct(
            total.alias("accumulated"),
            *at.values(),
            F.min("v").alias("min"),
            F.max("v").alias("max"),
            (total / n).alias("mean"),
            n.alias("n"),
        ).alias("m")
    )
    return each.groupBy(*keys).agg(*[F.first(F.when(F.col("which") == k, F.col("m")), ignorenulls=True).alias(k) for k in names])


def flat(df: DataFrame, *names: str, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Structs of measures as columns <name>_<field>."""
    rest = [c for c in df.columns if c not in names]
    return df.select(*rest, *[F.col(f"{n}.{f}").alias(f"{n}_{f}") for n in names for f in fields])


def text(measure: str) -> Column:
    """A measure on one line: the percentiles, then the sum."""
    return F.concat_ws(" ", *[F.concat(F.lit(f"{k}="), F.col(f"{measure}.{k}").cast("string")) for k in (*PERCENTILES, "accumulated")])
