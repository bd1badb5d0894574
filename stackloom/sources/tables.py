"""Traces from ordinary tables: a deterministic nesting of an event stream, and object-attribute tables.

An event becomes a call of the function that its type names. Types have levels; a call lasts until the user's next
event of its own or an outer level, or else to the user's last event, and its parent is the latest earlier event of
an outer level. All of it comes from two passes of running `last` over one ordering of each user's events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.stack import ROOT, with_exclusive
from ..plans.session import checkpointed

#: Event types by level; the function id is the level plus 1.
LEVELS = ("signup", "view", "click", "purchase", "error")


def functions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, i + 1, name, 1 + (i >= 3)) for i, name in enumerate(LEVELS)], "trace_id int, token int, name string, grp int")


def nested_calls(events: DataFrame, paths: bool = False) -> DataFrame:
    """calls (and their paths) of the events table: event_id, ts, user_id, event_type."""
    level = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("event_type")), F.lit(0)).cast("int")
    rows = events.select(
        F.lit(1).alias("trace_id"), F.col("user_id").alias("process"), F.col("event_id").alias("call_id"), level.alias("function"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("t_begin"),
    ).where("function > 0")
    seq = Window.partitionBy("trace_id", "process").orderBy("t_begin", "call_id")
    before = seq.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("trace_id", "process").orderBy(F.desc("t_begin"), F.desc("call_id")).rowsBetween(Window.unboundedPreceding, -1)
    n = range(1, len(LEVELS) + 1)
    at = rows.withColumn("i", F.row_number().over(seq))
    at = at.withColumns({f"last_{k}": F.last(F.when(F.col("function") == k, F.struct("i", "call_id")), ignorenulls=True).over(before) for k in n})
    ends = F.coalesce(*[F.when(F.col("function") == k, F.last(F.when(F.col("function") <= k, F.col("t_begin")), ignorenulls=True).over(after)) for k in n])
    at = at.withColumn("t_end", F.coalesce(ends, F.max("t_begin").over(Window.partitionBy("trace_id", "process"))))
    # An outer call is still open if nothing of a level further out came after it.
    outer = [F.greatest(F.lit(0), F.lit(0), *[F.col(f"last_{j}.i") for j in range(1, k)]) for k in n]
    open_ = [F.when((F.lit(k) < F.col("function")) & (F.col(f"last_{k}.i") > outer[k - 1]), F.struct(F.lit(k).alias("f"), F.col(f"last_{k}.call_id").alias("id"))) for k in n]
    stack = F.filter(F.array(*open_), lambda x: x.isNotNull())
    at = at.withColumn("stack", stack).withColumn("parent", F.try_element_at("stack", F.lit(-1)))
    calls = at.select(
        "trace_id", "process", "call_id", F.col("parent.id").alias("parent_call_id"), (F.size("stack") + 1).alias("depth"), "function", F.coalesce("parent.f", F.lit(ROOT)).alias("caller"),
        "t_begin", "t_end", (F.col("t_end") - F.col("t_begin")).alias("inclusive"), *([F.concat(F.transform("stack", lambda x: x.f), F.array("function")).alias("path")] if paths else []),
    )
    return with_exclusive(calls)


def supplier_brands(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """An object-attribute table from all lines: the part brands of which a supplier delivered more than suppliers do on average, by a fifth."""
    lines = lineitem.select("l_suppkey", "l_partkey", "l_quantity").join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    sums = checkpointed(lines.groupBy(F.col("l_suppkey").alias("object"), F.col("p_brand").alias("attr")).agg(F.sum(F.col("l_quantity").cast("long")).alias("q")))
    mean = sums.groupBy(F.col("attr").alias("brand")).agg(F.sum("q").alias("all"), F.count(F.lit(1)).alias("n"))
    return sums.join(mean, F.col("attr") == F.col("brand")).where("5 * q * n > 6 * all").select("object", "attr")
