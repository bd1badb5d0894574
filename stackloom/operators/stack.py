"""Call intervals from enter and leave events, by windows; and call paths.

calls: trace_id, process, call_id, parent_call_id, depth, function, caller, t_begin, t_end, inclusive, exclusive.
A process is one sequence and so one window partition; different processes never meet in a shuffle key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import checkpointed

ROOT = 0


def calls_from_events(events: DataFrame, unclosed: str = "drop") -> DataFrame:
    """events: trace_id, process, line (order within the process), ts, kind E or L, function.

    A leave closes the deepest open call; leaves without an open call are dropped. Calls that are never left are
    dropped, and what they called moves up to the root; with unclosed="clamp" they end with the process's last event.
    """
    seq = Window.partitionBy("trace_id", "process").orderBy("line")
    to_here = seq.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("trace_id", "process")
    step = F.when(F.col("kind") == "E", 1).otherwise(-1)
    # A leave at level 0 has nothing to close: with the running minimum taken out, levels never fall below 0.
    run = events.withColumn("run", F.sum(step).over(to_here)).withColumn("low", F.least(F.min("run").over(to_here), F.lit(0)))
    before = F.coalesce(F.lag("low").over(seq), F.lit(0))
    live = run.withColumn("stray", (F.col("kind") == "L") & (F.col("low") < before)).where(~F.col("stray"))
    level = F.col("run") - F.col("low")
    placed = live.withColumn("depth", F.when(F.col("kind") == "E", level).otherwise(level + 1)).withColumn("last_ts", F.max("ts").over(whole))
    same = Window.partitionBy("trace_id", "process", "depth").orderBy("line")
    closed = placed.withColumn("t_end", F.lead("ts").over(same)).where("kind = 'E'")
    if unclosed == "clamp":
        closed = closed.withColumn("t_end", F.coalesce("t_end", "last_ts")).withColumn("open", F.lit(0))
    else:  # calls that stay open begin outside all calls that follow them, which move up by as many levels
        closed = closed.withColumn("open", F.coalesce(F.sum(F.col("t_end").isNull().cast("int")).over(seq.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    # Each call stands on its own level and on the level above; the last one there before a call is its parent.
    both = closed.withColumn("on", F.explode(F.array(F.struct(F.col("depth").alias("level"), F.lit(True).alias("own")), F.struct((F.col("depth") - 1).alias("level"), F.lit(False).alias("own")))))
    upper = Window.partitionBy("trace_id", "process", "on.level").orderBy("line", F.col("on.own").desc()).rowsBetween(Window.unboundedPreceding, -1)
    parent = F.last(F.when(F.col("on.own"), F.struct("line", "function", "t_end")), ignorenulls=True).over(upper)
    found = both.withColumn("parent", parent).where("not on.own and t_end is not null").withColumn("parent", F.when(F.col("parent.t_end").isNotNull() & (F.col("depth") > 1), F.col("parent")))
    calls = found.select(
        "trace_id", "process", F.col("line").alias("call_id"), F.col("parent.line").alias("parent_call_id"), (F.col("depth") - F.col("open")).alias("depth"), "function",
        F.coalesce("parent.function", F.lit(ROOT)).alias("caller"), F.col("ts").alias("t_begin"), "t_end", (F.col("t_end") - F.col("ts")).alias("inclusive"),
    )
    return with_exclusive(calls)


def with_exclusive(calls: DataFrame) -> DataFrame:
    """exclusive = inclusive less that of the direct children."""
    below = calls.where("parent_call_id is not null").groupBy("trace_id", "process", F.col("parent_call_id").alias("call_id")).agg(F.sum("inclusive").alias("below"))
    return calls.join(below, ["trace_id", "process", "call_id"], "left").withColumn("exclusive", F.col("inclusive") - F.coalesce("below", F.lit(0))).drop("below")


def call_paths(calls: DataFrame) -> DataFrame:
    """calls with `path`, the functions from the outermost call down to it.

    Every call starts with its own function and a pointer to its parent; a round puts in front what the pointer's call
    has so far and takes over its pointer, so the rounds grow with the logarithm of the depth.
    """
    key = ["trace_id", "process", "call_id"]
    state = checkpointed(calls.select(*key, F.col("parent_call_id").alias("up"), F.array("function").alias("path")))
    while not state.where("up is not null").isEmpty():
        above = state.select("trace_id", "process", F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("path").alias("above"))
        joined = state.join(above, ["trace_id", "process", "up"], "left")
        state = checkpointed(joined.select(*key, F.col("next").alias("up"), F.when(F.col("above").isNotNull(), F.concat("above", "path")).otherwise(F.col("path")).alias("path")))
    return calls.join(state.drop("up"), key)


def merged(one: DataFrame, other: DataFrame) -> DataFrame:
    """The calls of two runs that share no process; a shared one is an error."""
    if shared := one.select("process").distinct().join(other.select("process").distinct(), "process", "left_semi").first():
        raise ValueError(f"process {shared[0]} is in both")
    return one.unionByName(other)


def select_processes(calls: DataFrame, chosen: list[int | tuple[int, int]] | None = None) -> DataFrame:
    """Rows of the processes named by id or inclusive range; all for none. Unknown or repeated ids are errors."""
    if not chosen:
        return calls
    ids = [(c, c) if isinstance(c, int) else c for c in chosen]
    flat = sorted(ids)
    if any(a[1] >= b[0] for a, b in zip(flat, flat[1:], strict=False)):
        raise ValueError("a process is selected twice")
    known = {r[0] for r in calls.where(F.col("process").isin([a for a, b in ids if a == b])).select("process").distinct().collect()}
    if missing := [a for a, b in ids if a == b and a not in known]:
        raise ValueError(f"no such processes: {missing}")
    cond = F.lit(False)
    for a, b in ids:
        cond = cond | F.col("process").between(a, b)
    return calls.where(cond)
