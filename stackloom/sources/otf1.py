"""Text traces: a master file of streams, a definition file, and one event file a stream. Numbers are hexadecimal.

    <name>.otf             stream:process[,process...]
    <name>.0.def           DP<id>NM"name"[PT<parent>]  DFG<id>NM"name"  DF<id>G<group>NM"name"
    <name>.<stream>.events <time>, *<process> (both hold until changed), E<function>, L[<function>]

Files are read by Spark's text reader, so any file system it knows will do, and large files are split. A selection of
processes prunes the event files to the streams that hold them. Ids that are defined twice are an error.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import seqdiff


@dataclass
class Trace:
    streams: DataFrame
    processes: DataFrame
    functions: DataFrame
    groups: DataFrame
    events: DataFrame


def _hex(c: Column) -> Column:
    return F.conv(c, 16, 10).cast("long")


def number_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, line number and text of each line. Files are split as any text; lines are numbered by split and place."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), "value")
    number = F.row_number().over(Window.partitionBy("file").orderBy("block", "place")) - 1
    return rows.select("file", number.cast("long").alias("line"), F.trim("value").alias("value")).where("value <> ''")


def defined_once(rows: DataFrame, column: str) -> None:
    """Definitions name each id once."""
    if twice := rows.groupBy(column).count().where("count > 1").orderBy(column).first():
        raise ValueError(f"{column} {twice[0]} has already been defined")


def read_trace(spark: SparkSession, path: str, trace_id: int = 1, processes: list[int] | None = None) -> Trace:
    """The tables of one trace; path is the master file. events keep the raw function token, null where a leave has none."""
    base = path.removesuffix(".otf")
    me = F.lit(trace_id).alias("trace_id")
    parts = F.split("value", ":")
    streams = number_lines(spark, f"{base}.otf").select(me, _hex(parts[0]).cast("int").alias("stream"), F.explode(F.split(parts[1], ",")).alias("p")).select("trace_id", "stream", _hex(F.col("p")).alias("process"))
    defs = number_lines(spark, f"{base}.0.def").select("value")

    def found(pattern: str, *fields: tuple[str, str]) -> DataFrame:
        rows = defs.where(F.col("value").rlike(pattern))
        get = [F.regexp_extract("value", pattern, i + 1) for i in range(len(fields))]
        return rows.select(me, *[(F.when(g != "", _hex(g)).cast(kind) if kind != "string" else g).alias(name) for g, (name, kind) in zip(get, fields, strict=True)])

    procs = found(r'^DP([0-9A-Fa-f]+)NM"([^"]*)"(?:PT([0-9A-Fa-f]+))?', ("process", "long"), ("name", "string"), ("parent", "long"))
    functions = found(r'^DF([0-9A-Fa-f]+)G([0-9A-Fa-f]+)NM"([^"]*)"', ("token", "int"), ("grp", "int"), ("name", "string")).select("trace_id", "token", "name", "grp")
    groups = found(r'^DFG([0-9A-Fa-f]+)NM"([^"]*)"', ("grp", "int"), ("name", "string"))
    defined_once(procs, "process")
    defined_once(functions, "token")
    defined_once(groups, "grp")
    wanted = streams if not processes else streams.where(F.col("process").isin(processes))
    names = [f"{base}.{r.stream:x}.events" for r in wanted.select("stream").distinct().orderBy("stream").collect()]
    if not names:
        raise ValueError("no such processes in this trace")
    seq = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    value = F.col("value")
    raw = number_lines(spark, names).select(
        "file",
        "line",
        "value",
        F.last(F.when(value.rlike("^[0-9A-Fa-f]+$") & ~value.rlike("^[EL]"), _hex(value)), ignorenulls=True).over(seq).alias("ts"),
        F.last(F.when(value.startswith("*"), _hex(F.substring(value, 2, 64))), ignorenulls=True).over(seq).alias("process"),
    )
    token = F.substring(value, 2, 64)
    events = raw.where(value.rlike("^[EL]")).select(
        me,
        F.conv(F.regexp_extract("file", r"\.([0-9A-Fa-f]+)\.events$", 1), 16, 10).cast("int").alias("stream"),
        "line",
        "process",
        "ts",
        F.substring(value, 1, 1).alias("kind"),
        F.when((token != "") & (_hex(token) > 0), _hex(token)).cast("int").alias("token"),
    )
    if processes:
        events = events.where(F.col("process").isin(processes))
    return Trace(streams, procs, functions, groups, events)


def unified_events(events: DataFrame, unifier: DataFrame) -> DataFrame:
    """events with unified functions; enters of unknown tokens are an error when the rows are read."""
    known = events.join(unifier, ["trace_id", "token"], "left")
    missing = (F.col("kind") == "E") & F.col("function").isNull()
    return known.withColumn("function", F.when(missing, F.raise_error(F.concat(F.lit("unknown function token "), F.col("token").cast("string"))).cast("int")).otherwise(F.col("function")))


def event_lines(calls: DataFrame, tokens: DataFrame) -> DataFrame:
    """process, t, line: enters and leaves of calls with `path`, in order, at times 1, 2, 3, ... within each process.

    After a call come the leaves of all calls that end before the next one begins: those on its path from its own depth
    up to the depth of the next. tokens: function, token.
    """
    order = Window.partitionBy("process").orderBy("t_begin", "call_id")
    depth = F.size("path")
    left = F.greatest(depth - F.coalesce(F.lead(depth).over(order), F.lit(1)) + 1, F.lit(0))
    steps = calls.select("process", "function", F.row_number().over(order).alias("i"), F.concat(F.array(F.lit("E")), F.array_repeat(F.lit("L"), left)).alias("kinds"))
    steps = steps.join(tokens, "function").select("process", "i", "token", F.posexplode("kinds").alias("k", "kind"))
    timed = steps.withColumn("t", F.row_number().over(Window.partitionBy("process").orderBy("i", "k")).cast("long"))
    what = F.when(F.col("kind") == "E", F.concat(F.lit("E"), F.lower(F.hex("token")))).otherwise("L")
    return timed.select("process", "t", F.concat(F.lower(F.hex("t")), F.lit("\n"), what).alias("line"))


def write_trace(calls: DataFrame, names: DataFrame, path: str, processes: DataFrame | None = None) -> None:
    """Calls with `path` as a trace: functions numbered anew from 1 by id, time counting 1, 2, 3, ... within each process.

    names: function, name; processes: process, name. Event files are written by Spark, one a process, and then given
    their names; only definitions pass through the driver.
    """
    spark = calls.sparkSession
    used = calls.select("function").distinct().join(names, "function", "left").withColumn("token", F.row_number().over(Window.orderBy("function")))
    rows = used.orderBy("token").collect()
    tokens = spark.createDataFrame([(r.function, r.token) for r in rows], "function int, token long")
    own = calls.select("process").distinct()
    own = own.join(processes.select("process", "name"), "process", "left") if processes is not None else own.withColumn("name", F.lit(None).cast("string"))
    ids = own.orderBy("process").collect()
    base = path.removesuffix(".otf")
    head = F.when(F.col("t") == 1, F.concat(F.lit("0\n*"), F.lower(F.hex("process")), F.lit("\n"))).otherwise("")
    body = event_lines(calls, tokens).withColumn("line", F.concat(head, "line"))
    folder = f"{base}.parts"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    body.repartition(parts, "process").sortWithinPartitions("process", "t").select(F.col("process").alias("p"), F.col("line").alias("value")).write.mode("overwrite").partitionBy("p").text(folder)
    for r in ids:
        _rename(spark, f"{folder}/p={r.process}", f"{base}.{r.process:x}.events")
    _delete(spark, folder)
    defs = ["DTR1"] + [f'DP{r.process:x}NM"{r.name or f"Process {r.process}"}"' for r in ids] + ['DFG3e8NM"Application"'] + [f'DF{r.token:x}G3e8NM"{r.name or r.function}"' for r in rows]
    _put(spark, f"{base}.otf", "".join(f"{r.process:x}:{r.process:x}\n" for r in ids))
    _put(spark, f"{base}.0.def", "\n".join(defs) + "\n")


def extract_long(paths: DataFrame, p: int, q: int, names: DataFrame, path: str, least: int = 10_000, processes: DataFrame | None = None) -> list[str]:
    """Writes a trace for each pair of matched nodes of two processes with at least `least` children together.

    It holds the calls below both nodes; its name tells the processes, the number of the match and the children.
    """
    spark, base = paths.sparkSession, path.removesuffix(".otf2").removesuffix(".otf")
    p, q = sorted((p, q))
    trees = seqdiff.tree_sequences(paths)
    found = seqdiff.long_match_pairs(trees, spark.createDataFrame([(p, q)], "p long, q long"), least).orderBy("number").collect()
    numbered = paths.where(F.col("process").isin(p, q)).withColumn("i", F.row_number().over(Window.partitionBy("process").orderBy("t_begin", "call_id")))
    out = []
    for r in found:
        below = ((F.col("process") == p) & F.col("i").between(*r.calls_p)) | ((F.col("process") == q) & F.col("i").between(*r.calls_q))
        calls = numbered.where(below).withColumn("path", F.slice("path", len(r.path) + 1, F.size("path")))
        out.append(f"{base}-extract-p{p}-p{q}-{r.number}-{r.children_p}-{r.children_q}.otf")
        write_trace(calls, names, out[-1], processes)
    return out


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _rename(spark: SparkSession, folder: str, target: str) -> None:
    """The one part file of a folder becomes `target`."""
    at, fs = _path(spark, folder)
    (part,) = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith("part-")]
    to, _ = _path(spark, target)
    fs.delete(to, False)
    fs.rename(part, to)


def _delete(spark: SparkSession, path: str) -> None:
    at, fs = _path(spark, path)
    fs.delete(at, True)


def _put(spark: SparkSession, path: str, content: str) -> None:
    target, fs = _path(spark, path)
    out = fs.create(target, True)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()
