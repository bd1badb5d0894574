"""Traces of the second format, from the text that its print tool makes of them (global definitions and events).

    STRING                     <id>  "<text>"
    LOCATION_GROUP             <id>  Name: "<name>" <string id>, ...
    LOCATION                   <id>  Name: "<name>" <string id>, Type: CPU_THREAD, ..., Group: "<name>" <group id>
    REGION                     <id>  Name: "<name>" <string id>, ..., Paradigm: MPI, ...
    ENTER                      <location>  <time>  Region: "<name>" <region id>
    LEAVE                      <location>  <time>  Region: "<name>" <region id>

Numbers are decimal. Names are resolved through the string table, so any id may stand in place of the quoted name. A
location is a process, named `<its name>:<its group's name>`; locations of type METRIC are left out, with their events.
The format has no function groups: groups are made of the regions' paradigms. The binary files themselves need the
format's own library, which is not at hand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .otf1 import Trace, defined_once, number_lines

# The groups, and the paradigms that belong to them; all others are applications.
GROUPS = {1: "Application", 2: "MPI", 3: "OpenMP", 4: "Pthreads", 5: "CUDA"}
PARADIGMS = {"MPI": 2, "OPENMP": 3, "PTHREAD": 4, "CUDA": 5}


def group_of(paradigm: Column) -> Column:
    out = F.lit(1)
    for name, grp in PARADIGMS.items():
        out = F.when(F.upper(paradigm) == name, grp).otherwise(out)
    return out


def read_trace(spark: SparkSession, path: str, trace_id: int = 1, processes: list[int] | None = None) -> Trace:
    """The tables of one printed trace; every location is a stream of its own."""
    lines = number_lines(spark, path)
    me = F.lit(trace_id).alias("trace_id")
    value = F.col("value")
    get = lambda pattern, k=1: F.regexp_extract("value", pattern, k)
    of = lambda kind: lines.where(value.rlike(rf"^{kind}\s+\d+\s"))
    own = lambda kind: get(rf"^{kind}\s+(\d+)\s").cast("long")
    ref = get(r'Name: (?:"[^"]*" )?<(\d+)>').cast("long")
    strings = of("STRING").select(own("STRING").alias("string"), get(r'"(.*)"').alias("s"))

    def named(rows: DataFrame) -> DataFrame:
        return rows.join(strings, F.col("ref") == F.col("string"), "left").drop("ref", "string").withColumnRenamed("s", "name")

    holders = named(of("LOCATION_GROUP").select(own("LOCATION_GROUP").alias("holder"), ref.alias("ref"))).withColumnRenamed("name", "held")
    places = named(of("LOCATION").where(get(r"Type: (\w+)") != "METRIC").select(own("LOCATION").alias("process"), ref.alias("ref"), get(r'Group: (?:"[^"]*" )?<(\d+)>').cast("long").alias("holder")))
    procs = places.join(holders, "holder", "left").select(me, "process", F.concat("name", F.lit(":"), F.coalesce("held", F.lit(""))).alias("name"), F.lit(None).cast("long").alias("parent"))
    functions = named(of("REGION").select(own("REGION").cast("int").alias("token"), ref.alias("ref"), group_of(get(r"Paradigm: (\w+)")).alias("grp"))).select(me, "token", "name", "grp")
    groups = spark.createDataFrame([(trace_id, k, v) for k, v in GROUPS.items()], "trace_id int, grp int, name string")
    defined_once(procs, "process")
    defined_once(functions, "token")
    streams = procs.select("trace_id", F.col("process").cast("int").alias("stream"), "process")
    pattern = r"^(ENTER|LEAVE)\s+(\d+)\s+(\d+)\b"
    events = lines.where(value.rlike(pattern)).select(
        me,
        get(pattern, 2).cast("long").alias("process"),
        "line",
        get(pattern, 3).cast("long").alias("ts"),
        F.when(get(pattern) == "ENTER", "E").otherwise("L").alias("kind"),
        F.try_element_at(F.regexp_extract_all("value", F.lit(r'Region: (?:"[^"]*" )?<(\d+)>')), F.lit(1)).cast("int").alias("token"),
    )
    wanted = procs.select("process") if not processes else procs.where(F.col("process").isin(processes)).select("process")
    events = events.join(wanted, "process", "left_semi").select("trace_id", F.col("process").cast("int").alias("stream"), "line", "process", "ts", "kind", "token")
    return Trace(streams, procs, functions, groups, events)
