"""Opening a trace of either format: the first one is tried first, then the printed form of the second."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import otf1, otf2


def sniff(spark: SparkSession, path: str) -> str:
    """otf1 or otf2, by what the first lines look like; anything else is an error."""
    try:
        some = [r.value for r in spark.read.text(path).where("trim(value) <> ''").limit(200).collect()]
    except AnalysisException as e:
        raise ValueError(f"{path} can't be opened") from e
    lines = spark.createDataFrame([(x,) for x in some], "value string")
    if some and lines.where(~F.col("value").rlike("^[0-9A-Fa-f]+:[0-9A-Fa-f]+(,[0-9A-Fa-f]+)*$")).isEmpty():
        return "otf1"
    if not lines.where(F.col("value").rlike(r"^(STRING|LOCATION|REGION|ENTER|LEAVE|=== )")).isEmpty():
        return "otf2"
    raise ValueError(f"{path} is neither a master file nor a printed trace")


def open_trace(spark: SparkSession, path: str, trace_id: int = 1, processes: list[int] | None = None) -> otf1.Trace:
    return {"otf1": otf1, "otf2": otf2}[sniff(spark, path)].read_trace(spark, path, trace_id, processes)


def group_members(functions: DataFrame) -> DataFrame:
    """The inverse of function -> group: trace_id, grp, sorted functions (raw tokens)."""
    return functions.groupBy("trace_id", "grp").agg(F.sort_array(F.collect_set("token")).alias("tokens"))
