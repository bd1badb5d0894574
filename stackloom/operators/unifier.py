"""One dictionary of names for several traces: equal names get one id, from 1 in the order of first appearance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unify(names: DataFrame) -> DataFrame:
    """names: trace_id, token, name. Returns trace_id, token, function; the dictionary is small, its numbering is global."""
    first = names.groupBy("name").agg(F.min(F.struct("trace_id", "token")).alias("at"))
    ids = first.select("name", F.row_number().over(Window.orderBy("at")).alias("function"))
    return names.join(ids, "name").select("trace_id", "token", "function")


def unified_names(names: DataFrame, unifier: DataFrame) -> DataFrame:
    """The inverse dictionary: function, name."""
    return names.join(unifier, ["trace_id", "token"]).select("function", "name").distinct()


def unify_members(functions: DataFrame, unifier: DataFrame, group_unifier: DataFrame) -> DataFrame:
    """function, grp, conflict: unified functions with unified groups.

    functions: trace_id, token, name, grp. Of a function in several groups the one of the last raw token counts.
    """
    both = functions.join(unifier, ["trace_id", "token"]).join(group_unifier.select("trace_id", F.col("token").alias("grp"), F.col("function").alias("group_id")), ["trace_id", "grp"])
    return both.groupBy("function").agg(F.max_by("group_id", F.struct("trace_id", "token")).alias("grp"), (F.countDistinct("group_id") > 1).alias("conflict"))
