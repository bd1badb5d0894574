"""Registered queries: every operator on the driver tables, with arrays as joined strings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import runs
from ..functions.measure import flat
from ..operators import calltree, context, lattice, profiles, render, seqdiff, similarity, stack, unifier
from ..sources import otf1, tables, traces
from .session import checkpointed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _calls(spark: SparkSession, sf_dir: str, paths: bool = False) -> DataFrame:
    return tables.nested_calls(_read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type"), paths)


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.supplier_brands(_read(spark, sf_dir, "lineitem"), _read(spark, sf_dir, "part"))


def _joined(c: str | Column, by: str = ",") -> Column:
    return F.array_join(c if isinstance(c, Column) else F.col(c), by)


def _path() -> Column:
    return _joined("path", ">").alias("path")


def _times(df: DataFrame) -> DataFrame:
    return flat(df, "exc", "inc")


@query
def calls_nested(spark, sf_dir):
    return _calls(spark, sf_dir, True).select("process", "call_id", "parent_call_id", "depth", "function", "caller", "t_begin", "t_end", "inclusive", "exclusive", _path())


@query
def call_list_stats(spark, sf_dir):
    return _times(profiles.call_list(_calls(spark, sf_dir)))


@query
def call_matrix_stats(spark, sf_dir):
    return _times(profiles.call_matrix(_calls(spark, sf_dir)))


@query
def call_tree_stats(spark, sf_dir):
    return _times(profiles.call_tree(_calls(spark, sf_dir, True).withColumn("path", _path())))


@query
def call_matrix_accumulated(spark, sf_dir):
    return _times(profiles.accumulated(_calls(spark, sf_dir), ["caller", "function"]))


@query
def call_list_rollup(spark, sf_dir):
    return profiles.rolled_up(_calls(spark, sf_dir), ["function"])


@query
def call_list_neighbors(spark, sf_dir):
    return profiles.neighbours(_calls(spark, sf_dir)).select("process", "function", _joined("callers").alias("callers"), _joined("callees").alias("callees"))


def _profile(calls: DataFrame, keys: list[str]) -> DataFrame:
    return flat(profiles.profile(calls, keys), "inv", "exc", "inc")


@query
def profile_function(spark, sf_dir):
    return _profile(_calls(spark, sf_dir), ["function"])


@query
def profile_group(spark, sf_dir):
    groups = tables.functions(spark).select(F.col("token").alias("function"), "grp")
    return _profile(_calls(spark, sf_dir).join(F.broadcast(groups), "function"), ["grp"])


@query
def profile_pair(spark, sf_dir):
    return _profile(_calls(spark, sf_dir), ["caller", "function"])


@query
def profile_path(spark, sf_dir):
    return _profile(_calls(spark, sf_dir, True).withColumn("path", _path()), ["path"])


@query
def weighted_median_order(spark, sf_dir):
    return profiles.weighted_medians(profiles.call_list(_calls(spark, sf_dir)), ["function"])


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three traces' name tables from nations and regions; tokens number the names from 2."""
    nation, region = _read(spark, sf_dir, "nation"), _read(spark, sf_dir, "region")
    number = lambda df, order, name, k: df.select(F.lit(k).alias("trace_id"), (F.row_number().over(Window.orderBy(order)) + 1).alias("token"), F.col(name).alias("name"))
    return number(nation, F.col("n_nationkey"), "n_name", 1).unionByName(number(region, F.col("r_regionkey"), "r_name", 2)).unionByName(number(nation, F.desc("n_nationkey"), "n_name", 3))


@query
def unified_functions(spark, sf_dir):
    return unifier.unify(_names(spark, sf_dir))


@query
def unified_members(spark, sf_dir):
    """Nations as functions of two traces, in groups that differ for some of them."""
    nation = _read(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).alias("token"), F.col("n_name").alias("name"), "n_regionkey", "n_nationkey")
    group = (F.col("n_regionkey") + 1, (F.col("n_regionkey") + F.col("n_nationkey") % 2) % 5 + 1)
    traces = [nation.select(F.lit(i + 1).alias("trace_id"), "token", "name", g.alias("grp")) for i, g in enumerate(group)]
    functions = traces[0].unionByName(traces[1])
    region = _read(spark, sf_dir, "region").select((F.col("r_regionkey") + 1).alias("token"), F.col("r_name").alias("name"))
    groups = region.select(F.lit(1).alias("trace_id"), "token", "name").unionByName(region.select(F.lit(2).alias("trace_id"), "token", "name"))
    return unifier.unify_members(functions, unifier.unify(functions), unifier.unify(groups))


@query
def sim_jaccard(spark, sf_dir):
    return similarity.simple_call_matrix(_calls(spark, sf_dir))


@query
def sim_functions(spark, sf_dir):
    return similarity.simple_functions(_calls(spark, sf_dir))


@query
def sim_subsumption(spark, sf_dir):
    return similarity.subsumption_call_matrix(_calls(spark, sf_dir))


@query
def sim_function_subsumption(spark, sf_dir):
    return similarity.subsumption(context.function_context(_calls(spark, sf_dir)))


@query
def sim_invocation(spark, sf_dir):
    return similarity.invocation_count_sensitive(_calls(spark, sf_dir)).withColumn("value", F.round("value", 9))


@query
def sim_call_tree(spark, sf_dir):
    return similarity.simple_call_tree(_calls(spark, sf_dir, True))


@query
def sim_call_tree_subsumption(spark, sf_dir):
    return similarity.subsumption_call_tree(_calls(spark, sf_dir, True))


@query
def closure_pairs(spark, sf_dir):
    closed = context.transitive(context.pair_context(_calls(spark, sf_dir)))
    return closed.select(F.col("object").alias("process"), "attr.from", "attr.to")


@query
def equality_groups(spark, sf_dir):
    groups = context.equality_groups(context.pair_context(_calls(spark, sf_dir)))
    shown = F.transform("intent", lambda x: F.concat_ws("-", x["from"].cast("string"), x["to"].cast("string")))
    return groups.select(_joined(shown).alias("intent"), _joined(F.col("objects").cast("array<string>")).alias("objects"), "first")


def _nodes(spark, sf_dir):
    return lattice.concepts(_suppliers(spark, sf_dir))


@query
def concept_nodes(spark, sf_dir):
    return _nodes(spark, sf_dir).select(_joined("intent").alias("intent"), _joined("reduced").alias("reduced"), _joined(F.col("objects").cast("array<string>")).alias("objects"), "is_min", "is_max")


@query
def full_lattice(spark, sf_dir):
    return lattice.full_lattice(_suppliers(spark, sf_dir)).select(_joined("intent").alias("intent"))


@query
def concept_edges(spark, sf_dir):
    return lattice.covers(_nodes(spark, sf_dir), _joined("intent"))


@query
def lattice_reachable(spark, sf_dir):
    return lattice.contained(_nodes(spark, sf_dir), _joined("intent"))


@query
def lattice_group_matrix(spark, sf_dir):
    return lattice.group_matrix(_suppliers(spark, sf_dir))


@query
def lattice_group_subsumption(spark, sf_dir):
    return lattice.group_matrix(_suppliers(spark, sf_dir), "subsumption")


@query
def lattice_metrics(spark, sf_dir):
    ctx = _suppliers(spark, sf_dir)
    counted = ctx.agg(F.countDistinct("attr").alias("attributes"), F.countDistinct("object").alias("objects"))
    groups = context.distinct_intents(ctx)[0].agg(F.count(F.lit(1)).alias("groups"))
    return counted.crossJoin(groups).crossJoin(lattice.concepts(ctx).agg(F.count(F.lit(1)).alias("nodes")))


@query
def long_sequences(spark, sf_dir):
    """Matched nodes of neighbouring processes with at least ten children together (calls here nest into short lists)."""
    long = seqdiff.long_match_pairs(seqdiff.tree_sequences(_calls(spark, sf_dir, True)), _neighbours(spark, sf_dir), 10)
    return long.select("p", "q", "number", _joined(F.col("path").cast("array<string>"), ">").alias("path"), "children_p", "children_q")


@query
def cxt_rows(spark, sf_dir):
    return render.cross_table(_suppliers(spark, sf_dir))


@query
def pair_statistics(spark, sf_dir):
    own = context.intents(context.pair_context(_calls(spark, sf_dir))).select(F.col("object").alias("node"), F.col("intent").alias("reduced"))
    return lattice.pair_statistics(own).withColumnRenamed("node", "object")


@query
def threshold_groups(spark, sf_dir):
    return lattice.threshold_groups(context.pair_context(_calls(spark, sf_dir)), 0.9)


@query
def selected_cells(spark, sf_dir):
    cells = profiles.entries_in_selection(_calls(spark, sf_dir), [1, 2], [3, 4])
    return cells.groupBy("process", "caller", "function").agg(F.count(F.lit(1)).alias("invocations"))


@query
def subtree_edges(spark, sf_dir):
    return profiles.subtree_edges(_calls(spark, sf_dir, True)).withColumn("path", _path())


@query
def tree_node_count(spark, sf_dir):
    return profiles.node_count(_calls(spark, sf_dir, True))


@query
def tree_compressed_count(spark, sf_dir):
    return calltree.compressed_node_count(_calls(spark, sf_dir, True))


@query
def flat_sequences(spark, sf_dir):
    return seqdiff.flat_sequences(_calls(spark, sf_dir, True)).select("process", _joined(F.col("seq").cast("array<string>"), " ").alias("seq"))


@query
def tree_sequences(spark, sf_dir):
    return seqdiff.tree_sequences(_calls(spark, sf_dir, True))


def _neighbours(spark, sf_dir):
    """Pairs of processes that follow each other by id."""
    ids = _read(spark, sf_dir, "events").select(F.col("user_id").alias("p")).distinct()
    return ids.join(ids.select((F.col("p") - 1).alias("p"), F.col("p").alias("q")), "p")


@query
def flat_diff(spark, sf_dir):
    diff = seqdiff.diff_pairs(seqdiff.flat_sequences(_calls(spark, sf_dir, True)), _neighbours(spark, sf_dir))
    return diff.select("p", "q", render.ops("ops").alias("ops"), "score", "achievable", "most")


@query
def tree_diff(spark, sf_dir):
    diff = seqdiff.diff_trees(seqdiff.tree_sequences(_calls(spark, sf_dir, True)), _neighbours(spark, sf_dir))
    rows = diff.select("p", "q", F.explode("rows").alias("r")).select("p", "q", "r.*")
    return rows.select("p", "q", _joined(F.col("pos_path").cast("array<string>"), ".").alias("place"), "op", "function")


@query
def tree_score(spark, sf_dir):
    diff = seqdiff.diff_trees(seqdiff.tree_sequences(_calls(spark, sf_dir, True)), _neighbours(spark, sf_dir))
    return diff.select("p", "q", "score", "achievable", "most")


@query
def flat_score(spark, sf_dir):
    diff = seqdiff.diff_pairs(seqdiff.flat_sequences(_calls(spark, sf_dir, True)), _neighbours(spark, sf_dir))
    return diff.select("p", "q", "score", "achievable", "most")


@query
def anchored_diff(spark, sf_dir):
    """Scores with the middles of both sequences aligned by force."""
    middle = lambda a, b: F.array(F.struct(F.floor(F.size(a) / 2).cast("int").alias("p"), F.floor(F.size(b) / 2).cast("int").alias("q")))
    diff = seqdiff.diff_pairs(seqdiff.flat_sequences(_calls(spark, sf_dir, True)), _neighbours(spark, sf_dir), middle)
    return diff.select("p", "q", "score", "achievable", "most")


@query
def flat_sequences_to_depth(spark, sf_dir):
    limited = seqdiff.flat_sequences(_calls(spark, sf_dir, True), 2)
    return limited.select("process", _joined(F.col("seq").cast("array<string>"), " ").alias("seq"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a trace: signup, view and click enter functions of those names, purchase and error leave.

    Tokens are raw and go through the unifier, as those of a trace file do.
    """
    kind = F.col("event_type")
    rows = _read(spark, sf_dir, "events").where(kind.isin("signup", "view", "click", "purchase", "error"))
    enter = kind.isin("signup", "view", "click")
    line = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    token = F.when(enter, F.array_position(F.array(F.lit("click"), F.lit("view"), F.lit("signup")), kind).cast("int") + 40)
    raw = rows.select(F.lit(1).alias("trace_id"), F.col("user_id").alias("process"), line.cast("long").alias("line"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.when(enter, "E").otherwise("L").alias("kind"), token.alias("token"))
    return otf1.unified_events(raw, unifier.unify(_tokens(spark)))


def _tokens(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, 41, "click"), (1, 42, "view"), (1, 43, "signup")], "trace_id int, token int, name string")


def _stack(spark: SparkSession, sf_dir: str, unclosed: str = "drop") -> DataFrame:
    return stack.calls_from_events(_events(spark, sf_dir), unclosed)


_CALL = ("process", "call_id", "parent_call_id", "depth", "function", "caller", "t_begin", "t_end", "inclusive", "exclusive")


@query
def stack_calls(spark, sf_dir):
    """Calls rebuilt from enters and leaves, with their paths; stray leaves and calls without a leave are dropped."""
    return stack.call_paths(_stack(spark, sf_dir)).select(*_CALL, _path())


@query
def stack_calls_clamped(spark, sf_dir):
    """The same with open calls ended by the process's last event."""
    return _stack(spark, sf_dir, "clamp").select(*_CALL)


@query
def selected_processes(spark, sf_dir):
    chosen = stack.select_processes(_stack(spark, sf_dir), [2, (4, 9)])
    return chosen.groupBy("process").agg(F.count(F.lit(1)).alias("calls"), F.sum("exclusive").alias("exclusive"))


@query
def trace_lines(spark, sf_dir):
    """The event files that the trace writer makes of the nested calls."""
    tokens = tables.functions(spark).select(F.col("token").alias("function"), (F.col("token") + 9).cast("long").alias("token"))
    return otf1.event_lines(_calls(spark, sf_dir, True), tokens).select("process", "t", F.replace("line", F.lit("\n"), F.lit(" ")).alias("line"))


@query
def group_members(spark, sf_dir):
    members = traces.group_members(tables.functions(spark))
    return members.select("grp", _joined(F.col("tokens").cast("array<string>")).alias("functions"))


@query
def unifier_dump(spark, sf_dir):
    names = _names(spark, sf_dir)
    ids = unifier.unify(names)
    return render.unifier_lines(unifier.unified_names(names, ids), ids)


@query
def sim_compressed(spark, sf_dir):
    return similarity.compare(_calls(spark, sf_dir), "sccm")


@query
def alike_groups(spark, sf_dir):
    pairs, members = similarity.alike_groups(context.pair_context(_calls(spark, sf_dir)), 0.75)
    size = members.groupBy(F.col("first").alias("a")).agg(F.count(F.lit(1)).alias("members_a"))
    return pairs.join(size, "a").select("a", "b", "members_a", "value")


@query
def pair_totals(spark, sf_dir):
    own = context.intents(context.pair_context(_calls(spark, sf_dir))).select(F.col("intent").alias("reduced"))
    return lattice.pair_totals(own)


@query
def lattice_objects(spark, sf_dir):
    return lattice.all_objects(_nodes(spark, sf_dir), _joined("intent")).withColumnRenamed("node", "intent")


@query
def box_plot(spark, sf_dir):
    return render.boxes(profiles.profile(_calls(spark, sf_dir), ["function"]), ["function"], "exc")


@query
def colours(spark, sf_dir):
    return render.colours(tables.functions(spark).select(F.col("token").alias("function"), "name"))


@query
def timing_roll_up(spark, sf_dir):
    """Durations of events as runs: user as configuration, event type as part; and whether counts agree."""
    rows = _read(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 7).alias("procs"), F.col("value").alias("total"), (F.col("value") / 2).alias("loading"))
    return runs.roll_up(rows, ["procs"], ["total", "loading"]).withColumn("avg", F.round("avg", 6))


@query
def tikz_rectangles(spark, sf_dir):
    return render.rectangles(_calls(spark, sf_dir, True)).drop("function")


@query
def dot_lines(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    # Sorting reads the edges twice; of their ids it shows twelve digits.
    return render.lattice_dot(nodes, checkpointed(lattice.covers(nodes, F.substring("node", 1, 12))))


@query
def metric_dump(spark, sf_dir):
    sides = similarity.both_or_one(context.pair_context(_calls(spark, sf_dir)), 1, 2)
    return sides.select(F.col("attr.from").alias("caller"), F.col("attr.to").alias("callee"), "side")


@query
def process_list(spark, sf_dir):
    return _read(spark, sf_dir, "events").select(F.col("user_id").alias("process")).distinct().orderBy("process")


@query
def function_list(spark, sf_dir):
    names = tables.functions(spark).select(F.col("token").alias("function"), "name", "grp")
    counted = _calls(spark, sf_dir).groupBy("function").agg(F.count(F.lit(1)).alias("calls"))
    return counted.join(F.broadcast(names), "function").select("grp", "function", "name", "calls").orderBy("grp", "function")


@query
def label_search(spark, sf_dir):
    t = F.col("p_type")
    return _read(spark, sf_dir, "part").where(t.contains("PROMO") | t.contains("promo")).select("p_partkey", "p_type")


@query
def attribute_count(spark, sf_dir):
    calls = _calls(spark, sf_dir)
    return calls.agg(F.countDistinct("caller", "function").alias("pairs"), F.countDistinct("function").alias("functions"))
