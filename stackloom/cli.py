"""Command line over trace files: python -m stackloom.cli <tool> [options] trace.otf [processes]

Processes are ids and inclusive ranges (3 7-9); none means all.
"""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import calltree, context, lattice, profiles, render, seqdiff, similarity, stack, unifier
from .plans.session import checkpointed, ship
from .sources import otf1, traces


def _chosen(words: list[str]) -> list[int | tuple[int, int]]:
    out: list[int | tuple[int, int]] = []
    for w in words:
        a, _, b = w.partition("-")
        out.append((int(a), int(b)) if b else int(a))
    return out


def _lines(df: DataFrame, column: str = "line") -> None:
    for row in df.toLocalIterator():
        print(row[column])


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="stackloom", description=__doc__)
    tools = out.add_subparsers(dest="tool", required=True)
    for name in ("call-list", "call-matrix", "call-tree", "profile", "similarity", "diff", "tikz"):
        tool = tools.add_parser(name)
        tool.add_argument("-p", "--processes", action="store_true", help="list processes")
        tool.add_argument("-f", "--functions", action="store_true", help="list functions")
        tool.add_argument("-%", "--timing", action="store_true", help="print how long the run took")
        tool.add_argument("-n", "--names", action="store_true", help="names for ids")
        tool.add_argument("-u", "--unifier", action="store_true", help="print the dictionary of names")
        if name in ("call-list", "call-matrix"):
            tool.add_argument("--group", type=float, metavar="THRESHOLD")
            tool.add_argument("--transitive", action="store_true", help="close the pairs first")
            tool.add_argument("-%2", "--stage-timing", action="store_true", help="print seconds by stage and counts as one JSON line")
            for flag in ("simple-similarity", "subsumption-similarity", "compressed-dot", "compressed-cxt", "compressed-txt", "compressed-txt2"):
                tool.add_argument(f"--{flag}", action="store_true")
        if name == "call-tree":
            tool.add_argument("--dot", action="store_true")
            tool.add_argument("--compressed-dot", action="store_true")
        if name == "profile":
            tool.add_argument("-l", "--call-list", action="store_true")
            tool.add_argument("-m", "--call-matrix", action="store_true")
            tool.add_argument("-t", "--call-tree", action="store_true")
        if name == "similarity":
            tool.add_argument("--metric", choices=sorted(similarity.METRICS), default="scm")
        if name == "diff":
            only = tool.add_mutually_exclusive_group()
            for flag in ("flat-sequence", "tree-sequence", "flat-diff", "flat-score", "tree-diff", "tree-score", "extract"):
                only.add_argument(f"--{flag}", action="store_true")
            tool.add_argument("--least", type=int, default=10_000, help="children that matched nodes have together to be extracted")
        tool.add_argument("trace")
        tool.add_argument("select", nargs="*")
    return out


class Stages:
    """Seconds of the stages of a run; each stage ends when its table is written or printed."""

    def __init__(self):
        self.began, self.seconds = time.perf_counter(), {}

    def over(self, name: str) -> None:
        now = time.perf_counter()
        self.seconds[name], self.began = round(now - self.began, 6), now


def _lattice(args: argparse.Namespace, ctx: DataFrame, names: DataFrame) -> bool:
    stages = Stages()
    if args.transitive or (args.subsumption_similarity and args.tool == "call-matrix"):
        ctx = context.transitive(ctx)
    if args.stage_timing:
        ctx = checkpointed(ctx)
        stages.over("loading")
        groups, _ = context.distinct_intents(ctx)
        counts = {"attributes": ctx.select("attr").distinct().count(), "groups": groups.count()}
        stages.over("merge")
        counts["nodes_with_empty"], counts["nodes"] = lattice.full_lattice(ctx).count(), lattice.concepts(ctx).count()
        stages.over("finalize")
        lattice.group_matrix(ctx, "subsumption" if args.subsumption_similarity else "simple").write.format("noop").mode("overwrite").save()
        stages.over("similarity")
        print(json.dumps(stages.seconds | {"total": round(sum(stages.seconds.values()), 6)} | counts), file=sys.stderr)
    if args.group is not None:
        _lines(lattice.grouped_objects(lattice.threshold_groups(ctx, args.group)).orderBy("cluster").select(F.array_join(F.col("objects").cast("array<string>"), " ").alias("line")))
    elif args.simple_similarity or args.subsumption_similarity:
        print("#group: processes")
        _lines(render.group_lines(context.equality_groups(ctx)))
        print("\n#group x group")
        values = lattice.group_matrix(ctx, "simple" if args.simple_similarity else "subsumption")
        _lines(render.similarity_lines(values.select(F.col("a").alias("p"), F.col("b").alias("q"), "value")))
    elif args.compressed_cxt:
        print(render.cxt(ctx))
    elif args.compressed_dot or args.compressed_txt or args.compressed_txt2:
        nodes = lattice.concepts(ctx)
        edges = lattice.edges(nodes)
        if args.compressed_dot:
            _lines(render.lattice_dot(nodes, edges))
        else:
            pairs = args.tool == "call-matrix"
            if args.compressed_txt2:
                nodes = _named_attributes(nodes, names, pairs)
            _lines(render.lattice_text(render.lattice_lines(nodes, edges), "string" if args.compressed_txt2 else nodes.schema["reduced"].dataType.elementType.simpleString()))
            if pairs and args.compressed_txt:
                _lines(lattice.pair_statistics(nodes).orderBy("node").select(F.format_string("%s: different callers %d, different callees %d, both %d", "node", "callers", "callees", "functions").alias("line")))
                _lines(lattice.pair_totals(nodes).select(F.format_string("all: callers %d, callees %d, both %d", "callers", "callees", "functions").alias("line")))
    else:
        return False
    return True


def _named_attributes(nodes: DataFrame, names: DataFrame, pairs: bool) -> DataFrame:
    """nodes whose reduced attributes are texts of names."""
    each = nodes.select("node", F.posexplode("reduced").alias("i", "attr"))
    each = each.select("node", "i", "attr.from", "attr.to") if pairs else each.withColumnRenamed("attr", "to")
    shown = render.named(each, names, *(("from", "to") if pairs else ("to",)))
    text = F.concat_ws(" -> ", *[c for c in ("from", "to") if c in shown.columns])
    whole = shown.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", text.alias("t")))), lambda x: x["t"]).alias("texts"))
    return nodes.join(whole, "node", "left").withColumn("reduced", F.coalesce("texts", F.array().cast("array<string>"))).drop("texts")


def run(args: argparse.Namespace, spark: SparkSession) -> None:
    trace = traces.open_trace(spark, args.trace)
    ids = unifier.unify(trace.functions)
    names = unifier.unified_names(trace.functions, ids)
    if args.unifier:
        _lines(render.unifier_lines(names, ids))
        return
    if args.functions and args.tool == "profile":  # by group
        own = trace.functions.join(ids, ["trace_id", "token"]).join(trace.groups.select("grp", F.col("name").alias("group_name")), "grp", "left").select("grp", "group_name", "function", "name").distinct()
        _lines(own.groupBy("grp", "group_name").agg(F.array_sort(F.collect_list(F.struct("function", "name"))).alias("f")).orderBy("grp").select(
            F.concat(F.concat_ws(" ", "grp", "group_name"), F.array_join(F.transform("f", lambda x: F.concat(F.lit("\n\t"), x["function"].cast("string"), F.lit(" "), x["name"])), "")).alias("line")))
        return
    if args.processes or args.functions:
        _lines(trace.processes.orderBy("process").select(F.concat_ws(" ", "process", "name").alias("line")) if args.processes else names.orderBy("function").select(F.concat_ws(" ", "function", "name").alias("line")))
        return
    calls = stack.select_processes(stack.calls_from_events(otf1.unified_events(trace.events, ids)), _chosen(args.select))

    def shown(df: DataFrame, *columns: str) -> DataFrame:
        return render.named(df, names, *columns) if args.names else df

    if args.tool == "call-list":
        if not _lattice(args, context.function_context(calls), names):
            _lines(render.call_list_lines(shown(profiles.call_list(calls), "function")))
    elif args.tool == "call-matrix":
        if not _lattice(args, context.pair_context(calls), names):
            _lines(render.call_matrix_lines(shown(profiles.call_matrix(calls), "caller", "function")))
    elif args.tool == "call-tree":
        paths = stack.call_paths(calls)
        if args.dot:
            _lines(render.tree_dot(paths, names if args.names else None))
        elif args.compressed_dot:
            print("digraph {")
            _lines(calltree.compressed_edges(paths).select(F.concat(F.lit('  "'), "parent", F.lit('" -> "'), "child", F.lit('";')).alias("line")))
            print("}")
        else:
            _lines(render.call_tree_lines(shown(profiles.call_tree(paths), "path")))
    elif args.tool == "profile":
        rows, keys = (calls, ["caller", "function"]) if args.call_matrix else (stack.call_paths(calls), ["path"]) if args.call_tree else (calls, ["function"])
        stats = profiles.profile(rows, keys)
        stats = shown(checkpointed(stats), *keys)
        for measure in ("inv", "exc", "inc"):
            print({"inv": "invocations", "exc": "exclusive time", "inc": "inclusive time"}[measure])
            print(render.profile_header())
            _lines(render.profile_lines(stats, keys, measure))
    elif args.tool == "similarity":
        rows = stack.call_paths(calls) if args.metric in ("sct", "uct") else calls
        _lines(render.similarity_lines(similarity.compare(rows, args.metric)))
    elif args.tool == "diff":
        paths = stack.call_paths(calls)
        chosen = sorted(r[0] for r in calls.select("process").distinct().limit(3).collect())
        if len(chosen) != 2:
            raise ValueError("a difference takes exactly two processes")
        pair = spark.createDataFrame([tuple(chosen)], "p long, q long")
        if args.extract:
            for made in otf1.extract_long(paths, *chosen, names, args.trace, args.least, trace.processes):
                print(made)
            return
        if args.tree_diff or args.tree_score:
            out = seqdiff.diff_trees(seqdiff.tree_sequences(paths), pair)
            _lines(render.tree_diff_lines(out) if args.tree_diff else out.select(F.concat_ws(" ", F.lit(0), "score", "achievable", "most").alias("line")))
        elif args.flat_diff or args.flat_score:
            out = seqdiff.diff_pairs(seqdiff.flat_sequences(paths), pair)
            _lines(out.select(render.ops("ops").alias("line")) if args.flat_diff else out.select(F.concat_ws(" ", F.lit(0), "score", "achievable", "most").alias("line")))
        elif args.tree_sequence:
            _lines(seqdiff.tree_sequences(paths).orderBy("process", "i").select(F.concat(F.expr("repeat('\t', cast(depth as int))"), F.col("function").cast("string")).alias("line")))
        else:
            _lines(seqdiff.flat_sequences(paths).orderBy("process").select(F.array_join(F.col("seq").cast("array<string>"), " ").alias("line")))
    else:
        _lines(render.tikz(render.rectangles(calls), names))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("stackloom").getOrCreate()
    ship(spark)
    began = time.perf_counter()
    run(args, spark)
    if args.timing:
        print(f"{time.perf_counter() - began:.3f} s", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
