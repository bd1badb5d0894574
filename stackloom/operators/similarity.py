"""Similarity of processes. Every metric gives (p, q, value) for all ordered pairs, the process with itself included.

Metrics work on groups of processes with equal sets (or equal weights) and expand to processes at the end, so the
quadratic part is in the number of distinct sets; members are joined, never held as arrays. Two empty sets have
similarity 1. The full matrix grows with the square of the groups by its nature; `alike_groups` is the form for many
processes, with a threshold, group pairs and membership.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.session import checkpointed
from .blocks import EMIT, crossed
from .context import distinct_intents, function_context, numbered, pair_context, transitive


def alike_groups(context: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(a, b, value of groups with equal sets whose Jaccard coefficient is `least` or more, a > b; object, first).

    The form for many objects: pairs come from shared attributes between sets whose sizes allow the threshold, so no
    pair without one is looked at, and copies are not expanded.
    """
    groups, members = distinct_intents(context)
    member = groups.select(F.col("first").alias("g"), F.size("intent").alias("n"), F.explode("intent").alias("attr"))
    x, y = (member.select("attr", F.col("g").alias(g), F.col("n").alias(f"n{g}")) for g in "ab")
    near = (F.col("a") > F.col("b")) & (F.least("na", "nb") >= F.lit(least) * F.greatest("na", "nb"))
    shared = x.join(y, "attr").where(near).groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("c"))
    value = F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))
    return shared.select("a", "b", value.alias("value")).where(F.col("value") >= least), members


def _expanded(scored: DataFrame, members: DataFrame) -> DataFrame:
    """Values of groups (gp, gq) for all pairs of their members.

    Members, a row an object, are broadcast: the rows to be made are the square of theirs and must not be shuffled.
    """
    p = members.select(F.col("object").alias("p"), F.col("first").alias("gp"))
    q = members.select(F.col("object").alias("q"), F.col("first").alias("gq"))
    return scored.join(F.broadcast(p), "gp").join(F.broadcast(q), "gq").select("p", "q", "value")


def _all_pairs(groups: DataFrame, shared: DataFrame, value: Column) -> DataFrame:
    """gp, gq, value for all ordered pairs of groups; groups: g and columns that become ..p and ..q beside those of shared."""
    side = lambda s: groups.select(*[F.col(c).alias(f"{c}{s}") for c in groups.columns])
    return side("p").crossJoin(side("q")).join(shared, ["gp", "gq"], "left").select("gp", "gq", value.alias("value"))


def _pairs_of_sets(context: DataFrame, value: Callable[[Column, Column, Column], Column], objects: DataFrame | None = None) -> DataFrame:
    """value(shared, size of p's set, size of q's set) for all ordered pairs; the full matrix is what is asked for here."""
    groups, members = distinct_intents(context)
    sizes = groups.select(F.col("first").alias("g"), F.size("intent").alias("n"))
    member = groups.select(F.col("first").alias("g"), F.explode("intent").alias("attr"))
    shared = member.alias("x").join(member.alias("y"), "attr").groupBy(F.col("x.g").alias("gp"), F.col("y.g").alias("gq")).agg(F.count(F.lit(1)).alias("shared"))
    out = _expanded(_all_pairs(sizes, shared, value(F.coalesce("shared", F.lit(0)), F.col("np"), F.col("nq"))), members)
    return out if objects is None else _with_empty(out, context, objects)


def _with_empty(out: DataFrame, context: DataFrame, objects: DataFrame) -> DataFrame:
    """Adds pairs with objects that have no attribute: alike among themselves, unlike all others."""
    bare = objects.select("object").distinct().join(context.select("object").distinct(), "object", "left_anti")
    some = context.select("object").distinct()
    one = lambda a, b, v: a.select(F.col("object").alias("p")).crossJoin(b.select(F.col("object").alias("q"))).withColumn("value", F.lit(v))
    return out.unionByName(one(bare, bare, 1.0)).unionByName(one(bare, some, 0.0)).unionByName(one(some, bare, 0.0))


def jaccard(context: DataFrame, objects: DataFrame | None = None) -> DataFrame:
    return _pairs_of_sets(context, lambda c, n, m: c / (n + m - c), objects)


def subsumption(context: DataFrame, objects: DataFrame | None = None) -> DataFrame:
    """How much of q's set p has."""
    return _pairs_of_sets(context, lambda c, n, m: c / m, objects)


Sums = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _weighted(weights: DataFrame, both: list[Sums], value: Callable[..., np.ndarray]) -> DataFrame:
    """weights: object, attr, w (1 or more). Values of all ordered pairs from sums over attributes.

    Each of `both` maps weights of p and q (0 for none) to a term that is 0 if one of them is; value gets the sums of
    the terms, then p's and q's totals and numbers of attributes. Objects with equal weights are compared once, in
    blocks, so that no pair is shuffled.
    """
    vectors, members = distinct_intents(weights.select("object", F.struct("attr", "w").alias("attr")))
    entry = numbered(vectors.select(F.col("first").alias("g"), F.explode("intent").alias("e")).select("g", "e.attr", "e.w"))
    own = checkpointed(entry.groupBy("g").agg(F.collect_list(F.struct("at", F.col("w").cast("long").alias("w"))).alias("e")).select("g", "e.at", "e.w"))
    kind = own.schema["g"].dataType.simpleString()

    def body(left: pa.RecordBatch, right: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unique(left["at"].flatten().to_numpy())
        held, *of_p = _dense(left, known)
        of_p = [x[:, None] for x in of_p]
        for batch in right:
            for at in range(0, len(batch), 256):
                part = batch[at : at + 256]
                met, *of_q = _dense(part, known)
                sums = [np.zeros((len(left), len(part))) for _ in both]
                for k in range(len(known)):
                    p, q = np.flatnonzero(held[k]), np.flatnonzero(met[k])
                    few = len(p) * len(q) * 8 < len(left) * len(part)
                    for total, term in zip(sums, both, strict=True):
                        if few:
                            total[np.ix_(p, q)] += term(held[k][p, None], met[k][q])
                        else:
                            total += term(held[k][:, None], met[k])
                scores = value(*sums, *(x for pair in zip(of_p, of_q, strict=True) for x in pair))
                for i in range(0, len(left), EMIT // 256):
                    some = scores[i : i + EMIT // 256]
                    p, q = np.repeat(np.arange(i, i + len(some)), len(part)), np.tile(np.arange(len(part)), len(some))
                    yield pa.RecordBatch.from_arrays([left["g"].take(pa.array(p)), part["g"].take(pa.array(q)), pa.array(some.ravel())], names=["gp", "gq", "value"])

    return _expanded(crossed(own, own, [], body, f"gp {kind}, gq {kind}, value double", 32), members)


def _dense(rows: pa.RecordBatch, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights by known attribute and row; totals and numbers of all attributes by row."""
    size = np.diff(rows["at"].offsets.to_numpy())
    row, at, w = np.repeat(np.arange(len(rows)), size), rows["at"].flatten().to_numpy(), rows["w"].flatten().to_numpy()
    k = np.minimum(np.searchsorted(known, at), len(known) - 1)
    ours = known[k] == at
    out = np.zeros((len(known), len(rows)))
    out[k[ours], row[ours]] = w[ours]
    return out, np.bincount(row, w, len(rows)), size.astype(float)


def simple_call_matrix(calls: DataFrame) -> DataFrame:
    """Jaccard coefficient of the sets of caller-callee pairs."""
    return jaccard(pair_context(calls))


def simple_compressed(calls: DataFrame) -> DataFrame:
    """The same coefficient read off a lattice: pairs of groups with equal sets, expanded to their processes."""
    context = pair_context(calls)
    groups, members = distinct_intents(context)
    sides = groups.select(F.col("first").alias("g"), "intent")
    x, y = (sides.select(F.col("g").alias(f"g{s}"), F.col("intent").alias(f"set_{s}")) for s in "pq")
    value = F.size(F.array_intersect("set_p", "set_q")) / F.size(F.array_union("set_p", "set_q"))
    return _expanded(x.crossJoin(y).select("gp", "gq", value.alias("value")), members)


def simple_functions(calls: DataFrame) -> DataFrame:
    """Jaccard coefficient of the sets of functions."""
    return jaccard(function_context(calls))


def subsumption_call_matrix(calls: DataFrame) -> DataFrame:
    """Share of q's transitive pairs that p has, too."""
    return subsumption(transitive(pair_context(calls)))


def invocation_count_sensitive(calls: DataFrame) -> DataFrame:
    """Pairs weighed by how close their invocation counts are, over the union of pairs."""
    w = calls.groupBy(F.col("process").alias("object"), F.struct("caller", "function").alias("attr")).agg(F.count(F.lit(1)).alias("w"))
    alike = lambda a, b: np.minimum(a, b) / np.maximum(np.maximum(a, b), 1)
    return _weighted(w, [alike, lambda a, b: (a > 0) & (b > 0)], lambda met, shared, tp, tq, np_, nq: met / (np_ + nq - shared))


def _tree_edges(paths: DataFrame) -> DataFrame:
    return paths.select("process", "path").distinct()


def simple_call_tree(paths: DataFrame) -> DataFrame:
    """Call-tree edges by parent and child function, weighed by how many nodes have them."""
    parent = F.when(F.size("path") > 1, F.element_at("path", -2)).otherwise(0)
    w = _tree_edges(paths).groupBy(F.col("process").alias("object"), F.struct(parent.alias("a"), F.element_at("path", -1).alias("b")).alias("attr")).agg(F.count(F.lit(1)).alias("w"))
    w = w.withColumn("w", F.when(F.col("attr.a") == 0, F.lit(1)).otherwise(F.col("w")).cast("long"))
    return _weighted(w, [np.minimum], lambda met, tp, tq, np_, nq: met / (tp + tq - met))


def subsumption_call_tree(paths: DataFrame) -> DataFrame:
    """Call-tree pairs of ancestor (the root is 0) and descendant; how much p's weights make up of the larger of both."""
    above = F.explode(F.concat(F.array(F.lit(0)), F.slice("path", 1, F.size("path") - 1)))
    nodes = _tree_edges(paths).select("process", above.alias("a"), F.element_at("path", -1).alias("b"))
    w = nodes.groupBy(F.col("process").alias("object"), F.struct("a", "b").alias("attr")).agg(F.count(F.lit(1)).alias("w"))
    # The sum of the larger weights over all pairs is tp + tq less the smaller ones of shared pairs.
    return _weighted(w, [np.minimum], lambda met, tp, tq, np_, nq: tp / (tp + tq - met))


#: Metrics by name. Those on call trees take calls with paths.
METRICS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "scm": simple_call_matrix,
    "sccm": simple_compressed,
    "uccm": subsumption_call_matrix,
    "icscm": invocation_count_sensitive,
    "sct": simple_call_tree,
    "uct": subsumption_call_tree,
}


def register(name: str, metric: Callable[[DataFrame], DataFrame]) -> None:
    """Adds a metric that maps calls to (p, q, value)."""
    METRICS[name] = metric


def compare(calls: DataFrame, metric: str) -> DataFrame:
    return METRICS[metric](calls)


def both_or_one(context: DataFrame, p: int, q: int) -> DataFrame:
    """attr and where it occurs: both, only_p, only_q."""
    a, b = (context.where(F.col("object") == x).select("attr", F.lit(True).alias(n)) for x, n in ((p, "in_p"), (q, "in_q")))
    joined = a.join(b, "attr", "full")
    return joined.select("attr", F.when(F.col("in_p") & F.col("in_q"), "both").when(F.col("in_p"), "only_p").otherwise("only_q").alias("side"))
