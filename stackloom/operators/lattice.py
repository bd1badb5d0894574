"""Concept lattices without enumerating them, and threshold grouping.

Once empty nodes are removed, a lattice has the concepts of objects (distinct intents), the concepts of attributes
(what all owners of an attribute share), the union of all intents for its maximum and their intersection for its
minimum. These come from two group-bys; there are at most objects + attributes + 2 of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.session import checkpointed
from .blocks import Pairs, crossed, packed, widened
from .context import distinct_intents, equality_groups, intents, numbered


def _node_id(intent: str = "intent"):
    return F.sha2(F.to_json(F.col(intent)), 256)


def concepts(context: DataFrame) -> DataFrame:
    """node, intent, reduced (attributes first held here), objects, is_min, is_max."""
    kind = context.schema["attr"].dataType.simpleString()
    groups = checkpointed(equality_groups(context).select("intent", "objects"))
    owned = groups.select("intent", F.explode("intent").alias("attr"))
    # A fold of the distinct intents that have the attribute, by counting: kept is what all of them have.
    owners = owned.groupBy("attr").agg(F.count(F.lit(1)).alias("owners"))
    shared = owned.select("attr", F.explode("intent").alias("other")).groupBy("attr", "other").agg(F.count(F.lit(1)).alias("times"))
    by_attr = shared.join(owners, "attr").where("times = owners").groupBy("attr").agg(F.sort_array(F.collect_list("other")).alias("intent"))
    reduced = by_attr.groupBy("intent").agg(F.sort_array(F.collect_list("attr")).alias("reduced"))
    n = groups.count()
    every = owners.agg(F.sort_array(F.collect_list("attr")).alias("intent"))
    common = owners.where(F.col("owners") == n).agg(F.sort_array(F.collect_list("attr")).alias("intent"))
    ends = every.select("intent", F.lit(False).alias("is_min"), F.lit(True).alias("is_max")).union(common.select("intent", F.lit(True).alias("is_min"), F.lit(False).alias("is_max")))
    none = F.array().cast(f"array<{kind}>")
    no_objects = F.array().cast(groups.schema["objects"].dataType)
    rows = (
        groups.select("intent", "objects", none.alias("reduced"), F.lit(False).alias("is_min"), F.lit(False).alias("is_max"))
        .unionByName(reduced.select("intent", no_objects.alias("objects"), "reduced", F.lit(False).alias("is_min"), F.lit(False).alias("is_max")))
        .unionByName(ends.select("intent", no_objects.alias("objects"), none.alias("reduced"), "is_min", "is_max"))
    )
    merged = rows.groupBy("intent").agg(
        F.sort_array(F.flatten(F.collect_list("objects"))).alias("objects"), F.sort_array(F.flatten(F.collect_list("reduced"))).alias("reduced"), F.max("is_min").alias("is_min"), F.max("is_max").alias("is_max")
    )
    return checkpointed(merged.select(_node_id().alias("node"), "intent", "reduced", "objects", "is_min", "is_max"))


def _placed(nodes: DataFrame) -> DataFrame:
    """node, at (numbers of its attributes), size."""
    own = numbered(nodes.select("node", F.explode("intent").alias("attr"))).groupBy("node").agg(F.collect_list("at").alias("at"))
    at = F.coalesce("at", F.array().cast("array<int>"))
    return nodes.select("node").join(own, "node", "left").select("node", at.alias("at"), F.size(at).alias("size"))


def _above(sets: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which sets contain one of `least`; both are rows of bits."""
    out = np.zeros(len(sets), bool)
    step = max(1, (1 << 20) // max(1, sets.size))
    for i in range(0, len(least), step):
        some = least[i : i + step]
        out |= ((sets[:, None] & some) == some).all(2).any(1)
    return out


def _contained(lower: DataFrame, upper: DataFrame, proper: bool, covers: bool = False) -> DataFrame:
    """(lower, upper): labels of the rows (label, at, size) of lower and of the rows of upper whose sets contain theirs.

    With covers, upper's sets are distinct and pairs are left out that a third set lies between. Upper rows come by
    size, so a set that contains a cover found before, or a smaller one of its own batch, is none. A block holds the
    bits of its sets and of their covers so far.
    """

    def body(left: pa.RecordBatch, right: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = packed(left["at"])
        size = left["size"].to_numpy()
        found = [low[:0]] * len(low)
        for batch in right:
            up = packed(batch["at"])
            words = max(low.shape[1], up.shape[1])
            low, up = widened(low, words), widened(up, words)
            first = np.ascontiguousarray(up[:, 0])
            sizes = batch["size"].to_numpy()
            starts = np.searchsorted(sizes, size, "right" if proper else "left")
            pairs = Pairs(["lower", "upper"], left["label"], batch["label"])
            for i, (row, start) in enumerate(zip(low, starts, strict=True)):
                hits = start + np.flatnonzero((first[start:] & row[0]) == row[0])
                for k in range(1, words):
                    if row[k] and len(hits):
                        hits = hits[(up[hits, k] & row[k]) == row[k]]
                if covers and len(hits):
                    known = widened(found[i], words)
                    hits = hits[~_above(up[hits], known)]
                    new = []
                    while len(hits):
                        n = np.searchsorted(sizes[hits], sizes[hits[0]], "right")
                        new.append(hits[:n])
                        hits = hits[n:]
                        hits = hits[~_above(up[hits], up[new[-1]])]
                    hits = np.concatenate(new) if new else hits
                    found[i] = np.concatenate([known, up[hits]])
                if len(hits):
                    yield from pairs.add(i, hits)
            yield from pairs.rest()

    kind = lambda df: df.schema["label"].dataType.simpleString()
    return crossed(lower, upper, ["size"], body, f"lower {kind(lower)}, upper {kind(upper)}")


def _labelled(nodes: DataFrame, label: Column | None) -> DataFrame:
    named = nodes.select("node", (F.col("node") if label is None else label).alias("label"))
    return checkpointed(_placed(nodes).join(named, "node").select("label", "at", "size"))


def covers(nodes: DataFrame, label: Column | None = None) -> DataFrame:
    """The covering relation: (lower, upper) with lower a proper subset and nothing between; nodes by a column or by id.

    Blocks of nodes are compared with all nodes as bits. No pair is shuffled; only covers leave the tasks.
    """
    own = _labelled(nodes, label)
    return _contained(own, own, True, True)


def edges(nodes: DataFrame) -> DataFrame:
    """The covering relation by node, kept for several uses."""
    return checkpointed(covers(nodes))


def contained(nodes: DataFrame, label: Column | None = None) -> DataFrame:
    """(lower, upper) of all nodes that lie below one another: what `reachable` makes of the covering relation, without it."""
    own = _labelled(nodes, label)
    return _contained(own, own, True)


def reachable(edge: DataFrame) -> DataFrame:
    """(lower, upper) of all nodes that lie below one another, from the covering relation."""
    known = fresh = checkpointed(edge.select("lower", "upper").distinct())
    while not fresh.isEmpty():
        step = fresh.select("lower", F.col("upper").alias("m")).join(known.select(F.col("lower").alias("m"), "upper"), "m").select("lower", "upper").distinct()
        fresh = checkpointed(step.join(known, ["lower", "upper"], "left_anti"))
        known = checkpointed(known.union(fresh))
    return known


def _closed_sets(rows: np.ndarray, first: int) -> Iterator[np.ndarray]:
    """Every intersection of rows whose least column is `first`, once, as rows of booleans; all rows have that column.

    Close-by-one: a set grows by a column and by all that the rows with both have in common; if that brings in a smaller
    column, the set comes up elsewhere.
    """
    every = np.arange(rows.shape[1])
    start = rows.all(0)
    if start[:first].any():
        return
    yield start[None]
    rows = rows.astype(np.float32 if len(rows) < 1 << 24 else np.float64)  # counts are exact
    stack = [(rows, start, first)]
    while stack:
        own, held, at = stack.pop()
        own = own[own[:, at] > 0]
        counts = own.sum(0)
        nexts = every[at + 1 :][((counts > 0) & ~held)[at + 1 :]]
        if not len(nexts):
            continue
        sets = (own[:, nexts].T @ own) == counts[nexts, None]
        new = ~(sets & ~held & (every < nexts[:, None])).any(1)
        sets, nexts = sets[new], nexts[new]
        if len(sets):
            yield sets
        stack += [(own, s, k) for s, k in zip(sets, nexts, strict=True) if counts[k] > 1]


def full_lattice(context: DataFrame, most: int | None = None) -> DataFrame:
    """Every intersection of intents, with the union of all: the nodes before empty ones are removed.

    Attributes are numbered, rare ones first. The distinct intents with an attribute go to one group, which finds the
    intersections whose least attribute it is, each once and in a walk that holds one branch; so neither pairs nor sets
    meet in a shuffle. The number of sets can grow exponentially with the attributes; more than `most`, if given, is an
    error, not a cut.
    """
    spark = context.sparkSession
    groups = distinct_intents(context)[0].select("intent")
    n = groups.count()
    owned = groups.select(_node_id().alias("node"), F.explode("intent").alias("attr"))
    owners = owned.groupBy("attr").agg(F.count(F.lit(1)).alias("owners"))
    rare = F.transform(F.sort_array(F.collect_list(F.when(F.col("owners") < n, F.struct("owners", "attr")))), lambda x: x["attr"])
    ends = checkpointed(owners.agg(F.sort_array(F.collect_list("attr")).alias("every"), F.sort_array(F.collect_list(F.when(F.col("owners") == n, F.col("attr")))).alias("common"), rare.alias("rest")))
    parts = max(64, spark.sparkContext.defaultParallelism)
    rows = owned.join(ends.select(F.posexplode("rest").alias("at", "attr")), "attr").groupBy("node").agg(F.collect_list("at").alias("at"))
    each = rows.select(F.explode("at").alias("first"), "at").repartitionById(parts, F.col("first") % parts).sortWithinPartitions("first")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, lists in _runs(batches):
            flat = lists.flatten().to_numpy()
            columns, at = np.unique(flat, return_inverse=True)
            own = np.zeros((len(lists), len(columns)), bool)
            own[np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), at] = True
            held, size, total = [], 0, 0
            for some in _closed_sets(own, int(np.searchsorted(columns, first))):
                held.append(some)
                size, total = size + len(some), total + len(some)
                if most is not None and total > most:
                    break  # the count below makes an error of it
                if size >= 8192:
                    yield _lists(np.concatenate(held), columns)
                    held, size = [], 0
            if held:
                yield _lists(np.concatenate(held), columns)

    named = F.sort_array(F.concat("common", F.transform("at", lambda i: F.get("rest", i))))
    found = each.mapInArrow(sets, "at array<int>").crossJoin(F.broadcast(ends)).select(named.alias("intent"))
    whole = groups.crossJoin(F.broadcast(ends)).where(F.size("intent") == F.size("every")).isEmpty()
    out = found.union(ends.where(F.lit(n > 0)).select("common"))
    out = out.union(ends.where(F.lit(n > 0 and whole)).select("every"))
    if most is not None:
        out = checkpointed(out)
        if out.count() > most:
            raise ValueError(f"more than {most} nodes")
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.ListArray]]:
    """first and all lists `at` of rows sorted by it."""
    key, held = None, []
    for batch in batches:
        firsts = batch["first"].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(firsts)) + 1), len(firsts)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if held and firsts[a] != key:
                yield key, pa.concat_arrays(held)
                held = []
            key = int(firsts[a])
            held.append(batch["at"][a:b])
    if held:
        yield key, pa.concat_arrays(held)


def _lists(sets: np.ndarray, columns: np.ndarray) -> pa.RecordBatch:
    offsets = np.concatenate([[0], sets.sum(1).cumsum()]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, columns[np.nonzero(sets)[1]].astype(np.int32))], names=["at"])


def pair_statistics(nodes: DataFrame) -> DataFrame:
    """By node: distinct callers, callees and functions of its own pairs."""
    own = nodes.select("node", F.explode("reduced").alias("p"))
    return own.groupBy("node").agg(F.countDistinct("p.from").alias("callers"), F.countDistinct("p.to").alias("callees")).join(
        own.select("node", F.explode(F.array("p.from", "p.to")).alias("f")).groupBy("node").agg(F.countDistinct("f").alias("functions")), "node"
    )


def pair_totals(nodes: DataFrame) -> DataFrame:
    """Distinct callers, callees and functions of all nodes' own pairs."""
    own = nodes.select(F.explode("reduced").alias("p"))
    every = own.select(F.explode(F.array(F.struct(F.lit(True).alias("calls"), F.col("p.from").alias("f")), F.struct(F.lit(False).alias("calls"), F.col("p.to").alias("f")))).alias("x")).select("x.*")
    return every.agg(F.countDistinct(F.when(F.col("calls"), F.col("f"))).alias("callers"), F.countDistinct(F.when(~F.col("calls"), F.col("f"))).alias("callees"), F.countDistinct("f").alias("functions"))


def all_objects(nodes: DataFrame, label: Column | None = None) -> DataFrame:
    """node, object: every object whose attributes include the node's, its own ones and those of all nodes above."""
    placed = checkpointed(_placed(nodes))
    shown = nodes.select("node", (F.col("node") if label is None else label).alias("label"))
    objects = nodes.select("node", F.explode("objects").alias("label"))
    side = lambda names: placed.join(names, "node").select("label", "at", "size")
    return _contained(checkpointed(side(shown)), side(objects), False).select(F.col("lower").alias("node"), F.col("upper").alias("object"))


def group_matrix(context: DataFrame, metric: str = "simple") -> DataFrame:
    """Similarity of equality groups by their first objects: each pair once, or both ways for subsumption."""
    groups, _ = distinct_intents(context)
    groups = groups.select(F.col("first").alias("g"), "intent", F.size("intent").alias("n"))
    member = groups.select("g", F.explode("intent").alias("attr"))
    shared = member.alias("x").join(member.alias("y"), "attr").groupBy(F.col("x.g").alias("a"), F.col("y.g").alias("b")).agg(F.count(F.lit(1)).alias("c"))
    size = groups.select("g", "n")
    every = size.select(F.col("g").alias("a"), F.col("n").alias("na")).join(size.select(F.col("g").alias("b"), F.col("n").alias("nb")), F.col("a") > F.col("b") if metric == "simple" else F.col("a") != F.col("b"))
    c = F.coalesce("c", F.lit(0))
    value = c / (F.col("na") + F.col("nb") - c) if metric == "simple" else c / F.col("nb")
    return every.join(shared, ["a", "b"], "left").select("a", "b", value.alias("value"))


def threshold_groups(context: DataFrame, threshold: float) -> DataFrame:
    """Leader clustering of equality groups in order of their least object: (cluster, object).

    A group joins the cluster whose members are most similar to it on average, weighed by their objects, the first
    among equals; below the threshold it opens a new one. Similarities to earlier groups are computed by joins; only
    they pass, in order, through the one task that the sequence needs, which holds a cluster number a group and a
    weight a cluster, but no sets and no objects.
    """
    groups, members = distinct_intents(context)
    kind = context.schema["object"].dataType.simpleString()
    entry = groups.select(F.col("first").alias("g"), "n", F.size("intent").alias("size"), F.explode("intent").alias("attr"))
    x, y = (entry.select("attr", F.col("g").alias(g), F.col("n").alias(f"n_{g}"), F.col("size").alias(f"size_{g}")) for g in "ab")
    met = x.join(y, "attr").where(F.col("a") > F.col("b")).groupBy("a", "b", "n_a", "n_b", "size_a", "size_b").agg(F.count(F.lit(1)).alias("c"))
    earlier = met.select("a", F.col("n_a").alias("n"), "b", (F.col("n_b") * F.col("c") / (F.col("size_a") + F.col("size_b") - F.col("c"))).alias("weighed"))
    alone = groups.select(F.col("first").alias("a"), "n", F.lit(None).cast(kind).alias("b"), F.lit(0.0).alias("weighed"))

    def cluster(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of: dict = {}
        weight: list[int] = []
        held = None

        def place(rows: pd.DataFrame) -> pd.DataFrame:
            out = []
            for first, own in rows.groupby("a", sort=False):
                n, known = int(own.n.iloc[0]), own[own.b.notna()]
                sums: dict[int, float] = {}
                for b, v in zip(known.b, known.weighed, strict=True):
                    sums[of[b]] = sums.get(of[b], 0.0) + v
                best, at = max(((v / weight[k], -k) for k, v in sums.items()), default=(0.0 if weight else -1.0, 0))
                at = -at
                if best < threshold:
                    at = len(weight)
                    weight.append(0)
                weight[at] += n
                of[first] = at
                out.append((first, at))
            return pd.DataFrame(out, columns=["first", "cluster"])

        for part in parts:
            rows = part if held is None else pd.concat([held, part], ignore_index=True)
            last = rows.a == rows.a.iloc[-1] if len(rows) else None
            if len(rows):
                held = rows[last]
                yield place(rows[~last])
        if held is not None:
            yield place(held)

    rows = checkpointed(earlier.unionByName(alone))
    placed = rows.repartition(1).sortWithinPartitions("a", "b").mapInPandas(cluster, f"first {kind}, cluster int")
    return members.join(placed, "first").select("cluster", "object")


def grouped_objects(clusters: DataFrame) -> DataFrame:
    """For display: cluster and its sorted objects."""
    return clusters.groupBy("cluster").agg(F.sort_array(F.collect_list("object")).alias("objects"))


def brute_force_nodes(sets: dict[int, set]) -> set[frozenset]:
    """The surviving nodes by definition, for tests: close under intersection, then drop empty ones."""
    rows = {frozenset(s) for s in sets.values()}
    closed = set(rows)
    for size in range(2, len(rows) + 1):
        closed |= {frozenset.intersection(*c) for c in combinations(rows, size)}
    every = frozenset().union(*rows)
    closed.add(every)
    least = frozenset.intersection(*rows)
    reduced = {c: {a for a in c if not any(d < c and a in d for d in closed)} for c in closed}
    return {c for c in closed if c in (every, least) or c in rows or reduced[c]}


__all__ = ["all_objects", "brute_force_nodes", "concepts", "contained", "covers", "edges", "full_lattice", "group_matrix", "grouped_objects", "intents", "pair_statistics", "pair_totals", "reachable", "threshold_groups"]
