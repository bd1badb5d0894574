import random

import pytest
from pyspark.sql import functions as F

from stackloom.functions import runs
from stackloom.operators import calltree, context, lattice, profiles, render, seqdiff, similarity, stack, unifier
from stackloom.sources import otf1
from stackloom.sources import traces as open_traces
from tests import traces


def calls_of(spark, path, **more):
    trace = otf1.read_trace(spark, path, **more)
    names = unifier.unify(trace.functions)
    return trace, stack.calls_from_events(otf1.unified_events(trace.events, names))


def test_profile_fixture(spark, tmp_path):
    events = {p: f"*{p:x}\n" + "".join(f"{a:x}\nE{f:x}\n{b:x}\nL{f:x}\n\n" for f, a, b in rows) for p, rows in traces.PROFILE.items()}
    trace, calls = calls_of(spark, traces.write(tmp_path, "a", events, 8))
    assert {(r.process, r.name) for r in trace.processes.collect()} == {(1, "Process 1"), (2, "Process 2")}
    assert trace.groups.first().grp == 0x3E8 and trace.functions.count() == 7
    want = {1: (15, 1, 2, 3, 4, 5, 1, 5, 3.0, 5), 2: (31, 1, 6, 7, 8, 9, 1, 9, 6.2, 5)}
    for df, cond in ((profiles.call_list(calls), "function = 3"), (profiles.call_matrix(calls), "caller = 0 and function = 3"), (profiles.call_tree(stack.call_paths(calls)), "path = array(3)")):
        rows = {r.process: r for r in df.where(cond).collect()}
        assert {p: tuple(r.exc) for p, r in rows.items()} == want and {p: tuple(r.inc) for p, r in rows.items()} == want
    both = profiles.accumulated(calls, ["function"]).where("function = 3").first()
    assert tuple(both.exc) == (46, 1, 2, 5, 7, 9, 1, 9, 4.6, 10) and both.invocations == 10
    zero = profiles.profile(calls, ["function"]).where("function = 1").first()
    assert tuple(zero.inv) == (1, 0, 0, 1, 1, 1, 0, 1, 0.5, 2)
    only = otf1.read_trace(spark, str(tmp_path / "a.otf"), processes=[2]).events
    assert [r[0] for r in only.select("process").distinct().collect()] == [2]
    assert stack.select_processes(calls, [(1, 1)]).select("process").distinct().count() == 1
    for wrong in ([1, 1], [7]):
        with pytest.raises(ValueError):
            stack.select_processes(calls, wrong)


def test_stack_defects(spark):
    """Leaves without an enter are dropped, unclosed calls dropped or clamped."""
    rows = [(1, 1, i, t, k, f) for i, (t, k, f) in enumerate([(0, "L", None), (1, "E", 1), (2, "E", 2), (3, "L", None), (4, "L", 1), (5, "L", None), (6, "E", 3), (7, "E", 4), (9, "L", 4)])]
    events = spark.createDataFrame(rows, "trace_id int, process long, line long, ts long, kind string, function int")
    got = {(r.function, r.caller, r.t_begin, r.t_end, r.exclusive) for r in stack.calls_from_events(events).collect()}
    assert {g[:4] for g in got} >= {(1, 0, 1, 4), (2, 1, 2, 3)} and not any(g[0] == 3 for g in got)
    clamped = {(r.function, r.t_begin, r.t_end) for r in stack.calls_from_events(events, "clamp").collect()}
    assert (3, 6, 9) in clamped and (4, 7, 9) in clamped
    # A call below one that stays open moves up to the root, and takes no earlier call for its parent.
    assert next(tuple(r) for r in stack.calls_from_events(events).where("function = 4").select("parent_call_id", "depth", "caller").collect()) == (None, 1, 0)


@pytest.fixture(scope="module")
def similar(spark, tmp_path_factory):
    """All fixtures as one table: process 10 k + 1 and 10 k + 2 for trace k."""
    folder = tmp_path_factory.mktemp("similar")
    events = {10 * k + s + 1: traces.event_lines(forest, 10 * k + s + 1) for k, pair in enumerate(traces.SIMILAR.values()) for s, forest in enumerate(pair)}
    _, calls = calls_of(spark, traces.write(folder, "s", events))
    return stack.call_paths(calls).cache()


@pytest.mark.parametrize("metric", traces.EXPECTED)
def test_similarity(similar, metric):
    values = {(r.p, r.q): r.value for r in similarity.compare(similar, metric).collect()}
    for k, name in enumerate(traces.SIMILAR):
        p, q = 10 * k + 1, 10 * k + 2
        assert (values[p, q], values[q, p]) == pytest.approx(traces.EXPECTED[metric][name]), name
    assert all(v == 1 for (p, q), v in values.items() if p == q) and all(0 <= v <= 1 for v in values.values())
    if metric not in ("uccm", "uct"):
        assert all(v == pytest.approx(values[q, p]) for (p, q), v in values.items())


def test_tours_trees_and_compression(similar):
    tours = {r.process: r.seq for r in seqdiff.flat_sequences(similar).collect()}
    assert tours[11] == [1, 2, 3, 2, 1] and tours[31] == [1, 2, 1]
    pairs = similar.sparkSession.createDataFrame([(11, 12), (32, 31)], "p long, q long")
    diff = {r.p: r for r in seqdiff.diff_pairs(seqdiff.flat_sequences(similar), pairs).collect()}
    assert diff[11].score == 5 and diff[31].score == 1
    trees = {r.p: r for r in seqdiff.diff_trees(seqdiff.tree_sequences(similar), pairs).collect()}
    assert trees[11].score == 5 and [(x.op, x.function) for x in trees[11].rows] == [(0, 1), (0, 2), (0, 3), (1, 4)]
    one = similar.where("process = 1")
    # 5, 4{5}, 2{...}, 3{2}, 1{...} and the root, of ten calls
    assert calltree.compressed_node_count(one).first().nodes == 6 and profiles.node_count(one).first().nodes == 11
    assert calltree.compressed_edges(one).count() == 7
    assert render.tree_dot(one).count() == 2 * 10 + 2


def test_empty_sets(spark):
    ctx = spark.createDataFrame([(1, 5)], "object long, attr int")
    every = spark.createDataFrame([(1,), (2,), (3,)], "object long")
    values = {(r.p, r.q): r.value for r in similarity.jaccard(ctx, every).collect()}
    assert values[2, 3] == values[2, 2] == 1 and values[1, 2] == values[2, 1] == 0 and len(values) == 9


def test_unifier(spark):
    names = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "a"), (2, 1, "a"), (2, 2, "c")], "trace_id int, token int, name string")
    ids = {(r.trace_id, r.token): r.function for r in unifier.unify(names).collect()}
    assert ids == {(1, 1): 1, (1, 2): 2, (1, 3): 1, (2, 1): 1, (2, 2): 3}


def test_lattices(spark):
    for name, (rows, nodes) in traces.CONTEXTS.items():
        ctx = spark.createDataFrame([(o, a) for o, attrs in rows.items() for a in attrs], "object long, attr int")
        found = {frozenset(r.intent) for r in lattice.concepts(ctx).select("intent").collect()}
        assert len(found) == nodes and found == lattice.brute_force_nodes({o: set(a) for o, a in rows.items()}), name
    last = lattice.concepts(ctx).collect()
    assert sum(not r.reduced for r in last) >= 4
    groups = lattice.threshold_groups(spark.createDataFrame([(o, a) for o, attrs in traces.CONTEXTS["d"][0].items() for a in attrs], "object long, attr int"), 0.9)
    assert {tuple(r.objects) for r in lattice.grouped_objects(groups).collect()} == {(1,), (2, 4), (3, 5)}


def test_lattice_edges_and_full(spark):
    r = random.Random(5)
    rows = {o: {a for a in range(6) if r.random() < 0.5} | {6} for o in range(6)}
    ctx = spark.createDataFrame([(o, a) for o, attrs in rows.items() for a in attrs], "object long, attr int")
    nodes = lattice.concepts(ctx).cache()
    sets = {x.node: frozenset(x.intent) for x in nodes.collect()}
    assert set(sets.values()) == lattice.brute_force_nodes(rows)
    below = {(a, b) for a in sets for b in sets if sets[a] < sets[b]}
    cover = {(a, b) for a, b in below if not any((a, c) in below and (c, b) in below for c in sets)}
    edges = lattice.edges(nodes).cache()
    assert {tuple(e) for e in edges.select("lower", "upper").collect()} == cover
    assert {tuple(e) for e in lattice.reachable(edges).select("lower", "upper").collect()} == below
    closed = {frozenset(s) for s in rows.values()}
    while new := {a & b for a in closed for b in closed} - closed:
        closed |= new
    assert {frozenset(x.intent) for x in lattice.full_lattice(ctx).collect()} == closed | {frozenset().union(*rows.values())}
    with pytest.raises(ValueError):
        lattice.full_lattice(ctx, 1)
    assert render.cxt(ctx).splitlines()[0] == "B"
    assert render.lattice_dot(nodes, edges).count() == len(sets) + len(cover) + 2


def test_closure_with_cycles(spark):
    pairs = {1: {(0, 1), (1, 2), (2, 1), (2, 3)}, 2: {(0, 1), (1, 1)}, 3: {(0, 1), (1, 2), (2, 1), (2, 3)}}
    ctx = spark.createDataFrame([(o, p) for o, ps in pairs.items() for p in ps], "object long, attr struct<from:int,to:int>")
    got: dict[int, set] = {}
    for r in context.transitive(ctx).collect():
        got.setdefault(r.object, set()).add(tuple(r.attr))
    for o, ps in pairs.items():
        closed = set(ps)
        while new := {(a, d) for a, b in closed for c, d in closed if b == c} - closed:
            closed |= new
        assert got[o] == closed


def test_written_trace_reads_back(spark, tmp_path):
    events = {p: traces.event_lines(f, p) for p, f in zip((1, 2), traces.SIMILAR["a"], strict=True)}
    _, calls = calls_of(spark, traces.write(tmp_path, "w", events))
    calls = stack.call_paths(calls).cache()
    names = spark.createDataFrame([(f, f"F{f}") for f in range(1, 16)], "function int, name string")
    otf1.write_trace(calls, names, str(tmp_path / "out.otf"))
    _, again = calls_of(spark, str(tmp_path / "out.otf"))
    shape = lambda c: sorted((r.process, r.seq) for r in seqdiff.flat_sequences(c).collect())
    assert shape(calls) == shape(stack.call_paths(again))
    lines = render.call_list_lines(profiles.call_list(calls)).collect()
    assert lines and "exclusive" in lines[0].line
    assert render.call_tree_lines(profiles.call_tree(calls)).first().line.startswith("\t")
    assert render.profile_lines(profiles.profile(calls, ["caller", "function"]), ["caller", "function"], "inv").first().line
    assert render.similarity_lines(similarity.compare(calls, "scm")).first().line == "1.00 0.71"
    assert render.tikz(render.rectangles(calls)).count() == calls.count()
    assert render.named(profiles.call_list(calls), names).where(F.col("function") == "F1").count() == 2


PRINTED = """=== OTF2-PRINT ===

=== Content of OTF2 global definitions ===

STRING                     0  "main"
STRING                     1  "MPI_Send"
STRING                     2  "Master thread"
STRING                     3  "MPI Rank 0"
STRING                     4  "cuda kernel"
LOCATION_GROUP             0  Name: "MPI Rank 0" <3>, Type: PROCESS, Parent: "node" <0>
LOCATION                   0  Name: "Master thread" <2>, Type: CPU_THREAD, # Events: 6, Group: "MPI Rank 0" <0>
LOCATION          4294967296  Name: "Master thread" <2>, Type: GPU, # Events: 2, Group: "MPI Rank 0" <0>
LOCATION                   7  Name: "Master thread" <2>, Type: METRIC, # Events: 2, Group: "MPI Rank 0" <0>
REGION                     0  Name: "main" <0> (Aka. "main" <0>), Descr.: "" <0>, Role: FUNCTION, Paradigm: COMPILER, File: "a.c" <0>
REGION                     1  Name: "MPI_Send" <1>, Role: POINT2POINT, Paradigm: MPI
REGION                     2  Name: <4>, Role: FUNCTION, Paradigm: CUDA

=== Events ===

ENTER                      0                   10  Region: "main" <0>
METRIC                     7                   11  Metric: 0, 1 Value: ("x" <0>; UINT64; 5)
ENTER                      7                   11  Region: "main" <0>
ENTER                      0                   12  Region: "MPI_Send" <1>
ENTER             4294967296                   12  Region: <2>
LEAVE                      0                   15  Region: "MPI_Send" <1>
LEAVE             4294967296                   19  Region: <2>
LEAVE                      0                   20  Region: "main" <0>
"""


def test_printed_trace(spark, tmp_path):
    """Names by string and group, groups by paradigm, metric locations left out, ids defined twice refused."""
    path = tmp_path / "p.txt"
    path.write_text(PRINTED)
    trace = open_traces.open_trace(spark, str(path))
    assert {(r.process, r.name) for r in trace.processes.collect()} == {(0, "Master thread:MPI Rank 0"), (1 << 32, "Master thread:MPI Rank 0")}
    assert {(r.token, r.name, r.grp) for r in trace.functions.collect()} == {(0, "main", 1), (1, "MPI_Send", 2), (2, "cuda kernel", 5)}
    assert {r.name for r in trace.groups.collect()} == {"Application", "MPI", "OpenMP", "Pthreads", "CUDA"}
    assert {(r.grp, tuple(r.tokens)) for r in open_traces.group_members(trace.functions).collect()} == {(1, (0,)), (2, (1,)), (5, (2,))}
    calls = stack.calls_from_events(otf1.unified_events(trace.events, unifier.unify(trace.functions)))
    assert {(r.process, r.function, r.caller, r.t_begin, r.t_end, r.exclusive) for r in calls.collect()} == {(0, 1, 0, 10, 20, 7), (0, 2, 1, 12, 15, 3), (1 << 32, 3, 0, 12, 19, 7)}
    assert open_traces.open_trace(spark, str(path), processes=[0]).events.select("process").distinct().count() == 1
    path.write_text(PRINTED.replace("REGION                     2 ", "REGION                     1 "))
    with pytest.raises(ValueError, match="already been defined"):
        open_traces.open_trace(spark, str(path))
    path.write_text("hello\n")
    with pytest.raises(ValueError, match="neither"):
        open_traces.open_trace(spark, str(path))
    with pytest.raises(ValueError, match="opened"):
        open_traces.open_trace(spark, str(tmp_path / "none"))


def test_long_event_files_are_split(spark, tmp_path):
    """Lines keep their order across the splits of a file."""
    n = 4000
    text = "*1\n" + "".join(f"{2 * i + 1:x}\nE1\n{2 * i + 2:x}\nL\n" for i in range(n))
    path = traces.write(tmp_path, "long", {1: text})
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3k")
    try:
        trace, calls = calls_of(spark, path)
        assert trace.events.rdd.getNumPartitions() >= 1 and calls.where("inclusive = 1 and t_begin = 2 * (t_begin div 2) + 1").count() == n
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_extraction(spark, tmp_path):
    """Matched nodes with many children are written with what lies below them, as traces of their own."""
    a, b = [(1, (2, (5,), (5,), (5, (6,))), (3,))], [(1, (2, (5,), (5,)), (4,))]
    _, calls = calls_of(spark, traces.write(tmp_path, "x", {1: traces.event_lines(a, 1), 2: traces.event_lines(b, 2)}))
    calls = stack.call_paths(calls).cache()
    names = spark.createDataFrame([(f, f"F{f}") for f in range(1, 16)], "function int, name string")
    found = otf1.extract_long(calls, 2, 1, names, str(tmp_path / "x.otf"), 5)
    assert [f.rpartition("/")[2] for f in found] == ["x-extract-p1-p2-1-3-2.otf"]
    trace, again = calls_of(spark, found[0])
    assert {r.name for r in trace.functions.collect()} == {"F5", "F6"}
    tours = {r.process: r.seq for r in seqdiff.flat_sequences(stack.call_paths(again)).collect()}
    assert tours == {1: [1, 1, 1, 2, 1], 2: [1, 1]}
    assert len(otf1.extract_long(calls, 1, 2, names, str(tmp_path / "x.otf"), 4)) == 2


def test_leader_clustering_by_brute_force(spark):
    r = random.Random(9)
    for threshold in (0.3, 0.6, 0.9):
        rows = {o: frozenset(r.sample(range(8), r.randint(1, 6))) for o in range(60)}
        groups: dict = {}
        for o, s in rows.items():
            groups.setdefault(s, []).append(o)
        clusters: list = []
        for s, objects in sorted(groups.items(), key=lambda x: min(x[1])):
            means = [sum(len(o) * len(s & m) / len(s | m) for m, o in c) / sum(len(o) for _, o in c) for c in clusters]
            best = max(means, default=-1)
            if best < threshold:
                clusters.append([])
                means.append(best := 2)
            clusters[means.index(best)].append((s, objects))
        want = {o: k for k, c in enumerate(clusters) for _, objects in c for o in objects}
        ctx = spark.createDataFrame([(o, a) for o, s in rows.items() for a in s], "object long, attr int")
        assert {x.object: x.cluster for x in lattice.threshold_groups(ctx, threshold).collect()} == want


def test_checksum_and_merging(spark, similar):
    assert render.checksum(b"123456789") == 0x906E  # the check value of this CRC
    one, two = similar.where("process < 20"), similar.where("process >= 20")
    assert stack.merged(one, two).count() == similar.count()
    with pytest.raises(ValueError, match="in both"):
        stack.merged(one, similar)


def test_timing_roll_up(spark):
    rows = [(4, s, 7, 9, 5, 3) for s in (0.5, 0.1, 0.9, 0.3, 0.7)] + [(8, 1.0, 7, 9, 5, 3), (8, 2.0, 7, 9, 6, 3)]
    df = spark.createDataFrame(rows, "procs int, total double, attributes int, nodes_with_empty int, nodes int, groups int")
    got = {r.procs: (r.runs, r.min, r.med, r.max) for r in runs.roll_up(df, ["procs"], ["total"]).collect()}
    assert got == {4: (5, 0.1, 0.5, 0.9), 8: (2, 1.0, 2.0, 2.0)}
    assert [(r.procs, r.wrong) for r in runs.disagreeing(df, ["procs"]).collect()] == [(8, ["nodes"])]
