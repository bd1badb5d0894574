"""Lattices and matrices of many distinct sets: results by definition, and no pairs in shuffles."""

import random

import numpy as np
import pytest

from stackloom.operators import blocks, lattice, render, similarity


def shuffled(spark, action):
    """What action returns, and the rows that it wrote to shuffles."""
    sc = spark.sparkContext
    bus, store = sc._jsc.sc().listenerBus(), sc._jsc.sc().statusStore()

    def written():
        bus.waitUntilEmpty()
        stages = store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    out = action()
    return out, written() - before


@pytest.fixture(scope="module")
def many(spark):
    """Random sets of 16 of 90 attributes that many share: a context, its nodes and their sets."""
    dice = random.Random(3)
    rows = {o: sorted({dice.randrange(16) * 6 - dice.randrange(2) * (dice.random() < 0.02) for _ in range(dice.randrange(1, 9))}) for o in range(500)}
    ctx = spark.createDataFrame([(o, a + 6) for o, attrs in rows.items() for a in attrs], "object long, attr int").cache()
    nodes = lattice.concepts(ctx).cache()
    return ctx, nodes, {r.node: frozenset(r.intent) for r in nodes.collect()}, {o: frozenset(a + 6 for a in attrs) for o, attrs in rows.items()}


def covering(sets):
    below = {(x, y) for x in sets for y in sets if sets[x] < sets[y]}
    above = {}
    for x, y in below:
        above.setdefault(x, set()).add(y)
    return below, {(x, y) for x, y in below if not any((z, y) in below for z in above[x])}


def test_dot_of_many_nodes(spark, many, monkeypatch):
    monkeypatch.setattr(blocks, "ROWS", 150)
    _, nodes, sets, _ = many
    rows, moved = shuffled(spark, lambda: render.lattice_dot(nodes, lattice.edges(nodes)).where("ord = 2").collect())
    assert sorted(r.line for r in rows) == sorted(f'  "{x[:12]}" -> "{y[:12]}";' for x, y in covering(sets)[1])
    assert moved < 60 * len(sets)


def test_covers_of_many_nodes(spark, many, monkeypatch):
    _, nodes, sets, _ = many
    for size in (100_000, 150):
        monkeypatch.setattr(blocks, "ROWS", size)
        rows, moved = shuffled(spark, lambda: lattice.edges(nodes).collect())
        assert {tuple(r) for r in rows} == covering(sets)[1] and len(rows) == len({tuple(r) for r in rows})
        assert moved < 40 * len(sets) < len(sets) ** 2 / 8


def test_contained_of_many_nodes(spark, many, monkeypatch):
    monkeypatch.setattr(blocks, "ROWS", 150)
    _, nodes, sets, _ = many
    rows, moved = shuffled(spark, lambda: lattice.contained(nodes).collect())
    assert {tuple(r) for r in rows} == covering(sets)[0] and len(rows) == len({tuple(r) for r in rows})
    assert moved < 40 * len(sets)


def test_objects_of_many_nodes(spark, many, monkeypatch):
    monkeypatch.setattr(blocks, "ROWS", 150)
    _, nodes, sets, own = many
    rows, moved = shuffled(spark, lambda: lattice.all_objects(nodes).collect())
    assert sorted(map(tuple, rows)) == sorted((n, o) for n, s in sets.items() for o, attrs in own.items() if s <= attrs)
    assert moved < 40 * len(sets)


def test_full_lattice_of_many_sets(spark, many):
    ctx, _, _, own = many
    base = set(own.values())
    closed = fresh = base
    while fresh:
        fresh = {x & y for x in fresh for y in base} - closed
        closed = closed | fresh
    rows, moved = shuffled(spark, lambda: lattice.full_lattice(ctx).collect())
    assert len(rows) == len({tuple(r.intent) for r in rows}) and {frozenset(r.intent) for r in rows} == closed | {frozenset().union(*base)}
    assert all(r.intent == sorted(r.intent) for r in rows)
    assert moved < 60 * len(own)
    with pytest.raises(ValueError, match="more than"):
        lattice.full_lattice(ctx, len(rows) - 1)
    assert lattice.full_lattice(ctx, len(rows)).count() == len(rows)


def test_full_lattice_with_common_attributes(spark):
    """Sets that all share an attribute, one of which has all; and a single set."""
    for rows, want in (({1: [1, 2], 2: [1, 3], 3: [1, 2, 3]}, [[1], [1, 2], [1, 2, 3], [1, 3]]), ({1: [4, 5]}, [[4, 5]]), ({1: [1], 2: [2]}, [[], [1], [1, 2], [2]])):
        ctx = spark.createDataFrame([(o, a) for o, attrs in rows.items() for a in attrs], "object long, attr int")
        assert sorted(r.intent for r in lattice.full_lattice(ctx).collect()) == want


def test_matrix_of_many_vectors(spark):
    """Each pair from its definition, copies and strangers included."""
    dice = random.Random(5)
    rows = {o: {a: dice.randrange(1, 9) for a in dice.sample(range(12), dice.randrange(1, 6))} for o in range(300)} | {o: {50: 2} for o in range(300, 304)}
    w = spark.createDataFrame([(o, a, n) for o, own in rows.items() for a, n in own.items()], "object long, attr int, w long").cache()
    want = {(p, q): sum(x.values()) / (sum(x.values()) + sum(y.values()) - sum(min(n, y.get(a, 0)) for a, n in x.items())) for p, x in rows.items() for q, y in rows.items()}
    score = lambda met, tp, tq, np_, nq: tp / (tp + tq - met)
    found, moved = shuffled(spark, lambda: similarity._weighted(w, [np.minimum], score).collect())
    assert len(found) == len(want) and {(r.p, r.q): r.value for r in found} == want
    assert moved < 50 * len(rows) < len(want) / 4
