import random
import time

import pytest

from stackloom.operators import seqdiff
from stackloom.operators.seqdiff import Tree, flat_diff, flat_scores, tree_diff, tree_scores

# Sequences, anchors, differences and scores that other implementations must find, too.
UNIT = [
    ([1, 3, 4], [1], [(0, [1]), (-1, [3, 4])]),
    ([1, 3, 4], [3, 4], [(-1, [1]), (0, [3, 4])]),
    ([1], [1, 3, 4], [(0, [1]), (1, [3, 4])]),
    ([3, 4], [1, 3, 4], [(1, [1]), (0, [3, 4])]),
    ([1, 2, 11, 2, 12, 2, 1], [1, 2, 12, 2, 11, 2, 1], [(0, [1, 2]), (-1, [11, 2]), (0, [12]), (1, [2, 11]), (0, [2, 1])]),
    ([1, 4, 6, 7, 8, 1, 10, 3, 10, 1], [6, 7, 8], [(-1, [1, 4]), (0, [6, 7, 8]), (-1, [1, 10, 3, 10, 1])]),
]
S1, S2, S3, S4, S5 = [1, 2, 3, 4], [1, 1, 2, 3, 4], [1, 2, 3, 4, 4], [1, 2, 1, 3, 1, 2, 1], [1, 2, 1]
SAME = [(0, S1)]
ANCHORED = [
    (S1, S1, [], SAME),
    (S1, S1, [(0, 0), (1, 1), (2, 2), (3, 3)], SAME),
    (S1, S1, [(0, 0), (2, 2)], SAME),
    (S1, S1, [(1, 1), (2, 2)], SAME),
    (S1, S1, [(1, 1), (3, 3)], SAME),
    (S1, S2, [(0, 0)], [(0, [1]), (1, [1]), (0, [2, 3, 4])]),
    (S1, S2, [(0, 1)], [(1, [1]), (0, [1, 2, 3, 4])]),
    (S1, S3, [(3, 3)], [(0, [1, 2, 3, 4]), (1, [4])]),
    (S1, S3, [(3, 4)], [(0, [1, 2, 3]), (1, [4]), (0, [4])]),
    (S1, S1, [(0, 2)], [(-1, [1, 2, 3]), (1, [1, 2, 3]), (0, [4])]),
    (S1, S1, [(3, 0)], [(-1, S1), (1, S1)]),
    (S1, S1, [(1, 0), (3, 1)], [(-1, S1), (1, S1)]),
    (S4, S5, [(0, 0), (2, 2)], [(0, [1, 2, 1]), (-1, [3, 1, 2, 1])]),
    (S4, S5, [(2, 0), (4, 2)], [(-1, [1, 2]), (0, [1]), (-1, [3]), (1, [2]), (0, [1]), (-1, [2, 1])]),
    (S4, S5, [(4, 0), (6, 2)], [(-1, [1, 2, 1, 3]), (0, [1, 2, 1])]),
]
# trace: (a, b, flat score, achievable, most, tree score); a tree is (function, children...)
TRACES = [
    ([(1, (2, (3,), (3,)), (2, (3,), (3, (4,)), (3,)))], [(1, (2, (3,), (3,)), (2, (3,), (3,), (3, (4,))))], 15, 17, 17, 15),
    ([(1, (2, (3,)), (4, (5,)))], [(1, (3,), (4, (5,)))], 7, 7, 9, 6),
    ([(1, (4,), (4,)), (1,), (1,), (3,), (1,), (1,), (2,)], [(1, (4,), (4,)), (2,), (1,), (1,), (2,), (1,), (1,)], 9, 11, 11, 9),
    ([(1, (2,), (2,))], [(3,)], 0, 1, 5, 0),
    ([(1,), (2, (4, (5,), (5,)), (4,))], [(2, (4, (5,)), (4,)), (3,)], 7, 8, 10, 7),
]


def tree(forest):
    root = Tree()

    def put(parent, node):
        own = Tree(node[0])
        parent.calls.append(own)
        for child in node[1:]:
            put(own, child)

    for node in forest:
        put(root, node)
    return root


def tour(forest):
    out = []
    for f, *children in forest:
        out.append(f)
        for c in children:
            out += [*tour([c]), f]
    return out


@pytest.mark.parametrize(("a", "b", "ops"), UNIT)
def test_unit(a, b, ops):
    assert flat_diff(a, b) == ops


@pytest.mark.parametrize(("a", "b", "anchors", "ops"), ANCHORED)
def test_anchors(a, b, anchors, ops):
    assert flat_diff(a, b, anchors) == ops


@pytest.mark.parametrize(("a", "b", "score", "achievable", "most", "in_tree"), TRACES)
def test_traces(a, b, score, achievable, most, in_tree):
    assert flat_scores(flat_diff(tour(a), tour(b))) == (score, achievable, most)
    assert tree_scores(tree(a), tree(b)) == (in_tree, achievable, most)
    rows = tree_diff(tree(a), tree(b))
    assert sum(o <= 0 for o, _, _ in rows) == tree(a).size() and sum(o >= 0 for o, _, _ in rows) == tree(b).size()


def test_round_trip_and_length():
    """Both sides come back, and no difference is shorter, by the table of longest common subsequences."""
    r = random.Random(3)
    for size, letters, rounds in ((14, 4, 300), (60, 3, 40), (60, 40, 40)):
        for _ in range(rounds):
            a, b = ([r.randint(1, letters) for _ in range(r.randint(0, size))] for _ in range(2))
            ops = flat_diff(a, b)
            assert [x for o, s in ops if o <= 0 for x in s] == a and [x for o, s in ops if o >= 0 for x in s] == b
            table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
            assert flat_scores(ops)[0] == table[-1][-1] and ops == seqdiff.canonical(ops)


def test_near_equal_long_sequences():
    """Time grows with the differences, not with the product of the lengths."""
    r = random.Random(5)
    a = [r.randint(1, 9) for _ in range(200_000)]
    b = a.copy()
    for at in (10, 777, 150_000):
        b[at] = 10
    began = time.perf_counter()
    ops = flat_diff(a, b)
    assert flat_scores(ops)[0] == 200_000 - 3 and time.perf_counter() - began < 10


def test_long_matches():
    a, b = tree([(1, (2,), (2,), (3, (4,)))]), tree([(1, (2,), (3, (4,), (4,)))])
    assert [(path, len(x.calls), len(y.calls), x.at, y.at) for path, x, y in seqdiff.long_matches(a, b, 3)] == [([1], 3, 2, 0, 0), ([1, 3], 1, 2, 0, 0)]


def test_canonical_form():
    assert seqdiff.canonical([(1, [2]), (-1, [1]), (0, []), (1, [3]), (0, [4]), (0, [5])]) == [(-1, [1]), (1, [2, 3]), (0, [4, 5])]
