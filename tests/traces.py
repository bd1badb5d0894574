"""Small traces for tests: nested literals, written as trace files."""

from __future__ import annotations

# The small traces, contexts and expected results below are known cases that any implementation must meet.

#: Similarity fixtures: a node is (function, children...).
SIMILAR = {
    "a": ([(1, (3, (2, (4, (5,)), (5,))), (2, (4, (5,)), (5,)))], [(1, (2, (4, (5,)), (5,)))]),
    "b": ([(1, (2, (3,)))], [(1, (2, (3, (4,))))]),
    "c": ([(1, (3,), (2,))], [(1, (2,))]),
    "d": ([(1, (2,))], [(2,)]),
    "e": tuple([(1, (6, (5,)), (9,), (8,), (2, (3, (x,))), (2, (4, (10,))), (7, (5,)))] for x in (11, 12)),
}
#: metric -> trace -> ((p, q) value, (q, p) value)
EXPECTED = {
    "scm": {"a": (5 / 7, 5 / 7), "b": (3 / 4, 3 / 4), "c": (2 / 3, 2 / 3), "d": (0, 0), "e": (11 / 13, 11 / 13)},
    "uccm": {"a": (1, 10 / 15), "b": (6 / 10, 1), "c": (1, 3 / 5), "d": (1, 1 / 3), "e": (25 / 29, 25 / 29)},
    "sct": {"a": (5 / 10, 5 / 10), "b": (3 / 4, 3 / 4), "c": (2 / 3, 2 / 3), "d": (0, 0), "e": (11 / 13, 11 / 13)},
    "uct": {"a": (1, 13 / 31), "b": (6 / 10, 1), "c": (1, 3 / 5), "d": (1, 1 / 3), "e": (31 / 35, 31 / 35)},
    "icscm": {"a": (1 / 2, 1 / 2), "b": (3 / 4, 3 / 4), "c": (2 / 3, 2 / 3), "d": (0, 0), "e": (11 / 13, 11 / 13)},
}
#: Lattice fixtures: object -> attributes, and the nodes that stay.
CONTEXTS = {
    "a": ({1: [1], 2: [1, 2]}, 2),
    "b": ({1: [1, 2], 2: [1]}, 2),
    "c": ({1: [1, 2, 3], 2: [1], 3: [1, 2]}, 3),
    "d": ({1: [1, 2, 3], 2: [1], 3: [1, 2], 4: [1], 5: [1, 2]}, 3),
    "e": ({1: [1], 2: [2]}, 4),
    "f": ({1: [3], 2: [1, 3], 3: [2, 3]}, 4),
    "g": ({1: [3, 4], 2: [1, 2, 3, 4], 3: [1, 3]}, 4),
    "h": ({1: [1], 2: [2, 3], 3: [2]}, 5),
    "i": ({1: [1], 2: [2, 3, 4, 5], 3: [2, 3], 4: [2, 4]}, 7),
    "j": ({1: [3], 2: [1, 3, 4], 3: [4], 4: [2, 3]}, 6),
    "k": ({1: [3], 2: [1, 3, 4], 3: [4], 4: [2, 3, 4]}, 6),
    "l": ({1: [1, 2], 2: [1, 3], 3: [2, 3, 4]}, 8),
}
#: (function, begin, end) of the two processes of the profile fixture.
PROFILE = {
    1: [(1, 0, 0), *[(3, a, b) for a, b in ((1, 2), (3, 5), (6, 9), (10, 14), (15, 20))]],
    2: [(2, 0, 0), *[(3, a, b) for a, b in ((1, 2), (3, 9), (10, 17), (18, 26), (27, 36))]],
}


def event_lines(forest: list[tuple], process: int) -> str:
    out, time = [f"*{process:x}"], 0

    def put(node: tuple) -> None:
        nonlocal time
        time += 1
        out.append(f"{time:x}\nE{node[0]:x}")
        for child in node[1:]:
            put(child)
        time += 1
        out.append(f"{time:x}\nL{node[0]:x}")

    for node in forest:
        put(node)
    return "\n".join(out) + "\n"


def write(folder, name: str, events: dict[int, str], functions: int = 16) -> str:
    (folder / f"{name}.otf").write_text("".join(f"{p:x}:{p:x}\n" for p in events))
    defs = ["DTR1", *[f'DP{p:x}NM"Process {p}"' for p in events], 'DFG3e8NM"Application"', *[f'DF{f:x}G3e8NM"F{f}"' for f in range(1, functions)]]
    (folder / f"{name}.0.def").write_text("\n".join(defs) + "\n")
    for p, text in events.items():
        (folder / f"{name}.{p:x}.events").write_text(text)
    return str(folder / f"{name}.otf")
