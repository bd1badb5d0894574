"""Closed calls from a stream of enter and leave events: one call stack per process is all the state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "process long, function int, caller int, depth int, t_begin long, t_end long, inclusive long, exclusive long"
STATE = "function array<int>, t_begin array<long>, below array<long>"


def _advance(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    function, begin, below = ([list(x) for x in state.get] if state.exists else [[], [], []])
    rows = []
    events = pd.concat(list(parts), ignore_index=True).sort_values(["line"], kind="stable")
    for ts, kind, f in zip(events["ts"], events["kind"], events["function"], strict=True):
        if kind == "E":
            function.append(int(f))
            begin.append(int(ts))
            below.append(0)
        elif function:  # a leave without an open call is dropped
            own, start, inner = function.pop(), begin.pop(), below.pop()
            inclusive = int(ts) - start
            if below:
                below[-1] += inclusive
            rows.append((key[0], own, function[-1] if function else 0, len(function) + 1, start, int(ts), inclusive, inclusive - inner))
    state.update((function, begin, below))
    yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUTPUT.split(", ")])


def closed_calls(events: DataFrame) -> DataFrame:
    """events: process, line (order within the process), ts, kind, function; calls come out as they are left."""
    return events.groupBy("process").applyInPandasWithState(_advance, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
