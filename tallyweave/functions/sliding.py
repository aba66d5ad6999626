"""Order statistics of the last d rows, kept up to date as rows enter and leave.

Rows come from Spark in the order of their keys; a row costs the logarithm of d (and the move of a short list), and a
task holds d values for each statistic.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import deque
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa

# The result type of each statistic.
KINDS = {"rank": "double", "since_min": "int", "since_max": "int"}


class Rank:
    """Share of the window's present values that are at most the newest one."""

    def __init__(self, rows: int):
        self.rows, self.held, self.ordered = rows, deque(), []

    def push(self, value: float | None) -> float | None:
        if len(self.held) == self.rows:
            gone = self.held.popleft()
            if gone is not None:
                del self.ordered[bisect_left(self.ordered, gone)]
        self.held.append(value)
        if value is None:
            return None
        insort(self.ordered, value)
        if len(self.held) < self.rows:
            return None
        return bisect_right(self.ordered, value) / len(self.ordered)


class Since:
    """Rows since the window's smallest value (largest with sign -1); the latest of equals counts."""

    def __init__(self, rows: int, sign: int):
        self.rows, self.sign, self.at, self.best = rows, sign, 0, deque()

    def push(self, value: float | None) -> int | None:
        self.at += 1
        if value is not None:
            value *= self.sign
            while self.best and self.best[-1][1] >= value:
                self.best.pop()
            self.best.append((self.at, value))
        if self.best and self.best[0][0] <= self.at - self.rows:
            self.best.popleft()
        if self.at < self.rows or not self.best:
            return None
        return self.at - self.best[0][0]


def _statistic(kind: str, rows: int):
    return Rank(rows) if kind == "rank" else Since(rows, 1 if kind == "since_min" else -1)


def passes(wanted: Sequence[tuple[str, str, str, int]], at: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A pass over ordered rows that adds one column per (output, input column, kind, rows); `at` numbers the rows of a
    series from 1, so a 1 starts a new series."""
    types = {"double": pa.float64(), "int": pa.int32()}

    def run(batches):
        state = []
        for batch in batches:
            starts = [i for i, n in enumerate(batch.column(at).to_pylist()) if n == 1]
            edges = [0, *starts, batch.num_rows]
            read = {source: batch.column(source).to_pylist() for _, source, _, _ in wanted}
            found = [[] for _ in wanted]
            for piece, (low, high) in enumerate(zip(edges, edges[1:])):
                if piece:
                    state = [_statistic(kind, rows) for _, _, kind, rows in wanted]
                for statistic, (_, source, _, _), out in zip(state, wanted, found):
                    out.extend(map(statistic.push, read[source][low:high]))
            columns = [*batch.columns, *[pa.array(out, types[KINDS[w[2]]]) for w, out in zip(wanted, found)]]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *[w[0] for w in wanted]])
    return run
