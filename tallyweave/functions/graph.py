"""Many formulas as one graph: equal subtrees are one node, and nodes are computed step by step."""

from __future__ import annotations

import ast
import json
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tallyweave import scale
from tallyweave.functions.registry import lookup, render


@dataclass
class Node:
    """A call: its output column, its arguments as names and numbers, and the rows its result reaches."""
    column: str
    name: str
    arguments: list
    parents: list[str]
    step: tuple[int, int]
    back: int = 0
    ahead: int = 0


def read_formula(text: str):
    """A formula from a catalogue as nested lists: JSON as it is, or calls such as delta(close,3)."""
    if text.lstrip().startswith(("[", '"')):
        return json.loads(text)

    def tree(e):
        match e:
            case ast.Call(ast.Name(name), args, []):
                return [name, *map(tree, args)]
            case ast.Name(name):
                return name
            case ast.Constant(int() | float() as number) if not isinstance(number, bool):
                return number
            case ast.UnaryOp(ast.USub(), ast.Constant(int() | float() as number)):
                return -number
        raise ValueError(f"not a formula: {text}")

    try:
        return tree(ast.parse(text.strip(), mode="eval").body)
    except SyntaxError:
        raise ValueError(f"not a formula: {text}") from None


class Graph:
    """Call nodes by their text. A step is (series functions below the node, plain calls above the last of them), so that
    sorting nodes by step puts every node after those it reads and gathers windows of one depth."""

    def __init__(self, columns: Iterable[str]):
        self.columns, self.nodes = set(columns), {}

    def add(self, tree) -> str | float:
        """The column (or number) that holds a formula; unknown names, columns and argument counts are errors."""
        if isinstance(tree, (int, float)) and not isinstance(tree, bool):
            return tree
        if isinstance(tree, str):
            if tree not in self.columns:
                raise ValueError(f"unknown column: {tree}")
            return tree
        key = render(tree)
        if key not in self.nodes:
            name, *args = tree
            _, over_series = lookup(name, len(args))
            arguments = [self.add(a) for a in args]
            parents = [render(a) for a in args if isinstance(a, (list, tuple))]
            below = [self.nodes[p].step for p in parents]
            depth = max((d for d, _ in below), default=0)
            step = (depth + 1, 0) if over_series else (depth, 1 + max((p for d, p in below if d == depth), default=0))
            self.nodes[key] = Node(f"__n{len(self.nodes)}", name, arguments, parents, step)
        return self.nodes[key].column

    def under(self, keys: Iterable[str]) -> list[str]:
        """The nodes that these need, themselves included, in order of their steps."""
        found, open_keys = set(), list(keys)
        while open_keys:
            key = open_keys.pop()
            if key not in found:
                found.add(key)
                open_keys.extend(self.nodes[key].parents)
        return sorted(found, key=lambda k: (self.nodes[k].step, self.nodes[k].column))

    def shared(self, batches: Sequence[Sequence[str]]) -> list[str]:
        """Nodes that more than one batch needs."""
        users = Counter(key for batch in batches for key in self.under(batch))
        return [key for key in self.under(users) if users[key] > 1]

    def compute(self, df: DataFrame, keys: Iterable[str], by: Sequence[str], order: Sequence[str],
                rows_per_task: int | None = None, largest: int | None = None) -> DataFrame:
        """Add the columns of these nodes and of all below them that `df` does not hold yet, in one set of blocks."""
        missing = [k for k in self.under(keys) if self.nodes[k].column not in df.columns]
        if not missing:
            return df
        steps = list(self._steps(missing, by, order))
        back = max(self.nodes[k].back for k in missing)
        ahead = max(self.nodes[k].ahead for k in missing)

        def build(rows: DataFrame) -> DataFrame:
            for series, built in steps:
                rows = scale.add_columns(rows, series, built)
            return rows

        return scale.in_blocks(df, by, order, back, ahead, build, rows_per_task, largest)

    def _steps(self, keys: Sequence[str], by, order) -> Iterator[tuple[scale.Series, dict]]:
        """Columns to add, step by step. The calls inside one function stand side by side, so its reach is the longest of
        them; along a chain of nodes the reaches add up."""
        ready = set(keys)
        for step in sorted({self.nodes[k].step for k in keys}):
            series, built = scale.Series(by, order), {}
            for node in (self.nodes[k] for k in keys if self.nodes[k].step == step):
                make, over_series = lookup(node.name, len(node.arguments))
                noted = len(series.reaches)
                built[node.column] = make(series, *node.arguments) if over_series else make(*node.arguments)
                reaches = series.reaches[noted:]
                below = [self.nodes[p] for p in node.parents if p in ready]
                node.back = max((b for b, _ in reaches), default=0) + max((p.back for p in below), default=0)
                node.ahead = max((a for _, a in reaches), default=0) + max((p.ahead for p in below), default=0)
            yield series, built
