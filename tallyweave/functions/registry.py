"""Named signal functions with their arity, and formulas as nested lists.

A formula is JSON: a string is a column, a number is a number, a list is a call, as in
["ts_zscore", ["div", ["sub", "high", "low"], "close"], 5]. It becomes a Column before any job runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column

from tallyweave.functions import numeric as n, rolling as r
from tallyweave.scale import Series

_PLAIN: dict[str, tuple[Callable[..., Column], tuple[int, int]]] = {}
_SERIES: dict[str, tuple[Callable[..., Column], tuple[int, int]]] = {}


def register(name: str, arity: tuple[int, int], make: Callable[..., Column], over_series: bool = False) -> None:
    """Add a function returning a Column; series functions receive the `Series` first."""
    if name in _PLAIN or name in _SERIES:
        raise ValueError(f"{name} is already registered")
    (_SERIES if over_series else _PLAIN)[name] = (make, arity)


def list_transforms() -> list[str]:
    return sorted([*_PLAIN, *_SERIES])


def arity(name: str) -> tuple[int, int]:
    return (_PLAIN.get(name) or _SERIES[name])[1]


def lookup(name: str, count: int) -> tuple[Callable[..., Column], bool]:
    """The function and whether it takes the series first; an unknown name or a wrong number of arguments is an error."""
    found = _PLAIN.get(name) or _SERIES.get(name)
    if found is None:
        raise ValueError(f"unknown function: {name}")
    make, (low, high) = found
    if not low <= count <= high:
        raise ValueError(f"{name} takes {low} to {high} arguments, got {count}")
    return make, name in _SERIES


def compose(tree, series: Series, columns: Iterable[str] | None = None) -> Column:
    """Build the Column of a formula; unknown names, columns and argument counts are errors."""
    if isinstance(tree, (int, float)) and not isinstance(tree, bool):
        return tree
    if isinstance(tree, str):
        if columns is not None and tree not in set(columns):
            raise ValueError(f"unknown column: {tree}")
        return n.col(tree)
    name, *args = tree
    make, over_series = lookup(name, len(args))
    built = [compose(a, series, columns) for a in args]
    return make(series, *built) if over_series else make(*built)


def render(tree) -> str:
    """The formula as text, f(a,b)."""
    if isinstance(tree, (str, int, float)):
        return str(tree)
    return f"{tree[0]}({','.join(render(a) for a in tree[1:])})"


for _name, _arity, _make in [
    ("add", 2, n.add), ("sub", 2, n.sub), ("mul", 2, n.mul), ("div", 2, n.div), ("sqrt", 1, n.signed_sqrt),
    ("log", 1, n.signed_log), ("abs", 1, n.absolute), ("neg", 1, n.neg), ("inv", 1, n.inv),
    ("max", 2, n.maximum), ("min", 2, n.minimum), ("sign", 1, n.sign), ("power", 2, n.power),
    ("ifcondition_g", 4, n.if_greater), ("ifcondition_ge", 4, n.if_at_least), ("ifcondition_e", 4, n.if_equal),
]:
    register(_name, (_arity, _arity), _make)

for _name, _make in [
    ("delay", r.delay), ("delta", r.delta), ("ts_sum", r.ts_sum), ("ts_mean", r.ts_mean), ("ts_min", r.ts_min),
    ("ts_max", r.ts_max), ("ts_stddev", r.ts_stddev), ("ts_zscore", r.ts_zscore),
    ("decay_linear", r.decay_linear), ("ts_rank", r.ts_rank), ("ts_argmin", r.ts_argmin),
    ("ts_argmax", r.ts_argmax), ("ts_product", r.ts_product),
]:
    register(_name, (2, 2), _make, over_series=True)
