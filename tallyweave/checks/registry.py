"""The two dictionaries that the entry module hands out, and the decorator that fills them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyweave.checks.inputs import Inputs, with_inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    """Register a query over `Inputs`; `sql` may use the derived inputs by their `fx_` names."""
    def add(make: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: make(Inputs(spark, folder))
        if sql is not None:
            SQL[name] = with_inputs(sql)
        return make
    return add


def r6(c) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), 6)


def r2(c) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), 2)


def plain_ts(c) -> Column:
    """Instants leave as zone-free timestamps."""
    return (F.col(c) if isinstance(c, str) else c).cast("timestamp_ntz")


def lines(c, sep: str = "|") -> Column:
    """An array of strings as one string."""
    return F.array_join(F.col(c) if isinstance(c, str) else c, sep)
