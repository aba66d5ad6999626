"""Trailing-window signal functions over a `Series`.

A window of d rows counts rows, not values: the first d-1 rows of a series are NULL, and missing
values inside a full window are skipped unless stated.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tallyweave.functions.numeric import col, finite
from tallyweave.scale import Series

_UNROLL = 32


def _window(d: int) -> int:
    d = int(d)
    if d < 2:
        raise ValueError("window must be at least 2 rows")
    return d


def full(s: Series, d: int, value: Column) -> Column:
    """NULL until the window holds d rows."""
    return F.when(F.lag(F.lit(1), d - 1).over(s.previous(d - 1)).isNotNull(), value)


def delay(s: Series, x, d: int) -> Column:
    d = int(d)
    if d < 1:
        raise ValueError("delay must be at least 1 row")
    return F.lag(col(x), d).over(s.previous(d))


def delta(s: Series, x, d: int) -> Column:
    return finite(col(x) - delay(s, x, d))


def ts_sum(s: Series, x, d: int) -> Column:
    """An all-missing full window sums to 0."""
    d = _window(d)
    return full(s, d, F.coalesce(F.sum(col(x)).over(s.last(d)), F.lit(0.0)))


def ts_mean(s: Series, x, d: int) -> Column:
    d = _window(d)
    return full(s, d, F.avg(col(x)).over(s.last(d)))


def ts_min(s: Series, x, d: int) -> Column:
    d = _window(d)
    return full(s, d, F.min(col(x)).over(s.last(d)))


def ts_max(s: Series, x, d: int) -> Column:
    d = _window(d)
    return full(s, d, F.max(col(x)).over(s.last(d)))


def ts_stddev(s: Series, x, d: int) -> Column:
    d = _window(d)
    return full(s, d, F.stddev_samp(col(x)).over(s.last(d)))


def ts_zscore(s: Series, x, d: int) -> Column:
    return finite(F.try_divide(col(x) - ts_mean(s, x, d), ts_stddev(s, x, d)))


def decay_linear(s: Series, x, d: int) -> Column:
    """Weighted mean, newest row heaviest; any missing value makes the result missing."""
    d = _window(d)
    scale = 2.0 / (d * (d + 1))
    if d <= _UNROLL:
        ordered = s.previous(d - 1)
        total = col(x) * (d * scale)
        for back in range(1, d):
            total = total + F.lag(col(x), back).over(ordered) * ((d - back) * scale)
        return finite(total)
    frame = s.last(d)
    values = F.collect_list(col(x)).over(frame)
    weighted = F.transform(values, lambda v, i: v * (i + 1) * scale)
    total = F.aggregate(weighted, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.count(col(x)).over(frame) == d, finite(total))


def ts_rank(s: Series, x, d: int) -> Column:
    """Share of the window's values that are at most the current value."""
    return s.slide("rank", finite(x), _window(d))


def ts_argmin(s: Series, x, d: int) -> Column:
    """Rows since the window's smallest value; the latest of equals counts."""
    return s.slide("since_min", finite(x), _window(d))


def ts_argmax(s: Series, x, d: int) -> Column:
    """Rows since the window's largest value; the latest of equals counts."""
    return s.slide("since_max", finite(x), _window(d))


def ts_product(s: Series, x, d: int) -> Column:
    d = _window(d)
    return full(s, d, finite(F.product(col(x)).over(s.last(d))))


def forward_return(s: Series, x, rows: int) -> Column:
    """Relative change to the value `rows` later."""
    return finite(F.try_divide(F.lead(col(x), rows).over(s.following(rows)), col(x)) - 1.0)
