"""Element-wise signal arithmetic. NULL is the only missing value: NaN and infinities become NULL."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def col(x) -> Column:
    """A name means a column, a number means a literal."""
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(float(x))


def finite(x) -> Column:
    c = col(x).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def add(a, b) -> Column:
    return finite(col(a) + col(b))


def sub(a, b) -> Column:
    return finite(col(a) - col(b))


def mul(a, b) -> Column:
    return finite(col(a) * col(b))


def div(a, b) -> Column:
    return finite(F.try_divide(col(a).cast("double"), col(b).cast("double")))


def signed_sqrt(x) -> Column:
    return finite(F.signum(col(x)) * F.sqrt(F.abs(col(x))))


def signed_log(x) -> Column:
    return finite(F.signum(col(x)) * F.ln(F.abs(col(x))))


def absolute(x) -> Column:
    return finite(F.abs(col(x)))


def neg(x) -> Column:
    return finite(-col(x))


def inv(x) -> Column:
    return div(1.0, x)


def _both(a, b, value: Column) -> Column:
    return F.when(col(a).isNotNull() & col(b).isNotNull(), value)


def maximum(a, b) -> Column:
    return _both(a, b, F.greatest(col(a), col(b)))


def minimum(a, b) -> Column:
    return _both(a, b, F.least(col(a), col(b)))


def sign(x) -> Column:
    return F.signum(col(x))


def power(a, b) -> Column:
    return finite(F.pow(col(a), col(b)))


def if_greater(c1, c2, then, other) -> Column:
    return F.when(col(c1) > col(c2), col(then)).otherwise(col(other))


def if_at_least(c1, c2, then, other) -> Column:
    return F.when(col(c1) >= col(c2), col(then)).otherwise(col(other))


def if_equal(c1, c2, then, other) -> Column:
    return F.when(col(c1) == col(c2), col(then)).otherwise(col(other))
