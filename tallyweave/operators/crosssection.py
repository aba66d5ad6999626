"""Cross-sectional operators: one instant, all series.

Aggregates by instant are combined map-side and joined back, so one crowded instant is no single task
(adaptive execution splits a skewed join, it cannot split a window).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyweave import scale
from tallyweave.functions.numeric import finite

# Fixed value: gross exposure per instant.
BOOK_SIZE = 10_000.0


def centred(df: DataFrame, at: str = "timestamp", value: str = "alpha", out: str = "z") -> DataFrame:
    """Value minus its mean over the instant."""
    means = df.groupBy(at).agg(F.avg(value).alias("__mean"))
    return df.join(means, at).withColumn(out, F.col(value) - F.col("__mean")).drop("__mean")


def divisor(gross: str) -> Column:
    """The gross sum, or 1 where it is 0."""
    return F.coalesce(F.nullif(F.col(gross), F.lit(0.0)), F.lit(1.0))


def neutralise(df: DataFrame, at: str = "timestamp", value: str = "alpha", out: str = "position") -> DataFrame:
    """Demeaned per instant and scaled to the book size; an all-equal instant gets zero positions."""
    moved = centred(df, at, value, "__z")
    gross = moved.groupBy(at).agg(F.sum(F.abs("__z")).alias("__gross"))
    position = finite(BOOK_SIZE * F.col("__z") / divisor("__gross"))
    return moved.join(gross, at).withColumn(out, position).drop("__z", "__gross")


def cross_rank(df: DataFrame, at: str, value: str, out: str = "rank", rows_per_task: int | None = None) -> DataFrame:
    """Percent rank per instant in [0, 1]; missing values are neither ranked nor counted."""
    limit = scale.ROWS_PER_TASK if rows_per_task is None else rows_per_task
    known = F.col(value).isNotNull()
    if scale.largest_group(df, [at]) <= limit:
        ranked = F.percent_rank().over(W.partitionBy(at, F.col(value).isNull()).orderBy(value))
        return df.withColumn(out, F.when(known, ranked))
    per_value = df.where(known).groupBy(at, value).agg(F.count(F.lit(1)).alias("__n"))
    upto = scale.running_total(per_value, [at], [value], "__n", "__upto", limit)
    sizes = df.groupBy(at).agg(F.count(value).alias("__size"))
    below = upto.select(at, value, (F.col("__upto") - F.col("__n")).alias("__below"))
    share = F.when(F.col("__size") > 1, F.col("__below") / (F.col("__size") - 1)).otherwise(F.lit(0.0))
    return (
        df.join(below, [at, value], "left").join(sizes, at, "left")
        .withColumn(out, F.when(known, share)).drop("__below", "__size")
    )
