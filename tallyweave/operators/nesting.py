"""Parents with their ordered children, without an unbounded array."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tallyweave import scale

CHILDREN_PER_PAGE = 10_000


def nest(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, order: Sequence[str],
         fields: Sequence[str], out: str, per_page: int = CHILDREN_PER_PAGE,
         rows_per_task: int | None = None) -> DataFrame:
    """Left 1:N nest. A parent is one row with its children in order; one with more children than a page
    holds has several rows, `page` 0, 1, 2, … Parents without children keep an empty array."""
    placed = scale.ordinal(children, [child_key], order, "__n", rows_per_task)
    pages = (
        placed.withColumn("page", F.floor((F.col("__n") - 1) / per_page))
        .groupBy(F.col(child_key).alias("__parent"), "page")
        .agg(F.array_sort(F.collect_list(F.struct("__n", *fields))).alias(out))
        .withColumn(out, F.transform(out, lambda e: F.struct(*[e[f].alias(f) for f in fields])))
    )
    joined = parents.join(pages, parents[parent_key] == pages["__parent"], "left").drop("__parent")
    return joined.withColumn("page", F.coalesce("page", F.lit(0))).withColumn(
        out, F.coalesce(out, F.array().cast(pages.schema[out].dataType)))
