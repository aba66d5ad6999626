"""Research reports: insights and sources of one query as text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyweave import scale

# Report format.
INSIGHT_BLOCK = "<insight>\n%s\n</insight>"
SOURCES_TITLE = "## Reference Sources"
SOURCE_LINE = "- %s"


def report_lines(insights: DataFrame, sources: DataFrame, key: str = "query_id") -> DataFrame:
    """Every piece of each report as (key, part, item, line): insights, the title, then the sources.

    The report is a set of rows in a known order, so its length has no bound.
    """
    blocks = insights.select(key, F.lit(0).alias("part"), F.col("insight").alias("item"),
                             F.format_string(INSIGHT_BLOCK, "insight").alias("line"))
    title = insights.select(key).union(sources.select(key)).distinct().select(
        key, F.lit(1).alias("part"), F.lit("").alias("item"), F.lit(f"\n{SOURCES_TITLE}\n").alias("line"))
    bullets = sources.select(key, F.lit(2).alias("part"), F.col("url").alias("item"),
                             F.format_string(SOURCE_LINE, "url").alias("line"))
    return blocks.unionByName(title).unionByName(bullets)


def compile_report(insights: DataFrame, sources: DataFrame, key: str = "query_id",
                   items_per_page: int = 10_000) -> DataFrame:
    """(key, page, text): the report of each query, items in order. A report with more items than a page
    holds continues on the next page; joining the pages by newline gives the whole text."""
    lines = scale.ordinal(report_lines(insights, sources, key), [key], ["part", "item"], "n")
    paged = lines.withColumn("page", F.floor((F.col("n") - 1) / items_per_page))
    ordered = F.array_sort(F.collect_list(F.struct("n", "line")))
    return paged.groupBy(key, "page").agg(F.array_join(F.transform(ordered, lambda e: e["line"]), "\n").alias("text"))


def whole_digests(pages: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, page, digest): the MD5 of each whole report over its pages in order, and its first page. The pages pass through
    one by one, so a report has no bound."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            done = []
            for name, page, text in zip(*(batch.column(c).to_pylist() for c in (key, "page", "text"))):
                if held is None or held[0] != name:
                    done += [held] if held else []
                    held = (name, page, hashlib.md5())
                else:
                    held[2].update(b"\n")
                held[2].update((text or "").encode())
            yield _digest_rows(done, key, batch.schema)
        if held:
            yield _digest_rows([held], key, batch.schema)

    kinds = dict(pages.dtypes)
    ordered = pages.select(key, "page", "text").repartition(key).sortWithinPartitions(key, "page")
    return ordered.mapInArrow(run, f"`{key}` {kinds[key]}, page {kinds['page']}, digest string")


def _digest_rows(done: list[tuple], key: str, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([d[0] for d in done], schema.field(key).type), pa.array([d[1] for d in done], schema.field("page").type),
        pa.array([d[2].hexdigest() for d in done], pa.string())], names=[key, "page", "digest"])


def write_reports(reports: DataFrame, root: str, key: str = "query_id") -> None:
    """Text files under one folder per report and page."""
    reports.select(key, "page", F.col("text").alias("value")).write.mode("overwrite").partitionBy(key, "page").text(root)
