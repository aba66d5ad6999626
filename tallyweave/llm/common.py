"""Helpers that several operators of this package share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyweave.session import cut_lineage, work_path
from tallyweave.streaming.events import settings

#: Shuffle files go when the step that made them has ended: what later steps read lies in checkpoints and tables.
FREED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: A to Z become a to z; every other byte stays.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str, row_group: int = 16 << 20, batch: int = 8 << 20) -> DataFrame:
    """`df` written to the shared folder and read again. Rows that are large arrays go to Python in batches of about
    `batch` bytes and into row groups of `row_group` bytes, so a task holds few of them."""
    spark, path = df.sparkSession, work_path(df.sparkSession, name)
    with settings(spark, {"spark.sql.execution.arrow.maxBytesPerBatch": str(batch)}):
        df.write.option("parquet.block.size", row_group).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_table(df: DataFrame, name: str, row_group: int = 16 << 20, batch: int = 8 << 20) -> Iterator[DataFrame]:
    """As `stored`, as a table that is dropped at the end of the block; what is made of it must be computed inside."""
    spark, held = df.sparkSession, f"llm_{name}_{uuid.uuid4().hex}"
    try:
        with settings(spark, {"spark.sql.execution.arrow.maxBytesPerBatch": str(batch)}):
            df.write.option("parquet.block.size", row_group).saveAsTable(held)
        yield spark.table(held)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {held}")


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; what Python has freed after each goes back to the system. A worker lives on between tasks and steps, and
    would keep the most that any of them has taken."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()
        if trim:
            trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 200) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of `rows` rows, so that what Python makes of one, and sends back, stays small."""
    for batch in released(batches):
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def fold(key: str | Column, parts: int) -> Column:
    """crc32 of the key as text, modulo `parts`; a null key counts as the empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def words_of(text: str | None) -> list[bytes]:
    """Runs of bytes other than space and 0x09 to 0x0D, with A-Z lower-cased."""
    return utf8(text).translate(LOWER).split()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an undirected edge list (a, b) of longs; root is the smallest node reachable.

    Alternates two star contractions: every node hands its larger neighbours, then its smaller ones, to its smallest
    neighbour. The number of rounds grows with the logarithm of the longest path. Each round is checkpointed. Loops and
    repeated edges are allowed; an empty list gives no rows.
    """
    stars = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    for _ in range(rounds):
        both = stars.unionAll(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(
            F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x")).select(
            F.col("x.b").alias("a"), F.col("x.m").alias("b")).where("a <> b").distinct()
        stars = cut_lineage(small)
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            roots = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def forest(pairs_a: np.ndarray, pairs_b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the given pairs: as few of them as keep the same components."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for a, b in zip(pairs_a.tolist(), pairs_b.tolist()):
        x, y = top(a), top(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept
