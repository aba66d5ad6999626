"""Formulas over bars, written as a keyed feature table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tallyweave import scale
from tallyweave.functions.graph import Graph, read_formula
from tallyweave.functions.numeric import col, finite
from tallyweave.functions.registry import render
from tallyweave.session import cut_lineage

# Formulas that share one pass; a plan of several hundred window columns takes longer to compile than to run.
BATCH = 100


def feature_hash(freq, expr) -> Column:
    """First 12 hex digits of the SHA-1 of the compact key {"f": freq, "e": expr}."""
    def text(c):
        plain = c if isinstance(c, Column) else F.lit(c)
        return F.regexp_replace(plain, r'(["\\])', r'\\$1')

    body = F.concat(F.lit('{"f": "'), text(freq), F.lit('", "e": "'), text(expr), F.lit('"}'))
    return F.substring(F.sha1(body), 1, 12)


def _long(wide: DataFrame, freq: str, alphas: dict[str, Column]) -> DataFrame:
    """One row per present alpha; `alphas` holds each formula's value by its text."""
    entries = F.array(*[F.struct(feature_hash(freq, text).alias("feature_hash"), finite(value).alias("alpha"))
                        for text, value in alphas.items()])
    long = wide.select("symbol", "ts", F.explode(F.filter(entries, lambda e: e["alpha"].isNotNull())).alias("e"))
    return long.select(
        "e.feature_hash", F.lit(freq).alias("freq"), F.col("symbol").alias("ticker"),
        F.col("ts").alias("timestamp"), "e.alpha",
    )


def build_features(bars: DataFrame, freq: str, formulas: Sequence, rows_per_task: int | None = None,
                   largest: int | None = None, batch: int = BATCH) -> DataFrame:
    """Long table feature_hash, freq, ticker, timestamp, alpha for every formula over every symbol.

    Formulas that read alike count once, and so do equal subtrees. Up to `batch` formulas share one scan and one ordered
    pass. Beyond it, what several batches need is computed first and written, and each batch is a pass over that table.
    Missing alphas are dropped; without formulas the table is empty.
    """
    by, order = ["symbol"], ["ts"]
    graph = Graph(bars.columns)
    columns = {render(tree): graph.add(tree) for tree in formulas}
    texts = list(columns)
    calls = [[t for t in texts[i:i + batch] if t in graph.nodes] for i in range(0, len(texts), batch)]
    if len(calls) > 1:
        if largest is None:
            largest = scale.largest_group(bars, by)
        bars = cut_lineage(graph.compute(bars, graph.shared(calls), by, order, rows_per_task, largest))
    parts = [
        _long(graph.compute(bars, keys, by, order, rows_per_task, largest), freq,
              {t: col(columns[t]) for t in texts[i * batch:(i + 1) * batch]})
        for i, keys in enumerate(calls)]
    if not parts:
        return _long(bars.limit(0), freq, {"": F.lit(None).cast("double")})
    return reduce(DataFrame.unionByName, parts)


def build_catalog(bars: DataFrame, catalog: DataFrame, rows_per_task: int | None = None, batch: int = BATCH) -> DataFrame:
    """Features of a catalogue (`frequency`, `alpha`) over bars of several frequencies (`freq`).

    The formulas become the plan, so the catalogue is read by the driver: one short text per distinct formula. Rows that
    lack a frequency or a formula are left out, a frequency without bars gives no rows, a formula that is none is an error.
    """
    known = catalog.where("frequency IS NOT NULL AND alpha IS NOT NULL").distinct().orderBy("frequency", "alpha").collect()
    wanted: dict[str, list] = {}
    for frequency, alpha in known:
        wanted.setdefault(frequency, []).append(read_formula(alpha))
    parts = [build_features(bars.where(F.col("freq") == frequency), frequency, formulas, rows_per_task, batch=batch)
             for frequency, formulas in wanted.items()]
    return reduce(DataFrame.unionByName, parts) if parts else build_features(bars, "", [])


def build_feature(bars: DataFrame, freq: str, formula, rows_per_task: int | None = None,
                  largest: int | None = None) -> DataFrame:
    return build_features(bars, freq, [formula], rows_per_task, largest)
