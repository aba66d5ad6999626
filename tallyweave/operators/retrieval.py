"""Top-k documents per query by shared words."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyweave.operators.filtering import top_per
from tallyweave.scale import small
from tallyweave.session import cut_lineage

#: Pairs of query and word that are sent to every task; more are joined.
WEIGHTS = 500_000
#: Documents whose words a task holds as Python strings at a time, and pairs that it passes on at a time.
DOCS, PAIRS = 64, 1 << 16


def _schema(query: str, doc: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    return pa.schema([("query_id", kinds[query]), ("doc_id", kinds[doc]), ("score", pa.float64())])


def words(text) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _packed(weights: DataFrame) -> tuple[list, dict[str, slice], np.ndarray, np.ndarray]:
    """Query ids, and a posting list of (query number, weight) for each word."""
    rows = weights.sort("word", "query_id").collect()
    names = sorted({r["query_id"] for r in rows})
    number, places = {q: i for i, q in enumerate(names)}, {}
    for i, row in enumerate(rows):
        first = places[row["word"]].start if row["word"] in places else i
        places[row["word"]] = slice(first, i + 1)
    return (names, places, np.array([number[r["query_id"]] for r in rows], np.int64),
            np.array([r["weight"] for r in rows], np.float64))


def _matches(tokens: list[str] | None, places: dict[str, slice], at: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the queries that share a word with the text, and their scores; the cost is that of the matching pairs."""
    counts = Counter(w for w in tokens or () if w in places)
    if not counts:
        return at[:0], by[:0]
    found = np.concatenate([at[places[w]] for w in counts])
    added = np.concatenate([n * by[places[w]] for w, n in counts.items()])
    order = np.argsort(found, kind="stable")
    found = found[order]
    first = np.flatnonzero(np.diff(found, prepend=-1))
    return found[first], np.add.reduceat(added[order], first)


def _scored_in_task(batches: Iterator[pa.RecordBatch], shared, k: int | None) -> Iterator[pa.RecordBatch]:
    """Scores of this task's rows: the k best for each query, or all without k."""
    names, places, at, by = shared.value
    held: list[list] = [[] for _ in names]
    least = np.zeros(len(names))  # a score below the k-th best so far cannot be among the best

    def rows(hits) -> pa.RecordBatch:
        columns = list(zip(*hits)) if hits else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "doc_id", "score"])

    ids = pa.array(names)
    parts = (batch.slice(first, DOCS) for batch in batches for first in range(0, batch.num_rows, DOCS))
    for part in parts:
        hits, size = [], 0

        def packed() -> pa.RecordBatch:
            docs = np.repeat([h[0] for h in hits], [len(h[1]) for h in hits])
            return pa.RecordBatch.from_arrays([
                ids.take(pa.array(np.concatenate([h[1] for h in hits]))), part.column("doc_id").take(pa.array(docs)),
                pa.array(np.concatenate([h[2] for h in hits]))], names=["query_id", "doc_id", "score"])

        for row, (doc, tokens) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("words").to_pylist())):
            found, scores = _matches(tokens, places, at, by)
            if k is None:
                if len(found):
                    hits.append((row, found, scores))
                    size += len(found)
                if size >= PAIRS:
                    yield packed()
                    hits, size = [], 0
                continue
            scores = np.round(scores, 6)
            good = (scores > 0) & (scores >= least[found])
            for q, x in zip(found[good].tolist(), scores[good].tolist()):
                mine = held[q]
                mine.append((-x, doc))
                if len(mine) >= 4 * k + 16:
                    mine.sort()
                    del mine[k:]
                    least[q] = -mine[-1][0] if k else 0
        if hits:
            yield packed()
    if k is not None:
        yield rows([(query, doc, -x) for query, mine in zip(names, held) for x, doc in sorted(mine)[:k]])


def search_documents(queries: DataFrame, docs: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, doc_id, score, position): score is the sum over the query's distinct words of
    tf * ln(1 + N / df), ties by document id. N and df count rows; rows that share an id are one document, whose
    scores are added up. Rows without an id are no document.

    Query words measured to be few go to every task, which scores its rows for all queries and passes on at most k of them
    per query; rows whose id repeats are scored there too, but added up before any is left out. More query words than
    that are joined by a shuffle, each document's words counted first. Both ways give the same rows.
    """
    wanted = queries.select("query_id", F.explode(F.array_distinct(words("text"))).alias("word")).distinct()
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    again = F.col("doc_id").isNotNull() & (F.col("n") > 1)
    total, repeats = ids.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(again)).first()
    spread = (
        docs.select(F.explode(F.array_distinct(words("text"))).alias("word"))
        .join(small(wanted.select("word").distinct()), "word", "left_semi")
        .groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    )
    weights = cut_lineage(wanted.join(spread, "word").select(
        "query_id", "word", F.log1p(F.lit(float(total)) / F.col("df")).alias("weight")))
    size = weights.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("word")).alias("bytes")).first()
    named = docs.where(F.col("doc_id").isNotNull())
    if size["n"] <= WEIGHTS and (size["bytes"] or 0) <= 16 * WEIGHTS:
        shared = docs.sparkSession.sparkContext.broadcast(_packed(weights))
        kinds = dict(queries.dtypes)["query_id"], dict(docs.dtypes)["doc_id"]

        def in_tasks(rows: DataFrame, best: int | None) -> DataFrame:
            return rows.select("doc_id", words("text").alias("words")).mapInArrow(
                lambda it: (b.cast(_schema(*kinds)) for b in _scored_in_task(it, shared, best)),
                f"query_id {kinds[0]}, doc_id {kinds[1]}, score double")

        if not repeats:
            scored = in_tasks(named, k)
        else:
            repeated = cut_lineage(ids.where(again).select("doc_id"))
            parts = in_tasks(named.join(repeated, "doc_id", "left_semi"), None)
            scored = in_tasks(named.join(repeated, "doc_id", "left_anti"), k).unionAll(parts.groupBy(
                "query_id", "doc_id").agg(F.round(F.sum("score"), 6).alias("score")))
    else:
        counted = named.select("doc_id", F.explode(words("text")).alias("word")).groupBy("doc_id", "word").agg(
            F.count(F.lit(1)).alias("tf"))
        # sums of equal terms in another order differ in the last digits; rounding makes equal scores tie
        scored = counted.join(weights, "word").groupBy("query_id", "doc_id").agg(
            F.round(F.sum(F.col("tf") * F.col("weight")), 6).alias("score"))
    return top_per(scored, ["query_id"], [F.col("score").desc(), F.col("doc_id")], k, "position")


def result_position(hits: DataFrame, key: str, order: list[Column], out: str = "position") -> DataFrame:
    """1-based rank of each key's hits; result lists are short, they come from a top-k."""
    return hits.withColumn(out, F.row_number().over(W.partitionBy(key).orderBy(*order)))
