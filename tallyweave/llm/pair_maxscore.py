"""Ranked lexical search by MaxScore with bounds of term pairs.

Documents are indexed in chunks of bounded size: posting lists of terms with the impact of each posting, and for pairs
of terms that queries use together the list of documents holding both, with their joint impacts. A query splits its terms
into units, pairs and single terms. No document can get more from a pair than the greatest of its joint maximum and the two
single maxima, which is often far below their sum. Units whose bounds together stay below the k-th best score so far are not
traversed: they are looked up only for the documents that the others leave in the race. The first threshold of a chunk comes
from the documents with the greatest joint impacts.

All scores are integers, so the result is exact and does not depend on the chunks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tallyweave.llm.common import LOWER, stored, utf8

#: Text bytes of a chunk; a longer document is a chunk alone.
CHUNK_BYTES = 2 << 20
#: Text bytes of queries that are held by a task at once; more queries take further rounds over the documents.
QUERY_BYTES = 2 << 20
#: Terms of a query, those with the greatest weights, whose pairs are intersected ahead. Others add single bounds.
PAIRED_TERMS = 16

_KEEP = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
_TERMS = bytes(LOWER[b] if b in _KEEP else 0x20 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased; a null text has none."""
    return utf8(text).translate(_TERMS).split()


def weight(documents: int, holding: int) -> int:
    """A term's integer weight among `documents`, of which `holding` have it."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


# --- index -------------------------------------------------------------------------------------------------------

_POSTINGS = ("docs array<bigint>, sizes array<bigint>, n_terms bigint, terms array<int>, df array<int>, "
             "at array<int>, tf array<int>")
_INDEX = "docs array<bigint>, terms array<int>, df array<int>, at array<int>, gain array<bigint>, " \
         "pairs array<bigint>, shared array<int>, pair_at array<int>, joint array<bigint>"


def _lists(arrays: Sequence[np.ndarray], kind: pa.DataType) -> pa.Array:
    return pa.array(list(arrays), pa.list_(kind))


def postings(docs: DataFrame, vocabulary: Sequence[bytes], chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per chunk: its documents with at least one term and their sizes, and for each term of the vocabulary found
    there its documents (`at`, positions in `docs`) and occurrences."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {term: k for k, term in enumerate(vocabulary)}
        names: list[int | None] = []
        sizes: list[int] = []
        found: list[list[int]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            docs_of = np.repeat(np.arange(len(found)), [len(x) for x in found])
            terms = np.fromiter((t for x in found for t in x), np.int64, len(docs_of))
            keys, tf = np.unique(terms * max(len(found), 1) + docs_of, return_counts=True)
            term, at = np.divmod(keys, max(len(found), 1))
            kinds, df = np.unique(term, return_counts=True)
            return pa.RecordBatch.from_arrays([
                pa.array([names], pa.list_(pa.int64())), _lists([np.array(sizes, np.int64)], pa.int64()),
                pa.array([sum(sizes)], pa.int64()), _lists([kinds.astype(np.int32)], pa.int32()),
                _lists([df.astype(np.int32)], pa.int32()), _lists([at.astype(np.int32)], pa.int32()),
                _lists([tf.astype(np.int32)], pa.int32())], names=["docs", "sizes", "n_terms", "terms", "df", "at", "tf"])

        for batch in batches:
            for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                words = terms_of(text.as_py())
                if not words:
                    continue
                names.append(name)
                sizes.append(len(words))
                found.append([k for k in map(number.get, words) if k is not None])
                held += sum(map(len, words)) + len(words)
                if held >= chunk_bytes:
                    yield flush()
                    names.clear(), sizes.clear(), found.clear()
                    held = 0
        if names:
            yield flush()

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, _POSTINGS)


def _numpy(batch: pa.RecordBatch, column: str, row: int) -> np.ndarray:
    return batch.column(column)[row].values.to_numpy(zero_copy_only=False)


def _views(terms: np.ndarray, counts: np.ndarray) -> dict[int, slice]:
    ends = np.cumsum(counts)
    return {t: slice(e - c, e) for t, c, e in zip(terms.tolist(), counts.tolist(), ends.tolist())}


def impact_index(found: DataFrame, weights: np.ndarray, documents: int, length: int, pairs: np.ndarray) -> DataFrame:
    """Chunks with the impact of each posting, and the intersection list of each of the given pairs (rows of two term
    numbers, the smaller first) that share a document there, with joint impacts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_first: dict[int, list[int]] = {}
        for a, b in pairs.tolist():
            by_first.setdefault(a, []).append(b)
        for batch in batches:
            for row in range(batch.num_rows):
                terms, df, at = (_numpy(batch, c, row) for c in ("terms", "df", "at"))
                tf = _numpy(batch, "tf", row).astype(np.int64)
                norm = 10 + 90 * _numpy(batch, "sizes", row) * documents // length
                gain = np.repeat(weights[terms], df) * (1_000_000_000 * tf // (1000 * tf + 8 * norm[at]))
                lists = _views(terms, df)
                dense = np.zeros(len(norm), np.int64)
                held = np.zeros(len(norm), bool)
                keys, sizes, places, joints = [], [], [], []
                for a in terms.tolist():
                    others = [b for b in by_first.get(a, ()) if b in lists]
                    if not others:
                        continue
                    mine = lists[a]
                    dense[at[mine]], held[at[mine]] = gain[mine], True
                    for b in others:
                        theirs = at[lists[b]]
                        both = held[theirs]
                        if both.any():
                            keys.append(a << 32 | b)
                            places.append(theirs[both])
                            joints.append(dense[places[-1]] + gain[lists[b]][both])
                            sizes.append(len(places[-1]))
                    held[at[mine]] = False
                yield pa.RecordBatch.from_arrays([
                    batch.column("docs").slice(row, 1), batch.column("terms").slice(row, 1),
                    batch.column("df").slice(row, 1), batch.column("at").slice(row, 1), _lists([gain], pa.int64()),
                    _lists([np.array(keys, np.int64)], pa.int64()), _lists([np.array(sizes, np.int32)], pa.int32()),
                    _lists([np.concatenate(places) if places else np.zeros(0, np.int32)], pa.int32()),
                    _lists([np.concatenate(joints) if joints else np.zeros(0, np.int64)], pa.int64()),
                ], names=["docs", "terms", "df", "at", "gain", "pairs", "shared", "pair_at", "joint"])

    return found.mapInArrow(run, _INDEX)


# --- search ------------------------------------------------------------------------------------------------------

class Chunk:
    """The index of one chunk, and exact search in it."""

    def __init__(self, size: int, terms: np.ndarray, df: np.ndarray, at: np.ndarray, gain: np.ndarray,
                 pairs: np.ndarray, shared: np.ndarray, pair_at: np.ndarray, joint: np.ndarray):
        self.size, self.at, self.gain, self.pair_at, self.joint = size, at, gain, pair_at, joint
        self.lists = _views(terms, df)
        self.pairs = _views(pairs, shared)
        starts = np.cumsum(df) - df
        self.most = dict(zip(terms.tolist(), np.maximum.reduceat(gain, starts).tolist() if len(terms) else ()))
        starts = np.cumsum(shared) - shared
        self.joint_most = dict(zip(pairs.tolist(), np.maximum.reduceat(joint, starts).tolist() if len(pairs) else ()))

    def units(self, terms: Sequence[int], paired: Sequence[int]) -> list[tuple[int, tuple[int, ...]]]:
        """The terms as pairs and singles with their bounds, least bound first. Among terms whose pairs are listed, those
        are joined whose joint bound saves most; two that never meet are bound by the greater of the two."""
        saved = []
        for a, b in combinations(sorted(paired), 2):
            x, y = self.most[a], self.most[b]
            bound = max(x, y, self.joint_most.get(a << 32 | b, 0))
            if bound < x + y:
                saved.append((x + y - bound, a, b, bound))
        out, free = [], set(terms)
        for _, a, b, bound in sorted(saved, reverse=True):
            if a in free and b in free:
                free -= {a, b}
                out.append((bound, (a, b)))
        return sorted([*out, *((self.most[t], (t,)) for t in free)])

    def scores(self, docs: np.ndarray, terms: Sequence[int]) -> np.ndarray:
        """Exact scores of the given documents (positions, ascending)."""
        out = np.zeros(len(docs), np.int64)
        for t in terms:
            self._add(out, docs, t)
        return out

    def _add(self, out: np.ndarray, docs: np.ndarray, term: int) -> None:
        view = self.lists[term]
        listed = self.at[view]
        if len(listed) == self.size:
            out += self.gain[view][docs]
            return
        place = np.searchsorted(listed, docs)
        place[place == len(listed)] = 0
        out += np.where(listed[place] == docs, self.gain[view][place], 0)

    def seeds(self, paired: Sequence[int], k: int) -> np.ndarray:
        """Up to some k documents of the pairs with the greatest joint maxima."""
        keys = sorted(((self.joint_most[key], key) for a, b in combinations(sorted(paired), 2)
                       if (key := a << 32 | b) in self.joint_most), reverse=True)
        picked: set[int] = set()
        for _, key in keys:
            view = self.pairs[key]
            at, joint = self.pair_at[view], self.joint[view]
            picked.update(at[np.argsort(-joint, kind="stable")[:k]].tolist())
            if len(picked) >= k:
                break
        return np.array(sorted(picked), np.int64)

    def search(self, terms: Sequence[int], paired: Sequence[int], k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, scores) of the documents that score at least `least`; some that k others exceed may lack."""
        terms = [t for t in terms if t in self.lists]
        paired = [t for t in paired if t in self.lists]
        if not terms:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        tried = self.seeds(paired, k)
        if len(tried) >= k:
            least = max(least, int(np.sort(self.scores(tried, terms))[-k]))
        units = self.units(terms, paired)
        below, skipped = 0, 0  # what the units looked up last can add together, and how many they are
        while skipped < len(units) and below + units[skipped][0] < least:
            below += units[skipped][0]
            skipped += 1
        total = np.zeros(self.size, np.int64)
        for _, unit in units[skipped:]:
            for t in unit:
                view = self.lists[t]
                total[self.at[view]] += self.gain[view]
        docs = np.flatnonzero(total >= max(1, least - below))
        total = total[docs]
        for bound, unit in reversed(units[:skipped]):
            for t in unit:
                self._add(total, docs, t)
            below -= bound
            stays = total + below >= least
            docs, total = docs[stays], total[stays]
        return docs, total


_HITS = "query int, doc_id bigint, score bigint"


def search(index: DataFrame, queries: Sequence[Sequence[int]], paired: Sequence[Sequence[int]], k: int) -> DataFrame:
    """(query, doc_id, score): for each task the best k documents of every query, among them all that are best overall."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, bool, int]]] = [[] for _ in queries]
        for batch in batches:
            for row in range(batch.num_rows):
                names = batch.column("docs")[row].as_py()
                chunk = Chunk(len(names), *(_numpy(batch, c, row) for c in (
                    "terms", "df", "at", "gain", "pairs", "shared", "pair_at", "joint")))
                for q, terms in enumerate(queries):
                    least = -best[q][-1][0] if len(best[q]) >= k else 1
                    docs, total = chunk.search(terms, paired[q], k, least)
                    if len(docs) > 4 * k:  # all that tie with the k-th stay
                        stays = total >= np.partition(total, -k)[-k]
                        docs, total = docs[stays], total[stays]
                    hits = [(-s, names[d] is None, names[d] or 0) for d, s in zip(docs.tolist(), total.tolist())]
                    best[q] = sorted(best[q] + hits)[:k]
        for at in range(0, len(best), 4096):
            rows = [(q, None if none else name, -s) for q, hits in enumerate(best[at:at + 4096], at) for s, none, name in hits]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([r[2] for r in rows], pa.int64())], names=["query", "doc_id", "score"])

    return index.mapInArrow(run, _HITS)


def _blocks(items: DataFrame, query_bytes: int) -> Iterator[list[tuple[int | None, str | None]]]:
    """The items in lists of about `query_bytes` of text; one longer item is alone with what shares its block."""
    size = items.agg(F.sum(F.octet_length("text") + F.lit(64))).first()[0] or 0
    count = size // query_bytes + 1
    for block in range(count):
        part = items if count == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == block)
        yield [(r.item_id, r.text) for r in part.sort("item_id", "text").toLocalIterator()]


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, chunk_bytes: int = CHUNK_BYTES,
                  query_bytes: int = QUERY_BYTES, paired_terms: int = PAIRED_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0, ties by ascending doc_id.

    A document's score adds up, over the item's distinct terms, the term's weight times a saturated count that is lower in
    longer documents. Rows are documents: repeated ids appear as often as they score, null ids last among ties. Rows
    are items too, also where they repeat. Texts that are null or hold no term match nothing and do not count as documents.
    Other columns are ignored; an empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    schema, out = "item_id bigint, rank int, doc_id bigint, score bigint", None
    for block in _blocks(items, query_bytes):
        asked = [sorted(set(terms_of(text))) for _, text in block]
        vocabulary = sorted(set().union(*asked)) if asked else []
        if not vocabulary:
            continue
        number = {term: t for t, term in enumerate(vocabulary)}
        found = stored(postings(docs, vocabulary, chunk_bytes), "postings")
        documents, length = found.agg(F.sum(F.size("docs")), F.sum("n_terms")).first()
        if not documents:
            continue
        holding = np.zeros(len(vocabulary), np.int64)
        # at most one row per term of the block
        for row in found.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy("x.terms").agg(
                F.sum("x.df").alias("df")).collect():
            holding[row["terms"]] = row["df"]
        weights = np.array([weight(documents, int(df)) for df in holding], np.int64)
        queries = [[number[t] for t in terms if holding[number[t]]] for terms in asked]
        paired = [sorted(q, key=lambda t: (-weights[t], t))[:paired_terms] for q in queries]
        pairs = np.array(sorted({p for q in paired for p in combinations(sorted(q), 2)}), np.int64).reshape(-1, 2)
        index = stored(impact_index(found, weights, documents, length, pairs), "impacts")
        hits = stored(search(index, queries, paired, k), "hits")
        best = W.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        named = spark.createDataFrame([(q, item) for q, (item, _) in enumerate(block)], "query int, item_id bigint")
        ranked = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).join(
            F.broadcast(named), "query").select("item_id", "rank", "doc_id", "score")
        out = ranked if out is None else out.unionAll(ranked)
    return spark.createDataFrame([], schema) if out is None else out
