"""Benchmark decontamination: a BM25 index of the test items, queried with every passage of every training document.

Impacts are divided by an item's score against itself, so one threshold serves all items. It is the lowest score that an
item can have while four fifths of its five-word shingles are in the passage; so nothing that verification would accept
is missed. A passage is looked up by block-max WAND: cursors over the posting lists skip to the first item that the
lists' maxima allow, and past blocks whose own maxima do not reach the threshold. Most passages are known beforehand to have no result: an item
can only be reached with one of its essential terms, those that its lesser terms together cannot make up for, and the
bound of such a pair falls with every lesser term that the passage lacks. That is worked out for many passages at once.
Retrieved items are verified by shingles, and by the words of question and answer.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyweave.llm.common import LOWER, slices, utf8

SHINGLE, SIMILAR, ANSWER_SIMILAR = 5, 0.8, 0.5
K1, B = 1.2, 0.75
#: Words of a passage at least; it starts every half passage, and grows so that the longest item fits in one half.
PASSAGE = 128
BLOCK = 64
#: Bytes of item texts in one index, which is sent to every executor; larger sets are split into several indexes.
INDEX_BYTES = 32_000_000

_PLAIN = bytes(32 if b < 128 and not chr(b).isalnum() else LOWER[b] for b in range(256))


def plain_words(text: str | None) -> list[bytes]:
    """Lower-case words without ASCII punctuation."""
    return utf8(text).translate(_PLAIN).split()


def parts_of(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """Question and answer: the last line, or else the last sentence, is the answer; with one sentence only the question."""
    text = (text or "").strip()
    at = text.rfind("\n") if "\n" in text else max(text.rfind(mark, 0, len(text) - 1) for mark in (". ", "? ", "! ")) + 1
    question, answer = plain_words(text[:at]), plain_words(text[at:])
    return (question, answer) if at > 0 and question else (plain_words(text), [])


def shingles(words: list[bytes], n: int = SHINGLE) -> set[bytes]:
    return {b" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def _within(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    return keys[np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)] == wanted


class Index:
    """Posting lists of items (term -> items in order, impacts, block maxima) and what each item needs."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.ids, self.words, self.parts = [], [], []
        for item_id, text in sorted(items, key=lambda x: (x[0], x[1] or "")):
            words = plain_words(text)
            if words:
                self.ids.append(item_id)
                self.words.append(words)
                self.parts.append(parts_of(text))
        n = len(self.ids)
        df = Counter(t for w in self.words for t in set(w))
        self.terms = {t: k for k, t in enumerate(sorted(df))}
        average = sum(map(len, self.words)) / max(1, n)
        lists: list[tuple[list[int], list[float]]] = [([], []) for _ in df]
        own, self.threshold = [], 1.0
        for k, words in enumerate(self.words):
            norm = K1 * (1 - B + B * len(words) / average)
            impact = {t: np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + norm) for t, c in Counter(words).items()}
            total = sum(impact.values())
            for t, x in impact.items():
                lists[self.terms[t]][0].append(k)
                lists[self.terms[t]][1].append(x / total)
            shares = sorted((x / total for x in impact.values()), reverse=True)
            count = max(1, len(words) - SHINGLE + 1)
            own.append((k, impact, total))
            # this many words at most can be missing while SIMILAR of the shingles are there
            self.threshold = min(self.threshold, 1 - sum(shares[:int((1 - SIMILAR) * count + 1e-9)]) - 1e-9)
        self.postings = [(np.array(i), np.array(x), [max(x[a:a + BLOCK]) for a in range(0, len(x), BLOCK)]) for i, x in lists]
        self.lesser = np.zeros(n)
        rest: list[list[tuple[float, int]]] = [[] for _ in range(n)]
        essential: list[tuple[list[int], list[float]]] = [([], []) for _ in df]
        for k, impact, total in own:
            for t, x in sorted(impact.items(), key=lambda p: (p[1], p[0])):
                if self.lesser[k] + x / total < self.threshold:
                    self.lesser[k] += x / total
                    rest[k].append((x / total, self.terms[t]))
                else:
                    essential[self.terms[t]][0].append(k)
                    essential[self.terms[t]][1].append(x / total)
        sizes = np.array([len(e[0]) for e in essential], np.int64)
        self.from_ = np.cumsum(sizes) - sizes
        self.sizes = sizes
        self.items = np.array([k for e in essential for k in e[0]], np.int64)
        self.shares = np.array([x for e in essential for x in e[1]])
        self.longest = max(map(len, self.words), default=0)
        # the lesser terms of each item, the weightiest first
        self.rest_size = np.array(list(map(len, rest)), np.int64)
        self.rest_from = np.cumsum(self.rest_size) - self.rest_size
        self.rest_share = np.array([x for r in rest for x, _ in reversed(r)])
        self.rest_term = np.array([t for r in rest for _, t in reversed(r)], np.int64)

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """All items whose score for the distinct terms reaches the threshold, by block-max WAND."""
        cursors = []  # [item, position, list]
        for t in terms:
            items, shares, maxima = self.postings[t]
            if len(items):
                cursors.append([int(items[0]), 0, items, shares, maxima, max(maxima)])
        found = []
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += c[5]
                if bound >= self.threshold:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            upper, after = 0.0, len(self.ids)
            for c in cursors[:pivot + 1]:
                at = c[1] if c[0] >= item else bisect_left(c[2], item, c[1])
                block = at // BLOCK
                if at < len(c[2]):
                    upper += c[4][block]
                    end = min(len(c[2]), (block + 1) * BLOCK) - 1
                    after = min(after, int(c[2][end]) + 1)
            if upper < self.threshold:  # no item up to the nearest block end can reach it
                if pivot + 1 < len(cursors):
                    after = min(after, cursors[pivot + 1][0])
                goal = max(after, item + 1)
            else:
                score = 0.0
                for c in cursors[:pivot + 1]:
                    c[1] = bisect_left(c[2], item, c[1])
                    if c[1] < len(c[2]) and c[2][c[1]] == item:
                        score += c[3][c[1]]
                if score >= self.threshold:
                    found.append((item, float(score)))
                goal = item + 1
            for c in cursors[:pivot + 1]:
                c[1] = bisect_left(c[2], goal, c[1])
                c[0] = int(c[2][c[1]]) if c[1] < len(c[2]) else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return found

    def verify(self, item: int, words: list[bytes]) -> tuple[float, float, float]:
        """Shares of the item's shingles, of the question's words and of the answer's words that the words have."""
        wanted, there = shingles(self.words[item]), set(words)
        n = min(SHINGLE, len(self.words[item]))
        own = {b" ".join(words[i:i + n]) for i in range(len(words) - n + 1)}
        question, answer = map(set, self.parts[item])
        return (len(wanted & own) / len(wanted), len(question & there) / max(1, len(question)),
                len(answer & there) / len(answer) if answer else 1.0)

    def hits(self, texts: list[str | None]) -> list[list[dict]]:
        """For each text the verified items, each once, where it fits best."""
        half = max(PASSAGE // 2, self.longest)
        words = [plain_words(t) for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        get = self.terms.get
        term = np.fromiter(map(get, chain.from_iterable(words), repeat(-1)), np.int64, int(sizes.sum()))
        row = np.repeat(np.arange(len(texts)), sizes)
        place = np.arange(len(term)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        some = np.nonzero(term >= 0)[0]
        out: list[list[dict]] = [[] for _ in texts]
        if not len(some):
            return out
        # a word is in the passage that starts in its half and in the one before
        width, known = int(sizes.max()) // half + 2, len(self.terms)
        halves = np.unique((row[some] * width + place[some] // half + 1) * known + term[some])
        keys = halves[self.sizes[halves % known] > 0]
        keys = np.unique(np.concatenate((keys, keys - known)))
        passage, t = keys // known, keys % known
        n = self.sizes[t]
        flat = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.from_[t], n)
        pairs, which = np.unique(np.repeat(passage, n) * len(self.ids) + self.items[flat], return_inverse=True)
        passage, item = pairs // len(self.ids), pairs % len(self.ids)
        bound = np.bincount(which, self.shares[flat], len(pairs)) + self.lesser[item]
        # the bound falls with each lesser term that a passage lacks; most pairs are out after a few
        alive, done, step = np.nonzero(bound >= self.threshold - 1e-9)[0], [], 0
        while len(alive):
            ended = self.rest_size[item[alive]] <= step
            done.append(alive[ended])
            alive = alive[~ended]
            at = self.rest_from[item[alive]] + step
            wanted = passage[alive] * known + self.rest_term[at]
            there = _within(halves, wanted) | _within(halves, wanted + known)
            bound[alive] -= np.where(there, 0.0, self.rest_share[at])
            alive = alive[bound[alive] >= self.threshold - 1e-9]
            step += 1
        reached = np.unique(passage[np.concatenate(done)]) if done else passage[:0]
        best: dict[tuple[int, int], dict] = {}
        for p in reached.tolist():
            k, start = p // width, max(0, (p % width - 1) * half)
            own = words[k]
            terms = sorted({get(x, -1) for x in own[start:start + 2 * half]} - {-1})
            for item, score in self.search(terms):
                found = self.verify(item, own[start:start + 2 * half])
                if found[0] >= SIMILAR and found[1] >= SIMILAR and found[2] >= ANSWER_SIMILAR:
                    hit = {"item_id": self.ids[item], "start": start, "score": score, "overlap": found[0],
                           "question_overlap": found[1], "answer_overlap": found[2]}
                    if (k, item) not in best or best[k, item]["overlap"] < found[0]:
                        best[k, item] = hit
        for (k, _), hit in sorted(best.items(), key=lambda x: x[0]):
            out[k].append(hit)
        return out


HIT = "struct<item_id:long,start:long,score:double,overlap:double,question_overlap:double,answer_overlap:double>"
_HIT = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), *[(k, pa.float64()) for k in (
    "score", "overlap", "question_overlap", "answer_overlap")]]))


def item_shards(items: DataFrame) -> list[list[tuple[int, str]]]:
    """The items in shards of at most INDEX_BYTES of text (a longer item is a shard of its own)."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    shards, size = [[]], 0
    for row in rows.toLocalIterator():
        more = len(utf8(row["text"]))
        if shards[-1] and size + more > INDEX_BYTES:
            shards.append([])
            size = 0
        shards[-1].append((row["item_id"], row["text"]))
        size += more
    return shards


def with_hits(docs: DataFrame, items: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep` of `docs` and `hits`, the items found in each text; empty for null texts and where none is."""
    picked = docs.select(*[F.col(f"`{k}`") for k in keep], F.col("text").cast("string").alias("text_"))
    plain = picked.withColumn("hits", F.expr(f"cast(array() as array<{HIT}>)"))
    for shard in item_shards(items):
        shared = docs.sparkSession.sparkContext.broadcast(shard)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value)
            for batch in slices(batches, 500):
                texts = batch.column("text_").to_pylist()
                found = index.hits(texts) if index.ids else [[] for _ in texts]
                hits = [a + b for a, b in zip(batch.column("hits").to_pylist(), found)]
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in batch.schema.names[:-1]], pa.array(hits, _HIT)],
                                                 names=batch.schema.names)

        plain = plain.mapInArrow(run, plain.schema)
    return plain.drop("text_")


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each document and test item found in it: `doc_id`, `item_id`, the passage's first word, the score
    (1: all terms of the item), and the shares of shingles, question words and answer words found.

    Null and empty texts and items match nothing; repeated rows each give their rows; other columns are ignored. Items
    of fewer than five words count as one shingle.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_hits(named, items, "doc_id").select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.*")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents, all columns as they are, in which no test item is found."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return with_hits(row, items, "row").where(F.size("hits") == 0).select("row.*")
