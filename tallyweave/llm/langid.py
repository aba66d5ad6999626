"""Language identification by interpolated Kneser-Ney character models, one for each language.

Training counts n-grams of letters in a bounded sample of labelled rows. A model keeps, for each order, its n-grams as
a sorted array of 64-bit hashes with discounted probabilities and back-off weights beside it. A text goes to the
language with the lowest cross-entropy per character; where even that is far above what the language's own texts
have, the text is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyweave.llm.common import fold, released, slices

ORDER = 4
#: Rows of each language, at most about this many, that a model is counted on and, as many again, calibrated on.
SAMPLE_ROWS = 1500
#: Rows whose texts are compared with the models at once.
ROWS_AT_ONCE = 300
#: Bits per character above the worst of a language's own calibration texts at which a text is rejected; short texts,
#: which vary more, are allowed `SHORT_BITS` in all on top.
REJECT_BITS, SHORT_BITS = 1.0, 40.0
#: Share of the calibration rows that lie within a language's limit before `REJECT_BITS` are added, so that single odd or
#: mislabelled rows do not set it.
WORST_SHARE = 0.995
_SPACE = np.uint32(32)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _fold_table(limit: int = 0x110000) -> np.ndarray:
    """Code point to the lower-case letter, or to a space for what is no letter."""
    out = np.full(limit, 32, np.uint32)
    for c in range(limit):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_TABLE: list[np.ndarray] = []


def letters(text: str | None) -> np.ndarray:
    """Lower-case letters with one space before, between and after words; empty if there is no letter."""
    if not text:
        return np.empty(0, np.uint32)
    if not _TABLE:
        _TABLE.append(_fold_table())
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    folded = np.concatenate(([_SPACE], _TABLE[0][codes], [_SPACE]))
    kept = folded[np.concatenate(([True], (folded[1:] != _SPACE) | (folded[:-1] != _SPACE)))]
    return kept if len(kept) > 1 else np.empty(0, np.uint32)


def gram_hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1 to `order` the hash of the n characters that end at each position; the start is padded with zeros."""
    wide = codes.astype(np.uint64)
    out, h = [], np.zeros(len(wide), np.uint64)
    padded = np.concatenate((np.zeros(order, np.uint64), wide))
    for n in range(1, order + 1):
        h = (h ^ (padded[order - n + 1: order - n + 1 + len(wide)] + np.uint64(n))) * _MIX
        h ^= h >> np.uint64(29)
        out.append(h)
    return out


class CharModel:
    """Interpolated Kneser-Ney over sorted hash arrays.

    Hashes of an n-gram are built from its last character backwards, so that the hash of a gram's suffix is that of the
    lower order. `levels[n]` has (hashes, discounted probability, context hashes, back-off weight).
    """

    def __init__(self, alphabet: int, levels: list[tuple[np.ndarray, ...]]):
        self.alphabet, self.levels = alphabet, levels

    @classmethod
    def fit(cls, counts: list[pd.DataFrame], alphabet: int) -> CharModel:
        """counts[n - 1]: columns gram, context, shorter (hashes of the gram, of it without its last and without its
        first character) and count."""
        levels, order = [], len(counts)
        for n in range(1, order + 1):
            seen = counts[n - 1]
            if n == order:
                used = seen["count"].to_numpy(np.float64)
            else:  # in how many ways the gram is preceded
                ways = counts[n].groupby("shorter").size()
                used = ways.reindex(seen["gram"]).fillna(0).to_numpy(np.float64)
                seen, used = seen[used > 0], used[used > 0]
            ones, twos = (used == 1).sum(), (used == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            grams, contexts = seen["gram"].to_numpy(np.uint64), seen["context"].to_numpy(np.uint64)
            context, where = np.unique(contexts, return_inverse=True)
            total = np.bincount(where, used)
            weight = discount * np.bincount(where) / total
            by = np.argsort(grams)
            levels.append((grams[by], (np.maximum(used - discount, 0) / total[where])[by], context, weight))
        return cls(alphabet, levels)

    @staticmethod
    def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
        if not len(keys):
            return np.full(len(wanted), default)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], default)

    def log2(self, grams: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
        """log2 of the probability of each gram's last character after the others; lowest order first."""
        p = np.full(len(grams[0]), 1.0 / self.alphabet)
        for (keys, own, context, weight), g, c in zip(self.levels, grams, contexts):
            p = self._find(keys, own, g, 0.0) + self._find(context, weight, c, 1.0) * p
        return np.log2(p)


def context_hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1 to `order` the hash of the n - 1 characters before each position (n = 1: zero)."""
    before = np.concatenate((np.zeros(1, np.uint32), codes[:-1]))
    return [np.zeros(len(codes), np.uint64), *gram_hashes(before, order - 1)] if order > 1 else [np.zeros(len(codes), np.uint64)]


def _counted(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """Counts of n-grams of each language in a batch; `shorter` is the gram without its first character."""
    for batch in released(batches):
        frames = []
        for lang, rows in batch.to_pandas().groupby("lang"):
            texts = [x for x in map(letters, rows["text"]) if len(x)]
            if not texts:
                continue
            grams = [np.concatenate(x) for x in zip(*[gram_hashes(t, order) for t in texts])]
            contexts = [np.concatenate(x) for x in zip(*[context_hashes(t, order) for t in texts])]
            for n in range(order):
                keys, first, count = np.unique(grams[n], return_index=True, return_counts=True)
                frames.append(pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(keys)), pa.array(np.full(len(keys), n + 1, np.int32)),
                    *[pa.array(x.view(np.int64)) for x in (
                        keys, contexts[n][first], grams[n - 1][first] if n else np.zeros(len(keys), np.uint64))],
                    pa.array(count.astype(np.int64))], names=["lang", "n", "gram", "context", "shorter", "count"]))
        yield from frames


class Identifier:
    """The models of all languages and the worst cross-entropy that each has on texts of its own."""

    def __init__(self, models: dict[str, CharModel], order: int = ORDER, worst: dict[str, float] | None = None):
        self.models, self.order, self.worst = models, order, worst or {}

    def plain(self) -> tuple:
        """Arrays and numbers only, to be sent to the executors."""
        return {k: (m.alphabet, m.levels) for k, m in self.models.items()}, self.order, self.worst

    @classmethod
    def from_plain(cls, models: dict, order: int, worst: dict) -> Identifier:
        return cls({k: CharModel(*m) for k, m in models.items()}, order, worst)

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy in bits per character of each text (rows) in each language (columns); characters of each text."""
        rows = [letters(t) for t in texts]
        sizes = np.array([len(r) for r in rows], np.int64)
        out = np.full((len(rows), len(self.models)), np.nan)
        filled = np.nonzero(sizes)[0]
        if not len(filled):
            return out, sizes
        parts = [gram_hashes(rows[k], self.order)[-1] for k in filled]
        longest = np.concatenate(parts)
        where, distinct = pd.factorize(longest)
        first = np.full(len(distinct), -1, np.int64)
        first[where[::-1]] = np.arange(len(where) - 1, -1, -1)
        starts = np.cumsum(sizes[filled]) - sizes[filled]
        owner = np.searchsorted(starts, first, side="right") - 1
        # the characters of each distinct gram, oldest first, zeros where the text had not begun
        codes = np.concatenate([rows[k] for k in filled])
        back = np.stack([np.where(first - j >= starts[owner], codes[np.maximum(first - j, 0)], 0) for j in range(self.order)])
        grams = _from_characters(back)
        contexts = [np.zeros(len(first), np.uint64), *_from_characters(back[1:])] if self.order > 1 else [np.zeros(len(first), np.uint64)]
        for column, model in enumerate(self.models.values()):
            bits = -model.log2(grams, contexts)
            out[filled, column] = np.add.reduceat(bits[where], starts) / sizes[filled]
        return out, sizes

    def decide(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language (`und` without letters), posterior of it, cross-entropy and whether it is rejected, for each text."""
        names = list(self.models)
        found, sizes = self.entropies(texts)
        best = np.where(sizes > 0, np.argmin(np.nan_to_num(found, nan=np.inf), axis=1), -1)
        langs = [names[b] if b >= 0 else "und" for b in best]
        least = np.where(best >= 0, found[np.arange(len(best)), best], np.nan)
        odds = np.exp2(-np.minimum(1000, (found - least[:, None]) * sizes[:, None]))
        score = np.where(best >= 0, 1 / np.nansum(np.where(np.isnan(odds), 0, odds), axis=1).clip(1), 0.0)
        worst = np.array([self.worst.get(x, np.inf) for x in langs])
        rejected = (best < 0) | (least > worst + REJECT_BITS + SHORT_BITS / np.maximum(sizes, 1))
        return langs, score, least, rejected


def _from_characters(back: np.ndarray) -> list[np.ndarray]:
    """Hashes for n = 1, 2, ... of grams whose last character is back[0], the one before it back[1] and so on."""
    out, h = [], np.zeros(back.shape[1], np.uint64)
    for n, row in enumerate(back.astype(np.uint64), 1):
        h = (h ^ (row + np.uint64(n))) * _MIX
        h ^= h >> np.uint64(29)
        out.append(h)
    return out


def _sample(rows: DataFrame, limit: int) -> DataFrame:
    """About `limit` rows of each language, chosen by a hash of the text, so that it is the same on every run."""
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    share = {r["lang"]: min(1.0, limit / r["n"]) for r in sizes.collect()}
    if not share:
        return rows
    picks = F.create_map(*[x for k, v in share.items() for x in (F.lit(k), F.lit(v))])
    return rows.where(F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1_000_003)) < picks[F.col("lang")] * 1_000_003)


def train(labelled: DataFrame, order: int = ORDER, sample_rows: int = SAMPLE_ROWS) -> Identifier:
    """An identifier learned from `text` and `lang`; rows without either, or without letters, teach nothing.

    At most about `sample_rows` rows of each language are counted and as many others calibrate the rejection.
    """
    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where("text is not null and lang is not null")
    counting = F.pmod(F.xxhash64("text"), F.lit(2)) == 0
    schema = "lang string, n int, gram long, context long, shorter long, count long"
    counts = _sample(rows.where(counting), sample_rows).mapInArrow(lambda it: _counted(it, order), schema)
    found = counts.groupBy("lang", "n", "gram").agg(
        F.first("context").alias("context"), F.first("shorter").alias("shorter"), F.sum("count").alias("count")).toPandas()
    for name in ("gram", "context", "shorter"):
        found[name] = found[name].to_numpy(np.int64).view(np.uint64)
    alphabet = 2 * max(26, found.loc[found["n"] == 1, "gram"].nunique())
    models = {}
    for lang in sorted(found["lang"].unique()):
        own = found[found["lang"] == lang]
        models[lang] = CharModel.fit([own[own["n"] == n] for n in range(1, order + 1)], alphabet)
    identifier = Identifier(models, order)
    if models:
        shared = labelled.sparkSession.sparkContext.broadcast(identifier.plain())

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Identifier.from_plain(*shared.value)
            column = {k: c for c, k in enumerate(known.models)}
            for batch in slices(batches, ROWS_AT_ONCE):
                bits, sizes = known.entropies(batch.column("text").to_pylist())
                own = [bits[r, column[k]] if k in column else np.nan for r, k in enumerate(batch.column("lang").to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(own), pa.array(sizes)], names=["lang", "bits", "size"])

        held = _sample(rows.where(~counting), sample_rows).mapInArrow(measure, "lang string, bits double, size long")
        for r in held.where("size > 0 and not isnan(bits)").groupBy("lang").agg(
                F.percentile(F.col("bits") - SHORT_BITS / F.col("size"), F.lit(WORST_SHARE)).alias("bits")).collect():
            identifier.worst[r["lang"]] = r["bits"]
    return identifier


def identify(docs: DataFrame, identifier: Identifier, *keep: str) -> DataFrame:
    """The columns `keep` of `docs` with `lang_pred`, `score` (0 to 1), `bits` per character and `rejected`.

    A text that is null, empty or without a letter gets `und`, score 0 and is rejected. Ties go to the first language
    in alphabetical order. An identifier that has learned nothing answers `und` throughout.
    """
    shared = docs.sparkSession.sparkContext.broadcast(identifier.plain())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Identifier.from_plain(*shared.value)
        for batch in slices(batches, ROWS_AT_ONCE):
            texts = batch.column("text_").to_pylist()
            if known.models:
                langs, score, bits, rejected = known.decide(texts)
            else:
                n = len(texts)
                langs, score, bits, rejected = ["und"] * n, np.zeros(n), np.full(n, np.nan), np.ones(n, bool)
            columns = {k: batch.column(k) for k in keep} | {
                "lang_pred": pa.array(langs, pa.string()), "score": pa.array(score, pa.float64()),
                "bits": pa.array(bits, pa.float64(), from_pandas=True), "rejected": pa.array(rejected, pa.bool_())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    picked = docs.select(*[F.col(f"`{k}`") for k in keep], F.col("text").cast("string").alias("text_"))
    schema = picked.drop("text_").schema.add("lang_pred", "string").add("score", "double").add("bits", "double").add("rejected", "boolean")
    return picked.mapInArrow(run, schema)


def held_out_languages(docs: DataFrame, parts: int = 4, held: int = 2) -> DataFrame:
    """Every document's language by models learned from the documents outside one fold of ids."""
    remainder = fold("doc_id", parts)
    identifier = train(docs.where((remainder != held) & F.col("lang").isNotNull()))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (remainder == held).alias("held_out"))
    return identify(named, identifier, "doc_id", "held_out")


def known_languages(docs: DataFrame) -> DataFrame:
    """The documents, all columns as they are, whose text some language's model accepts."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    return identify(row, train(docs), "row").where(~F.col("rejected")).select("row.*")
