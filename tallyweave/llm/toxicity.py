"""Toxicity by weak supervision.

Many voters look at a text: words of a lexicon, words that the labelled rows associate with a label, and patterns. A
generative label model estimates from their votes how often each votes under either label, finds voters that agree
beyond that and counts such a group less, and gives each text a posterior. A linear classifier learns the posteriors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyweave.llm.common import fold
from tallyweave.llm.decontaminate import plain_words

#: Labelled rows of each label that are learned from, at most about this many.
SAMPLE_ROWS = 4000
#: Words and beginnings of words that become voters and features of the classifier, beside the lexicon, for each label.
LEARNED_WORDS = 160
#: Bytes of a word's beginning that may vote for themselves, as insults are inflected.
BEGINNINGS = (4, 5, 6)

# Common insults in four languages, without accents where both spellings are in use.
LEXICON = """idiot idiots stupid moron morons loser losers trash garbage scum pathetic worthless disgusting clown clowns
dumb ugly fool fools jerk jerks creep filthy vermin imbecile cretin lowlife hate hateful kill shut freak freaks sucker
dummkopf trottel arschloch hurensohn abschaum idioten widerlich connard salaud ordure imbécile débile abruti crétin
estúpido estúpida imbécil basura asqueroso asquerosa tonto tonta idiota payaso""".split()
PATTERNS = [
    re.compile(r"!{2,}"), re.compile(r"\?!|!\?"), re.compile(r"\b[A-Z]{4,}\b.*\b[A-Z]{4,}\b", re.S), re.compile(r"[$#@*&%]{3,}"),
    re.compile(r"(?i)\byou(?:'re| are)? (?:a |an |such |so )?\w+"), re.compile(r"(.)\1{4,}"),
]


class LabelModel:
    """P(label) and, for each voter, P(votes | label), fitted by expectation and maximisation; label 1 is toxic.

    A voter votes or abstains. `weight` is one over the size of the group of voters, itself included, whose votes go
    together with its own beyond what the label explains.
    """

    def __init__(self, votes: np.ndarray, start: np.ndarray, rounds: int = 25, together: float = 0.3):
        votes = votes.astype(np.float64)
        posterior, self.weight = start.astype(np.float64), np.ones(votes.shape[1])
        for k in range(rounds):
            self._fit(votes, posterior)
            if k == 3:
                self.weight = self._groups(votes, posterior, together)
            # labels of the training rows are the strongest voter, but not beyond doubt
            posterior = self._posterior(votes, start)
        self.posterior = posterior

    def _fit(self, votes: np.ndarray, posterior: np.ndarray) -> None:
        self.prior = (posterior.sum() + 1) / (len(posterior) + 2)
        mass = np.array([len(posterior) - posterior.sum(), posterior.sum()])
        self.rate = np.stack([((1 - posterior) @ votes + 0.05) / (mass[0] + 0.1), (posterior @ votes + 0.05) / (mass[1] + 0.1)])

    def _groups(self, votes: np.ndarray, posterior: np.ndarray, together: float) -> np.ndarray:
        left = votes - np.where(posterior[:, None] > 0.5, self.rate[1], self.rate[0])
        size = np.sqrt((left ** 2).sum(axis=0)) + 1e-9
        return 1 / (np.abs(left.T @ left / np.outer(size, size)) > together).sum(axis=1).clip(1)

    def _posterior(self, votes: np.ndarray, start: np.ndarray) -> np.ndarray:
        yes, no = np.log(self.rate[1] / self.rate[0]), np.log((1 - self.rate[1]) / (1 - self.rate[0]))
        odds = np.log(self.prior / (1 - self.prior)) + votes @ (self.weight * yes) + (1 - votes) @ (self.weight * no)
        return 1 / (1 + np.exp(-np.clip(odds + np.log(start / (1 - start)), -40, 40)))


def fit_linear(x: np.ndarray, y: np.ndarray, penalty: float = 0.1, rounds: int = 25) -> np.ndarray:
    """Weights, the bias last, of a logistic regression on labels between 0 and 1, by Newton's method."""
    x = np.hstack([x.astype(np.float64), np.ones((len(x), 1))])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-4
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _terms(text: str | None) -> set[bytes]:
    """The different words of a text, and their beginnings (as bytes, with a star)."""
    words = set(plain_words(text))
    return words.union(*[{w[:k] + b"*" for w in words if len(w) > k} for k in BEGINNINGS])


def _marks(text: str | None, words: dict[bytes, int], size: int) -> np.ndarray:
    """Which words and patterns a text has."""
    out = np.zeros(size, np.uint8)
    for w in words.keys() & _terms(text):
        out[words[w]] = 1
    for k, pattern in enumerate(PATTERNS):
        out[len(words) + k] = pattern.search(text or "") is not None
    return out


def train(labelled: DataFrame) -> dict:
    """A classifier (words, weights) from columns `text` and `toxic`; rows without a label teach nothing.

    At most about SAMPLE_ROWS rows of each label are used, chosen by a hash of the text. Without rows of both labels the
    lexicon alone decides.
    """
    rows = labelled.where("toxic in (0, 1)").select(F.col("text").cast("string").alias("text"), F.col("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    lexicon = [w.encode() for w in LEXICON]
    if len(counts) < 2:
        return {"words": lexicon, "weights": [4.0] * len(lexicon) + [0.0] * len(PATTERNS) + [-2.0]}
    share = F.when(F.col("toxic") == 1, min(1.0, SAMPLE_ROWS / counts[1])).otherwise(min(1.0, SAMPLE_ROWS / counts[0]))
    rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < share * 1_000_003)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                own = [sorted(_terms(t)) for t in batch.column("text").to_pylist()]
                toxic = np.repeat(batch.column("toxic").to_numpy(), [len(x) for x in own])
                yield pa.RecordBatch.from_arrays([pa.array([w for x in own for w in x], pa.binary()), pa.array(toxic, pa.int32())],
                                                 names=["word", "toxic"])

    total = rows.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    toxic, clean = total["t"], total["n"] - total["t"]
    tally = rows.mapInArrow(distinct, "word binary, toxic int").groupBy("word").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    with_, without = F.col("t") / toxic, (F.col("n") - F.col("t")) / clean
    spread = F.sqrt((F.col("n") + 1) / (toxic + clean) * (1 / toxic + 1 / clean))
    tally = tally.where("n >= 5").select("word", ((with_ - without) / spread).alias("z"))
    learned = [bytes(r["word"]) for side in (F.desc("z"), F.asc("z")) for r in tally.orderBy(side, "word").limit(LEARNED_WORDS).collect()]
    words = {w: k for k, w in enumerate(dict.fromkeys([*lexicon, *learned]))}
    size = len(words) + len(PATTERNS)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows_ = [_marks(t, words, size).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows_, pa.binary()), batch.column("toxic")], names=["marks", "toxic"])

    found = rows.mapInArrow(marked, "marks binary, toxic int").collect()
    found.sort(key=lambda r: (bytes(r["marks"]), r["toxic"]))
    votes = np.frombuffer(b"".join(bytes(r["marks"]) for r in found), np.uint8).reshape(-1, size)
    label = np.array([r["toxic"] for r in found])
    model = LabelModel(votes, np.where(label == 1, 0.97, 0.03))
    return {"words": list(words), "weights": fit_linear(votes, model.posterior).tolist()}


def score(docs: DataFrame, classifier: dict, *keep: str) -> DataFrame:
    """The columns `keep` with `score`, the probability that a text is toxic, and `predicted` (1 from 0.5 on).

    Null and empty texts are scored like a text without any word. Repeated rows are scored alike; other columns are
    ignored.
    """
    words = {w: k for k, w in enumerate(classifier["words"])}
    weights = np.array(classifier["weights"])
    picked = docs.select(*[F.col(f"`{k}`") for k in keep], F.col("text").cast("string").alias("text_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odds = np.array([_marks(t, words, len(weights) - 1) @ weights[:-1] + weights[-1] for t in batch.column("text_").to_pylist()])
            p = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))],
                                             names=[*keep, "score", "predicted"])

    return picked.mapInArrow(run, picked.drop("text_").schema.add("score", "double").add("predicted", "integer"))


def held_out_toxicity(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0) -> DataFrame:
    """Every document's score by a classifier learned from the labels outside one fold of ids."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", parts) == held).alias("held_out"), "text")
    taught = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(
        (fold("doc_id", parts) != held) & F.col("toxic").isin(0, 1)).distinct()
    # the sample is drawn from the labels alone, so that texts need not be shuffled to meet them; its size is bounded
    counts = {r["toxic"]: r["count"] for r in taught.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, min(1.0, SAMPLE_ROWS / counts.get(1, 1))).otherwise(min(1.0, SAMPLE_ROWS / counts.get(0, 1)))
    sample = taught.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003)
    return score(named, train(named.where("not held_out").join(F.broadcast(sample), "doc_id")), "doc_id", "held_out")
