"""Phrases of words that belong together, mined by set-oriented joins of occurrence relations (SETM).

Relation R1 holds the occurrences of words, (piece, position, word), sorted by piece and position and stored in blocks of whole
documents. From there on each length repeats the same steps: the relation is merge-joined with itself where piece and
position are adjacent, the groups are counted, and only occurrences of frequent groups go into the stored relation that the
next length extends. Blocks hold whole pieces, so the merge-join needs no shuffle; only counts of groups, already
summed over the blocks of a task, a million groups at a time, are shuffled.

A block keeps a piece and a position as one number `at`: neighbours within a piece differ by 1, pieces lie further apart.
Words are known by a 64-bit hash that is checked to be free of collisions over the whole corpus (else the next seed is taken).
The semi-join with frequent groups reads a bitmap of fixed size: it never loses a frequent group, and what it lets through
besides is dropped by the exact count of the next length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tallyweave.llm.common import LOWER, released, stored, utf8
from tallyweave.streaming.events import settings

LEAST = 10
LONGEST = 3
TOP = 2000
#: A shorter candidate goes if a longer one around it has this share of its occurrences, in percent.
SHARE = 50
#: Word occurrences that a block gathers before it is stored; a longer document is a block alone.
BLOCK_WORDS = 1_000_000
#: Most bits of the bitmap of frequent groups (32 MB), and bits per group below that. More groups than it serves cost time,
#: not results.
FILTER_BITS, GROUP_BITS = 1 << 28, 16
#: Groups of a task's blocks that are added up at once.
HELD = 1 << 20
#: Slots of a bitmap that leave a task at once (1 MB).
SLOTS = 1 << 16
#: Spark's reader takes a block at a time, not all blocks of a row group.
BY_BLOCK = {"spark.sql.parquet.columnarReaderBatchSize": "1"}
#: Bytes of rows that go to Python at once; a longer block goes alone.
BATCH = 1 << 20
#: Ways in which a language's candidates are ranked before they meet in one task, which reads WAYS * TOP rows at most.
WAYS = 128

_CUT = 0xFF  # never part of UTF-8
_SPLIT = bytes(_CUT if b in b".,;:!?\x0a\x0b\x0c\x0d" else 0x20 if b == 9 else LOWER[b] for b in range(256))
_MARK = bytes((_CUT,))


def pieces_of(text: str | None) -> list[bytes]:
    """The words of a text with a mark for every end of a piece; a null text has none."""
    return utf8(text).translate(_SPLIT).replace(_MARK, b" \xff ").split()


# --- relations ---------------------------------------------------------------------------------------------------

_R1 = "lang string, words array<binary>, ids array<bigint>, counts array<bigint>, gap array<smallint>, item array<int>"


class _Numbers(dict):
    """A number for each distinct key, in order of first use."""

    def __missing__(self, key: bytes) -> int:
        self[key] = number = len(self)
        return number


def word_relation(docs: DataFrame, seed: int, block_words: int = BLOCK_WORDS) -> DataFrame:
    """R1 in blocks of one language: distinct words with their ids and counts, and the occurrences in order (`gap` to the
    one before, `item` among the words)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, _Numbers] = {}
        runs: dict[str, list[np.ndarray]] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in runs.items():
                said = np.concatenate(parts)
                where = np.flatnonzero(said)  # 0 marks the end of a piece
                words = list(numbers[lang])[1:]
                gap = np.minimum(np.diff(where, prepend=-2), 2).astype(np.int16)
                item = (said[where] - 1).astype(np.int32)
                name = lang.encode() + _MARK
                ids = np.fromiter((xxhash.xxh64_intdigest(name + w, seed) for w in words), np.uint64, len(words))
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang]), pa.array([words], pa.list_(pa.binary())),
                    pa.array([ids.view(np.int64)], pa.list_(pa.int64())),
                    pa.array([np.bincount(item, minlength=len(words))], pa.list_(pa.int64())),
                    pa.array([gap], pa.list_(pa.int16())), pa.array([item], pa.list_(pa.int32())),
                ], names=["lang", "words", "ids", "counts", "gap", "item"])
            numbers.clear(), runs.clear()

        for batch in released(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                said = pieces_of(text.as_py())
                if not said:
                    continue
                if lang not in numbers:
                    numbers[lang], runs[lang] = _Numbers({_MARK: 0}), []
                said.append(_MARK)
                runs[lang].append(np.fromiter(map(numbers[lang].__getitem__, said), np.int32, len(said)))
                held += len(said)
                if held >= block_words:
                    yield from flush()
                    held = 0
        yield from flush()

    picked = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                         F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, _R1)


def _numpy(batch: pa.RecordBatch, column: str, row: int) -> np.ndarray:
    return batch.column(column)[row].values.to_numpy(zero_copy_only=False)


def _mixed(keys: list[np.ndarray]) -> np.ndarray:
    """One 64-bit number per group of word ids."""
    out = np.zeros(len(keys[0]), np.uint64)
    for key in keys:
        out = (out ^ key.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _places(keys: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    mixed = _mixed(keys)
    return mixed % np.uint64(bits), (mixed * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20)) % np.uint64(bits)


def frequent_filter(groups: DataFrame, keys: list[str], most_bits: int) -> np.ndarray:
    """A bitmap of the groups, put together from a bitmap per task; at most `most_bits` / 64 rows reach the driver."""
    bits = min(most_bits, max(64, 1 << (GROUP_BITS * groups.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(bits >> 6, np.uint64)
        for batch in released(batches):
            for place in _places([batch.column(k).to_numpy() for k in keys], bits):
                np.bitwise_or.at(mine, place >> np.uint64(6), np.uint64(1) << (place & np.uint64(63)))
        for start in range(0, len(mine), SLOTS):
            part = mine[start:start + SLOTS]
            used = np.flatnonzero(part)
            yield pa.RecordBatch.from_arrays([pa.array(used + start, pa.int64()), pa.array(part[used].view(np.int64))], names=["slot", "mask"])

    slots = groups.select(*keys).mapInArrow(run, "slot bigint, mask bigint").groupBy("slot").agg(F.bit_or("mask").alias("mask"))
    table = slots.toArrow()
    out = np.zeros(bits >> 6, np.uint64)
    out[table.column("slot").to_numpy()] = table.column("mask").to_numpy().view(np.uint64)
    return out


def _passes(keys: list[np.ndarray], bitmap: np.ndarray) -> np.ndarray:
    stays = np.ones(len(keys[0]), bool)
    for place in _places(keys, len(bitmap) << 6):
        stays &= (bitmap[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
    return stays


def _joined(at: np.ndarray, item: np.ndarray, keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The relation merge-joined with itself at adjacent positions: (at, group), a group being the number of its left item
    times the number of items, plus that of its right one."""
    left = np.flatnonzero(np.diff(at) == 1)
    return at[left], item[left].astype(np.int64) * max(len(keys[0]), 1) + item[left + 1]


def _group_keys(groups: np.ndarray, keys: list[np.ndarray]) -> list[np.ndarray]:
    """The word ids of groups. `keys` names each item by its word ids; two adjacent items share all but the outer words, so a
    group has the left item's ids and the right item's last one."""
    first, second = np.divmod(groups, max(len(keys[0]), 1))
    return [*(k[first] for k in keys), keys[-1][second]]


def _kept(at: np.ndarray, item: np.ndarray, keys: list[np.ndarray], bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The semi-join: occurrences of items that the bitmap of frequent groups lets pass, items numbered anew."""
    stays = _passes(keys, bitmap)
    number = np.cumsum(stays, dtype=np.int64) - 1
    here = stays[item]
    return at[here], number[item[here]].astype(np.int32), [k[stays] for k in keys]


def _names(length: int) -> list[str]:
    return [f"w{i}" for i in range(1, length + 1)]


def _relation(batch: pa.RecordBatch, row: int, names: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    at = np.cumsum(_numpy(batch, "gap", row), dtype=np.int64)
    return at, _numpy(batch, "item", row), [_numpy(batch, n, row) for n in names]


def _added(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """The columns of word ids and counts of some blocks as one, equal groups added up. Groups that share a mixed number can
    stay in several rows, which the count after the shuffle adds up."""
    if len(parts) == 1:
        return parts[0]
    columns = [np.concatenate(c) for c in zip(*parts)]
    order = np.argsort(_mixed(columns[:-1]))
    columns = [c[order] for c in columns]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in columns[:-1]:
        new[1:] |= key[1:] != key[:-1]
    first = np.flatnonzero(new)
    return [*(key[first] for key in columns[:-1]), np.add.reduceat(columns[-1], first) if len(first) else columns[-1]]


def group_counts(relation: DataFrame, length: int, bitmap: Broadcast | None) -> DataFrame:
    """(w1 … , a): how often each group of `length` words occurs in some blocks, from the relation of one word less and the
    bitmap of its frequent groups; none if it holds only those. A word's id tells its language as well."""
    before, names = _names(length - 1), _names(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            columns = _added(held) if held else []
            held.clear()
            for i in range(0, len(columns[-1]) if columns else 0, 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i:i + 100_000]) for c in columns], names=[*names, "a"])

        for batch in released(batches):
            for row in range(batch.num_rows):
                at, item, keys = _relation(batch, row, before)
                if bitmap:
                    at, item, keys = _kept(at, item, keys, bitmap.value)
                groups, counts = np.unique(_joined(at, item, keys)[1], return_counts=True)
                if sum(len(part[-1]) for part in held) + len(counts) > HELD:
                    yield from flush()
                held.append([*_group_keys(groups, keys), counts])
        yield from flush()

    return relation.select("gap", "item", *before).mapInArrow(run, ", ".join(f"{n} bigint" for n in [*names, "a"]))


def next_relation(relation: DataFrame, length: int, below: Broadcast | None, bitmap: Broadcast) -> DataFrame:
    """The relation of groups of `length` words, semi-joined with the frequent ones; `below` as in `group_counts`."""
    before, names = _names(length - 1), _names(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for row in range(batch.num_rows):
                at, item, keys = _relation(batch, row, before)
                if below:
                    at, item, keys = _kept(at, item, keys, below.value)
                at, joined = _joined(at, item, keys)
                groups, number = np.unique(joined, return_inverse=True)
                at, item, keys = _kept(at, number, _group_keys(groups, keys), bitmap.value)
                if len(at):
                    gap = np.minimum(np.diff(at, prepend=at[0] - 2), 2).astype(np.int16)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([gap], pa.list_(pa.int16())), pa.array([item], pa.list_(pa.int32())),
                         *(pa.array([k], pa.list_(pa.int64())) for k in keys)], names=["gap", "item", *names])

    schema = ", ".join(["gap array<smallint>, item array<int>", *(f"{n} array<bigint>" for n in names)])
    return relation.select("gap", "item", *before).mapInArrow(run, schema)


# --- mining ------------------------------------------------------------------------------------------------------

def _words(spark: SparkSession, docs: DataFrame, block_words: int) -> tuple[DataFrame, DataFrame]:
    """R1, and every word with its id and count, under a seed without collisions."""
    for seed in range(64):
        relation = stored(word_relation(docs, seed, block_words), "setm-r1", batch=BATCH)
        counted = relation.select("lang", F.explode(F.arrays_zip("words", "ids", "counts")).alias("x")).groupBy(
            "lang", F.col("x.words").alias("word"), F.col("x.ids").alias("w1")).agg(F.sum("x.counts").alias("a"))
        with settings(spark, BY_BLOCK):
            words = stored(counted, "setm-words")
        if words.groupBy("w1").count().where("count > 1").isEmpty():
            return relation, words
    raise RuntimeError("no seed without collisions found")


def frequent_groups(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, block_words: int = BLOCK_WORDS,
                    filter_bits: int = FILTER_BITS) -> tuple[DataFrame, list[DataFrame]]:
    """All words (lang, word, w1, a), and for each length from 1 the groups of words (w1 …, a) that occur at least `least`
    times within pieces of their language."""
    if least < 1 or longest < 1:
        raise ValueError("least and longest are 1 or more")
    spark = docs.sparkSession
    relation, words = _words(spark, docs, block_words)
    relation = relation.withColumnRenamed("ids", "w1")
    levels = [words.where(F.col("a") >= least).select("w1", "a")]
    below = spark.sparkContext.broadcast(frequent_filter(levels[0], ["w1"], filter_bits)) if longest > 1 else None
    for length in range(2, longest + 1):
        names = _names(length)
        # dealt out before they are counted: tasks have added them up, a second table of them would only take memory
        counts = group_counts(relation, length, below).repartition(*names).groupBy(*names).agg(F.sum("a").alias("a"))
        with settings(spark, BY_BLOCK):
            levels.append(stored(counts.where(F.col("a") >= least), f"setm-g{length}", batch=BATCH))
        if length < longest:
            bitmap = spark.sparkContext.broadcast(frequent_filter(levels[-1], names, filter_bits))
            with settings(spark, BY_BLOCK):
                relation = stored(next_relation(relation, length, below, bitmap), f"setm-r{length}", batch=BATCH)
            bitmap.unpersist()
        if below:  # the relations of two words and more hold frequent groups only
            below.unpersist()
            below = None
    return words, levels


def _scored(levels: list[DataFrame], length: int) -> DataFrame:
    """Candidates of one length with the cut of least score: (w1 …, a, l, r, score)."""
    names, out = _names(length), levels[length - 1]
    cuts = []
    for k in range(1, length):
        first = levels[k - 1].withColumnRenamed("a", f"l{k}")
        rest = levels[length - k - 1].select(
            *(F.col(f"w{i}").alias(f"w{i + k}") for i in range(1, length - k + 1)), F.col("a").alias(f"r{k}"))
        # parts of a frequent phrase are frequent: neither join loses a row
        out = out.join(first, names[:k]).join(rest, names[k:])
        wide = lambda c: f"cast({c} AS decimal(15,0))"
        score = F.expr(f"(1000000 * ({wide('a')} * {wide('a')})) div ({wide(f'l{k}')} * {wide(f'r{k}')})")
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
    least = cuts[0] if len(cuts) == 1 else F.least(*cuts)
    return out.withColumn("cut", least).select(*names, "a", "cut.l", "cut.r", "cut.score")


def _outside(levels: list[DataFrame], scored: DataFrame, length: int, share: int) -> DataFrame:
    """Candidates that no longer frequent phrase around them has `share` percent of."""
    names = _names(length)
    around = None
    for longer in range(length + 1, len(levels) + 1):
        for start in range(longer - length + 1):
            part = levels[longer - 1].select(*(F.col(f"w{start + i}").alias(f"w{i}") for i in range(1, length + 1)), "a")
            part = part.groupBy(*names).agg(F.max("a").alias("around"))
            around = part if around is None else around.unionAll(part)
    if around is None:
        return scored
    most = around.groupBy(*names).agg(F.max("around").alias("around"))
    return scored.join(most, names, "left").where(
        F.col("around").isNull() | (100 * F.col("around") < share * F.col("a"))).drop("around")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, share: int = SHARE,
                 block_words: int = BLOCK_WORDS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to `longest` words.

    A phrase occurs `a` times in a row within pieces. Of its cuts into a first part (`l` occurrences) and a rest (`r`), that
    with the least floor(1,000,000 a² / (l r)) is its score. Phrases around which a longer one has `share` percent of the
    occurrences or more are left out. Ranks go by score and `a`, descending, and the phrase in byte order.

    A null language is `und`; null and empty texts have no words; repeated rows count as often as they occur; other
    columns are ignored; an empty table, or one without frequent phrases, gives no rows.
    """
    words, levels = frequent_groups(docs, least, longest, block_words, filter_bits)
    total = words.groupBy("lang").agg(F.sum("a").alias("n"))
    text = words.where(F.col("a") >= least).select("lang", "w1", "word")
    ways = []
    for length in range(2, longest + 1):
        found = _outside(levels, _scored(levels, length), length, share)
        for name in _names(length):  # the first word tells the language
            named = text if name == "w1" else text.drop("lang")
            found = found.join(named.withColumnsRenamed({"w1": name, "word": f"t_{name}"}), name)
        phrase = F.concat_ws(" ", *(F.decode(f"t_{name}", "UTF-8") for name in _names(length)))
        ways.append(found.select("lang", phrase.alias("phrase"), "a", "l", "r", "score"))
    if not ways:
        return docs.sparkSession.createDataFrame(
            [], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    found = ways[0]
    for way in ways[1:]:
        found = found.unionAll(way)
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = F.row_number().over(W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(WAYS))).orderBy(*best))
    best_of = F.row_number().over(W.partitionBy("lang").orderBy(*best))
    ranked = found.withColumn("rank", some).where(F.col("rank") <= top).withColumn("rank", best_of.cast("long")).where(
        F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
