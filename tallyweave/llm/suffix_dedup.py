"""Removal of byte strings that occur more than once, by merging Burrows-Wheeler transforms.

A string of `length` bytes that starts in two places also shares its anchor, the smallest of its 16-byte grams, and
what lies around it. So strings are dealt out by anchor and by their offset from it (in cells of 48 offsets), and only
cells whose common core occurs more than once go on. Cells that are equal as a whole are one weighted entry. What is
left differs somewhere at its rim: its bytes are cut into shards, each with the Burrows-Wheeler transform of its own
strings (in blocks of bytes instead of single ones), and the transforms are merged by refining their interleave block
by block, without sorting the strings of all shards again. Neighbours that no round has told apart share a prefix of
`length` bytes: these intervals are the repeats.

Cores with more different rims than one task should hold are settled by counting digests of their strings instead.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tallyweave.llm.common import FREED, LOWER, slices, utf8, words_of
from tallyweave.session import cut_lineage
from tallyweave.streaming.events import settings

LENGTH = 400
#: Words of the shortest passage that counts as repeated, and characters that stand for a word where words are compared.
WORDS, CODE = 51, 6
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
GRAM, CELL, STEPS = 16, 48, 4
#: Different cells around one core that one task merges; more are settled by digests.
CORE_LIMIT = 2048
#: Strings in a shard, cells that are merged at once, and bytes that are scanned at once.
SHARD, MERGE_CELLS, SCAN_BYTES = 16384, 4096, 1 << 18
#: Bytes of a batch that goes to Python, about.
BATCH_BYTES = 8 << 20

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x5851F42D4C957F2D
_MIX = np.uint64(0x9E3779B97F4A7C15)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.concatenate((np.ones(1, np.uint64), np.full(size, b, np.uint64))).cumprod(dtype=np.uint64)
                          for b in (_BASE, inverse)]
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums from which the hash of any part of `data` follows, and the inverse powers."""
    power, inverse = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * power[: len(data)], dtype=np.uint64)))
    return sums, inverse


def _hash(sums: np.ndarray, inverse: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (sums[at + length] - sums[at]) * inverse[at]
        h ^= h >> np.uint64(31)
        h *= _MIX
        return h ^ h >> np.uint64(29)


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start of a string of `length` bytes its anchor's position, and the hash of the gram at each position."""
    window = length - GRAM + 1
    sums, inverse = prefix_hashes(data)
    grams = _hash(sums, inverse, np.arange(len(data) - GRAM + 1), GRAM)
    n = len(grams)
    ranked = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // window) * window, ~np.uint64(0))
    padded[:n] = ranked
    rows = padded.reshape(-1, window)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - window + 1
    least = np.minimum(after[:starts], before[window - 1: window - 1 + starts])
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64), grams


def _scan(tids: list[bytes], texts: list[bytes], copies: list[int], length: int) -> Iterator[pa.RecordBatch]:
    """Runs of neighbouring strings with one anchor: text, its copies, hash of the anchor, place of the anchor, first and last start."""
    def pieces() -> Iterator[tuple[int, int, bytes]]:
        for k, text in enumerate(texts):
            for at in range(0, len(text) - length + 1, 4 * SCAN_BYTES):
                yield k, at, text[at:at + 4 * SCAN_BYTES + length - 1]

    def emit(group: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(g[2] for g in group), np.uint8)
        sizes = np.array([len(g[2]) for g in group], np.int64)
        begin = np.cumsum(sizes) - sizes
        anchor, grams = anchors(data, length)
        owner = np.repeat(np.arange(len(group)), sizes)[: len(anchor)]
        valid = np.arange(len(anchor)) + length <= (begin + sizes)[owner]
        new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])))
        first = np.nonzero(new & valid)[0]
        ends = np.nonzero(valid & np.concatenate((new[1:] | ~valid[1:], [True])))[0]
        own = owner[first]
        shift = np.array([g[1] for g in group], np.int64)[own] - begin[own]
        which = [group[o][0] for o in own.tolist()]
        return pa.RecordBatch.from_arrays([
            pa.array([tids[w] for w in which], pa.binary()), pa.array([copies[w] for w in which], pa.int64()),
            pa.array(grams[anchor[first]].view(np.int64)), *[pa.array(x) for x in (anchor[first] + shift, first + shift, ends + shift)]],
            names=["tid", "copies", "gram", "anchor", "first", "last"])

    group, size = [], 0
    for piece in pieces():
        group.append(piece)
        size += len(piece[2])
        if size >= SCAN_BYTES:
            yield emit(group)
            group, size = [], 0
    if group:
        yield emit(group)


def _cells(tid: bytes, copies: int, text: bytes, runs: list[dict], length: int) -> tuple[list, ...]:
    """The cells of a text's runs: digests of core and whole, first start and number of starts."""
    cores, wholes, firsts, counts = [], [], [], []
    digest = xxhash.xxh3_64_intdigest
    for r in runs:
        p, low, high = r["anchor"], r["first"], r["last"]
        for j in range((p - high) // CELL, (p - low) // CELL + 1):
            a, b = max(low, p - CELL * j - CELL + 1), min(high, p - CELL * j)
            core = p - CELL * j
            cores.append(digest(text[core:core + length - CELL + 1], j))
            wholes.append(digest(text[a:b + length], p - a + 1000))
            firsts.append(a)
            counts.append(b - a + 1)
    return cores, wholes, firsts, counts


def shard_transform(symbols: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Transform of strings given as rows of symbols: for each depth, from the last symbol to the first, the symbols
    that precede the sorted tails; and the sorted order of the rows."""
    order, columns = np.arange(len(symbols)), []
    for t in range(symbols.shape[1] - 1, -1, -1):
        columns.append(symbols[order, t])
        order = order[np.argsort(columns[-1], kind="stable")]
    return columns, order


def merge_transforms(shards: list[tuple[list[np.ndarray], np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The interleave of the shards' sorted rows and, along it, the number of the interval of equal rows.

    Each round reads every shard's transform in its own order, as the interleave so far tells, and deals the interleave
    out by symbol, keeping order. Two neighbours stay in one interval as long as no round has told them apart.
    """
    sizes = [len(order) for _, order in shards]
    source = np.repeat(np.arange(len(shards), dtype=np.int32), sizes)
    interval = np.zeros(len(source), np.int64)
    for t in range(len(shards[0][0])):
        symbol = np.empty(len(source), np.uint64)
        symbol[np.argsort(source, kind="stable")] = np.concatenate([columns[t] for columns, _ in shards])
        by = np.argsort(symbol, kind="stable")
        source, symbol, interval = source[by], symbol[by], interval[by]
        interval = np.cumsum(np.concatenate(([0], (symbol[1:] != symbol[:-1]) | (interval[1:] != interval[:-1]))))
    return source, interval


def repeated_starts(cells: list[bytes], weights: np.ndarray, length: int) -> list[int]:
    """For each cell (consecutive strings of `length` bytes) the bits of the starts whose string is in another cell, or
    whose own cell has a weight above one."""
    data = np.frombuffer(b"".join(cells), np.uint8)
    sizes = np.array([len(c) for c in cells], np.int64)
    starts = sizes - length + 1
    owner = np.repeat(np.arange(len(cells)), starts)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(starts) - starts, starts)
    at = np.repeat(np.cumsum(sizes) - sizes, starts) + offset
    step = -(-length // STEPS)
    sums, inverse = prefix_hashes(data)
    symbols = np.stack([_hash(sums, inverse, at + min(t * step, length - step), step) for t in range(STEPS)], axis=1)
    cuts = range(0, len(at), SHARD)
    shards = [shard_transform(symbols[a:a + SHARD]) for a in cuts]
    source, interval = merge_transforms(shards)
    rows = np.empty(len(at), np.int64)
    rows[np.argsort(source, kind="stable")] = np.concatenate([order + a for (_, order), a in zip(shards, cuts)])
    weight = np.bincount(interval, weights[owner[rows]])
    repeated = np.zeros(len(at), bool)
    repeated[rows] = weight[interval] > 1
    bits = np.zeros(len(cells), np.uint64)
    np.bitwise_or.at(bits, owner[repeated], np.uint64(1) << offset[repeated].astype(np.uint64))
    return bits.view(np.int64).tolist()


def _merge_cells(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by core; the cells of several cores are merged at once."""
    held, last = [], None

    def flush() -> pa.RecordBatch:
        found = repeated_starts([h["bytes"] for h in held], np.array([h["weight"] for h in held], np.float64), length)
        rows = [(h["tid"], h["first"], f) for h, f in zip(held, found) if f and h["weight"] == 1]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()),
                                           pa.array([r[2] for r in rows], pa.int64())], names=["tid", "first", "bits"])

    for batch in slices(batches, 1000):
        for row in batch.to_pylist():
            if len(held) >= MERGE_CELLS and row["core"] != last:
                yield flush()
                held = []
            last = row["core"]
            held.append(row)
    if held:
        yield flush()


def _contexts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of each text's cells; these are several times the text, so few texts are taken at once."""
    for batch in slices(batches):
        rows = [(i["core"], utf8(row["text"])[i["first"]:i["first"] + i["starts"] + length - 1], i["weight"], row["tid"], i["first"])
                for row in batch.to_pylist() for i in row["items"]]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(
            (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64()))], names=["core", "bytes", "weight", "tid", "first"])


def _digest_starts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        for row in batch.to_pylist():
            n = len(row["bytes"]) - length + 1
            yield pa.RecordBatch.from_arrays([
                pa.array([xxhash.xxh3_128_digest(row["bytes"][i:i + length]) for i in range(n)], pa.binary()),
                pa.array([row["tid"]] * n, pa.binary()), pa.array([row["first"]] * n, pa.int64()), pa.array(range(n), pa.int64()),
                pa.array([row["weight"]] * n, pa.int64())], names=["string", "tid", "first", "start", "weight"])


def _by_text(texts: DataFrame, side: DataFrame, run, schema: str) -> DataFrame:
    """`run` over texts together with the list of what `side` has for each."""
    columns = [c for c in side.columns if c != "tid"]
    lists = side.groupBy("tid").agg(F.collect_list(F.struct(*columns)).alias("items"))
    return texts.join(lists, "tid").select("tid", "copies", "text", "items").mapInArrow(run, schema)


def text_key(text) -> F.Column:
    """128 bits that name a whole text; null and empty texts are one."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(tid, spans, kept_sha256): for each different text with removable bytes its maximal removed runs (start, end) in
    bytes and the digest of the others.

    `tid` is `text_key` of the text. Texts that occur more than once are removed as a whole if they have `length` bytes.
    """
    if length < 4 * CELL:
        raise ValueError(f"length must be at least {4 * CELL}")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"llm_texts_{uuid.uuid4().hex}"
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.where(F.octet_length("text") >= length).groupBy(text_key(F.col("text")).alias("tid")).agg(
        F.first("text").alias("text"), F.count("*").alias("copies"))
    with settings(spark, FREED, {"spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}):
        texts.repartition(parts, "tid").write.bucketBy(parts, "tid").saveAsTable(name)
        try:
            return _spans_of(spark.table(name), length)
        finally:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def _spans_of(texts: DataFrame, length: int) -> DataFrame:
    def scan(batches):
        for batch in slices(batches, 500):
            yield from _scan(batch.column("tid").to_pylist(), [utf8(t) for t in batch.column("text").to_pylist()],
                             batch.column("copies").to_pylist(), length)

    def cells(batches):
        for batch in slices(batches):
            columns: list[list] = [[] for _ in range(6)]
            for row in batch.to_pylist():
                found = _cells(row["tid"], row["copies"], utf8(row["text"]), row["items"], length)
                for column, values in zip(columns, found):
                    column.extend(values)
                columns[4].extend([row["tid"]] * len(found[0]))
                columns[5].extend([row["copies"]] * len(found[0]))
            core, whole = (pa.array(np.array(c, np.uint64).view(np.int64)) for c in columns[:2])
            yield pa.RecordBatch.from_arrays([core, whole, pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int32()),
                                              pa.array(columns[4], pa.binary()), pa.array(columns[5], pa.int64())],
                                             names=["core", "whole", "first", "starts", "tid", "copies"])

    def spans(batches):
        for batch in slices(batches):
            tids, out, kept = [], [], []
            for row in batch.to_pylist():
                text = utf8(row["text"])
                begins = np.zeros(len(text) + length + 1, np.int32)
                for i in row["items"]:
                    for k in range(i["bits"].bit_length() if i["bits"] >= 0 else 64):
                        if i["bits"] >> k & 1:
                            begins[i["first"] + k] = 1
                covered = np.cumsum(begins - np.concatenate((np.zeros(length, np.int32), begins[:-length])))[: len(text)] > 0
                edges = np.flatnonzero(np.diff(np.concatenate(([0], covered.astype(np.int8), [0]))))
                tids.append(row["tid"])
                out.append([{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])])
                kept.append(hashlib.sha256(_cut(row["text"], out[-1])).hexdigest())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(tids, pa.binary()), pa.array(out, kind), pa.array(kept, pa.string())],
                                             names=["tid", "spans", "kept_sha256"])

    run_schema = "tid binary, copies long, gram long, anchor long, first long, last long"
    runs = texts.select("tid", "text", "copies").mapInArrow(scan, run_schema)
    # cut off, so that both sides of the join are plain exchanges and a frequent anchor's rows can be split
    twice = cut_lineage(runs.groupBy("gram").agg(F.sum("copies").alias("n")).where("n > 1").select("gram"))
    runs = runs.join(twice, "gram", "left_semi").select("tid", "anchor", "first", "last")
    cell_rows = cut_lineage(_by_text(texts, runs, cells, "core long, whole long, first long, starts int, tid binary, copies long"))

    place = F.struct("tid", "first", "starts")
    kinds = cell_rows.groupBy("core", "whole").agg(F.sum("copies").alias("weight"), F.min(place).alias("place"))
    kinds = cut_lineage(kinds)
    # cores with at least two different wholes, one of them found once: only there is anything left to tell
    open_cores = kinds.groupBy("core").agg(F.count("*").alias("kinds"), F.min("weight").alias("least")).where("kinds > 1 and least = 1")
    left = kinds.join(open_cores.select("core", "kinds"), "core").select("core", "kinds", "weight", "place.*")
    small = left.where(F.col("kinds") <= CORE_LIMIT).drop("kinds")
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    context = "core long, bytes binary, weight long, tid binary, first long"
    merged = _by_text(texts, small, lambda it: _contexts(it, length), context).repartition(parts, "core").sortWithinPartitions("core").mapInArrow(
        lambda it: _merge_cells(it, length), "tid binary, first long, bits long")
    found = merged
    large = left.where(F.col("kinds") > CORE_LIMIT).drop("kinds")
    strings = _by_text(texts, large, lambda it: _contexts(it, length), context).mapInArrow(
        lambda it: _digest_starts(it, length), "string binary, tid binary, first long, start long, weight long")
    again = strings.groupBy("string").agg(F.sum("weight").alias("n")).where("n > 1").select("string")
    settled = strings.where("weight = 1").join(again, "string", "left_semi").groupBy("tid", "first").agg(
        F.bit_or(F.expr("shiftleft(1L, cast(start as int))")).alias("bits"))
    found = found.unionAll(settled)
    # cells that occur as a whole more than once, in texts that occur once
    whole = kinds.where("weight > 1").select("core", "whole")
    equal = cell_rows.where("copies = 1").join(whole, ["core", "whole"], "left_semi").select(
        "tid", "first", F.expr("shiftleft(1L, starts) - 1").alias("bits"))
    found = found.unionAll(equal)
    single = _by_text(texts, found, spans, "tid binary, spans array<struct<start:long,end:long>>, kept_sha256 string")
    copied = texts.where("copies > 1").select("tid", F.array(F.struct(
        F.lit(0).cast("long").alias("start"), F.octet_length("text").cast("long").alias("end"))).alias("spans"),
        F.lit(hashlib.sha256().hexdigest()).alias("kept_sha256"))
    return cut_lineage(single.unionAll(copied))


def _cut(text: str | None, spans: list[dict]) -> bytes:
    data, out, at = utf8(text), [], 0
    for s in spans:
        out.append(data[at:s["start"]])
        at = s["end"]
    return b"".join(out) + data[at:]


def removal_report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per document: `doc_id`, `n_bytes`, `n_removed`, `n_spans`, `kept_sha256` of the remaining bytes, and those as `text`
    (a character that is cut in part goes as a whole; the digest is that of the bytes).

    A byte goes if a string of `length` bytes that covers it also starts anywhere else, in the same document too. Null
    texts are empty. Every row gives a row, repeated ones too (they remove each other if they are long enough); other
    columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(text).alias("tid"),
                       F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha"), text.alias("text"))
    spans = repeated_spans(docs, length)

    def cut(batches):
        for batch in slices(batches):
            texts, spans_ = (batch.column(c).to_pylist() for c in ("text", "spans"))
            kept = [t if not s else _cut(t, s).decode("utf-8", "ignore") for t, s in zip(texts, spans_)]
            fixed = [batch.column(k) for k in range(batch.num_columns - 2)]
            yield pa.RecordBatch.from_arrays([*fixed, pa.array(kept, pa.string())], names=[*batch.schema.names[:-2], "text"])

    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    facts = spans.select("tid", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256", "spans")
    zero = F.lit(0).cast("long")
    report = rows.join(facts, "tid", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"), "text", "spans")
    return report.mapInArrow(cut, report.drop("spans").schema)


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents, all columns as they are, with repeated bytes cut from `text`; those of which nothing but white
    space is left go. A character that is cut in part goes as a whole. `n_chars`, where present, is counted anew."""
    text = F.col("text").cast("string")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_key(text).alias("tid"))
    return _without(row, repeated_spans(docs, length), lambda text, spans: spans)


def word_codes(texts: list[str | None]) -> list[str]:
    """Each text with `CODE` characters, 36 bits of a hash, for each of its words."""
    codes: dict[bytes, str] = {}
    out = []
    for text in texts:
        words = words_of(text)
        for w in set(words).difference(codes):
            codes[w] = base64.b64encode(xxhash.xxh3_64_digest(w))[:CODE].decode()
        out.append("".join(map(codes.__getitem__, words)))
        if len(codes) > 300_000:
            codes.clear()
    return out


def _byte_spans(text: str | None, spans: list[dict]) -> list[dict]:
    """Spans of coded words as spans of the text's bytes, from the first whole word to the last."""
    places = [m.span() for m in _WORD.finditer(utf8(text).translate(LOWER))]
    whole = [(-(-s["start"] // CODE), s["end"] // CODE) for s in spans]
    return [{"start": places[a][0], "end": places[b - 1][1]} for a, b in whole if a < b]


def without_repeated_words(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The documents without the passages of `words` words and more that occur more than once, in the same document too.

    Words are those of `words_of`, so white space and the case of A to Z make no difference; the white space around a passage
    stays. `words` must be 32 or more. Otherwise as `without_repeats`.
    """
    def run(batches):
        for batch in slices(batches, 1000):
            coded = word_codes(batch.column("row").field("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(coded, pa.string())], names=["row", "coded"])

    row = docs.withColumn("text", F.col("text").cast("string")).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    coded = row.mapInArrow(run, row.select("row").schema.add("coded", "string"))
    spans = repeated_spans(coded.select(F.col("coded").alias("text")), words * CODE)
    return _without(coded.select("row", text_key(F.col("coded")).alias("tid")), spans, _byte_spans)


def _without(row: DataFrame, spans: DataFrame, in_bytes) -> DataFrame:
    """The documents `row` without the spans of their `tid`; `in_bytes(text, spans)` gives them in bytes of the text."""
    spans, columns = spans.select("tid", "spans"), row.schema["row"].dataType
    touched = row.join(spans, "tid", "left").select("row", "spans")

    def cut(batches):
        for batch in slices(batches):
            texts, spans_ = batch.column("row").field("text").to_pylist(), batch.column("spans").to_pylist()
            new = [t if not s else _cut(t, in_bytes(t, s)).decode("utf-8", "ignore") for t, s in zip(texts, spans_)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(new, pa.string()), pa.array([bool(s) for s in spans_])],
                                             names=["row", "new_text", "changed"])

    schema = touched.drop("spans").schema.add("new_text", "string").add("changed", "boolean")
    done = touched.mapInArrow(cut, schema).where("not changed or trim(new_text) <> ''")
    new = {"text": F.col("new_text")} | ({"n_chars": F.when(F.col("changed"), F.length("new_text")).otherwise(F.col("row.n_chars")).cast(
        columns["n_chars"].dataType)} if "n_chars" in columns.names else {})
    return done.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns.names])
