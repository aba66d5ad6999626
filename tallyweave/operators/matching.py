"""Keyword lookups and routing. Lookup lists of fixed size are part of the expression: no join, and every text is read
once where it lies. A lookup table of any length is laid out as files of the shared folder, which all workers map; the pieces of
texts that a filter of its keywords lets through are looked up there, so neither texts nor hits are shuffled."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator, Mapping, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, StructField, StructType

from tallyweave import vocab
from tallyweave.functions.text import contains_any, let
from tallyweave.scale import _row_bytes, small
from tallyweave.session import mounted, work_path

#: Bytes of the filter of a lookup table's keywords at most; about 16 bits a keyword below that.
LOOKUP_BYTES = 64 << 20
#: Bits of the filter that are put together as one row.
SEGMENT = 1 << 20
#: Bytes of entries, about, in a file of a lookup table; bytes of texts that are looked up at once; hits that leave a task at once.
PART_BYTES, TEXT_BYTES, HITS = 128 << 20, 256 << 10, 1 << 16

_RNG = np.random.default_rng(42)
_BYTES = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_ODD = _RNG.integers(0, 1 << 64, 4, dtype=np.uint64) | np.uint64(1)


def _text(c) -> Column:
    return F.lower(F.col(c) if isinstance(c, str) else c)


def _entry(pos: int, row: Mapping) -> Column:
    return F.struct(
        F.lit(pos).alias("pos"), F.lit(row["covered"]).alias("covered"), F.lit(row["coverage"]).alias("coverage"),
        F.lit(row["approval"]).cast("int").alias("approval"), F.lit(row["referral"]).cast("boolean").alias("referral"),
        F.lit(row["annual_limit"]).cast("int").alias("annual_limit"), F.lit(row["category"]).alias("category"),
        F.lit(row["notes"]).alias("notes"),
    )


def matching_entries(text, lookup: Sequence[Mapping] = tuple(vocab.COVERAGE_LOOKUP)) -> Column:
    """Lookup entries with any keyword as a literal substring of the text, in lookup order."""
    return let(_text(text), lambda low: F.array_compact(F.array(*[
        F.when(contains_any(low, row["keywords"]), _entry(i, row)) for i, row in enumerate(lookup)])))


def match_keywords(df: DataFrame, text: str, lookup: Sequence[Mapping] = tuple(vocab.COVERAGE_LOOKUP)) -> DataFrame:
    """One row per (text, matching entry)."""
    return df.withColumn("entry", F.explode(matching_entries(text, lookup)))


def _lengths(sizes: Iterable[int]) -> dict[int, list[int]]:
    """Byte lengths of keywords by the power of two that each of them holds."""
    found: dict[int, list[int]] = {}
    for size in sorted(sizes):
        found.setdefault(1 << size.bit_length() - 1, []).append(size)
    return found


def _mixed(x: np.ndarray, y, salt: int) -> np.ndarray:
    x = (x ^ x >> np.uint64(29)) * _ODD[0] + y + np.uint64(salt) * _ODD[1]
    return x ^ x >> np.uint64(32)


def _rolled(data: np.ndarray, lengths: dict[int, list[int]]) -> Iterator[tuple[int, np.ndarray]]:
    """For each power of two in `lengths` a hash of the so many bytes from every place on."""
    hashes, width = _BYTES[data], 1
    while len(hashes) and width <= max(lengths, default=0):
        if width in lengths:
            yield width, hashes
        hashes, width = _mixed(hashes[:-width], hashes[width:], width), 2 * width


def _known(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether both bits of each hash are set."""
    low = hashes & np.uint64(8 * len(bits) - 1)
    found = bits[low >> np.uint64(3)] >> (low & np.uint64(7)).astype(np.uint8) & 1 == 1
    at = np.flatnonzero(found)
    high = (hashes[at] * _ODD[2]) >> np.uint64(32) & np.uint64(8 * len(bits) - 1)
    found[at] = bits[high >> np.uint64(3)] >> (high & np.uint64(7)).astype(np.uint8) & 1 == 1
    return found


def _slices(column: pa.Array, size: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Pieces (start, end, bytes, ends) of a column of texts or bytes of about `size` bytes, one row at least."""
    column = column.cast(pa.large_binary())
    _, starts, data = column.buffers()
    starts = np.frombuffer(starts, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(starts, starts[at] + size, "right")) - 1)
        yield at, end, data[starts[at]:starts[end]], starts[at + 1:end + 1] - starts[at]
        at = end


def _hashed(words: pa.Array, lengths: dict[int, list[int]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For some of the words at a time (their places) the hashes of their starts and of the whole. An empty word has none."""
    for at, _, data, ends in _slices(words):
        sizes = np.diff(ends, prepend=0)
        for width, hashes in _rolled(data, lengths):
            mine = np.flatnonzero((sizes >= width) & (sizes < 2 * width))
            last, length = ends[mine], sizes[mine]
            start = hashes[last - length]
            yield at + mine, start, _mixed(start, hashes[last - width], 0) + length.astype(np.uint64) * _ODD[3]


def _bits(batches: Iterator[pa.RecordBatch], lengths: dict[int, list[int]], size: int) -> Iterator[pa.RecordBatch]:
    """The bits of a filter of `size` bytes that the keywords set: those of the start and those of the whole."""
    for batch in batches:
        for _, start, whole in _hashed(batch.column("word"), lengths):
            both = np.concatenate([start, whole])
            places = np.unique(np.concatenate([both, (both * _ODD[2]) >> np.uint64(32)]) & np.uint64(8 * size - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(places // SEGMENT), pa.array(places % SEGMENT)], names=["segment", "bit"])


def _segment(rows: pa.Table) -> pa.Table:
    bits = np.zeros(SEGMENT, np.uint8)
    bits[rows.column("bit").to_numpy()] = 1
    return pa.table({"segment": rows.column("segment").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})


def _passing(data: np.ndarray, ends: np.ndarray, bits: np.ndarray, lengths: dict[int, list[int]]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """The pieces that the filter lets through, by length: their places, the rows they lie in, and their hashes."""
    for width, hashes in _rolled(data, lengths):
        start = np.flatnonzero(_known(bits, hashes))
        owner = np.searchsorted(ends, start, "right")
        for length in lengths[width]:
            fits = start + length <= ends[owner]
            first, mine = start[fits], owner[fits]
            whole = _mixed(hashes[first], hashes[first + length - width], 0) + np.uint64(length) * _ODD[3]
            hit = _known(bits, whole)
            yield length, first[hit], mine[hit], whole[hit]


def _found_in(batches: Iterator[pa.RecordBatch], bits: np.ndarray, lengths: dict[int, list[int]], empty: bool) -> Iterator[pa.RecordBatch]:
    """The batches with `__words`, the different pieces of `__low` that the filter lets through."""
    for batch in batches:
        low, rest = batch.column("__low"), [c for c in batch.schema.names if c != "__low"]
        for at, end, data, ends in _slices(low):
            found = [{b""} if empty and there else set() for there in low.slice(at, end - at).is_valid().to_pylist()]
            raw = data.tobytes()
            for length, first, mine, _ in _passing(data, ends, bits, lengths):
                for i, row in zip(first.tolist(), mine.tolist()):
                    found[row].add(raw[i:i + length])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).slice(at, end - at) for c in rest), pa.array([sorted(f) for f in found], pa.list_(pa.binary()))],
                names=[*rest, "__words"])


def _filter_of(terms: DataFrame, limit: int) -> tuple[np.ndarray, dict[int, list[int]], bool]:
    """A filter of the keywords (`word`) of `limit` bytes at most, their lengths, and whether one is empty."""
    sizes = {r[0]: r[1] for r in terms.groupBy(F.octet_length("word")).agg(F.count(F.lit(1))).collect()}
    lengths, room = _lengths(size for size in sizes if size), max(limit, 1024)
    size = min(1 << max(10, (2 * sum(sizes.values())).bit_length()), 1 << room.bit_length() - 1)
    bits = np.zeros(max(size, SEGMENT // 8), np.uint8)
    segments = terms.select("word").mapInArrow(lambda it: _bits(it, lengths, size), "segment long, bit long").groupBy(
        "segment").applyInArrow(_segment, "segment long, bits binary")
    for row in segments.collect():
        bits[row["segment"] * SEGMENT // 8:(row["segment"] + 1) * SEGMENT // 8] = np.frombuffer(row["bits"], np.uint8)
    return bits[:size], lengths, 0 in sizes


# --- lookup tables in mapped files --------------------------------------------------------------------------------

def _save(folder: str, name: str, batch: pa.RecordBatch) -> None:
    """A file of a mounted folder; a task that runs again puts the same one in its place."""
    os.makedirs(folder, exist_ok=True)
    new = os.path.join(folder, f".{name}-{uuid.uuid4().hex}")
    try:
        with pa.OSFile(new, "wb") as file, pa.ipc.new_file(file, batch.schema) as out:
            out.write_batch(batch)
        os.replace(new, os.path.join(folder, name))
    except BaseException:
        if os.path.exists(new):
            os.remove(new)
        raise


def _load(folder: str, name: str) -> pa.RecordBatch:
    return pa.ipc.open_file(pa.memory_map(os.path.join(folder, name))).get_batch(0)


def _eights(data: pa.Buffer | np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as numbers."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,))


def _eighth(length: int, k: int) -> np.uint64:
    """What belongs to a word of `length` bytes in its eight bytes from 8 k on."""
    return np.uint64((1 << 8 * min(8, length - 8 * k)) - 1)


def _part_of(hashes, parts: int):
    return ((hashes >> np.uint64(40)) * np.uint64(parts)) >> np.uint64(24)


def _entries(batches: Iterator[pa.RecordBatch], folder: str, parts: int) -> Iterator[pa.RecordBatch]:
    """Writes a task's entries as a file; of each keyword its part, hash, bytes, and where its entry is: file and row."""
    table = pa.Table.from_batches(held) if (held := list(batches)) else None
    if not table:
        return
    number, table = TaskContext.get().partitionId(), table.combine_chunks()
    _save(folder, f"entries-{number:08d}", pa.record_batch([table.column("entry").chunk(0)], ["entry"]))
    lists = table.column("__words").chunk(0)
    words, rows = lists.flatten(), pc.list_parent_indices(lists).to_numpy().astype(np.int64)
    hashes = np.zeros(len(words), np.uint64)
    for at, _, whole in _hashed(words, _lengths(size for size in pc.unique(pc.binary_length(words)).to_pylist() if size)):
        hashes[at] = whole
    for at in range(0, len(words), 100_000):
        mine = hashes[at:at + 100_000]
        yield pa.RecordBatch.from_arrays([
            pa.array(_part_of(mine, parts).astype(np.int32)), pa.array(mine.view(np.int64)), words.slice(at, 100_000),
            pa.array(rows[at:at + 100_000] | number << 32)], names=["part", "hash", "word", "place"])


def _keywords(rows: pa.Table, folder: str) -> pa.Table:
    """Writes a part of the keywords, in order of their hashes, each with the places of its entries. Words end in eight zero
    bytes; `most` is the number of words that share a hash."""
    rows = rows.set_column(rows.schema.get_field_index("hash"), "hash", rows.column("hash").combine_chunks().view(pa.uint64()))
    number = rows.column("part")[0].as_py()
    rows = rows.sort_by([("hash", "ascending"), ("word", "ascending"), ("place", "ascending")]).combine_chunks()
    word, hashes = rows.column("word").chunk(0).cast(pa.large_binary()), rows.column("hash").to_numpy()
    new = np.ones(len(word), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | pc.not_equal(word[1:], word[:-1]).to_numpy(zero_copy_only=False)
    first = np.flatnonzero(new)
    word, hashes = word.take(pa.array(first)), hashes[first]
    most = np.diff(np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])), append=len(hashes)).max()
    padded = pc.binary_join_element_wise(word, pa.scalar(bytes(8), pa.large_binary()), pa.scalar(b"", pa.large_binary()))
    places = pa.ListArray.from_arrays(pa.array(np.append(first, len(new)), pa.int32()), rows.column("place").chunk(0))
    batch = pa.record_batch([pa.array(hashes), pc.binary_length(word).cast(pa.int32()), padded, places], ["hash", "size", "word", "places"])
    _save(folder, f"keywords-{number:08d}", batch.replace_schema_metadata({"most": str(most)}))
    return pa.table({"part": pa.array([number], pa.int32())})


class _Table:
    """A lookup table in the files of a mounted folder. What is read of them stays outside the worker's own memory."""

    def __init__(self, folder: str, parts: int):
        names = os.listdir(folder) if os.path.isdir(folder) else []
        self.parts, self.most = parts, 1
        self.entries = {int(n[-8:]): _load(folder, n).column("entry") for n in names if n.startswith("entries-")}
        self.keywords: dict[int, tuple] = {}
        at = 0
        for name in sorted(n for n in names if n.startswith("keywords-")):
            batch = _load(folder, name)
            word, places = batch.column("word"), batch.column("places")
            self.most = max(self.most, int(batch.schema.metadata[b"most"]))
            self.keywords[int(name[-8:])] = (
                at, batch.column("hash").to_numpy(), batch.column("size").to_numpy(),
                np.frombuffer(word.buffers()[1], np.int64)[:len(word) + 1], _eights(word.buffers()[2]),
                places.offsets.to_numpy(), places.values.to_numpy())
            at += batch.num_rows
        self.size = at

    def find(self, text: np.ndarray, length: int, first: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pieces are keywords, and which ones. Their bytes are compared, so an equal hash alone does not count."""
        different, piece = np.unique(hashes, return_inverse=True)
        cuts = np.searchsorted(_part_of(different, self.parts), np.arange(self.parts + 1, dtype=np.uint64))
        eights = range(-(-length // 8))
        pieces, found = [], []
        for k in range(self.most):
            keyword = np.full(len(different), -1)
            told = np.zeros((len(eights), len(different)), np.uint64)
            for part, (base, known, size, offsets, words, _, _) in self.keywords.items():
                mine = different[cuts[part]:cuts[part + 1]]
                at = np.searchsorted(known, mine) + k
                near = np.minimum(at, len(known) - 1)
                fits = np.flatnonzero((at == near) & (known[near] == mine) & (size[near] == length))
                near, fits = near[fits], fits + cuts[part]
                keyword[fits] = near + base
                for i in eights:
                    told[i][fits] = words[offsets[near] + 8 * i] & _eighth(length, i)
            same = keyword[piece] >= 0
            for i in eights:
                same &= (text[first + 8 * i] & _eighth(length, i)) == told[i][piece]
            at = np.flatnonzero(same)
            pieces.append(at), found.append(keyword[piece[at]])
        return np.concatenate(pieces), np.concatenate(found)

    def places(self, owner: np.ndarray, keyword: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows with the places of the entries of their keywords."""
        owners, out = [], []
        for base, known, _, _, _, starts, places in self.keywords.values():
            mine = (keyword >= base) & (keyword < base + len(known))
            at = keyword[mine] - base
            first, count = starts[at], starts[at + 1] - starts[at]
            owners.append(np.repeat(owner[mine], count))
            out.append(places[np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())])
        return (np.concatenate(owners), np.concatenate(out)) if out else (owner[:0], keyword[:0])


@lru_cache(maxsize=2)
def _table(folder: str, parts: int) -> _Table:
    return _Table(folder, parts)


def _looked_up(batches: Iterator[pa.RecordBatch], table: _Table, bits: np.ndarray, lengths: dict[int, list[int]], empty: bool,
               repeats: bool) -> Iterator[pa.RecordBatch]:
    """The batches with `__entries`, entries that have a keyword in `__low`; a row comes several times if they are many.
    `repeats` tells whether an entry can have several keywords."""
    for batch in batches:
        low, rest = batch.column("__low"), batch.drop_columns(["__low"])
        for at, end, data, ends in _slices(low, TEXT_BYTES):
            text = _eights(np.concatenate([data, np.zeros(15, np.uint8)]))
            hits = []
            if empty:
                there = np.flatnonzero(low.slice(at, end - at).is_valid().to_numpy(zero_copy_only=False))
                which, keyword = table.find(text, 0, np.zeros(len(there), np.int64), np.zeros(len(there), np.uint64))
                hits.append(there[which] * table.size + keyword)
            for length, first, owner, whole in _passing(data, ends, bits, lengths):
                which, keyword = table.find(text, length, first, whole)
                hits.append(owner[which] * table.size + keyword)
            if not hits or not sum(map(len, hits)):
                continue
            hits = np.sort(np.concatenate(hits))  # several times as fast as np.unique
            owner, place = table.places(*np.divmod(hits[np.append(True, hits[1:] != hits[:-1])], table.size))
            # by file, then by row of the batch
            order = np.lexsort((place, owner, place >> 32) if repeats else (owner, place >> 32))
            owner, place = owner[order], place[order]
            if repeats:
                new = np.append(True, (owner[1:] != owner[:-1]) | (place[1:] != place[:-1]))
                owner, place = owner[new], place[new]
            file, row = place >> 32, place & 0xFFFFFFFF
            cuts = np.flatnonzero(np.diff(file, prepend=-1))
            for start, stop in zip(cuts, [*cuts[1:], len(file)]):
                for i in range(start, stop, HITS):
                    some = slice(i, min(i + HITS, stop))
                    first = np.flatnonzero(np.diff(owner[some], prepend=-1))
                    lists = pa.ListArray.from_arrays(
                        pa.array(np.append(first, some.stop - i), pa.int32()), table.entries[int(file[start])].take(pa.array(row[some])))
                    yield pa.RecordBatch.from_arrays(
                        [*rest.take(pa.array(at + owner[some][first])).columns, lists], names=[*rest.schema.names, "__entries"])


def _laid_out(named: DataFrame, folder: str, parts: int) -> None:
    """The files of a lookup table. Its rows lie in stored files, so a task that runs again finds them in the same order."""
    schema = "part int, hash long, word binary, place long"
    words = named.select("__words", "entry").coalesce(parts).mapInArrow(lambda it: _entries(it, folder, parts), schema)
    words.groupBy("part").applyInArrow(lambda rows: _keywords(rows, folder), "part int").write.format("noop").mode("overwrite").save()


def match_keyword_table(df: DataFrame, text: str, lookup: DataFrame, keywords: str = "keywords",
                        key: str = "pos", block_bytes: int = LOOKUP_BYTES) -> DataFrame:
    """One row per row of `df` and row of `lookup` (as struct `entry`) any of whose keywords is a literal substring of the
    text in lower case.

    The lookup is a table of any length with unique whole numbers in `key`. Each text is read once; the pieces of it that pass a
    filter of all keywords are looked up, so nothing but the filter, of `block_bytes` at most, is sent to the tasks,
    and what it lets through wrongly is not found. The lookup lies in files of the shared folder, which the workers map; only
    where that folder is not mounted are pieces and keywords joined, which shuffles all pieces of a large lookup.
    A null text or keyword matches nothing, an empty keyword every text.
    Where many entries have the same keywords, group them first: a text then gives one row per group.
    """
    spark = df.sparkSession
    named = lookup.select(F.col(key).cast("long").alias("__entry"), F.array_distinct(F.array_compact(keywords)).cast("array<binary>").alias("__words"), F.struct("*").alias("entry"))
    path = work_path(spark, "lookup")
    named.write.option("parquet.block.size", 16 << 20).parquet(path)
    named, folder = spark.read.schema(named.schema).parquet(path), mounted(spark, f"{path}-files")
    words = named.select(F.explode("__words").alias("word")).distinct()
    bits, lengths, empty = _filter_of(words, block_bytes)
    shared = spark.sparkContext.broadcast(bits)
    most, size = named.agg(F.max(F.size("__words")), F.sum(_row_bytes(named.select("entry")))).first()
    if folder:
        parts = 1 + (size or 0) // PART_BYTES
        _laid_out(named, folder, parts)
        low = df.withColumn("__low", _text(text))
        schema = StructType([f for f in low.schema.fields if f.name != "__low"] + [StructField("__entries", ArrayType(named.schema["entry"].dataType))])
        repeats = (most or 0) > 1
        hits = low.mapInArrow(lambda batches: _looked_up(batches, _table(folder, parts), shared.value, lengths, empty, repeats), schema)
        return hits.withColumn("entry", F.explode("__entries")).drop("__entries")
    low = df.withColumn("__row", F.monotonically_increasing_id()).withColumn("__low", _text(text))
    schema = StructType([f for f in low.schema.fields if f.name != "__low"] + [StructField("__words", ArrayType(BinaryType()))])
    hits = low.mapInArrow(lambda batches: _found_in(batches, shared.value, lengths, empty), schema)
    pairs = hits.withColumn("__word", F.explode("__words")).drop("__words")
    if (most or 0) <= 1:
        terms = named.select(F.explode("__words").alias("__word"), "entry")
        return pairs.join(small(terms, rows=1_000_000), "__word").drop("__word", "__row")
    terms = named.select("__entry", F.explode("__words").alias("__word"))
    # several keywords of an entry in one text are one hit
    once = pairs.join(small(terms), "__word").drop("__word").dropDuplicates(["__row", "__entry"])
    return once.join(small(named.select("__entry", "entry")), "__entry").drop("__entry", "__row")


def category_rates(lookup: Sequence[Mapping]) -> dict[str, float]:
    found: dict[str, list[float]] = {}
    for row in lookup:
        found.setdefault(row["category"], []).append(row["approval"] or 0)
    return {category: sum(rates) / len(rates) for category, rates in found.items()}


def approval_rate_by_category(lookup: DataFrame) -> DataFrame:
    """Mean approval per category; a missing approval counts as 0."""
    return lookup.groupBy("category").agg(F.avg(F.coalesce("approval", F.lit(0))).alias("approval_rate"))


def best_coverage(text, lookup: Sequence[Mapping] = tuple(vocab.COVERAGE_LOOKUP)) -> Column:
    """The matching entry with the highest mean of coverage and approval, the first of equals; NULL
    without a match."""
    ranked = F.transform(matching_entries(text, lookup), lambda e: F.struct(
        ((e["coverage"] + F.coalesce(e["approval"], F.lit(0))) / 2).alias("score"), (-e["pos"]).alias("before"),
        e.alias("entry")))
    return F.array_max(ranked)["entry"]


def coverage(text, lookup: Sequence[Mapping] = tuple(vocab.COVERAGE_LOOKUP)) -> Column:
    """The full answer: covered, estimate, notes, category approval, pre-authorisation."""
    rates = F.create_map(*[F.lit(v) for pair in category_rates(lookup).items() for v in pair])
    miss = F.struct(
        F.lit(False).alias("covered"), F.lit(0).alias("coverage"), F.lit(vocab.NO_COVERAGE_NOTE).alias("notes"),
        F.lit(0.0).alias("approval_rate"), F.lit(None).cast("boolean").alias("requires_preauth"),
    )

    def answer(best: Column) -> Column:
        referral = F.coalesce(best["referral"], F.lit(False))
        hit = F.struct(
            best["covered"].alias("covered"), best["coverage"].alias("coverage"),
            F.concat(best["notes"], F.when(referral, vocab.REFERRAL_SUFFIX).otherwise("")).alias("notes"),
            F.try_element_at(rates, best["category"]).alias("approval_rate"),
            ((best["category"] == vocab.PREAUTH_CATEGORY) | referral).alias("requires_preauth"),
        )
        return F.when(best.isNull(), miss).otherwise(hit)

    return let(best_coverage(text, lookup), answer)


def routing_score(low: Column, role: str, primary: bool, keywords: Mapping = vocab.ROUTING_KEYWORDS) -> Column:
    """Points of one role for a text in lower case: the primary role gains for any word of the boost category, any role for one of
    its own words in the text, and for each keyword of a category that is part of a role word. All tests
    are literal substrings."""
    words = role.lower().split(" ")
    score = F.lit(0)
    if primary:
        score = score + F.when(contains_any(low, keywords[vocab.PRIMARY_CATEGORY][1]), vocab.PRIMARY_BOOST).otherwise(0)
    score = score + F.when(contains_any(low, words), vocab.ROLE_BOOST).otherwise(0)
    for category, (weight, terms) in keywords.items():
        if any(category in word for word in words):
            for term in terms:
                score = score + F.when(F.contains(low, F.lit(term)), weight).otherwise(0)
    return score


def routing_scores(text, roles: Sequence[str] = tuple(vocab.ROLES), keywords: Mapping = vocab.ROUTING_KEYWORDS) -> Column:
    """array of (role, pos, score) in role order; the first role is the primary one."""
    return let(_text(text), lambda low: F.array(*[
        F.struct(F.lit(role).alias("role"), F.lit(i).alias("pos"), routing_score(low, role, i == 0, keywords).alias("score"))
        for i, role in enumerate(roles)]))


def route_topk(text, k, roles: Sequence[str] = tuple(vocab.ROLES), keywords: Mapping = vocab.ROUTING_KEYWORDS) -> Column:
    """The k best roles in order, equal scores in role order; k is a number or a column."""
    ordered = F.array_sort(F.transform(routing_scores(text, roles, keywords), lambda r: F.struct(
        (-r["score"]).alias("minus"), r["pos"].alias("pos"), r["role"].alias("role"), r["score"].alias("score"))))
    return F.transform(F.slice(ordered, 1, k), lambda r: F.struct(r["role"], r["pos"], r["score"]))
