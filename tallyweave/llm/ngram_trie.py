"""Scoring texts with an Elias-Fano n-gram trie.

Level 1 holds the hashes of all words in order, so that a word's id is its rank. Each further level holds, for every
entry of the level above, the ids of the words seen after it, as one monotone sequence (context times vocabulary plus
word) in Elias-Fano form, with one byte for each smoothed probability, one for each context's back-off weight, and
monotone pointers to where a context's words begin. A lookup seeks a context and word among the few entries with the same high bits.

Counting runs over all training texts in Spark: tasks send sorted blocks of keys and counts, cut by ranges of keys, and
one task merges each range. Where the shared folder is mounted, the task that ends a range writes its part of the level there,
in the form that the Python workers of all executors map into memory. Otherwise the levels are written as tables, from which
each executor turns them, one range at a time, into one file a level. Columns of numbers are written as compressed byte
planes, ascending ones as differences.
"""

from __future__ import annotations

import fcntl
import json
import mmap
import os
import sys
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyweave.llm.common import FREED, fold, released, words_of
from tallyweave.session import work_path
from tallyweave.streaming.events import settings

ORDER = 3
#: n-grams of two words and more that occur less often are left to the lower order: none.
MIN_COUNT = 1
#: What every token gets on top of its count, in the base and in level 1.
ADDED = 0.1
#: Neither can be a word, as words have no white space.
END, BEGIN = b"\n", b" "
#: Keys that a task gathers before it sends a block (half as many of words).
BLOCK_KEYS = 3_000_000
#: A byte stands for a probability or weight of 10 ** (-byte / 30).
STEP = 30.0
#: Bins of log2(relative frequency / lower order) over which interpolation weights are fitted.
BINS, BIN_WIDTH, BUCKETS = 160, 0.25, 40


#: Entries (a multiple of 8) whose low bits are packed at once.
LOW_BLOCK = 1 << 17


class EliasFano:
    """A non-decreasing sequence of integers: low bits as they are, high bits in unary."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)
        self.bits = int(self.shape[0])
        self.size = int(self.shape[1])

    @staticmethod
    def encode(values: np.ndarray) -> dict[str, np.ndarray]:
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, min(32, (max(1, top) // max(1, n)).bit_length() - 1))
        high = (values >> np.uint64(bits)).astype(np.int64)
        marks = np.zeros((n + int(high[-1]) + 2 if n else 2) + 63 & ~63, np.uint8)
        marks[high + np.arange(n)] = 1
        words = np.packbits(marks, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(words).astype(np.int64)
        low = (values & np.uint64((1 << bits) - 1)).astype(np.uint64)
        lows = [np.packbits(np.unpackbits(low[at:at + LOW_BLOCK].view(np.uint8).reshape(-1, 8), axis=1, count=bits, bitorder="little"), bitorder="little")
                for at in range(0, n if bits else 0, LOW_BLOCK)]
        tail = np.zeros(16 - sum(map(len, lows)) % 8, np.uint8)
        before = np.cumsum(ones) - ones
        return {"shape": np.array([bits, n], np.int64), "lows": np.concatenate([*lows, tail]).view(np.uint64), "words": words,
                "ones": before.astype(np.uint32), "zeros": (64 * np.arange(len(words)) - before).astype(np.uint32)}

    def low(self, at: np.ndarray) -> np.ndarray:
        first = at * self.bits
        word, shift = first >> 6, (first & 63).astype(np.uint64)
        # shifted in two steps, as 64 at once is not defined
        out = self.lows[word] >> shift | self.lows[word + 1] << (np.uint64(63) - shift) << np.uint64(1)
        return (out & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def _select(self, k: np.ndarray, of_ones: bool) -> np.ndarray:
        """Position of the k-th one (or zero) in the high bits."""
        before = self.ones if of_ones else self.zeros
        word = np.searchsorted(before, k.astype(np.uint32), side="right") - 1
        bits = self.words[word] if of_ones else ~self.words[word]
        rest = (k - before[word]).astype(np.uint64)
        # all eight bytes of a word at once: their counts of ones, each with those of the bytes before it
        upto = bits - (bits >> np.uint64(1) & PAIRS)
        upto = (upto & NIBBLES) + (upto >> np.uint64(2) & NIBBLES)
        upto = (upto + (upto >> np.uint64(4)) & HALVES) * ONE_A_BYTE
        byte = np.bitwise_count((rest * ONE_A_BYTE | TOP_OF_BYTES) - upto & TOP_OF_BYTES)
        shift = byte.astype(np.uint64) << np.uint64(3)
        rest -= (upto << np.uint64(8)) >> shift & np.uint64(255)
        return 64 * word + 8 * byte.astype(np.int64) + SELECT_IN_BYTE[(bits >> shift & np.uint64(255)).view(np.int64), rest.view(np.int64)]

    def access(self, at: np.ndarray) -> np.ndarray:
        return (self._select(at, True) - at) << self.bits | self.low(at)

    def successor(self, wanted: np.ndarray) -> np.ndarray:
        """Position of the first value that is not below each wanted one (the size, if there is none)."""
        if not self.size:
            return np.zeros(len(wanted), np.int64)
        last = int(self.access(np.array([self.size - 1]))[0])
        over = wanted > last
        capped = np.where(over, last, wanted)
        high, low = capped >> self.bits, capped & (1 << self.bits) - 1
        from_ = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) - np.maximum(high - 1, 0), 0)
        upto = self._select(high, False) - high
        active = np.nonzero(from_ < upto)[0]
        while len(active):
            mid = (from_[active] + upto[active]) >> 1
            less = self.low(mid) < low[active]
            from_[active[less]] = mid[less] + 1
            upto[active[~less]] = mid[~less]
            active = active[from_[active] < upto[active]]
        return np.where(over, self.size, from_)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Position of each wanted value in a sequence without repeats, -1 where it has none."""
        out = np.full(len(wanted), -1, np.int64)
        if not self.size:
            return out
        inside = np.nonzero(wanted <= int(self.access(np.array([self.size - 1]))[0]))[0]
        high, low = wanted[inside] >> self.bits, wanted[inside] & (1 << self.bits) - 1
        # values with the same high bits are a run of ones behind as many zeros
        begin = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) + 1, 0)
        word, shift = begin >> 6, (begin & 63).astype(np.uint64)
        window = self.words[word] >> shift | self.words[np.minimum(word + 1, len(self.words) - 1)] << (np.uint64(63) - shift) << np.uint64(1)
        run = np.bitwise_count(window & ~(window + np.uint64(1))).astype(np.int64)
        longer = np.nonzero(run == 64)[0]
        run[longer] = self._select(high[longer], False) - begin[longer]
        some = np.nonzero(run)[0]
        inside, low, from_ = inside[some], low[some], begin[some] - high[some]
        upto = from_ + run[some]
        active = np.nonzero(upto - from_ > 1)[0]
        while len(active):
            mid = (from_[active] + upto[active]) >> 1
            less = self.low(mid) <= low[active]
            from_[active[less]] = mid[less]
            upto[active[~less]] = mid[~less]
            active = active[upto[active] - from_[active] > 1]
        same = self.low(from_) == low
        out[inside[same]] = from_[same]
        return out


#: Masks for counting the ones of all bytes of a 64-bit word.
PAIRS, NIBBLES, HALVES, ONE_A_BYTE, TOP_OF_BYTES = (np.uint64(int(x * 8, 16)) for x in ("55", "33", "0f", "01", "80"))
SELECT_IN_BYTE = np.zeros((256, 8), np.int64)
for _byte in range(256):
    for _k, _bit in enumerate(b for b in range(8) if _byte >> b & 1):
        SELECT_IN_BYTE[_byte, _k] = _bit


def packed(values: np.ndarray, ascending: bool = False) -> bytes:
    """Numbers below 2 ** 64 in bytes; `ascending` ones take the room of their differences."""
    values = values.astype(np.uint64)
    rest = np.diff(values) if ascending else values
    width = max(1, -(-int(rest.max()).bit_length() // 8)) if len(rest) else 1
    planes = np.ascontiguousarray(rest.view(np.uint8).reshape(-1, 8)[:, :width].T)
    head = np.array([len(values), values[0] if ascending and len(values) else 0, width, ascending], np.uint64)
    return head.tobytes() + (pa.compress(planes.tobytes(), "zstd", asbytes=True) if len(rest) else b"")


def unpacked(data: bytes) -> np.ndarray:
    n, first, width, ascending = (int(x) for x in np.frombuffer(data, np.uint64, 4))
    rest = max(0, n - 1) if ascending else n
    planes = np.zeros((rest, 8), np.uint8)
    if rest:
        planes[:, :width] = np.frombuffer(pa.decompress(data[32:], rest * width, "zstd", asbytes=True), np.uint8).reshape(width, rest).T
    values = planes.view(np.uint64).ravel()
    if not ascending or not n:
        return values
    return np.cumsum(np.concatenate((np.array([first], np.uint64), values)), dtype=np.uint64)


def _placed(arrays: dict[str, np.ndarray], file, at: int) -> tuple[dict[str, tuple], int]:
    """Where in `file` each array has been written, from `at` on, and the place behind them."""
    places = {}
    for key, a in arrays.items():
        places[key] = (a.dtype.str, at, len(a))
        file.seek(at)
        a.tofile(file)
        at += -(-a.nbytes // 64) * 64
    file.truncate(max(1, at))
    return places, at


def write_part(folder: str, part: int, arrays: dict[str, np.ndarray]) -> None:
    """A part of a level as a file of a mounted folder; a task that runs again puts the same one in its place."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{part:08d}")
    new = f"{path}.{uuid.uuid4().hex}"
    try:
        with open(new, "wb") as file:
            places, _ = _placed(arrays, file, 0)
        os.replace(new, path + ".bin")
        with open(new, "w") as file:
            json.dump(places, file)
        os.replace(new, path + ".json")
    except BaseException:
        if os.path.exists(new):
            os.remove(new)
        raise


def _folder_parts(folder: str) -> list[dict[str, np.ndarray]]:
    """The arrays of each part of a level that `write_part` has written, in order."""
    parts = []
    for name in sorted(os.listdir(folder) if os.path.isdir(folder) else []):
        if name.endswith(".json"):
            with open(os.path.join(folder, name)) as file:
                places = json.load(file)
            if places:
                with open(os.path.join(folder, name[:-5] + ".bin"), "rb") as file:
                    # a level of thousands of parts must not hold as many open files
                    whole = np.frombuffer(mmap.mmap(
                        file.fileno(), 0, access=mmap.ACCESS_READ, **({"trackfd": False} if sys.version_info >= (3, 13) else {})), np.uint8)
                parts.append({key: whole[at:at + np.dtype(kind).itemsize * size].view(kind) for key, (kind, at, size) in places.items()})
    return parts


def mapped(files: tuple[str, ...], build: Callable[[dict], dict[str, np.ndarray]]) -> list[dict[str, np.ndarray]]:
    """The arrays of each part of a level, in order, mapped into memory from a mounted folder (`files` names it alone and ends
    in a slash), otherwise as `build` makes them of each row, from one file that all workers of an executor share. The first
    to come writes it, row by row, and removes the table's files that were sent to that executor's folder."""
    if len(files) == 1 and files[0].endswith("/"):
        return _folder_parts(files[0])
    root = SparkFiles.getRootDirectory()
    path = os.path.join(root, f"level-{xxhash.xxh3_64_hexdigest(chr(10).join(files))}")
    with open(path + ".lock", "w") as lock:
        fcntl.flock(lock, fcntl.LOCK_EX)
        if not os.path.exists(path):
            parts, at = [], 0
            with open(path + ".new", "wb") as file:
                for name in files:
                    with pq.ParquetFile(os.path.join(root, name)) as table:
                        for batch in table.iter_batches(batch_size=1):
                            for row in batch.to_pylist():
                                places, at = _placed(build(row), file, at)
                                parts.append((row["part"], places))
                file.truncate(max(1, at))
            with open(path + ".json", "w") as file:
                json.dump([places for _, places in sorted(parts, key=lambda p: p[0]) if places], file)
            os.rename(path + ".new", path)
            for name in files:
                if not os.path.isabs(name):
                    os.remove(os.path.join(root, name))
    with open(path + ".json") as file:
        parts = json.load(file)
    whole = np.memmap(path, np.uint8, "r")
    return [{key: whole[at:at + np.dtype(kind).itemsize * size].view(kind) for key, (kind, at, size) in places.items()}
            for places in parts]


def _by_part(values: np.ndarray, begins: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Where the values stand that belong to each part; `begins` has the least value of each."""
    part = np.searchsorted(begins, values, side="right") - 1
    by = np.argsort(part.astype(np.int16 if len(begins) < 1 << 15 else np.int64), kind="stable")
    cuts = np.searchsorted(part[by], np.arange(len(begins) + 1)).tolist()
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if a < b:
            yield k, by[a:b]


class Part:
    """A range of contexts of a level: `codes` by entry, `weights` by context, children and pointers in Elias-Fano form."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.first = int(arrays["first"][0])
        self.codes, self.weights = arrays["codes"], arrays["weights"]
        self.children = EliasFano({k[2:]: v for k, v in arrays.items() if k.startswith("k_")})
        self.pointers = EliasFano({k[2:]: v for k, v in arrays.items() if k.startswith("p_")})

    @staticmethod
    def built(row: dict, vocabulary: int) -> dict[str, np.ndarray]:
        return Part.arrays(unpacked(row["keys"]), np.frombuffer(row["codes"], np.uint8), unpacked(row["contexts"]),
                           np.frombuffer(row["weights"], np.uint8), vocabulary)

    @staticmethod
    def arrays(keys: np.ndarray, codes: np.ndarray, contexts: np.ndarray, coded: np.ndarray, vocabulary: int) -> dict[str, np.ndarray]:
        if not len(contexts):
            return {}
        first = contexts[0]
        keys, contexts = keys - first * np.uint64(vocabulary), (contexts - first).astype(np.int64)
        n = int(contexts[-1]) + 2
        starts = np.searchsorted(keys, np.arange(n, dtype=np.uint64) * np.uint64(vocabulary)).astype(np.uint64)
        weights = np.zeros(n - 1, np.uint8)
        weights[contexts] = coded
        return {"first": np.array([first]), "codes": codes, "weights": weights} | {
            f"k_{k}": v for k, v in EliasFano.encode(keys).items()} | {f"p_{k}": v for k, v in EliasFano.encode(starts).items()}

    def find(self, keys: np.ndarray, vocabulary: int) -> np.ndarray:
        """Entry of each of the ascending keys (from the part's first context on), -1 where it has none."""
        at = np.full(len(keys), -1, np.int64)
        n = np.searchsorted(keys, (self.pointers.size - 1) * vocabulary)
        at[:n] = self.children.find(keys[:n])
        return at


class Level:
    """Level n >= 2 in parts; entries are numbered through."""

    def __init__(self, files: tuple[str, ...], vocabulary: int):
        self.vocabulary = vocabulary
        self.parts = [Part(arrays) for arrays in mapped(files, lambda row: Part.built(row, vocabulary))]
        sizes = np.array([p.children.size for p in self.parts], np.int64)
        self.size = int(sizes.sum())
        self.begins = np.cumsum(sizes) - sizes
        self.firsts = np.array([p.first for p in self.parts], np.int64)

    def _found(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Which (context, word) can have an entry, as negative ones have none; of their different keys, in order, the entry (-1
        for none) and the code of its probability, else that of the context's weight; and which of these keys each has."""
        known = np.nonzero((context >= 0) & (word >= 0))[0]
        keys, back = np.unique(context[known] * self.vocabulary + word[known], return_inverse=True)
        at, codes = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.uint8)
        cuts = [*np.searchsorted(keys, self.firsts * self.vocabulary).tolist(), len(keys)]
        for part, begin, a, b in zip(self.parts, self.begins.tolist(), cuts, cuts[1:]):
            if a < b:
                own = keys[a:b] - part.first * self.vocabulary
                found = part.find(own, self.vocabulary)
                hit, miss = np.nonzero(found >= 0)[0], np.nonzero(found < 0)[0]
                at[a:b][hit] = found[hit] + begin
                codes[a:b][hit] = part.codes[found[hit]]
                contexts = own[miss] // self.vocabulary
                inside = contexts < len(part.weights)
                codes[a:b][miss[inside]] = part.weights[contexts[inside]]
        return known, at, codes, back

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Entry of each (context, word), -1 where it has none; negative contexts and words have none."""
        return self.look(context, word)[0]

    def look(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry of each (context, word), as `find`, and the code of its probability, else that of its context's weight."""
        known, at, found, back = self._found(context, word)
        out, codes = np.full(len(context), -1, np.int64), np.zeros(len(context), np.uint8)
        out[known], codes[known] = at[back], found[back]
        new = np.nonzero((context >= 0) & (word < 0))[0]
        if len(new):
            codes[new] = self.weight(context[new])
        return out, codes

    def weight(self, context: np.ndarray) -> np.ndarray:
        """Code of the back-off weight of each context, 0 where it has no words."""
        out = np.zeros(len(context), np.uint8)
        for k, at in _by_part(context, self.firsts):
            own = context[at] - self.firsts[k]
            inside = own < len(self.parts[k].weights)
            out[at[inside]] = self.parts[k].weights[own[inside]]
        return out

    def word(self, entry: np.ndarray) -> np.ndarray:
        """The last word of each entry."""
        out = np.zeros(len(entry), np.int64)
        for k, at in _by_part(entry, self.begins):
            out[at] = self.parts[k].children.access(entry[at] - self.begins[k]) % self.vocabulary
        return out


def _different(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Which of the different words each one is, and the hashes of these."""
    coded = pa.array(words, pa.large_binary()).dictionary_encode()
    which, first = coded.indices.to_numpy(), np.zeros(len(coded.dictionary), np.int64)
    first[which[::-1]] = np.arange(len(words) - 1, -1, -1)
    return which, np.fromiter(map(xxhash.xxh3_64_intdigest, map(words.__getitem__, first.tolist())), np.uint64, len(first))


class Trie:
    """What a worker has mapped: level 1 (hashes, counts) and the further levels, all in parts."""

    def __init__(self, files: tuple[tuple[str, ...], ...]):
        self.words = mapped(files[0], lambda row: {"hashes": unpacked(row["keys"]), "counts": unpacked(row["counts"]).astype(np.uint32)})
        self.words = [w for w in self.words if len(w["hashes"])]
        sizes = np.array([len(w["hashes"]) for w in self.words], np.int64)
        self.tokens = sum(int(w["counts"].sum(dtype=np.int64)) for w in self.words)
        self.size = int(sizes.sum())
        self.begins = np.cumsum(sizes) - sizes
        self.firsts = np.array([w["hashes"][0] for w in self.words], np.uint64)
        self.levels = [Level(names, self.size) for names in files[1:]]

    def ids(self, words: list[bytes]) -> np.ndarray:
        which, own = _different(words)
        order = np.argsort(own)
        own = own[order]
        found = np.full(len(own), -1, np.int64)
        cuts = [*np.searchsorted(own, self.firsts).tolist(), len(own)]
        for part, begin, a, b in zip(self.words, self.begins.tolist(), cuts, cuts[1:]):
            if a < b:
                hashes = part["hashes"]
                at = np.minimum(np.searchsorted(hashes, own[a:b]), len(hashes) - 1)
                found[order[a:b]] = np.where(hashes[at] == own[a:b], at + begin, -1)
        return found[which]

    def entries(self, ids: np.ndarray, begins: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray | None, np.ndarray | None]]:
        """(context, entry, code as `Level.look` gives it) of every token, level by level from the second; `begins` marks first
        tokens of texts. Behind the last level stand its entries as contexts alone."""
        above = ids
        for n in range(len(self.levels) + 1):
            context = np.concatenate(([-1], above[:-1]))
            context[begins] = self.size if n == 0 else -1
            entry, code = self.levels[n].look(context, ids) if n < len(self.levels) else (None, None)
            yield context, entry, code
            above = entry

    def base(self, ids: np.ndarray) -> np.ndarray:
        counts = np.zeros(len(ids), np.int64)
        for k, at in _by_part(ids, self.begins):
            counts[at] = self.words[k]["counts"][ids[at] - self.begins[k]]
        return np.log10((counts + ADDED) / (self.tokens + ADDED * (self.size + 1)))

    def log10(self, ids: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each token in level 1 and in the whole trie."""
        base = self.base(ids)
        score = base.copy()
        for (_, entry, code), _ in zip(self.entries(ids, begins), self.levels):
            score = np.where(entry >= 0, 0.0, score) - code / STEP
        return base, score


_TRIES: dict[tuple, Trie] = {}


def load_trie(files: tuple[tuple[str, ...], ...]) -> Trie:
    """The trie from the files of its levels' tables, mapped once in a process."""
    if files not in _TRIES:
        _TRIES.clear()
        _TRIES[files] = Trie(files)
    return _TRIES[files]


def _mounted(spark: SparkSession, path: str) -> str | None:
    """The local name of a path in a shared folder that is mounted; of one in a store: none."""
    if not urlsplit(path).scheme:
        path = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").rstrip("/") + path
    return unquote(urlsplit(path).path) + "/" if path.startswith("file:") else None


def _share(spark: SparkSession, level: DataFrame, path: str) -> tuple[str, ...]:
    """`level` computed, and where executors, now and later, find its parts: in the folder that its tasks have written, if the
    shared one is mounted, otherwise in files of a table, by the names under which each executor fetches them from the store."""
    folder = _mounted(spark, path)
    if folder:
        level.write.format("noop").mode("overwrite").save()
        return (folder,)
    level.write.parquet(path)
    names = []
    for row in spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path").collect():
        spark.sparkContext.addFile(row["path"])
        names.append(row["path"].rpartition("/")[2])
    return tuple(sorted(names))


def _merge(blocks: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([b[0] for b in blocks])
    counts = np.concatenate([b[1] for b in blocks])
    by = np.argsort(keys, kind="stable")
    keys, counts = keys[by], counts[by]
    first = np.nonzero(np.concatenate(([True], keys[1:] != keys[:-1])))[0] if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _blocks(keys: np.ndarray, counts: np.ndarray, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sorted keys and counts as one row for each range of keys."""
    cuts = np.searchsorted(keys, bounds)
    for part, (a, b) in enumerate(zip(np.concatenate(([0], cuts)).tolist(), [*cuts.tolist(), len(keys)])):
        if a < b:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([packed(keys[a:b], True)]), pa.array(
                [packed(counts[a:b])])], names=["part", "keys", "counts"])


_BLOCK = "part int, keys binary, counts binary"


def _merged(blocks: DataFrame, parts: int, then: Callable, schema: str) -> DataFrame:
    """`then(part, keys, counts)` for each range of keys with the counts of all blocks added up."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size = None, [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                now = batch.column("part")[k].as_py()
                if part is not None and now != part:
                    yield from then(part, *_merge(held))
                    held, size = [], 0
                part = now
                held.append((unpacked(batch.column("keys")[k].as_py()), unpacked(batch.column("counts")[k].as_py())))
                size += len(held[-1][0])
                if size > 4 * BLOCK_KEYS:
                    held = [_merge(held)]
                    size = len(held[0][0])
        if part is not None:
            yield from then(part, *_merge(held))

    return blocks.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, schema)


def _texts(batch: pa.RecordBatch) -> tuple[list[bytes], np.ndarray]:
    """All tokens of a batch in one list and how many each text has, the end included."""
    words, sizes = [], []
    for text in batch.column("text").to_pylist():
        own = words_of(text)
        words += own
        words.append(END)
        sizes.append(len(own) + 1)
    return words, np.array(sizes, np.int64)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _count_words(texts: DataFrame, parts: int, folder: str | None) -> DataFrame:
    bounds = (np.arange(1, parts, dtype=np.float64) * (2.0 ** 64 / parts)).astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in _slices(batches):
            words = _texts(batch)[0]
            if not words:
                continue
            which, hashes = _different(words)
            held.append((hashes, np.bincount(which, minlength=len(hashes)).astype(np.uint64)))
            size += len(hashes)
            if size > BLOCK_KEYS // 2:
                yield from _blocks(*_merge(held), bounds)
                held, size = [], 0
        if size:
            yield from _blocks(*_merge(held), bounds)

    def then(part: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        if folder:
            write_part(folder, part, {"hashes": keys, "counts": counts.astype(np.uint32)})
            return
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([packed(keys, True)]), pa.array([packed(counts)])], names=["part", "keys", "counts"])

    return _merged(texts.mapInArrow(run, _BLOCK), parts, then, _BLOCK)


def _ranges(trie: Trie, parts: int) -> np.ndarray:
    """Cuts of the keys (context, word) of the next level, between contexts."""
    contexts = trie.levels[-1].size if trie.levels else trie.size + 1
    if contexts * max(1, trie.size) >= 1 << 63:
        raise ValueError("more contexts and words than a 64-bit key can hold")
    return (np.arange(1, parts, dtype=np.int64) * contexts // parts).astype(np.uint64) * np.uint64(trie.size)


def _count_grams(texts: DataFrame, files: tuple, parts: int, min_count: int) -> DataFrame:
    """The next level's n-grams with counts, each context's total, and the bins for the interpolation weights."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = load_trie(files)
        bounds, held, size = _ranges(trie, parts), [], 0
        for batch in _slices(batches):
            words, sizes = _texts(batch)
            if not words:
                continue
            ids = trie.ids(words)
            begins = np.cumsum(sizes) - sizes
            context = list(trie.entries(ids, begins))[-1][0]
            seen = context >= 0
            held.append((context[seen] * trie.size + ids[seen]).astype(np.uint64))
            size += len(held[-1])
            if size > BLOCK_KEYS:
                yield from _blocks(*np.unique(np.concatenate(held), return_counts=True), bounds)
                held, size = [], 0
        if size:
            yield from _blocks(*np.unique(np.concatenate(held), return_counts=True), bounds)

    def then(part: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        trie = load_trie(files)
        context, word = keys // np.uint64(trie.size), (keys % np.uint64(trie.size)).astype(np.int64)
        new = np.concatenate(([True], context[1:] != context[:-1]))[:len(keys)]
        contexts, which = context[new], np.cumsum(new) - 1
        totals = np.bincount(which, counts, len(contexts)).astype(np.uint64)
        # how the other occurrences of a context predict this one, against the lower order
        rest = totals[which] - 1.0
        bins, more = np.zeros(len(keys), np.int64), np.nonzero(counts > 1)[0]
        lower = _lower(trie, context[more].astype(np.int64), word[more])
        ratio = (counts[more] - 1.0) / rest[more]
        bins[more] = np.clip(np.log2(ratio / lower) / BIN_WIDTH + BINS / 4, 1, BINS - 1).astype(np.int64)
        # what is left of the context is a context of that size, down to those seen once
        bucket = _bucket(rest)
        tally = np.bincount(bucket * BINS + bins, counts * (rest > 0), BUCKETS * BINS)
        kept = counts >= min_count
        mass = np.bincount(which[kept], counts[kept], len(contexts)).astype(np.uint64)
        some = mass > 0
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *[pa.array([x]) for x in (
            packed(keys[kept], True), packed(counts[kept]), packed(contexts[some], True), packed(totals[some]), packed(mass[some]),
            tally.tobytes())]], names=["part", "keys", "counts", "contexts", "totals", "mass", "tally"])

    return _merged(texts.mapInArrow(run, _BLOCK), parts, then,
                   "part int, keys binary, counts binary, contexts binary, totals binary, mass binary, tally binary")


def _lower(trie: Trie, context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Probability of each word after its context without the context's first word."""
    if not trie.levels:
        return 10 ** trie.base(word)
    # the context is an entry of the last level: its own key names the word before
    pairs = np.stack([trie.levels[-1].word(context), word], axis=1).ravel()
    return 10 ** trie_tail(trie, pairs)


def trie_tail(trie: Trie, pairs: np.ndarray) -> np.ndarray:
    """log10 of the second token of each pair after the first; orders over three keep the last two words only."""
    level = trie.levels[0]
    first, second = pairs[0::2], pairs[1::2]
    entry, code = level.look(first, second)
    return np.where(entry >= 0, 0.0, trie.base(second)) - code / STEP


def _bucket(totals: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(totals, 1)), BUCKETS - 1).astype(np.int64)


def _weights(tally: np.ndarray, rounds: int = 60) -> np.ndarray:
    """For each size of context the share of its own counts in the mixture, fitted on left-out occurrences."""
    ratio = np.concatenate(([0.0], 2.0 ** ((np.arange(1, BINS) + 0.5 - BINS / 4) * BIN_WIDTH)))
    share = np.full(BUCKETS, 0.3)
    n = tally.sum(axis=1)
    for _ in range(rounds):
        own = share[:, None] * ratio
        share = np.where(n > 0, (tally * own / (own + 1 - share[:, None])).sum(axis=1) / np.maximum(n, 1), 0.0)
    return np.clip(share, 0.0, 0.95)


def _code(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(np.maximum(p, 1e-12)) * STEP), 0, 255).astype(np.uint8)


def _finish(counted: DataFrame, files: tuple, share: np.ndarray, folder: str | None) -> DataFrame:
    """Codes of the smoothed probabilities of entries and of the back-off weights of contexts; with a folder, they go there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = load_trie(files)
        for batch in released(batches):
            for k in range(batch.num_rows):
                keys, counts, contexts, totals, mass = (
                    unpacked(batch.column(c)[k].as_py()) for c in ("keys", "counts", "contexts", "totals", "mass"))
                own = share[_bucket(totals)] / np.maximum(totals, 1)
                weight = 1 - own * mass
                coded = _code(weight)
                owner = np.searchsorted(contexts, keys // np.uint64(trie.size))
                lower = _lower(trie, contexts[owner].astype(np.int64), (keys % np.uint64(trie.size)).astype(np.int64)) if len(keys) else 0
                p = own[owner] * counts + 10 ** (-(coded[owner] / STEP)) * lower
                if folder:
                    write_part(folder, batch.column("part")[k].as_py(), Part.arrays(keys, _code(p), contexts, coded, trie.size))
                    continue
                yield pa.RecordBatch.from_arrays([batch.column("part")[k:k + 1], *[pa.array([x]) for x in (
                    packed(keys, True), _code(p).tobytes(), packed(contexts, True), coded.tobytes())]], names=["part", "keys", "codes", "contexts", "weights"])

    return counted.mapInArrow(run, "part int, keys binary, codes binary, contexts binary, weights binary")


def build_trie(texts: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT) -> tuple[tuple[str, ...], ...]:
    """The files of a trie of the column `text`: a tuple of them for each level, within reach of all executors.

    Every training text counts in full. The weights of the interpolation are fitted for each size of context by leaving
    out one occurrence at a time. Orders 2 and 3 are supported. No texts give an empty vocabulary.
    """
    if order not in (1, 2, 3):
        raise ValueError("order must be 1, 2 or 3")
    spark = texts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = work_path(spark, "trie-1")
    with settings(spark, FREED):
        files = (_share(spark, _count_words(texts, parts, _mounted(spark, path)), path),)
        for n in range(2, order + 1):
            counted, path = f"llm_grams_{uuid.uuid4().hex}", work_path(spark, f"trie-{n}")
            try:
                _count_grams(texts, files, parts, min_count).write.saveAsTable(counted)
                rows = spark.table(counted)
                tally = np.zeros((BUCKETS, BINS))
                for row in rows.select("tally").toLocalIterator():
                    tally += np.frombuffer(row["tally"], np.float64).reshape(BUCKETS, BINS)
                level = _finish(rows, files, _weights(tally), _mounted(spark, path))
                files = (*files, _share(spark, level, path))
            finally:
                # the finished level holds its n-grams
                spark.sql(f"DROP TABLE IF EXISTS {counted}")
    return files


def score(docs: DataFrame, files: tuple[tuple[str, ...], ...], *keep: str) -> DataFrame:
    """The columns `keep` with the tokens of each text (words and one end), those known, the tokens that the trie has
    learned from, and the log10 probability of the text in level 1 (`base_score`) and in the trie (`score`).

    A null or blank text has the end alone. Repeated rows are scored alike; other columns are ignored.
    """
    picked = docs.select(*[F.col(f"`{k}`") for k in keep], F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = load_trie(files)
        for batch in _slices(batches):
            words, sizes = _texts(batch)
            if not words:
                continue
            ids = trie.ids(words)
            begins = np.cumsum(sizes) - sizes
            base, own = trie.log10(ids, begins)
            added = lambda x: pa.array(np.add.reduceat(x, begins))
            columns = {k: batch.column(k) for k in keep} | {
                "n_tokens": pa.array(sizes), "n_known": added((ids >= 0).astype(np.int64)),
                "train_tokens": pa.array(np.full(len(sizes), trie.tokens, np.int64)), "base_score": added(base), "score": added(own)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = picked.drop("text").schema
    for name, kind in (("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"), ("base_score", "double"), ("score", "double")):
        schema = schema.add(name, kind)
    return picked.mapInArrow(run, schema)


def held_out_scores(docs: DataFrame, parts: int = 10, held: int = 0, order: int = ORDER) -> DataFrame:
    """Scores of every document by a trie of the documents outside one fold of ids."""
    remainder = fold("doc_id", parts)
    files = build_trie(docs.where(remainder != held).select(F.col("text").cast("string").alias("text")), order)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder == held).alias("held_out"), "text")
    return score(named, files, "doc_id", "held_out")
