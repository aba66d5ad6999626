"""Byte-level BPE by a queue of merge ranks: encoding and decoding of whole texts.

A pre-token's bytes form a linked list. Every pair of neighbours whose joined bytes have a rank waits in the bucket of
that rank. A bitmap of two levels (a word for 256 ranks, and a word above that tells which words are in use) gives the
least rank by two find-first-set steps. Buckets give the leftmost position first. A merge changes at most two pairs, which enter new
buckets; what they leave behind in old ones is skipped when it comes up. A pre-token of n bytes takes n log n steps
at most, whatever it holds, so a text without a single break is no special case.

Pre-tokens are encoded once and remembered in each worker, within a bound.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator, Sequence
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

#: Distinct pre-tokens that a worker remembers, and the longest one that it does.
REMEMBERED = 1_000_000
REMEMBERED_CHARS = 64
#: Bytes of results that leave a task at once.
BATCH_BYTES = 4 << 20
#: Longer texts are cut into pre-tokens one by one, not as one list.
LIST_CHARS = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a file of lines `base64 rank`."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class _Remembered(dict):
    """Pre-token to its packed ids, filled on demand and emptied when it has grown to its bound."""

    def __init__(self, make: Callable[[str], bytes], bound: int):
        super().__init__()
        self.make, self.bound = make, bound

    def __missing__(self, piece: str) -> bytes:
        packed = self.make(piece)
        if len(piece) <= REMEMBERED_CHARS:
            if len(self) >= self.bound:
                self.clear()
            self[piece] = packed
        return packed


#: Texts without a character beyond this one are cut by plain character classes.
LATIN = 0x24F
_BEYOND = re.compile(f"[^\x00-{chr(LATIN)}]")


def latin_pattern(pattern: str) -> re.Pattern | None:
    """The pattern for texts without characters beyond LATIN: the properties \\p{L}, \\p{N} and \\s written out as
    classes, which the plain engine runs several times as fast. None for a pattern that uses anything else it lacks."""
    def of(test: Callable[[str], bool]) -> str:
        return "".join(re.escape(chr(c)) for c in range(LATIN + 1) if test(chr(c)))

    classes = {r"\p{L}": of(lambda c: unicodedata.category(c)[0] == "L"), r"\p{N}": of(lambda c: unicodedata.category(c)[0] == "N"),
               r"\s": of(lambda c: c.isspace() and not "\x1c" <= c <= "\x1f")}
    out, inside, at = [], False, 0
    while at < len(pattern):
        step = next((x for x in (*classes, r"\S") if pattern.startswith(x, at)), pattern[at:at + 1 + (pattern[at] == "\\")])
        if step in classes:
            out.append(classes[step] if inside else f"[{classes[step]}]")
        elif step == r"\S" and not inside:
            out.append("[^" + classes[r"\s"] + "]")
        elif step == r"\S" or re.fullmatch(r"\\[a-zA-Z]", step):
            return None
        else:
            inside = step == "[" or (inside and step != "]")
            out.append(step)
        at += len(step)
    return re.compile("".join(out))


class Coder:
    """Encoder and decoder of one vocabulary. Every single byte must have a rank; ids are ranks.

    `pattern` cuts a text into pre-tokens; each is a token of its own if it has a rank, and else merged. Characters that
    the pattern does not match are left out, as by any encoder that works on matches.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED):
        if any(bytes((b,)) not in ranks for b in range(256)):
            raise ValueError("a single byte has no rank")
        self.ranks = ranks
        self.tokens: dict[int, bytes] = {rank: token for token, rank in ranks.items()}
        self.cut = regex.compile(pattern)
        self.cut_latin = latin_pattern(pattern)
        self.buckets: list[list[int]] = [[] for _ in range(max(ranks.values()) + 1)]
        self.words = [0] * ((len(self.buckets) >> 8) + 1)
        self.packed = _Remembered(lambda piece: array("I", self.merge(piece.encode("utf-8", "surrogatepass"))).tobytes(),
                                  remembered)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token. The queue is empty before and after."""
        ranks, n = self.ranks, len(piece)
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        rank_of, buckets, words, used = ranks.get, self.buckets, self.words, 0
        end = list(range(1, n + 1))  # where the token that starts here ends
        before = list(range(-1, n))  # where the token before the one that starts here starts
        pair = [None] * n  # rank of the token that starts here joined with the next
        for i in range(n - 1):
            rank = rank_of(piece[i:i + 2])
            if rank is not None:
                pair[i] = rank
                bucket = buckets[rank]
                if not bucket:
                    words[rank >> 8] |= 1 << (rank & 255)
                    used |= 1 << (rank >> 8)
                bucket.append(i)  # in order, so it is a heap
        while used:
            word = (used & -used).bit_length() - 1
            bits = words[word]
            lowest = bits & -bits
            rank = word << 8 | lowest.bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket.pop()
                words[word] = bits ^ lowest
                if bits == lowest:
                    used ^= 1 << word
            if pair[i] != rank:
                continue  # what this entry stood for has changed since
            joined = end[i]
            end[i] = stop = end[joined]
            pair[joined] = rank = None
            if stop < n:
                before[stop] = i
                rank = rank_of(piece[i:end[stop]])
                if rank is not None:
                    bucket = buckets[rank]
                    if bucket:
                        heappush(bucket, i)
                    else:
                        words[rank >> 8] |= 1 << (rank & 255)
                        used |= 1 << (rank >> 8)
                        bucket.append(i)
            pair[i] = rank
            left = before[i]
            if left >= 0:
                pair[left] = rank = rank_of(piece[left:stop])
                if rank is not None:
                    bucket = buckets[rank]
                    if bucket:
                        heappush(bucket, left)
                    else:
                        words[rank >> 8] |= 1 << (rank & 255)
                        used |= 1 << (rank >> 8)
                        bucket.append(left)
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i:end[i]]])
            i = end[i]
        return ids

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers; a null text has none."""
        if not text:
            return b""
        cut = self.cut if self.cut_latin is None or _BEYOND.search(text) else self.cut_latin
        if len(text) <= LIST_CHARS:
            return b"".join(map(self.packed.__getitem__, cut.findall(text)))
        return b"".join(self.packed[m.group()] for m in cut.finditer(text))

    def decode(self, ids: bytes | None) -> bytes:
        """The bytes behind packed ids; an id without a token raises."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))


_CODERS: dict[tuple[str, str], Coder] = {}


def coder(path: str, pattern: str) -> Coder:
    """The file's coder, made once in a process."""
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = Coder(read_ranks(path), pattern)
    return _CODERS[path, pattern]


def _mapped(df: DataFrame, column: str, made: Sequence[str], work: Callable[[], Callable[[object], Sequence[bytes]]]) -> DataFrame:
    """doc_id with binary columns made from `column` value by value, in batches of bounded size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = work()
        for batch in batches:
            source, at, size, held = batch.column(column), 0, 0, []
            for k in range(batch.num_rows):
                held.append(make(source[k].as_py()))
                size += sum(map(len, held[-1]))
                if size >= BATCH_BYTES or k + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").slice(at, len(held)), *(pa.array(c, pa.binary()) for c in zip(*held))],
                        names=["doc_id", *made])
                    at, size, held = k + 1, 0, []

    return df.mapInArrow(run, ", ".join(["doc_id long", *(f"{c} binary" for c in made)]))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): the token ids of each row's whole text, packed as little-endian unsigned 32-bit integers.

    A null or empty text has no ids. Repeated rows and null doc_ids stay as they are; other columns are left out; an
    empty table gives no rows. The file at `path` must be in place on every executor.
    """
    def work():
        run = coder(path, pattern).encode
        return lambda text: (run(text),)

    return _mapped(_texts(docs), "text", ["ids"], work)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, decoded): the bytes that the ids stand for; null ids stand for none. An unknown id fails the job."""
    def work():
        run = coder(path, pattern).decode
        return lambda ids: (run(ids),)

    return _mapped(encoded.select("doc_id", "ids"), "ids", ["decoded"], work)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded): `encode` and then `decode` of the ids, in one pass."""
    def work():
        own = coder(path, pattern)
        return lambda text: (ids := own.encode(text), own.decode(ids))

    return _mapped(_texts(docs), "text", ["ids", "decoded"], work)


def digests(decoded: DataFrame) -> DataFrame:
    """One row per document with the number of its ids and the digests of ids and decoded bytes."""
    return decoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
