"""Packing documents into windows of tokens by best-fit decreasing.

Documents longer than a window are first cut into full windows. The rests and the shorter documents are packed the
longest first, each into the open window with the least room that still holds it; a segment tree over the remaining
capacities finds that window. A task packs what it reads in chunks of bounded size, so nothing is shuffled and no task
holds more than one chunk. The emptiest windows of a chunk are cut at powers of two, where no padding is needed.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from tallyweave.llm.common import released

WINDOW = 2048
END_ID = 1
#: Tokens that a task gathers before it packs them.
CHUNK_TOKENS = 8_000_000

# The way the vocabulary cuts text before merging.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose class may differ between Unicode versions: texts with any are left to the file's own library.
UNSURE = re.compile("[^\t\n\r\x20-\x7e\xa1-\xac\xae-\u024f]")


class Encoder:
    """Ids of whole texts by a byte-level BPE file of the `tokenizers` library.

    The same merges run in tiktoken, several times as fast, with the ids of the file as ranks; the two agree wherever
    both cut the text alike. Texts with characters for which that is not certain go to `tokenizers` itself.
    """

    def __init__(self, path: str):
        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in plain]
        byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
        ranks = {bytes(map(byte_of.__getitem__, token)): rank
                 for token, rank in self.own.get_vocab(with_added_tokens=False).items() if set(token) <= byte_of.keys()}
        ranks = {token: rank for token, rank in ranks.items() if token != b"<|endoftext|>"}
        self.fast = tiktoken.Encoding("packing", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str | None, end_id: int = END_ID) -> np.ndarray:
        """The ids of the text and then `end_id`; a null text has `end_id` only."""
        if not text:
            found = []
        elif UNSURE.search(text):
            found = self.own.encode(text, add_special_tokens=False).ids
        else:
            found = self.fast.encode_ordinary(text)
        out = np.empty(len(found) + 1, np.uint32)
        out[:-1] = found
        out[-1] = end_id
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The file's encoder, loaded once in a process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class OpenWindows:
    """Windows by remaining room, in a segment tree: each node tells whether a window with such room is open below it."""

    def __init__(self, window: int):
        self.window = window
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.ids: dict[int, list[int]] = defaultdict(list)

    def _change(self, room: int, by: int) -> None:
        node = self.leaves + room
        while node:
            self.count[node] += by
            node >>= 1

    def add(self, room: int, window_id: int) -> None:
        if room:
            self.ids[room].append(window_id)
            self._change(room, 1)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """Takes out the open window with the least room of at least `size`; (room, window id)."""
        node = self.leaves + size
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node == 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node + (not self.count[2 * node])
        room = node - self.leaves
        self._change(room, -1)
        return room, self.ids[room].pop()


def best_fit_decreasing(sizes: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """For each size (at most `window`) the number of its window and its offset there; ties go by position."""
    open_windows, placed, used = OpenWindows(window), [(0, 0)] * len(sizes), 0
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        found = open_windows.tightest(sizes[k])
        room, at = found or (window, used)
        used += found is None
        placed[k] = (at, window - room)
        open_windows.add(room - sizes[k], at)
    return placed


def plan(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, window number, offset) of documents of the given token lengths, all at least 1.

    Windows less than half full hold only what no other window took; they are cut at powers of two, so that each part
    is a sequence of its own without padding.
    """
    pieces, rests, used = [], [], 0
    for k, n in enumerate(lengths):
        full = n // window
        for j in range(full):
            pieces.append((k, j * window, window, used, 0))
            used += 1
        if n % window:
            rests.append((k, full * window, n % window))
    placed = best_fit_decreasing([r[2] for r in rests], window)
    filled: dict[int, list[int]] = defaultdict(list)
    for r, (at, _) in enumerate(placed):
        filled[at].append(r)
    for at in sorted(filled):
        members = sorted(filled[at], key=lambda r: placed[r][1])
        total = sum(rests[r][2] for r in members)
        parts = [total] if total * 2 > window else [1 << b for b in range(window.bit_length(), -1, -1) if total >> b & 1]
        left, offset = parts.pop(0), 0
        for r in members:
            k, start, n = rests[r]
            while n:
                take = min(n, left)
                pieces.append((k, start, take, used, offset))
                start, n, left, offset = start + take, n - take, left - take, offset + take
                if not left and parts:
                    left, offset, used = parts.pop(0), 0, used + 1
        used += 1
    return pieces


PIECES = ("doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID,
         chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """Pieces of documents with their token ids (`ids`, little-endian unsigned 32-bit) and their place in a sequence.

    Every token of every row is in exactly one piece; a null or empty text is the end token alone. Repeated rows are
    packed as often as they occur; other columns are ignored; an empty table gives no rows. `sequence_id` joins the
    number of the task with that of the window, so a task that runs again gives the same sequences. The file at
    `tokenizer_path` must be in place on every executor.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, used = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36, 0
        names: list[int | None] = []
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal used
            pieces = plan([len(x) for x in held], window)
            for at in range(0, len(pieces), 8192):
                some = pieces[at:at + 8192]
                yield pa.RecordBatch.from_arrays([
                    pa.array([names[p[0]] for p in some], pa.int64()),
                    *[pa.array([p[c] for p in some], pa.int64()) for c in (1, 2)],
                    pa.array([len(held[p[0]]) for p in some], pa.int64()),
                    pa.array([base + used + p[3] for p in some], pa.int64()),
                    pa.array([p[4] for p in some], pa.int64()),
                    pa.array([held[p[0]][p[1]:p[1] + p[2]].astype("<u4").tobytes() for p in some], pa.binary()),
                ], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
            used += max((p[3] for p in pieces), default=-1) + 1
            names.clear()
            held.clear()

        tokens, encode = 0, encoder(tokenizer_path).ids
        for batch in released(batches):
            for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                names.append(name)
                held.append(encode(text.as_py(), end_id))
                tokens += len(held[-1])
                if tokens >= chunk_tokens:
                    yield from flush()
                    tokens = 0
        yield from flush()

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, PIECES)


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with `ids_crc32`, the checksum of their ids, in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
