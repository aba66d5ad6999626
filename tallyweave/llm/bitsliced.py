"""Exact top-k inner products over a bit-sliced index.

The vectors of a block of rows are kept as bit slices: one bitmap for each bit of each attribute. For a query the slices
of its weighted attributes are added with bitmap arithmetic (full adders on whole words, three bitmaps to two), which
gives the slices of every row's score. The best rows are taken from the most significant slice downward: a slice either
has enough rows set among the candidates, which narrows them, or too few, which makes those rows certain. Rows still
tied after the last slice are settled by their id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallyweave.session import cut_lineage

SCALE = 256
#: Components beyond this in size (after scaling) are no longs; such vectors take no part.
LARGEST = 1 << 62
#: Rows of a block of slices, and queries that meet a block together: least (to have tasks for all cores) and most.
BLOCK_ROWS, QUERY_ROWS, MOST_QUERY_ROWS = 65_536, 64, 8192
_LONG = 1 << 63


def slices_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit slices [attribute, bit, word] of values [row, attribute] above each attribute's least value, and those least
    values. The bit count is that of the widest attribute."""
    least = values.min(axis=0)
    above = values.view(np.uint64) - least.view(np.uint64)  # no difference of longs is beyond 64 bits
    bits = max(1, int(above.max()).bit_length())
    rows = -(-len(values) // 64) * 64
    out = np.empty((values.shape[1], bits, rows // 64), np.uint64)
    for b in range(bits):
        plane = np.zeros((values.shape[1], rows), np.uint8)
        plane[:, : len(values)] = (above >> np.uint64(b) & np.uint64(1)).T
        out[:, b] = np.packbits(plane, axis=1, bitorder="little").view(np.uint64)
    return out, least


def signed_digits(n: int) -> list[int]:
    """Positions of the ones of n, few of them: a run of ones is one subtraction, given as ~position."""
    out, at = [], 0
    while n:
        if n & 1:
            digit = 2 - (n & 3)
            out.append(at if digit > 0 else ~at)
            n -= digit
        n >>= 1
        at += 1
    return out


def add_slices(query: np.ndarray, slices: np.ndarray, inverse: np.ndarray) -> list[np.ndarray | None]:
    """Slices of query * row + constant for every row, the least significant first (None: no bit set); `inverse` are the
    complements of the slices."""
    width = slices.shape[1]
    columns: list[list[np.ndarray]] = [[] for _ in range(200)]
    for a in range(len(query)):
        q = int(query[a])
        for digit in signed_digits(abs(q)):
            # what is subtracted is added complemented, which shifts all scores alike
            minus = (digit < 0) != (q < 0)
            at = ~digit if digit < 0 else digit
            for b in range(width):
                columns[at + b].append(inverse[a, b] if minus else slices[a, b])
    out: list[np.ndarray | None] = []
    for w in range(len(columns) - 1):
        own = columns[w]
        while len(own) > 2:
            x, y, z = own.pop(), own.pop(), own.pop()
            both = x ^ y
            own.insert(0, both ^ z)
            columns[w + 1].append((x & y) | (both & z))
        if len(own) == 2:
            x, y = own
            columns[w + 1].append(x & y)
            own = [x ^ y]
        out.append(own[0] if own else None)
    while out and out[-1] is None:
        out.pop()
    return out


def top_rows(score: list[np.ndarray | None], wanted: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of the k best of the rows in bitmap `wanted`, in row order; ties at the boundary go to lower rows."""
    sure, maybe = np.zeros_like(wanted), wanted.copy()
    for plane in reversed(score):
        if plane is None:
            continue
        here = maybe & plane
        n = int(np.bitwise_count(sure | here).sum())
        if n > k:
            maybe = here
        else:
            sure |= here
            maybe &= ~plane
            if n == k:
                maybe[:] = 0
                break
    rows = lambda bitmap: np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))
    certain = rows(sure)
    return np.sort(np.concatenate((certain, rows(maybe)[: max(0, k - len(certain))])))


def exact_products(query: np.ndarray, values: np.ndarray) -> list[int]:
    """Inner products of a vector with the columns of `values`, by whole numbers of any size where longs might not do."""
    if not values.size:
        return []
    most = max(abs(int(query.min())), abs(int(query.max()))) * max(abs(int(values.min())), abs(int(values.max())))
    if most * len(query) < _LONG:
        return (query @ values).tolist()
    return (query.astype(object) @ values.astype(object)).tolist()


def quantised(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v): floor(256 * component) as longs, for rows that take part."""
    v = F.col("embedding").cast("array<double>")
    usable = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("e")).where(
        F.col("vec_id").isNotNull() & F.col("e").isNotNull()).where(
        F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST / SCALE)))
    return usable.select("vec_id", F.transform("e", lambda x: F.floor(x * SCALE)).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    lists = column.to_pylist()
    out = np.zeros((len(lists), width), np.int64)
    for k, v in enumerate(lists):
        out[k, : len(v)] = v
    return out


def top_inner_products(embeddings: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k rows of `embeddings` with the highest inner product of the
    vectors floor(256 * component), ties to the smaller id; rows with the query's own id are no candidates.

    `queries` has the columns of `embeddings`. Vectors that are null, or hold a null or non-finite component, take no part
    (nor one beyond LARGEST / SCALE, which is no long), nor do rows without an id. Shorter vectors count as filled up
    with zeros. Rows that repeat an id are candidates each, and as queries share one result. A score beyond a long comes
    out as the nearest long, in its right place. Other columns are ignored; empty tables give no rows.
    """
    numbered = lambda df: cut_lineage(quantised(df).withColumn("row", F.monotonically_increasing_id()))
    rows, asked = numbered(embeddings), numbered(queries)
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    width = max(1, facts["width"] or 1)
    # blocks take rows by number, so that no id crowds one; each meets all queries, a stated set, group by group
    blocks = max(1, -(-facts["n"] // BLOCK_ROWS))
    n_asked = asked.count()
    # a block is copied once per group: as few groups as keep all cores busy, of bounded size
    tasks = 2 * embeddings.sparkSession.sparkContext.defaultParallelism
    groups = max(1, -(-n_asked // MOST_QUERY_ROWS), min(-(-n_asked // QUERY_ROWS), -(-tasks // blocks)))
    placed = rows.select(F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block"), "vec_id", "v")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, values = None, [], []

        def built() -> pa.RecordBatch:
            i, v = np.concatenate(ids), np.concatenate(values)
            by = np.argsort(i, kind="stable")
            slices, least = slices_of(v[by])
            return pa.RecordBatch.from_arrays([
                pa.array([block], pa.int64()), pa.array([slices.shape[1]], pa.int32()), pa.array([i[by].tobytes()]),
                pa.array([least.tobytes()]), pa.array([slices.tobytes()])], names=["block", "bits", "ids", "least", "slices"])

        for batch in batches:
            own = batch.column("block").to_numpy()
            i, v = batch.column("vec_id").to_numpy(), _matrix(batch.column("v"), width)
            cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)] if len(own) else []
            for a, b in zip(cuts, cuts[1:]):
                if block is not None and own[a] != block:
                    yield built()
                    ids, values = [], []
                block = int(own[a])
                ids.append(i[a:b])
                values.append(v[a:b])
        if block is not None:
            yield built()

    built = placed.repartition(blocks, "block").sortWithinPartitions("block").mapInArrow(
        index, "block long, bits int, ids binary, least binary, slices binary")
    built = cut_lineage(built)
    grouped = asked.withColumn("g", F.pmod(F.xxhash64("row", F.lit("query")), F.lit(groups))).groupBy("g").agg(
        F.collect_list(F.struct("vec_id", "v")).alias("queries"))
    # every block meets every group of queries once: an equality join on the pair of their numbers
    left = built.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    right = grouped.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, least = (np.frombuffer(batch.column(c)[r].as_py(), np.int64) for c in ("ids", "least"))
                bits = batch.column("bits")[r].as_py()
                slices = np.frombuffer(batch.column("slices")[r].as_buffer(), np.uint64).reshape(width, bits, -1)
                full = np.zeros(slices.shape[2] * 64, np.uint8)
                full[: len(ids)] = 1
                full = np.packbits(full, bitorder="little").view(np.uint64)
                inverse = ~slices
                asked_ids, picks, scores = [], [], []
                for query in batch.column("queries")[r].as_py():
                    q = np.zeros(width, np.int64)
                    q[: min(width, len(query["v"]))] = query["v"][:width]
                    wanted = full
                    own = np.arange(*(np.searchsorted(ids, query["vec_id"], side) for side in ("left", "right")))
                    if len(own):
                        wanted = full.copy()
                        np.bitwise_and.at(wanted, own >> 6, ~(np.uint64(1) << (own & 63).astype(np.uint64)))
                    best = top_rows(add_slices(q, slices, inverse), wanted, k)
                    asked_ids += [query["vec_id"]] * len(best)
                    picks.append(ids[best])
                    word, bit = best >> 6, (best & 63).astype(np.uint64)
                    above = sum(((slices[:, b, word] >> bit & np.uint64(1)) << np.uint64(b) for b in range(bits)),
                                np.zeros((width, len(best)), np.uint64))
                    values = (least.view(np.uint64)[:, None] + above).view(np.int64)
                    scores.append(exact_products(q, values))
                flat = np.concatenate(picks) if picks else np.zeros(0, np.int64)
                true = [x for s in scores for x in s]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(asked_ids, pa.int64()), pa.array(flat), pa.array([x >> 63 for x in true], pa.decimal128(38, 0)),
                     pa.array([x & _LONG - 1 for x in true], pa.int64())], names=["query_id", "vec_id", "high", "low"])

    found = left.join(right, ["block", "g"]).repartition(max(blocks * groups, 1), "block", "g").mapInArrow(
        search, "query_id long, vec_id long, high decimal(38,0), low long")
    order = Window.partitionBy("query_id").orderBy(F.desc("high"), F.desc("low"), "vec_id")
    score = F.when(F.col("high") > 0, F.lit(_LONG - 1)).when(F.col("high") < -1, F.lit(-_LONG)).when(
        F.col("high") == 0, F.col("low")).otherwise(F.col("low") + F.lit(-_LONG))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", score.alias("score"))
