"""Near duplicates by SimHash, found through deletion-variant signatures.

A fingerprint is cut into two segments. Fingerprints that differ in at most three bits have a segment that differs in
at most one, so they agree on one variant of that segment with a single bit wiped. Every distinct fingerprint is
indexed under its 64 variants and joined on equality; what shares a variant is verified bit by bit. A variant shared by
more fingerprints than one task should compare is refined by the same rule on the bits that are still free, until
2,048 fingerprints at most can share one. Copies never meet: only distinct fingerprints are indexed.

`keep_one` takes as candidates what fingerprints of five-word shingles link in this way, and counts the shingles that each
candidate pair shares. Texts that share 0.8 of their shingles differ in about 15% of the bits of any such fingerprint, which no
number of wildcards finds at bearable cost. Further candidates are therefore found by the least values of the shingles
under many hash functions, taken in bands, and counted likewise. Texts are compared within
a band's group, in pairs of blocks; what hangs together by chains of candidates only is never brought together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tallyweave.llm.common import FREED, components, forest, released, scratch_table, slices, stored, words_of
from tallyweave.scale import small
from tallyweave.session import cut_lineage
from tallyweave.streaming.events import settings

SEED = 42
#: Fingerprints of one bucket that a task compares with each other.
BUCKET = 2048
#: Bands of least values under which texts meet, and values in each: of pairs that share 0.8 of their shingles, 3 in a
#: million share no band.
BANDS, VALUES = 32, 5
#: Texts and shingles of a block; a task compares two blocks at most.
BLOCK_TEXTS, BLOCK_SHINGLES = 1024, 1 << 20
#: Bands whose groups are compared first; the others then compare only what is still apart.
FIRST_BANDS = 4

_RNG = np.random.default_rng(SEED)
_FLIP = _RNG.integers(0, 1 << 64, BANDS * VALUES, dtype=np.uint64)
_ODD = _RNG.integers(0, 1 << 64, BANDS * VALUES, dtype=np.uint64) | np.uint64(1)


def _majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[at:at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64 bits, each set in over half of the hashes of the word shingles; fewer words: of the whole sequence; none: 0."""
    hashes = _hashes(words_of(text), shingle)
    return _majority(hashes) if len(hashes) else 0


def _hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """A hash for each shingle; fewer words: one of the whole sequence; none: none."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(
        (ends - sizes)[: len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist())], dtype=np.uint64)


def shingle_set(text: str | None, shingle: int = 5) -> tuple[int, np.ndarray]:
    """The different hashes of a text's shingles in order, and a number for them all."""
    hashes = np.unique(_hashes(words_of(text), shingle))
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED), hashes


def bands_of(hashes: np.ndarray) -> np.ndarray:
    """A number for each band: a hash of the least values that the shingles have under its hash functions."""
    least = np.full(BANDS * VALUES, ~np.uint64(0))
    for at in range(0, len(hashes), 1024):
        least = np.minimum(least, ((hashes[at:at + 1024, None] ^ _FLIP) * _ODD).min(axis=0))
    bands = ((least ^ least >> np.uint64(32)) * _ODD[::-1]).reshape(BANDS, VALUES).sum(axis=1, dtype=np.uint64)
    return (bands ^ bands >> np.uint64(31)) * _ODD[0] + np.arange(BANDS, dtype=np.uint64)


def with_fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """`doc_id`, `fp` (the fingerprint as a signed long) of every row; null and blank texts have fingerprint 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000):
            prints = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, fp long")


def _variants(batches: Iterator[pa.RecordBatch], level: int) -> Iterator[pa.RecordBatch]:
    """Each fingerprint under all variants that fix one more segment but for a bit; `fixed` marks the bits agreed on."""
    width = 64 >> level
    segment = (1 << width) - 1
    for batch in released(batches):
        prints = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        fixed = batch.column("fixed").to_numpy(zero_copy_only=False).view(np.uint64)
        for block in range(0, 64, 2 * width):
            free = (fixed & np.uint64(((1 << 2 * width) - 1) << block)) == 0
            if not free.any():
                continue
            here, agreed = prints[free], fixed[free]
            for half in (block, block + width):
                for bit in range(width):
                    now = agreed | np.uint64((segment << half) ^ (1 << half + bit))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x.view(np.int64)) for x in (now, here & now, here)], names=["fixed", "value", "fp"])


def _near(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    for batch in released(batches):
        a, b = [], []
        for members in batch.column("members"):
            prints = np.unique(members.values.to_numpy(zero_copy_only=False).view(np.uint64))
            for at in range(0, len(prints) - 1, 256):
                left, right = prints[at:at + 256], prints[at + 1:]
                near = np.bitwise_count(left[:, None] ^ right[None, :]) <= max_bits
                i, j = np.nonzero(near & (np.arange(len(right))[None, :] >= np.arange(len(left))[:, None]))
                for x, y in forest(left[i].view(np.int64), right[j].view(np.int64)):
                    a.append(x)
                    b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def near_links(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` at most `max_bits` (0 to 3) bits apart.

    Every pair that near is connected by the links, directly or through others; a bucket gives fewer links than it has
    members.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("two segments find up to three differing bits")
    spark = prints.sparkSession
    links = spark.createDataFrame([], "a long, b long")
    # each fingerprint becomes 64 rows: spread them first, by another hash than the one that `prints` may be dealt by already
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = prints.select("fp", F.lit(0).cast("long").alias("fixed")).repartition(
        parts, F.xxhash64("fp", F.lit(parts)))
    for level in (1, 2, 3):
        keyed = rows.mapInArrow(lambda it, level=level: _variants(it, level), "fixed long, value long, fp long")
        # cut off, so that both sides of the join are plain exchanges and a frequent variant's rows can be split
        shared = cut_lineage(keyed.groupBy("fixed", "value").agg(F.count("*").alias("n")).where("n > 1"))
        shared = cut_lineage(keyed.join(shared, ["fixed", "value"]))
        fit = shared if level == 3 else shared.where(F.col("n") <= BUCKET)
        groups = fit.groupBy("fixed", "value").agg(F.collect_list("fp").alias("members")).select("members")
        links = links.unionAll(groups.mapInArrow(lambda it: _near(it, max_bits), "a long, b long"))
        rows = shared.where(F.col("n") > BUCKET).select("fp", "fixed")
        if level == 3 or rows.isEmpty():
            break
    return links.distinct()


def near_classes(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """(fp, root) for every distinct fingerprint that has a neighbour; the others are their own class."""
    distinct = prints.select("fp").distinct()
    return components(near_links(distinct, max_bits)).select(F.col("node").alias("fp"), "root")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """Per document: `doc_id`, `fingerprint` (16 hex digits), `component_id`, the smallest doc_id reachable over links.

    Null and blank texts have fingerprint zero and are linked like any other. Repeated rows each give a row. Documents
    without an id are linked too; a component of such documents alone has a null `component_id`. Other columns are
    ignored; an empty table gives no rows.
    """
    prints = cut_lineage(with_fingerprints(docs, shingle))
    with settings(docs.sparkSession, FREED):
        classes = near_classes(prints, max_bits)
    own = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = own.join(classes, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _similar_pairs(nodes: np.ndarray, roots: np.ndarray, own: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of nodes that share 0.8 of their shingles, as few as connect all that such pairs connect.

    Nodes of one root are connected already. Of two blocks (`own`) only pairs across them are compared, each block being
    compared with itself elsewhere. All overlaps of a set are counted at once, over postings of the shingles.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    shingles, code = np.unique(np.concatenate(sets), return_inverse=True)
    owners = np.repeat(np.arange(len(sets)), sizes)[np.argsort(code, kind="stable")]
    n = np.bincount(code, minlength=len(shingles))
    starts, ends = np.cumsum(n) - n, np.cumsum(sizes)
    labels, kept, across = np.unique(roots, return_inverse=True)[1], [], bool((own != own[0]).any())
    for y in range(len(sets)):
        others = labels != labels[y]
        if not others.any():
            continue
        mine = code[ends[y] - sizes[y]:ends[y]]
        count = n[mine]
        places = np.repeat(starts[mine] - np.cumsum(count) + count, count) + np.arange(count.sum())
        shared = np.bincount(owners[places], minlength=len(sets))
        near = others & (9 * shared >= 4 * (sizes + sizes[y]))
        if across:
            near &= own != own[y]
        for x in np.flatnonzero(near).tolist():
            if labels[x] != labels[y]:
                labels[labels == labels[x]] = labels[y]
                kept.append((int(nodes[x]), int(nodes[y])))
    return kept


def _verified_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in released(batches):
        pairs = []
        for members in batch.column("members"):
            node, root, own = (members.values.field(c).to_numpy(zero_copy_only=False) for c in ("node", "root", "own"))
            pairs += _similar_pairs(node, root, own, [np.frombuffer(x, np.uint64) for x in members.values.field("shingles").to_pylist()])
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _band_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between `node`s of a band's `value` that share 0.8 of their shingles (`sets`).

    Values whose nodes have one `root` give nothing, and of values with the same nodes one is compared. A value's nodes are
    compared in pairs of blocks, so that no task holds more than two blocks.
    """
    mark = [F.bit_xor(F.xxhash64("node", F.lit(seed))) for seed in (1, 2)]
    values = members.groupBy("value").agg(
        F.ceil(F.greatest(F.count("*") / BLOCK_TEXTS, F.sum("size") / BLOCK_SHINGLES, F.lit(1))).cast("int").alias("blocks"),
        F.count("*").alias("n"), F.min("node").alias("least"), *[m.alias(f"mark{k}") for k, m in enumerate(mark)],
        F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    # cut off, so that both sides of the join are plain exchanges and a frequent value's rows can be split
    chosen = cut_lineage(values.groupBy("n", "least", "mark0", "mark1", "blocks").agg(F.min("value").alias("value")))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    paired = members.join(small(chosen.select("value", "blocks")), "value").join(sets, "node").withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    groups = paired.groupBy("value", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")).agg(
        F.collect_list(F.struct("node", "root", "own", "shingles")).alias("members")).select("members")
    with settings(members.sparkSession, {"spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}):
        return cut_lineage(groups.mapInArrow(_verified_sets, "a long, b long").distinct())


def _prepared(docs: DataFrame, shingle: int) -> DataFrame:
    """`docs` as `row`, written once with a number `rid`, the number `node` of its set of shingles, that set's size, fingerprint
    and bands."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shingle_set(t, shingle) for t in batch.column("row").field("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("row"), pa.array(np.array([f[0] for f in found], np.uint64).view(np.int64)),
                pa.array([len(f[1]) for f in found], pa.int64()),
                pa.array(np.array([_majority(f[1]) for f in found], np.uint64).view(np.int64)),
                pa.array([bands_of(f[1]).tobytes() for f in found], pa.binary())], names=["row", "node", "size", "fp", "bands"])

    row = docs.withColumn("text", F.col("text").cast("string")).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    schema = row.select("row").schema.add("node", "long").add("size", "long").add("fp", "long").add("bands", "binary")
    return stored(row.mapInArrow(run, schema).withColumn("rid", F.monotonically_increasing_id()), "near")


def _print_groups(rows: DataFrame, max_bits: int = 2) -> DataFrame:
    """(band, value, node, size) of the sets that fingerprints link with others, directly or through others; the band is -1."""
    prints = cut_lineage(rows.select("node", "size", "fp").distinct())
    named = prints.join(near_classes(prints, max_bits), "fp", "left").select(
        F.lit(-1).alias("band"), F.xxhash64(F.coalesce("root", "fp"), F.lit("fp")).alias("value"), "node", "size")
    several = named.groupBy("value").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most")
    return cut_lineage(named.join(several.select("value"), "value").select("band", "value", "node", "size"))


def _candidates(rows: DataFrame) -> DataFrame:
    """(band, value, node, size) of all sets under the fingerprints' groups and the bands that they share with others."""
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            values = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.int64)
            repeated = [np.repeat(batch.column(c).to_numpy(zero_copy_only=False), BANDS) for c in ("node", "size")]
            bands = np.tile(np.arange(BANDS, dtype=np.int32), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (bands, values, *repeated)], names=["band", "value", "node", "size"])

    prints = cut_lineage(rows.select("node", "size", "bands").distinct())
    keyed = prints.mapInArrow(keys, "band int, value long, node long, size long")
    shared = cut_lineage(keyed.groupBy("value").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most"))
    return _print_groups(rows).unionAll(keyed.join(shared.select("value"), "value").select("band", "value", "node", "size"))


def set_links(rows: DataFrame, firsts: DataFrame, shingle: int = 5) -> DataFrame:
    """Links (a, b) between the numbers of shingle sets of which 0.8 is shared (intersection by union, counted).

    Sets that fingerprints link or that share a band are compared. What fingerprints and the first bands have linked already is not compared again in the others,
    where most groups are then one component and fall out. Only sets that have candidates are written, once each.
    """
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(t, shingle)[1].tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], names=["node", "shingles"])

    with scratch_table(_candidates(rows), "near_bands") as members:
        return _links_of(rows, firsts, members, hashed)


def _links_of(rows: DataFrame, firsts: DataFrame, members: DataFrame, hashed) -> DataFrame:
    wanted = members.select("node").distinct().join(firsts.select("node", F.col("best.rid").alias("rid")), "node")
    texts = rows.select("rid", F.col("row.text").alias("text")).join(small(wanted), "rid").select("node", "text")
    with scratch_table(texts.mapInArrow(hashed, "node long, shingles binary"), "near_sets") as sets:
        links = _band_links(members.where(F.col("band") < FIRST_BANDS).withColumn("root", F.col("node")), sets)
        roots = cut_lineage(components(links))
        rest = members.where(F.col("band") >= FIRST_BANDS).join(small(roots), "node", "left").withColumn("root", F.coalesce("root", "node")) \
            if FIRST_BANDS < BANDS else None
        return links if rest is None else links.unionAll(_band_links(rest, sets))


def keep_one(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """The documents without near duplicates: of each component the row with the smallest doc_id stays (no id: last).

    Texts are linked that share 0.8 of their different shingles. All columns of `docs` stay as they are. Exact repeats
    and blank texts count as duplicates of each other; of repeated rows one stays. An empty table gives no rows.
    """
    rows = _prepared(docs, shingle)
    with settings(docs.sparkSession, FREED):
        kept = _kept(rows, shingle)
    return rows.select("rid", "row").join(kept, "rid", "left_semi").select("row.*")


def _kept(rows: DataFrame, shingle: int) -> DataFrame:
    """`rid` of the row that stays of each component."""
    order = F.struct(F.col("row.doc_id").isNull().alias("none"), F.col("row.doc_id").alias("id"), F.xxhash64("row.text").alias("hash"), "rid")
    firsts = cut_lineage(rows.groupBy("node").agg(F.min(order).alias("best")))
    roots = components(set_links(rows, firsts, shingle))
    kept = firsts.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best"))
    return cut_lineage(kept.select(F.col("best.rid").alias("rid")))
