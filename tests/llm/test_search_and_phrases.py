"""Phrases, byte-level BPE and ranked search against plain versions, on nulls, ties, repeats, long texts and clashing columns."""

import base64
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tallyweave.llm import pair_maxscore, rank_queue, setm

SCHEMA = "doc_id long, text string, lang string, score string, rank string, a string, ids string, query string, word string"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def rows_of(texts):
    return [(i if i % 11 != 7 else None, t, ["en", "de", None, "und"][i % 4], "x", "x", "x", "x", "x", "x") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdé") for _ in range(rnd.randrange(1, 5))) for _ in range(25)]
    say = lambda n: "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", ", ", ".\n", "\t", "! "]) for _ in range(n))
    out = [None, "", " \n ", ".;", "É", "One WORD", "Hot Dog " * 40, "hot dog stand " * 30, "漢字かな交じり文" * 5, "\x00 a\x1cb \xa0c"]
    out += [say(rnd.randrange(1, 200)) for _ in range(60)]
    return [*out, out[20], out[20], "x" * 3000, say(30_000)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(rows_of(texts), SCHEMA).repartition(5)


# --- phrases -----------------------------------------------------------------------------------------------------

def plain_collocations(rows, least, longest, top, share):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        frequent = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        around = Counter()
        for p, a in frequent.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    around[p[i:i + k]] = max(around[p[i:i + k]], a)
        found = []
        for p, a in frequent.items():
            if p in around and 100 * around[p] >= share * a:
                continue
            score, _, left, right = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]])
                                        for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.mark.parametrize("least,longest,top,share,block,bits", [
    (10, 3, 2000, 50, 2_500_000, 1 << 20), (3, 3, 20, 80, 300, 64), (4, 5, 2000, 50, 50, 1 << 12), (10, 2, 7, 50, 1000, 1 << 12)])
def test_collocations_against_counting(docs, texts, least, longest, top, share, block, bits):
    got = setm.collocations(docs, least, longest, top, share, block_words=block, filter_bits=bits)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain_collocations(rows_of(texts), least, longest, top, share)


def test_collocations_of_little(spark, docs):
    for some in (docs.where("false"), docs.where("text IS NULL OR text = ''"), docs.limit(1).withColumn("text", F.lit("a b c"))):
        assert setm.collocations(some).count() == 0


def test_scores_beyond_64_bits(spark):
    levels = [spark.createDataFrame([(1, 3_000_000_000_000), (2, 2_999_999_999_999)], "w1 long, a long"),
              spark.createDataFrame([(1, 2, 2_999_999_999_998)], "w1 long, w2 long, a long")]
    row = setm._scored(levels, 2).first()
    assert row["score"] == 1000000 * 2_999_999_999_998 ** 2 // (3_000_000_000_000 * 2_999_999_999_999)


def test_colliding_word_ids_take_the_next_seed(docs, texts, monkeypatch):
    true = setm.xxhash.xxh64_intdigest
    monkeypatch.setattr(setm, "word_relation", lambda d, seed, block, make=setm.word_relation: (
        made := make(d, seed, block), made.withColumn("ids", F.transform("ids", lambda x: x % 5)) if seed == 0 else made)[1])
    got = sorted(map(tuple, setm.collocations(docs).collect()))
    assert true is setm.xxhash.xxh64_intdigest and got == plain_collocations(rows_of(texts), 10, 3, 2000, 50)


def test_one_pair_in_every_block(spark):
    crowded = spark.createDataFrame([(i, "of the " * 5 + f"w{i} ", "en") for i in range(400)], "doc_id long, text string, lang string")
    got = sorted(map(tuple, setm.collocations(crowded, block_words=20).collect()))
    assert got and got == plain_collocations([(i, "of the " * 5 + f"w{i} ", "en") for i in range(400)], 10, 3, 2000, 50)


def test_groups_are_added_up_before_they_are_dealt_out(spark, monkeypatch):
    # one task of 400 blocks sends each pair once, or once for every few groups held; the counts are those of all blocks
    rows = [(i, "of the " * 5 + f"w{i} ", "en") for i in range(400)]
    crowded = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    relation = setm.word_relation(crowded, 0, 20).withColumnRenamed("ids", "w1").localCheckpoint()
    levels = [relation.select(F.explode("w1").alias("w1")).distinct()]
    every = spark.sparkContext.broadcast(setm.frequent_filter(levels[0], ["w1"], 1 << 20))
    for held, most in ((1 << 20, 1), (100, 40)):
        monkeypatch.setattr(setm, "HELD", held, raising=False)
        got = setm.group_counts(relation, 2, every).groupBy("w1", "w2").agg(F.sum("a").alias("a"), F.count("*").alias("n")).orderBy(F.desc("a")).limit(2).collect()
        assert [r.a for r in got] == [2000, 1600] and all(r.n <= most for r in got)


def test_bitmap_leaves_a_task_in_pieces(spark, monkeypatch):
    groups = spark.range(3000).select(F.xxhash64("id").alias("w1")).coalesce(1)
    whole = setm.frequent_filter(groups, ["w1"], 1 << 16)
    sizes = []
    real = type(groups).mapInArrow

    def spied(self, func, schema, *rest):
        made = lambda it: (s for b in func(it) for s in [setm.pa.RecordBatch.from_pydict({"slot": [b.num_rows], "mask": [1]})])
        sizes.extend(r.slot for r in real(self, made, schema).collect())
        return real(self, func, schema, *rest)

    monkeypatch.setattr(setm, "SLOTS", 64, raising=False)
    monkeypatch.setattr(type(groups), "mapInArrow", spied)
    assert (setm.frequent_filter(groups, ["w1"], 1 << 16) == whole).all() and whole.any()
    assert len(sizes) == 1024 // 64 and max(sizes) <= 64


# --- byte-level BPE ----------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_and_decoded_bytes(docs, texts, library):
    coded = rank_queue.round_trip(docs, RANKS, PATTERN)
    assert coded.columns == ["doc_id", "ids", "decoded"]
    encoded = rank_queue.encode(docs, RANKS, PATTERN)
    assert Counter(map(tuple, encoded.collect())) == Counter(map(tuple, coded.select("doc_id", "ids").collect()))
    assert Counter(map(tuple, rank_queue.decode(encoded, RANKS, PATTERN).collect())) == Counter(
        map(tuple, coded.select("doc_id", "decoded").collect()))
    want = Counter()
    for doc_id, text, *_ in rows_of(texts):
        ids = np.array(library.encode_ordinary(text or ""), "<u4")
        want[doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, rank_queue.digests(coded).collect())) == want
    assert rank_queue.encode(docs.where("false"), RANKS, PATTERN).count() == 0


def test_long_pre_tokens(library):
    rnd = random.Random(3)
    coder = rank_queue.coder(RANKS, PATTERN)
    for text in ("a" * 20_000, "ab" * 9_000, " " * 5_000, "".join(rnd.choice("abcéß漢") for _ in range(20_000))):
        ids = library.encode_ordinary(text)
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == ids
        assert coder.decode(coder.encode(text)) == text.encode()


def test_long_texts_are_cut_one_by_one(library, monkeypatch):
    monkeypatch.setattr(rank_queue, "LIST_CHARS", 10)
    text = "one two  three, don't stop 123 é漢\n\n"
    assert np.frombuffer(rank_queue.Coder(rank_queue.read_ranks(RANKS), PATTERN).encode(text), "<u4").tolist() == library.encode_ordinary(text)


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_merges_of_any_ranks(data):
    """Ranks in any order, also with a longer token before its parts: the least rank goes first, then the leftmost."""
    singles = [bytes((b,)) for b in range(256)]
    longer = data.draw(st.lists(st.binary(min_size=2, max_size=4).map(lambda b: bytes(97 + x % 3 for x in b)), max_size=12, unique=True))
    order = data.draw(st.permutations(singles[97:100] + longer))
    ranks = {t: r for r, t in enumerate([*order, *(s for s in singles if s not in order)])}
    piece = bytes(97 + x % 3 for x in data.draw(st.binary(min_size=1, max_size=30)))
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while len(parts) > 1 and piece not in ranks:
        least = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if least is None:
            break
        parts[least[1]:least[1] + 2] = [parts[least[1]] + parts[least[1] + 1]]
    want = [ranks[piece]] if piece in ranks else [ranks[p] for p in parts]
    assert rank_queue.Coder(ranks, "(?s).+", remembered=2).merge(piece) == want


def test_patterns_of_latin_texts(library):
    coder = rank_queue.coder(RANKS, PATTERN)
    text = "".join(a + chr(c) + b for c in range(rank_queue.LATIN + 1) for a, b in (("a", " b"), (" ", "1"), (".", "  ")))
    assert coder.cut_latin.findall(text) == coder.cut.findall(text)
    assert np.frombuffer(coder.encode(text), "<u4").tolist() == library.encode_ordinary(text)
    assert rank_queue.latin_pattern(r"\w+|\W") is None


def test_what_is_remembered_is_bounded():
    coder = rank_queue.Coder(rank_queue.read_ranks(RANKS), PATTERN, remembered=5)
    assert all(coder.decode(coder.encode(t)) == t.encode() for t in [f"word{i} other" * 3 for i in range(50)])
    assert len(coder.packed) <= 5


# --- ranked search -----------------------------------------------------------------------------------------------

def plain_ranks(rows, items, k):
    held = [(d, Counter(re.findall("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))))
            for d, t, *_ in rows]
    held = [(d, c) for d, c in held if c]
    count, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text, *_ in items:
        terms = set(re.findall("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
        found = []
        for d, c in held:
            m = 100 - 90 + (90 * sum(c.values()) * count) // length
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m))
                        for t in terms if c[t])
            found.append((-score, d is None, d or 0))
        out += [(item, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(x for x in found if x[0] < 0)[:k])]
    return Counter(out)


def items_of(texts):
    items = [(1, texts[30]), (2, texts[30]), (2, "Hot dog, stand?"), (3, None), (4, ""), (5, "unseen zzz"), (6, texts[-1][:4000]),
             (7, "É a"), (None, texts[40]), (8, "hot hot hot"), (9, texts[45] + texts[50])]
    return [(i, t, "x", "x") for i, t in items]


@pytest.mark.parametrize("chunk,queries,paired,k", [(8 << 20, 2 << 20, 16, 10), (200, 4000, 4, 3), (1, 1 << 20, 0, 1), (2000, 1 << 20, 40, 40)])
def test_search_against_all_scores(spark, docs, texts, chunk, queries, paired, k):
    items = spark.createDataFrame(items_of(texts), "item_id long, text string, doc_id string, score string")
    got = pair_maxscore.ranked_search(docs, items, k, chunk_bytes=chunk, query_bytes=queries, paired_terms=paired)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == plain_ranks(rows_of(texts), items_of(texts), k)


def test_search_of_empty_tables(spark, docs, texts):
    items = spark.createDataFrame(items_of(texts), "item_id long, text string, doc_id string, score string")
    for d, i in ((docs.where("false"), items), (docs, items.where("false")), (docs.where("text IS NULL OR text = ' \n '"), items)):
        assert pair_maxscore.ranked_search(d, i).count() == 0


def test_pair_bounds_skip_and_hold(texts):
    """Bounds of units are never below a document's share, are tighter than single bounds, and searches agree with all scores."""
    rnd = np.random.default_rng(4)
    terms = np.arange(30, dtype=np.int32)
    lists = [np.sort(rnd.choice(400, rnd.integers(1, 120), replace=False)).astype(np.int32) for _ in terms]
    gains = [rnd.integers(1, 1000, len(x)) for x in lists]
    dense = np.zeros((30, 400), np.int64)
    for t in terms:
        dense[t, lists[t]] = gains[t]
    keys, shared, at, joint = [], [], [], []
    for a in range(30):
        for b in range(a + 1, 30):
            both = np.intersect1d(lists[a], lists[b])
            if len(both):
                keys.append(a << 32 | b), shared.append(len(both)), at.append(both), joint.append(dense[a, both] + dense[b, both])
    chunk = pair_maxscore.Chunk(400, terms, np.array([len(x) for x in lists]), np.concatenate(lists), np.concatenate(gains),
                                np.array(keys), np.array(shared), np.concatenate(at), np.concatenate(joint))
    for trial in range(40):
        asked = sorted(rnd.choice(30, rnd.integers(1, 14), replace=False).tolist())
        units = chunk.units(asked, asked)
        assert sorted(t for _, u in units for t in u) == asked
        assert all(bound >= dense[list(u)].sum(0).max() for bound, u in units)
        assert sum(bound for bound, _ in units) <= sum(chunk.most[t] for t in asked)
        total = dense[asked].sum(0)
        best = np.sort(total[total > 0])[::-1][:5]
        docs, scores = chunk.search(asked, asked, 5, 1)
        assert (total[docs] == scores).all() and np.sort(scores)[::-1][:5].tolist() == best.tolist()
        kept = set(docs.tolist())
        assert len(best) < 5 or all(d in kept for d in np.flatnonzero(total >= best[-1]).tolist())
