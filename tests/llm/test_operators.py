"""The operators for training data against plain versions on small inputs with nulls, ties, repeats and clashing columns."""

import ctypes
import hashlib
import os
import random
import re
import subprocess
import sys
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyweave.llm import (
    bitsliced, chat_format, decontaminate, html_text, langid, ngram_trie, packing, queries, simhash, suffix_dedup, toxicity)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, score string"


def rows_of(texts):
    return [(i if i != 7 else None, t, "xx" if i % 2 else "yy", "s", len(t or ""), 1, "x") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 7))) for _ in range(60)]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    shared, out = say(90), [None, "", " \n ", "É", "one word", "aaaa" * 300, "aaaa" * 300]
    for i in range(30):
        out.append(say(20) + ((" " + shared + " ") if i % 3 == 0 else " ") + say(rnd.randrange(1, 60)))
    return [*out, out[10], out[10], out[12] + " more", out[12].upper(), "ß ééé " + shared[100:520] + " ende", say(20000)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(rows_of(texts), SCHEMA)


def empty(docs):
    return docs.where("false")


def test_simhash_against_all_pairs(spark, docs, texts):
    got = simhash.near_duplicates(docs).collect()
    prints = []
    for t in texts:
        w = [x.encode() for x in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]
        s = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    ids = [r[0] for r in rows_of(texts)]
    root = list(range(len(ids)))
    for _ in ids:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if bin(a ^ b).count("1") <= 2:
                    root[i] = root[j] = min(root[i], root[j])
    least = {r: min((ids[k] for k in range(len(ids)) if root[k] == r and ids[k] is not None), default=None) for r in set(root)}
    want = Counter((i, f"{p:016x}", least[r]) for i, p, r in zip(ids, prints, root))
    assert Counter(map(tuple, got)) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() <= len(set(root))
    assert simhash.near_duplicates(empty(docs)).count() == 0


def test_near_links_in_crowded_buckets(spark, monkeypatch):
    rnd = random.Random(2)
    base = rnd.getrandbits(64)
    prints = list({base ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for _ in range(150)})
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    monkeypatch.setattr(simhash, "BUCKET", 4)
    got = {frozenset((a, b)) for a, b in simhash.near_links(df, 2).collect()}
    root = {p: p for p in prints}
    for _ in prints:
        for a in prints:
            for b in prints:
                if bin(a ^ b).count("1") <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    near = simhash.near_classes(df, 2).collect()
    mine = {}
    for fp, r in near:
        mine.setdefault(r, set()).add(fp % (1 << 64))
    want = {}
    for p, r in root.items():
        want.setdefault(r, set()).add(p)
    assert got and sorted(map(sorted, mine.values())) == sorted(sorted(s) for s in want.values() if len(s) > 1)


@pytest.mark.parametrize("core_limit", [2048, 1])
def test_repeats_against_counting(spark, docs, texts, monkeypatch, core_limit):
    monkeypatch.setattr(suffix_dedup, "CORE_LIMIT", core_limit)
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + 400] for d in data for i in range(len(d) - 399))
    want = Counter()
    for (doc_id, *_), d in zip(rows_of(texts), data):
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - 399):
            if seen[d[i:i + 400]] > 1:
                gone[i:i + 400] = True
        kept = bytes(b for b, g in zip(d, gone) if not g)
        want[doc_id, len(d), int(gone.sum()), int((gone[:-1] & ~np.concatenate(([False], gone[:-2]))).sum()) if len(d) else 0,
             hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")] += 1
    assert Counter(map(tuple, suffix_dedup.removal_report(docs).collect())) == want
    assert suffix_dedup.without_repeats(docs).columns == docs.columns
    assert suffix_dedup.removal_report(empty(docs)).count() == 0


def test_stage_cuts_passages_of_51_words(spark):
    """51 repeated words go, also where they are under 400 bytes and differ in white space or case; 50 words stay."""
    import corpus_pipeline

    rnd = random.Random(9)
    say = lambda n: [f"{rnd.randrange(36 ** 3):04x}" for _ in range(n)]
    long, short = say(51), say(50)
    texts = [say(30) + long + say(20), say(10) + [w.upper() for w in long] + say(40), say(30) + short + say(20), short + say(60), long]
    assert len(" ".join(long)) < 400
    rows = [(i, ("\n" if i else " ").join(t)) for i, t in enumerate(texts)] + [(5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_passages(spark, docs, "").collect()}
    split = lambda t: t.split()
    assert split(kept[0]) == texts[0][:30] + texts[0][81:] and split(kept[1]) == texts[1][:10] + texts[1][61:]
    assert kept[2] == rows[2][1] and kept[3] == rows[3][1] and 4 not in kept and kept[5] is None


def test_merged_transforms_sort_all_rows():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 3, (500, 4)).astype(np.uint64)
    shards = [suffix_dedup.shard_transform(rows[a:a + 120]) for a in range(0, 500, 120)]
    source, interval = suffix_dedup.merge_transforms(shards)
    place = [0] * len(shards)
    merged = []
    for s in source:
        merged.append(tuple(rows[120 * s + shards[s][1][place[s]]]))
        place[s] += 1
    assert merged == sorted(map(tuple, rows))
    assert interval[-1] + 1 == len(set(merged))


def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(np.round(rng.normal(0, 0.3, (300, 6)), 1))]
    rows += [(900, None), (901, [1.0, float("nan")]), (902, [None, 1.0]), (903, []), (904, [float("inf")]), (None, [1.0]), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = bitsliced.top_inner_products(df, df.where("vec_id % 50 = 0"), 5).collect()
    good = {i: np.floor(np.array([*v, *[0] * (6 - len(v))]) * 256).astype(int) for i, v in rows[:300] + [(903, [])]}
    want = []
    for q in range(0, 300, 50):
        best = sorted((-int(good[q] @ v), i) for i, v in good.items() if i != q)[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got)) == want
    assert bitsliced.top_inner_products(df.where("false"), df.where("false")).count() == 0


def test_chat(spark):
    rnd = random.Random(4)
    parts = [*chat_format.CONTROL, "\\", "<", "[", "ok", "\n", "é", " "]
    rows = [(c, t, rnd.choice(["user", "assistant", None, "system", chat_format.MARKER.format(0), "a\nb\\", "<|im_end|>\n"]), rnd.choice([None, "".join(rnd.choice(parts) for _ in range(rnd.randrange(9)))]))
            for c in (1, 2, None) for t in range(40)] + [(1, 3, "user", "again"), (1, 3, "user", "again")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("output", F.lit(1))
    got = {r["conv_id"]: r for r in chat_format.conversation_digests(chat_format.format_turns(chat_format.with_probe(df))).collect()}
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    for conv in (1, 2, None, -1):
        own = sorted((t, r or "", x or "") for c, t, r, x in rows if c == conv)
        loss = "".join(x for _, r, x in own if r == "assistant")
        g = got[conv]
        assert g["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert (g["n_turns"], g["loss_chars"], g["loss_sha256"]) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert g["rewrites"] == 0
    none = chat_format.format_turns(df.where("conv_id = 99"))
    assert none.count() == 0 and chat_format.conversation_digests(none).count() == 0
    with pytest.raises(ValueError):
        chat_format.read_tagged("x" + chat_format.tagged([("user", "a")]))
    assert chat_format.read_tagged(chat_format.tagged([("a\n", "<|im_end|>\n"), ("", "\\")]) + "<|im") == (
        [("a\n", "<|im_end|>\n"), ("", "\\")], "<|im")


def test_rewriting_templates_are_found():
    renderer = chat_format.Renderer(lambda turns: f"{len(turns)}:" + "".join(t for _, t in turns))
    assert [renderer.add("user", t)[3] for t in ("a", "b")] == [False, True]
    for text in ["", *chat_format.CONTROL, "<\\/s>", "a\\", "<<s>"]:
        assert chat_format.unescape(chat_format.escape(text)) == text
        assert not any(c in chat_format.escape(text) for c in chat_format.CONTROL)


def test_long_conversations_render_true_prefixes(spark):
    """Turns past the bound of turn-local templates are still rendered from the first turn on."""
    def numbered(turns):
        return "".join(f"{k}:{t};" for k, (_, t) in enumerate(turns))

    def shortened(turns):
        return "".join(f"{t[:1] if len(turns) - k > 40 else t};" for k, (_, t) in enumerate(turns))

    turns = [("user", f"text {k}") for k in range(90)]
    rows = spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    got = chat_format.format_turns(rows, numbered).orderBy("place").collect()
    assert [r["output"] for r in got] == [f"{k}:text {k};" for k in range(90)] and not any(r["rewritten"] for r in got)
    renderer = chat_format.Renderer(shortened)
    assert [renderer.add(*t)[3] for t in turns] == [k >= 40 for k in range(90)]
    assert renderer.output == shortened(turns)
    with pytest.raises(ValueError):
        chat_format.Renderer(chat_format.turn_local(numbered))


def test_packing(spark, docs, texts):
    path = queries.tokenizer_path()
    encoder = packing.Encoder(path)
    got = packing.pack(docs.union(spark.createDataFrame([(99, "日本 <|endoftext|> ½\x1c x", "", "", 1, 1, "")], SCHEMA)), path, chunk_tokens=9000).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for doc_id, text in [(9, texts[9]), (len(texts) - 1, texts[-1]), (0, None), (1, ""), (99, "日本 <|endoftext|> ½\x1c x")]:
        pieces = sorted(by_doc[doc_id], key=lambda r: r["start"])
        ids = np.frombuffer(b"".join(r["ids"] for r in pieces), "<u4").tolist()
        assert ids == encoder.own.encode(text or "", add_special_tokens=False).ids + [1] and pieces[0]["doc_tokens"] == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert packing.pack(docs.where("false"), path).count() == 0


def test_best_fit_is_tightest():
    rnd = random.Random(8)
    sizes = [rnd.randrange(1, 65) for _ in range(400)]
    placed, rooms = packing.best_fit_decreasing(sizes, 64), {}
    for k in sorted(range(400), key=lambda k: (-sizes[k], k)):
        fits = [room for room in rooms.values() if room >= sizes[k]]
        window = placed[k][0]
        assert rooms.get(window, 64) == (min(fits) if fits else 64) and (window in rooms) == bool(fits)
        rooms[window] = rooms.get(window, 64) - sizes[k]


def test_trie_scores(spark, docs, texts):
    got = ngram_trie.held_out_scores(docs).collect()
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\n"]
    known = Counter()
    for i, t, *_ in rows_of(texts):
        if zlib.crc32(str("" if i is None else i).encode()) % 10:
            known.update(tokens(t))
    n, v, by_id = sum(known.values()), len(known), {r["doc_id"]: r for r in got}
    for i, t, *_ in rows_of(texts):
        own = tokens(t)
        r = by_id[i]
        base = sum(np.log10((known[x] + 0.1) / (n + 0.1 * (v + 1))) for x in own)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(known[x] > 0 for x in own), n)
        assert r["base_score"] == pytest.approx(base) and np.isfinite(r["score"])
    assert ngram_trie.held_out_scores(empty(docs)).count() == 0


def test_trie_keeps_phrases_seen_once_or_twice(spark):
    """A phrase that training texts hold once or twice scores better than the same words in an order never seen."""
    rnd = random.Random(12)
    say = lambda n: [f"w{rnd.randrange(400)}" for _ in range(n)]
    twice, once = say(12), say(12)
    texts = [" ".join(say(60)) for _ in range(60)] + [" ".join(say(20) + twice + say(20)) for _ in range(2)] + [" ".join(say(20) + once)]
    files = ngram_trie.build_trie(spark.createDataFrame([(t,) for t in texts], "text string"))
    asked = [" ".join(w) for p in (twice, once) for w in (p, p[::-1])]
    found = ngram_trie.score(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), files, "doc_id").collect()
    score = {r["doc_id"]: r["score"] for r in found}
    assert score[0] > score[1] + 1 and score[2] > score[3] + 0.3


def test_trie_lies_on_disk_once(spark, monkeypatch):
    """Each part of a level is one file of the shared folder, which executors map as it is; a store gives the same scores."""
    texts = [" ".join(f"w{(i * j) % 97}" for j in range(i % 50)) for i in range(200)]
    trained = spark.createDataFrame([(t,) for t in texts], "text string")
    asked = spark.createDataFrame(list(enumerate(texts[:40])), "doc_id long, text string")
    files = ngram_trie.build_trie(trained)
    score = lambda names: sorted(map(tuple, ngram_trie.score(asked, names, "doc_id").collect()))
    found = score(files)
    for level in files:
        folder = Path(*level)
        assert folder.is_dir() and {p.suffix for p in folder.iterdir()} == {".bin", ".json"}
    monkeypatch.setattr(ngram_trie, "_mounted", lambda spark, path: None)
    stored = ngram_trie.build_trie(trained)
    assert all(name.endswith(".parquet") for level in stored for name in level) and score(stored) == found


def test_workers_give_freed_memory_back():
    """A worker lives on between tasks: what its texts have taken must not stay with it."""
    code = """if True:
        import re
        import numpy as np, pyarrow as pa
        from tallyweave.llm.common import slices
        taken = lambda: int(re.search(r"Anonymous:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024
        kept, before = [], taken()
        for batch in slices(iter([pa.record_batch([pa.array([1])], names=["x"])])):
            # 100 MB, of which a little scattered over all of it stays
            parts = [np.ones(2000, np.uint8) for _ in range(50_000)]
            kept += parts[::500]
            del parts
        print(taken() - before)
    """
    if not os.path.exists("/proc/self/smaps_rollup") or not hasattr(ctypes.CDLL(None), "malloc_trim"):
        pytest.skip("needs Linux and glibc")
    left = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": os.getcwd()})
    assert float(left.stdout) < 60


def test_packed_numbers():
    rng = np.random.default_rng(4)
    for values in ([], [7], [0, 1 << 63, (1 << 64) - 1], np.sort(rng.integers(0, 1 << 50, 900))):
        values = np.array(values, np.uint64)
        assert (ngram_trie.unpacked(ngram_trie.packed(values, True)) == values).all()
        assert (ngram_trie.unpacked(ngram_trie.packed(values[::-1])) == values[::-1]).all()


def test_elias_fano():
    rng = np.random.default_rng(6)
    for top in (5, 1000, 1 << 40):
        values = np.sort(rng.integers(0, top, 700).astype(np.uint64))
        ef = ngram_trie.EliasFano(ngram_trie.EliasFano.encode(values))
        assert (ef.access(np.arange(700)) == values).all()
        wanted = np.concatenate((values.astype(np.int64), rng.integers(0, top, 300)))
        assert (ef.successor(wanted) == np.searchsorted(values, wanted.astype(np.uint64))).all()


def test_elias_fano_finds_values_with_one_select(monkeypatch):
    rng = np.random.default_rng(7)
    for bunch in ([], range(5000, 5300), range(1 << 40, (1 << 40) + 5000, 3)):
        values = np.unique(np.concatenate((rng.integers(0, 1 << 41, 900), np.array(bunch, np.int64)))).astype(np.uint64)
        ef = ngram_trie.EliasFano(ngram_trie.EliasFano.encode(values))
        wanted = np.concatenate((values.astype(np.int64), rng.integers(0, 1 << 42, 500), np.array([0, 5300, int(values[-1]) + 1])))
        selects, select = [], ngram_trie.EliasFano._select
        monkeypatch.setattr(ngram_trie.EliasFano, "_select", lambda self, k, of_ones: selects.append(len(k)) or select(self, k, of_ones))
        found = ef.find(wanted)
        monkeypatch.undo()
        place = {v: k for k, v in enumerate(values.tolist())}
        assert found.tolist() == [place.get(v, -1) for v in wanted.tolist()]
        # a second one only for values that share their high bits with 63 others or more
        assert sum(selects) <= len(wanted) + 1 + (len(bunch) + 3 if len(bunch) else 0)
    assert ngram_trie.EliasFano(ngram_trie.EliasFano.encode(np.zeros(0, np.uint64))).find(np.array([0, 5])).tolist() == [-1, -1]


def test_languages(spark, docs):
    got = langid.held_out_languages(docs).collect()
    assert all(r["lang_pred"] in ("xx", "yy", "und") and 0 <= r["score"] <= 1 for r in got)
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {0, 1, 2}
    assert langid.known_languages(docs).columns == docs.columns
    assert langid.held_out_languages(empty(docs)).count() == 0


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    found = queries.op8_language(spark, folder).join(queries.table(spark, folder, "documents").select("doc_id", "lang"), "doc_id")
    assert found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    scored = queries.op5_toxicity(spark, folder).join(queries.table(spark, folder, "labels"), "doc_id")
    right = scored.where("held_out").agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).first()[0]
    assert right > 0.9


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.held_out_toxicity(docs.union(spark.createDataFrame([(50, "You idiot, you moron", "", "", 1, 1, "")], SCHEMA)), none).collect()
    assert {r["doc_id"] for r in got if r["predicted"]} == {50}


def test_decontamination(spark, docs, texts):
    words = texts[9].split()
    items = [(1, f"{' '.join(words[:15])}. {' '.join(words[15:20])}"), (2, None), (3, ""), (4, "nowhere to be found in any of these at all"), (5, "É")]
    got = decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert (9, 1) in {(r["doc_id"], r["item_id"]) for r in got} and not {r["item_id"] for r in got} & {2, 3, 4}
    assert decontaminate.clean(docs, spark.createDataFrame([], "item_id long, text string")).count() == len(texts)
    index = decontaminate.Index([(k, " ".join(random.Random(k).choices(texts[-1].split(), k=40))) for k in range(150)])
    for k in range(150):
        terms = sorted({index.terms[w] for w in index.words[k]})
        sums = Counter()
        for t in terms:
            for item, share in zip(*index.postings[t][:2]):
                sums[int(item)] += share
        assert sorted(i for i, _ in index.search(terms)) == sorted(i for i, s in sums.items() if s >= index.threshold)


def test_page_text(spark):
    page = ("<html><head><title>no</title><script>var a = '</p>';</script></head><body><nav><a href=x>menu</a></nav><div class='ad'>buy</div>"
            "<article><h1>Head &amp; tail</h1><p><b>First\n  words<br>go<p>Is.</p><aside>beside</aside><form>mail</form>"
            "<div id='comments'>said a reader</div></article><footer>&copy; me</footer>")
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (1, "u", page), (4, "u", "<article><p>open <a href='")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect()
    assert [r["text"] for r in got[:4]] == ["Head & tail\nFirst words go\nIs.", "", "", got[0]["text"]]
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_pipeline_stages(spark, docs):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name
    packed = corpus_pipeline.run(spark, folder)
    assert packed.count() > 0 and packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_keep_one_finds_copies_of_four_fifths(spark):
    """Copies with 0.8 of the shingles and more fall to one each; unrelated texts of the same words stay."""
    rnd = random.Random(11)
    vocabulary = [f"word{k}" for k in range(3000)]
    texts, expected = [], []
    for base in range(40):
        words = rnd.choices(vocabulary, k=250)
        expected.append(len(texts))
        texts.append(" ".join(words))
        for _ in range(4):
            copy = list(words)
            for at in (20, 120, 220):
                copy[at + rnd.randrange(20)] = rnd.choice(vocabulary)
            texts.append(" ".join(copy))
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, node string")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == expected


@pytest.mark.parametrize("blocks", [False, True])
def test_keep_one_finds_appended_paragraphs(spark, monkeypatch, blocks):
    """Copies with a fifth of their shingles appended go (0.8 is counted, not estimated), those with a quarter to spare stay."""
    if blocks:
        monkeypatch.setattr(simhash, "BLOCK_TEXTS", 1)
    rnd = random.Random(21)
    say = lambda n: [f"word{rnd.randrange(3000)}" for _ in range(n)]
    texts, expected = [], []
    for n in (60, 250, 600):
        for _ in range(20):
            base = say(n + 4)
            expected += [len(texts), len(texts) + 2, len(texts) + 3]
            other = say(n + 4)
            texts += [base, base + say(n // 4), other, other + say(n // 4 + 2)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == expected


def brute_kept(rows, shingle=5):
    """Rows that stay by comparing all pairs, linked where 0.8 of the different shingles is shared."""
    sets = [frozenset(simhash.shingle_set(t, shingle)[1].tolist()) for _, t in rows]
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 10 * len(a & sets[j]) >= 8 * len(a | sets[j]) > 0:
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    best = {}
    for k, (doc_id, _) in enumerate(rows):
        order = (doc_id is None, doc_id or 0)
        best[root[k]] = min(best.get(root[k], order), order)
    return Counter(None if none else i for none, i in best.values())


@pytest.mark.parametrize("block, first", [(1024, 4), (3, 1), (2, 32)])
def test_keep_one_against_all_pairs(spark, monkeypatch, block, first):
    """Chains of edits, nulls, blanks, repeated rows and ids, in whole groups and in pairs of small blocks."""
    monkeypatch.setattr(simhash, "BLOCK_TEXTS", block)
    monkeypatch.setattr(simhash, "FIRST_BANDS", first)
    rnd = random.Random(8)
    vocabulary = [f"w{k}" for k in range(900)]
    rows = [(None, "no id at all"), (None, "no id at all"), (5, None), (6, ""), (7, " \n"), (8, "one two"), (8, "three four"), (9, "ONE two")]
    for base in range(12):
        words = rnd.choices(vocabulary, k=rnd.choice((30, 120, 400)))
        for step in range(8):
            rows.append((100 * base + 50 - 3 * step, " ".join(words)))
            for _ in range(max(1, len(words) // 60)):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
    rows += rows[20:30]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rid", F.lit("x")).withColumn("row", F.lit(1)).repartition(5)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == brute_kept(rows)
    assert simhash.keep_one(empty(docs)).count() == 0


def test_boilerplate_chains_stay_apart(spark):
    """5,000 unrelated texts under few license texts, near one another by chains of shared bands only, all stay."""
    rnd = random.Random(4)
    licence = [[f"l{k}x{i}" for i in range(60)] for k in range(10)]
    texts = [" ".join([*licence[i % 10][:50], *licence[(i + 1) % 10][10:], *(f"t{rnd.randrange(10 ** 9)}" for _ in range(60))]) for i in range(5000)]
    docs = spark.createDataFrame(list(enumerate([*texts, *(t + " end" for t in texts[:500])])), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == list(range(5000))


def test_wide_components_and_repeated_ids(spark, monkeypatch):
    """Every finite vector takes part, each row of a repeated id as well; scores may be beyond a long."""
    monkeypatch.setattr(bitsliced, "BLOCK_ROWS", 8)
    rnd = random.Random(6)
    rows = [(0, [70000.0, 1.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (50, [1.0, 2.0]), (3, [3.0, 1.0]), (3, [0.1, 0.1]),
            (4, [-2e15, 3.5]), (5, [4e15, -1e9]), (100, [1.5e15, 2.0]), (100, [-0.5, 0.25]), (150, [-3e9, 1.0])]
    rows += [(i, [rnd.uniform(-1e5, 1e5), rnd.uniform(-1, 1)]) for i in range(6, 40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = [(i, [int(np.floor(256 * x)) for x in e]) for i, e in rows]
    want = []
    for query in sorted({i for i, _ in whole if i % 50 == 0}):
        pairs = sorted((-sum(a * b for a, b in zip(q, v)), i) for qi, q in whole if qi == query for i, v in whole if i != query)
        want += [(query, r + 1, i, max(-2**63, min(2**63 - 1, -s))) for r, (s, i) in enumerate(pairs[:5])]
    got = bitsliced.top_inner_products(df, df.where("vec_id % 50 = 0"), 5).collect()
    assert sorted(map(tuple, got)) == want


def test_markup_without_end_is_read_once():
    start = time.perf_counter()
    for page in ("<a " * 100_000, "<script " * 100_000, "<p>x" + "<a \">" * 100_000 + "'", "<div>" * 50_000 + "</section>" * 50_000,
                 "<!--" * 100_000, "<a b='" * 60_000 + ">", "<!x" * 100_000, "<style>" * 50_000, "</script" * 50_000 + ">"):
        html_text.blocks_of(page)
    assert time.perf_counter() - start < 20
    texts = lambda page: [b.text for b in html_text.blocks_of(page)]
    assert texts("<p>1 < 2 <a href='x>y'>z</a><!-- > --><b class=\"q>\">w</b> <script>if (a<b) </p></script >t<i") == ["1 < 2 zw t<i"]
    assert texts("<p title=\"x>one<p>two") == ["one", "two"] and texts("a<!--b") == ["a"] and texts("a<style>b") == ["a"]


def test_attributes_of_paragraphs_and_containers(spark):
    body = "<p>" + "Plain words of the article that go on and on. " * 6 + "</p>"
    said = " ".join(("Plain words of the article that go on and on. " * 6).split())
    pages = {f"<article>{body}<p class='advert'>Buy this now</p><h2 class=newsletter>Sign up</h2><p hidden>gone</p>{body}</article>": f"{said}\n{said}",
             f"<article><div class='article-share-body'>{body}</div></article>": said,
             f"<article><div class='main header-offset'>{body}</div></article>": said,
             f"<article>{body}<div class='share-buttons'>Share it</div></article>": said}
    got = html_text.extract(spark.createDataFrame([(i, "u", h) for i, h in enumerate(pages)], "page_id long, url string, html string"))
    assert [r.text for r in got.orderBy("page_id").collect()] == list(pages.values())
    assert html_text.extract(got.selectExpr("page_id", "url", "text AS html").where("false")).count() == 0


def test_keep_one_goes_by_linked_fingerprints(spark, monkeypatch):
    # without bands, the fingerprints' links alone bring copies together; the shared shingles decide
    monkeypatch.setattr(simhash, "bands_of", lambda hashes: np.random.default_rng(int(hashes.sum() >> np.uint64(1))).integers(0, 1 << 63, simhash.BANDS))
    words = [f"w{i}" for i in range(4000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:-1], "end"])), (3, " ".join(f"v{i}" for i in range(50)))],
                                 "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == [1, 3]


def shuffle_files(spark) -> int:
    """Shuffle files on disk, once those that are being removed are gone."""
    folders = [str(d) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    count = lambda: sum(len(list(Path(d).glob("*/shuffle_*"))) for d in folders)
    for _ in range(20):
        before = count()
        time.sleep(0.5)
        if count() == before:
            return before


@pytest.mark.parametrize("step", [
    lambda docs: suffix_dedup.repeated_spans(docs), lambda docs: simhash.keep_one(docs)], ids=["repeated_spans", "keep_one"])
def test_steps_leave_no_shuffle_files(spark, docs, step):
    before = shuffle_files(spark)
    held = step(docs)
    assert shuffle_files(spark) <= before, held


def test_cells_of_many_texts_leave_in_small_batches():
    rows = [{"tid": bytes([k % 256] * 16), "copies": 1, "text": "x" * 3000, "items": [
        {"core": j, "first": 48 * j, "starts": 48, "weight": 1} for j in range(20)]} for k in range(3000)]
    whole = pa.RecordBatch.from_pylist(rows)
    found = list(suffix_dedup._contexts(iter([whole]), 400))
    assert sum(b.num_rows for b in found) == 3000 * 20
    assert max(b.nbytes for b in found) < 4 << 20
