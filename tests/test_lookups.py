"""Searches and lookup tables: both ways of a search, and automata in blocks."""

import pytest

from tallyweave.operators import matching, retrieval


@pytest.mark.parametrize("limit", [0, 500_000])
def test_both_ways_of_a_search(spark, monkeypatch, limit):
    monkeypatch.setattr(retrieval, "WEIGHTS", limit)
    docs = spark.createDataFrame([(7, "alpha x"), (7, "beta y"), (8, "alpha alpha"), (9, None), (None, "alpha"), (10, "")],
                                 "doc_id long, text string")
    queries = spark.createDataFrame([(1, "Alpha beta"), (1, "beta"), (2, "gamma"), (3, None), (4, "y alpha")], "query_id long, text string")
    got = [(r.query_id, r.doc_id, round(r.score, 3), r.position) for r in
           retrieval.search_documents(queries, docs, 2).orderBy("query_id", "position").collect()]
    assert got == [(1, 7, 3.045, 1), (1, 8, 2.197, 2), (4, 7, 3.045, 1), (4, 8, 2.197, 2)]


@pytest.mark.parametrize("block", [1 << 20, 1500])
def test_lookup_table_of_any_length(spark, block):
    words = [f"w{i}" for i in range(300)]
    rows = [(i, [w, w.upper()] if i % 2 else [w, None], "note") for i, w in enumerate(words)] + [(900, None, "x"), (901, [""], "all"), (902, [], "none")]
    lookup = spark.createDataFrame(rows, "pos long, keywords array<string>, notes string")
    texts = [(1, "W12 and w7"), (2, None), (3, ""), (4, "nothing"), (1, "w299w5")]
    got = matching.match_keyword_table(spark.createDataFrame(texts, "id long, body string"), "body", lookup, block_bytes=block)
    assert got.columns == ["id", "body", "entry"]
    want = sorted((i, t, p) for i, t in texts if t is not None for p, terms, _ in rows
                  if any(k is not None and k in t.lower() for k in terms or ()))
    assert sorted((r.id, r.body, r.entry.pos) for r in got.collect()) == want
    assert matching.match_keyword_table(got.drop("entry"), "body", lookup.where("false")).count() == 0


def test_lookup_keywords_are_not_collected(spark, monkeypatch):
    # the driver gets a filter and the keywords' lengths, never a keyword; words of other texts and beyond Latin are told apart
    rows = [(i, [f"key{i:05d}", f"kéy{i}"]) for i in range(3000)] + [(5000, ["ab"]), (5001, ["αβγ" * 30])]
    lookup = spark.createDataFrame(rows, "pos long, keywords array<string>")
    texts = spark.createDataFrame([(1, "KEY00007key00007 kéy12"), (2, "key0000"), (3, "7a"), (4, "b" + "αβγ" * 31)], "id long, body string")
    collected = []
    real = type(texts).collect
    monkeypatch.setattr(type(texts), "collect", lambda self: collected.append(real(self)) or collected[-1])
    found = matching.match_keyword_table(texts, "body", lookup)
    monkeypatch.undo()
    assert all(len(part) < 100 for part in collected)
    assert sorted((r.id, r.entry.pos) for r in found.collect()) == [(1, 1), (1, 7), (1, 12), (4, 5001)]


def test_scores_leave_a_task_in_bounded_batches():
    import numpy as np
    import pyarrow as pa

    class Shared:
        value = ([f"q{i}" for i in range(200)], {"w": slice(0, 200)}, np.arange(200), np.ones(200))

    docs = pa.RecordBatch.from_pydict({"doc_id": list(range(2000)), "words": [["w"]] * 1999 + [None]})
    out = list(retrieval._scored_in_task(iter([docs]), Shared, None))
    assert max(b.num_rows for b in out) <= retrieval.PAIRS + 200 and sum(b.num_rows for b in out) == 1999 * 200
    assert out[0].slice(0, 1).to_pylist() == [{"query_id": "q0", "doc_id": 0, "score": 1.0}]
    best = [r for b in retrieval._scored_in_task(iter([docs]), Shared, 2) for r in b.to_pylist() if r["query_id"] == "q7"]
    assert [r["doc_id"] for r in best] == [0, 1]


@pytest.mark.parametrize("parts,stored", [(1 << 26, True), (200, True), (200, False)])
def test_lookup_shuffles_no_hits(spark, monkeypatch, parts, stored):
    # two keys are equal, several keywords of an entry occur in one text, words of up to 20 bytes and the empty one
    monkeypatch.setattr(matching, "PART_BYTES", parts, raising=False)
    if not stored:
        monkeypatch.setattr(matching, "mounted", lambda spark, path: None)
        monkeypatch.setattr(matching, "small", lambda df, **k: df)
    words = [f"{'word' * (i % 5)}{i}é" for i in range(400)]
    rows = [(i, [words[i], words[(7 * i) % 400], ""][:1 + (i % 3)], f"n{i}") for i in range(400)] + [(401, ["word1"], "x"), (None, ["é"], "y")][:2 if stored else 1]
    rows += [(7, ["2é"], "again")] * 2 * stored
    lookup = spark.createDataFrame(rows, "pos long, keywords array<string>, notes string").repartition(3)
    texts = [(i, None if i % 9 == 0 else " ".join(words[i * 3 % 400:][:i % 7]).upper()) for i in range(60)]
    found = matching.match_keyword_table(spark.createDataFrame(texts, "id long, body string"), "body", lookup)
    want = sorted((i, p or -1, n) for i, t in texts if t is not None for p, terms, n in rows if any(k in t.lower() for k in terms))
    assert sorted((r.id, r.entry.pos or -1, r.entry.notes) for r in found.collect()) == want and len(want) > 5000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not stored or "Exchange" not in plan and "Join" not in plan


def test_keywords_that_share_a_hash(tmp_path):
    import numpy as np
    import pyarrow as pa

    words = [b"abc", b"abd", b"abc", b"longer than eight", b"longer than nine.", b""]
    rows = pa.table({"part": pa.array([0] * 6, pa.int32()), "hash": pa.array([5, 5, 5, 9, 9, 0]), "word": words, "place": [0, 1, 2, 3, 4, 5]})
    matching._keywords(rows, str(tmp_path))
    table, data = matching._Table(str(tmp_path), 1), np.frombuffer(b"abdabc longer than nine.longer than ten" + bytes(15), np.uint8)
    found = set()
    for length, first, value in ((3, [0, 3, 1], 5), (17, [7, 22], 9), (0, [0], 0)):
        which, keyword = table.find(matching._eights(data), length, np.array(first), np.full(len(first), value, np.uint64))
        owner, place = table.places(np.array(first)[which], keyword)
        found |= set(zip(owner.tolist(), place.tolist()))
    assert found == {(0, 1), (3, 0), (3, 2), (7, 4), (0, 5)}
