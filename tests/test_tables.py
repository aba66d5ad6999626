import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import calls, changes, filtering as fl, ledger as lg, validation as va
from tallyweave.operators.retrieval import search_documents
from tallyweave.plans.frontier import expand_frontier
from tallyweave.session import work_path
from tallyweave.sources import reports, tables as tb
from tallyweave.streaming import events as ev, folds


def rows(df, *order):
    return [tuple(x) for x in df.orderBy(*order).collect()]


def test_zero_bound_is_a_bound(spark):
    df = spark.createDataFrame([(1, -5), (2, 0), (3, 5)], "id int, amount int")
    assert rows(fl.filter_transactions(df, max_amount=0).select("id"), "id") == [(1,), (2,)]


def test_violations_are_all_collected(spark):
    df = spark.createDataFrame([(None, "ab", "x", "refund", None, "c")], "date string, description string, amount string, type string, account_id string, category string")
    checked = va.check(df, va.transaction_rules(F.current_timestamp()))
    assert checked.first().violations == ["date.required", "description.min", "amount.base", "type.only", "account_id.required"]
    good, bad = va.split(checked)
    assert good.isEmpty() and bad.count() == 1


def test_latest_rate_wins_and_ends_are_exclusive(spark):
    day = dt.date
    tx = spark.createDataFrame([(1, day(2024, 1, 31), 100.0), (2, day(2024, 2, 1), 100.0), (3, day(2023, 1, 1), 100.0),
                                (4, day(2024, 6, 1), 100.0)], "id int, date date, amount double")
    rates = spark.createDataFrame([(1, "old", 0.1, "X", day(2024, 1, 1), day(2024, 6, 1)), (2, "new", 0.2, "X", day(2024, 2, 1), day(2024, 3, 1))],
                                  "id int, name string, rate double, country string, effective_date date, expiry_date date")
    got = rows(lg.tax_for_transactions(tx, rates).select("id", "rate_name", "tax"), "id")
    assert got == [(1, "old", 10.0), (2, "new", 20.0), (3, None, None), (4, None, None)]
    assert lg.tax_for_transactions(tx.where("false"), rates).isEmpty()


def test_chart_depth_and_cycles(spark):
    accounts = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "c")], "id string, parent_account_id string")
    own = spark.createDataFrame([("d", 1), ("b", 10)], "account_id string, balance int")
    assert rows(lg.coa_rollup(accounts, own), "account_id") == [("a", 11), ("b", 11), ("c", 1), ("d", 1)]
    loop = spark.createDataFrame([("a", "b"), ("b", "a")], "id string, parent_account_id string")
    with pytest.raises(ValueError):
        lg.coa_rollup(loop, spark.createDataFrame([("a", 1)], "account_id string, balance int"), max_depth=5)


def test_balanced_journal_has_zero_total(spark):
    tx = spark.createDataFrame([("a", "debit", 5, "2024-01-01"), ("b", "credit", 5, "2024-01-02"), ("a", "debit", 9, "2025-01-01")],
                               "account_id string, type string, amount int, date string").withColumn("date", F.col("date").cast("date"))
    total = lg.trial_balance(tx, "2024-12-31").where("account_id IS NULL").first()
    assert total.balance == 0 and total.balanced


def test_upsert_keeps_unset_columns(spark):
    old = spark.createDataFrame([(1, "a", 10, "t0"), (2, "b", 20, "t0")], "id int, name string, v int, updated_at string")
    new = spark.createDataFrame([(2, None, 21), (3, "c", None)], "id int, name string, v int")
    assert rows(changes.upsert(old, new, "id", F.lit("t1")), "id") == [(1, "a", 10, "t0"), (2, "b", 21, "t1"), (3, "c", None, "t1")]


def test_append_defaults(spark, tmp_path):
    tb.append_rows(spark.createDataFrame([("sales", "1")], "type string, phone_number string"), str(tmp_path), "calls",
                   F.lit("2024-01-01").cast("timestamp"))
    got = tb.scan_table(spark, str(tmp_path), "calls").first()
    assert got.status == "ringing" and got.start_time == got.created_at and len(got.id) == 36 and got.end_time is None


def test_search_ranks_rare_words(spark):
    docs = spark.createDataFrame([(1, "the cat"), (2, "the the the"), (3, "a dog")], "doc_id int, text string")
    queries = spark.createDataFrame([(7, "The CAT, the")], "query_id int, text string")
    got = rows(search_documents(queries, docs, 5).select("doc_id", "position"), "position")
    assert got == [(2, 1), (1, 2)] or got == [(1, 1), (2, 2)]
    assert {x[0] for x in got} == {1, 2}


def test_frontier_narrows(spark):
    edges = spark.createDataFrame([("s", c, w) for c, w in [("a", 5.0), ("b", 4.0), ("c", 3.0), ("d", 2.0)]]
                                  + [(p, p + str(i), 9.0 - i) for p in "abcd" for i in range(4)]
                                  + [(p + str(i), p + str(i) + "x", 1.0) for p in "abcd" for i in range(4)], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("s",), ("nowhere",)], "seed string")
    found = expand_frontier(seeds, edges, 3, 3)
    assert rows(found.groupBy("level").count(), "level") == [(1, 3), (2, 6), (3, 6)]


_EVENTS = [
    '{"type":"callStarted","call_id":1,"data":"{\\"status\\":\\"in-progress\\"}","timestamp":"2024-01-01T00:00:00Z"}',
    '{"type":"transcriptUpdate","call_id":1,"data":"{\\"segment_id\\":1,\\"text\\":\\"hi\\"}","timestamp":"2024-01-01T00:00:10Z"}',
    '{"type":"transcriptUpdate","call_id":1,"data":"{\\"segment_id\\":1,\\"text\\":\\"hi\\"}","timestamp":"2024-01-01T00:00:10Z"}',
    '{"type":"callEnded","call_id":1,"data":"{}","timestamp":"2024-01-01T00:01:00Z"}',
    '{"type":"callStarted","callId":"CA2f","data":{},"timestamp":"2024-01-01T00:00:30Z"}',
    '{"type":"other","call_id":2,"data":"{}","timestamp":"2024-01-01T00:00:31Z"}', "broken",
    '{"type":"callEnded","data":{},"timestamp":"2024-01-01T00:01:00Z"}',
    '{"type":"feedbackSubmitted","callId":"CA3","data":{"rating":3},"timestamp":"2024-01-01T00:01:00Z"}',
]


def test_stream_and_table_agree(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i, line in enumerate(_EVENTS):
        (source / f"{i}.json").write_text(line + "\n")
    batch = folds.call_state(ev.read_call_events(spark.read.text(str(source))))
    stream = folds.call_state(ev.read_call_events(ev.stream_lines(spark, str(source), files_per_batch=3)))
    with ev.settings(spark, folds.STATE_STORE):
        ev.run_updates(stream, str(tmp_path / "out"), str(tmp_path / "mark"), timeout_s=120)
    pick = ["call_id", "status", "start_time", "end_time", "segments"]
    last = ev.latest_updates(spark, str(tmp_path / "out"), ["call_id"])
    assert rows(batch.select(pick), "call_id") == rows(last.select(pick), "call_id")
    assert rows(batch.select("call_id", "status", "segments"), "call_id") == [("1", "completed", 1), ("CA2f", "ringing", 0)]
    assert rows(folds.active_calls(batch).select("call_id"), "call_id") == [("CA2f",)]
    rejected = ev.rejected_call_events(spark.read.text(str(source)))
    assert rows(rejected.select("reason"), "reason") == [("no_call_id",), ("unknown_type",), ("unreadable",)]
    ev.run_append(folds.transcript_merge(ev.read_call_events(ev.stream_lines(spark, str(source)))), str(tmp_path / "once"),
                  str(tmp_path / "mark2"), timeout_s=120)
    assert spark.read.parquet(str(tmp_path / "once")).count() == 1


def test_lifecycle_over_several_batches(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    later = '{"type":"feedbackSubmitted","callId":"CA4","data":{"rating":3},"timestamp":"2024-01-01T01:00:00Z"}'
    for i, line in enumerate([*_EVENTS, later]):
        (source / f"{i}.json").write_text(line + "\n")
    with ev.settings(spark, folds.STATE_STORE):
        stream = folds.call_lifecycle(ev.read_call_events(ev.stream_lines(spark, str(source), files_per_batch=4)))
        ev.run_append(stream, str(tmp_path / "out"), str(tmp_path / "mark"), timeout_s=120)
    got = spark.read.parquet(str(tmp_path / "out")).select("call_id", "status", "segments")
    assert rows(got, "call_id") == [("1", "completed", 1)]


def test_statements_carry_balances_over_empty_periods(spark):
    accounts = spark.createDataFrame([("a", "asset"), ("l", "liability"), ("r", "revenue")], "id string, type string")
    rows = [("a", "debit", "2023-11-05", 10), ("a", "credit", "2024-02-01", 4), ("l", "credit", "2024-01-31", 7), ("l", "debit", "2024-03-02", 7),
            ("r", "credit", "2024-03-31", 9), ("r", "credit", "2024-04-01", 1), ("zz", "debit", "2024-01-01", 1), ("a", None, "2024-01-01", 5),
            ("a", "debit", None, 3)]
    transactions = spark.createDataFrame(rows, "account_id string, type string, date string, amount int").selectExpr(
        "account_id", "type", "CAST(date AS date) AS date", "CAST(amount AS decimal(18,2)) AS amount", "CAST(NULL AS string) AS category")

    def of(statement, unit="month"):
        found = lg.statement_by_period(accounts, transactions, statement, unit, "2024-01-01", "2024-03-31")
        return sorted((str(r.period), r.item, int(r.balance)) for r in found.collect())

    months = ["2024-01-01", "2024-02-01", "2024-03-01"]
    assert [x for x in of("balance_sheet") if x[1] == "a"] == list(zip(months, "aaa", [10, 6, 6]))
    assert of("accounts_receivable") == list(zip(months, "aaa", [10, 6, 6]))
    assert of("accounts_payable") == [(months[0], "l", 7), (months[1], "l", 7)]
    assert of("income_statement") == list(zip(months, [None] * 3, [0, 0, -9])) and of("balance_sheet", "year")[0] == ("2024-01-01", "a", 6)
    assert [x for x in of("trial_balance", "quarter")] == [("2024-01-01", "a", 6), ("2024-01-01", "l", 0), ("2024-01-01", "r", -9)]
    with pytest.raises(ValueError):
        of("poem")


def test_deep_charts_roll_up(spark):
    chain = [(f"n{i}", f"n{i + 1}" if i < 69 else None) for i in range(70)]
    accounts = spark.createDataFrame(chain, "id string, parent_account_id string").coalesce(1)
    own = spark.createDataFrame([("n0", 5)], "account_id string, balance long")
    assert {r.balance for r in lg.coa_rollup(accounts, own).collect()} == {5}
    with pytest.raises(ValueError):
        lg.coa_rollup(spark.createDataFrame([("x", "y"), ("y", "x")], accounts.schema), spark.createDataFrame([("x", 1)], own.schema))


def test_deep_pages_equal_plain_ones(spark):
    data = [(i, None if i % 13 == 0 else i % 7, "x") for i in range(1000)] + [(5, 3, "again")] * 3
    df = spark.createDataFrame(data, "id long, k int, note string").repartition(3)
    order = [F.col("k").desc(), F.col("id"), F.col("note")]
    want = sorted(data, key=lambda r: (-(r[1] if r[1] is not None else -1), r[0], r[2]))
    for page, limit in ((1, 60), (4, 100), (11, 100), (12, 100), (20, 51), (2, 1003), (1, 2000)):
        got = [tuple(r)[:3] for r in fl.page(df, order, page, limit, range_rows=50).orderBy(*order).collect()]
        assert got == want[(page - 1) * limit:page * limit], (page, limit)
    plan = fl.page_with_more(df, order, offset=900, limit=10, range_rows=50).collect()
    assert [r.id for r in plan] == [r[0] for r in want[900:910]] and {(r.total, r.has_more) for r in plan} == {(1003, True)}


def test_deep_pages_deal_bounded_ranges(spark, monkeypatch):
    df = spark.range(4000).select((F.col("id") * 7919 % 4000).alias("id"), F.lit(1).alias("same"))
    dealt, real = [], type(df).repartitionByRange
    monkeypatch.setattr(type(df), "repartitionByRange", lambda self, n, *c: dealt.append(n) or real(self, n, *c))
    monkeypatch.setattr(fl, "RANGES", 8)
    assert [r.id for r in fl.page(df, [F.col("id").desc()], 51, 10, range_rows=20).collect()] == list(range(3499, 3489, -1))
    assert max(dealt) <= 8 and len(dealt) > 1
    # an order that tells nothing apart ends as well
    assert fl.page(df, [F.col("same")], 51, 10, range_rows=20).count() == 10


def test_reports_of_many_pages_have_one_digest(spark):
    import hashlib
    insights = spark.createDataFrame([(q, f"found {i:03d}") for q in ("a", "b") for i in range(25)], "query_id string, insight string")
    sources = spark.createDataFrame([("a", "u1"), ("b", "u2")], "query_id string, url string")
    pages = reports.compile_report(insights, sources, items_per_page=4)
    assert pages.where("page > 0").count() > 0
    root = work_path(spark, "reports")
    reports.write_reports(pages, root)
    files = spark.read.schema("value string, query_id string, page bigint").text(root, wholetext=True)
    body = "\n".join(f"<insight>\nfound {i:03d}\n</insight>" for i in range(25)) + "\n\n## Reference Sources\n\n- u"
    want = [(q, 0, hashlib.md5(f"{body}{n}".encode()).hexdigest()) for q, n in (("a", 1), ("b", 2))]
    for found in (pages, files.withColumn("text", F.regexp_replace("value", r"\n\z", ""))):
        assert sorted(map(tuple, reports.whole_digests(found).collect())) == want


def test_training_pairs_name_their_review(spark):
    turns = spark.createDataFrame([(1, 1, 0, "user", "q"), (1, 2, 1, "assistant", "r")], "call_id long, id long, timestamp long, speaker string, text string")
    reviews = spark.createDataFrame([(7, 1, 5), (8, 1, 5), (9, 1, 1)], "id long, call_id long, rating long")
    assert sorted((r.segment_id, r.feedback) for r in calls.training_set(turns, reviews, 3).collect()) == [(1, 7), (1, 8)]
