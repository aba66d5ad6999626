"""The cut-up plans must give what the plain windows give, on skewed keys, hot instants and ties."""

import random

import pytest
from pyspark.sql import Window as W, functions as F

from tallyweave import scale
from tallyweave.functions import rolling as r
from tallyweave.operators import calls, crosssection
from tallyweave.plans import backtest as bt


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one key, a third of those at one instant; missing values and a NULL key."""
    rnd = random.Random(5)
    rows = []
    for i in range(900):
        key = "hot" if i % 3 == 0 else rnd.choice(["a", "b", "c", None])
        at = 500 if key == "hot" and i % 9 == 0 else rnd.randrange(1000)
        rows.append((key, at, i, None if i % 11 == 0 else round(rnd.uniform(-5, 5), 3)))
    return spark.createDataFrame(rows, "k string, at bigint, seq bigint, v double").repartition(4).cache()


def same(left, right, *order):
    a = [tuple(x) for x in left.orderBy(*order).collect()]
    b = [tuple(x) for x in right.orderBy(*order).collect()]
    assert len(a) == len(b)
    for p, q in zip(a, b):
        assert p == pytest.approx(q, abs=1e-9)


def test_ordinal(skewed):
    for keys in (["k"], []):
        plain = scale.ordinal(skewed, keys, ["at", "seq"], "n")
        cut = scale.ordinal(skewed, keys, ["at", "seq"], "n", rows_per_task=7)
        same(plain.select("seq", "n"), cut.select("seq", "n"), "seq")


def test_running_total(skewed):
    for keys in (["k"], []):
        plain = scale.running_total(skewed, keys, ["at", "seq"], "v", "t")
        cut = scale.running_total(skewed, keys, ["at", "seq"], "v", "t", rows_per_task=7)
        same(plain.select("seq", "t"), cut.select("seq", "t"), "seq")


def test_running_max(skewed):
    plain = scale.running_max(skewed, ["at", "seq"], "v", "m")
    cut = scale.running_max(skewed, ["at", "seq"], "v", "m", rows_per_task=7)
    same(plain.select("seq", "m"), cut.select("seq", "m"), "seq")


def test_order_by_text(spark):
    rows = [("x" * (i % 9) + str(i * 37 % 101), i) for i in range(300)]
    df = spark.createDataFrame(rows, "s string, i bigint")
    plain = scale.ordinal(df, [], ["s", "i"], "n")
    cut = scale.ordinal(df, [], ["s", "i"], "n", rows_per_task=7)
    same(plain.select("i", "n"), cut.select("i", "n"), "i")


def test_blocks_of_nested_windows(skewed):
    makes = {
        "z": lambda s: r.ts_zscore(s, "v", 5), "nested": lambda s: r.ts_mean(s, r.delta(s, "v", 3), 4),
        "ahead": lambda s: F.lead("v", 2).over(s.following(2)), "arg": lambda s: r.ts_argmax(s, "v", 6),
        "decay": lambda s: r.decay_linear(s, "v", 4), "rank": lambda s: r.ts_rank(s, "v", 5),
    }
    plain = scale.evaluate(skewed, scale.Series(["k"], ["at", "seq"]), makes)
    cut = scale.evaluate(skewed, scale.Series(["k"], ["at", "seq"]), makes, rows_per_task=5)
    same(plain.select("seq", *makes), cut.select("seq", *makes), "seq")


def test_blocks_shorter_than_the_reach(skewed):
    makes = {"m": lambda s: r.ts_mean(s, "v", 50)}
    plain = scale.evaluate(skewed, scale.Series(["k"], ["at", "seq"]), makes)
    cut = scale.evaluate(skewed, scale.Series(["k"], ["at", "seq"]), makes, rows_per_task=2)
    same(plain.select("seq", "m"), cut.select("seq", "m"), "seq")


def test_cross_rank(skewed):
    plain = crosssection.cross_rank(skewed, "at", "v")
    cut = crosssection.cross_rank(skewed, "at", "v", rows_per_task=3)
    same(plain.select("seq", "rank"), cut.select("seq", "rank"), "seq")


def test_row_curve(skewed):
    rows = skewed.select(F.col("at").alias("timestamp"), F.format_string("t%04d", "seq").alias("ticker"), F.col("v").alias("pnl"))
    plain, cut = bt.row_curve(rows), bt.row_curve(rows, rows_per_task=3)
    same(plain.select("ticker", "cum_pnl"), cut.select("ticker", "cum_pnl"), "ticker")
    whole = W.partitionBy(F.lit(0)).orderBy("timestamp", "ticker").rowsBetween(W.unboundedPreceding, 0)
    # A row without PnL repeats the total so far.
    direct = rows.withColumn("cum_pnl", F.sum(F.coalesce("pnl", F.lit(0.0))).over(whole))
    same(plain.select("ticker", "cum_pnl"), direct.select("ticker", "cum_pnl"), "ticker")


def test_call_helpers(skewed):
    turns = skewed.where("k IS NOT NULL").select(
        F.col("k").alias("call_id"), F.col("seq").alias("id"), F.col("at").alias("timestamp"), F.col("at").alias("offset_s"),
        F.when(F.col("seq") % 2 == 0, "user").otherwise("assistant").alias("speaker"), F.col("seq").cast("string").alias("text"))
    same(calls.segment_index(turns).select("id", "segment_id"), calls.segment_index(turns, 7).select("id", "segment_id"), "id")
    history = lambda n: calls.conversation_history(turns, "call_id", ["timestamp", "id"], ["id"], 3, n).select(
        "id", "earlier", F.to_json("history"))
    assert sorted(map(tuple, history(None).collect())) == sorted(map(tuple, history(7).collect()))
    probes = turns.select("call_id", (F.col("timestamp") * 2 - 300).alias("at_s")).distinct()
    found = calls.active_segment_at(turns, probes, slice_s=50, rows_per_task=7)
    series = W.partitionBy("call_id").orderBy("offset_s", "id")
    ended = turns.withColumn("end_s", F.lead("offset_s").over(series)).withColumnRenamed("id", "segment_id")
    brute = probes.join(ended, "call_id").where("at_s >= offset_s AND (end_s IS NULL OR at_s < end_s)").select(found.columns)
    assert found.exceptAll(brute).isEmpty() and brute.exceptAll(found).isEmpty()
    rated = turns.select("call_id").distinct().withColumn("rating", F.lit(5))
    pairs = lambda n: sorted(map(tuple, calls.training_set(turns, rated, 1, n).collect()))
    assert pairs(None) == pairs(7)


def test_pages_hold_everything(spark, skewed):
    from tallyweave.operators.nesting import nest
    parents = skewed.select("k").where("k IS NOT NULL").distinct().union(spark.createDataFrame([("none",)], "k string"))
    children = skewed.where("k IS NOT NULL").select(F.col("k").alias("p"), "at", "seq")
    paged = nest(parents, children, "k", "p", ["at", "seq"], ["seq"], "items", per_page=10, rows_per_task=20)
    assert paged.agg(F.max(F.size("items"))).first()[0] == 10
    flat = paged.select("k", "page", F.posexplode("items").alias("i", "e"))
    order = W.partitionBy("p").orderBy("at", "seq")
    wanted = children.withColumn("n", F.row_number().over(order) - 1).select("p", "n", "seq")
    got = flat.select("k", (F.col("page") * 10 + F.col("i")).alias("n"), "e.seq")
    assert got.exceptAll(wanted).isEmpty() and wanted.exceptAll(got).isEmpty()
    assert paged.where("k = 'none'").select("page", F.size("items")).collect() == [(0, 0)]


def test_small_checks_its_bound(spark):
    df = spark.range(100)
    assert "broadcast" in scale.small(df, 100)._jdf.queryExecution().toString().lower()
    assert "broadcast" not in scale.small(df, 99)._jdf.queryExecution().toString().lower()


def test_pieces_of_keys_in_disjoint_ranges(spark):
    """Each of many large keys has cut points of its own, and pieces follow the order."""
    df = spark.range(300 * 2000).select(F.expr("id div 2000").alias("k"), F.col("id").alias("at"))
    placed = scale.with_pieces(df, ["k"], ["at"], limit=100).groupBy("k", "__piece", "__subpiece").agg(
        F.count("*").alias("n"), F.min("at").alias("low"), F.max("at").alias("high"))
    before = F.lag("high").over(W.partitionBy("k").orderBy("__piece", "__subpiece"))
    got = placed.withColumn("bad", F.col("low") <= before).agg(F.max("n"), F.sum("n"), F.count_if("bad")).first()
    assert got[0] <= 400 and got[1] == 600_000 and got[2] == 0
