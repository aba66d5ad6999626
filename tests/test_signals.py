import random

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import graph, numeric as n, registry, rolling as r
from tallyweave.operators import crosssection, resample
from tallyweave.plans import backtest as bt, signals
from tallyweave.scale import Series, evaluate
from tallyweave.sources import bars as files


def column(df, name):
    return [row[0] for row in df.select(name).collect()]


def over(spark, values, make):
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], "k string, i int, x double")
    return column(evaluate(df, Series(["k"], ["i"]), {"y": make}).orderBy("i"), "y")


def test_add_and_sub(spark):
    df = spark.createDataFrame([(1.0, 4.0), (2.0, 5.0), (3.0, 6.0)], "a double, b double")
    assert column(df.select(n.add("a", "b").alias("y")), "y") == [5.0, 7.0, 9.0]
    df = spark.createDataFrame([(5.0, 1.0), (7.0, 2.0), (9.0, 3.0)], "a double, b double")
    assert column(df.select(n.sub("a", "b").alias("y")), "y") == [4.0, 5.0, 6.0]


def test_missing_values(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-4.0, 2.0), (None, 3.0), (float("nan"), 1.0), (1e200, 1e200)], "a double, b double")
    got = df.select(n.div("a", "b").alias("div"), n.signed_sqrt("a").alias("root"), n.signed_log("b").alias("log"),
                    n.maximum("a", "b").alias("max"), n.power(n.finite("a"), "b").alias("power"), n.mul("a", "b").alias("mul")).collect()
    assert got[0].div is None and got[1].div == -2.0 and got[2].div is None and got[3].div is None
    assert got[1].root == -2.0 and got[0].log is None
    assert got[2].max is None and got[0].power == 1.0 and got[3].power is None
    assert got[4].mul is None and got[4].power is None


def test_conditions_with_missing(spark):
    df = spark.createDataFrame([(2.0, 1.0), (None, 1.0), (1.0, 1.0)], "a double, b double")
    got = df.select(n.if_greater("a", "b", 10.0, 20.0).alias("g"), n.if_at_least("a", "b", 10.0, 20.0).alias("ge"),
                    n.if_equal("a", "b", 10.0, 20.0).alias("e")).collect()
    assert [tuple(x) for x in got] == [(10.0, 10.0, 20.0), (20.0, 20.0, 20.0), (20.0, 10.0, 10.0)]


def test_windows(spark):
    x = [1.0, None, 3.0, 2.0, 2.0]
    assert over(spark, x, lambda s: r.delay(s, "x", 2)) == [None, None, 1.0, None, 3.0]
    assert over(spark, x, lambda s: r.ts_sum(s, "x", 2)) == [None, 1.0, 3.0, 5.0, 4.0]
    assert over(spark, [None, None, None], lambda s: r.ts_sum(s, "x", 2)) == [None, 0.0, 0.0]
    assert over(spark, [None, None, None], lambda s: r.ts_mean(s, "x", 2)) == [None, None, None]
    assert over(spark, x, lambda s: r.ts_min(s, "x", 3)) == [None, None, 1.0, 2.0, 2.0]
    assert over(spark, x, lambda s: r.ts_stddev(s, "x", 2)) == [None, None, None, pytest.approx(0.5 ** 0.5), 0.0]
    assert over(spark, x, lambda s: r.ts_zscore(s, "x", 2))[-1] is None
    assert over(spark, x, lambda s: r.decay_linear(s, "x", 2)) == [None, None, None, pytest.approx(7 / 3), pytest.approx(2.0)]
    assert over(spark, x, lambda s: r.ts_rank(s, "x", 3)) == [None, None, 1.0, 0.5, pytest.approx(2 / 3)]
    assert over(spark, x, lambda s: r.ts_argmin(s, "x", 3)) == [None, None, 2, 0, 0]
    assert over(spark, x, lambda s: r.ts_argmax(s, "x", 3)) == [None, None, 0, 1, 2]
    assert over(spark, x, lambda s: r.ts_product(s, "x", 3)) == [None, None, 3.0, 6.0, 12.0]
    assert over(spark, [1.0, 2.0], lambda s: r.ts_sum(s, "x", 3)) == [None, None]


def _plain_window(x, d, kind):
    """The three order statistics by definition."""
    found = []
    for i, v in enumerate(x):
        held = [(w, i - j) for j, w in enumerate(x) if i - d < j <= i and w is not None]
        if i + 1 < d or not held or (kind == "rank" and v is None):
            found.append(None)
        elif kind == "rank":
            found.append(sum(w <= v for w, _ in held) / len(held))
        else:
            best = (min if kind == "since_min" else max)(w for w, _ in held)
            found.append(min(back for w, back in held if w == best))
    return found


@pytest.mark.parametrize("limit", [None, 37])
def test_order_statistics_by_definition(spark, limit):
    draw = random.Random(4)
    x = {k: [draw.choice([None, float("nan"), *map(float, range(6))]) for _ in range(n)] for k, n in [("a", 211), ("b", 3), ("c", 90)]}
    rows = [(k, i, v) for k, values in x.items() for i, v in enumerate(values)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i int, x double")
    makes = {"rank": r.ts_rank, "since_min": r.ts_argmin, "since_max": r.ts_argmax}
    got = evaluate(df, Series(["k"], ["i"]), {f"{kind}{d}": lambda s, make=make, d=d: make(s, "x", d)
                                              for kind, make in makes.items() for d in (2, 5, 50)}, limit)
    assert got.columns[:3] == ["k", "i", "x"] and len(got.columns) == 12
    found = got.orderBy("k", "i").collect()
    for kind in makes:
        for d in (2, 5, 50):
            wanted = [v for k in sorted(x) for v in _plain_window([None if v is None or v != v else v for v in x[k]], d, kind)]
            assert [row[f"{kind}{d}"] for row in found] == wanted


def test_order_statistics_of_order_statistics(spark):
    x = [float(i * 7 % 11) for i in range(40)] + [None] * 4 + [2.0, 2.0]
    inner = _plain_window(x, 4, "rank")
    nested = over(spark, x, lambda s: r.ts_argmax(s, r.ts_rank(s, "x", 4), 3))
    assert nested == _plain_window(inner, 3, "since_max")
    both = over(spark, x, lambda s: r.ts_rank(s, "x", 3) + r.ts_argmin(s, r.delta(s, "x", 2), 5))
    change = [None if i < 2 or v is None or x[i - 2] is None else v - x[i - 2] for i, v in enumerate(x)]
    pairs = zip(_plain_window(x, 3, "rank"), _plain_window(change, 5, "since_min"))
    assert both == [None if a is None or b is None else a + b for a, b in pairs]
    empty = spark.createDataFrame([], "k string, i int, x double")
    assert evaluate(empty, Series(["k"], ["i"]), {"y": lambda s: r.ts_rank(s, "x", 3)}).collect() == []


def test_long_decay_equals_short_form(spark, monkeypatch):
    x = [float(i * i % 7) for i in range(12)] + [None] + [float(i) for i in range(8)]
    short = over(spark, x, lambda s: r.decay_linear(s, "x", 5))
    monkeypatch.setattr(r, "_UNROLL", 2)
    assert over(spark, x, lambda s: r.decay_linear(s, "x", 5)) == pytest.approx(short)


def test_bad_windows(spark):
    s = Series(["k"], ["i"])
    with pytest.raises(ValueError):
        r.ts_sum(s, "x", 1)
    with pytest.raises(ValueError):
        r.delay(s, "x", 0)


def test_registry(spark):
    assert registry.list_transforms() == sorted(registry.list_transforms())
    assert {"ts_zscore", "div", "ifcondition_ge"} <= set(registry.list_transforms())
    assert registry.arity("ifcondition_g") == (4, 4)
    s = Series(["k"], ["i"])
    for tree in (["nothing", "x"], ["add", "x"], ["add", "x", "y"]):
        with pytest.raises(ValueError):
            registry.compose(tree, s, ["x"])
    with pytest.raises(ValueError):
        registry.register("add", (2, 2), n.add)
    assert registry.render(["ts_zscore", ["div", "a", "b"], 30]) == "ts_zscore(div(a,b),30)"


def test_feature_hash(spark):
    import hashlib
    import json
    for freq, expr in [("1d", "add(a,b)"), ("1h", 'say "x" \\ y')]:
        wanted = hashlib.sha1(json.dumps({"f": freq, "e": expr}).encode()).hexdigest()[:12]
        assert spark.range(1).select(signals.feature_hash(freq, expr)).first()[0] == wanted


def test_one_ticker_earns_nothing(spark):
    rows = [(f"2024-01-0{i + 1}", "T", a, c) for i, (a, c) in enumerate(
        zip([0.1, -0.2, 0.3, -0.1, 0.2], [100.0, 102.0, 98.0, 105.0, 103.0]))]
    df = spark.createDataFrame(rows, "timestamp string, ticker string, alpha double, close double").withColumn(
        "timestamp", F.col("timestamp").cast("timestamp"))
    curve = bt.backtest(df).collect()
    assert len(curve) == 4 and all(x.pnl == 0.0 and x.cum_pnl == 0.0 for x in curve)


def test_two_tickers(spark):
    rows = [(d, t, a, c) for d, pairs in {"2024-01-01": [("A", 1.0, 10.0), ("B", -1.0, 10.0)],
                                          "2024-01-02": [("A", 1.0, 11.0), ("B", 1.0, 9.0)],
                                          "2024-01-03": [("A", 0.0, 11.0), ("B", 0.0, 9.0)]}.items() for t, a, c in pairs]
    df = spark.createDataFrame(rows, "timestamp string, ticker string, alpha double, close double").withColumn(
        "timestamp", F.col("timestamp").cast("timestamp"))
    held = bt.positions(df).orderBy("timestamp", "ticker").collect()
    assert [x.position for x in held] == [5000.0, -5000.0, 0.0, 0.0]
    curve = bt.backtest(df).orderBy("timestamp").collect()
    assert curve[0].pnl == pytest.approx(1000.0) and curve[-1].cum_pnl == pytest.approx(1000.0)
    sums = crosssection.neutralise(df.where("timestamp = '2024-01-01'")).agg(F.sum("position"), F.sum(F.abs("position"))).first()
    assert tuple(sums) == (0.0, 10_000.0)


def test_bar_edges_and_ties(spark):
    rows = [("00:00:00", 1, 10.0), ("00:00:30", 2, 11.0), ("00:01:00", 3, 12.0), ("00:01:00", 4, 13.0), ("00:01:01", 5, 9.0)]
    quotes = spark.createDataFrame([("s", f"2024-01-01 {t}", q, v, v) for t, q, v in rows],
                                   "symbol string, ts string, seq bigint, bid_price double, ask_price double")
    quotes = quotes.withColumn("ts", F.col("ts").cast("timestamp"))
    bars = resample.resample_bars(quotes, "1min").orderBy("ts").select(F.date_format("ts", "HH:mm"), "open", "high", "low", "close").collect()
    assert [tuple(b) for b in bars] == [("00:00", 10.0, 10.0, 10.0, 10.0), ("00:01", 11.0, 13.0, 11.0, 13.0), ("00:02", 9.0, 9.0, 9.0, 9.0)]
    every = resample.resample_all(quotes)
    for freq in ("5min", "1h", "1d"):
        direct = resample.resample_bars(quotes, freq)
        assert every.where(F.col("freq") == freq).exceptAll(direct).isEmpty()
        assert direct.exceptAll(every.where(F.col("freq") == freq)).isEmpty()
    coarse = resample.coarsen(resample.resample_bars(quotes, "1min"), "15min")
    assert coarse.exceptAll(resample.resample_bars(quotes, "15min")).isEmpty()


def test_formulas_of_a_catalogue(spark, tmp_path):
    assert graph.read_formula(" ts_zscore(div(sub(high,low),close), 5) ") == ["ts_zscore", ["div", ["sub", "high", "low"], "close"], 5]
    assert graph.read_formula('["delta", "close", 3]') == ["delta", "close", 3] and graph.read_formula("mul(x,-2.5)") == ["mul", "x", -2.5]
    for bad in ("", "close +", "a.b(c)", "delta(close,d=3)", "close > 3", "__import__('os')"):
        with pytest.raises(ValueError):
            graph.read_formula(bad)


def test_graph_shares_subtrees(spark):
    g = graph.Graph(["high", "low", "close"])
    g.add(["ts_zscore", ["div", ["sub", "high", "low"], "close"], 5])
    g.add(["ts_mean", ["ts_max", ["sub", "high", "low"], 3], 4])
    assert len(g.nodes) == 5 and [g.nodes[k].step for k in g.under(g.nodes)] == [(0, 1), (0, 2), (1, 0), (1, 0), (2, 0)]
    assert g.shared([["ts_zscore(div(sub(high,low),close),5)"], ["ts_mean(ts_max(sub(high,low),3),4)"]]) == ["sub(high,low)"]
    for tree in (["nothing", "close"], ["add", "close"], ["add", "close", "volume"]):
        with pytest.raises(ValueError):
            g.add(tree)


@pytest.mark.parametrize("limit, batch", [(None, 100), (20, 3)])
def test_features_of_a_catalogue(spark, limit, batch):
    draw = random.Random(7)
    rows = [(s, f, d, draw.choice([None, draw.random()]), draw.random()) for s, n in [("A", 70), ("B", 9)] for f in ("1d", "1h") for d in range(n)]
    bars = spark.createDataFrame(rows, "symbol string, freq string, d int, x double, close double").withColumn(
        "ts", F.timestamp_seconds(F.lit(1_700_000_000) + 86400 * F.col("d")))
    texts = ["delta(x,2)", "ts_mean(delta(x,2),3)", "ts_rank(ts_mean(delta(x,2),3),4)", "ts_argmin(close,5)", "close",
             "add(ts_rank(close,6),ts_argmax(ts_rank(close,6),3))", "ts_max(ts_min(ts_sum(close,3),3),3)"]
    catalog = spark.createDataFrame([("1d", t) for t in texts] + [("1d", texts[0]), ("1h", texts[3]), ("4h", "close"), (None, "x"), ("1d", None)],
                                    "frequency string, alpha string")
    found = signals.build_catalog(bars, catalog, limit, batch)
    got = {(r.feature_hash, r.freq, r.ticker, r.timestamp): r.alpha for r in found.collect()}
    assert found.count() == len(got)
    wanted = {}
    for freq, text in [*[("1d", t) for t in texts], ("1h", texts[3])]:
        s = Series(["symbol"], ["ts"])
        alone = evaluate(bars.where(F.col("freq") == freq), s, {"y": lambda s: n.finite(registry.compose(graph.read_formula(text), s))})
        digest = spark.range(1).select(signals.feature_hash(freq, text)).first()[0]
        wanted.update({(digest, freq, r.symbol, r.ts): r.y for r in alone.where("y IS NOT NULL").collect()})
    assert got.keys() == wanted.keys() and all(got[k] == pytest.approx(v) for k, v in wanted.items())
    assert signals.build_catalog(bars, catalog.limit(0)).collect() == []
    with pytest.raises(ValueError):
        signals.build_catalog(bars, spark.createDataFrame([("1d", "nothing(x)")], "frequency string, alpha string"))


@pytest.mark.parametrize("limit", [None, 25])
def test_row_curve_and_costs(spark, limit):
    draw = random.Random(3)
    rows = [(d, k, draw.choice([None, round(draw.uniform(-5, 5), 2)]), float(draw.randrange(-3, 4))) for d in range(40) for k in "ABC"]
    df = spark.createDataFrame(rows, "d int, ticker string, pnl double, position double").withColumn(
        "timestamp", F.timestamp_seconds(F.col("d") * 60)).withColumn("close_ask_price", F.lit(101.0)).withColumn("close_bid_price", F.lit(99.0))
    curve = bt.row_curve(df, limit).orderBy("timestamp", "ticker").collect()
    total = 0.0
    for row, (_, _, pnl, _) in zip(curve, sorted(rows, key=lambda r: r[:2]), strict=True):
        total += pnl or 0.0
        assert row.cum_pnl == pytest.approx(total)
    held = {(d, k): p for d, k, _, p in rows}
    for row in bt.with_costs(df, limit).collect():
        assert row.turnover == abs(row.position - held.get((row.d - 1, row.ticker), 0.0)) and row.cost == pytest.approx(row.turnover / 100)
    assert bt.row_curve(df.limit(0), limit).collect() == []


def test_quotes_stay_in_their_files_until_aggregated(spark, tmp_path):
    rows = [(1_700_000_000_000_000 + 1_000_000 * i, float(i % 13), float(i % 13) + 1) for i in range(500)]
    for part in (0, 1):
        one = spark.createDataFrame(rows[part::2], "timestamp bigint, bid_price double, ask_price double").coalesce(1)
        one.write.option("header", True).option("compression", "gzip").csv(f"{tmp_path}/{part}/quotes_S.csv")
    quotes = files.read_quotes(spark, f"{tmp_path}/*/quotes_S.csv/*.csv.gz")
    assert "Exchange" not in quotes._jdf.queryExecution().executedPlan().toString()
    bars = resample.resample_bars(quotes, "1min").orderBy("ts").collect()
    ends = {}
    for us, bid, ask in rows:
        ends.setdefault(-(-us // 60_000_000), []).append((bid + ask) / 2)
    assert [(b.open, b.high, b.low, b.close) for b in bars] == [(m[0], max(m), min(m), m[-1]) for _, m in sorted(ends.items())]
    assert {b.symbol for b in bars} == {"S"}


def test_files_of_a_folder_follow_its_size(spark, tmp_path):
    hours = spark.range(24 * 59).select(F.lit("S").alias("symbol"), F.lit("1h").alias("freq"), F.timestamp_seconds(
        F.lit(1_704_067_200) + 3600 * F.col("id")).alias("ts"), F.rand(1).alias("open")).repartition(7)
    files.write_bars(hours, f"{tmp_path}/few")
    assert len(list(tmp_path.glob("few/symbol=S/freq=1h/*/*/*.parquet"))) == 2
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "8KB")
    try:
        files.write_bars(hours, f"{tmp_path}/more")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert 2 < len(list(tmp_path.glob("more/symbol=S/freq=1h/*/*/*.parquet"))) <= 16
    assert spark.read.parquet(f"{tmp_path}/more").select("ts", "open").exceptAll(hours.select("ts", "open")).isEmpty()
    assert spark.read.parquet(f"{tmp_path}/more").count() == 24 * 59
