"""Bars, signal functions, features and backtests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.checks.registry import check, plain_ts, r2, r6
from tallyweave.functions import numeric as n, rolling as w
from tallyweave.functions.registry import compose
from tallyweave.operators import crosssection, resample
from tallyweave.plans import backtest as bt, signals
from tallyweave.schemas import BAR_COLUMNS, BAR_TABLE
from tallyweave.scale import Series, evaluate, largest_group
from tallyweave.session import cut_lineage, work_path
from tallyweave.sources import bars as bar_files, catalogs

# --- element-wise functions over daily bars -------------------------------------------------------

_POINTWISE = {
    "sca01_add": (lambda: n.add("close", "x"), "close + x"),
    "sca02_sub": (lambda: n.sub("high", "x"), "high - x"),
    "sca03_mul": (lambda: n.mul(n.mul("close", "x"), 1e-6), "close * x * 1e-6"),
    "sca04_div": (lambda: n.div("x", n.sub("high", "low")), "CASE WHEN high - low <> 0 THEN x / (high - low) END"),
    "sca05_sqrt": (lambda: n.signed_sqrt(n.sub("x", 150000.0)), "sign(x - 150000) * sqrt(abs(x - 150000))"),
    "sca06_log": (lambda: n.signed_log(n.sub("x", "open")), "CASE WHEN x <> open THEN sign(x - open) * ln(abs(x - open)) END"),
    "sca07_abs": (lambda: n.absolute(n.sub("x", "open")), "abs(x - open)"),
    "sca08_neg": (lambda: n.neg("x"), "-x"),
    "sca09_inv": (lambda: n.inv(n.div(n.sub("high", "low"), 1000.0)),
                  "CASE WHEN high - low <> 0 THEN 1.0 / ((high - low) / 1000) END"),
    "sca10_max": (lambda: n.maximum("open", "x"), "CASE WHEN x IS NOT NULL THEN greatest(open, x) END"),
    "sca11_min": (lambda: n.minimum("open", "x"), "CASE WHEN x IS NOT NULL THEN least(open, x) END"),
    "sca12_sign": (lambda: n.sign(n.sub("x", "open")), "CAST(sign(x - open) AS DOUBLE)"),
    "sca13_power": (lambda: n.power(n.div("x", 100000.0), n.div("open", 100000.0)), "pow(x / 100000, open / 100000)"),
    "sca14_ifcondition_g": (lambda: n.if_greater("x", "open", "high", "low"), "CASE WHEN x > open THEN high ELSE low END"),
    "sca15_ifcondition_ge": (lambda: n.if_at_least("x", "open", "high", "low"), "CASE WHEN x >= open THEN high ELSE low END"),
    "sca16_ifcondition_e": (lambda: n.if_equal("x", "high", "open", "low"), "CASE WHEN x = high THEN open ELSE low END"),
}


def _pointwise(name, value, sql):
    @check(name, f"SELECT symbol, ts, round({sql}, 6) AS value FROM fx_bars")
    def run(t):
        return t.bars.select("symbol", plain_ts("ts").alias("ts"), r6(value()).alias("value"))


for _name, (_value, _sql) in _POINTWISE.items():
    _pointwise(_name, _value, _sql)

# --- trailing windows over daily bars -------------------------------------------------------------

_D = 5
_FRAME = f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {_D - 1} PRECEDING AND CURRENT ROW)"
_ORDER = "(PARTITION BY symbol ORDER BY ts)"


def _full(sql):
    return f"CASE WHEN count(*) OVER {_FRAME} = {_D} THEN {sql} END"


_ROLLING = {
    "win01_delay": (lambda s: w.delay(s, "x", 3), f"lag(x, 3) OVER {_ORDER}"),
    "win02_delta": (lambda s: w.delta(s, "x", 3), f"x - lag(x, 3) OVER {_ORDER}"),
    "win03_rolling_frame": (lambda s: w.full(s, _D, F.count("x").over(s.last(_D)).cast("double")),
                            _full(f"CAST(count(x) OVER {_FRAME} AS DOUBLE)")),
    "win04_ts_sum": (lambda s: w.ts_sum(s, "x", _D), _full(f"coalesce(sum(x) OVER {_FRAME}, 0.0)")),
    "win05_ts_mean": (lambda s: w.ts_mean(s, "x", _D), _full(f"avg(x) OVER {_FRAME}")),
    "win06_ts_min": (lambda s: w.ts_min(s, "x", _D), _full(f"min(x) OVER {_FRAME}")),
    "win07_ts_max": (lambda s: w.ts_max(s, "x", _D), _full(f"max(x) OVER {_FRAME}")),
    "win08_ts_stddev": (lambda s: w.ts_stddev(s, "x", _D), _full(f"stddev_samp(x) OVER {_FRAME}")),
    "win09_ts_zscore": (lambda s: w.ts_zscore(s, "x", _D), _full(
        f"CASE WHEN stddev_samp(x) OVER {_FRAME} > 0 THEN (x - avg(x) OVER {_FRAME}) / stddev_samp(x) OVER {_FRAME} END")),
    "win10_decay_linear": (lambda s: w.decay_linear(s, "x", _D), " + ".join(
        f"lag(x, {k}) OVER {_ORDER} * {_D - k} * 2.0 / {_D * (_D + 1)}" if k else f"x * {_D} * 2.0 / {_D * (_D + 1)}"
        for k in range(_D))),
    "win12_ts_rank": (lambda s: w.ts_rank(s, "x", _D), ""),
    "win13_ts_argmin": (lambda s: w.ts_argmin(s, "x", _D).cast("double"), ""),
    "win14_ts_argmax": (lambda s: w.ts_argmax(s, "x", _D).cast("double"), ""),
    "win15_ts_product": (lambda s: w.ts_product(s, n.div("x", 250000.0), _D), _full(f"product(x / 250000.0) OVER {_FRAME}")),
}
# The twins of the arg functions compare every row of the frame with its extreme.
for _name, _pick in [("win13_ts_argmin", "min"), ("win14_ts_argmax", "max")]:
    _best = " ".join(
        f"WHEN {'x' if k == 0 else f'lag(x, {k}) OVER {_ORDER}'} = {_pick}(x) OVER {_FRAME} THEN CAST({k} AS DOUBLE)" for k in range(_D))
    _ROLLING[_name] = (_ROLLING[_name][0], _full(f"CASE {_best} END"))
_at_most = " + ".join(f"CASE WHEN {'x' if k == 0 else f'lag(x, {k}) OVER {_ORDER}'} <= x THEN 1 ELSE 0 END" for k in range(_D))
_ROLLING["win12_ts_rank"] = (_ROLLING["win12_ts_rank"][0], _full(
    f"CASE WHEN x IS NOT NULL THEN ({_at_most}) * 1.0 / count(x) OVER {_FRAME} END"))


def _rolling(name, make, sql):
    @check(name, f"SELECT symbol, ts, round({sql}, 6) AS value FROM fx_bars")
    def run(t):
        found = evaluate(t.bars, Series(["symbol"], ["ts"]), {"value": make})
        return found.select("symbol", plain_ts("ts").alias("ts"), r6("value").alias("value"))


for _name, (_make, _sql) in _ROLLING.items():
    _rolling(_name, _make, _sql)


@check("win11_rank", """
    SELECT symbol, ts, round(CASE WHEN x IS NOT NULL
        THEN percent_rank() OVER (PARTITION BY ts, x IS NULL ORDER BY x) END, 6) AS rank FROM fx_bars""")
def _(t):
    ranked = crosssection.cross_rank(t.bars.select("symbol", "ts", "x"), "ts", "x")
    return ranked.select("symbol", plain_ts("ts").alias("ts"), r6("rank").alias("rank"))


@check("udf01_registered_functions", """
    SELECT symbol, ts, round(x - lag(x, 2) OVER (PARTITION BY symbol ORDER BY ts), 6) AS momentum,
           round(CASE WHEN high <> low THEN (close - low) / (high - low) END, 6) AS place FROM fx_bars""")
def _(t):
    tree = ["div", ["sub", "close", "low"], ["sub", "high", "low"]]
    found = evaluate(t.bars, Series(["symbol"], ["ts"]), {
        "momentum": lambda s: compose(["delta", "x", 2], s, t.bars.columns),
        "place": lambda s: compose(tree, s, t.bars.columns)})
    return found.select("symbol", plain_ts("ts").alias("ts"), r6("momentum").alias("momentum"), r6("place").alias("place"))


@check("udf04_per_group_positions", """
    SELECT timestamp, ticker, round(10000 * z / CASE WHEN g = 0 THEN 1 ELSE g END, 6) AS position FROM (
        SELECT *, sum(abs(z)) OVER (PARTITION BY timestamp) AS g FROM (
            SELECT *, alpha - avg(alpha) OVER (PARTITION BY timestamp) AS z FROM fx_features) a) b""")
def _(t):
    held = crosssection.neutralise(t.features)
    return held.select(plain_ts("timestamp").alias("timestamp"), "ticker", r6("position").alias("position"))

# --- bars -----------------------------------------------------------------------------------------

_FREQ_SQL = {"1min": "1 minute", "5min": "5 minutes", "15min": "15 minutes", "1h": "1 hour", "4h": "4 hours",
             "12h": "12 hours", "1d": "1 day"}


def _end_sql(freq):
    step = f"INTERVAL '{_FREQ_SQL[freq]}'"
    return f"time_bucket({step}, ts - INTERVAL '1 microsecond') + {step}"


def _quote_bars_sql(freq):
    return f"""
        SELECT symbol, '{freq}' AS freq, bar_ts AS ts, round(arg_min(mid, ts), 6) AS open, round(max(mid), 6) AS high,
               round(min(mid), 6) AS low, round(arg_max(mid, ts), 6) AS close,
               round(arg_min(ask_price, ts), 6) AS open_ask_price, round(arg_max(ask_price, ts), 6) AS close_ask_price,
               round(arg_min(bid_price, ts), 6) AS open_bid_price, round(arg_max(bid_price, ts), 6) AS close_bid_price
        FROM (SELECT *, (bid_price + ask_price) / 2 AS mid, {_end_sql(freq)} AS bar_ts FROM fx_quotes) q
        GROUP BY symbol, bar_ts"""


def _trade_bars_sql(freq):
    return f"""
        SELECT symbol, '{freq}' AS freq, bar_ts AS ts, round(sum(price * qty) / sum(qty), 6) AS vwap,
               coalesce(sum(qty) FILTER (WHERE side = 'buy'), 0.0) AS buy_volume,
               coalesce(sum(qty) FILTER (WHERE side = 'sell'), 0.0) AS sell_volume, sum(qty) AS total_volume,
               CAST(count(*) FILTER (WHERE side = 'buy') AS DOUBLE) AS buy_trades_count,
               CAST(count(*) FILTER (WHERE side = 'sell') AS DOUBLE) AS sell_trades_count,
               CAST(count(*) AS DOUBLE) AS total_trades_count
        FROM (SELECT *, {_end_sql(freq)} AS bar_ts FROM fx_trades) q GROUP BY symbol, bar_ts"""


def _shown(bars):
    return bars.select("symbol", "freq", plain_ts("ts").alias("ts"),
                       *[r6(c).alias(c) for c in bars.columns if c not in ("symbol", "freq", "ts")])


@check("agg01_resample_bars", _quote_bars_sql("1h"))
def _(t):
    return _shown(resample.resample_bars(t.quotes, "1h"))


@check("agg02_resample_all", " UNION ALL ".join(_quote_bars_sql(f) for f in _FREQ_SQL))
def _(t):
    return _shown(resample.resample_all(t.quotes))


@check("agg03_trade_bars", _trade_bars_sql("1d"))
def _(t):
    return _shown(resample.trade_bars(t.trades, "1d"))


@check("agg03_full_bars", f"""
    WITH q AS ({_quote_bars_sql('1d')}), d AS ({_trade_bars_sql('1d')})
    SELECT * FROM q FULL OUTER JOIN d USING (symbol, freq, ts)""")
def _(t):
    return _shown(resample.full_bars(t.quotes, t.trades, "1d"))


@check("set01_concat_files", _quote_bars_sql("4h"))
def _(t):
    # The same quotes as two folders: a bucket that spans both still gives one bar.
    folders = [work_path(t.spark, "odd"), work_path(t.spark, "even")]
    for rest, folder in zip((1, 0), folders):
        t.quotes.where(F.col("seq") % 2 == rest).write.parquet(folder)
    odd, even = (t.spark.read.parquet(folder) for folder in folders)
    return _shown(resample.resample_bars(odd.unionByName(even), "4h"))


@check("src01_read_quotes", """
    SELECT event_type AS symbol, ts, round(value - 0.01, 6) AS bid_price, round(value + 0.01, 6) AS ask_price,
           round((value - 0.01 + value + 0.01) / 2, 6) AS mid_price FROM events""")
def _(t):
    root = work_path(t.spark, "quotes")
    name = F.concat(F.lit("quotes_20240101_"), "symbol", F.lit(".csv"))
    rows = t.quotes.select(F.unix_micros("ts").alias("timestamp"), "bid_price", "ask_price", name.alias("file"))
    rows.write.partitionBy("file").option("header", True).option("compression", "gzip").csv(root)
    quotes = bar_files.read_quotes(t.spark, f"{root}/*/*.csv.gz")
    return quotes.select("symbol", plain_ts("ts").alias("ts"), *[r6(c).alias(c) for c in
                                                                 ("bid_price", "ask_price", "mid_price")])


@check("src02_write_bars", f"SELECT *, year(ts) AS year, month(ts) AS month FROM ({_quote_bars_sql('1h')}) b")
def _(t):
    root = work_path(t.spark, "bars")
    bar_files.write_bars(resample.resample_bars(t.quotes, "1h"), root)
    stored = t.spark.read.schema(BAR_TABLE).parquet(root).drop(*BAR_COLUMNS[8:])
    return _shown(stored.drop("year", "month")).join(
        stored.select("symbol", "freq", plain_ts("ts").alias("ts"), "year", "month"), ["symbol", "freq", "ts"])


@check("src03_load_bars", f"SELECT * FROM ({_quote_bars_sql('1d')}) b WHERE symbol = 'click'")
def _(t):
    root = work_path(t.spark, "bars")
    both = resample.resample_bars(t.quotes, "1d").unionByName(resample.resample_bars(t.quotes, "4h"))
    bar_files.write_bars(both, root)
    return _shown(bar_files.load_bars(t.spark, root, "click", "1d").drop(*BAR_COLUMNS[8:]))


@check("prj01_canonical_columns", "SELECT symbol, ts, open, high, low, close FROM fx_bars")
def _(t):
    kept = bar_files.canonical_columns(t.bars, "symbol", "ts")
    return kept.withColumn("ts", plain_ts("ts"))


@check("fil07_drop_missing", "SELECT symbol, ts, x FROM fx_bars WHERE x IS NOT NULL")
def _(t):
    return bar_files.drop_missing(t.bars, "x").select("symbol", plain_ts("ts").alias("ts"), "x")


@check("dat01_month_parts", "SELECT symbol, ts, year(ts) AS year, month(ts) AS month FROM fx_quotes")
def _(t):
    return bar_files.with_month(t.quotes).select("symbol", plain_ts("ts").alias("ts"), "year", "month")

# --- features and backtests -----------------------------------------------------------------------

_Z = ["ts_zscore", ["div", ["sub", "high", "low"], "close"], 5]
_M = ["delta", "close", 3]
_Z_TEXT = "ts_zscore(div(sub(high,low),close),5)"
_M_TEXT = "delta(close,3)"


def _hash_sql(text):
    return "substr(sha1('{\"f\": \"1d\", \"e\": \"" + text + "\"}'), 1, 12)"


_Z_SQL = f"""
    SELECT {_hash_sql(_Z_TEXT)} AS feature_hash, '1d' AS freq, symbol AS ticker, ts AS timestamp,
           CASE WHEN n = 5 AND dev > 0 THEN (v - mean) / dev END AS alpha
    FROM (SELECT symbol, ts, v, count(*) OVER {_FRAME} AS n, avg(v) OVER {_FRAME} AS mean, stddev_samp(v) OVER {_FRAME} AS dev
          FROM (SELECT symbol, ts, (high - low) / close AS v FROM fx_bars) a) b"""
_M_SQL = f"""
    SELECT {_hash_sql(_M_TEXT)} AS feature_hash, '1d' AS freq, symbol AS ticker, ts AS timestamp,
           close - lag(close, 3) OVER {_ORDER} AS alpha FROM fx_bars"""


def _alphas(features):
    return features.select("feature_hash", "freq", "ticker", plain_ts("timestamp").alias("timestamp"),
                           r6("alpha").alias("alpha"))


@check("job01_build_feature", f"""
    SELECT feature_hash, freq, ticker, timestamp, round(alpha, 6) AS alpha FROM ({_Z_SQL}) f WHERE alpha IS NOT NULL""")
def _(t):
    return _alphas(signals.build_feature(t.bars, "1d", _Z))


@check("job02_build_features", f"""
    SELECT feature_hash, freq, ticker, timestamp, round(alpha, 6) AS alpha
    FROM ({_Z_SQL} UNION ALL {_M_SQL}) f WHERE alpha IS NOT NULL""")
def _(t):
    return _alphas(signals.build_features(t.bars, "1d", [_Z, _M]))


def _grid_sql(texts):
    """All formulas of a table in one scan, as a list of hash and value per bar."""
    return "[" + ", ".join(f"{{'h': {_hash_sql(text)}, 'a': {sql}}}" for text, sql in texts.items()) + "]"


_GRID = {}
for _d in range(2, 10):
    _back = f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {_d - 1} PRECEDING AND CURRENT ROW)"
    _GRID[f"delta(close,{_d})"] = f"close - lag(close, {_d}) OVER {_ORDER}"
    _GRID[f"sub(close,ts_mean(close,{_d}))"] = f"CASE WHEN count(*) OVER {_back} = {_d} THEN close - avg(close) OVER {_back} END"
    _GRID[f"ts_max(delta(close,1),{_d})"] = f"CASE WHEN count(*) OVER {_back} = {_d} THEN max(step) OVER {_back} END"


@check("job02_build_catalog", f"""
    WITH b AS MATERIALIZED (SELECT symbol, ts, close, close - lag(close, 1) OVER {_ORDER} AS step FROM fx_bars),
    w AS (SELECT symbol, ts, {_grid_sql(_GRID)} AS found FROM b),
    e AS (SELECT symbol, ts, unnest(found) AS f FROM w)
    SELECT f.h AS feature_hash, '1d' AS freq, symbol AS ticker, ts AS timestamp, round(f.a, 6) AS alpha FROM e WHERE f.a IS NOT NULL""")
def _(t):
    # the catalogue is written and read back; its formulas share subtrees and take more than one pass
    root = work_path(t.spark, "catalog")
    rows = t.spark.createDataFrame([("1d", text) for text in _GRID], "frequency string, alpha string")
    catalogs.write_catalog(rows, root)
    catalog = catalogs.read_alpha_catalog(t.spark, root, multi_line=False)
    return _alphas(signals.build_catalog(t.bars.withColumn("freq", F.lit("1d")), catalog, batch=8))


@check("src04_write_feature", f"""
    SELECT feature_hash, freq, ticker, timestamp, round(alpha, 6) AS alpha FROM ({_M_SQL}) f WHERE alpha IS NOT NULL""")
def _(t):
    root = work_path(t.spark, "features")
    bar_files.write_feature(signals.build_features(t.bars, "1d", [_Z, _M]), root)
    wanted = t.spark.range(1).select(signals.feature_hash("1d", _M_TEXT)).first()[0]
    return _alphas(bar_files.read_feature(t.spark, root, wanted, "1d"))


@check("str22_feature_hash", """
    SELECT event_type AS freq, props AS expr,
           substr(sha1('{"f": "' || event_type || '", "e": "' || replace(props, '"', '\\"') || '"}'), 1, 12) AS feature_hash
    FROM events""")
def _(t):
    e = t.table("events")
    return e.select(F.col("event_type").alias("freq"), F.col("props").alias("expr"),
                    signals.feature_hash(F.col("event_type"), F.col("props")).alias("feature_hash"))


@check("joi12_features_with_prices", """
    SELECT f.ticker, f.timestamp, round(f.alpha, 6) AS alpha, b.close FROM fx_features f
    JOIN fx_bars b ON b.symbol = f.ticker AND b.ts = f.timestamp""")
def _(t):
    joined = bt.features_with_prices(t.features, t.bars)
    return joined.select("ticker", plain_ts("timestamp").alias("timestamp"), r6("alpha").alias("alpha"), "close")


_RETURNS = """
    SELECT f.ticker, f.timestamp, f.alpha, b.close,
           lead(b.close, 1) OVER (PARTITION BY f.ticker ORDER BY f.timestamp) / b.close - 1 AS ret
    FROM fx_features f JOIN fx_bars b ON b.symbol = f.ticker AND b.ts = f.timestamp"""
_POSITIONS = f"""
    SELECT ticker, timestamp, ret, 10000 * z / CASE WHEN g = 0 THEN 1 ELSE g END AS position FROM (
        SELECT *, sum(abs(z)) OVER (PARTITION BY timestamp) AS g FROM (
            SELECT *, alpha - avg(alpha) OVER (PARTITION BY timestamp) AS z FROM ({_RETURNS}) r
            WHERE ret IS NOT NULL) a) b"""
_CURVE = f"SELECT timestamp, sum(position * ret) AS pnl FROM ({_POSITIONS}) p GROUP BY timestamp"


def _priced(t):
    return bt.features_with_prices(t.features, t.bars)


@check("win16_forward_return", f"SELECT ticker, timestamp, round(ret, 6) AS ret FROM ({_RETURNS}) r WHERE ret IS NOT NULL")
def _(t):
    return bt.add_forward_return(_priced(t)).select("ticker", plain_ts("timestamp").alias("timestamp"), r6("ret").alias("ret"))


@check("win17_neutralise", f"SELECT ticker, timestamp, round(position, 6) AS position FROM ({_POSITIONS}) p")
def _(t):
    return bt.positions(_priced(t)).select("ticker", plain_ts("timestamp").alias("timestamp"), r6("position").alias("position"))


@check("win18_row_curve", f"""
    SELECT ticker, timestamp, round(position * ret, 4) AS pnl,
           round(sum(position * ret) OVER (ORDER BY timestamp, ticker ROWS UNBOUNDED PRECEDING), 4) AS cum_pnl
    FROM ({_POSITIONS}) p""")
def _(t):
    rows = bt.row_curve(bt.positions(_priced(t)))
    return rows.select("ticker", plain_ts("timestamp").alias("timestamp"), F.round("pnl", 4).alias("pnl"),
                       F.round("cum_pnl", 4).alias("cum_pnl"))


@check("job03_backtest", f"""
    SELECT timestamp, round(pnl, 4) AS pnl, round(sum(pnl) OVER (ORDER BY timestamp), 4) AS cum_pnl FROM ({_CURVE}) c""")
def _(t):
    return bt.backtest(_priced(t)).select(plain_ts("timestamp").alias("timestamp"), F.round("pnl", 4).alias("pnl"),
                                          F.round("cum_pnl", 4).alias("cum_pnl"))


@check("job04_backtest_metrics", f"""
    SELECT count(pnl) AS periods, round(sum(pnl), 4) AS total_pnl, round(avg(pnl), 4) AS mean_pnl,
           round(stddev_samp(pnl), 4) AS stdev_pnl, round(avg(pnl) / stddev_samp(pnl) * sqrt(252), 6) AS sharpe,
           round(max(greatest(peak, 0) - cum_pnl), 4) AS max_drawdown,
           round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate
    FROM (SELECT *, max(cum_pnl) OVER (ORDER BY timestamp) AS peak FROM (
        SELECT *, sum(pnl) OVER (ORDER BY timestamp) AS cum_pnl FROM ({_CURVE}) c) d) e""")
def _(t):
    m = bt.metrics(bt.backtest(_priced(t)))
    return m.select("periods", *[F.round(c, 4).alias(c) for c in ("total_pnl", "mean_pnl", "stdev_pnl", "max_drawdown")],
                    r6("sharpe").alias("sharpe"), r6("hit_rate").alias("hit_rate"))


@check("job05_backtest_costs", f"""
    SELECT ticker, timestamp, round(turnover, 4) AS turnover, round(turnover * (ask - bid) / (ask + bid), 4) AS cost,
           round(pnl - turnover * (ask - bid) / (ask + bid), 4) AS net_pnl
    FROM (SELECT p.ticker, p.timestamp, p.position * p.ret AS pnl, b.close + 1 AS ask, b.close - 1 AS bid,
                 abs(p.position - coalesce(lag(p.position) OVER (PARTITION BY p.ticker ORDER BY p.timestamp), 0)) AS turnover
          FROM ({_POSITIONS}) p JOIN fx_bars b ON b.symbol = p.ticker AND b.ts = p.timestamp) c""")
def _(t):
    quoted = t.bars.withColumn("close_ask_price", F.col("close") + 1).withColumn("close_bid_price", F.col("close") - 1)
    costed = bt.with_costs(bt.positions(bt.features_with_prices(t.features, quoted)))
    return costed.select("ticker", plain_ts("timestamp").alias("timestamp"),
                         *[F.round(c, 4).alias(c) for c in ("turnover", "cost", "net_pnl")])


def flagship(t):
    """Daily bars of the event stream, a range signal, and its backtest."""
    # The bars feed the signal and the prices; they are small and written once.
    daily = cut_lineage(resample.resample_bars(t.quotes, "1d"))
    largest = largest_group(daily, ["symbol"])
    features = signals.build_feature(daily, "1d", _Z, largest=largest)
    curve = bt.backtest(bt.features_with_prices(features, daily), largest=largest)
    return curve.select(plain_ts("timestamp").alias("timestamp"), r6("pnl").alias("pnl"), r6("cum_pnl").alias("cum_pnl"))


@check("flagship_signal_backtest", f"""
    WITH d AS (SELECT symbol, bar_ts AS ts, max(mid) AS high, min(mid) AS low, arg_max(mid, ts) AS close
               FROM (SELECT *, (bid_price + ask_price) / 2 AS mid, {_end_sql('1d')} AS bar_ts FROM fx_quotes) q
               GROUP BY symbol, bar_ts),
    z AS (SELECT symbol, ts, close, CASE WHEN n = 5 AND dev > 0 THEN (v - mean) / dev END AS alpha FROM (
            SELECT *, count(*) OVER {_FRAME} AS n, avg(v) OVER {_FRAME} AS mean, stddev_samp(v) OVER {_FRAME} AS dev
            FROM (SELECT *, (high - low) / close AS v FROM d) a) b),
    r AS (SELECT *, lead(close) OVER {_ORDER} / close - 1 AS ret FROM z WHERE alpha IS NOT NULL),
    p AS (SELECT ts, ret, alpha - avg(alpha) OVER (PARTITION BY ts) AS z FROM r WHERE ret IS NOT NULL),
    c AS (SELECT ts, sum(10000 * z / CASE WHEN g = 0 THEN 1 ELSE g END * ret) AS pnl
          FROM (SELECT *, sum(abs(z)) OVER (PARTITION BY ts) AS g FROM p) q GROUP BY ts)
    SELECT ts AS timestamp, round(pnl, 6) AS pnl, round(sum(pnl) OVER (ORDER BY ts), 6) AS cum_pnl FROM c""")
def _(t):
    return flagship(t)
