"""Right-closed time bars from quotes and trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyweave.functions.numeric import finite
from tallyweave.schemas import BAR_COLUMNS

# Bar frequencies, finest first, with their length in seconds.
FREQUENCIES = {"1min": 60, "5min": 300, "15min": 900, "1h": 3_600, "4h": 14_400, "12h": 43_200, "1d": 86_400}

_QUOTE_BARS = BAR_COLUMNS[:8]


def _micros(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def bucket_end(micros: Column, freq: str) -> Column:
    """Right edge, in microseconds, of the bucket (start, end] that holds the instant: an edge tick closes
    its bar. Plain long arithmetic, because every aggregate repeats it."""
    length = F.lit(FREQUENCIES[freq] * 1_000_000)
    return micros - 1 - F.pmod(micros - 1, length) + length


def _edges(pick, values: dict[str, str], order: str) -> list[Column]:
    """First or last value of a bar by a numeric order: {value column: output name}. Stays in hash aggregation."""
    return [pick(v, order).alias(name) for v, name in values.items()]


_OPENING = {"mid": "open", "ask": "open_ask_price", "bid": "open_bid_price"}
_CLOSING = {"mid": "close", "ask": "close_ask_price", "bid": "close_bid_price"}


def _quote_level(quotes: DataFrame, freq: str, seq: str | None) -> DataFrame:
    """Quote bars with the bucket end in microseconds (`us`), from ticks that have both sides."""
    ticks = quotes.select("symbol", _micros().alias("at"), *([F.col(seq).alias("seq")] if seq else []),
                          finite("bid_price").alias("bid"), finite("ask_price").alias("ask"))
    whole = ticks.where("bid IS NOT NULL AND ask IS NOT NULL").withColumn("mid", (F.col("bid") + F.col("ask")) / 2)
    keyed = whole.withColumn("us", bucket_end(F.col("at"), freq)).groupBy("symbol", "us")
    height = [F.max("mid").alias("high"), F.min("mid").alias("low")]
    if seq is None:
        return keyed.agg(*height, *_edges(F.min_by, _OPENING, "at"), *_edges(F.max_by, _CLOSING, "at"))
    # Equal instants go by `seq`: the whole tick is the order, one struct for all opening or closing values.
    tick = F.struct("at", "seq", *_OPENING)
    bars = keyed.agg(*height, F.min(tick).alias("first"), F.max(tick).alias("last"))
    return bars.select(
        "symbol", "us", "high", "low", *[F.col(f"first.{v}").alias(name) for v, name in _OPENING.items()],
        *[F.col(f"last.{v}").alias(name) for v, name in _CLOSING.items()])


def _coarser(level: DataFrame, freq: str) -> DataFrame:
    """A coarser level from a finer one; one bar per symbol and end, so the end alone orders them."""
    fine = level.withColumn("end", bucket_end(F.col("us"), freq))
    return fine.groupBy("symbol", F.col("end").alias("us")).agg(
        F.max("high").alias("high"), F.min("low").alias("low"),
        *_edges(F.min_by, {c: c for c in _QUOTE_BARS if c.startswith("open")}, "us"),
        *_edges(F.max_by, {c: c for c in _QUOTE_BARS if c.startswith("close")}, "us"),
    ).select(*level.columns)


def _labelled(level: DataFrame, freq: str) -> DataFrame:
    return level.select("symbol", F.lit(freq).alias("freq"), F.timestamp_micros("us").alias("ts"), *_QUOTE_BARS)


def resample_bars(quotes: DataFrame, freq: str, seq: str | None = "seq") -> DataFrame:
    """Quote bars of two-sided ticks; empty buckets give no row. Pass seq=None where (symbol, ts) is known to
    be unique: the order is then one number and the aggregation needs no sort."""
    return _labelled(_quote_level(quotes, freq, seq), freq)


def coarsen(bars: DataFrame, freq: str) -> DataFrame:
    """Coarser quote bars from finer ones; the finer frequency must divide the coarser."""
    level = bars.select("symbol", _micros().alias("us"), *_QUOTE_BARS)
    return _labelled(_coarser(level, freq), freq)


def resample_all(quotes: DataFrame, seq: str | None = "seq") -> DataFrame:
    """All frequencies from one read of the quotes: up to an hour from the minute bars, beyond it from the
    hour bars. Spark reuses the shuffles of those two levels."""
    minute = _quote_level(quotes, "1min", seq)
    hour = _coarser(minute, "1h")
    result = _labelled(minute, "1min").unionByName(_labelled(hour, "1h"))
    for freq, base in [("5min", minute), ("15min", minute), ("4h", hour), ("12h", hour), ("1d", hour)]:
        result = result.unionByName(_labelled(_coarser(base, freq), freq))
    return result


def trade_bars(trades: DataFrame, freq: str) -> DataFrame:
    """Volume-weighted price, volumes and counts by side."""
    def of(side: str, value: Column) -> Column:
        return F.when(F.col("side") == side, value)

    one, qty = F.lit(1), F.col("qty")
    bars = trades.groupBy("symbol", bucket_end(_micros(), freq).alias("us")).agg(
        finite(F.try_divide(F.sum(F.col("price") * qty), F.sum(qty))).alias("vwap"),
        F.coalesce(F.sum(of("buy", qty)), F.lit(0.0)).alias("buy_volume"),
        F.coalesce(F.sum(of("sell", qty)), F.lit(0.0)).alias("sell_volume"),
        F.sum(qty).alias("total_volume"),
        F.count(of("buy", one)).cast("double").alias("buy_trades_count"),
        F.count(of("sell", one)).cast("double").alias("sell_trades_count"),
        F.count(one).cast("double").alias("total_trades_count"),
    )
    return bars.select("symbol", F.lit(freq).alias("freq"), F.timestamp_micros("us").alias("ts"), *BAR_COLUMNS[8:])


def full_bars(quotes: DataFrame, trades: DataFrame, freq: str, seq: str | None = "seq") -> DataFrame:
    """All canonical columns; a bucket with only quotes or only trades is kept."""
    return resample_bars(quotes, freq, seq).join(trade_bars(trades, freq), ["symbol", "freq", "ts"], "full_outer")
