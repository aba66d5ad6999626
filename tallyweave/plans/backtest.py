"""Dollar-neutral backtest of a signal, as one DataFrame chain."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyweave import scale
from tallyweave.functions.numeric import finite
from tallyweave.functions.rolling import delay, forward_return
from tallyweave.operators.crosssection import BOOK_SIZE, centred, divisor, neutralise
from tallyweave.session import cut_lineage


def features_with_prices(features: DataFrame, bars: DataFrame) -> DataFrame:
    """Signal rows with the bar of the same ticker and instant."""
    prices = bars.select(F.col("symbol").alias("ticker"), F.col("ts").alias("timestamp"), "close",
                         *[c for c in ("open_ask_price", "close_ask_price", "open_bid_price", "close_bid_price")
                           if c in bars.columns])
    return features.join(prices, ["ticker", "timestamp"])


def add_forward_return(df: DataFrame, lookahead: int = 1, out: str = "ret", rows_per_task: int | None = None,
                       largest: int | None = None) -> DataFrame:
    """Return over the next `lookahead` rows of the same ticker; rows without one are dropped.

    Here and below `largest` is a known bound on the rows of a ticker; without it they are counted, which runs the
    plan behind `df` once more."""
    series = scale.Series(["ticker"], ["timestamp"])
    found = scale.evaluate(df, series, {out: lambda s: forward_return(s, "close", lookahead)}, rows_per_task, largest)
    return found.dropna(subset=[out])


def positions(df: DataFrame, lookahead: int = 1, rows_per_task: int | None = None, largest: int | None = None) -> DataFrame:
    """ticker, timestamp, position, ret, pnl per row."""
    held = neutralise(add_forward_return(df, lookahead, rows_per_task=rows_per_task, largest=largest))
    return held.withColumn("pnl", finite(F.col("position") * F.col("ret")))


def _accumulated(per_instant: DataFrame, rows_per_task: int | None) -> DataFrame:
    """Running sum over instants. The per-instant table is written once, so that neither the size check nor
    the running sum repeats the work behind it."""
    return scale.running_total(cut_lineage(per_instant), [], ["timestamp"], "pnl", "cum_pnl", rows_per_task)


def pnl_curve(rows: DataFrame, pnl: str = "pnl", rows_per_task: int | None = None) -> DataFrame:
    """PnL per instant and its running sum, from rows that carry their PnL."""
    return _accumulated(rows.groupBy("timestamp").agg(F.sum(pnl).alias("pnl")), rows_per_task)


def row_curve(rows: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """Running PnL row by row in (timestamp, ticker) order: total of earlier instants plus the running
    sum inside the instant; a missing PnL adds nothing.

    The rows are written once. The sums per instant and the rows themselves are read from there, so the plan behind them
    runs once. Two levels of sums also keep the rounding error of long curves small."""
    stored = cut_lineage(rows)
    curve = pnl_curve(stored, rows_per_task=rows_per_task)
    before = curve.select("timestamp", (F.col("cum_pnl") - F.coalesce("pnl", F.lit(0.0))).alias("__before"))
    inside = scale.running_total(stored, ["timestamp"], ["ticker"], "pnl", "__inside", rows_per_task)
    total = F.coalesce("__before", F.lit(0.0)) + F.coalesce("__inside", F.lit(0.0))
    return inside.join(before, "timestamp").withColumn("cum_pnl", total).drop("__before", "__inside")


def backtest(df: DataFrame, lookahead: int = 1, rows_per_task: int | None = None, largest: int | None = None) -> DataFrame:
    """timestamp, pnl, cum_pnl from (timestamp, ticker, alpha, close).

    The curve needs only sums per instant, so positions are never joined back to the rows.
    """
    held = centred(add_forward_return(df, lookahead, rows_per_task=rows_per_task, largest=largest))
    sums = held.groupBy("timestamp").agg(F.sum(F.abs("z")).alias("gross"), F.sum(F.col("z") * F.col("ret")).alias("gain"))
    per_instant = sums.select("timestamp", finite(BOOK_SIZE * F.col("gain") / divisor("gross")).alias("pnl"))
    return _accumulated(per_instant, rows_per_task)


def metrics(curve: DataFrame, periods_per_year: float = 252.0, rows_per_task: int | None = None) -> DataFrame:
    """One row: total, mean, stdev, Sharpe ratio, maximum drawdown, hit rate."""
    peaks = scale.running_max(curve, ["timestamp"], "cum_pnl", "peak", rows_per_task)
    mean, dev = F.avg("pnl"), F.stddev_samp("pnl")
    return peaks.agg(
        F.count("pnl").alias("periods"), F.sum("pnl").alias("total_pnl"), mean.alias("mean_pnl"),
        dev.alias("stdev_pnl"),
        finite(F.try_divide(mean, dev) * F.sqrt(F.lit(periods_per_year))).alias("sharpe"),
        F.max(F.greatest("peak", F.lit(0.0)) - F.col("cum_pnl")).alias("max_drawdown"),
        F.avg((F.col("pnl") > 0).cast("double")).alias("hit_rate"),
    )


def with_costs(rows: DataFrame, rows_per_task: int | None = None, largest: int | None = None) -> DataFrame:
    """Half the closing spread on the change of position since the ticker's previous row.

    Unless `largest` bounds the rows of a ticker, the rows are written once, counted, and read from there."""
    series = scale.Series(["ticker"], ["timestamp"])
    rows = rows if largest is not None else cut_lineage(rows)
    moved = scale.evaluate(rows, series, {"__prior": lambda s: delay(s, "position", 1)}, rows_per_task, largest)
    mid = (F.col("close_ask_price") + F.col("close_bid_price")) / 2
    half = F.try_divide(F.col("close_ask_price") - F.col("close_bid_price"), 2 * mid)
    turnover = F.abs(F.col("position") - F.coalesce("__prior", F.lit(0.0)))
    return (
        moved.withColumn("turnover", turnover)
        .withColumn("cost", F.coalesce(finite(turnover * half), F.lit(0.0)))
        .withColumn("net_pnl", F.col("pnl") - F.col("cost")).drop("__prior")
    )
