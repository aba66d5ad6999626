"""Dates, durations and repeats."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from tallyweave import vocab


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def duration_s(start, end, as_of: Column) -> Column:
    """Whole seconds; a running interval ends at `as_of`."""
    stop = F.coalesce(_col(end), as_of).cast("timestamp")
    return F.floor((F.unix_micros(stop) - F.unix_micros(_col(start).cast("timestamp"))) / 1_000_000)


def duration_mmss(seconds) -> Column:
    return F.format_string("%d:%02d", F.floor(_col(seconds) / 60), F.pmod(_col(seconds), F.lit(60)))


def duration_minutes(seconds) -> Column:
    return F.round(_col(seconds) / 60).cast("bigint")


def duration_words(seconds) -> Column:
    return F.format_string("%dm %ds", F.floor(_col(seconds) / 60), F.pmod(_col(seconds), F.lit(60)))


def format_date(d, pattern: str) -> Column:
    """Tokens YYYY MMMM MMM MM DD dddd ddd HH mm ss, the longest first; all else is literal."""
    tokens = dict(vocab.DATE_TOKENS)
    parts = re.split(f"({'|'.join(tokens)})", pattern)
    java = "".join(tokens[p] if p in tokens else "'" + p.replace("'", "''") + "'" for p in parts if p)
    return F.date_format(_col(d), java)


def format_date_style(d, style: str) -> Column:
    return F.date_format(_col(d), vocab.DATE_STYLES[style])


def is_valid_date(s) -> Column:
    return F.try_to_timestamp(_col(s)).isNotNull()


def month_parts(ts) -> list[Column]:
    return [F.year(_col(ts)).alias("year"), F.month(_col(ts)).alias("month")]


def expand_reminders(df: DataFrame, start: str, end: str, due: str = "due_date", repeat: str = "repeat") -> DataFrame:
    """One row per occurrence inside [start, end]; no repeat means the due date alone."""
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    due_date = F.col(due).cast("date")
    steps = {"daily": "INTERVAL 1 DAY", "weekly": "INTERVAL 7 DAY", "monthly": "INTERVAL 1 MONTH",
             "yearly": "INTERVAL 1 YEAR"}
    dates = F.when(due_date > last, F.array().cast("array<date>"))
    for name, step in steps.items():
        dates = dates.when(F.col(repeat) == name, F.sequence(due_date, F.greatest(due_date, last), F.expr(step)))
    dates = dates.otherwise(F.array(due_date))
    return df.withColumn("occurrence", F.explode(F.filter(dates, lambda d: (d >= first) & (d <= last))))
