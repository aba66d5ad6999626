"""Running figures over event streams; each function takes a stream or a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyweave import vocab
from tallyweave.operators.calls import call_metrics
from tallyweave.streaming.events import WATERMARK
from tallyweave.streaming.folds import SILENCE_MS

# Request limit, its window and the dashboard's refresh.
REQUESTS_PER_WINDOW = 100
LIMIT_WINDOW = "15 minutes"
REFRESH = "60 seconds"


def metrics_every_minute(calls: DataFrame, save, checkpoint: str, every: str = REFRESH) -> StreamingQuery:
    """Call metrics recomputed each minute; `save(batch, number)` receives the one row. Stopped and started again with the
    same checkpoint, it goes on from the calls it has counted."""
    return (
        call_metrics(calls).writeStream.outputMode("complete").foreachBatch(save)
        .option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
    )


def rate_limit_violations(log: DataFrame, limit: int = REQUESTS_PER_WINDOW, window: str = LIMIT_WINDOW) -> DataFrame:
    """Windows in which a client sent more requests than allowed."""
    counts = log.withWatermark("ts", window).groupBy(F.window("ts", window), "client").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") > limit).select(
        F.col("window.start").alias("window_start"), "client", "n")


def agent_task_status(events: DataFrame, silence_ms: int = SILENCE_MS, watermark: str = WATERMARK) -> DataFrame:
    """The last task state of each user's conversation, by time and then `seq`; of a table, or of a stream in update mode.

    On a stream the state is kept for spans of `silence_ms` of event time and given back when the watermark has passed a span's
    end. A batch gives the last state of each span that it changes; the row with the greatest `since` is the conversation's
    (`latest_updates` with `by`). Events behind the watermark, or without a time, are dropped.
    """
    known = events.where(F.col("type").isin(vocab.TASK_STATES) & F.col("ts").isNotNull())
    keys = ["user_id", "conversation_id"]
    if events.isStreaming:
        # other events move the watermark on as well: a test of `ts` is not pushed below it
        known = events.withWatermark("ts", watermark).where(F.col("type").isin(vocab.TASK_STATES) | F.col("ts").isNull())
        keys.append(F.window("ts", f"{silence_ms} milliseconds"))
    return known.groupBy(*keys).agg(F.max_by("type", F.struct("ts", "seq")).alias("state"), F.max("ts").alias("since")).select(
        "user_id", "conversation_id", "state", "since")


def feedback_stream(events: DataFrame, calls: DataFrame) -> DataFrame:
    """Submitted feedback with its call; the calls are a static table."""
    sent = events.where("type = 'feedbackSubmitted'").select(
        "call_id", "data.rating", "data.comments", F.col("ts").alias("created_at"))
    known = calls.select(F.col("id").alias("call_id"), F.col("type").alias("call_type"), "outcome")
    return sent.join(known, "call_id")
