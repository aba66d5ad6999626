"""Streams run to the end of their input, each against the batch answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.checks.registry import check, plain_ts, r6
from tallyweave.functions.text import content_hash
from tallyweave.session import work_path
from tallyweave.streaming import events as ev, folds, monitors


def _lines(t, repeat: int = 1, noise: bool = False, clock: bool = False):
    """Call events of the conversations as JSON lines in a folder: a start on the first turn, an update per
    turn, an end after the last turn of completed calls, and feedback. `noise` adds lines to be rejected, `clock` feedback of a
    later day, which moves the watermark past all ends."""
    def event(rows, kind, at, data):
        return rows.select(F.to_json(F.struct(
            F.lit(kind).alias("type"), F.concat(F.lit("call-"), F.col("id")).alias("callId"), data.alias("data"),
            F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"))).alias("value"))

    segments = t.segments.select(F.col("call_id").alias("id"), F.concat(F.lit("call-"), "call_id", F.lit("-"), "id").alias("segment_id"), "speaker", "text", "timestamp")
    said = F.struct(F.struct(F.col("segment_id").alias("id"), "speaker", "text").alias("segment"))
    all_lines = event(t.calls, "callStarted", "start_time", F.struct(F.col("type").alias("call_type"), "phone_number",
                                                                     F.lit("in-progress").alias("status")))
    for _ in range(repeat):
        all_lines = all_lines.union(event(segments, "transcriptUpdate", "timestamp", said))
    all_lines = all_lines.union(event(t.calls.where("end_time IS NOT NULL"), "callEnded", "end_time", F.struct("outcome")))
    reviews = t.feedback.select(F.col("call_id").alias("id"), "rating", "created_at", F.col("category").alias("comments"))
    all_lines = all_lines.union(event(reviews, "feedbackSubmitted", "created_at", F.struct("rating", "comments")))
    if clock:
        latest = t.calls.agg(F.lit("none").alias("id"), F.expr("max(end_time) + INTERVAL 1 DAY").alias("at"))
        all_lines = all_lines.union(event(latest, "feedbackSubmitted", "at", F.struct(F.lit(0).alias("rating"))))
    if noise:
        all_lines = all_lines.union(event(t.calls, "callMuted", "start_time", F.struct("outcome"))).union(
            t.calls.select(F.concat(F.lit("{broken "), F.col("id").cast("string")).alias("value"))).union(
            t.calls.select(F.concat(F.lit('{"type": "callEnded", "data": {"n": '), F.col("id").cast("string"), F.lit("}}")).alias("value")))
    folder = work_path(t.spark, "events")
    all_lines.repartition(4).write.text(folder)
    return folder


def _events(t, **how):
    return ev.read_call_events(ev.stream_lines(t.spark, _lines(t, **how)))


def _paths(t, name):
    root = work_path(t.spark, name)
    return f"{root}/out", f"{root}/checkpoint"


@check("stm01_read_call_events", """
    SELECT 'callStarted' AS type, count(*) AS n FROM fx_calls UNION ALL SELECT 'transcriptUpdate', count(*) FROM fx_segments
    UNION ALL SELECT 'callEnded', count(end_time) FROM fx_calls UNION ALL SELECT 'feedbackSubmitted', count(*) FROM fx_feedback""")
def _(t):
    out, mark = _paths(t, "stm01")
    ev.run_append(_events(t, noise=True), out, mark)
    return t.spark.read.parquet(out).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@check("stm01_rejected_events", """
    SELECT 'unknown_type' AS reason, count(*) AS n FROM fx_calls UNION ALL SELECT 'unreadable', count(*) FROM fx_calls
    UNION ALL SELECT 'no_call_id', count(*) FROM fx_calls""")
def _(t):
    out, mark = _paths(t, "stm01r")
    ev.run_append(ev.rejected_call_events(ev.stream_lines(t.spark, _lines(t, noise=True))), out, mark)
    return t.spark.read.parquet(out).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _state(t):
    out, mark = _paths(t, "stm02")
    with ev.settings(t.spark, folds.STATE_STORE):
        ev.run_updates(folds.call_state(_events(t, repeat=2)), out, mark)
    return ev.latest_updates(t.spark, out, ["call_id"])


@check("stm02_call_state", """
    SELECT 'call-' || id AS call_id, status, start_time, end_time, turns AS segments FROM fx_calls""")
def _(t):
    return _state(t).select("call_id", "status", plain_ts("start_time").alias("start_time"), plain_ts("end_time").alias("end_time"), "segments")


@check("stm03_active_calls", "SELECT 'call-' || id AS call_id, turns AS segments FROM fx_calls WHERE status <> 'completed'")
def _(t):
    return folds.active_calls(_state(t)).select("call_id", "segments")


@check("stm04_call_lifecycle", "SELECT 'call-' || id AS call_id, status, start_time, end_time, turns AS segments FROM fx_calls WHERE end_time IS NOT NULL")
def _(t):
    out, mark = _paths(t, "stm04")
    with ev.settings(t.spark, folds.STATE_STORE):
        ev.run_append(folds.call_lifecycle(_events(t, repeat=2, clock=True)), out, mark, timeout_s=600)
    done = t.spark.read.parquet(out)
    return done.select("call_id", "status", plain_ts(F.timestamp_micros("start_us")).alias("start_time"),
                       plain_ts(F.timestamp_micros("end_us")).alias("end_time"), "segments")


@check("stm05_metrics_every_minute", """
    SELECT count(*) AS total_calls, round(avg(epoch(end_time - start_time)), 6) AS average_duration,
           count(*) FILTER (WHERE type = 'sales') AS calls_sales FROM fx_calls""")
def _(t):
    stored = work_path(t.spark, "calls")
    out, mark = _paths(t, "stm05")

    def save(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    # two halves; between them the query is stopped and goes on from its checkpoint
    for half in (0, 1):
        t.calls.where(F.pmod(F.xxhash64("id"), F.lit(2)) == half).write.mode("append").parquet(stored)
        calls = t.spark.readStream.schema(t.calls.schema).parquet(stored)
        query = monitors.metrics_every_minute(calls, save, mark, every="0 seconds")
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    last = t.spark.read.parquet(out)
    newest = last.groupBy().agg(F.max_by(F.struct("total_calls", "average_duration", "calls_sales"), "batch").alias("r"))
    return newest.select("r.total_calls", r6("r.average_duration").alias("average_duration"), "r.calls_sales")


@check("stm06_rate_limit_violations", """
    SELECT time_bucket(INTERVAL '15 minutes', ts) AS window_start, client % 10 AS client, count(*) AS n FROM fx_log
    GROUP BY 1, 2 HAVING count(*) > 1""")
def _(t):
    out, mark = _paths(t, "stm06")
    log = ev.stream_table(t.spark, t.folder, "events", t.table("events").schema).select(
        F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 10).alias("client"))
    ev.run_updates(monitors.rate_limit_violations(log, limit=1), out, mark)
    return ev.latest_updates(t.spark, out, ["window_start", "client"]).withColumn("window_start", plain_ts("window_start"))


@check("stm07_agent_task_status", """
    SELECT user_id, conversation_id, arg_max(state, (ts, event_id)) AS state, max(ts) AS since FROM (
        SELECT user_id, event_id % 40 AS conversation_id, CASE event_id % 5 WHEN 0 THEN 'thinking' WHEN 1 THEN 'executing_skill'
               WHEN 2 THEN 'completed' WHEN 3 THEN 'error' END AS state, ts, event_id FROM events) e
    WHERE state IS NOT NULL GROUP BY user_id, conversation_id""")
def _(t):
    out, mark = _paths(t, "stm07")
    i = F.col("event_id")
    kind = F.when(i % 5 == 0, "thinking").when(i % 5 == 1, "executing_skill").when(i % 5 == 2, "completed").when(
        i % 5 == 3, "error").otherwise("typing")
    tasks = ev.stream_table(t.spark, t.folder, "events", t.table("events").schema).select(
        "user_id", (i % 40).alias("conversation_id"), kind.alias("type"), F.col("ts").cast("timestamp").alias("ts"), i.alias("seq"))
    with ev.settings(t.spark, folds.STATE_STORE):
        ev.run_updates(monitors.agent_task_status(tasks), out, mark)
    return ev.latest_updates(t.spark, out, ["user_id", "conversation_id"], by="since").withColumn("since", plain_ts("since"))


@check("stm08_feedback_stream", """
    SELECT 'call-' || f.call_id AS call_id, f.rating, f.category AS comments, f.created_at, c.type AS call_type, c.outcome
    FROM fx_feedback f JOIN fx_calls c ON c.id = f.call_id""")
def _(t):
    out, mark = _paths(t, "stm08")
    ev.run_append(monitors.feedback_stream(_events(t), t.calls.withColumn("id", F.concat(F.lit("call-"), "id"))), out, mark)
    return t.spark.read.parquet(out).withColumn("created_at", plain_ts("created_at"))


@check("stm09_transcript_merge", "SELECT 'call-' || call_id AS call_id, 'call-' || call_id || '-' || id AS segment_id, speaker, md5(text) AS text, timestamp AS ts FROM fx_segments")
def _(t):
    out, mark = _paths(t, "stm09")
    ev.run_append(folds.transcript_merge(_events(t, repeat=2)), out, mark)
    return t.spark.read.parquet(out).withColumn("text", content_hash("text")).withColumn("ts", plain_ts("ts"))
