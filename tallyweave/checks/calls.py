"""Calls, transcripts and feedback."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.checks.registry import check, lines, plain_ts, r6
from tallyweave.functions import dates as d, text as tx
from tallyweave.operators import calls as cl, changes, filtering as fl
from tallyweave.session import work_path
from tallyweave.sources import tables as tb

_SEG = "string_agg(s.speaker || ':' || s.id, '|' ORDER BY s.timestamp, s.id)"


def _who(nested="segments"):
    return lines(F.transform(nested, lambda s: F.concat_ws(":", s["speaker"], s["id"].cast("string"))))


@check("joi01_calls_with_transcript", f"""
    SELECT c.id, c.type, 0 AS page, coalesce({_SEG}, '') AS segments FROM fx_calls c
    LEFT JOIN fx_segments s ON s.call_id = c.id GROUP BY c.id, c.type""")
def _(t):
    return cl.calls_with_transcript(t.calls, t.segments).select("id", "type", "page", _who().alias("segments"))


@check("top01_recent_calls", f"""
    SELECT c.id, c.start_time, coalesce({_SEG}, '') AS segments
    FROM (SELECT * FROM fx_calls ORDER BY start_time DESC, id DESC LIMIT 10) c
    LEFT JOIN fx_segments s ON s.call_id = c.id GROUP BY c.id, c.start_time""")
def _(t):
    return cl.recent_calls(t.calls, t.segments, 10).select("id", plain_ts("start_time").alias("start_time"), _who().alias("segments"))


@check("str19_transcript_text", """
    SELECT call_id AS id, md5(string_agg(speaker || ': ' || text, chr(10) ORDER BY timestamp, id)) AS digest
    FROM fx_segments GROUP BY call_id""")
def _(t):
    nested = cl.calls_with_transcript(t.calls, t.segments)
    return nested.select("id", tx.content_hash(tx.transcript_text("segments")).alias("digest"))


@check("joi08_feedback_enriched", """
    SELECT f.id, f.rating, c.type AS call_type, c.outcome, u.name AS reviewer FROM fx_feedback f
    JOIN fx_calls c ON c.id = f.call_id JOIN fx_users u ON u.id = f.reviewer_id""")
def _(t):
    return cl.feedback_enriched(t.feedback, t.calls, t.users).select("id", "rating", "call_type", "outcome", "reviewer")


@check("joi10_active_segment_at", """
    SELECT p.call_id, p.at_s, s.id AS segment_id FROM (SELECT conv_id AS call_id, turn * 47 + 7 AS at_s FROM conversations) p
    JOIN (SELECT *, lead(offset_s) OVER (PARTITION BY call_id ORDER BY offset_s, id) AS end_s FROM fx_segments) s
    ON s.call_id = p.call_id AND p.at_s >= s.offset_s AND (s.end_s IS NULL OR p.at_s < s.end_s)""")
def _(t):
    probes = t.table("conversations").select(F.col("conv_id").alias("call_id"), (F.col("turn") * 47 + 7).alias("at_s"))
    return cl.active_segment_at(t.segments, probes).select("call_id", "at_s", "segment_id")


_UPDATES = """(SELECT conv_id AS call_id, CASE turn % 3 WHEN 0 THEN 'in-progress' WHEN 1 THEN 'failed' ELSE 'completed' END AS status,
    CASE WHEN turn % 2 = 0 THEN 'NoSale' END AS outcome, CASE WHEN turn % 4 = 1 THEN 'rec/' || conv_id || '/' || turn END AS url,
    TIMESTAMP '2024-03-01' + turn * INTERVAL '1' MINUTE AS ts, turn FROM conversations)"""


@check("joi20_apply_status_updates", f"""
    SELECT c.id, coalesce(u.status, c.status) AS status, CASE WHEN u.status = 'completed' THEN u.ts ELSE c.end_time END AS end_time,
           CASE WHEN u.status = 'completed' THEN coalesce(u.outcome, c.outcome) ELSE c.outcome END AS outcome, r.url AS recording_url
    FROM fx_calls c LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY turn DESC) AS k FROM {_UPDATES} x) u
         ON u.call_id = c.id AND u.k = 1
    LEFT JOIN (SELECT call_id, arg_max(url, turn) AS url FROM {_UPDATES} y WHERE url IS NOT NULL GROUP BY call_id) r ON r.call_id = c.id""")
def _(t):
    turn = F.col("turn")
    updates = t.table("conversations").select(
        F.col("conv_id").alias("call_id"),
        F.when(turn % 3 == 0, "in-progress").when(turn % 3 == 1, "failed").otherwise("completed").alias("status"),
        F.when(turn % 2 == 0, "NoSale").alias("outcome"),
        F.when(turn % 4 == 1, F.concat_ws("/", F.lit("rec"), F.col("conv_id").cast("string"), turn.cast("string"))).alias("recording_url"),
        F.timestamp_seconds(1709251200 + turn * 60).alias("ts"), turn.alias("seq"))
    found = changes.apply_status_updates(t.calls, updates)
    return found.select("id", "status", plain_ts("end_time").alias("end_time"), "outcome", "recording_url")


@check("fil04_filter_calls", """
    SELECT id, phone_number FROM fx_calls WHERE type = 'sales' AND status = 'completed' AND outcome = 'NoSale'
    AND start_time >= TIMESTAMP '2024-01-01' AND start_time <= TIMESTAMP '2024-01-20'""")
def _(t):
    return fl.filter_calls(t.calls, type="sales", status="completed", outcome="NoSale", start_date="2024-01-01",
                           end_date="2024-01-20").select("id", "phone_number")


@check("fil05_calls_to_review", """
    SELECT id, start_time FROM fx_calls WHERE status = 'completed' AND id NOT IN (SELECT call_id FROM fx_feedback WHERE rating = 3)""")
def _(t):
    return cl.calls_to_review(t.calls, t.feedback.where("rating = 3")).select("id", plain_ts("start_time").alias("start_time"))


@check("set04_except_reviewed", """
    SELECT id FROM fx_calls EXCEPT SELECT call_id FROM fx_feedback WHERE category = 'praise'""")
def _(t):
    reviewed = t.feedback.where("category = 'praise'").select(F.col("call_id").alias("id"))
    return t.calls.select("id").join(reviewed, "id", "left_anti")


_SECONDS = "epoch(end_time - start_time)"


@check("agg13_call_metrics", f"""
    SELECT count(*) AS total_calls, round(avg({_SECONDS}), 6) AS average_duration,
           round(avg(CASE WHEN status = 'completed' THEN CASE WHEN outcome IN ('SaleConfirmed', 'Resolved') THEN 1.0 ELSE 0.0 END END), 6) AS success_rate,
           count(*) FILTER (WHERE type = 'sales') AS calls_sales, count(*) FILTER (WHERE type = 'support') AS calls_support,
           {', '.join(f"count(*) FILTER (WHERE outcome = '{o}') AS calls_{o}" for o in
                      ('SaleConfirmed', 'LeadPending', 'NoSale', 'Resolved', 'NeedsFollowUp', 'Unresolved'))}
    FROM fx_calls""")
def _(t):
    found = cl.call_metrics(t.calls)
    return found.withColumn("average_duration", r6("average_duration")).withColumn("success_rate", r6("success_rate"))


@check("agg14_call_volume", """
    SELECT time_bucket(INTERVAL '4 hours', start_time) AS bucket, count(*) AS n FROM fx_calls
    WHERE start_time >= TIMESTAMP '2024-01-01' AND start_time < TIMESTAMP '2024-01-31' GROUP BY 1""")
def _(t):
    found = cl.call_volume(t.calls, "4 hours", F.lit("2024-01-01").cast("timestamp"), F.lit("2024-01-31").cast("timestamp"))
    return found.withColumn("bucket", plain_ts("bucket"))


@check("agg15_training_metrics", """
    SELECT count(*) AS total_reviews, round(avg(rating), 6) AS average_rating,
           round(avg(rating) FILTER (WHERE half = 2) - avg(rating) FILTER (WHERE half = 1), 6) AS improvement_rate
    FROM (SELECT *, ntile(2) OVER (ORDER BY created_at, id) AS half FROM fx_feedback) f""")
def _(t):
    found = cl.training_metrics(t.feedback)
    return found.withColumn("average_rating", r6("average_rating")).withColumn("improvement_rate", r6("improvement_rate"))


@check("agg15_common_feedback", "SELECT category, count(*) AS n FROM fx_feedback GROUP BY category")
def _(t):
    return cl.common_feedback(t.feedback)


@check("agg19_training_set", """
    SELECT p.call_id, p.id AS segment_id, md5(p.text) AS input, md5(p.output) AS output, f.rating, f.id AS feedback FROM (
        SELECT *, lead(speaker) OVER w AS next_speaker, lead(text) OVER w AS output FROM fx_segments
        WINDOW w AS (PARTITION BY call_id ORDER BY timestamp, id)) p
    JOIN fx_feedback f ON f.call_id = p.call_id AND f.rating >= 3 WHERE p.speaker = 'user' AND p.next_speaker = 'assistant'""")
def _(t):
    # a call that was reviewed several times gives its pairs once for each review
    pairs = cl.training_set(t.segments, t.feedback, 3)
    return pairs.select("call_id", "segment_id", tx.content_hash("input").alias("input"), tx.content_hash("output").alias("output"), "rating", "feedback")


@check("win19_segment_index", """
    SELECT id, row_number() OVER (PARTITION BY call_id ORDER BY timestamp, id) - 1 AS position,
           call_id || '-' || (row_number() OVER (PARTITION BY call_id ORDER BY timestamp, id) - 1) AS segment_id FROM fx_segments""")
def _(t):
    return cl.segment_index(t.segments).select("id", "position", "segment_id")


@check("win21_conversation_history", """
    SELECT id, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at, id) - 1 AS earlier,
           coalesce(string_agg(role || ':' || id, '|') OVER (PARTITION BY conversation_id ORDER BY created_at, id
               ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), '') AS history FROM fx_messages""")
def _(t):
    found = cl.conversation_history(t.messages, "conversation_id", ["created_at", "id"], ["role", "id"])
    shown = lines(F.transform("history", lambda m: F.concat_ws(":", m["role"], m["id"].cast("string"))))
    return found.select("id", "earlier", shown.alias("history"))


@check("win22_status_history", """
    SELECT user_id, id, status, lag(status) OVER w AS previous, row_number() OVER w AS version,
           lead(id) OVER w IS NULL AS is_current FROM fx_commands WINDOW w AS (PARTITION BY user_id ORDER BY timestamp, id)""")
def _(t):
    found = cl.status_history(t.commands, "user_id", ("timestamp", "id"))
    return found.select("user_id", "id", "status", "previous", "version", "is_current")


@check("dat02_durations", f"""
    SELECT id, s AS seconds, CAST(s // 60 AS VARCHAR) || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS mmss,
           CAST(round(s / 60) AS BIGINT) AS minutes, (s // 60) || 'm ' || (s % 60) || 's' AS words FROM (
        SELECT id, CAST(floor(epoch(coalesce(end_time, TIMESTAMP '2024-02-15 00:00:00') - start_time)) AS BIGINT) AS s FROM fx_calls) c""")
def _(t):
    s = t.calls.withColumn("s", d.duration_s("start_time", "end_time", F.lit("2024-02-15").cast("timestamp")))
    return s.select("id", F.col("s").alias("seconds"), d.duration_mmss("s").alias("mmss"),
                    d.duration_minutes("s").alias("minutes"), d.duration_words("s").alias("words"))


@check("str20_valid_outcome", """
    SELECT id, CASE WHEN label IN ('SaleConfirmed', 'LeadPending', 'NoSale') AND type = 'sales'
                      OR label IN ('Resolved', 'NeedsFollowUp', 'Unresolved') AND type = 'support' THEN label END AS outcome
    FROM (SELECT id, type, CASE WHEN id % 7 = 0 THEN 'Maybe' WHEN id % 4 = 0 THEN 'Resolved' ELSE outcome END AS label FROM fx_calls) c""")
def _(t):
    label = F.when(F.col("id") % 7 == 0, " Maybe").when(F.col("id") % 4 == 0, "Resolved\n").otherwise(F.concat(F.lit("  "), "outcome"))
    return t.calls.select("id", tx.valid_outcome("type", label).alias("outcome"))


@check("str21_response_confidence", """
    SELECT event_id, round(CASE WHEN event_type = 'click' THEN least(1.0, (1 - value / 1000) * 0.8 + 0.2) ELSE 0.5 END, 6) AS confidence
    FROM events""")
def _(t):
    finish = F.when(F.col("event_type") == "click", "stop").otherwise("length")
    return t.table("events").select("event_id", r6(tx.response_confidence(finish, F.col("value") / 1000)).alias("confidence"))

# --- stored tables --------------------------------------------------------------------------------

def _stored_calls(t):
    return t.calls.select(F.col("id").cast("string").alias("id"), "type", "status", "phone_number", "start_time", "end_time", "outcome")


@check("src11_scan_calls", "SELECT CAST(id AS VARCHAR) AS id, type, status, phone_number, start_time, end_time, outcome FROM fx_calls WHERE type = 'sales'")
def _(t):
    root = work_path(t.spark, "store")
    tb.append_rows(_stored_calls(t), root, "calls", F.lit("2024-03-01").cast("timestamp"))
    found = tb.scan_table(t.spark, root, "calls").where("type = 'sales'")
    return found.select("id", "type", "status", "phone_number", plain_ts("start_time").alias("start_time"),
                        plain_ts("end_time").alias("end_time"), "outcome")


@check("src13_append_call_rows", """
    SELECT CAST(id AS VARCHAR) AS id, CASE WHEN id % 2 = 0 THEN 'ringing' ELSE status END AS status,
           CASE WHEN id % 3 = 0 THEN TIMESTAMP '2024-03-01' ELSE start_time END AS start_time, TIMESTAMP '2024-03-01' AS created_at FROM fx_calls""")
def _(t):
    root = work_path(t.spark, "store")
    i = F.col("id").cast("bigint")
    rows = _stored_calls(t).withColumn("status", F.when(i % 2 == 1, F.col("status"))).withColumn(
        "start_time", F.when(i % 3 != 0, F.col("start_time")))
    tb.append_rows(rows, root, "calls", F.lit("2024-03-01").cast("timestamp"))
    found = tb.scan_table(t.spark, root, "calls")
    return found.select("id", "status", plain_ts("start_time").alias("start_time"), plain_ts("created_at").alias("created_at"))


@check("src13_append_message_pairs", """
    SELECT conv_id AS conversation_id, role, md5(text) AS content FROM (
        SELECT *, lead(role) OVER w AS next_role, lag(role) OVER w AS prev_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) c
    WHERE role = 'user' AND next_role = 'assistant' OR role = 'assistant' AND prev_role = 'user'""")
def _(t):
    pairs = cl.training_set(t.segments, t.calls.select(F.col("id").alias("call_id"), F.lit(5).alias("rating")))
    turns = pairs.select(F.col("call_id").alias("conversation_id"), F.col("input").alias("user_text"), F.col("output").alias("agent_text"))
    return tb.message_pairs(turns).withColumn("content", tx.content_hash("content"))
