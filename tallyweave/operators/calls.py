"""Calls, transcripts, feedback and their metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyweave import scale, vocab
from tallyweave.operators.nesting import CHILDREN_PER_PAGE, nest

_SEGMENT_FIELDS = ["id", "timestamp", "speaker", "text"]


def calls_with_transcript(calls: DataFrame, segments: DataFrame, per_page: int = CHILDREN_PER_PAGE) -> DataFrame:
    return nest(calls, segments, "id", "call_id", ["timestamp", "id"], _SEGMENT_FIELDS, "segments", per_page)


def recent_calls(calls: DataFrame, segments: DataFrame, limit: int = 10) -> DataFrame:
    """The newest calls with their transcripts; only their segments are read into the nest."""
    newest = calls.orderBy(F.col("start_time").desc(), F.col("id").desc()).limit(limit)
    wanted = segments.join(newest.select(F.col("id").alias("call_id")), "call_id", "left_semi")
    return calls_with_transcript(newest, wanted)


def calls_to_review(calls: DataFrame, feedback: DataFrame, limit: int | None = None) -> DataFrame:
    """Completed calls without feedback, the newest first."""
    reviewed = feedback.select(F.col("call_id").alias("id"))
    left = calls.where("status = 'completed'").join(reviewed, "id", "left_anti")
    ordered = left.orderBy(F.col("start_time").desc(), F.col("id").desc())
    return ordered.limit(limit) if limit else ordered


def segment_index(segments: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """0-based position inside the call and the id built from it."""
    placed = scale.ordinal(segments, ["call_id"], ["timestamp", "id"], "__n", rows_per_task)
    at = F.col("__n") - 1
    return placed.withColumn("position", at).withColumn(
        "segment_id", F.concat_ws("-", F.col("call_id").cast("string"), at.cast("string"))).drop("__n")


def active_segment_at(segments: DataFrame, probes: DataFrame, slice_s: int = 60,
                      rows_per_task: int | None = None) -> DataFrame:
    """The segment that plays at each probe (call_id, at_s): start <= at_s < next start, offsets in seconds
    from the call start (`offset_s` on segments); the last segment has no end. Probes before the first
    segment find nothing.

    Segments are laid over time slices and joined on (call, slice), so that a long call does not pair
    every probe with every segment. The last segment of each call is joined on the call alone.
    """
    series = scale.Series(["call_id"], ["offset_s", "id"])
    ended = scale.evaluate(
        segments, series, {"end_s": lambda s: F.lead("offset_s").over(s.following(1))}, rows_per_task
    ).select("call_id", F.col("id").alias("segment_id"), "offset_s", "end_s")
    slices = F.sequence(F.floor(F.col("offset_s") / slice_s), F.floor(F.col("end_s") / slice_s))
    inner = ended.where("end_s > offset_s").withColumn("slice", F.explode(slices))
    sliced = probes.withColumn("slice", F.floor(F.col("at_s") / slice_s))
    bounded = sliced.join(inner, ["call_id", "slice"]).where("at_s >= offset_s AND at_s < end_s")
    final = probes.join(ended.where("end_s IS NULL"), "call_id").where("at_s >= offset_s")
    columns = [*probes.columns, "segment_id"]
    return bounded.select(*columns).unionByName(final.select(*columns))


def feedback_enriched(feedback: DataFrame, calls: DataFrame, reviewers: DataFrame) -> DataFrame:
    call = calls.select(F.col("id").alias("call_id"), F.col("type").alias("call_type"), "outcome")
    who = reviewers.select(F.col("id").alias("reviewer_id"), F.col("name").alias("reviewer"))
    return feedback.join(call, "call_id").join(who, "reviewer_id")


def call_seconds(start: str = "start_time", end: str = "end_time") -> Column:
    span = F.unix_micros(F.col(end).cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp"))
    return span / 1_000_000


def call_metrics(calls: DataFrame, start=None, end=None) -> DataFrame:
    """One row: total, mean seconds of ended calls, success share of completed calls, counts by type and
    by outcome."""
    if start is not None:
        calls = calls.where(F.col("start_time") >= start)
    if end is not None:
        calls = calls.where(F.col("start_time") <= end)
    done = F.col("status") == "completed"
    won = F.coalesce(F.col("outcome").isin(vocab.SUCCESS_OUTCOMES), F.lit(False))
    outcomes = [o for values in vocab.OUTCOMES.values() for o in values]
    return calls.agg(
        F.count(F.lit(1)).alias("total_calls"), F.avg(call_seconds()).alias("average_duration"),
        F.avg(F.when(done, won.cast("double"))).alias("success_rate"),
        *[F.count_if(F.col("type") == t).alias(f"calls_{t}") for t in vocab.OUTCOMES],
        *[F.count_if(F.col("outcome") == o).alias(f"calls_{o}") for o in outcomes],
    )


def call_volume(calls: DataFrame, bucket: str = "4 hours", start=None, end=None) -> DataFrame:
    if start is not None:
        calls = calls.where(F.col("start_time") >= start)
    if end is not None:
        calls = calls.where(F.col("start_time") < end)
    return calls.groupBy(F.window("start_time", bucket)["start"].alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def training_metrics(feedback: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """One row: reviews, mean rating, and the mean of the later half by time minus that of the earlier."""
    total = feedback.count()
    placed = scale.ordinal(feedback.select("rating", "created_at", "id"), [], ["created_at", "id"], "n", rows_per_task)
    early = F.col("n") <= -(-total // 2)
    return placed.agg(
        F.count(F.lit(1)).alias("total_reviews"), F.avg("rating").alias("average_rating"),
        (F.avg(F.when(~early, F.col("rating"))) - F.avg(F.when(early, F.col("rating")))).alias("improvement_rate"))


def common_feedback(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def training_set(segments: DataFrame, feedback: DataFrame, min_rating: int = 1,
                 rows_per_task: int | None = None) -> DataFrame:
    """A user turn with the assistant turn right after it, for calls rated at least `min_rating`; once for each review of the
    call, with the review's id as `feedback` where reviews have one."""
    series = scale.Series(["call_id"], ["timestamp", "id"])
    paired = scale.evaluate(segments.select("call_id", "id", "timestamp", "speaker", "text"), series, {
        "next_speaker": lambda s: F.lead("speaker").over(s.following(1)),
        "output": lambda s: F.lead("text").over(s.following(1)),
    }, rows_per_task)
    review = [F.col("id").alias("feedback")] if "id" in feedback.columns else []
    rated = feedback.where(F.col("rating") >= min_rating).select("call_id", "rating", *review)
    pairs = paired.where("speaker = 'user' AND next_speaker = 'assistant'")
    return pairs.join(rated, "call_id").select("call_id", F.col("id").alias("segment_id"),
                                               F.col("text").alias("input"), "output", "rating", *rated.columns[2:])


def conversation_history(turns: DataFrame, key: str, order: list[str], fields: list[str], n: int = 5,
                         rows_per_task: int | None = None) -> DataFrame:
    """The n turns before each turn as an array, and `earlier`, the number of all turns before it.

    The full history of a turn is the first `earlier` turns of its transcript; it is not copied per row.
    """
    series = scale.Series([key], order)
    recent = scale.evaluate(turns, series, {
        "history": lambda s: F.collect_list(F.struct(*fields)).over(s.between(-n, -1)),
    }, rows_per_task, position="__n")
    return recent.withColumn("earlier", F.col("__n") - 1).drop("__n")


def status_history(changes: DataFrame, key: str = "id", order: tuple[str, ...] = ("ts", "seq"),
                   rows_per_task: int | None = None) -> DataFrame:
    """Every dated status with the one before it and its version number; `is_current` marks the last."""
    series = scale.Series([key], list(order))
    return scale.evaluate(changes, series, {
        "previous": lambda s: F.lag("status").over(s.previous(1)),
        "is_current": lambda s: F.lead(F.lit(1)).over(s.following(1)).isNull(),
    }, rows_per_task, position="version")
