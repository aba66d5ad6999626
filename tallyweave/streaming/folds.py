"""Per-call state from events.

On a stream each call keeps one small row and the ids of its segments, so a turn that is sent again counts once. Timers in
event time end that state: a finished call leaves when the watermark has passed its end, so turns that come in after the
end event still count, and a silent call is forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyweave.streaming.events import WATERMARK

#: A call without an event for so long, in event time, is forgotten.
SILENCE_MS = 24 * 3600 * 1000


def _status():
    kind = F.col("type")
    return (
        F.when(kind == "callStarted", F.coalesce("data.status", F.lit("ringing")))
        .when(kind == "callEnded", "completed").when(kind.isin("statusUpdate", "transcriptUpdate"), F.col("data.status"))
    )


def call_state(events: DataFrame, silence_ms: int = SILENCE_MS, watermark: str = WATERMARK) -> DataFrame:
    """call_id, status, start_time, end_time, segments of a table, or of a stream in update mode.

    The last status by event time wins, and a call that ended stays completed. A segment counts once however often it
    is sent; segments without an id count each time. Feedback and
    events without a time make no call. On a stream, events behind the watermark are
    dropped, and a call that stays silent is forgotten; `STATE_STORE` must be set before the stream starts.
    """
    if events.isStreaming:
        state = _per_call(events, _Calls(silence_ms, at_end=False), "Update", watermark)
        return state.select("call_id", F.timestamp_micros("start_us").alias("start_time"),
                            F.timestamp_micros("end_us").alias("end_time"), "segments", "status")
    kind, status, turn = F.col("type"), _status(), F.col("type") == "transcriptUpdate"
    folded = events.where((kind != "feedbackSubmitted") & F.col("ts").isNotNull()).groupBy("call_id").agg(
        F.max_by(status, F.when(status.isNotNull(), F.col("ts"))).alias("last_status"),
        F.min(F.when(kind == "callStarted", F.col("ts"))).alias("start_time"),
        F.max(F.when(kind == "callEnded", F.col("ts"))).alias("end_time"),
        (F.count_distinct(F.when(turn, F.col("data.segment_id")))
         + F.count(F.when(turn & F.col("data.segment_id").isNull(), 1))).alias("segments"),
    )
    return folded.withColumn("status", F.when(F.col("end_time").isNotNull(), "completed").otherwise(
        F.col("last_status"))).drop("last_status")


def active_calls(state: DataFrame) -> DataFrame:
    return state.where("start_time IS NOT NULL AND status <> 'completed'")


_CALL = "status string, status_us bigint, start_us bigint, end_us bigint, segments bigint"
_FIELDS = ["status", "status_us", "start_us", "end_us", "segments", "last_us", "timer_ms"]


def _later(a, b):
    return b if a is None else a if b is None else max(a, b)


def _sooner(a, b):
    return b if a is None else a if b is None else min(a, b)


class _Calls(StatefulProcessor):
    """One row and the segment ids of each open call. Emits a call at every change, or once, when it is over."""

    def __init__(self, silence_ms: int, at_end: bool):
        self.silence_ms, self.at_end = silence_ms, at_end

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.call = handle.getValueState("call", f"{_CALL}, last_us bigint, timer_ms bigint")
        self.seen = handle.getListState("seen", "segment_id string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # a call to the state costs far more than a row: one each for what is read and written, however many rows there are
        stored = self.call.get()
        call = dict(zip(_FIELDS, stored or (None, None, None, None, 0, None, None)))
        known, new = None, {}
        for part in rows:
            newest = None
            for kind, status, name, us in zip(*(part[c].tolist() for c in ("type", "status", "segment_id", "us"))):
                if us != us or us is None:
                    continue
                us = int(us)
                call["last_us"] = _later(call["last_us"], us)
                if isinstance(status, str) and (newest is None or us > newest[1]):
                    newest = status, us
                if kind == "callStarted":
                    call["start_us"] = _sooner(call["start_us"], us)
                elif kind == "callEnded":
                    call["end_us"] = _later(call["end_us"], us)
                elif kind == "transcriptUpdate" and isinstance(name, str):
                    if known is None:
                        known = {r[0] for r in self.seen.get()} if stored else set()
                    if name not in known:
                        new[name] = None
                elif kind == "transcriptUpdate":
                    call["segments"] += 1
            if newest and (call["status_us"] is None or newest[1] >= call["status_us"]):
                call["status"], call["status_us"] = newest
        if call["last_us"] is None:
            return
        if new:
            self.seen.appendList([(name,) for name in new])
            call["segments"] += len(new)
        if call["end_us"] is not None:
            call["status"] = "completed"
        over = self.at_end and call["end_us"] is not None
        timer = int(call["end_us"]) // 1000 if over else int(call["last_us"]) // 1000 + self.silence_ms
        if timer != call["timer_ms"]:
            if call["timer_ms"] is not None:
                self.handle.deleteTimer(call["timer_ms"])
            self.handle.registerTimer(timer)
            call["timer_ms"] = timer
        self.call.update(tuple(None if v is None else v if isinstance(v, str) else int(v) for v in call.values()))
        if not self.at_end:
            yield self._row(key, call)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        call = dict(zip(_FIELDS, self.call.get()))
        self.call.clear()
        self.seen.clear()
        if self.at_end and call["end_us"] is not None:
            yield self._row(key, call)

    @staticmethod
    def _row(key, call: dict) -> pd.DataFrame:
        return pd.DataFrame({"call_id": [key[0]], "status": [call["status"]], **{
            c: pd.array([call[c]], "Int64") for c in ("status_us", "start_us", "end_us", "segments")}})

    def close(self) -> None:
        pass


def _per_call(events: DataFrame, processor: StatefulProcessor, mode: str, watermark: str) -> DataFrame:
    # feedback moves the watermark on but makes no call; a test of `ts` is not pushed below the watermark
    told = events.withWatermark("ts", watermark).where("type <> 'feedbackSubmitted' OR ts IS NULL").select(
        "call_id", "type", _status().alias("status"), "data.segment_id", F.unix_micros("ts").alias("us"), "ts")
    return told.groupBy("call_id").transformWithStateInPandas(
        processor, outputStructType=f"call_id string, {_CALL}", outputMode=mode, timeMode="EventTime")


def call_lifecycle(events: DataFrame, silence_ms: int = SILENCE_MS, watermark: str = WATERMARK) -> DataFrame:
    """Stream of finished calls (call_id, status, status_us, start_us, end_us, segments), each once.

    A call is emitted when the watermark has passed its end, so turns up to `watermark` late are part of it; events
    behind the watermark are dropped. A call that never ends is forgotten after the silence. Segments count as in `call_state`.
    """
    return _per_call(events, _Calls(silence_ms, at_end=True), "Append", watermark)


# The setting that `call_state`, `call_lifecycle` and `agent_task_status` need before their stream starts.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass":
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def transcript_merge(events: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Segments of a stream, each once however often it is sent."""
    segments = events.where("type = 'transcriptUpdate' AND data.segment_id IS NOT NULL").select(
        "call_id", "data.segment_id", "data.speaker", "data.text", "ts")
    return segments.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["segment_id"])
