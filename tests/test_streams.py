"""Per-call state on streams: late and repeated turns, and state that is given back."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyweave.session import work_path
from tallyweave.streaming import events as ev, folds, monitors

START = datetime(2024, 5, 1, 12)


def event(kind, call, minute, **data):
    at = (START + timedelta(minutes=minute)).strftime("%Y-%m-%dT%H:%M:%SZ")
    return json.dumps({"type": kind, "callId": call, "timestamp": at, "data": data})


class Feed:
    """A folder of event lines, read batch by batch with one checkpoint."""

    def __init__(self, spark, make):
        self.spark, self.make = spark, make
        self.folder, self.out, self.mark = (work_path(spark, n) for n in ("lines", "out", "mark"))
        self.number = 0

    def send(self, *lines):
        """Runs the stream over one more file; the last progress with state."""
        self.spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.mode("append").text(self.folder)
        stream = self.make(ev.read_call_events(ev.stream_lines(self.spark, self.folder)))
        with ev.settings(self.spark, folds.STATE_STORE):
            query = (stream.writeStream.foreachBatch(lambda b, n: b.withColumn("n", F.lit(n)).write.mode("append").parquet(self.out))
                     .outputMode("append" if self.make is folds.call_lifecycle else "update")
                     .option("checkpointLocation", self.mark).trigger(availableNow=True).start())
            assert query.awaitTermination(120)
        return [p for p in query.recentProgress if p["stateOperators"]][-1]["stateOperators"][0]["numRowsTotal"]

    def rows(self, *columns):
        return self.spark.read.parquet(self.out).orderBy("n", "call_id").select(*columns).collect()


def turn(call, minute, name):
    return event("transcriptUpdate", call, minute, segment_id=name, speaker="agent", text="x")


def test_turn_after_the_end_counts(spark):
    feed = Feed(spark, folds.call_lifecycle)
    feed.send(event("callStarted", "a", 0), turn("a", 1, "s1"), event("callStarted", "b", 0))
    feed.send(event("callEnded", "a", 5))
    feed.send(turn("a", 4, "s2"), turn("a", 1, "s1"))
    assert [tuple(r) for r in feed.rows("call_id")] == []
    left = feed.send(event("feedbackSubmitted", "z", 60, rating=5))
    assert [(r.call_id, r.status, r.segments, r.end_us - r.start_us) for r in feed.rows("*")] == [("a", "completed", 2, 300_000_000)]
    before = left
    # far behind the watermark: nothing comes out twice; a call that never ends is forgotten
    left = feed.send(turn("a", 4, "s3"), event("callEnded", "a", 5), event("feedbackSubmitted", "z", 3 * 1440, rating=5))
    assert len(feed.rows("call_id")) == 1 and left < before


def test_repeated_turns_count_once_and_state_is_given_back(spark):
    feed = Feed(spark, folds.call_state)
    feed.send(event("callStarted", "a", 0, status="ringing"), turn("a", 1, "s1"), turn("a", 1, "s1"), event("transcriptUpdate", "a", 1))
    held = feed.send(turn("a", 1, "s1"), turn("a", 2, "s2"), event("statusUpdate", "a", 2, status="in-progress"))
    last = feed.rows("*")[-1]
    assert (last.call_id, last.segments, last.status, last.end_time) == ("a", 3, "in-progress", None)
    assert held > 0 and folds.active_calls(spark.read.parquet(feed.out)).count() == 2
    feed.send(event("feedbackSubmitted", "z", 3 * 1440, rating=5))
    assert feed.send(event("feedbackSubmitted", "z", 3 * 1440 + 60, rating=5)) == 0


def test_table_and_stream_agree(spark):
    lines = [event("callStarted", "a", 0), turn("a", 1, "s1"), turn("a", 1, "s1"), event("transcriptUpdate", "a", 2),
             event("callEnded", "a", 3), event("statusUpdate", "a", 4, status="late"), turn("b", 1, "s9")]
    feed = Feed(spark, folds.call_state)
    feed.send(*lines)
    batch = folds.call_state(ev.read_call_events(spark.createDataFrame([(x,) for x in lines], "value string")))
    columns = ["call_id", "status", "start_time", "end_time", "segments"]
    assert sorted(map(tuple, feed.rows(*columns))) == sorted(map(tuple, batch.select(*columns).collect()))
    assert ("a", 2) in [(r.call_id, r.segments) for r in batch.collect()]


def test_task_status_is_forgotten(spark):
    folder, out, mark = (work_path(spark, n) for n in ("tasks", "out", "mark"))
    schema = "user_id long, conversation_id string, type string, ts timestamp, seq long"

    def send(*rows):
        spark.createDataFrame([(u, c, k, START + timedelta(minutes=m), s) for u, c, k, m, s in rows], schema).coalesce(1).write.mode("append").parquet(folder)
        stream = monitors.agent_task_status(spark.readStream.schema(schema).parquet(folder))
        with ev.settings(spark, folds.STATE_STORE):
            query = stream.writeStream.foreachBatch(lambda b, n: b.write.mode("append").parquet(out)).outputMode("update").option(
                "checkpointLocation", mark).trigger(availableNow=True).start()
            assert query.awaitTermination(120)
        return [p for p in query.recentProgress if p["stateOperators"]][-1]["stateOperators"][0]["numRowsTotal"]

    assert send((1, "x", "thinking", 0, 1), (1, "x", "completed", 0, 2), (1, "x", "typing", 5, 3), (2, "y", "error", 1, 1)) > 0
    send((1, "x", "thinking", 0, 1))
    found = spark.read.parquet(out).collect()
    assert {(r.user_id, r.state) for r in found} == {(1, "completed"), (2, "error")}
    send((9, "z", "other", 3 * 1440, 1))
    assert send((9, "z", "other", 3 * 1440 + 60, 2)) == 0


def test_latest_task_state_over_batches_and_days(spark):
    folder, out, mark = (work_path(spark, n) for n in ("tasks", "out", "mark"))
    schema = "user_id long, conversation_id string, type string, ts timestamp, seq long"

    def send(*rows):
        spark.createDataFrame([(1, "x", k, START + timedelta(minutes=m), s) for k, m, s in rows], schema).coalesce(1).write.mode("append").parquet(folder)
        stream = monitors.agent_task_status(spark.readStream.schema(schema).parquet(folder))
        # grouped by the engine: no call into Python for each key
        assert "TransformWithState" not in stream._jdf.queryExecution().analyzed().toString()
        ev.run_updates(stream, out, mark)

    send(("thinking", 719, 1), ("completed", 721, 2), ("error", 721, 1))
    send(("executing_skill", 718, 3), ("thinking", 719, 4))
    found = ev.latest_updates(spark, out, ["user_id", "conversation_id"], by="since").collect()
    assert [(r.state, r.since) for r in found] == [("completed", START + timedelta(minutes=721))]


def test_calls_to_the_state_do_not_grow_with_the_turns():
    import pandas as pd

    class Held:
        def __init__(self):
            self.calls, self.value, self.items = 0, None, []

        def __getattr__(self, name):
            def call(*args):
                self.calls += 1
                if name == "update":
                    self.value = args[0]
                elif name == "appendList":
                    self.items += args[0]
                elif name in ("getValueState", "getListState", "getMapState"):
                    return self
                elif name == "get":
                    return iter(self.items) if self.items else self.value
            return call

    class Handle(Held):
        def __init__(self):
            super().__init__()
            self.states = []

        def __getattr__(self, name):
            if name.startswith("get"):
                return lambda *_: self.states.append(Held()) or self.states[-1]
            return super().__getattr__(name)

    handle, processor = Handle(), folds._Calls(1000, at_end=False)
    processor.init(handle)
    rows = pd.DataFrame({"type": "transcriptUpdate", "status": None, "segment_id": [f"s{i % 300}" for i in range(600)] + [None], "us": range(601)})
    out = list(processor.handleInputRows(("a",), iter([rows]), None))
    assert out[0]["segments"].tolist() == [301] and handle.calls + sum(s.calls for s in handle.states) < 10
