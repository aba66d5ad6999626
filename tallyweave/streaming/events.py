"""Call events as a stream: parsing, and running a stream to the end of what is there."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tallyweave import schemas, vocab

WATERMARK = "10 minutes"


def stream_table(spark: SparkSession, folder: str, table: str, schema: StructType) -> DataFrame:
    """A parquet table as a stream of its files."""
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(folder)


def stream_lines(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Raw event lines (column `value`) from a folder of text files."""
    reader = spark.readStream
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).text(folder)


def stream_kafka(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """The same lines from Kafka; needs its connector on the class path."""
    raw = spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, **options})
    return raw.load().select(F.col("value").cast("string").alias("value"))


def _call() -> Column:
    return F.coalesce("e.callId", "e.call_id")


def _known() -> Column:
    return F.coalesce(F.col("e.type").isin(vocab.CALL_EVENT_TYPES), F.lit(False))


def _parsed(lines: DataFrame) -> DataFrame:
    event = F.from_json("value", schemas.CALL_EVENT)
    return lines.withColumn("e", F.when(F.try_parse_json("value").isNotNull(), event))


def read_call_events(lines: DataFrame) -> DataFrame:
    """Typed events of the known types with a call id (`callId` or `call_id`, any string); the rest is left out.

    `data` is an object or a text that holds one; a segment's fields may stand in it or under `segment`.
    """
    events = _parsed(lines).where(_known() & _call().isNotNull()).select(
        "e.type", _call().alias("call_id"), F.from_json("e.data", schemas.CALL_EVENT_DATA).alias("data"),
        F.col("e.timestamp").alias("ts"))
    data = F.col("data").withField("segment_id", F.coalesce("data.segment_id", "data.segment.id"))
    for name in ("speaker", "text"):
        data = data.withField(name, F.coalesce(f"data.{name}", f"data.segment.{name}"))
    return events.withColumn("data", data.dropFields("segment"))


def rejected_call_events(lines: DataFrame) -> DataFrame:
    """What `read_call_events` leaves out, with the reason, for a side table."""
    bad, nameless = F.col("e").isNull(), _call().isNull()
    return _parsed(lines).where(bad | ~_known() | nameless).select("value", F.when(bad, "unreadable").when(
        ~_known(), "unknown_type").otherwise("no_call_id").alias("reason"))


@contextmanager
def settings(spark: SparkSession, *wanted: dict[str, str]) -> Iterator[None]:
    """Session settings for the streams started inside; the former values come back after."""
    merged = {k: v for group in wanted for k, v in group.items()}
    before = {k: spark.conf.get(k, None) for k in merged}
    for k, v in merged.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _finish(query: StreamingQuery, timeout_s: int) -> None:
    if not query.awaitTermination(timeout_s):
        query.stop()
        raise TimeoutError(f"stream still runs after {timeout_s} s")


def run_append(stream: DataFrame, out: str, checkpoint: str, timeout_s: int = 3_600) -> None:
    """Append-mode stream into a parquet folder until the present input is used up."""
    query = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    _finish(query, timeout_s)


def run_updates(stream: DataFrame, out: str, checkpoint: str, mode: str = "update", timeout_s: int = 3_600) -> None:
    """Each batch's changed rows into their own folder; a repeated batch overwrites itself."""
    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (
        stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
        .outputMode(mode).trigger(availableNow=True).start()
    )
    _finish(query, timeout_s)


def latest_updates(spark: SparkSession, out: str, keys: list[str], by: str | None = None) -> DataFrame:
    """The last state per key from the folder of `run_updates`: of the greatest `by`, if given, and then of the last batch."""
    rows = spark.read.parquet(out)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*([by] if by else []), "batch")).alias("r")).select(*keys, "r.*")
