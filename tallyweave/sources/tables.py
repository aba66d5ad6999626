"""Operational tables: parquet folders or a partitioned JDBC read, and appends with defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The stored tables and their columns.
CALL_TABLES = {
    "calls": "id string, type string, status string, phone_number string, start_time timestamp, end_time timestamp, "
             "outcome string, recording_url string, created_at timestamp, updated_at timestamp",
    "segments": "id string, call_id string, timestamp timestamp, speaker string, text string, "
                "created_at timestamp, updated_at timestamp",
    "feedback": "id string, call_id string, reviewer_id string, rating int, comments string, "
                "created_at timestamp, updated_at timestamp",
    "training_examples": "id string, call_id string, context string, input string, output string, rating int, "
                         "feedback string, created_at timestamp, updated_at timestamp",
}
CHAT_TABLES = {
    "users": "id string, email string, name string, preferences string, integrations string, token_version int, "
             "created_at timestamp, updated_at timestamp",
    "conversations": "id string, user_id string, context string, created_at timestamp, updated_at timestamp",
    "messages": "id string, conversation_id string, role string, content string, metadata string, "
                "created_at timestamp, updated_at timestamp",
    "permissions": "id string, user_id string, permission string, created_at timestamp, updated_at timestamp",
}


def scan_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A stored table with its declared columns; filters and column choices reach the files."""
    return spark.read.schema({**CALL_TABLES, **CHAT_TABLES}[table]).parquet(f"{root}/{table}")


def scan_jdbc(spark: SparkSession, url: str, table: str, partition_column: str, lower: str, upper: str,
              partitions: int, **options: str) -> DataFrame:
    """The same table from a database, read by ranges of a numeric or time column in parallel."""
    return spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=partition_column, lowerBound=lower, upperBound=upper,
        numPartitions=str(partitions), **options).load()


def with_defaults(rows: DataFrame, table: str, as_of: Column | None = None) -> DataFrame:
    """Fill what the store fills: id, timestamps, a call's start and status 'ringing'."""
    now = F.current_timestamp() if as_of is None else as_of.cast("timestamp")
    filled = {"id": F.expr("uuid()"), "created_at": now, "updated_at": now}
    if table == "calls":
        filled |= {"start_time": now, "status": F.lit("ringing")}
    if table == "segments":
        filled["timestamp"] = now
    if table == "users":
        filled["token_version"] = F.lit(0)
    declared = {**CALL_TABLES, **CHAT_TABLES}[table]
    columns = []
    for spec in declared.split(", "):
        name, kind = spec.strip().split(" ")
        value = F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind)
        columns.append((F.coalesce(value, filled[name]) if name in filled else value).cast(kind).alias(name))
    return rows.select(*columns)


def append_rows(rows: DataFrame, root: str, table: str, as_of: Column | None = None) -> None:
    with_defaults(rows, table, as_of).write.mode("append").parquet(f"{root}/{table}")


def message_pairs(turns: DataFrame) -> DataFrame:
    """Each exchange (conversation_id, user_text, agent_text) as its two message rows."""
    both = F.array(
        F.struct(F.lit("user").alias("role"), F.col("user_text").alias("content")),
        F.struct(F.lit("assistant").alias("role"), F.col("agent_text").alias("content")),
    )
    return turns.select("conversation_id", F.explode(both).alias("m")).select("conversation_id", "m.role", "m.content")
