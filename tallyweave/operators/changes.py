"""Updates and deletes as joins over immutable tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallyweave.functions.text import content_hash


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key, combined map-side: a hot key sends one row per task."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return picked.select(*keys, "__row.*")


def upsert(target: DataFrame, updates: DataFrame, key: str, as_of: Column, stamp: str = "updated_at",
           order: Sequence[str] | None = None) -> DataFrame:
    """Insert or update by key. Columns that an update leaves NULL keep their value. With `order`, several
    updates of one key are reduced to the last."""
    if order:
        updates = latest(updates, [key], order)
    given = [c for c in updates.columns if c != key and c in target.columns]
    new = updates.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__new_{c}") for c in given])
    joined = target.join(new, target[key] == new["__key"], "full_outer")
    touched = F.col("__key").isNotNull()
    columns = []
    for c in target.columns:
        if c == key:
            columns.append(F.coalesce(F.col(key), F.col("__key")).alias(key))
        elif c == stamp:
            columns.append(F.when(touched, as_of).otherwise(F.col(c)).alias(c))
        elif c in given:
            columns.append(F.coalesce(F.col(f"__new_{c}"), F.col(c)).alias(c))
        else:
            columns.append(F.col(c))
    return joined.select(*columns)


def cascade_delete(users: DataFrame, conversations: DataFrame, messages: DataFrame, permissions: DataFrame,
                   gone: DataFrame) -> Mapping[str, DataFrame]:
    """All four tables without the users in `gone` (user_id) and what belongs to them."""
    doomed = conversations.join(gone, "user_id", "left_semi").select(F.col("id").alias("conversation_id"))
    return {
        "users": users.join(gone, users["id"] == gone["user_id"], "left_anti"),
        "conversations": conversations.join(gone, "user_id", "left_anti"),
        "messages": messages.join(doomed, "conversation_id", "left_anti"),
        "permissions": permissions.join(gone, "user_id", "left_anti"),
    }


def uncached_texts(texts: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    """One row (hash, text) per distinct text whose hash is not in the cache."""
    hashed = texts.where(F.col(text).isNotNull()).select(content_hash(text).alias("hash"), F.col(text).alias("text"))
    once = hashed.groupBy("hash").agg(F.any_value("text").alias("text"))
    return once.join(cache.select("hash"), "hash", "left_anti")


def check_owner(requests: DataFrame, conversations: DataFrame) -> DataFrame:
    """Each request (conversation_id, requester) as found, not_found or forbidden."""
    owners = conversations.select(F.col("id").alias("conversation_id"), F.col("user_id").alias("__owner"))
    outcome = (
        F.when(F.col("__owner").isNull(), "not_found").when(F.col("__owner") != F.col("requester"), "forbidden")
        .otherwise("found")
    )
    return requests.join(owners, "conversation_id", "left").withColumn("outcome", outcome).drop("__owner")


def apply_status_updates(calls: DataFrame, updates: DataFrame) -> DataFrame:
    """The last update (call_id, status, outcome, recording_url, ts, seq) of each call. Only `completed`
    sets the end time and, if given, the outcome; a recording url is set whenever one came."""
    last = updates.groupBy(F.col("call_id").alias("id")).agg(
        F.max_by(F.struct("status", "outcome", "ts"), F.struct("ts", "seq")).alias("__u"),
        F.max_by("recording_url", F.when(F.col("recording_url").isNotNull(), F.struct("ts", "seq"))).alias("__url"))
    done = F.col("__u.status") == "completed"
    return (
        calls.join(last, "id", "left")
        .withColumn("end_time", F.when(done, F.col("__u.ts")).otherwise(F.col("end_time")))
        .withColumn("outcome", F.when(done, F.coalesce("__u.outcome", "outcome")).otherwise(F.col("outcome")))
        .withColumn("status", F.coalesce("__u.status", "status"))
        .withColumn("recording_url", F.coalesce("__url", "recording_url")).drop("__u", "__url")
    )
