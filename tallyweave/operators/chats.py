"""Users, conversations, messages and permissions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyweave.operators.nesting import CHILDREN_PER_PAGE, nest


def conversations_with_messages(conversations: DataFrame, messages: DataFrame,
                                per_page: int = CHILDREN_PER_PAGE) -> DataFrame:
    return nest(conversations, messages, "id", "conversation_id", ["created_at", "id"],
                ["id", "role", "content", "created_at"], "messages", per_page)


def latest_message_per_conversation(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Each conversation with its newest message, NULL without one; combined before the shuffle."""
    last = messages.groupBy(F.col("conversation_id").alias("id")).agg(
        F.max_by(F.struct("role", "content", "created_at"), F.struct("created_at", "id")).alias("last_message"))
    return conversations.join(last, "id", "left")


def users_with_permissions(users: DataFrame, permissions: DataFrame) -> DataFrame:
    """Permissions are unique per user, so the set is bounded by the kinds of permission."""
    held = permissions.groupBy(F.col("user_id").alias("id")).agg(
        F.sort_array(F.collect_set("permission")).alias("permissions"))
    return users.join(held, "id", "left").withColumn(
        "permissions", F.coalesce("permissions", F.array().cast("array<string>")))


def require_permission(users: DataFrame, permissions: DataFrame, permission: str, held: bool = True) -> DataFrame:
    """Users that hold the permission, or those that do not."""
    holders = permissions.where(F.col("permission") == permission).select(F.col("user_id").alias("id"))
    return users.join(holders, "id", "left_semi" if held else "left_anti")
