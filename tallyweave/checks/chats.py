"""Users, conversations and messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.checks.registry import check, lines, plain_ts, r6
from tallyweave.functions import jsons as js
from tallyweave.operators import changes, chats as ch, filtering as fl
from tallyweave.operators.retrieval import result_position
from tallyweave.session import work_path
from tallyweave.sources import tables as tb


@check("joi02_conversations_with_messages", """
    SELECT c.id, c.user_id, coalesce(string_agg(m.role || ':' || m.id, '|' ORDER BY m.created_at, m.id), '') AS messages
    FROM fx_chats c LEFT JOIN fx_messages m ON m.conversation_id = c.id GROUP BY c.id, c.user_id""")
def _(t):
    nested = ch.conversations_with_messages(t.chats, t.messages)
    shown = lines(F.transform("messages", lambda m: F.concat_ws(":", m["role"], m["id"].cast("string"))))
    return nested.select("id", "user_id", shown.alias("messages"))


@check("joi03_latest_message_per_conversation", """
    SELECT c.id, m.role, m.created_at FROM fx_chats c LEFT JOIN (
        SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at DESC, id DESC) AS k FROM fx_messages) m
    ON m.conversation_id = c.id AND m.k = 1""")
def _(t):
    found = ch.latest_message_per_conversation(t.chats.select("id"), t.messages)
    return found.select("id", "last_message.role", plain_ts("last_message.created_at").alias("created_at"))


@check("joi04_users_with_permissions", """
    SELECT u.id, u.name, coalesce(string_agg(p.permission, '|' ORDER BY p.permission), '') AS permissions
    FROM fx_users u LEFT JOIN fx_permissions p ON p.user_id = u.id GROUP BY u.id, u.name""")
def _(t):
    return ch.users_with_permissions(t.users, t.permissions).select("id", "name", lines("permissions").alias("permissions"))


@check("joi05_require_permission", """
    SELECT id, name, id IN (SELECT user_id FROM fx_permissions WHERE permission = '1-URGENT') AS held FROM fx_users""")
def _(t):
    held = ch.require_permission(t.users, t.permissions, "1-URGENT").select("id", "name", F.lit(True).alias("held"))
    return held.unionByName(ch.require_permission(t.users, t.permissions, "1-URGENT", held=False).select("id", "name", F.lit(False).alias("held")))


@check("joi16_cascade_delete", """
    SELECT 'users' AS kept, count(*) AS n FROM fx_users WHERE id % 3 <> 0
    UNION ALL SELECT 'conversations', count(*) FROM fx_chats WHERE user_id % 3 <> 0
    UNION ALL SELECT 'messages', count(*) FROM fx_messages m JOIN fx_chats c ON c.id = m.conversation_id WHERE c.user_id % 3 <> 0
    UNION ALL SELECT 'permissions', count(*) FROM fx_permissions WHERE user_id % 3 <> 0""")
def _(t):
    gone = t.users.where("id % 3 = 0").select(F.col("id").alias("user_id"))
    kept = changes.cascade_delete(t.users, t.chats, t.messages, t.permissions, gone)
    counts = [df.agg(F.lit(name).alias("kept"), F.count(F.lit(1)).alias("n")) for name, df in kept.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


@check("joi18_check_owner", """
    SELECT m.id, CASE WHEN c.id IS NULL THEN 'not_found' WHEN c.user_id <> m.requester THEN 'forbidden' ELSE 'found' END AS outcome
    FROM (SELECT e.event_id AS id, e.event_id % 150 AS conversation_id, e.user_id AS requester FROM events e) m
    LEFT JOIN fx_chats c ON c.id = m.conversation_id""")
def _(t):
    requests = t.table("events").select(F.col("event_id").alias("id"), (F.col("event_id") % 150).alias("conversation_id"),
                                        F.col("user_id").alias("requester"))
    return changes.check_owner(requests, t.chats).select("id", "outcome")


@check("fil06_filter_conversations", """
    SELECT id FROM fx_chats c WHERE updated_at >= TIMESTAMP '2024-01-01 02:00:00' AND updated_at <= TIMESTAMP '2024-02-01'
    AND EXISTS (SELECT 1 FROM fx_messages m WHERE m.conversation_id = c.id AND contains(lower(m.content), 'ation'))""")
def _(t):
    return fl.filter_conversations(t.chats, t.messages, search="Ation", start_date="2024-01-01 02:00:00", end_date="2024-02-01").select("id")


@check("agg18_count_for_page", """
    SELECT id, owner, count(*) OVER (PARTITION BY owner) AS total FROM (SELECT id, user_id % 5 AS owner FROM fx_chats) c""")
def _(t):
    return fl.count_per(t.chats.select("id", (F.col("user_id") % 5).alias("owner")), ["owner"])


@check("agg21_token_usage", """
    SELECT model, CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(sum(c) AS BIGINT) AS completion_tokens, CAST(sum(p + c) AS BIGINT) AS total_tokens FROM (
        SELECT CASE WHEN conv_id % 2 = 0 THEN 'small' ELSE 'large' END AS model, CASE WHEN role = 'user' THEN length(text) ELSE 0 END AS p,
               CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END AS c FROM conversations) t GROUP BY model""")
def _(t):
    from tallyweave.operators.ledger import token_usage
    n = F.length("text")
    rows = t.table("conversations").select(
        F.when(F.col("conv_id") % 2 == 0, "small").otherwise("large").alias("model"),
        F.when(F.col("role") == "user", n).otherwise(0).alias("prompt_tokens"),
        F.when(F.col("role") == "assistant", n).otherwise(0).alias("completion_tokens"))
    return token_usage(rows)


@check("top02_page", """
    SELECT id, updated_at, (SELECT count(*) FROM fx_chats) AS total FROM fx_chats ORDER BY updated_at DESC, id LIMIT 10 OFFSET 10""")
def _(t):
    found = fl.page(t.chats.select("id", "updated_at"), [F.col("updated_at").desc(), F.col("id")], page=2)
    return found.withColumn("updated_at", plain_ts("updated_at"))


@check("top09_take_first_n", """
    SELECT conversation_id, id FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at, id) AS k FROM fx_messages) m WHERE k <= 3""")
def _(t):
    return fl.top_per(t.messages, ["conversation_id"], [F.col("created_at"), F.col("id")], 3).select("conversation_id", "id")


@check("win20_result_position", """
    SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY execution_ms DESC, id) AS position FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY execution_ms DESC, id) AS k FROM fx_commands) c WHERE k <= 10""")
def _(t):
    order = [F.col("execution_ms").desc(), F.col("id")]
    hits = fl.top_per(t.commands, ["user_id"], order, 10)
    return result_position(hits, "user_id", order).select("user_id", "id", "position")


@check("prj05_merge_preferences", """
    SELECT id, CASE WHEN id % 2 = 0 THEN 'de' WHEN id % 3 = 0 THEN 'fr' ELSE 'en' END AS language,
           CASE WHEN id % 3 = 0 THEN NULL ELSE 'UTC' END AS timezone, CAST(nation AS VARCHAR) AS nation, '' AS removed FROM fx_users""")
def _(t):
    from tallyweave import vocab
    i = F.col("id")
    default = F.create_map(*[F.lit(v) for pair in vocab.DEFAULT_PREFERENCES.items() for v in pair])
    current = F.when(i % 3 == 0, F.create_map(F.lit("language"), F.lit("fr"), F.lit("theme"), F.lit("dark")))
    nation = F.create_map(F.lit("nation"), F.col("nation").cast("string"))
    patch = F.when(i % 2 == 0, F.map_concat(nation, F.create_map(F.lit("language"), F.lit("de")))).otherwise(nation)
    merged = t.users.select("id", js.remove_preference(js.merge_preferences(default, current, patch), "theme").alias("p"))
    return merged.select("id", F.col("p")["language"].alias("language"), F.col("p")["timezone"].alias("timezone"),
                         F.col("p")["nation"].alias("nation"), F.coalesce(F.col("p")["theme"], F.lit("")).alias("removed"))


@check("jsn05_integration_providers", """
    SELECT id, CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN 'google' ELSE 'google|slack' END AS providers FROM fx_users""")
def _(t):
    i = F.col("id")
    stored = F.when(i % 3 == 0, "{}").when(i % 3 == 1, '{"google":{"scope":[]}}').otherwise('{"slack":{},"google":{"scope":["a"]}}')
    return t.users.select("id", lines(js.integration_providers(stored)).alias("providers"))


@check("src12_scan_chat_tables", """
    SELECT CAST(u.id AS VARCHAR) AS id, u.name, coalesce(p.n, 0) AS permissions, coalesce(c.n, 0) AS conversations,
           coalesce(m.n, 0) AS messages, coalesce(m.size, 0) AS size FROM fx_users u
    LEFT JOIN (SELECT user_id, count(*) AS n FROM fx_permissions GROUP BY user_id) p ON p.user_id = u.id
    LEFT JOIN (SELECT user_id, count(*) AS n FROM fx_calls GROUP BY user_id) c ON c.user_id = u.id
    LEFT JOIN (SELECT k.user_id, count(*) AS n, CAST(sum(coalesce(length(g.content), 0)) AS BIGINT) AS size FROM fx_messages g
               JOIN fx_calls k ON k.id = g.conversation_id GROUP BY k.user_id) m ON m.user_id = u.id""")
def _(t):
    root, now = work_path(t.spark, "store"), F.lit("2024-03-01").cast("timestamp")
    for table, rows in {"users": t.users.select("id", "name"), "permissions": t.permissions, "messages": t.messages,
                        "conversations": t.calls.select("id", "user_id")}.items():
        tb.append_rows(rows, root, table, now)
    users, permissions, messages, conversations = (
        tb.scan_table(t.spark, root, table) for table in ("users", "permissions", "messages", "conversations"))
    said = messages.groupBy(F.col("conversation_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.length("content"), F.lit(0))).alias("size"))
    per_user = conversations.select("id", "user_id").join(said, "id", "left").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("conversations"), F.sum("n").alias("messages"), F.sum("size").alias("size"))
    granted = permissions.groupBy("user_id").agg(F.count(F.lit(1)).alias("permissions"))
    known = users.select(F.col("id").alias("user_id"), "name").join(granted, "user_id", "left").join(per_user, "user_id", "left")
    return known.select(F.col("user_id").alias("id"), "name", *[
        F.coalesce(c, F.lit(0)).alias(c) for c in ("permissions", "conversations", "messages", "size")])
