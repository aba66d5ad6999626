"""Operator inputs derived from the given tables: one DataFrame and one SQL text each."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tallyweave.scale import spread
from tallyweave.session import use_utc

# Account type by market segment.
SEGMENT_TYPES = {"AUTOMOBILE": "asset", "BUILDING": "liability", "FURNITURE": "equity", "HOUSEHOLD": "revenue",
                 "MACHINERY": "expense"}

_TYPE_CASE = "CASE c_mktsegment " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SEGMENT_TYPES.items()) + " END"

# Both engines read these texts; `{...}` marks where their dialects differ.
_INPUTS = {
    "fx_quotes": """
        SELECT event_type AS symbol, {ts} AS ts, event_id AS seq, value - 0.01 AS bid_price, value + 0.01 AS ask_price
        FROM events""",
    "fx_trades": """
        SELECT l_returnflag AS symbol, {shipdate} AS ts, CASE WHEN l_linestatus = 'O' THEN 'buy' ELSE 'sell' END AS side,
               floor(l_extendedprice) AS price, l_quantity AS qty
        FROM lineitem""",
    "fx_bars": """
        SELECT symbol, ts, open, high, low, close, CASE WHEN n > 1 THEN close END AS x FROM (
            SELECT o_orderpriority AS symbol, {orderdate} AS ts, {first_price} AS open, max(o_totalprice) AS high,
                   min(o_totalprice) AS low, {last_price} AS close, count(*) AS n
            FROM orders GROUP BY o_orderpriority, o_orderdate) d""",
    "fx_accounts": f"""
        SELECT c_custkey AS id, c_name AS name, {_TYPE_CASE} AS type, 'USD' AS currency,
               c_nationkey AS parent_account_id, CAST(c_acctbal AS DECIMAL(18,2)) AS balance
        FROM customer""",
    "fx_transactions": """
        SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS date, concat('order ', o_orderkey) AS description,
               CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
               CASE WHEN o_orderstatus = 'F' THEN 'debit' ELSE 'credit' END AS type, o_custkey AS account_id,
               o_orderpriority AS category, CASE WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'completed' END AS status
        FROM orders""",
    "fx_calls": """
        SELECT c.conv_id AS id, CASE WHEN c.conv_id % 2 = 0 THEN 'sales' ELSE 'support' END AS type,
               CASE WHEN c.conv_id % 5 = 0 THEN 'in-progress' ELSE 'completed' END AS status,
               concat('+1', lpad(CAST(c.conv_id AS {text}), 10, '0')) AS phone_number, {e_ts} AS start_time,
               CASE WHEN c.conv_id % 5 = 0 THEN NULL ELSE {e_ts} + c.turns * INTERVAL '30' SECOND END AS end_time,
               CASE WHEN c.conv_id % 5 = 0 THEN NULL
                    WHEN c.conv_id % 2 = 0 THEN CASE c.conv_id % 3 WHEN 0 THEN 'SaleConfirmed' WHEN 1 THEN 'LeadPending'
                                                ELSE 'NoSale' END
                    ELSE CASE c.conv_id % 3 WHEN 0 THEN 'Resolved' WHEN 1 THEN 'NeedsFollowUp' ELSE 'Unresolved' END
               END AS outcome, CAST(NULL AS {text}) AS recording_url, e.user_id AS user_id, c.turns AS turns
        FROM (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY conv_id) c
        JOIN events e ON e.event_id = c.conv_id""",
    "fx_segments": """
        SELECT t.conv_id * 100000 + t.turn AS id, t.conv_id AS call_id, t.turn AS turn, 30 * t.turn AS offset_s,
               k.start_time + t.turn * INTERVAL '30' SECOND AS timestamp, t.role AS speaker, t.text AS text
        FROM conversations t JOIN fx_calls k ON k.id = t.conv_id""",
    "fx_feedback": """
        SELECT doc_id AS id, doc_id % 100 AS call_id, doc_id % 50 AS reviewer_id, 1 + quality * 2 + toxic AS rating,
               CASE WHEN toxic = 1 THEN 'tone' WHEN quality = 1 THEN 'praise' ELSE 'detail' END AS category,
               {feedback_at} AS created_at
        FROM labels""",
    "fx_chats": """
        SELECT id, user_id, start_time AS created_at, start_time + turns * INTERVAL '30' SECOND AS updated_at
        FROM fx_calls""",
    "fx_messages": """
        SELECT id, call_id AS conversation_id, speaker AS role, text AS content, timestamp AS created_at
        FROM fx_segments""",
    "fx_users": "SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation FROM customer",
    "fx_permissions": """
        SELECT DISTINCT o_custkey AS user_id, o_orderpriority AS permission FROM orders WHERE o_orderstatus = 'F'""",
    "fx_log": """
        SELECT event_id AS id, user_id AS client, {ts} AS ts, CASE WHEN k % 2 = 0 THEN 'GET' ELSE 'POST' END AS method,
               event_type AS path, CASE WHEN k >= 90 THEN 500 WHEN k >= 80 THEN 404 ELSE 200 END AS status,
               value AS duration_ms
        FROM (SELECT *, {k} AS k FROM events) e""",
    "fx_commands": """
        SELECT event_id AS id, user_id, {ts} AS timestamp,
               CASE event_id % 6 WHEN 0 THEN 'create_transaction' WHEN 1 THEN 'get_transactions'
                    WHEN 2 THEN 'generate_report' WHEN 3 THEN 'get_account_balance' WHEN 4 THEN 'categorize_transaction'
                    ELSE 'unknown' END AS intent,
               CASE WHEN k >= 90 THEN 'failed' WHEN k >= 80 THEN 'requires_clarification' ELSE 'completed' END AS status,
               CAST(floor(value * 10) AS BIGINT) AS execution_ms
        FROM (SELECT *, {k} AS k FROM events) e""",
    "fx_edges": """
        SELECT concat('S', l_suppkey) AS src, concat('P', l_partkey) AS dst, l_quantity AS weight FROM lineitem
        UNION ALL
        SELECT concat('P', l_partkey) AS src, concat('S', l_suppkey) AS dst, l_quantity AS weight FROM lineitem""",
    "fx_features": """
        SELECT symbol AS ticker, ts AS timestamp, (high - low) / close AS alpha FROM fx_bars""",
}

_SPARK = {
    "ts": "CAST(ts AS TIMESTAMP)", "e_ts": "CAST(e.ts AS TIMESTAMP)", "shipdate": "CAST(l_shipdate AS TIMESTAMP)",
    "orderdate": "CAST(o_orderdate AS TIMESTAMP)", "text": "STRING",
    "first_price": "min_by(o_totalprice, o_orderkey)", "last_price": "max_by(o_totalprice, o_orderkey)",
    "k": "CAST(get_json_object(props, '$.k') AS INT)",
    "feedback_at": "timestamp_seconds(1704067200 + doc_id * 3600)",
}
_DUCK = {
    "ts": "ts", "e_ts": "e.ts", "shipdate": "l_shipdate", "orderdate": "o_orderdate", "text": "VARCHAR",
    "first_price": "arg_min(o_totalprice, o_orderkey)", "last_price": "arg_max(o_totalprice, o_orderkey)",
    "k": "CAST(json_extract_string(props, '$.k') AS INTEGER)",
    "feedback_at": "TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL '1' HOUR",
}


def with_inputs(sql: str) -> str:
    """The SQL with the derived inputs it uses as leading common table expressions."""
    ordered: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\bfx_[a-z]+\b", text):
            if name not in ordered:
                need(_INPUTS[name])
                if name not in ordered:
                    ordered.append(name)

    need(sql)
    parts = [f"{name} AS ({_INPUTS[name].format(**_DUCK)})" for name in ordered]
    body = sql.strip()
    recursive = body[:14].upper() == "WITH RECURSIVE"
    if body[:4].upper() == "WITH":
        body = body[14 if recursive else 4:].strip()
        return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join([*parts, body])
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


# Tables of whole texts: work per row is heavy, so one file is spread over the cores.
_TEXTS = ("documents", "pages")


class Inputs:
    """Raw tables by name, derived inputs as attributes without their prefix."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = use_utc(spark), folder
        self._made: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._made:
            found = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            self._made[name] = spread(found) if name in _TEXTS else found
        return self._made[name]

    def derived(self, name: str) -> DataFrame:
        if name not in self._made:
            text = _INPUTS[name].format(**_SPARK)
            used = set(re.findall(r"\b(?:FROM|JOIN)\s+([a-z_]+)", text))
            frames = {u: self.derived(u) if u.startswith("fx_") else self.table(u) for u in used}
            body = re.sub(r"\b(FROM|JOIN)\s+([a-z_]+)", lambda m: f"{m[1]} {{{m[2]}}}", text)
            self._made[name] = self.spark.sql(body, **frames)
        return self._made[name]

    def __getattr__(self, name: str) -> DataFrame:
        key = f"fx_{name}"
        if key in _INPUTS:
            return self.derived(key)
        raise AttributeError(name)
