"""Structured answers inside text and JSON columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tallyweave import schemas, vocab


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def extract_tool_call(text) -> Column:
    """struct(name, parameters JSON, error) of the first marked call, NULL where there is none."""
    found = _col(text).rlike(vocab.TOOL_CALL)
    body = F.regexp_extract(_col(text), vocab.TOOL_CALL, 1)
    good = F.try_parse_json(body).isNotNull()
    call = F.struct(
        F.when(good, F.get_json_object(body, "$.name")).alias("name"),
        F.when(good, F.get_json_object(body, "$.parameters")).alias("parameters"),
        F.when(~good, F.lit("PARSE_ERROR")).alias("error"),
    )
    return F.when(found, call)


def parse_command(text) -> Column:
    """struct(intent, confidence, entities); an intent outside the known list is `unknown`."""
    parsed = F.from_json(_col(text), schemas.COMMAND_JSON)
    return F.struct(
        F.when(parsed["intent"].isin(vocab.COMMAND_INTENTS), parsed["intent"]).otherwise("unknown").alias("intent"),
        F.coalesce(parsed["confidence"], F.lit(0.0)).alias("confidence"),
        F.coalesce(parsed["entities"], F.from_json(F.lit("{}"), "map<string,string>")).alias("entities"),
    )


def tool_references(calls, tool: str = "wikipedia") -> Column:
    """URLs in the results of a tool's successful calls, empty ones dropped."""
    good = F.filter(F.from_json(_col(calls), schemas.TOOL_CALLS),
                    lambda c: (c["toolName"] == tool) & (c["error"].isNull() | (c["error"] == "")))
    pages = F.transform(good, lambda c: F.from_json(c["result"], "array<struct<url:string>>"))
    urls = F.transform(F.flatten(F.filter(pages, lambda p: p.isNotNull())), lambda p: p["url"])
    return F.filter(urls, lambda u: u.isNotNull() & (u != ""))


def command_envelope(error) -> Column:
    """struct(status, success, code, message) from the error text of a command, NULL meaning none."""
    error = _col(error)
    status = (
        F.when(error.isNull(), "completed").when(F.contains(error, F.lit("clarification")), "requires_clarification")
        .otherwise("failed")
    )
    return F.struct(
        status.alias("status"), error.isNull().alias("success"),
        F.when(error.isNotNull(), F.lit(vocab.COMMAND_ERROR_CODE)).alias("code"), error.alias("message"),
    )


def integration_providers(text) -> Column:
    """Sorted provider names of a JSON object; tokens themselves are not read."""
    return F.array_sort(F.json_object_keys(_col(text)))


def merge_preferences(default: Column, current: Column, patch: Column) -> Column:
    """Maps merged key by key, the later winning; without a current map the default is the base."""
    base = F.coalesce(current, default)
    kept = F.map_filter(base, lambda k, v: ~F.map_contains_key(patch, k))
    return F.map_concat(kept, patch)


def remove_preference(current: Column, key: str) -> Column:
    return F.map_filter(current, lambda k, v: k != key)
