"""From a labelled text to its ordered specialist answers with coverage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallyweave import vocab
from tallyweave.functions.text import let, priority, priority_order
from tallyweave.operators.matching import coverage, route_topk


def roles_for(complexity: Column, roles: Sequence[str]) -> Column:
    """How many roles a complexity level consults; the highest level consults all."""
    count = F.lit(len(roles))
    for level, n in vocab.COMPLEXITY_ROLES.items():
        count = F.when(complexity == level, n).otherwise(count)
    return count


def triage(df: DataFrame, text: str, complexity: str, answer: str,
           lookup: Sequence[Mapping] = tuple(vocab.COVERAGE_LOOKUP), roles: Sequence[str] = tuple(vocab.ROLES),
           keywords: Mapping = vocab.ROUTING_KEYWORDS) -> DataFrame:
    """One row per consulted role in answer order: roles by routing score (all roles in their fixed order at
    the highest level), coverage of the answer text, answers by priority."""
    level = F.coalesce(F.col(complexity), F.lit("low"))
    in_role_order = lambda ranked: F.array_sort(ranked, lambda a, b: a["pos"] - b["pos"])
    chosen = let(route_topk(text, len(roles), roles, keywords), lambda ranked: F.when(
        level.isin(list(vocab.COMPLEXITY_ROLES)), F.slice(ranked, F.lit(1), roles_for(level, roles))
    ).otherwise(in_role_order(ranked)))
    # Priority and coverage belong to the answer: once per row, before it is multiplied by the roles.
    judged = df.select("*", priority(answer).alias("priority"), coverage(answer, lookup).alias("coverage"),
                       chosen.alias("__roles"))
    rows = judged.select("*", F.posexplode("__roles").alias("consulted", "r")).drop("__roles")
    return rows.select(
        *df.columns, "consulted", F.col("r.role").alias("role"), F.col("r.score").alias("score"), "priority", "coverage",
        priority_order("priority").alias("priority_order"))


def order_by_priority(df: DataFrame, tie: str = "consulted") -> DataFrame:
    return df.orderBy(F.col("priority_order").desc(), F.col(tie))
