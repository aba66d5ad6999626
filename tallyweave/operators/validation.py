"""Validation as data: every violated rule of every row is collected."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallyweave import vocab

Rule = tuple[str, Column]


def violations(rules: Sequence[Rule]) -> Column:
    """Codes of the rules that fail; a NULL test counts as a failure."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in rules]))


def check(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    return df.withColumn("violations", violations(rules))


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantine with the violations)."""
    clean = F.size("violations") == 0
    return checked.where(clean).drop("violations"), checked.where(~clean)


def _text(name: str, low: int, high: int | None = None) -> list[Rule]:
    length = F.length(F.col(name))
    rules = [(f"{name}.required", F.col(name).isNotNull() & (F.col(name) != "")),
             (f"{name}.min", F.col(name).isNull() | (F.col(name) == "") | (length >= low))]
    return rules + ([(f"{name}.max", F.col(name).isNull() | (length <= high))] if high else [])


def _required(name: str) -> Rule:
    return f"{name}.required", F.col(name).isNotNull() & (F.col(name).cast("string") != "")


def _one_of(name: str, values: Sequence[str]) -> Rule:
    return f"{name}.only", F.col(name).isin(list(values))


def transaction_rules(as_of: Column) -> list[Rule]:
    date = F.col("date").try_cast("timestamp")
    return [
        ("date.required", date.isNotNull()), ("date.max", date.isNull() | (date <= as_of)),
        *_text("description", 3, 500), ("amount.base", F.col("amount").try_cast("double").isNotNull()),
        _one_of("type", vocab.TRANSACTION_TYPES), _required("account_id"), _required("category"),
    ]


def account_rules() -> list[Rule]:
    return [
        *_text("name", 3, 100), _one_of("type", vocab.ACCOUNT_TYPES),
        ("description.max", F.col("description").isNull() | (F.length("description") <= 500)),
        ("currency.pattern", F.col("currency").rlike(vocab.CURRENCY_CODE)),
    ]


def range_rules() -> list[Rule]:
    """For a table of query specs, after `range_defaults`."""
    ends, tops = F.col("end_date"), F.col("max_amount")
    return [
        ("end_date.min", ends.isNull() | F.col("start_date").isNull() | (ends >= F.col("start_date"))),
        ("max_amount.min", tops.isNull() | F.col("min_amount").isNull() | (tops >= F.col("min_amount"))),
        ("limit.range", F.col("limit").between(1, 100)), ("offset.min", F.col("offset") >= 0),
    ]


def range_defaults(df: DataFrame) -> DataFrame:
    return df.withColumn("limit", F.coalesce("limit", F.lit(50))).withColumn("offset", F.coalesce("offset", F.lit(0)))


def command_rules() -> list[Rule]:
    return [*_text("text", 3, 1000), _required("user_id")]


def rating_rules() -> list[Rule]:
    return [("rating.required", F.col("rating").isNotNull() & (F.col("rating") != 0)),
            ("rating.range", F.col("rating").isNull() | F.col("rating").between(1, 5))]


# The stricter profile, which disagrees with the rules above on types and formats.
def strict_transaction_rules() -> list[Rule]:
    return [
        _one_of("type", vocab.STRICT_TRANSACTION_TYPES), ("amount.positive", F.col("amount").try_cast("double") > 0),
        ("description.min", F.length("description") >= 1), ("category.min", F.length("category") >= 1),
        ("date.datetime", F.col("date").cast("string").rlike(vocab.ISO_DATETIME)),
        ("account_id.uuid", F.col("account_id").cast("string").rlike(vocab.UUID)),
    ]


def strict_account_rules() -> list[Rule]:
    return [("name.min", F.length("name") >= 1), _one_of("type", vocab.STRICT_ACCOUNT_TYPES),
            ("currency.length", F.length("currency") == 3)]


def strict_range_rules() -> list[Rule]:
    return [("start_date.datetime", F.col("start_date").cast("string").rlike(vocab.ISO_DATETIME)),
            ("end_date.datetime", F.col("end_date").cast("string").rlike(vocab.ISO_DATETIME))]


# JSON kinds as they appear in the schema text of a variant.
_KINDS = {
    "string": r"^STRING\z", "number": r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)\z",
    "boolean": r"^BOOLEAN\z", "object": r"^OBJECT<.*\z", "array": r"^ARRAY<.*\z",
}


def param_rules(params: str, spec: Mapping[str, tuple[str, bool]]) -> list[Rule]:
    """Rules over a JSON parameter column: {name: (kind, required)}."""
    parsed = F.try_parse_json(F.col(params))
    rules: list[Rule] = []
    for name, (kind, required) in spec.items():
        here = F.schema_of_variant(F.try_variant_get(parsed, f"$.{name}", "variant"))
        if required:
            rules.append((f"{name}.missing", here.isNotNull()))
        rules.append((f"{name}.type", here.isNull() | here.rlike(_KINDS[kind])))
    return rules
