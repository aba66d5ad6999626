"""Filters, projections, sorts and pages over any table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import StructType

from tallyweave import vocab
from tallyweave.scale import ROWS_PER_TASK
from tallyweave.session import cut_lineage

#: Rows up to the end of a page that one task may hold; a deeper page is found by ranges of about that size.
RANGE_ROWS = 100_000
#: Ranges that rows are dealt into at a time, unless a task would then hold more than `ROWS_PER_TASK` rows.
RANGES = 256


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(and_, conditions, F.lit(True))


def filter_transactions(df: DataFrame, start_date=None, end_date=None, account_id=None, category=None,
                        min_amount=None, max_amount=None, type=None, status=None, search=None) -> DataFrame:
    """Optional inclusive bounds and equalities, all of which must hold. Only None means unset."""
    tests = [
        (start_date, lambda v: F.col("date") >= F.lit(v).cast("date")),
        (end_date, lambda v: F.col("date") <= F.lit(v).cast("date")),
        (account_id, lambda v: F.col("account_id") == v),
        (category, lambda v: F.col("category") == v),
        (min_amount, lambda v: F.col("amount") >= v),
        (max_amount, lambda v: F.col("amount") <= v),
        (type, lambda v: F.col("type") == v),
        (status, lambda v: F.col("status") == v),
        (search, lambda v: F.contains(F.lower("description"), F.lit(v.lower()))),
    ]
    return df.where(all_of([make(v) for v, make in tests if v is not None]))


# Operators of the generic filter.
FILTER_OPERATORS = {
    "eq": lambda c, v: c == v, "ne": lambda c, v: c != v, "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v, "in": lambda c, v: c.isin(list(v)),
    "nin": lambda c, v: ~c.isin(list(v)), "contains": lambda c, v: c.contains(v),
    "startsWith": lambda c, v: c.startswith(v), "endsWith": lambda c, v: c.endswith(v),
}


def apply_filters(df: DataFrame, filters: Mapping[str, object]) -> DataFrame:
    """{field: {operator: value}} or {field: value}; every test must hold."""
    tests = []
    for field, wanted in filters.items():
        for op, value in (wanted.items() if isinstance(wanted, Mapping) else [("eq", wanted)]):
            tests.append(FILTER_OPERATORS[op](F.col(field), value))
    return df.where(all_of(tests))


def filter_calls(df: DataFrame, type=None, status=None, outcome=None, start_date=None, end_date=None,
                 phone_number=None) -> DataFrame:
    tests = [F.col(name) == value for name, value in
             [("type", type), ("status", status), ("outcome", outcome), ("phone_number", phone_number)]
             if value is not None]
    kind = dict(df.dtypes)["start_time"]
    if start_date is not None:
        tests.append(F.col("start_time") >= F.lit(start_date).cast(kind))
    if end_date is not None:
        tests.append(F.col("start_time") <= F.lit(end_date).cast(kind))
    return df.where(all_of(tests))


def filter_conversations(conversations: DataFrame, messages: DataFrame, owner=None, search=None, start_date=None,
                         end_date=None) -> DataFrame:
    """By owner and update time; `search` keeps conversations with a message that contains it."""
    kind = dict(conversations.dtypes)["updated_at"]
    tests = []
    if owner is not None:
        tests.append(F.col("user_id") == owner)
    if start_date is not None:
        tests.append(F.col("updated_at") >= F.lit(start_date).cast(kind))
    if end_date is not None:
        tests.append(F.col("updated_at") <= F.lit(end_date).cast(kind))
    kept = conversations.where(all_of(tests))
    if search is None:
        return kept
    hits = messages.where(F.contains(F.lower("content"), F.lit(search.lower()))).select("conversation_id").distinct()
    return kept.join(hits, kept.id == hits.conversation_id, "left_semi")


def compact(df: DataFrame, *columns: str) -> DataFrame:
    """Rows whose named strings are present and not empty."""
    return df.where(all_of([F.col(c).isNotNull() & (F.col(c) != "") for c in columns]))


def pick(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The named columns, in the order named; absent ones are ignored."""
    return df.select([c for c in columns if c in df.columns])


def omit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def strip_unknown(df: DataFrame, schema: StructType) -> DataFrame:
    return df.select([c for c in schema.fieldNames() if c in df.columns])


def transaction_defaults(df: DataFrame, as_of: Column) -> DataFrame:
    """Fill a raw transaction (all strings): amount as a number, and the defaults of the rest."""
    def text(name: str, default: Column) -> Column:
        return F.coalesce(F.nullif(F.col(name), F.lit("")), default).alias(name)

    return df.select(
        "id", "type", F.col("amount").try_cast("double").alias("amount"), text("description", F.lit("")),
        text("category", F.lit(vocab.DEFAULT_CATEGORY)), text("date", F.date_format(as_of, "yyyy-MM-dd")),
        "account_id", F.lit(vocab.DEFAULT_STATUS).alias("status"),
        F.from_json("metadata", "map<string,string>").alias("metadata"),
        as_of.alias("created_at"), as_of.alias("updated_at"),
    )


def sort_by(df: DataFrame, field: str, order: str = "asc", tie: str | None = None) -> DataFrame:
    first = F.col(field).desc() if order == "desc" else F.col(field).asc()
    return df.orderBy(first, *([F.col(tie)] if tie else []))


def _slice(df: DataFrame, order: Sequence[Column], skip: int, limit: int, range_rows: int) -> DataFrame:
    """Rows skip + 1 to skip + limit of the sorted rows. Sorting with a limit keeps all rows up to the last one wanted in one
    task, so beyond `range_rows` of them the rows are dealt into ranges of the order, only the ranges are counted, and those
    that hold the wanted rows are dealt again until they are about `range_rows`, then sorted. The number of ranges is bounded, so
    what reaches the driver does not grow with the rows."""
    if skip + limit <= range_rows:
        return df.orderBy(*order).offset(skip).limit(limit)
    rows = df.count()
    while True:
        parts = min(rows // range_rows + 1, max(RANGES, rows // ROWS_PER_TASK + 1))
        dealt = cut_lineage(df.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()))
        sizes = {r["__range"]: r["n"] for r in dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).collect()}
        before, wanted, first = 0, [], 0
        for part in sorted(sizes):
            if before < skip + limit and before + sizes[part] > skip:
                first = before if not wanted else first
                wanted.append(part)
            before += sizes[part]
        df, skip = dealt.where(F.col("__range").isin(wanted)).drop("__range"), max(0, skip - first)
        held = sum(sizes[part] for part in wanted)
        # rows that the order does not tell apart stay in one range
        if held <= limit + 2 * range_rows or held == rows:
            return df.orderBy(*order).offset(skip).limit(limit)
        rows = held


def page(df: DataFrame, order: Sequence[Column], page: int = 1, limit: int = 10, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One page of the sorted rows, with the total row count beside them."""
    return with_total(df, _slice(df, order, (page - 1) * limit, limit, range_rows))


def page_with_more(df: DataFrame, order: Sequence[Column], page: int | None = None, limit: int = 10,
                   offset: int | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """As `page`, by page number or by offset, with `has_more`."""
    skip = offset if offset is not None else ((page or 1) - 1) * limit
    rows = with_total(df, _slice(df, order, skip, limit, range_rows))
    return rows.withColumn("page", F.lit(skip // limit + 1)).withColumn("has_more", F.col("total") > skip + limit)


def with_total(df: DataFrame, rows: DataFrame) -> DataFrame:
    """The one-row count of `df` beside each row of a page; counted map-side, not in a window."""
    total = df.agg(F.count(F.lit(1)).alias("total")).withColumn("__k", F.lit(1))
    return rows.withColumn("__k", F.lit(1)).join(total, "__k").drop("__k")


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, out: str | None = None) -> DataFrame:
    """First n rows of each key. The limit is applied before the shuffle as well as after it, so a key
    of any size sends at most n rows per task."""
    ranked = df.withColumn("__rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("__rank") <= n)
    return ranked.withColumnRenamed("__rank", out) if out else ranked.drop("__rank")


def count_per(df: DataFrame, keys: Sequence[str], out: str = "total") -> DataFrame:
    """Each row with the row count of its key, counted map-side and joined back."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))
    return df.join(counts, list(keys))


def upcoming(df: DataFrame, at: str, start: Column, end: Column, tie: str, limit: int = 10) -> DataFrame:
    """The first events inside [start, end], the earliest first."""
    return df.where(F.col(at).between(start, end)).orderBy(at, tie).limit(limit)
