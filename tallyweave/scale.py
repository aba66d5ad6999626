"""Exact ordered work on keys of any size.

A window over `partitionBy(key)` puts a whole key in one task. The helpers here first count the
largest key. Below `ROWS_PER_TASK` the plain window is the better plan. Above it the key is cut
into ordered pieces: counts (or sums) per piece are small, their prefix sums give each piece its
starting position, and the piece itself is the unit that a task sorts. Nothing is dropped or capped.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from itertools import takewhile

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tallyweave.functions import sliding

ROWS_PER_TASK = 5_000_000
PIECES = 256
BROADCAST_BYTES = 64 << 20
_PIECE = ("__piece", "__subpiece")


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows held by the most frequent key; aggregated map-side, one number reaches the driver."""
    biggest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return biggest or 0


def _row_bytes(df: DataFrame) -> Column:
    """About the bytes a row takes: texts and nested values by their length, all else as 16."""
    total = F.lit(0).cast("long")
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(c), F.lit(0)) + 16
        elif kind.startswith(("array", "map", "struct")):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 16
        else:
            total = total + 16
    return total


def small(df: DataFrame, rows: int = 200_000, size: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint for a side measured to hold at most `rows` rows and about `size` bytes; a larger side is left to
    a shuffled join. The measure stops at one row above the bound."""
    found = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(_row_bytes(df)).alias("size")).first()
    return F.broadcast(df) if found["n"] <= rows and (found["size"] or 0) <= size else df


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when a scan has fewer partitions than the session has cores (one small or
    unsplittable file); a scan of many files is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _bytes_code(name: str, start: int) -> Column:
    """Seven bytes of a string as a number; bytes in order keep the order of strings."""
    return F.conv(F.rpad(F.hex(F.substring(F.encode(F.col(name), "UTF-8"), start, 7)), 14, "0"), 16, 10).cast("bigint")


def sort_codes(df: DataFrame, order: Sequence[str]) -> list[Column]:
    """One or two numbers whose lexicographic order never contradicts `order`.

    A number or time is its own code, followed by that of the next column. Strings that differ may share
    their first code, so a leading string is followed by its own next bytes instead.
    """
    kinds = dict(df.dtypes)

    def code(name: str) -> Column:
        kind = kinds[name]
        if kind in ("timestamp", "timestamp_ntz"):
            return F.unix_micros(F.col(name).cast("timestamp"))
        if kind == "date":
            return F.unix_date(F.col(name))
        if kind == "string":
            return _bytes_code(name, 1)
        if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
            return F.col(name)
        raise TypeError(f"cannot order by {name}: {kind}")

    if kinds[order[0]] == "string":
        return [_bytes_code(order[0], 1), _bytes_code(order[0], 8)]
    return [code(c) for c in order[:2]]


def _flag_large(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """`__large`: whether the row's key holds more than `limit` rows. There are at most rows / limit such keys."""
    if not keys:
        return df.withColumn("__large", F.lit(True))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
    named = sizes.select(*[F.col(k).alias(f"__l_{i}") for i, k in enumerate(keys)], F.lit(True).alias("__hit"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__l_{i}"))
    flagged = df.join(small(named), same, "left").withColumn("__large", F.col("__hit").isNotNull())
    return flagged.drop("__hit", *[f"__l_{i}" for i in range(len(keys))])


def _count_below(code: Column, points: Column) -> Column:
    return F.coalesce(F.size(F.filter(points, lambda p: p < code)), F.lit(0))


def _cut_points(df: DataFrame, keys: Sequence[str], codes: Sequence[Column], limit: int) -> DataFrame:
    """Rows with the approximate quantiles, ends and size of their own key; NULL where the key holds at most `limit` rows."""
    shares = [i / PIECES for i in range(1, PIECES)]
    found = [
        *[F.percentile_approx(c, shares, 4 * PIECES).alias(f"__p{i}") for i, c in enumerate(codes)],
        F.min(codes[0]).cast("double").alias("__low"), F.max(codes[0]).cast("double").alias("__high"),
        F.count(F.lit(1)).alias("__rows")]
    if not keys:
        whole = df.agg(*found)
        values, kinds = whole.first(), dict(whole.dtypes)
        return df.withColumns({c: F.lit(values[c]).cast(kinds[c]) for c in whole.columns})
    # only the rows of large keys are sorted into digests; there are at most rows / limit such keys
    cut = _flag_large(df, keys, limit).where("__large").groupBy(*keys).agg(*found)
    named = cut.select(*[F.col(k).alias(f"__l_{i}") for i, k in enumerate(keys)], *[c for c in cut.columns if c not in keys])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__l_{i}"))
    return df.join(small(named), same, "left").drop(*[f"__l_{i}" for i in range(len(keys))])


def with_pieces(df: DataFrame, keys: Sequence[str], order: Sequence[str], limit: int) -> DataFrame:
    """Add two columns whose lexicographic order agrees with `order` and that cut each large key evenly; all
    other keys stay whole.

    Cut points are approximate quantiles of the key itself, which affects balance only. Between two cut points rows are
    cut again by even steps, as often as the key's size asks for. A first code that is itself hot (it repeats
    among the quantiles, or is missing) is cut by the second code instead.
    """
    codes = sort_codes(df, order)
    names = [c for c in df.columns]
    # each search runs once per row of a large key; later steps read its column
    searched = (
        _cut_points(df, keys, codes, limit)
        .withColumn("__cuts", F.array_distinct("__p0"))
        .withColumn("__cut", _count_below(codes[0], F.col("__cuts")))
        .withColumn("__on", F.coalesce(F.array_contains("__cuts", codes[0]), F.lit(False)))
        .withColumn("__edges", F.concat(
            F.array("__low"), F.transform("__cuts", lambda p: p.cast("double")), F.array("__high")))
    )
    at, on_cut = F.col("__cut"), F.col("__on")
    steps = F.greatest(F.lit(1), F.ceil(4 * F.col("__rows") / (limit * PIECES)))
    start, end = F.get("__edges", at), F.get("__edges", at + 1)
    step = F.floor(F.try_divide((codes[0].cast("double") - start) * steps, end - start))
    second = F.when(on_cut, 0).otherwise(F.coalesce(step.cast("int"), F.lit(0)))
    if len(codes) > 1:
        repeated = on_cut & (F.size(F.filter("__p0", lambda p: p == codes[0])) > 1)
        second = F.when(codes[0].isNull() | repeated, _count_below(codes[1], F.array_distinct("__p1"))).otherwise(second)
    first = F.when(codes[0].isNull(), -1).otherwise(2 * at + on_cut.cast("int"))
    large = F.col("__rows") > limit
    return searched.select(
        *names, F.when(large, first).otherwise(0).alias(_PIECE[0]), F.when(large, second).otherwise(0).alias(_PIECE[1]))


def _join_starts(placed: DataFrame, starts: DataFrame, keys: Sequence[str]) -> DataFrame:
    on = [*keys, *_PIECE]
    renamed = starts.select(*[F.col(c).alias(f"__r_{i}") for i, c in enumerate(on)], "__start")
    same = F.lit(True)
    for i, c in enumerate(on):
        same = same & F.col(c).eqNullSafe(F.col(f"__r_{i}"))
    return placed.join(renamed, same, "inner").drop(*[f"__r_{i}" for i in range(len(on))])


def _prefix(placed: DataFrame, keys: Sequence[str], amount: Column, combine=F.sum) -> DataFrame:
    per_piece = placed.groupBy(*keys, *_PIECE).agg(amount.alias("__amount"))
    earlier = W.partitionBy(*keys).orderBy(*_PIECE).rowsBetween(W.unboundedPreceding, -1)
    return per_piece.withColumn("__start", combine("__amount").over(earlier)).drop("__amount")


def _whole(keys: Sequence[str]):
    return W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))


def ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "ordinal",
            rows_per_task: int | None = None, largest: int | None = None) -> DataFrame:
    """1-based position of each row in its key's order. `largest` is the size of the largest key, if known."""
    limit = ROWS_PER_TASK if rows_per_task is None else rows_per_task
    if largest is None:
        largest = largest_group(df, keys)
    if largest <= limit:
        return df.withColumn(out, F.row_number().over(_whole(keys).orderBy(*order)).cast("bigint"))
    placed = with_pieces(df, keys, order, limit).withColumn("__all", F.lit(0))
    by = [*keys, "__all"]
    joined = _join_starts(placed, _prefix(placed, by, F.count(F.lit(1))), by)
    inside = F.row_number().over(W.partitionBy(*by, *_PIECE).orderBy(*order))
    return joined.withColumn(out, inside + F.coalesce("__start", F.lit(0))).drop(*_PIECE, "__start", "__all")


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str,
                  rows_per_task: int | None = None) -> DataFrame:
    """Running sum of `value` in each key's order (row by row); missing values add nothing.

    Without keys the whole frame is one order; it too is cut once it outgrows a task.
    """
    limit = ROWS_PER_TASK if rows_per_task is None else rows_per_task
    largest = largest_group(df, keys)
    if largest <= limit:
        upto = _whole(keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumn(out, F.sum(value).over(upto))
    placed = with_pieces(df, keys, order, limit).withColumn("__all", F.lit(0))
    by = [*keys, "__all"]
    joined = _join_starts(placed, _prefix(placed, by, F.sum(value)), by)
    upto = W.partitionBy(*by, *_PIECE).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    inside = F.sum(value).over(upto)
    total = F.when(F.col("__start").isNull(), inside).otherwise(F.col("__start") + F.coalesce(inside, F.lit(0)))
    return joined.withColumn(out, total).drop(*_PIECE, "__start", "__all")


def running_max(df: DataFrame, order: Sequence[str], value: str, out: str,
                rows_per_task: int | None = None) -> DataFrame:
    """Running maximum of `value` over all rows in order; cut into pieces like `running_total`."""
    limit = ROWS_PER_TASK if rows_per_task is None else rows_per_task
    largest = largest_group(df, [])
    if largest <= limit:
        upto = _whole([]).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumn(out, F.max(value).over(upto))
    placed = with_pieces(df, [], order, limit).withColumn("__all", F.lit(0))
    joined = _join_starts(placed, _prefix(placed, ["__all"], F.max(value), F.max), ["__all"])
    upto = W.partitionBy("__all", *_PIECE).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    best = F.greatest(F.max(value).over(upto), F.col("__start"))
    return joined.withColumn(out, best).drop(*_PIECE, "__start", "__all")


class Series:
    """Rows of one key in order: hands out windows and notes how many rows each reaches.

    The sum over all calls is an upper bound of the reach of nested windows, which is what `evaluate`
    needs to copy enough rows across a block edge.
    """

    def __init__(self, by: Sequence[str], order: Sequence[str]):
        self.by, self.order = tuple(by), tuple(order)
        self.reaches: list[tuple[int, int]] = []
        self.slides: list[tuple[str, Column, str, int]] = []

    @property
    def back(self) -> int:
        return sum(b for b, _ in self.reaches)

    @property
    def ahead(self) -> int:
        return sum(a for _, a in self.reaches)

    def _ordered(self, back: int = 0, ahead: int = 0):
        self.reaches.append((back, ahead))
        return W.partitionBy(*self.by, "__block").orderBy(*self.order)

    def last(self, rows: int):
        return self._ordered(rows - 1).rowsBetween(1 - rows, 0)

    def previous(self, rows: int):
        return self._ordered(rows)

    def following(self, rows: int):
        return self._ordered(0, rows)

    def between(self, start: int, end: int):
        return self._ordered(max(0, -start), max(0, end)).rowsBetween(start, end)

    def slide(self, kind: str, value: Column, rows: int) -> Column:
        """A statistic of `sliding.KINDS` over the last `rows` rows; `with_slides` fills the column it names."""
        self.reaches.append((rows - 1, 0))
        name = f"__slide{len(self.slides)}"
        self.slides.append((name, value, kind, rows))
        return F.col(name)


def with_slides(df: DataFrame, series: Series) -> DataFrame:
    """Fill the columns of `series.slides`. Rows are ordered once for all of them; one that reads another's result
    waits for the next pass. The cost of a row does not grow with the window."""
    waiting = list(series.slides)
    while waiting:
        unfilled = {name for name, *_ in waiting}
        # a call is noted after those it reads
        ready = list(takewhile(lambda w: unfilled.isdisjoint(re.findall(r"__slide\d+", str(w[1]))), waiting))
        waiting = waiting[len(ready):]
        inputs = {f"{name}_in": value for name, value, _, _ in ready}
        ordered = W.partitionBy(*series.by, "__block").orderBy(*series.order)
        # the window leaves the rows of a key together and in order, which the pass over them relies on
        rows = df.select("*", *[v.cast("double").alias(c) for c, v in inputs.items()], F.row_number().over(ordered).alias("__nth"))
        added = [T.StructField(name, T.DoubleType() if sliding.KINDS[kind] == "double" else T.IntegerType())
                 for name, _, kind, _ in ready]
        wanted = [(name, f"{name}_in", kind, d) for name, _, kind, d in ready]
        df = rows.mapInArrow(sliding.passes(wanted, "__nth"), T.StructType([*rows.schema.fields, *added])).drop("__nth", *inputs)
    return df


def add_columns(df: DataFrame, series: Series, built: dict[str, Column]) -> DataFrame:
    """Window columns built over `series` for rows that carry `__block`."""
    slid = with_slides(df, series)
    return slid.select("*", *[c.alias(n) for n, c in built.items()]).drop(*[name for name, *_ in series.slides])


def in_blocks(df: DataFrame, by: Sequence[str], order: Sequence[str], back: int, ahead: int,
              build: Callable[[DataFrame], DataFrame], rows_per_task: int | None = None,
              largest: int | None = None, position: str | None = None) -> DataFrame:
    """`build` over rows whose `__block` holds at most a task's share of a key, each block with the `back` rows before
    it and the `ahead` rows after it. `position` names a column for the 1-based place of a row in its key."""
    limit = ROWS_PER_TASK if rows_per_task is None else rows_per_task
    if largest is None:
        largest = largest_group(df, by)
    if largest <= limit:
        whole = df.withColumn("__block", F.lit(0))
        if position:
            ordered = W.partitionBy(*by, "__block").orderBy(*order)
            whole = whole.withColumn(position, F.row_number().over(ordered).cast("bigint"))
        return build(whole).drop("__block")
    size = max(limit, back + ahead + 1)
    at = F.col("__at") - 1
    blocks = F.sequence(F.floor((at - ahead) / size), F.floor((at + back) / size))
    spread = (
        ordinal(df, by, order, "__at", limit, largest)
        .withColumn("__home", F.floor(at / size))
        .withColumn("__block", F.explode(blocks))
    )
    if position:
        spread = spread.withColumn(position, F.col("__at"))
    return build(spread).where("__home = __block").drop("__at", "__home", "__block")


def evaluate(df: DataFrame, series: Series, columns: dict[str, Callable[[Series], Column]],
             rows_per_task: int | None = None, largest: int | None = None, position: str | None = None) -> DataFrame:
    """Add bounded-reach window columns. Keys longer than a task's share are split into blocks of
    consecutive rows; each block also receives the neighbours its windows reach.

    `largest` is a known bound on the rows of a key; it saves the count, which otherwise runs the plan behind
    `df` once more (give a stored table where that plan is long). `position` names a column for the 1-based place of a
    row in its key, from the same count and order."""
    built = {name: make(series) for name, make in columns.items()}
    return in_blocks(df, series.by, series.order, series.back, series.ahead,
                     lambda rows: add_columns(rows, series, built), rows_per_task, largest, position)
