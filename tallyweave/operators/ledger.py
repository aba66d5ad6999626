"""Ledger joins, balances and statements.

Statements aggregate to account, category or month first (combined map-side), and only the small result
is rolled up, so no grouping set multiplies the raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyweave.functions.numeric import finite
from tallyweave.scale import running_total, small
from tallyweave.session import cut_lineage


def signed(amount="amount", kind="type") -> Column:
    """Debit positive, credit negative."""
    return F.when(F.col(kind) == "debit", F.col(amount)).when(F.col(kind) == "credit", -F.col(amount))


def until(as_of) -> Column:
    return F.col("date") <= F.lit(as_of).cast("date")


def within(start, end) -> Column:
    return F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))


# --- existence ------------------------------------------------------------------------------------

def check_account_exists(transactions: DataFrame, accounts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(transactions of known accounts, orphans)."""
    known = accounts.select(F.col("id").alias("account_id"))
    return transactions.join(known, "account_id", "left_semi"), transactions.join(known, "account_id", "left_anti")


def deletable_accounts(accounts: DataFrame, transactions: DataFrame) -> DataFrame:
    used = transactions.select(F.col("account_id").alias("id"))
    return accounts.join(used, "id", "left_anti")


# --- balances -------------------------------------------------------------------------------------

def _per_account(transactions: DataFrame, *extra: str) -> DataFrame:
    return transactions.groupBy("account_id", *extra).agg(
        F.sum("amount").alias("raw_sum"), F.sum(signed()).alias("signed"),
        F.sum(F.when(F.col("type") == "debit", F.col("amount"))).alias("debit"),
        F.sum(F.when(F.col("type") == "credit", F.col("amount"))).alias("credit"),
    )


def _zero(c: str) -> Column:
    return F.coalesce(c, F.lit(0)).alias(c)


def account_balance(accounts: DataFrame, transactions: DataFrame, as_of) -> DataFrame:
    """account_id, raw_sum (all amounts added), signed (debit minus credit); no transactions means 0."""
    sums = _per_account(transactions.where(until(as_of)))
    return (
        accounts.select(F.col("id").alias("account_id")).join(sums, "account_id", "left")
        .select("account_id", _zero("raw_sum"), _zero("signed"))
    )


def trial_balance(transactions: DataFrame, as_of) -> DataFrame:
    """debit, credit and balance per account, with a total row (NULL account) and its balance check."""
    sums = _per_account(transactions.where(until(as_of))).select("account_id", _zero("debit"), _zero("credit"))
    total = sums.rollup("account_id").agg(F.sum("debit").alias("debit"), F.sum("credit").alias("credit"))
    return total.withColumn("balance", F.col("debit") - F.col("credit")).withColumn(
        "balanced", F.col("debit") == F.col("credit"))


def _with_type(transactions: DataFrame, accounts: DataFrame, types: list[str], *extra: str) -> DataFrame:
    kinds = accounts.select(F.col("id").alias("account_id"), F.col("type").alias("account_type"))
    return _per_account(transactions, *extra).join(kinds.where(F.col("account_type").isin(types)), "account_id")


def income_statement(accounts: DataFrame, transactions: DataFrame, start, end) -> DataFrame:
    """Amount by (account type, category) with subtotals; `net` counts revenue up and expense down."""
    rows = _with_type(transactions.where(within(start, end)), accounts, ["revenue", "expense"], "category")
    net = F.when(F.col("account_type") == "revenue", F.col("raw_sum")).otherwise(-F.col("raw_sum"))
    return rows.withColumn("n", net).rollup("account_type", "category").agg(
        F.sum("raw_sum").alias("amount"), F.sum("n").alias("net"))


def balance_sheet(accounts: DataFrame, transactions: DataFrame, as_of) -> DataFrame:
    """Signed balance by type and account with totals per type and over all."""
    rows = _with_type(transactions.where(until(as_of)), accounts, ["asset", "liability", "equity"])
    return rows.rollup("account_type", "account_id").agg(F.sum("signed").alias("balance"))


def cash_flow(accounts: DataFrame, transactions: DataFrame, start, end, unit: str = "month") -> DataFrame:
    """Inflow, outflow and net of asset accounts per period."""
    period = F.date_trunc(unit, "date").cast("date")
    dated = transactions.where(within(start, end)).withColumn("period", period)
    rows = _with_type(dated, accounts, ["asset"], "period")
    return rows.groupBy("period").agg(
        F.sum(F.coalesce("debit", F.lit(0))).alias("inflow"), F.sum(F.coalesce("credit", F.lit(0))).alias("outflow"),
        F.sum(F.coalesce("signed", F.lit(0))).alias("net"))


def report_by_period(transactions: DataFrame) -> DataFrame:
    """Month, quarter and year totals by type in one result; `unit` tells which a row is."""
    monthly = (
        transactions.groupBy("type", F.trunc("date", "month").alias("month"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))
        .withColumn("quarter", F.trunc("month", "quarter")).withColumn("year", F.trunc("month", "year"))
    )
    kind, units = F.col("type"), ["month", "quarter", "year"]
    sets = monthly.groupingSets([[kind, F.col(u)] for u in units], kind, *[F.col(u) for u in units]).agg(
        F.sum("n").alias("n"), F.sum("amount").alias("amount"),
        *[F.grouping(u).alias(f"__{u}") for u in units])
    unit = F.when(F.col("__month") == 0, "month").when(F.col("__quarter") == 0, "quarter").otherwise("year")
    return sets.select(unit.alias("unit"), F.coalesce(*units).alias("period"), "type", "n", "amount")


#: Statements by period: account types, what a line stands for, and whether amounts add up over periods.
STATEMENTS = {
    "income_statement": (["revenue", "expense"], "category", False),
    "cash_flow": (["asset"], "account_id", False),
    "balance_sheet": (["asset", "liability", "equity"], "account_id", True),
    "trial_balance": (["asset", "liability", "equity", "revenue", "expense"], "account_id", True),
    "accounts_receivable": (["asset"], "account_id", True),
    "accounts_payable": (["liability"], "account_id", True),
}


def statement_by_period(accounts: DataFrame, transactions: DataFrame, statement: str, unit: str, start, end) -> DataFrame:
    """(period, account_type, item, debit, credit, balance) of a statement for every month, quarter or year that meets
    [start, end], also those without transactions.

    Income and cash flow hold what is dated within the period and [start, end]; items are categories or accounts. The other
    statements hold the position at the period's end, or at `end`: balances run on from all earlier transactions and are
    carried over empty periods. `balance` is debit minus credit, for payables credit minus debit; receivables are asset
    accounts and payables liability accounts of which something is still open. Transactions are added up per item and
    period first, so what is ordered holds one row per item and period.
    """
    if statement not in STATEMENTS:
        raise ValueError(f"unknown statement: {statement}")
    types, item, running = STATEMENTS[statement]
    if unit not in ("month", "quarter", "year"):
        raise ValueError(f"unknown unit: {unit}")
    first, last = (F.trunc(F.lit(d).cast("date"), unit) for d in (start, end))
    dated = transactions.where(until(end) if running else within(start, end)).withColumn(
        "period", F.greatest(F.trunc("date", unit), first))  # earlier ones open the first period
    keys = ["account_type", "item"]
    sums = _with_type(dated, accounts, types, *dict.fromkeys(["period", *([item] if item != "account_id" else [])])).select(
        "account_type", F.col(item).cast("string").alias("item"), "period", _zero("debit"), _zero("credit"))
    step = {"month": "INTERVAL 1 MONTH", "quarter": "INTERVAL 3 MONTH", "year": "INTERVAL 1 YEAR"}[unit]
    grid = sums.select(*keys).distinct().withColumn("period", F.explode(F.sequence(first, last, F.expr(step))))
    empty = grid.select(*keys, "period", F.lit(0).alias("debit"), F.lit(0).alias("credit"))
    lines = sums.unionByName(empty).groupBy(*keys, "period").agg(F.sum("debit").alias("debit"), F.sum("credit").alias("credit"))
    if running:
        upto = W.partitionBy(*keys).orderBy("period").rowsBetween(W.unboundedPreceding, 0)
        lines = lines.withColumns({c: F.sum(c).over(upto) for c in ("debit", "credit")})
    balance = F.col("credit") - F.col("debit") if statement == "accounts_payable" else F.col("debit") - F.col("credit")
    lines = lines.select("period", *keys, "debit", "credit", balance.alias("balance"))
    return lines.where("balance > 0") if statement in ("accounts_receivable", "accounts_payable") else lines


def coa_rollup(accounts: DataFrame, balances: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Balance of every account including all its descendants.

    Climbs one parent level per round, all accounts at once. A path cannot be longer than there are accounts, so more rounds
    than that (or than `max_depth`, where given) mean a parent cycle, which is an error.
    """
    if max_depth is None:
        max_depth = accounts.count() + 1
    parents = accounts.where("parent_account_id IS NOT NULL").select(F.col("id").alias("child"), "parent_account_id")
    own = balances.select(F.col("account_id").alias("at"), "balance")
    level = own.groupBy("at").agg(F.sum("balance").alias("balance"))
    total = level
    for _ in range(max_depth):
        # Each level is already summed per ancestor, so a parent of many children stays one row.
        level = cut_lineage(
            level.join(parents, level["at"] == parents["child"])
            .groupBy(F.col("parent_account_id").alias("at")).agg(F.sum("balance").alias("balance")))
        if level.isEmpty():
            break
        total = total.unionByName(level)
    else:
        raise ValueError(f"accounts form a cycle, or nest deeper than {max_depth} levels")
    summed = total.groupBy("at").agg(F.sum("balance").alias("balance"))
    return accounts.select(F.col("id").alias("at")).join(summed, "at", "left").select(
        F.col("at").alias("account_id"), F.coalesce("balance", F.lit(0)).alias("balance"))


def journal_balanced(entries: DataFrame) -> DataFrame:
    """debit, credit and `balanced` per entry; added up inside the row, without a shuffle."""
    def side(kind: str) -> Column:
        parts = F.filter("entries", lambda e: e["type"] == kind)
        return F.aggregate(parts, F.lit(0).cast("decimal(38,2)"),
                           lambda acc, e: (acc + e["amount"]).cast("decimal(38,2)"))

    return (
        entries.select("id", side("debit").alias("debit"), side("credit").alias("credit"))
        .withColumn("balanced", F.col("debit") == F.col("credit"))
    )


# --- taxes and budgets ----------------------------------------------------------------------------

def tax_for_transactions(transactions: DataFrame, rates: DataFrame) -> DataFrame:
    """Each transaction with the rate valid on its date, the latest effective one on overlap, and its decimal tax.

    Rates become the one winning rate of each calendar day that has transactions around it (at most one row per day, combined
    map-side), so the range condition is an equality on the day and no transaction is multiplied.
    """
    reach = transactions.agg(F.min("date").cast("date").alias("low"), F.max("date").cast("date").alias("high")).first()
    low, high = (F.lit(reach[c]).cast("date") for c in ("low", "high"))
    begin = F.greatest(F.col("effective_date").cast("date"), low)
    finish = F.least(F.date_sub(F.col("expiry_date").cast("date"), 1), high)
    days = F.when(begin <= finish, F.sequence(begin, finish))
    fields = ["rate_id", "rate_name", "country", "rate"]
    by_day = rates.select(F.explode(days).alias("__day"), F.struct(
        "effective_date", F.col("id").alias("rate_id"), F.col("name").alias("rate_name"), "country", "rate").alias("c")).groupBy(
        "__day").agg(F.max("c").alias("c")).select("__day", *[F.col(f"c.{f}").alias(f) for f in fields])
    dated = transactions.join(small(by_day), F.to_date("date") == F.col("__day"), "left").drop("__day")
    tax = F.round(F.col("amount").cast("decimal(18,2)") * F.col("rate").cast("decimal(12,8)"), 2)
    return dated.withColumn("tax", tax.cast("decimal(18,2)"))


def tax_summary(transactions: DataFrame, rates: DataFrame, start, end) -> DataFrame:
    """Tax by rate name and country with every subtotal."""
    taxed = tax_for_transactions(transactions.where(within(start, end)), rates).where("rate_id IS NOT NULL")
    base = taxed.groupBy("rate_name", "country").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("tax").cast("decimal(18,2)")).alias("tax"))
    return base.cube("rate_name", "country").agg(F.sum("n").alias("n"), F.sum("tax").alias("tax"))


def budget_vs_actual(budgets: DataFrame, transactions: DataFrame) -> DataFrame:
    """Planned, actual in the budget's period, variance and share per (budget, category).

    The ends of the periods are put among the days of their category; the difference of the running totals there is the actual
    amount. Periods may overlap at will: work grows with days plus items.
    """
    item = ["budget_id", "start", "end", "category"]
    items = budgets.select(F.col("id").alias("budget_id"), "period", F.explode("items").alias("i")).groupBy(
        "budget_id", F.col("period.start").cast("date").alias("start"), F.col("period.end").cast("date").alias("end"),
        F.col("i.category").alias("category")).agg(F.sum("i.amount").alias("planned"))
    daily = transactions.groupBy("category", F.col("date").cast("date").alias("date")).agg(F.sum("amount").alias("amount"))
    # before the first day's amount, and after the last day's
    ends = items.select("*", F.explode(F.array(F.struct(F.col("start").alias("date"), F.lit(0).alias("place")),
                                               F.struct(F.col("end").alias("date"), F.lit(2).alias("place")))).alias("e"))
    marks = ends.select(*item, "planned", "e.date", "e.place").unionByName(
        daily.withColumn("place", F.lit(1)), allowMissingColumns=True)
    totals = running_total(marks, ["category"], ["date", "place"], "amount", "total").where("place <> 1")
    upto = F.coalesce(F.sum(F.when(F.col("place") == 2, F.col("total"))), F.lit(0)) - F.coalesce(
        F.sum(F.when(F.col("place") == 0, F.col("total"))), F.lit(0))
    valid = (F.col("start") <= F.col("end")) & F.col("category").isNotNull()
    joined = totals.groupBy(*item, "planned").agg(upto.alias("actual")).withColumn(
        "actual", F.when(valid, F.col("actual")).otherwise(0))
    return joined.select(
        "budget_id", "category", "planned", "actual", (F.col("actual") - F.col("planned")).alias("variance"),
        finite(F.try_divide(F.col("actual").cast("double"), F.col("planned").cast("double"))).alias("share"))


def apply_categories(transactions: DataFrame, mapping: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Suggested category by transaction id where its confidence reaches the threshold; the most
    confident suggestion wins."""
    best = mapping.groupBy(F.col("transaction_id").alias("id")).agg(
        F.max(F.struct("confidence", "suggested_category")).alias("s"))
    take = F.col("s.confidence") >= threshold
    return (
        transactions.join(best, "id", "left")
        .withColumn("category", F.when(take, F.col("s.suggested_category")).otherwise(F.col("category"))).drop("s")
    )


# --- logs and commands ----------------------------------------------------------------------------

def request_log_stats(log: DataFrame) -> DataFrame:
    """Count, error share, mean and p95 duration by method, path and status class."""
    return log.groupBy("method", "path", "status").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("status") >= 400).cast("double")).alias("error_share"),
        F.avg("duration_ms").alias("mean_ms"), F.percentile_approx("duration_ms", 0.95, 100_000).alias("p95_ms"))


def command_stats(commands: DataFrame, intents: list[str], statuses: list[str]) -> DataFrame:
    """Per user: totals, success and failure, mean time, last time, and counts by intent and status."""
    def tally(column: str, values: list[str]) -> list[Column]:
        return [F.count_if(F.col(column) == v).alias(f"{column}_{v}") for v in values]

    return commands.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "completed").alias("successful"),
        F.count_if(F.col("status") == "failed").alias("failed"), F.avg("execution_ms").alias("mean_ms"),
        F.max("timestamp").alias("last_at"), *tally("intent", intents), *tally("status", statuses))


def token_usage(rows: DataFrame) -> DataFrame:
    return rows.groupBy("model").agg(
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"))
