"""Ledger rows: files, filters, validation, balances, statements, logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave import vocab
from tallyweave.checks.registry import check, lines, plain_ts, r2, r6
from tallyweave.operators import changes, filtering as fl, ledger as lg, validation as va
from tallyweave.sources import ledger_json as lj

_TX = "id, CAST(date AS VARCHAR) AS date, description, CAST(amount AS DOUBLE) AS amount, type, account_id, category, status"


def _tx(df):
    return df.withColumns({c: F.col(c).cast(k) for c, k in [("amount", "double"), ("date", "string")] if c in df.columns})

# --- nested JSON in and out -----------------------------------------------------------------------

def _account_json():
    return F.to_json(F.struct(
    F.col("id").cast("string").alias("Id"), F.col("name").alias("Name"), F.upper("type").alias("AccountType"),
    F.when(F.col("id") % 7 == 0, "n/a").otherwise(F.col("balance").cast("string")).alias("CurrentBalance"),
    F.when(F.col("id") % 3 == 0, F.struct(F.lit("EUR").alias("value"))).alias("CurrencyRef"),
    F.struct(F.lit("2024-01-01").alias("CreateTime"), F.lit("2024-01-02").alias("LastUpdatedTime")).alias("MetaData"),
)).alias("json")


@check("src06_normalize_accounts", """
    SELECT CAST(id AS VARCHAR) AS id, name, type, CASE WHEN id % 7 = 0 THEN NULL ELSE CAST(balance AS DOUBLE) END AS balance,
           CASE WHEN id % 3 = 0 THEN 'EUR' ELSE 'USD' END AS currency, '2024-01-01' AS created_at, '2024-01-02' AS updated_at
    FROM fx_accounts""")
def _(t):
    return lj.normalize_accounts(t.accounts.select(_account_json()))


def _tx_json():
    return F.to_json(F.struct(
    F.col("id").cast("string").alias("Id"), F.upper("type").alias("TransactionType"),
    F.col("amount").cast("string").alias("Amount"), F.col("description").alias("Description"),
    F.struct(F.col("account_id").cast("string").alias("value"), F.col("category").alias("name")).alias("AccountRef"),
    F.col("date").cast("string").alias("TxnDate"),
    F.when(F.col("status") == "pending", "PENDING").alias("status"),
    F.struct(F.lit("2024-01-01").alias("CreateTime"), F.lit("2024-01-02").alias("LastUpdatedTime")).alias("MetaData"),
)).alias("json")


@check("src07_normalize_transactions", """
    SELECT CAST(id AS VARCHAR) AS id, type, CAST(amount AS DOUBLE) AS amount, description, category,
           CAST(date AS VARCHAR) AS date, CAST(account_id AS VARCHAR) AS account_id, status, '2024-01-01' AS created_at,
           '2024-01-02' AS updated_at FROM fx_transactions""")
def _(t):
    return lj.normalize_transactions(t.transactions.select(_tx_json()))


def _budgets(t):
    """One budget per account type and year, an item per category: planned is twice what was booked."""
    rows = t.transactions.join(t.accounts.select(F.col("id").alias("account_id"), F.col("type").alias("kind")), "account_id")
    items = rows.groupBy("kind", F.year("date").alias("year"), "category").agg(F.sum("amount").alias("amount"))
    planned = (F.col("amount") * 2).cast("decimal(18,2)")
    return items.withColumn("planned", planned).groupBy("kind", "year").agg(F.sort_array(F.collect_list(F.struct(
        "category", F.col("planned").alias("amount"), F.col("amount").cast("decimal(18,2)").alias("actual")))).alias("items")
    ).select(
        F.concat_ws("-", "kind", "year").alias("id"), F.concat(F.lit("plan "), "kind").alias("name"),
        F.struct(F.concat("year", F.lit("-01-01")).alias("start"), F.concat("year", F.lit("-12-31")).alias("end")).alias("period"),
        "items")


_BUDGET_ITEMS = """
    SELECT concat(a.type, '-', year(t.date)) AS id, concat('plan ', a.type) AS name,
           concat(year(t.date), '-01-01') AS "start", concat(year(t.date), '-12-31') AS "end", t.category AS category,
           CAST(sum(t.amount) * 2 AS DECIMAL(18,2)) AS amount, CAST(sum(t.amount) AS DECIMAL(18,2)) AS actual
    FROM fx_transactions t JOIN fx_accounts a ON a.id = t.account_id
    GROUP BY a.type, year(t.date), t.category"""

def _budget_json():
    return F.to_json(F.struct(
    F.col("id").alias("Id"), F.col("name").alias("Name"), F.col("period.start").alias("StartDate"),
    F.col("period.end").alias("EndDate"),
    F.transform("items", lambda i: F.struct(
        F.struct(i["category"].alias("name")).alias("AccountRef"), i["amount"].cast("string").alias("Amount"),
        i["actual"].cast("string").alias("ActualAmount"))).alias("BudgetDetail"),
)).alias("json")


@check("src08_normalize_budgets", f"""
    SELECT id, name, "start", "end", category, round(CAST(amount AS DOUBLE), 2) AS amount, round(CAST(actual AS DOUBLE), 2) AS actual
    FROM ({_BUDGET_ITEMS}) b""")
def _(t):
    flat = lj.normalize_budgets(_budgets(t).select(_budget_json()))
    rows = flat.select("id", "name", "period.*", F.explode("items").alias("i"))
    return rows.select("id", "name", "start", "end", "i.category", r2("i.amount").alias("amount"), r2("i.actual").alias("actual"))


@check("src09_denormalize_accounts", """
    SELECT id, '{"Name":"' || name || '","AccountType":"' || upper(type) || '","CurrencyRef":{"value":"USD"}}' AS json
    FROM fx_accounts""")
def _(t):
    return lj.denormalize_accounts(t.accounts)


@check("src09_denormalize_transactions", """
    SELECT id, '{"TransactionType":"' || upper(type) || '","Amount":' || amount || ',"Description":"' || description
           || '","AccountRef":{"value":"' || account_id || '","name":"' || category || '"},"TxnDate":"' || date || '"}' AS json
    FROM fx_transactions""")
def _(t):
    return lj.denormalize_transactions(t.transactions.withColumn("account_id", F.col("account_id").cast("string")))


@check("src09_denormalize_budgets", f"""
    SELECT id, '{{"Name":"' || any_value(name) || '","StartDate":"' || any_value("start") || '","EndDate":"' || any_value("end")
           || '","BudgetDetail":[' || string_agg('{{"AccountRef":{{"name":"' || category || '"}},"Amount":' || amount || '}}', ','
           ORDER BY category) || ']}}' AS json FROM ({_BUDGET_ITEMS}) b GROUP BY id""")
def _(t):
    return lj.denormalize_budgets(_budgets(t))


@check("src10_flatten_report", """
    SELECT 'Yearly ' || type AS report, CAST(dense_rank() OVER (PARTITION BY type ORDER BY y) - 1 AS INTEGER) AS section,
           CAST(row_number() OVER (PARTITION BY type, y, c ORDER BY category) - 1 AS INTEGER) AS row, c AS "column",
           CASE c WHEN 0 THEN category ELSE CAST(n AS VARCHAR) END AS value
    FROM (SELECT type, year(date) AS y, category, count(*) AS n FROM fx_transactions GROUP BY ALL) g,
         (SELECT unnest([0, 1]) AS c) u""")
def _(t):
    counts = t.transactions.groupBy("type", F.year("date").alias("y"), "category").agg(F.count(F.lit(1)).alias("n"))
    cell = lambda c: F.struct(c.cast("string").alias("value"))
    row = F.struct(F.array(cell(F.col("category")), cell(F.col("n"))).alias("ColData"))
    sections = counts.groupBy("type", "y").agg(F.sort_array(F.collect_list(row)).alias("Rows"))
    reports = sections.groupBy("type").agg(F.sort_array(F.collect_list(F.struct("y", "Rows"))).alias("s"))
    body = F.struct(F.struct(F.concat(F.lit("Yearly "), "type").alias("ReportName")).alias("Header"),
                    F.transform("s", lambda e: F.struct(e["Rows"].alias("Rows"))).alias("Rows"))
    flat = lj.flatten_report(reports.select(F.to_json(body).alias("json")))
    return flat.select("report", "section", "row", "column", "value")

# --- filters and projections ----------------------------------------------------------------------

@check("fil01_filter_transactions", f"""
    SELECT {_TX} FROM fx_transactions WHERE date >= DATE '1995-06-01' AND date <= DATE '1997-12-31'
    AND category = '1-URGENT' AND amount >= 50000 AND amount <= 300000""")
def _(t):
    return _tx(fl.filter_transactions(t.transactions, start_date="1995-06-01", end_date="1997-12-31",
                                      category="1-URGENT", min_amount=50000, max_amount=300000))


@check("fil02_extra_filters", f"""
    SELECT {_TX} FROM fx_transactions WHERE type = 'credit' AND status = 'pending' AND lower(description) LIKE '%r 12%'""")
def _(t):
    return _tx(fl.filter_transactions(t.transactions, type="credit", status="pending", search="R 12"))


@check("fil03_apply_filters", f"""
    SELECT {_TX} FROM fx_transactions WHERE amount > 1000 AND amount <= 400000 AND category IN ('1-URGENT', '2-HIGH', '5-LOW')
    AND category NOT IN ('5-LOW') AND status <> 'pending' AND type = 'debit' AND description LIKE 'order%'
    AND description LIKE '%7%' AND description LIKE '%9'""")
def _(t):
    return _tx(fl.apply_filters(t.transactions, {
        "amount": {"gt": 1000, "lte": 400000}, "category": {"in": ["1-URGENT", "2-HIGH", "5-LOW"], "nin": ["5-LOW"]},
        "status": {"ne": "pending"}, "type": "debit",
        "description": {"startsWith": "order", "contains": "7", "endsWith": "9"}}))


@check("prj02_pick", "SELECT id, amount FROM (SELECT id, CAST(amount AS DOUBLE) AS amount FROM fx_transactions) t")
def _(t):
    return _tx(fl.pick(t.transactions, ["id", "amount", "absent"]))


@check("prj02_omit", "SELECT id, CAST(date AS VARCHAR) AS date, type, account_id, category, status FROM fx_transactions")
def _(t):
    return _tx(fl.omit(t.transactions, ["amount", "description", "absent"]))


@check("prj03_strip_unknown", "SELECT id, name, type FROM fx_accounts")
def _(t):
    from pyspark.sql import types as T
    return fl.strip_unknown(t.accounts, T.StructType.fromDDL("id bigint, name string, type string, extra string"))


@check("prj04_transaction_defaults", """
    SELECT id, type, CASE WHEN id % 11 = 0 THEN NULL ELSE CAST(amount AS DOUBLE) END AS amount,
           CASE WHEN id % 2 = 0 THEN '' ELSE description END AS description,
           CASE WHEN id % 3 = 0 THEN 'Uncategorized' ELSE category END AS category,
           CASE WHEN id % 5 = 0 THEN '2024-03-01' ELSE CAST(date AS VARCHAR) END AS date, account_id, 'pending' AS status,
           CAST(id AS VARCHAR) AS source FROM fx_transactions""")
def _(t):
    raw = t.transactions.select(
        "id", "type", F.when(F.col("id") % 11 == 0, "many").otherwise(F.col("amount").cast("string")).alias("amount"),
        F.when(F.col("id") % 2 == 1, F.col("description")).alias("description"),
        F.when(F.col("id") % 3 == 0, "").otherwise(F.col("category")).alias("category"),
        F.when(F.col("id") % 5 != 0, F.col("date").cast("string")).alias("date"), "account_id",
        F.to_json(F.struct(F.col("id").cast("string").alias("source"))).alias("metadata"))
    filled = fl.transaction_defaults(raw, F.lit("2024-03-01 10:00:00").cast("timestamp"))
    return filled.withColumn("source", F.col("metadata")["source"]).drop("metadata", "created_at", "updated_at")

# --- validation -----------------------------------------------------------------------------------

def _codes(*pairs):
    return "concat_ws('|', " + ", ".join(f"CASE WHEN NOT ({ok}) THEN '{code}' END" for code, ok in pairs) + ")"


_RAW_TX = """(SELECT id, CASE WHEN id % 13 = 0 THEN NULL ELSE date END AS date,
    CASE id % 7 WHEN 0 THEN '' WHEN 1 THEN 'ab' ELSE description END AS description, amount,
    CASE WHEN id % 5 = 0 THEN 'refund' ELSE type END AS type, account_id,
    CASE WHEN id % 3 = 0 THEN NULL ELSE category END AS category FROM fx_transactions)"""


def _raw_tx(t):
    i = F.col("id")
    return t.transactions.select(
        "id", F.when(i % 13 != 0, F.col("date")).alias("date"),
        F.when(i % 7 == 0, "").when(i % 7 == 1, "ab").otherwise(F.col("description")).alias("description"), "amount",
        F.when(i % 5 == 0, "refund").otherwise(F.col("type")).alias("type"), "account_id",
        F.when(i % 3 != 0, F.col("category")).alias("category"))


@check("val01_validate_transactions", "SELECT id, " + _codes(
    ("date.required", "date IS NOT NULL"), ("date.max", "date IS NULL OR date <= DATE '1999-01-01'"),
    ("description.required", "description <> ''"), ("description.min", "description = '' OR length(description) >= 3"),
    ("description.max", "length(description) <= 500"), ("amount.base", "amount IS NOT NULL"),
    ("type.only", "type IN ('debit', 'credit')"), ("account_id.required", "account_id IS NOT NULL"),
    ("category.required", "category IS NOT NULL")) + f" AS violations FROM {_RAW_TX} t")
def _(t):
    rules = va.transaction_rules(F.lit("1999-01-01").cast("timestamp"))
    return va.check(_raw_tx(t), rules).select("id", lines("violations").alias("violations"))


@check("val01_quarantine", f"""
    SELECT id FROM {_RAW_TX} t WHERE date IS NULL OR description IN ('', 'ab') OR type = 'refund' OR category IS NULL""")
def _(t):
    rules = va.transaction_rules(F.lit("2100-01-01").cast("timestamp"))
    return va.split(va.check(_raw_tx(t), rules))[1].select("id")


@check("val02_validate_accounts", "SELECT id, " + _codes(
    ("name.min", "length(name) >= 3"), ("name.max", "length(name) <= 100"),
    ("type.only", "type IN ('asset', 'liability', 'equity', 'revenue', 'expense')"),
    ("currency.pattern", "regexp_matches(currency, '^[A-Z]{3}$')")) + """ AS violations FROM (
        SELECT id, CASE WHEN id % 4 = 0 THEN 'ab' ELSE name END AS name, CASE WHEN id % 3 = 0 THEN 'other' ELSE type END AS type,
               CASE id % 5 WHEN 0 THEN 'usd' WHEN 1 THEN 'DOLLARS' ELSE currency END AS currency FROM fx_accounts) a""")
def _(t):
    i = F.col("id")
    raw = t.accounts.select(
        "id", F.when(i % 4 == 0, "ab").otherwise(F.col("name")).alias("name"),
        F.when(i % 3 == 0, "other").otherwise(F.col("type")).alias("type"), F.lit(None).cast("string").alias("description"),
        F.when(i % 5 == 0, "usd").when(i % 5 == 1, "DOLLARS").otherwise(F.col("currency")).alias("currency"))
    return va.check(raw, va.account_rules()).select("id", lines("violations").alias("violations"))


@check("val03_validate_ranges", """
    SELECT id, coalesce(lim, 50) AS "limit", coalesce(off, 0) AS "offset", """ + _codes(
    ("end_date.min", "end_date IS NULL OR end_date >= start_date"), ("max_amount.min", "max_amount >= min_amount"),
    ("limit.range", "coalesce(lim, 50) BETWEEN 1 AND 100"), ("offset.min", "coalesce(off, 0) >= 0")) + """ AS violations FROM (
        SELECT id, date AS start_date, CASE id % 3 WHEN 0 THEN NULL WHEN 1 THEN date - 5 ELSE date + 5 END AS end_date,
               amount AS min_amount, CASE WHEN id % 4 = 0 THEN amount / 2 ELSE amount * 2 END AS max_amount,
               CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 101 ELSE 20 END AS lim,
               CASE id % 7 WHEN 0 THEN NULL WHEN 1 THEN -1 ELSE 10 END AS off FROM fx_transactions) q""")
def _(t):
    i = F.col("id")
    specs = t.transactions.select(
        "id", F.col("date").alias("start_date"),
        F.when(i % 3 == 1, F.date_sub("date", 5)).when(i % 3 == 2, F.date_add("date", 5)).alias("end_date"),
        F.col("amount").alias("min_amount"), F.when(i % 4 == 0, F.col("amount") / 2).otherwise(F.col("amount") * 2).alias("max_amount"),
        F.when(i % 5 == 1, 0).when(i % 5 == 2, 101).when(i % 5 > 2, 20).alias("limit"),
        F.when(i % 7 == 1, -1).when(i % 7 > 1, 10).alias("offset"))
    checked = va.check(va.range_defaults(specs), va.range_rules())
    return checked.select("id", "limit", "offset", lines("violations").alias("violations"))


@check("val04_validate_commands", "SELECT doc_id, " + _codes(
    ("text.min", "length(text) >= 3"), ("text.max", "length(text) <= 1000"), ("user_id.required", "doc_id % 4 <> 0"))
    + " AS violations FROM documents")
def _(t):
    raw = t.table("documents").select("doc_id", "text", F.when(F.col("doc_id") % 4 != 0, F.col("doc_id")).alias("user_id"))
    return va.check(raw, va.command_rules()).select("doc_id", lines("violations").alias("violations"))


_PARAM_SPEC = {"query": ("string", True), "count": ("number", False), "deep": ("boolean", False),
               "options": ("object", False), "tags": ("array", True)}


@check("val05_validate_params", "SELECT event_id, " + _codes(
    ("query.missing", "event_id % 4 <> 0"), ("query.type", "event_id % 4 = 0 OR event_id % 4 <> 1"),
    ("count.type", "event_id % 3 <> 0"), ("options.type", "event_id % 5 <> 0"), ("tags.type", "event_id % 7 <> 0"))
    + " AS violations FROM events")
def _(t):
    i = F.col("event_id")
    text = F.concat(
        F.lit("{"), F.when(i % 4 == 0, "").when(i % 4 == 1, '"query":5,').otherwise(F.lit('"query":"x",')),
        F.when(i % 3 == 0, F.lit('"count":"two",')).otherwise(F.concat(F.lit('"count":'), F.col("value").cast("string"), F.lit(","))),
        F.when(i % 5 == 0, F.lit('"options":[1],')).otherwise(F.concat(F.lit('"options":'), "props", F.lit(","))),
        F.lit('"deep":true,"tags":'), F.when(i % 7 == 0, F.lit('{"a":1}')).otherwise(F.lit('["a"]')), F.lit("}"))
    raw = t.table("events").select("event_id", text.alias("params"))
    return va.check(raw, va.param_rules("params", _PARAM_SPEC)).select("event_id", lines("violations").alias("violations"))


@check("val06_rating_present", "SELECT id, " + _codes(
    ("rating.required", "r <> 0"), ("rating.range", "r BETWEEN 1 AND 5")) + """ AS violations
    FROM (SELECT id, CASE id % 9 WHEN 0 THEN 0 WHEN 1 THEN 9 ELSE rating END AS r FROM fx_feedback) f""")
def _(t):
    i = F.col("id")
    raw = t.feedback.select("id", F.when(i % 9 == 0, 0).when(i % 9 == 1, 9).otherwise(F.col("rating")).alias("rating"))
    return va.check(raw, va.rating_rules()).select("id", lines("violations").alias("violations"))


@check("val07_validate_strict", "SELECT id, " + _codes(
    ("type.only", "id % 2 = 0"), ("amount.positive", "id % 3 <> 0"), ("date.datetime", "id % 5 <> 0"),
    ("account_id.uuid", "id % 7 <> 0")) + " AS violations FROM fx_transactions")
def _(t):
    i = F.col("id")
    raw = t.transactions.select(
        "id", F.when(i % 2 == 0, "transfer").otherwise(F.col("type")).alias("type"),
        F.when(i % 3 == 0, -F.col("amount")).otherwise(F.col("amount")).alias("amount"), "description", "category",
        F.when(i % 5 == 0, F.col("date").cast("string")).otherwise(F.concat(F.col("date").cast("string"), F.lit("T00:00:00Z"))).alias("date"),
        F.when(i % 7 == 0, i.cast("string")).otherwise(
            F.concat(F.lpad(F.lower(F.hex(i)), 8, "0"), F.lit("-0000-4000-8000-000000000000"))).alias("account_id"))
    return va.check(raw, va.strict_transaction_rules()).select("id", lines("violations").alias("violations"))


@check("val07_strict_accounts", "SELECT id, " + _codes(
    ("name.min", "id % 4 <> 0"), ("type.only", "id % 3 = 0"), ("currency.length", "id % 5 <> 0")) + " AS violations FROM fx_accounts")
def _(t):
    i = F.col("id")
    raw = t.accounts.select(
        "id", F.when(i % 4 == 0, "").otherwise(F.col("name")).alias("name"),
        F.when(i % 3 == 0, "savings").otherwise(F.col("type")).alias("type"),
        F.when(i % 5 == 0, "US").otherwise(F.col("currency")).alias("currency"))
    return va.check(raw, va.strict_account_rules()).select("id", lines("violations").alias("violations"))


@check("val07_strict_ranges", "SELECT id, " + _codes(
    ("start_date.datetime", "id % 3 <> 0"), ("end_date.datetime", "id % 4 <> 0")) + " AS violations FROM fx_transactions")
def _(t):
    i, day = F.col("id"), F.col("date").cast("string")
    raw = t.transactions.select(
        "id", F.when(i % 3 == 0, day).otherwise(F.concat(day, F.lit("T00:00:00Z"))).alias("start_date"),
        F.when(i % 4 == 0, F.concat(day, F.lit(" 23:59:59"))).otherwise(F.concat(day, F.lit("T23:59:59.999Z"))).alias("end_date"))
    return va.check(raw, va.strict_range_rules()).select("id", lines("violations").alias("violations"))

# --- joins ----------------------------------------------------------------------------------------

_EARLY = "date BETWEEN DATE '1995-01-01' AND DATE '1995-02-15'"


def _early(t):
    return t.transactions.where(lg.within("1995-01-01", "1995-02-15"))


@check("joi06_check_account_exists", f"""
    SELECT t.id, CASE WHEN a.id IS NULL THEN 'orphan' ELSE 'known' END AS outcome FROM fx_transactions t
    LEFT JOIN (SELECT id + 3 AS id FROM fx_accounts) a ON a.id = t.account_id""")
def _(t):
    known, orphans = lg.check_account_exists(t.transactions, t.accounts.withColumn("id", F.col("id") + 3))
    return known.select("id", F.lit("known").alias("outcome")).union(orphans.select("id", F.lit("orphan")))


@check("joi07_deletable_accounts", f"""
    SELECT id, name FROM fx_accounts WHERE id NOT IN (SELECT account_id + 3 FROM fx_transactions)""")
def _(t):
    return lg.deletable_accounts(t.accounts, t.transactions.withColumn("account_id", F.col("account_id") + 3)).select("id", "name")


_RATES = """(VALUES (1, 'standard', 0.10, 'US', DATE '1995-03-10', DATE '1998-01-01'),
    (2, 'raised', 0.12, 'US', DATE '1997-06-15', CAST(NULL AS DATE)), (3, 'reduced', 0.05, 'GB', DATE '1999-02-01', DATE '2000-07-20'))
    AS r(id, name, rate, country, effective_date, expiry_date)"""


def _rates(t):
    return t.spark.sql(f"SELECT id, name, CAST(rate AS DOUBLE) AS rate, country, effective_date, expiry_date FROM {_RATES[:_RATES.index(' AS r(')]} AS r(id, name, rate, country, effective_date, expiry_date)")


_TAXED = f"""
    SELECT * FROM (SELECT t.id, t.date, t.amount, r.id AS rate_id, r.name AS rate_name, r.country, CAST(r.rate AS DOUBLE) AS rate,
        row_number() OVER (PARTITION BY t.id ORDER BY r.effective_date DESC, r.id DESC) AS place
        FROM fx_transactions t LEFT JOIN {_RATES} ON r.effective_date <= t.date AND (r.expiry_date IS NULL OR t.date < r.expiry_date)
    ) x WHERE place = 1"""


@check("joi11_tax_for_transactions", f"SELECT id, rate_name, CAST(round(CAST(amount AS DECIMAL(18,2)) * CAST(rate AS DECIMAL(12,8)), 2) AS DOUBLE) AS tax FROM ({_TAXED}) t")
def _(t):
    taxed = lg.tax_for_transactions(t.transactions, _rates(t))
    return taxed.select("id", "rate_name", F.col("tax").cast("double").alias("tax"))


@check("agg09_tax_summary", f"""
    SELECT rate_name, country, CAST(count(*) AS BIGINT) AS n, CAST(sum(tax) * 100 AS BIGINT) AS tax_cents FROM (
        SELECT rate_name, country, round(CAST(amount AS DECIMAL(18,2)) * CAST(rate AS DECIMAL(12,8)), 2) AS tax FROM ({_TAXED}) t
        WHERE rate_id IS NOT NULL AND date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31') x
    GROUP BY CUBE (rate_name, country)""")
def _(t):
    found = lg.tax_summary(t.transactions, _rates(t), "1996-01-01", "2000-12-31")
    return found.select("rate_name", "country", "n", (F.col("tax") * 100).cast("bigint").alias("tax_cents"))


@check("joi13_budget_vs_actual", f"""
    WITH b AS (
        SELECT id || m AS id, category, amount, CAST("start" AS DATE) + CAST(m AS INTEGER) * 40 AS "start", CAST("end" AS DATE) + CAST(m AS INTEGER) * 25 AS "end"
        FROM ({_BUDGET_ITEMS}) i, (VALUES ('0'), ('1'), ('2')) v(m))
    SELECT b.id AS budget_id, b.category, round(CAST(any_value(b.amount) AS DOUBLE), 2) AS planned,
           round(CAST(coalesce(sum(s.amount), 0) AS DOUBLE), 2) AS actual,
           round(CAST(coalesce(sum(s.amount), 0) - any_value(b.amount) AS DOUBLE), 2) AS variance,
           round(CAST(coalesce(sum(s.amount), 0) AS DOUBLE) / CAST(any_value(b.amount) AS DOUBLE), 6) AS share
    FROM b LEFT JOIN (SELECT category, CAST(date AS DATE) AS date, sum(amount) AS amount FROM fx_transactions GROUP BY ALL) s
    ON s.category = b.category AND s.date BETWEEN b."start" AND b."end" GROUP BY b.id, b.category""")
def _(t):
    """Three budgets of each kind and year, over spans that overlap and are no whole years."""
    moved = _budgets(t).withColumn("m", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select(
        F.concat("id", F.col("m").cast("string")).alias("id"), "items", F.struct(
            F.date_add(F.to_date("period.start"), F.col("m") * 40).alias("start"),
            F.date_add(F.to_date("period.end"), F.col("m") * 25).alias("end")).alias("period"))
    found = lg.budget_vs_actual(moved, t.transactions)
    return found.select("budget_id", "category", *[r2(c).alias(c) for c in ("planned", "actual", "variance")], r6("share").alias("share"))


@check("joi15_upsert", """
    SELECT coalesce(t.id, u.id) AS id, coalesce(u.name, t.name) AS name, coalesce(u.balance, t.balance) AS balance,
           CASE WHEN u.id IS NOT NULL THEN '2024-03-01' ELSE '2024-01-01' END AS updated_at
    FROM (SELECT id, name, CAST(balance AS DOUBLE) AS balance FROM fx_accounts WHERE id % 3 <> 0) t
    FULL OUTER JOIN (SELECT account_id AS id, CASE WHEN account_id % 2 = 0 THEN 'renamed' END AS name,
                            arg_max(CAST(amount AS DOUBLE), id) AS balance FROM fx_transactions GROUP BY account_id) u ON t.id = u.id""")
def _(t):
    target = t.accounts.where("id % 3 <> 0").select(
        "id", "name", F.col("balance").cast("double").alias("balance"), F.lit("2024-01-01").alias("updated_at"))
    updates = t.transactions.select(
        F.col("account_id").alias("id"), F.when(F.col("account_id") % 2 == 0, "renamed").alias("name"),
        F.col("amount").cast("double").alias("balance"), F.col("id").alias("seq"))
    return changes.upsert(target, updates, "id", F.lit("2024-03-01"), order=["seq"])


@check("joi19_apply_categories", """
    SELECT t.id, CASE WHEN m.id IS NOT NULL AND m.confidence >= 0.5 THEN m.suggested ELSE t.category END AS category
    FROM fx_transactions t LEFT JOIN (
        SELECT l_orderkey AS id, max(l_discount * 10) AS confidence,
               arg_max('part ' || l_partkey, (l_discount * 10, 'part ' || l_partkey)) AS suggested
        FROM lineitem GROUP BY l_orderkey) m ON m.id = t.id""")
def _(t):
    mapping = t.table("lineitem").select(
        F.col("l_orderkey").alias("transaction_id"), (F.col("l_discount") * 10).alias("confidence"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("suggested_category"))
    return lg.apply_categories(t.transactions, mapping, 0.5).select("id", "category")

# --- balances and statements ----------------------------------------------------------------------

_SIGNED = "CASE WHEN type = 'debit' THEN amount ELSE -amount END"


@check("agg04_account_balance", f"""
    SELECT a.id AS account_id, round(CAST(coalesce(sum(t.amount), 0) AS DOUBLE), 2) AS raw_sum,
           round(CAST(coalesce(sum(CASE WHEN t.type = 'debit' THEN t.amount ELSE -t.amount END), 0) AS DOUBLE), 2) AS signed
    FROM fx_accounts a LEFT JOIN fx_transactions t ON t.account_id = a.id AND t.date <= DATE '1995-06-30' GROUP BY a.id""")
def _(t):
    found = lg.account_balance(t.accounts, t.transactions, "1995-06-30")
    return found.select("account_id", r2("raw_sum").alias("raw_sum"), r2("signed").alias("signed"))


@check("agg05_trial_balance", """
    SELECT account_id, round(CAST(debit AS DOUBLE), 2) AS debit, round(CAST(credit AS DOUBLE), 2) AS credit,
           round(CAST(debit - credit AS DOUBLE), 2) AS balance, debit = credit AS balanced FROM (
        SELECT account_id, coalesce(sum(amount) FILTER (WHERE type = 'debit'), 0) AS debit,
               coalesce(sum(amount) FILTER (WHERE type = 'credit'), 0) AS credit
        FROM fx_transactions WHERE date <= DATE '1998-12-31' GROUP BY ROLLUP (account_id)) t""")
def _(t):
    found = lg.trial_balance(t.transactions, "1998-12-31")
    return found.select("account_id", *[r2(c).alias(c) for c in ("debit", "credit", "balance")], "balanced")


@check("agg06_income_statement", """
    SELECT a.type AS account_type, t.category, round(CAST(sum(t.amount) AS DOUBLE), 2) AS amount,
           round(CAST(sum(CASE WHEN a.type = 'revenue' THEN t.amount ELSE -t.amount END) AS DOUBLE), 2) AS net
    FROM fx_transactions t JOIN fx_accounts a ON a.id = t.account_id
    WHERE a.type IN ('revenue', 'expense') AND t.date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'
    GROUP BY ROLLUP (a.type, t.category)""")
def _(t):
    found = lg.income_statement(t.accounts, t.transactions, "1996-01-01", "1996-12-31")
    return found.select("account_type", "category", r2("amount").alias("amount"), r2("net").alias("net"))


@check("agg07_balance_sheet", f"""
    SELECT a.type AS account_type, t.account_id, round(CAST(sum(CASE WHEN t.type = 'debit' THEN amount ELSE -amount END) AS DOUBLE), 2) AS balance
    FROM fx_transactions t JOIN fx_accounts a ON a.id = t.account_id
    WHERE a.type IN ('asset', 'liability', 'equity') AND t.date <= DATE '1999-12-31' GROUP BY ROLLUP (a.type, t.account_id)""")
def _(t):
    found = lg.balance_sheet(t.accounts, t.transactions, "1999-12-31")
    return found.select("account_type", "account_id", r2("balance").alias("balance"))


@check("agg08_cash_flow", """
    SELECT CAST(CAST(date_trunc('month', t.date) AS DATE) AS VARCHAR) AS period,
           round(CAST(coalesce(sum(t.amount) FILTER (WHERE t.type = 'debit'), 0) AS DOUBLE), 2) AS inflow,
           round(CAST(coalesce(sum(t.amount) FILTER (WHERE t.type = 'credit'), 0) AS DOUBLE), 2) AS outflow,
           round(CAST(sum(CASE WHEN t.type = 'debit' THEN t.amount ELSE -t.amount END) AS DOUBLE), 2) AS net
    FROM fx_transactions t JOIN fx_accounts a ON a.id = t.account_id
    WHERE a.type = 'asset' AND t.date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' GROUP BY 1""")
def _(t):
    found = lg.cash_flow(t.accounts, t.transactions, "1996-01-01", "1998-12-31")
    return found.select(F.col("period").cast("string").alias("period"), *[r2(c).alias(c) for c in ("inflow", "outflow", "net")])


@check("agg10_report_by_period", " UNION ALL ".join(f"""
    SELECT '{u}' AS unit, CAST(CAST(date_trunc('{u}', date) AS DATE) AS VARCHAR) AS period, type, count(*) AS n, round(CAST(sum(amount) AS DOUBLE), 2) AS amount
    FROM fx_transactions GROUP BY 2, type""" for u in ("month", "quarter", "year")))
def _(t):
    return lg.report_by_period(t.transactions).select("unit", F.col("period").cast("string").alias("period"), "type", "n", r2("amount").alias("amount"))


def _statement_sql(statement, unit, start, end):
    types, item, running = lg.STATEMENTS[statement]
    named = ", ".join(f"'{k}'" for k in types)
    item = "t.category" if item == "category" else "CAST(t.account_id AS VARCHAR)"
    balance = "credit - debit" if statement == "accounts_payable" else "debit - credit"
    shown = "WHERE balance > 0" if statement in ("accounts_receivable", "accounts_payable") else ""
    return f"""
    WITH t AS (
        SELECT a.type AS account_type, {item} AS item, date_trunc('{unit}', t.date) AS at,
               CASE WHEN t.type = 'debit' THEN amount ELSE 0 END AS d, CASE WHEN t.type = 'credit' THEN amount ELSE 0 END AS c
        FROM fx_transactions t JOIN fx_accounts a ON a.id = t.account_id
        WHERE a.type IN ({named}) AND t.date <= DATE '{end}' {"" if running else f"AND t.date >= DATE '{start}'"}),
    i AS (SELECT DISTINCT account_type, item FROM t),
    p AS (SELECT unnest(generate_series(date_trunc('{unit}', DATE '{start}'), date_trunc('{unit}', DATE '{end}'), INTERVAL 1 {unit})) AS period),
    s AS (
        SELECT p.period, i.account_type, i.item, coalesce(sum(d), 0) AS debit, coalesce(sum(c), 0) AS credit
        FROM p CROSS JOIN i LEFT JOIN t ON t.account_type = i.account_type AND t.item = i.item AND t.at {"<=" if running else "="} p.period
        GROUP BY ALL),
    b AS (SELECT *, {balance} AS balance FROM s)
    SELECT CAST(CAST(period AS DATE) AS VARCHAR) AS period, account_type, item, round(CAST(debit AS DOUBLE), 2) AS debit,
           round(CAST(credit AS DOUBLE), 2) AS credit, round(CAST(balance AS DOUBLE), 2) AS balance FROM b {shown}"""


def _statement(statement, unit, start, end):
    @check(f"agg10_{statement}_by_{unit}", _statement_sql(statement, unit, start, end))
    def run(t):
        found = lg.statement_by_period(t.accounts, t.transactions, statement, unit, start, end)
        return found.select(F.col("period").cast("string").alias("period"), "account_type", "item",
                            r2("debit").alias("debit"), r2("credit").alias("credit"), r2("balance").alias("balance"))


for _args in [("income_statement", "quarter", "1994-02-15", "1999-03-31"), ("cash_flow", "month", "1996-01-10", "1996-12-20"),
              ("balance_sheet", "quarter", "1996-05-01", "1998-11-15"), ("trial_balance", "year", "1993-01-01", "1998-06-30"),
              ("accounts_receivable", "month", "1997-01-01", "1997-12-31"), ("accounts_payable", "year", "1994-01-01", "2000-12-31")]:
    _statement(*_args)


@check("agg11_coa_rollup", """
    SELECT 'C' || c_custkey AS account_id, round(CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE), 2) AS balance FROM customer
    UNION ALL SELECT 'N' || n_nationkey, round(CAST(coalesce(sum(CAST(c_acctbal AS DECIMAL(18,2))), 0) AS DOUBLE), 2)
    FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey
    UNION ALL SELECT 'R' || r_regionkey, round(CAST(coalesce(sum(CAST(c_acctbal AS DECIMAL(18,2))), 0) AS DOUBLE), 2)
    FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_regionkey""")
def _(t):
    def node(table, kind, key, parent=None):
        up = F.concat(F.lit(parent[0]), F.col(parent[1])) if parent else F.lit(None).cast("string")
        return t.table(table).select(F.concat(F.lit(kind), F.col(key)).alias("id"), up.alias("parent_account_id"))
    accounts = node("customer", "C", "c_custkey", ("N", "c_nationkey")).union(
        node("nation", "N", "n_nationkey", ("R", "n_regionkey"))).union(node("region", "R", "r_regionkey"))
    own = t.table("customer").select(F.concat(F.lit("C"), "c_custkey").alias("account_id"),
                                     F.col("c_acctbal").cast("decimal(18,2)").alias("balance"))
    return lg.coa_rollup(accounts, own).select("account_id", r2("balance").alias("balance"))


@check("agg12_journal_balanced", """
    SELECT l_orderkey AS id, round(CAST(sum(p) AS DOUBLE), 2) AS debit, round(CAST(sum(c) AS DOUBLE), 2) AS credit, sum(p) = sum(c) AS balanced
    FROM (SELECT l_orderkey, CAST(l_extendedprice AS DECIMAL(18,2)) AS p,
                 CAST(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_extendedprice END AS DECIMAL(18,2)) AS c FROM lineitem) l
    GROUP BY l_orderkey""")
def _(t):
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    given = F.when(F.col("l_returnflag") == "R", 0).otherwise(F.col("l_extendedprice")).cast("decimal(18,2)")
    entry = lambda account, kind, amount: F.struct(account.alias("account_id"), F.lit(kind).alias("type"), amount.alias("amount"))
    entries = t.table("lineitem").select("l_orderkey", F.explode(F.array(
        entry(F.col("l_partkey"), "debit", price), entry(F.col("l_suppkey"), "credit", given))).alias("e"))
    journal = entries.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list("e").alias("entries"))
    return lg.journal_balanced(journal).select("id", r2("debit").alias("debit"), r2("credit").alias("credit"), "balanced")

# --- logs, commands, formats ----------------------------------------------------------------------

@check("agg16_command_stats", "SELECT user_id, count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS successful, "
    "count(*) FILTER (WHERE status = 'failed') AS failed, round(avg(execution_ms), 6) AS mean_ms, max(timestamp) AS last_at, "
    + ", ".join(f"count(*) FILTER (WHERE {c} = '{v}') AS {c}_{v}" for c, vs in [
        ("intent", [*vocab.COMMAND_INTENTS, "unknown"]), ("status", ["completed", "failed", "requires_clarification"])] for v in vs)
    + " FROM fx_commands GROUP BY user_id")
def _(t):
    found = lg.command_stats(t.commands, [*vocab.COMMAND_INTENTS, "unknown"], ["completed", "failed", "requires_clarification"])
    return found.withColumn("mean_ms", r6("mean_ms")).withColumn("last_at", plain_ts("last_at"))


@check("agg20_request_log_stats", """
    SELECT method, path, status, count(*) AS n, round(avg(CASE WHEN status >= 400 THEN 1.0 ELSE 0.0 END), 6) AS error_share,
           round(avg(duration_ms), 6) AS mean_ms, quantile_disc(duration_ms, 0.95) AS p95_ms FROM fx_log GROUP BY ALL""")
def _(t):
    found = lg.request_log_stats(t.log)
    return found.withColumn("error_share", r6("error_share")).withColumn("mean_ms", r6("mean_ms"))


@check("top10_command_history", """
    SELECT user_id, id, intent, timestamp FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, id DESC) AS r
    FROM fx_commands) c WHERE r <= 5""")
def _(t):
    top = fl.top_per(t.commands, ["user_id"], [F.col("timestamp").desc(), F.col("id").desc()], 5)
    return top.select("user_id", "id", "intent", plain_ts("timestamp").alias("timestamp"))


@check("top04_sort_by", "SELECT id, balance FROM (SELECT id, CAST(balance AS DOUBLE) AS balance FROM fx_accounts) a ORDER BY balance DESC, id")
def _(t):
    return fl.sort_by(t.accounts.select("id", F.col("balance").cast("double").alias("balance")), "balance", "desc", "id")


@check("top03_page_with_more", """
    SELECT id, CAST(date AS VARCHAR) AS date, (SELECT count(*) FROM fx_transactions) AS total, 3 AS page, (SELECT count(*) FROM fx_transactions) > 60 AS has_more
    FROM fx_transactions t ORDER BY t.date DESC, id LIMIT 20 OFFSET 40""")
def _(t):
    return fl.page_with_more(t.transactions.select("id", F.col("date").cast("string").alias("date")), [F.col("date").desc(), F.col("id")], page=3, limit=20)


@check("top03_deep_page", """
    SELECT id, CAST(date AS VARCHAR) AS date, (SELECT count(*) FROM fx_transactions) AS total, 41 AS page, (SELECT count(*) FROM fx_transactions) > 1025 AS has_more
    FROM fx_transactions t ORDER BY t.date DESC, id LIMIT 25 OFFSET 1000""")
def _(t):
    rows = t.transactions.select("id", F.col("date").cast("string").alias("date"))
    return fl.page_with_more(rows, [F.col("date").desc(), F.col("id")], page=41, limit=25, range_rows=300)


@check("top08_upcoming_events", """
    SELECT id, timestamp, intent FROM fx_commands WHERE timestamp >= TIMESTAMP '2024-01-10' AND timestamp <= TIMESTAMP '2024-01-17'
    ORDER BY timestamp, id LIMIT 10""")
def _(t):
    start = F.lit("2024-01-10").cast("timestamp")
    found = fl.upcoming(t.commands, "timestamp", start, start + F.expr("INTERVAL 7 DAYS"), "id")
    return found.select("id", plain_ts("timestamp").alias("timestamp"), "intent")
