"""Nested ledger JSON to flat rows and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyweave import schemas


def _parsed(df: DataFrame, column: str, schema: str, *keep: str) -> DataFrame:
    return df.select(*keep, F.from_json(F.col(column), schema).alias("j"))


def number(c) -> Column:
    return F.expr(f"try_cast({c} AS double)") if isinstance(c, str) else c.try_cast("double")


def normalize_accounts(df: DataFrame, column: str = "json") -> DataFrame:
    return _parsed(df, column, schemas.EXTERNAL_ACCOUNT).select(
        F.col("j.Id").alias("id"), F.col("j.Name").alias("name"), F.lower("j.AccountType").alias("type"),
        number("j.CurrentBalance").alias("balance"),
        F.coalesce(F.nullif(F.col("j.CurrencyRef.value"), F.lit("")), F.lit("USD")).alias("currency"),
        F.col("j.MetaData.CreateTime").alias("created_at"), F.col("j.MetaData.LastUpdatedTime").alias("updated_at"),
    )


def normalize_transactions(df: DataFrame, column: str = "json") -> DataFrame:
    return _parsed(df, column, schemas.EXTERNAL_TRANSACTION).select(
        F.col("j.Id").alias("id"), F.lower("j.TransactionType").alias("type"), number("j.Amount").alias("amount"),
        F.col("j.Description").alias("description"), F.col("j.AccountRef.name").alias("category"),
        F.col("j.TxnDate").alias("date"), F.col("j.AccountRef.value").alias("account_id"),
        F.coalesce(F.nullif(F.lower("j.status"), F.lit("")), F.lit("completed")).alias("status"),
        F.col("j.MetaData.CreateTime").alias("created_at"), F.col("j.MetaData.LastUpdatedTime").alias("updated_at"),
    )


def normalize_budgets(df: DataFrame, column: str = "json") -> DataFrame:
    items = F.transform("j.BudgetDetail", lambda d: F.struct(
        d["AccountRef"]["name"].alias("category"), d["Amount"].try_cast("double").alias("amount"),
        d["ActualAmount"].try_cast("double").alias("actual"),
    ))
    return _parsed(df, column, schemas.EXTERNAL_BUDGET).select(
        F.col("j.Id").alias("id"), F.col("j.Name").alias("name"),
        F.struct(F.col("j.StartDate").alias("start"), F.col("j.EndDate").alias("end")).alias("period"),
        items.alias("items"),
        F.col("j.MetaData.CreateTime").alias("created_at"), F.col("j.MetaData.LastUpdatedTime").alias("updated_at"),
    )


def denormalize_accounts(df: DataFrame) -> DataFrame:
    body = F.struct(
        F.col("name").alias("Name"), F.upper("type").alias("AccountType"),
        F.struct(F.col("currency").alias("value")).alias("CurrencyRef"),
    )
    return df.select("id", F.to_json(body).alias("json"))


def denormalize_transactions(df: DataFrame) -> DataFrame:
    body = F.struct(
        F.upper("type").alias("TransactionType"), F.col("amount").alias("Amount"),
        F.col("description").alias("Description"),
        F.struct(F.col("account_id").alias("value"), F.col("category").alias("name")).alias("AccountRef"),
        F.col("date").alias("TxnDate"),
    )
    return df.select("id", F.to_json(body).alias("json"))


def denormalize_budgets(df: DataFrame) -> DataFrame:
    detail = F.transform("items", lambda i: F.struct(
        F.struct(i["category"].alias("name")).alias("AccountRef"), i["amount"].alias("Amount")))
    body = F.struct(
        F.col("name").alias("Name"), F.col("period.start").alias("StartDate"), F.col("period.end").alias("EndDate"),
        detail.alias("BudgetDetail"),
    )
    return df.select("id", F.to_json(body).alias("json"))


def flatten_report(df: DataFrame, column: str = "json", *keep: str) -> DataFrame:
    """One row per report cell: section, row inside the section and column, all 0-based; a section without
    rows keeps one row with NULLs."""
    sections = _parsed(df, column, schemas.EXTERNAL_REPORT, *keep).select(
        *keep, F.col("j.Header.ReportName").alias("report"), F.posexplode_outer("j.Rows").alias("section", "s"))
    rows = sections.select(
        *keep, "report", "section", F.to_json("s.Header").alias("section_header"),
        F.posexplode_outer("s.Rows").alias("row", "r"))
    return rows.select(
        *keep, "report", "section", "section_header", "row", F.posexplode_outer("r.ColData").alias("column", "cell"),
    ).select(*keep, "report", "section", "section_header", "row", "column", F.col("cell.value").alias("value"))
