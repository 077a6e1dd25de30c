"""CSV exports. Rows are range-partitioned and sorted, so every part file holds one slice of the whole order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bourselake.operators.lookups import latest_fundamentals

# Columns of the published files, in their order.
PRICE_COLUMNS = ("symbol", "date", "open", "high", "low", "close", "ycp", "change", "change_percent", "volume", "value_mn", "pe")
INDEX_COLUMNS = ("date", "index_value", "advancing", "declining", "unchanged", "total_trades", "total_volume", "total_value_mn")
STATEMENT_COLUMNS = (
    "symbol", "fiscal_year", "period", "eps_basic", "nav_per_share", "roe", "dividend_yield", "paid_up_capital_mn",
    "authorized_capital_mn", "pe_ratio", "debt_to_equity", "current_ratio", "audit_status",
)
LATEST_COLUMNS = (
    "symbol", "name", "sector", "category", "eps_basic", "eps_diluted", "nav_per_share", "paid_up_capital_mn", "authorized_capital_mn",
    "debt_to_equity", "current_ratio", "fiscal_year", "period", "audit_status",
)


def write_csv(df: DataFrame, path: str, *, quote_all: bool = False) -> None:
    """One header per part file; an unknown value is an empty cell."""
    writer = df.write.mode("errorifexists").option("header", True).option("nullValue", "").option("emptyValue", "")
    writer.option("quoteAll", quote_all).option("escape", '"').csv(path)


def price_export_rows(prices: DataFrame) -> DataFrame:
    return prices.select(*PRICE_COLUMNS).orderBy("symbol", "date")


def index_export_rows(index: DataFrame) -> DataFrame:
    return index.select(*INDEX_COLUMNS).orderBy("date")


def latest_fundamentals_export_rows(fundamentals: DataFrame, roster: DataFrame) -> DataFrame:
    return latest_fundamentals(fundamentals, roster).select(*LATEST_COLUMNS).orderBy("symbol")


def statement_export_rows(statements: DataFrame) -> DataFrame:
    return statements.select(*STATEMENT_COLUMNS).orderBy("symbol", F.desc("fiscal_year"))


def export_prices_csv(prices: DataFrame, path: str) -> None:
    write_csv(price_export_rows(prices), path)


def export_index_csv(index: DataFrame, path: str) -> None:
    write_csv(index_export_rows(index), path)


def export_latest_fundamentals_csv(fundamentals: DataFrame, roster: DataFrame, path: str) -> None:
    write_csv(latest_fundamentals_export_rows(fundamentals, roster), path)


def export_statements_csv(statements: DataFrame, path: str) -> None:
    write_csv(statement_export_rows(statements), path)


def export_quoted_csv(df: DataFrame, path: str) -> None:
    """Users and payments: every cell quoted, embedded quotes doubled."""
    write_csv(df, path, quote_all=True)


def write_mismatches_csv(mismatches: DataFrame, path: str) -> None:
    write_csv(mismatches, path)
