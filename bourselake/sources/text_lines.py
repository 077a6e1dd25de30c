"""Facts out of running text and labelled statement lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bourselake.functions import numbers as num

# Patterns of tick lines and disclosure sentences, words that mark a readable statement, line labels.
TICK = r"([A-Z0-9_-]{2,16})\s+([\d.]+)\s+([+-]?[\d.]+)\s+([+-]?[\d.]+)%"
BASIC_EPS = r"(?i)Basic EPS\s*(?:Tk\.?)?\s*(-?\d+\.?\d*)"
NAV_PER_SHARE = r"(?i)NAV per share\s*(?:Tk\.?)?\s*(-?\d+\.?\d*)"
STATEMENT_WORDS = r"(?i)(revenue|total assets|total liabilities|gross profit|net profit|cash flow|earnings per share|shareholders)"
LINE_LABELS = {
    "revenue_mn": r"(?i)^\s*revenue",
    "gross_profit_mn": r"(?i)gross profit",
    "total_assets_mn": r"(?i)^\s*total assets",
    "total_liabilities_mn": r"(?i)^\s*total liabilities",
    "capex_mn": r"(?i)(purchase|acquisition) of property",
    "operating_cash_flow_mn": r"(?i)cash flows? from operating",
}


def extract_tick_rows(texts: DataFrame, order: str) -> DataFrame:
    """One tick per text row that holds one; the first tick of a symbol wins."""
    g = [F.regexp_extract("text", TICK, i) for i in range(1, 5)]
    t = texts.filter(g[0] != "").select(
        F.col(order).alias("_o"), g[0].alias("symbol"), g[1].try_cast("double").alias("ltp"), g[2].try_cast("double").alias("change"), g[3].try_cast("double").alias("change_percent")
    )
    first = t.filter(F.col("ltp") > 0).groupBy("symbol").agg(*[F.min_by(c, "_o").alias(c) for c in ("ltp", "change", "change_percent")])
    return first


def extract_disclosure_prose(texts: DataFrame, key: str, order: str) -> DataFrame:
    """Earnings and net assets per share from sentences; the first sentence of a company that has one counts."""
    value = lambda p: F.regexp_extract("text", p, 1).try_cast("double")
    says = lambda words, v: F.when(F.col("text").contains(words) & F.col("text").contains("Tk."), v)
    t = texts.select(key, order, says("Basic EPS", value(BASIC_EPS)).alias("e"), says("NAV per share", value(NAV_PER_SHARE)).alias("n"))
    g = t.groupBy(key).agg(
        F.min_by("e", F.when(F.col("e").isNotNull(), F.col(order))).alias("eps_basic"), F.min_by("n", F.when(F.col("n").isNotNull(), F.col(order))).alias("nav_per_share")
    )
    return g.filter(F.col("eps_basic").isNotNull())


def prose_where_missing(table_values: DataFrame, prose: DataFrame, key: str) -> DataFrame:
    """Table values win; prose fills companies whose table gave nothing."""
    p = prose.select(key, F.col("eps_basic").alias("_e"), F.col("nav_per_share").alias("_n"))
    empty = F.col("eps_basic").isNull() & F.col("nav_per_share").isNull()
    j = table_values.select(key, "eps_basic", "nav_per_share").join(p, key, "full_outer")
    return j.select(
        key, F.when(empty, F.col("_e")).otherwise(F.col("eps_basic")).alias("eps_basic"), F.when(empty, F.col("_n")).otherwise(F.col("nav_per_share")).alias("nav_per_share")
    )


def content_mode(text: Column) -> Column:
    """EMPTY, DIGITAL_VECTOR (readable statement text) or SCANNED_IMAGE (text without statement words)."""
    blank = F.coalesce(F.regexp_replace(text, r"\s+", ""), F.lit("")) == ""
    return F.when(blank, "EMPTY").when(text.rlike(STATEMENT_WORDS), "DIGITAL_VECTOR").otherwise("SCANNED_IMAGE")


def statement_lines_to_columns(lines: DataFrame, *key: str) -> DataFrame:
    """Labelled lines (label, value text) to one row per statement; free cash flow follows where both parts are known."""
    v = num.num_or_null(F.col("value"))
    g = lines.groupBy(*key).agg(*[F.max(F.when(F.col("label").rlike(p), v)).alias(n) for n, p in LINE_LABELS.items()])
    return g.withColumn("free_cash_flow_mn", num.to_fixed(F.col("operating_cash_flow_mn") - F.col("capex_mn")))
