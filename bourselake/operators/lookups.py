"""Latest-row lookups, the stock screen, timelines and refresh windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bourselake.functions import labels
from bourselake.functions import numbers as num
from bourselake.functions.provenance import tier_of

ROSTER_FIELDS = ("name", "sector", "category", "face_value")
PRICE_FIELDS = ("close", "ycp", "change", "change_percent", "volume", "pe")

# Columns that never leave the store, and the five disclosure columns of the paid plan.
INTERNAL_FIELDS = ("source", "tier")


def latest_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the highest ``order`` per key, reduced on the map side before the shuffle."""
    cols = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("_best"))
    return best.select(key, "_best.*")


def latest_fundamentals(fundamentals: DataFrame, roster: DataFrame) -> DataFrame:
    """Latest fiscal year per symbol with name, sector, category and face value of the roster."""
    latest = latest_by(fundamentals, "symbol", "fiscal_year")
    return latest.join(roster.select("symbol", *ROSTER_FIELDS), "symbol", "left")


def latest_price(prices: DataFrame) -> DataFrame:
    """Latest session per symbol. One numeric ``max_by`` per column keeps the aggregation in hash tables."""
    return prices.groupBy("symbol").agg(
        F.max("date").alias("date"), *[F.max_by(c, "date").alias(c) for c in PRICE_FIELDS]
    )


def stock_screen(fundamentals: DataFrame, roster: DataFrame, prices: DataFrame, digits: int | None = 2) -> DataFrame:
    """One row per symbol with statements: latest year, latest session and the ratios that follow from them."""
    f = latest_fundamentals(fundamentals, roster)
    p = latest_price(prices)
    s = f.join(p, "symbol", "left")
    ltp, ycp, eps, nav = F.col("close"), F.col("ycp"), F.col("eps_basic"), F.col("nav_per_share")
    daily_pe = F.when((ltp != 0) & (eps > 0), num.rounded(ltp / eps, digits)).otherwise(F.col("pe"))
    audited_pe = F.when((ycp != 0) & (eps > 0), num.rounded(ycp / eps, digits)).otherwise(daily_pe)
    face = F.col("face_value")
    change = F.coalesce(num.change_abs(ltp, ycp, digits=digits), F.col("change"))
    pct = F.coalesce(num.change_pct(ltp, ycp, digits=digits), F.col("change_percent"))
    return s.select(
        "symbol", "name", "sector", "category",
        eps.alias("eps"), "eps_diluted", "nav_per_share", "paid_up_capital_mn", "authorized_capital_mn", "dividend_yield",
        "fiscal_year", "face_value",
        F.col("date").alias("close_date"), ltp.alias("ltp"), "ycp",
        change.alias("change"), pct.alias("change_percent"), pct.alias("momentum"), "volume",
        daily_pe.alias("daily_pe"), audited_pe.alias("audited_pe"),
        F.when(nav > 0, num.rounded(eps / nav * 100.0, digits)).alias("roe"),
        F.when(face > 0, num.rounded(F.col("paid_up_capital_mn") / face * ltp, digits)).alias("market_cap"),
        "debt_to_equity", "current_ratio",
        labels.audited_period(F.col("fiscal_year"), F.col("period")).alias("audited_period"),
    )


def newest_per_key(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The newest ``n`` rows per key; Spark applies the limit on the map side before the shuffle."""
    w = W.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def one_row_per_day(prices: DataFrame, seq: str, keys: tuple[str, ...] = ("symbol", "date")) -> DataFrame:
    """Collapse repeated records of a key to the one with the highest ``seq``."""
    cols = [c for c in prices.columns if c not in keys]
    best = prices.groupBy(*keys).agg(F.max_by(F.struct(*cols), seq).alias("_best"))
    return best.select(*keys, "_best.*")


def price_timeline(prices: DataFrame, limit: int | None = None, symbol: str | None = None, seq: str | None = None) -> DataFrame:
    """All days of each symbol, or its newest ``limit`` ones, oldest first; one row per calendar day."""
    p = prices if symbol is None else prices.filter(F.col("symbol") == symbol)
    p = p if seq is None else one_row_per_day(p, seq)
    rows = p.select("symbol", "date", *PRICE_FIELDS)
    rows = rows if limit is None else newest_per_key(rows, "symbol", "date", limit)
    return rows.withColumnRenamed("close", "ltp").orderBy("symbol", "date")


def index_timeline(index: DataFrame, limit: int | None = None) -> DataFrame:
    """All index days with the tier of their source. A ``limit`` keeps the oldest days, as users of a limited timeline have always received it."""
    rows = index.select("date", "index_value", "advancing", "declining", "unchanged", "total_value_mn", "total_volume", "source").orderBy("date")
    rows = rows if limit is None else rows.limit(limit)
    return rows.withColumn("tier", tier_of(F.col("source")))


def statement_history(fundamentals: DataFrame, symbol: str | None = None) -> DataFrame:
    """All statements, newest year first per symbol."""
    f = fundamentals if symbol is None else fundamentals.filter(F.col("symbol") == symbol)
    return f.select(
        "symbol", F.col("fiscal_year").alias("year"), "period", F.col("eps_basic").alias("eps"),
        F.col("nav_per_share").alias("navps"), "roe", "dividend_yield", "dps", F.col("pe_ratio").alias("pe"),
        "debt_to_equity", "current_ratio", "paid_up_capital_mn", "audit_status",
    ).orderBy("symbol", F.desc("year"))


HOLDERS = ("sponsor", "govt", "institute", "foreign", "public")


def shareholding_view(shareholding: DataFrame) -> DataFrame:
    """Current and previous disclosure as two structs; no previous day means no previous struct."""
    current = F.struct(*[F.col(f"{h}_pct") for h in HOLDERS], "as_of_date")
    previous = F.struct(*[F.col(f"prev_{h}_pct").alias(f"{h}_pct") for h in HOLDERS], F.col("prev_as_of_date").alias("as_of_date"))
    return shareholding.select(
        "symbol", current.alias("current"), F.when(F.col("prev_as_of_date").isNotNull(), previous).alias("previous")
    )


def strip_internal(df: DataFrame) -> DataFrame:
    """Drop provenance columns before rows leave the store."""
    return df.drop(*INTERNAL_FIELDS)


def narrow_window(roster: DataFrame, prices: DataFrame, *, cutoff, until, lookback_days: int = 3) -> DataFrame:
    """Where the next fetch of each symbol starts; symbols already at ``until`` are left out."""
    last = prices.groupBy("symbol").agg(F.max("date").alias("last_date"))
    start = F.greatest(F.lit(cutoff).cast("date"), F.date_sub("last_date", lookback_days))
    return (
        roster.select("symbol")
        .join(last, "symbol", "left")
        .filter(F.col("last_date").isNull() | (F.col("last_date") < F.lit(until).cast("date")))
        .select("symbol", "last_date", F.coalesce(start, F.lit(cutoff).cast("date")).alias("start_date"))
    )


def index_gap_candidates(prices: DataFrame, index: DataFrame, official: DataFrame) -> DataFrame:
    """Official index rows for trading days after the last stored index day; nothing is interpolated."""
    last_day = index.agg(F.max("date")).first()[0]
    open_days = prices.filter(F.col("date") > F.lit(last_day)).select("date").distinct()
    return official.join(open_days, "date", "left_semi")


def resume_targets(targets: DataFrame, done: DataFrame, key: str = "symbol") -> DataFrame:
    """Targets that have no stored details yet."""
    return targets.join(done.select(key).distinct(), key, "left_anti")


def peers_by_sector(statements: DataFrame, roster: DataFrame) -> DataFrame:
    """Statements with a positive P/E and the sector of their symbol."""
    with_sector = roster.filter(F.col("sector").isNotNull()).select("symbol", "sector")
    return statements.filter(F.col("pe_ratio") > 0).select("symbol", "fiscal_year", "pe_ratio").join(with_sector, "symbol")


def with_index_level(prices: DataFrame, index: DataFrame) -> DataFrame:
    """Price timeline with the index level of the same day; a missing day stays null."""
    return prices.select("symbol", "date", F.col("close").alias("price"), "volume", "pe").join(level_per_day(index), "date", "left")


def level_per_day(index: DataFrame) -> DataFrame:
    """(date, index_value), one row per day whatever the index frame holds, so a century is 36 525 rows and may be broadcast.

    Where a day has several levels the highest counts."""
    return F.broadcast(index.groupBy("date").agg(F.max("index_value").alias("index_value")))
