"""Market-wide and per-symbol aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bourselake.functions import labels
from bourselake.functions import numbers as num
from bourselake.functions.provenance import tier_of
from bourselake.operators.asof import closes_at
from bourselake.operators.lookups import newest_per_key
from bourselake.operators.skew import salted_join


def market_breadth(prices: DataFrame) -> DataFrame:
    """Advancing, declining and unchanged symbols per day, counted only where yesterday's close is known."""
    close, ycp = F.col("close"), F.col("ycp")
    return prices.groupBy("date").agg(
        F.count_if(close > ycp).alias("advancing"),
        F.count_if(close < ycp).alias("declining"),
        F.count_if(close == ycp).alias("unchanged"),
        F.coalesce(F.sum("volume"), F.lit(0)).alias("total_volume"),
        F.coalesce(F.sum("trades"), F.lit(0)).alias("total_trades"),
        F.count(F.lit(1)).alias("issues"),
    )


def symbol_history_stats(prices: DataFrame) -> DataFrame:
    return prices.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("sessions"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.max("close").alias("ath_price"), F.min("close").alias("atl_price"),
    )


def source_distribution(df: DataFrame) -> DataFrame:
    """Rows per source with its tier; an unknown source has no tier."""
    return df.groupBy("source").agg(F.count(F.lit(1)).alias("rows")).withColumn("tier", tier_of(F.col("source")))


def revenue_totals(payments: DataFrame) -> DataFrame:
    return payments.filter(F.col("status") == "SUCCESS").agg(
        F.count(F.lit(1)).alias("success_count"), F.coalesce(F.sum("amount_bdt"), F.lit(0)).alias("total_bdt")
    )


def revenue_by_day(payments: DataFrame, *, as_of, days: int = 90) -> DataFrame:
    since = F.date_sub(F.lit(as_of).cast("date"), days)
    ok = payments.filter((F.col("status") == "SUCCESS") & (F.col("created_at") >= since))
    return ok.groupBy(F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("count"), F.sum("amount_bdt").alias("bdt"))


def revenue_by_plan(payments: DataFrame) -> DataFrame:
    ok = payments.filter(F.col("status") == "SUCCESS")
    return ok.groupBy("plan").agg(F.count(F.lit(1)).alias("count"), F.sum("amount_bdt").alias("bdt"))


def promo_redemption_counts(promos: DataFrame, redemptions: DataFrame) -> DataFrame:
    counts = redemptions.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return promos.join(counts, "code", "left").select("code", F.coalesce("n", F.lit(0)).alias("redemption_count"))


def table_row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows) of several tables in one plan."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def all_time_high_low(prices: DataFrame, digits: int | None = 2) -> DataFrame:
    """First day of the highest and the lowest close, and how far the latest close is from each."""
    p = prices.filter(F.col("close") > 0)
    # min_by keeps the earliest day among equal extremes through the (value, day) order.
    g = p.groupBy("symbol").agg(
        F.max("close").alias("ath_price"),
        F.min_by("date", F.struct((-F.col("close")).alias("c"), F.col("date"))).alias("ath_date"),
        F.min("close").alias("atl_price"),
        F.min_by("date", F.struct(F.col("close").alias("c"), F.col("date"))).alias("atl_date"),
        F.max_by("close", "date").alias("close"),
    )
    off = lambda ref: num.rounded((F.col("close") - ref) / ref * 100.0, digits)
    return g.withColumn("drawdown_pct", off(F.col("ath_price"))).withColumn("rise_pct", off(F.col("atl_price")))


def pe_sample(daily: DataFrame, statements: DataFrame, *, upper: float = 120.0) -> DataFrame:
    """(symbol, pe): daily and annual P/E values inside the plausible range."""
    both = daily.select("symbol", F.col("pe")).unionByName(statements.select("symbol", F.col("pe_ratio").alias("pe")))
    return both.filter((F.col("pe") > 0) & (F.col("pe") < upper))


def percentile_floor(sample: DataFrame, value: str = "pe", key: str = "symbol", digits: int | None = 2) -> DataFrame:
    """Quartiles taken at the zero-based position floor(n * p) of the sorted sample.

    Equal values collapse to counts on the map side first, so copies of a record never meet in a window.
    """
    counts = sample.groupBy(key, value).agg(F.count(F.lit(1)).alias("c"))
    w = W.partitionBy(key)
    up_to = w.orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    ranked = counts.select(key, value, F.sum("c").over(up_to).alias("upto"), F.sum("c").over(w).alias("n"))
    at = lambda p: F.min(F.when(F.col("upto") > F.floor(F.col("n") * F.lit(p)), F.col(value)))
    q = ranked.groupBy(key).agg(at(0.25).alias("p25"), at(0.5).alias("median"), at(0.75).alias("p75"), F.max("n").alias("sample_size"))
    return q.select(key, *[num.rounded(F.col(c), digits).alias(c) for c in ("p25", "median", "p75")], "sample_size")


def pe_percentile_rank(sample: DataFrame, current: DataFrame) -> DataFrame:
    """Share of the sample below the current P/E, in whole percent."""
    counts = sample.groupBy("symbol", "pe").agg(F.count(F.lit(1)).alias("c"))
    j = counts.join(current.select("symbol", "current_pe").filter(F.col("current_pe").isNotNull()), "symbol")
    below = F.coalesce(F.sum(F.when(F.col("pe") < F.col("current_pe"), F.col("c"))), F.lit(0))
    return j.groupBy("symbol").agg(F.floor(below.cast("double") / F.sum("c") * 100.0 + 0.5).alias("pe_percentile_rank"))


def liquidity_profile(prices: DataFrame, sessions: int = 90, digits: int | None = 2) -> DataFrame:
    """Average volume and value over the newest sessions, with a plain label."""
    recent = newest_per_key(prices.select("symbol", "date", "volume", "value_mn"), "symbol", "date", sessions)
    g = recent.groupBy("symbol").agg(
        F.sum("volume").alias("sv"), F.count("volume").alias("nv"), F.sum("value_mn").alias("sm"), F.count("value_mn").alias("nm")
    )
    avg_value = num.ratio_or_null(F.col("sm"), F.col("nm"))
    return g.select(
        "symbol",
        F.floor(num.ratio_or_null(F.col("sv").cast("double"), F.col("nv")) + 0.5).alias("avg_daily_volume"),
        num.rounded(avg_value, digits).alias("avg_daily_value_mn"),
        labels.liquidity_class(avg_value).alias("classification"),
    )


def sector_performance(roster: DataFrame, prices: DataFrame, *, as_of, days: int | None) -> DataFrame:
    """Return of a symbol over a window against the equal-weight mean of its sector peers, itself left out.

    Peers are summed per sector with partial sums and joined back by salt, so one large sector never sits in one task. Returns
    have two decimals; summing them as whole hundredths makes the mean independent of order.
    """
    start = F.min_by("close", "date") if days is None else None
    if days is None:
        ends = prices.groupBy("symbol").agg(F.max_by("close", "date").alias("latest"), start.alias("base"))
    else:
        reached = F.col("date") <= F.date_sub(F.lit(as_of).cast("date"), days)
        ends = prices.groupBy("symbol").agg(
            F.max_by("close", "date").alias("latest"), F.max_by("close", F.when(reached, F.col("date"))).alias("base")
        )
    ret = F.when(F.col("base") > 0, num.to_fixed((F.col("latest") - F.col("base")) / F.col("base") * 100.0, 2))
    members = roster.filter(F.col("sector").isNotNull()).select("symbol", "sector")
    own = members.join(ends, "symbol", "left").select("symbol", "sector", ret.alias("stock_return"))
    hundredths = F.rint(F.col("stock_return") * 100.0).cast("long")
    per_sector = own.groupBy("sector").agg(F.sum(hundredths).alias("total"), F.count("stock_return").alias("n"))
    peers = F.col("n") - F.col("stock_return").isNotNull().cast("int")
    rest = F.coalesce("total", F.lit(0)) - F.coalesce(hundredths, F.lit(0))
    return salted_join(own, per_sector, "sector", "symbol").select(
        "symbol", "sector", "stock_return",
        F.when(peers > 0, num.to_fixed(rest.cast("double") / 100.0 / peers, 2)).alias("sector_avg_return"),
        peers.alias("peer_count"),
    )


def growth_cagr(statements: DataFrame, field: str, digits: int | None = 2) -> DataFrame:
    """Growth between the earliest and latest year with a positive value; a loss year is never an end point."""
    ok = statements.filter(F.col(field) > 0)
    g = ok.groupBy("symbol").agg(
        F.min("fiscal_year").alias("from_year"), F.max("fiscal_year").alias("to_year"),
        F.min_by(field, "fiscal_year").alias("from_value"), F.max_by(field, "fiscal_year").alias("to_value"),
    )
    span = (F.col("to_year") - F.col("from_year")).cast("double")
    return g.filter(span > 0).withColumn("cagr_pct", num.cagr_pct(F.col("from_value"), F.col("to_value"), span, digits))


def volume_velocity(prices: DataFrame, recent: int = 5, baseline: int = 20, digits: int | None = 2) -> DataFrame:
    """Mean volume of the newest sessions over the mean of the sessions before them."""
    rows = prices.select("symbol", "date", "volume").filter(F.col("volume").isNotNull())
    w = W.partitionBy("symbol").orderBy(F.desc("date"))
    r = rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= recent + baseline)
    fresh = F.avg(F.when(F.col("rn") <= recent, F.col("volume")))
    base = F.avg(F.when(F.col("rn") > recent, F.col("volume")))
    return r.groupBy("symbol").agg(fresh.alias("f"), base.alias("b")).select(
        "symbol", num.rounded(num.ratio_or_null(F.col("f"), F.col("b")), digits).alias("volume_velocity")
    )


def lookback_closes(prices: DataFrame, as_of, offsets: dict[str, int]) -> DataFrame:
    """Last close on or before each calendar-day offset, per symbol."""
    import datetime as dt

    return closes_at(prices, {k: as_of - dt.timedelta(days=d) for k, d in offsets.items()})


def stratified_sample(roster: DataFrame, n: int) -> DataFrame:
    """The first ``n`` active symbols in sector order."""
    active = roster.filter(F.col("is_active") & F.col("sector").isNotNull())
    return active.select("symbol", "name", "sector", "category").orderBy("sector", "symbol").limit(n)
