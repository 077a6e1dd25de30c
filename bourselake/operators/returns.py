"""Returns, growth and risk of a price series."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bourselake.functions import numbers as num
from bourselake.operators.lookups import level_per_day
from bourselake.functions.dates import add_years, year_span
from bourselake.operators.asof import closes_at
from bourselake.operators.indicators import max_drawdown
from bourselake.operators.lookups import level_per_day

# Look-back distances in calendar days.
LOOKBACK_DAYS = {
    "1d": 1, "1w": 7, "1m": 30, "3m": 91, "6m": 182, "1y": 365, "3y": 1095, "5y": 1825, "10y": 3650, "20y": 7300,
}
SESSIONS_PER_YEAR = 252.0


def lookback_returns(prices: DataFrame, as_of: dt.date, digits: int | None = 2) -> DataFrame:
    """Price and return per look-back distance, and growth per year over 3, 5 and 10 years; one pass over prices."""
    days = {f"price_{k}_ago": as_of - dt.timedelta(days=d) for k, d in LOOKBACK_DAYS.items()}
    last = prices.groupBy("symbol").agg(F.max_by("close", "date").alias("last_close"), F.count(F.lit(1)).alias("_n"), *[
        F.max_by("close", F.when(F.col("date") <= F.lit(d), F.col("date"))).alias(n) for n, d in days.items()
    ])
    last = last.filter(F.col("_n") >= 2)
    ret = {f"return_{k}": F.when(F.col(f"price_{k}_ago") > 0, (F.col("last_close") / F.col(f"price_{k}_ago") - 1.0) * 100.0) for k in LOOKBACK_DAYS}
    growth = {f"cagr_{y}y": num.cagr_pct(F.col(f"price_{y}y_ago"), F.col("last_close"), F.lit(float(y)), None) for y in (3, 5, 10)}
    return num.with_rounded(last, ret | growth, digits).select("symbol", "last_close", *days, *ret, *growth)


def log_volatility(prices: DataFrame, digits: int | None = 2) -> DataFrame:
    """Annualised sample deviation of log returns, in percent."""
    prev = F.lag("close").over(W.partitionBy("symbol").orderBy("date"))
    p = prices.select("symbol", "close", prev.alias("prev")).filter(F.col("prev") > 0)
    g = p.groupBy("symbol").agg(F.stddev_samp(F.ln(F.col("close") / F.col("prev"))).alias("sd"), F.count(F.lit(1)).alias("n"))
    vol = F.sqrt(F.col("sd") * F.col("sd") * SESSIONS_PER_YEAR) * 100.0
    return g.filter(F.col("n") >= 2).select("symbol", num.rounded(vol, digits).alias("volatility_ann"))


def sharpe_1y(returns: DataFrame, volatility: DataFrame, risk_free: float = 0.04, digits: int | None = 3) -> DataFrame:
    s = returns.select("symbol", "return_1y").join(volatility, "symbol")
    value = F.when(F.col("volatility_ann") > 0, num.rounded((F.col("return_1y") - risk_free * 100.0) / F.col("volatility_ann"), digits))
    return s.select("symbol", value.alias("sharpe_ratio"))


def performance_summary(prices: DataFrame, as_of: dt.date, risk_free: float = 0.04) -> DataFrame:
    """Look-back returns, growth, volatility, drawdown, Sharpe ratio and 52-week range of every symbol."""
    r = lookback_returns(prices, as_of)
    v = log_volatility(prices)
    recent = prices.filter(F.col("date") >= F.lit(as_of - dt.timedelta(days=365)))
    span = recent.groupBy("symbol").agg(F.max("close").alias("week52_high"), F.min("close").alias("week52_low"))
    out = r.join(v, "symbol", "left").join(max_drawdown(prices).select("symbol", "max_drawdown_pct"), "symbol", "left")
    out = out.join(sharpe_1y(r, v, risk_free), "symbol", "left").join(span, "symbol", "left")
    return out


def risk_metrics(prices: DataFrame, index: DataFrame, *, risk_free_pct: float = 11.5, min_pairs: int = 30, digits: int | None = 2) -> DataFrame:
    """Volatility, beta against the index and a Sharpe-style ratio over the whole series.

    The index folds to one row per day before it is broadcast.
    Beta uses only days on which both series have a return.
    """
    w = W.partitionBy("symbol").orderBy("date")
    p = prices.select("symbol", "date", "close").join(level_per_day(index), "date", "left")
    p = p.select(
        "symbol", "date", "close", "index_value", F.lag("close").over(w).alias("p0"), F.lag("index_value").over(w).alias("i0")
    )
    ok = (F.col("p0") > 0) & (F.col("close") > 0)
    r = F.when(ok, (F.col("close") - F.col("p0")) / F.col("p0"))
    ir = F.when(ok & (F.col("i0") > 0) & (F.col("index_value") != 0), (F.col("index_value") - F.col("i0")) / F.col("i0"))
    q = p.withColumn("r", r).withColumn("ir", ir)
    rp = F.when(F.col("ir").isNotNull(), F.col("r"))
    g = q.groupBy("symbol").agg(
        F.count("r").alias("n"), F.stddev_pop("r").alias("sd"), F.count("ir").alias("pairs"),
        F.covar_pop(rp, F.col("ir")).alias("cov"), F.var_pop("ir").alias("ivar"),
        F.min_by("close", "date").alias("first"), F.max_by("close", "date").alias("last"),
        F.min("date").alias("d0"), F.max("date").alias("d1"),
    )
    vol = F.when(F.col("n") >= min_pairs, F.col("sd") * (SESSIONS_PER_YEAR**0.5) * 100.0)
    beta = F.when((F.col("n") >= min_pairs) & (F.col("pairs") >= min_pairs) & (F.col("ivar") > 0), F.col("cov") / F.col("ivar"))
    years = year_span(F.col("d1"), F.col("d0"))
    g = g.withColumn("vol", vol).withColumn("years", years)
    growth = num.cagr_pct(F.col("first"), F.col("last"), F.col("years"), None)
    sharpe = F.when((F.col("years") > 0.5) & (F.col("vol") > 0), (growth - risk_free_pct) / F.col("vol"))
    return g.select(
        "symbol", num.rounded(F.col("vol"), digits).alias("volatility_pct"), num.rounded(beta, digits).alias("beta"),
        num.rounded(sharpe, digits).alias("sharpe_ratio"),
    )


def returns_table(
    prices: DataFrame, statements: DataFrame, years: tuple[int, ...] = (1, 3, 5, 10), *, max_gap_days: int = 45,
    min_share: float = 0.7, digits: int | None = 2,
) -> DataFrame:
    """Growth per year over several spans, price only and with cash dividends added to the end value.

    A span starts at the first session on or after its target day and is left out where that session is more than
    ``max_gap_days`` away or covers less than ``min_share`` of the span.
    """
    p = prices.select("symbol", "date", "close", F.max("date").over(W.partitionBy("symbol")).alias("last_date"))
    target = {n: add_years(F.col("last_date"), -n) for n in years}
    g = p.groupBy("symbol").agg(
        F.max("last_date").alias("last_date"), F.max_by("close", "date").alias("close"),
        *[F.min(F.when(F.col("date") >= t, F.struct("date", "close"))).alias(f"s{n}") for n, t in target.items()],
    )
    spans = F.explode(F.array(*[
        F.struct(F.lit(f"{n}Y").alias("period"), F.lit(n).alias("n"), target[n].alias("target"), F.col(f"s{n}.date").alias("start_date"),
                 F.col(f"s{n}.close").alias("start_close")) for n in years
    ]))
    s = g.select("symbol", "last_date", "close", spans.alias("s")).select("symbol", "last_date", "close", "s.*")
    actual = year_span(F.col("last_date"), F.col("start_date"))
    s = s.withColumn("actual", actual).filter(
        (F.col("start_close") > 0) & (F.datediff("start_date", "target") <= max_gap_days) & (F.col("actual") >= F.col("n") * min_share)
    )
    paid = statements.filter(F.col("dps").isNotNull()).select("symbol", "fiscal_year", "dps")
    by_span = (
        s.join(paid, "symbol", "left")
        .groupBy("symbol", "period", "start_date", "start_close", "close", "actual")
        .agg(F.sum(F.when(F.col("fiscal_year") >= F.year("start_date"), F.col("dps"))).alias("dividends"))
    )
    price = num.cagr_pct(F.col("start_close"), F.col("close"), F.col("actual"), digits)
    total = num.cagr_pct(F.col("start_close"), F.col("close") + F.col("dividends"), F.col("actual"), digits)
    return by_span.select(
        "symbol", "period", "start_date", price.alias("price_cagr_pct"),
        F.when(F.col("dividends") > 0, total).otherwise(price).alias("total_return_cagr_pct"),
    )


__all__ = [
    "LOOKBACK_DAYS", "closes_at", "log_volatility", "lookback_returns", "performance_summary", "returns_table", "risk_metrics", "sharpe_1y",
]
