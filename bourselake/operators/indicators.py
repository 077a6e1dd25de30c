"""Time-series indicators that Spark windows express directly.

All frames partition by symbol and order by day. A price table holds one row per symbol and day, so a partition is
bounded by the calendar; every function below uses the same partitioning, so Spark keeps one exchange and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bourselake.functions import labels
from bourselake.functions import numbers as num
from bourselake.operators import skew

MIN_SERIES = 20


def _by_day():
    return W.partitionBy("symbol").orderBy("date")


def _full(value: Column, n: int) -> Column:
    """``value`` only where the window of ``n`` rows is full."""
    return F.when(F.count(F.lit(1)).over(_by_day().rowsBetween(-(n - 1), 0)) == n, value)


def long_enough(prices: DataFrame, n: int = MIN_SERIES) -> DataFrame:
    """Symbols with at least ``n`` sessions; shorter series give no indicators."""
    return prices.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("symbol"))).filter(F.col("_n") >= n).drop("_n")


def sma_column(n: int) -> Column:
    return _full(F.avg("close").over(_by_day().rowsBetween(-(n - 1), 0)), n)


def sma(prices: DataFrame, periods: tuple[int, ...] = (20, 50, 200), digits: int | None = 4) -> DataFrame:
    base = long_enough(prices.select("symbol", "date", "close"))
    raw = base.select("symbol", "date", *[sma_column(n).alias(f"sma_{n}") for n in periods])
    return raw.select("symbol", "date", *[num.rounded(F.col(f"sma_{n}"), digits).alias(f"sma_{n}") for n in periods])


def bollinger(prices: DataFrame, n: int = 20, width: float = 2.0, digits: int | None = 4) -> DataFrame:
    """Mean of the last ``n`` closes and ``width`` population deviations around it."""
    base = long_enough(prices.select("symbol", "date", "close"))
    sd = _full(F.stddev_pop("close").over(_by_day().rowsBetween(-(n - 1), 0)), n)
    banded = base.select("symbol", "date", sma_column(n).alias("mid"), sd.alias("sd"))
    return banded.select(
        "symbol", "date",
        num.rounded(F.col("mid") + F.col("sd") * width, digits).alias("boll_upper"),
        num.rounded(F.col("mid"), digits).alias("boll_mid"),
        num.rounded(F.col("mid") - F.col("sd") * width, digits).alias("boll_lower"),
    )


def rolling_high_low(prices: DataFrame, sessions: int = 252) -> DataFrame:
    """Highest and lowest close of the last ``sessions`` rows; shorter windows at the start are allowed."""
    w = _by_day().rowsBetween(-(sessions - 1), 0)
    return prices.select("symbol", "date", F.max("close").over(w).alias("week52_high"), F.min("close").over(w).alias("week52_low"))


def rolling_calendar_high_low(prices: DataFrame, days: int = 365) -> DataFrame:
    """Highest and lowest close of the last ``days`` calendar days at every session."""
    w = W.partitionBy("symbol").orderBy(F.unix_date("date")).rangeBetween(-days, 0)
    return prices.select("symbol", "date", F.max("close").over(w).alias("high"), F.min("close").over(w).alias("low"))


def week52(prices: DataFrame, days: int = 365, digits: int | None = 2) -> DataFrame:
    """High, low and distance from the high over the last ``days`` calendar days of each symbol."""
    last = F.max("date").over(W.partitionBy("symbol"))
    p = prices.select("symbol", "date", "close", last.alias("last_date"))
    inside = (F.col("date") >= F.date_sub("last_date", days)) & (F.col("close") > 0)
    g = p.groupBy("symbol").agg(
        F.max(F.when(inside, F.col("close"))).alias("high"), F.min(F.when(inside, F.col("close"))).alias("low"),
        F.max_by("close", "date").alias("close"),
    )
    off = F.when(F.col("high") > 0, num.rounded((F.col("close") - F.col("high")) / F.col("high") * 100.0, digits))
    return g.select("symbol", num.rounded(F.col("high"), digits).alias("high"), num.rounded(F.col("low"), digits).alias("low"), off.alias("percent_off_high"))


def trend(prices: DataFrame, short: int = 50, long: int = 200, digits: int | None = 2) -> DataFrame:
    """Means of the newest closes (fewer rows allowed) and the trend they show."""
    rn = F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("date")))
    r = prices.filter(F.col("close") > 0).select("symbol", "date", "close", rn.alias("rn")).filter(F.col("rn") <= long)
    g = r.groupBy("symbol").agg(
        F.avg(F.when(F.col("rn") <= short, F.col("close"))).alias("s"), F.avg("close").alias("l"), F.max_by("close", "date").alias("close")
    )
    g = g.select("symbol", "close", num.rounded(F.col("s"), digits).alias("sma50"), num.rounded(F.col("l"), digits).alias("sma200"))
    return g.withColumn("trend_signal", labels.trend_label(F.col("close"), F.col("sma50"), F.col("sma200")))


def max_drawdown(prices: DataFrame, digits: int | None = 2) -> DataFrame:
    """Deepest fall from a running peak, with the first day of that peak and the first day of that low."""
    up_to_now = _by_day().rowsBetween(W.unboundedPreceding, 0)
    # The largest (close, -day) is the running peak at its earliest day.
    peak = F.max(F.struct(F.col("close").alias("c"), (-F.unix_date("date")).alias("d"))).over(up_to_now)
    p = prices.filter(F.col("close") > 0).select("symbol", "date", "close", peak.alias("peak"))
    fall = (F.col("close") - F.col("peak.c")) / F.col("peak.c") * 100.0
    falls = p.select("symbol", "date", fall.alias("fall"), F.date_from_unix_date(-F.col("peak.d")).alias("peak_date"))
    g = falls.groupBy("symbol").agg(F.min(F.struct("fall", "date", "peak_date")).alias("m"))
    real = F.col("m.fall") < 0
    return g.select(
        "symbol", num.rounded(F.col("m.fall"), digits).alias("max_drawdown_pct"),
        F.when(real, F.col("m.peak_date")).alias("peak_date"), F.when(real, F.col("m.date")).alias("trough_date"),
    )


def annual_return(prices: DataFrame, digits: int | None = 2) -> DataFrame:
    """Close against the last close of the calendar year before."""
    yearly = prices.groupBy("symbol", F.year("date").alias("y")).agg(F.max_by("close", "date").alias("prev_close"))
    prev = yearly.select("symbol", (F.col("y") + 1).alias("y"), "prev_close")
    p = prices.select("symbol", "date", "close", F.year("date").alias("y")).join(prev, ["symbol", "y"], "left")
    ret = F.when(F.col("prev_close") > 0, num.rounded((F.col("close") / F.col("prev_close") - 1.0) * 100.0, digits))
    return p.select("symbol", "date", ret.alias("annual_return_pct"))


def price_swing(prices: DataFrame, up: float = 3.0, down: float = 0.25) -> DataFrame:
    """Sessions whose close left the band around the previous session's close."""
    prev = F.lag("close").over(_by_day())
    p = prices.select("symbol", "date", "close", prev.alias("prev_close")).filter(F.col("prev_close") > 0)
    ratio = F.col("close") / F.col("prev_close")
    return p.withColumn("ratio", ratio).filter((F.col("ratio") > up) | (F.col("ratio") < down))


def wma(prices: DataFrame, n: int = 20, digits: int | None = 4) -> DataFrame:
    """Linearly weighted mean of the last ``n`` closes, newest weighted most."""
    w = _by_day()
    total = sum((F.lag("close", i).over(w) * float(n - i) for i in range(1, n)), F.col("close") * float(n))
    base = prices.select("symbol", "date", "close", total.alias("t"))
    return base.select("symbol", "date", "close", num.rounded(F.col("t") / float(n * (n + 1) / 2), digits).alias(f"wma_{n}"))


def dedupe_first(prices: DataFrame, seq: str) -> DataFrame:
    """The first record of each (symbol, day); copies collapse on the map side."""
    cols = [c for c in prices.columns if c not in ("symbol", "date")]
    first = prices.groupBy("symbol", "date").agg(F.min_by(F.struct(*cols), seq).alias("_f"))
    return first.select("symbol", "date", "_f.*")


def sector_pe_percentile(statements: DataFrame, roster: DataFrame, min_peers: int = 4) -> DataFrame:
    """Per year and sector, the share of peers with a higher P/E (a higher percentile is cheaper)."""
    members = roster.filter(F.col("sector").isNotNull()).select("symbol", "sector")
    pe = statements.filter(F.col("pe_ratio") > 0).select("symbol", "fiscal_year", "pe_ratio").join(members, "symbol")
    ranked = skew.count_above(pe, ["sector", "fiscal_year"], "pe_ratio")
    n = F.col("group_size")
    pct = F.floor(F.col("above").cast("double") / (n - 1).cast("double") * 100.0 + 0.5)
    return ranked.filter(n >= min_peers).select("symbol", "sector", "fiscal_year", pct.alias("percentile"), n.alias("peer_count"))


def screener_flags(statements: DataFrame, min_years: int = 3) -> DataFrame:
    """Never-decreasing dividend payers and companies back in profit; symbols with neither flag are left out."""
    by_year = W.partitionBy("symbol").orderBy("fiscal_year")
    prev_dps = F.last("dps", ignorenulls=True).over(by_year.rowsBetween(W.unboundedPreceding, -1))
    s = statements.select(
        "symbol", "fiscal_year", F.col("eps_basic").alias("eps"), "dps",
        prev_dps.alias("prev_dps"), F.lag("eps_basic").over(by_year).alias("prev_eps"),
    )
    g = s.groupBy("symbol").agg(
        F.count("dps").alias("years"), F.count_if(F.col("dps") < F.col("prev_dps")).alias("cuts"),
        F.max_by("eps", "fiscal_year").alias("eps"), F.max_by("prev_eps", "fiscal_year").alias("prev_eps"),
    )
    aristocrat = (F.col("years") >= min_years) & (F.col("cuts") == 0)
    turnaround = F.coalesce((F.col("eps") > 0) & (F.col("prev_eps") <= 0), F.lit(False))
    flags = g.select("symbol", aristocrat.alias("dividend_aristocrat"), turnaround.alias("turnaround"))
    return flags.filter(F.col("dividend_aristocrat") | F.col("turnaround"))
