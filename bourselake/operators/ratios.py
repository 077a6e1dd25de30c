"""Ratios of annual statements derived from the price at the fiscal year end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bourselake.functions import numbers as num


def year_end_closes(statements: DataFrame, prices: DataFrame, *, month: int = 6, day: int = 30) -> DataFrame:
    """(symbol, fiscal_year, year_end_close): last close on or before the fiscal year end.

    Prices collapse to one row per symbol and fiscal year with map-side partial sums before the shuffle; years without
    a session inherit the last earlier close.
    """
    past_end = F.struct(F.month("date"), F.dayofmonth("date")) > F.struct(F.lit(month), F.lit(day))
    yearly = (
        prices.filter(F.col("close") > 0)
        .groupBy("symbol", (F.year("date") + F.when(past_end, 1).otherwise(0)).alias("fiscal_year"))
        .agg(F.max_by("close", "date").alias("c"))
        .select("symbol", "fiscal_year", "c", F.lit(False).alias("wanted"))
    )
    wanted = statements.select("symbol", "fiscal_year", F.lit(None).cast("double").alias("c"), F.lit(True).alias("wanted"))
    w = W.partitionBy("symbol").orderBy("fiscal_year", "wanted").rowsBetween(W.unboundedPreceding, 0)
    both = wanted.unionByName(yearly).withColumn("year_end_close", F.last("c", ignorenulls=True).over(w))
    return both.filter("wanted").select("symbol", "fiscal_year", "year_end_close")


def derived_ratios(
    statements: DataFrame, prices: DataFrame, *, month: int = 6, day: int = 30, par_value: float = 10.0, digits: int | None = 2
) -> DataFrame:
    """P/E, P/B, ROE, dividend yield and market value of every statement from its year-end close."""
    y = F.col("year_end_close")
    eps, nav, dps = F.col("eps_basic"), F.col("nav_per_share"), F.col("dps")
    shares = F.floor(F.col("paid_up_capital_mn") * 1e6 / par_value + 0.5)
    joined = statements.join(year_end_closes(statements, prices, month=month, day=day), ["symbol", "fiscal_year"], "left")
    rated = num.with_rounded(
        joined,
        {
            "pe_ratio": F.when(eps > 0, y / eps),
            "pb_ratio": F.when(nav > 0, y / nav),
            "roe": F.when((nav > 0) & (eps != 0), eps / nav * 100.0),
            "dividend_yield": F.when((dps > 0) & (y > 0), dps / y * 100.0),
        },
        digits,
    ).withColumn("shares", F.when(F.col("paid_up_capital_mn") > 0, shares))
    return num.with_rounded(rated, {"market_cap_mn": y * F.col("shares").cast("double") / 1e6}, digits)
