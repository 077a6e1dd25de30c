"""Threshold labels and small classifications."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts of the trend, corridor and liquidity labels.
TREND_BULL = "Bullish Golden Cross (Above SMA50 & SMA200)"
TREND_BEAR = "Bearish Consolidation (Below SMA50 & SMA200)"
TREND_SUPPORT = "Long-Term Structural Support (Above SMA200)"
TREND_NEUTRAL = "Neutral Accumulation"
CORRIDOR_LOW = "Deep Historical Discount (<25th Percentile)"
CORRIDOR_FAIR = "Fair Historical Range (25th–75th Percentile)"
CORRIDOR_HIGH = "Elevated Multiple (>75th Percentile)"
CORRIDOR_NONE = "P/E multiple unrated"


def trend_label(price: Column, sma50: Column, sma200: Column) -> Column:
    return (
        F.when((sma50 > sma200) & (price > sma50), TREND_BULL)
        .when((sma50 < sma200) & (price < sma50), TREND_BEAR)
        .when(price > sma200, TREND_SUPPORT)
        .otherwise(TREND_NEUTRAL)
    )


def valuation_status(percentile_rank: Column) -> Column:
    return (
        F.when(percentile_rank.isNull(), CORRIDOR_NONE)
        .when(percentile_rank <= 25, CORRIDOR_LOW)
        .when(percentile_rank <= 75, CORRIDOR_FAIR)
        .otherwise(CORRIDOR_HIGH)
    )


def liquidity_class(avg_value_mn: Column) -> Column:
    return F.when(avg_value_mn < 1, "Illiquid").when(avg_value_mn < 10, "Moderate").when(avg_value_mn >= 10, "Liquid")


def audited_period(fiscal_year: Column, period: Column) -> Column:
    """'FY2024 Annual'; the period part is left out where unknown."""
    return F.when(
        fiscal_year.isNotNull(),
        F.concat_ws(" ", F.concat(F.lit("FY"), fiscal_year.cast("string")), F.nullif(period, F.lit(""))),
    )


def fixed_income_class(symbol: Column, sector: Column, asset_class: Column, category: Column) -> Column:
    """struct(asset_class, sector, category), replaced only for bond-like codes with no sector of their own."""
    bond_like = (
        symbol.like("TB%") | symbol.like("%BOND%") | symbol.like("%SUKUK%") | symbol.like("%DEB%")
    ) & (sector.isNull() | (sector == "") | asset_class.eqNullSafe(F.lit("Fixed Income")))
    new_sector = (
        F.when(symbol.like("TB%"), "Govt Treasury Bond")
        .when(symbol.like("%SUKUK%"), "Sukuk")
        .when(symbol.like("%DEB%"), "Debenture")
        .otherwise("Corporate Bond")
    )
    new_category = F.when(symbol.like("TB%"), "Govt Bond").when(symbol.like("%SUKUK%"), "Sukuk").otherwise("Bond")
    return F.struct(
        F.when(bond_like, "Fixed Income").otherwise(asset_class).alias("asset_class"),
        F.when(bond_like, new_sector).otherwise(sector).alias("sector"),
        F.when(bond_like, new_category).otherwise(category).alias("category"),
    )


def total_bonus_hours(days: Column, hours: Column) -> Column:
    """Bonus time of a promo code in hours; a missing part counts as none."""
    return F.coalesce(days, F.lit(0)) * 24 + F.coalesce(hours, F.lit(0))


def rsi_zone(rsi: Column) -> Column:
    return (
        F.when(rsi.isNull(), "INSUFFICIENT_DATA").when(rsi < 30, "OVERSOLD").when(rsi > 70, "OVERBOUGHT").otherwise("NEUTRAL")
    )
