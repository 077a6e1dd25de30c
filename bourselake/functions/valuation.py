"""Valuation and quality models as Column expressions. An unknown input gives an unknown result."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from bourselake.functions.numbers import ratio_or_null, rounded, to_fixed

# Published model constants and the thresholds results depend on.
GRAHAM_FACTOR = 22.5
LYNCH_MAX_GROWTH = 50.0
BOND_YIELD_PCT = 11.5
LOW_LEVERAGE, HIGH_LEVERAGE = 0.5, 1.2
ALTMAN_WEIGHTS = (6.56, 3.26, 6.72, 1.05)
ALTMAN_SAFE, ALTMAN_DISTRESS = 2.6, 1.1
ENTRY_SHARE = 0.82
FINANCIAL_SECTORS = ("Bank", "Financial Institutions", "Insurance", "General Insurance", "Life Insurance")


@dataclass(frozen=True)
class Macro:
    """Rates of the macro table, as fractions."""

    risk_free: float = 0.1037
    equity_premium: float = 0.055
    terminal_growth: float = 0.04


# Choices of this library where no published value fixes them.
DDM_MIN_SPREAD = 0.02
DCF_YEARS = 10
SMART_MONEY_HIGH, RETAIL_HIGH = 40.0, 60.0
MOAT_WIDE_ROE, MOAT_NARROW_ROE = 20.0, 12.0
FAIR_BAND_PCT = 15.0
STRONG_BUY_MOS, ACCUMULATE_MOS, HOLD_MOS = 20.0, 5.0, -15.0


def graham_number(eps: Column, nav: Column, digits: int | None = 2) -> Column:
    return F.when((eps > 0) & (nav > 0), rounded(F.sqrt(GRAHAM_FACTOR * eps * nav), digits))


def margin_of_safety(value: Column, price: Column) -> Column:
    return F.when((value > 0) & (price > 0), to_fixed((value - price) / value * 100.0))


def earnings_yield(pe: Column) -> Column:
    return F.when(pe > 0, to_fixed(F.lit(1.0) / pe * 100.0))


def bond_spread(yield_pct: Column, bond_pct: float = BOND_YIELD_PCT) -> Column:
    return to_fixed(yield_pct - bond_pct)


def mean_reversion_target(multiple: Column, per_share: Column, digits: int | None = 2) -> Column:
    return F.when(per_share > 0, rounded(multiple * per_share, digits))


def upside_pct(target: Column, price: Column) -> Column:
    return F.when(price > 0, to_fixed((target - price) / price * 100.0))


def peter_lynch(eps: Column, growth_pct: Column, digits: int | None = 2) -> Column:
    return F.when((eps > 0) & (growth_pct > 0), rounded(eps * F.least(growth_pct, F.lit(LYNCH_MAX_GROWTH)), digits))


def cost_of_equity(beta: Column, macro: Macro = Macro()) -> Column:
    return F.lit(macro.risk_free) + F.coalesce(beta, F.lit(1.0)) * macro.equity_premium


def ddm_value(dps: Column, roe_pct: Column, payout: Column, beta: Column, macro: Macro = Macro(), digits: int | None = 2) -> Column:
    """Gordon growth; growth is retained return on equity, held below the cost of equity."""
    ke = cost_of_equity(beta, macro)
    g = F.least(F.greatest(roe_pct / 100.0 * (F.lit(1.0) - payout), F.lit(0.0)), ke - DDM_MIN_SPREAD)
    return F.when((dps > 0) & roe_pct.isNotNull() & payout.isNotNull(), rounded(dps * (F.lit(1.0) + g) / (ke - g), digits))


def power_sum(q: Column, n: int) -> Column:
    """q + q^2 + ... + q^n by nested multiplication, which stays in generated code."""
    total = q
    for _ in range(n - 1):
        total = q * (F.lit(1.0) + total)
    return total


def dcf_value(fcf_per_share: Column, growth_pct: Column, macro: Macro = Macro(), digits: int | None = 2) -> Column:
    """Ten years of growing free cash flow plus a terminal value; null without positive cash flow or known growth."""
    k = macro.risk_free + macro.equity_premium
    q = (F.lit(1.0) + growth_pct / 100.0) / (1.0 + k)
    stage = power_sum(q, DCF_YEARS)
    tail = F.pow(q, F.lit(float(DCF_YEARS))) * ((1.0 + macro.terminal_growth) / (k - macro.terminal_growth))
    return F.when((fcf_per_share > 0) & growth_pct.isNotNull(), rounded(fcf_per_share * (stage + tail), digits))


def total_debt(short_loan: Column, long_loan: Column) -> Column:
    return short_loan + long_loan


def debt_to_equity(short_loan: Column, long_loan: Column, paid_up: Column, reserve: Column, oci: Column, digits: int | None = 2) -> Column:
    """Null unless every component is known; an unknown one is never read as zero."""
    equity = paid_up + reserve + oci
    return F.when(equity > 0, rounded((short_loan + long_loan) / equity, digits))


def leverage_class(ratio: Column) -> Column:
    return F.when(ratio < LOW_LEVERAGE, "LOW").when(ratio > HIGH_LEVERAGE, "HIGH").when(ratio.isNotNull(), "MODERATE")


def price_to_sales(market_cap: Column, revenue: Column) -> Column:
    return F.when(revenue > 0, to_fixed(market_cap / revenue))


def percent_of(part: Column, whole: Column) -> Column:
    """Margins and return on assets."""
    return F.when(whole > 0, to_fixed(part / whole * 100.0))


def current_ratio(assets: Column, liabilities: Column) -> Column:
    return F.when(liabilities > 0, to_fixed(assets / liabilities))


def working_capital(assets: Column, liabilities: Column) -> Column:
    return to_fixed(assets - liabilities)


def free_cash_flow(operating: Column, capex: Column) -> Column:
    return to_fixed(operating - capex)


def dupont(net_income: Column, revenue: Column, assets: Column, equity: Column) -> Column:
    ok = (revenue > 0) & (assets > 0) & (equity > 0) & net_income.isNotNull()
    return F.when(
        ok,
        F.struct(
            to_fixed(net_income / revenue * 100.0).alias("net_margin_pct"), to_fixed(revenue / assets).alias("asset_turnover"),
            to_fixed(assets / equity).alias("equity_multiplier"), to_fixed(net_income / equity * 100.0).alias("roe_pct"),
        ),
    )


def altman_score(wc: Column, assets: Column, retained: Column, ebit: Column, equity: Column, liabilities: Column, digits: int | None = 2) -> Column:
    """Emerging-market Z'' score."""
    a, b, c, d = ALTMAN_WEIGHTS
    z = a * (wc / assets) + b * (retained / assets) + c * (ebit / assets) + d * (equity / liabilities)
    return F.when((assets > 0) & (liabilities > 0), rounded(z, digits))


def altman_zone(score: Column, sector: Column, financial: Iterable[str] = FINANCIAL_SECTORS) -> Column:
    return (
        F.when(F.coalesce(sector.isin(*financial), F.lit(False)), "NOT_APPLICABLE")
        .when(score > ALTMAN_SAFE, "SAFE")
        .when(score < ALTMAN_DISTRESS, "DISTRESS")
        .when(score.isNotNull(), "GREY")
    )


def payout_pct(dps: Column, eps: Column, digits: int | None = 1) -> Column:
    return F.when(eps > 0, rounded(dps / eps * 100.0, digits))


def dividend_status(dps: Column, eps: Column) -> Column:
    return (
        F.when(F.coalesce(dps, F.lit(0.0)) <= 0, "NO_DIVIDEND")
        .when(eps <= 0, "DIVIDEND_TRAP")
        .when(dps > eps, "RESERVE_DEPLETING")
        .when(eps.isNotNull(), "SAFE_ORGANIC")
    )


def smart_money_pct(institute: Column, foreign: Column) -> Column:
    return to_fixed(institute + foreign)


def smart_money_status(smart_pct: Column, public: Column) -> Column:
    return (
        F.when(smart_pct >= SMART_MONEY_HIGH, "HIGH_INSTITUTIONAL")
        .when(public >= RETAIL_HIGH, "RETAIL_DOMINATED")
        .when(smart_pct.isNotNull(), "BALANCED")
    )


def moat_rating(avg_roe: Column, leverage: Column, all_profitable: Column, all_paid: Column) -> Column:
    return (
        F.when((avg_roe >= MOAT_WIDE_ROE) & (leverage < LOW_LEVERAGE) & all_profitable & all_paid, "Wide")
        .when((avg_roe >= MOAT_NARROW_ROE) & all_profitable, "Narrow")
        .when(avg_roe.isNotNull(), "None")
    )


def valuation_verdict(mos_pct: Column) -> Column:
    return (
        F.when(mos_pct.isNull(), "Neutral").when(mos_pct >= FAIR_BAND_PCT, "Undervalued").when(mos_pct >= -FAIR_BAND_PCT, "Fairly Valued").otherwise("Overvalued")
    )


def graham_status(eps: Column, nav: Column) -> Column:
    return (
        F.when((eps > 0) & (nav > 0), "VIABLE")
        .when((eps <= 0) & (nav <= 0), "DISTRESSED_DUAL_NEGATIVE")
        .when(eps <= 0, "NEGATIVE_EARNINGS")
        .when(nav <= 0, "NEGATIVE_NET_ASSETS")
        .otherwise("INSUFFICIENT_DATA")
    )


def solvency_badge(equity: Column, leverage: Column) -> Column:
    return (
        F.when(equity < 0, "🚨 Critical Distress / Negative Equity")
        .when(leverage > HIGH_LEVERAGE, "High Leverage")
        .when(leverage < LOW_LEVERAGE, "Low Leverage")
        .when(leverage.isNotNull(), "Moderate Leverage")
    )


def piotroski_rating(score: Column, max_score: Column) -> Column:
    share = ratio_or_null(score.cast("double"), max_score.cast("double"))
    return F.when(share >= 7.0 / 9.0, "Strong").when(share >= 4.0 / 9.0, "Moderate").when(share.isNotNull(), "Weak")


def piotroski_badge(rating: Column) -> Column:
    return F.when(rating == "Strong", "Excellent Quality").when(rating == "Moderate", "Stable Health").when(rating == "Weak", "Weak Health")


def decision_verdict(mos_pct: Column, zone: Column, eps: Column, leverage: Column) -> Column:
    distress = F.coalesce(zone == "DISTRESS", F.lit(False)) | F.coalesce((eps <= 0) & (leverage > HIGH_LEVERAGE), F.lit(False))
    return (
        F.when(distress, "AVOID_DISTRESS")
        .when(mos_pct >= STRONG_BUY_MOS, "STRONG_BUY")
        .when(mos_pct >= ACCUMULATE_MOS, "ACCUMULATE")
        .when(mos_pct >= HOLD_MOS, "HOLD")
        .when(mos_pct.isNotNull(), "REDUCE")
        .otherwise("INSUFFICIENT_DATA")
    )


def entry_price(blended: Column) -> Column:
    return to_fixed(blended * ENTRY_SHARE)


def category_quality(category: Column) -> Column:
    return F.when(category.isNotNull(), F.concat(F.lit("Category "), category))


def grown_sum(base: Column, growth_pct: Column, years: int) -> Column:
    """Sum of ``base`` grown for 1..years; unknown growth counts as none."""
    g = F.lit(1.0) + F.coalesce(growth_pct, F.lit(0.0)) / 100.0
    return base * power_sum(g, years)


def timing_verdict(decision: Column, zone: Column) -> Column:
    value = decision.isin("STRONG_BUY", "ACCUMULATE")
    return (
        F.when(value & (zone == "OVERSOLD"), "SNIPER_BUY")
        .when(value, "VALUE_WAIT_FOR_DIP")
        .when(zone == "OVERBOUGHT", "TAKE_PROFIT")
        .otherwise("NEUTRAL")
    )
