"""Valuation, quality and decision frames: one row per symbol unless said otherwise.

Inputs are annual statements (a bounded number of years per symbol) and the latest close. All frames join on symbol.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bourselake.functions import labels
from bourselake.functions import numbers as num
from bourselake.functions import valuation as v
from bourselake.operators import indicators, market, returns
from bourselake.operators.lookups import HOLDERS, level_per_day

c = F.col


GROWTH_FIELDS = {"eps_basic": "eps", "nav_per_share": "navps", "dps": "dps", "free_cash_flow_mn": "fcf"}


def yearly_metrics() -> dict[str, Column]:
    """What the year-on-year signals compare."""
    return {
        "cap": c("paid_up_capital_mn"),
        "roa": num.ratio_or_null(c("net_income_mn"), c("total_assets_mn")),
        "lev": num.ratio_or_null(c("short_term_loan_mn") + c("long_term_loan_mn"), c("total_assets_mn")),
        "cr": num.ratio_or_null(c("current_assets_mn"), c("current_liabilities_mn")),
        "gm": num.ratio_or_null(c("gross_profit_mn"), c("revenue_mn")),
        "at": num.ratio_or_null(c("revenue_mn"), c("total_assets_mn")),
    }


def statement_facts(statements: DataFrame, years: int = 5) -> DataFrame:
    """One row per symbol from one pass over its statements: the latest year, the metrics of the year before, growth end
    points, multiples and returns of the newest ``years`` years, and the profit streak.

    Every model below reads this frame, so statements shuffle once (by symbol), are sorted once, and columns a
    model does not use are pruned away.
    """
    newest_first = W.partitionBy("symbol").orderBy(F.desc("fiscal_year"))
    so_far = newest_first.rowsBetween(W.unboundedPreceding, 0)
    seen = lambda f: F.sum((F.coalesce(c(f) > 0, F.lit(False))).cast("int")).over(so_far)
    metrics = yearly_metrics()
    s = statements.withColumns({f"m_{n}": e for n, e in metrics.items()})
    s = s.withColumns(
        {f"p_{n}": F.lead(f"m_{n}").over(newest_first) for n in metrics}
        | {
            "_rn": F.row_number().over(newest_first), "_rn_pe": seen("pe_ratio"), "_rn_pb": seen("pb_ratio"),
            "_unbroken": F.min(F.coalesce(c("eps_basic") > 0, F.lit(False)).cast("int")).over(so_far),
        }
    )
    aggs = [F.max_by(x, "fiscal_year").alias(x) for x in statements.columns if x not in ("symbol", "fiscal_year")]
    aggs += [F.max_by(x, "fiscal_year").alias(x) for x in (*[f"m_{n}" for n in metrics], *[f"p_{n}" for n in metrics])]
    aggs += [F.max("fiscal_year").alias("fiscal_year"), F.sum("_unbroken").alias("profit_streak_years")]
    for f, n in GROWTH_FIELDS.items():
        y = F.when(c(f) > 0, c("fiscal_year"))
        aggs += [F.min(y).alias(f"{n}_y0"), F.max(y).alias(f"{n}_y1"), F.min_by(f, y).alias(f"{n}_v0"), F.max_by(f, y).alias(f"{n}_v1")]
    for f, n, rn in (("pe_ratio", "pe", "_rn_pe"), ("pb_ratio", "pb", "_rn_pb")):
        used = (c(f) > 0) & (c(rn) <= years)
        x, y = F.when(used, c(f)), F.when(used, c("fiscal_year"))
        aggs += [F.avg(x).alias(f"{n}_m"), F.stddev_pop(x).alias(f"{n}_sd"), F.count(x).alias(f"{n}_n"), F.min(y).alias(f"{n}_a"), F.max(y).alias(f"{n}_b")]
    recent = c("_rn") <= years
    aggs += [
        F.avg(F.when(recent, c("roe"))).alias("avg_roe_raw"),
        F.min(F.when(recent, F.coalesce(c("eps_basic") > 0, F.lit(False)))).alias("all_profitable"),
        F.min(F.when(recent, F.coalesce(c("dps") > 0, F.lit(False)))).alias("all_paid"),
    ]
    facts = s.groupBy("symbol").agg(*aggs)
    grown = {}
    for n in GROWTH_FIELDS.values():
        span = (c(f"{n}_y1") - c(f"{n}_y0")).cast("double")
        grown[f"{n}_cagr"] = F.when(span > 0, num.cagr_pct(c(f"{n}_v0"), c(f"{n}_v1"), span, None))
    return num.with_rounded(facts, grown)


def latest_with_price(statements: DataFrame, prices: DataFrame) -> DataFrame:
    """``statement_facts`` with the latest close as ``ltp``."""
    last = prices.groupBy("symbol").agg(F.max_by("close", "date").alias("ltp"))
    return statement_facts(statements).join(last, "symbol", "left")


def graham(latest: DataFrame) -> DataFrame:
    g = latest.select("symbol", "ltp", v.graham_number(c("eps_basic"), c("nav_per_share")).alias("graham_number"))
    return g.withColumn("margin_of_safety_pct", v.margin_of_safety(c("graham_number"), c("ltp")))


def yield_spread(latest: DataFrame) -> DataFrame:
    pe = F.when((c("ltp") > 0) & (c("eps_basic") > 0), num.to_fixed(c("ltp") / c("eps_basic")))
    y = latest.select("symbol", pe.alias("pe")).withColumn("earnings_yield", v.earnings_yield(c("pe")))
    return y.withColumn("bond_spread", v.bond_spread(c("earnings_yield")))


def pe_mean_reversion(latest: DataFrame, corridor: DataFrame) -> DataFrame:
    """Price at the median historical P/E and its distance from the latest close."""
    j = latest.select("symbol", "ltp", "eps_basic").join(corridor.select("symbol", "median"), "symbol")
    t = j.withColumn("target_price", v.mean_reversion_target(c("median"), c("eps_basic")))
    return t.select("symbol", "median", "target_price", v.upside_pct(c("target_price"), c("ltp")).alias("upside_pct"))


def growth_rates(facts: DataFrame) -> DataFrame:
    """Growth per year of EPS, NAV, DPS and free cash flow between the first and last positive year."""
    names = [f"{n}_cagr" for n in GROWTH_FIELDS.values()]
    return facts.select("symbol", *names).filter(F.coalesce(*names).isNotNull())


def lynch_value(digits: int | None = 2) -> Column:
    return v.peter_lynch(c("eps_basic"), c("eps_cagr"), digits)


def peter_lynch(facts: DataFrame) -> DataFrame:
    return facts.select("symbol", lynch_value().alias("peter_lynch_fair_value"))


def ddm_fair_value(macro: v.Macro = v.Macro(), digits: int | None = 2) -> Column:
    payout = F.when((c("eps_basic") > 0) & c("dps").isNotNull(), F.least(c("dps") / c("eps_basic"), F.lit(1.0)))
    return v.ddm_value(c("dps"), c("roe"), payout, c("beta"), macro, digits)


def ddm(facts: DataFrame, beta: DataFrame, macro: v.Macro = v.Macro()) -> DataFrame:
    j = facts.join(beta.select("symbol", "beta"), "symbol", "left")
    raw = j.select("symbol", (v.cost_of_equity(c("beta"), macro) * 100.0).alias("ke"), ddm_fair_value(macro, None).alias("value"))
    return raw.select("symbol", num.to_fixed(c("ke")).alias("cost_of_equity_pct"), num.to_fixed(c("value")).alias("ddm_fair_value"))


def fcf_per_share() -> Column:
    return F.when(c("shares") > 0, c("free_cash_flow_mn") * 1e6 / c("shares").cast("double"))


def dcf(facts: DataFrame, macro: v.Macro = v.Macro()) -> DataFrame:
    raw = facts.select("symbol", fcf_per_share().alias("fcf_per_share"), "fcf_cagr")
    raw = raw.withColumn("value", v.dcf_value(c("fcf_per_share"), c("fcf_cagr"), macro, None))
    return raw.select("symbol", "fcf_per_share", num.to_fixed(c("value")).alias("dcf_intrinsic_value"))


def leverage_ratio(digits: int | None = 2) -> Column:
    return v.debt_to_equity(c("short_term_loan_mn"), c("long_term_loan_mn"), c("paid_up_capital_mn"), c("reserve_surplus_mn"), c("oci_mn"), digits)


def leverage(latest: DataFrame) -> DataFrame:
    return latest.select("symbol", leverage_ratio().alias("debt_to_equity")).withColumn("leverage", v.leverage_class(c("debt_to_equity")))


def corridors(facts: DataFrame) -> DataFrame:
    """Mean and deviation bands of P/E and P/B over the newest years that have them, with the years that count."""
    cols = []
    for p in ("pe", "pb"):
        m, sd, n = c(f"{p}_m"), c(f"{p}_sd"), c(f"{p}_n")
        note = F.format_string("Calculated from last %d years of annual data (FY%d-FY%d)", n, c(f"{p}_a"), c(f"{p}_b"))
        cols += [
            num.to_fixed(m).alias(f"{p}_mean"), num.to_fixed(m - sd).alias(f"{p}_low"), num.to_fixed(m + sd).alias(f"{p}_high"),
            F.when(n > 0, n).alias(f"{p}_sample_count"), F.when(n > 0, note).alias(f"{p}_note"),
        ]
    return facts.filter((c("pe_n") > 0) | (c("pb_n") > 0)).select("symbol", *cols)


def pb_target() -> Column:
    return v.mean_reversion_target(num.to_fixed(c("pb_m")), c("nav_per_share"))


def pb_mean_reversion(latest: DataFrame) -> DataFrame:
    t = latest.filter((c("pe_n") > 0) | (c("pb_n") > 0)).select("symbol", "ltp", num.to_fixed(c("pb_m")).alias("pb_mean"), pb_target().alias("target_price"))
    return t.select("symbol", "pb_mean", "target_price", v.upside_pct(c("target_price"), c("ltp")).alias("upside_pct"))


SIGNALS = (
    "positive_roa", "positive_cfo", "roa_improving", "cfo_above_income", "leverage_falling", "liquidity_improving", "no_new_shares",
    "margin_improving", "turnover_improving",
)


def piotroski_columns() -> dict[str, Column]:
    tests = dict(zip(SIGNALS, (
        c("m_roa") > 0, c("operating_cash_flow_mn") > 0, c("m_roa") > c("p_roa"), c("operating_cash_flow_mn") > c("net_income_mn"),
        c("m_lev") < c("p_lev"), c("m_cr") > c("p_cr"), c("m_cap") <= c("p_cap"), c("m_gm") > c("p_gm"), c("m_at") > c("p_at"),
    )))
    score = reduce(lambda a, b: a + b, [F.coalesce(t.cast("int"), F.lit(0)) for t in tests.values()])
    top = reduce(lambda a, b: a + b, [t.isNotNull().cast("int") for t in tests.values()])
    return tests | {"score": score, "max_score": top, "rating": v.piotroski_rating(score, top)}


def piotroski(facts: DataFrame) -> DataFrame:
    """Nine signals of the latest year against the year before; one that cannot be decided is left out of the maximum."""
    return facts.select("symbol", "fiscal_year", *[e.alias(n) for n, e in piotroski_columns().items()])


def moat_column(ratio: Column | None = None) -> Column:
    return v.moat_rating(c("avg_roe_raw"), leverage_ratio() if ratio is None else ratio, c("all_profitable"), c("all_paid"))


def moat(facts: DataFrame) -> DataFrame:
    return facts.select("symbol", num.to_fixed(c("avg_roe_raw")).alias("avg_roe"), "all_profitable", "all_paid", moat_column().alias("moat_rating"))


def operating_ratios(latest: DataFrame) -> DataFrame:
    return latest.select(
        "symbol", "fiscal_year",
        v.price_to_sales(c("market_cap_mn"), c("revenue_mn")).alias("price_to_sales"),
        v.percent_of(c("net_income_mn"), c("total_assets_mn")).alias("return_on_assets_pct"),
        v.percent_of(c("gross_profit_mn"), c("revenue_mn")).alias("gross_margin_pct"),
        v.percent_of(c("operating_profit_mn"), c("revenue_mn")).alias("operating_margin_pct"),
        v.current_ratio(c("current_assets_mn"), c("current_liabilities_mn")).alias("current_ratio"),
        v.working_capital(c("current_assets_mn"), c("current_liabilities_mn")).alias("working_capital_mn"),
    )


def dupont(statements: DataFrame) -> DataFrame:
    d = v.dupont(c("net_income_mn"), c("revenue_mn"), c("total_assets_mn"), c("total_assets_mn") - c("total_liabilities_mn"))
    return statements.select("symbol", "fiscal_year", d.alias("d")).select("symbol", "fiscal_year", "d.*")


def cash_flow(statements: DataFrame) -> DataFrame:
    return statements.select("symbol", "fiscal_year", v.free_cash_flow(c("operating_cash_flow_mn"), c("capex_mn")).alias("free_cash_flow_mn"))


def is_financial(financial: tuple[str, ...]) -> Column:
    return F.coalesce(c("sector").isin(*financial), F.lit(False))


def with_altman(df: DataFrame, financial: tuple[str, ...]) -> DataFrame:
    """Add ``altman_z`` and its ``zone`` to rows that carry the latest statement and the sector."""
    score = v.altman_score(
        c("current_assets_mn") - c("current_liabilities_mn"), c("total_assets_mn"), c("reserve_surplus_mn"), c("operating_profit_mn"),
        c("total_assets_mn") - c("total_liabilities_mn"), c("total_liabilities_mn"), None,
    )
    z = num.with_rounded(df, {"altman_z": F.when(~is_financial(financial), score)})
    return z.withColumn("zone", v.altman_zone(c("altman_z"), c("sector"), financial))


def altman(latest: DataFrame, roster: DataFrame, financial: tuple[str, ...] = v.FINANCIAL_SECTORS) -> DataFrame:
    j = latest.join(roster.select("symbol", "sector"), "symbol", "left")
    return with_altman(j, financial).select("symbol", "sector", is_financial(financial).alias("is_financial"), "altman_z", "zone")


def dividend_sustainability(latest: DataFrame) -> DataFrame:
    s = latest.select("symbol", "dps", "eps_basic", v.payout_pct(c("dps"), c("eps_basic")).alias("payout_pct"), v.dividend_status(c("dps"), c("eps_basic")).alias("status"))
    return s.withColumn("is_sustainable", c("status") == "SAFE_ORGANIC").withColumn("is_trap", c("status") == "DIVIDEND_TRAP")


def smart_money(shareholding: DataFrame, block_trades: DataFrame) -> DataFrame:
    n = block_trades.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    j = shareholding.join(n, "symbol", "left")
    pct = v.smart_money_pct(c("institute_pct"), c("foreign_pct"))
    return j.select(
        "symbol", pct.alias("smart_money_pct"), v.smart_money_status(pct, c("public_pct")).alias("status"), F.coalesce("n", F.lit(0)).alias("block_trade_count")
    )


def mean_of_known(*models: Column) -> Column:
    """Mean of the values that are known, unrounded."""
    total = reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0.0)) for x in models])
    known = reduce(lambda a, b: a + b, [x.isNotNull().cast("int") for x in models])
    return F.when(known > 0, total / known)


MODELS = ("graham_number", "peter_lynch_fair_value", "ddm_fair_value", "dcf_intrinsic_value", "pb_target")


def with_models(facts: DataFrame, risk: DataFrame, macro: v.Macro = v.Macro()) -> DataFrame:
    """Facts and risk figures of a symbol plus every intrinsic value, their mean and the margin to the latest close."""
    # Raw values first, then rounding: a rounded expression reads its input several times.
    raw = {
        "graham_number": v.graham_number(c("eps_basic"), c("nav_per_share"), None), "peter_lynch_fair_value": lynch_value(None),
        "ddm_fair_value": ddm_fair_value(macro, None), "dcf_intrinsic_value": v.dcf_value(fcf_per_share(), c("fcf_cagr"), macro, None),
        "pb_target": v.mean_reversion_target(c("_pb"), c("nav_per_share"), None),
    }
    out = num.with_rounded(facts.join(risk, "symbol", "left").withColumn("_pb", num.to_fixed(c("pb_m"))), raw)
    out = out.withColumn("_blend", mean_of_known(*[c(m) for m in MODELS])).withColumn("blended_target", num.to_fixed(c("_blend"))).drop("_blend")
    return out.withColumn("margin_of_safety_pct", v.margin_of_safety(c("blended_target"), c("ltp")))


def valuation_models(statements: DataFrame, prices: DataFrame, risk: DataFrame, macro: v.Macro = v.Macro()) -> DataFrame:
    m = with_models(latest_with_price(statements, prices), risk, macro)
    return m.select("symbol", "ltp", "eps_basic", "nav_per_share", *MODELS, "blended_target", "margin_of_safety_pct")


def decision_summary(
    statements: DataFrame, roster: DataFrame, prices: DataFrame, risk: DataFrame, *, financial: tuple[str, ...] = v.FINANCIAL_SECTORS
) -> DataFrame:
    """Verdict, entry price, resilience flags, streaks and projections."""
    m = with_models(latest_with_price(statements, prices), risk)
    m = m.join(roster.select("symbol", "sector", "category"), "symbol", "left")
    m = with_altman(num.with_rounded(m, {"debt_to_equity": leverage_ratio(None)}), financial)
    m = m.withColumns({"moat_rating": moat_column(c("debt_to_equity")), "dividend_status": v.dividend_status(c("dps"), c("eps_basic"))})
    return decide(m)


def decide(inputs: DataFrame) -> DataFrame:
    """The decision columns over a frame that already holds every input."""
    low_debt = F.coalesce(c("debt_to_equity") < v.LOW_LEVERAGE, F.lit(False))
    safe = F.coalesce(c("zone").isin("SAFE", "NOT_APPLICABLE"), F.lit(False))
    # Sums and powers are named first and rounded afterwards, so each is worked out once.
    raw = {f"_d{n}": v.grown_sum(c("dps"), c("dps_cagr"), n) for n in (3, 5, 10)}
    raw["_f5"] = c("blended_target") * F.pow(F.lit(1.0) + F.coalesce("eps_cagr", F.lit(0.0)) / 100.0, F.lit(5.0))
    d = inputs.withColumns(raw).withColumns({n: num.to_fixed(c(n)) for n in raw} | {"_storm": low_debt & safe})
    d = d.withColumn("_end", c("_f5") + F.coalesce("_d5", F.lit(0.0)))
    d = d.withColumn("_ret", F.when((c("ltp") > 0) & (c("_end") > 0), (F.pow(c("_end") / c("ltp"), F.lit(0.2)) - 1.0) * 100.0))
    lasting = F.coalesce(c("moat_rating") == "Wide", F.lit(False)) & (c("profit_streak_years") >= 5) & (c("dividend_status") == "SAFE_ORGANIC")
    return d.select(
        "symbol", v.decision_verdict(c("margin_of_safety_pct"), c("zone"), c("eps_basic"), c("debt_to_equity")).alias("verdict"),
        v.entry_price(c("blended_target")).alias("suggested_entry_price"), F.coalesce(c("_storm") & lasting, F.lit(False)).alias("can_buy_and_forget"),
        c("_storm").alias("is_storm_proof"), "profit_streak_years", F.coalesce(c("eps_basic") > 0, F.lit(False)).alias("is_profit_making"),
        v.category_quality(c("category")).alias("category_quality"), c("_d3").alias("projected_dividends_3y"), c("_d10").alias("projected_dividends_10y"),
        c("_f5").alias("projected_fair_value_5y"), num.to_fixed(c("_ret")).alias("expected_annual_return_pct"),
    )


def technical_fusion(decisions: DataFrame, zones: DataFrame) -> DataFrame:
    """Value verdict and momentum zone in one timing signal."""
    j = decisions.select("symbol", "verdict").join(zones.select("symbol", "rsi_14", "rsi_zone"), "symbol", "left")
    return j.withColumn("timing", v.timing_verdict(c("verdict"), c("rsi_zone")))


def valuation_snapshot(statements: DataFrame, roster: DataFrame, prices: DataFrame, index: DataFrame, *, as_of) -> DataFrame:
    """The daily valuation table: one row per symbol."""
    out = with_models(latest_with_price(statements, prices), returns.risk_metrics(prices, index))
    out = num.with_rounded(out.join(market.volume_velocity(prices), "symbol", "left"), {"leverage_ratio": leverage_ratio(None)})
    out = num.with_rounded(out, {"payout_ratio": v.payout_pct(c("dps"), c("eps_basic"), None)}, 1).withColumns(
        {
            "equity_mn": c("total_assets_mn") - c("total_liabilities_mn"), "moat_rating": moat_column(c("leverage_ratio")), "piotroski_score": piotroski_columns()["score"], "piotroski_rating": piotroski_columns()["rating"],
        }
    )
    return out.select(
        "symbol", c("ltp").alias("close"), "market_cap_mn", "graham_number", "peter_lynch_fair_value", "ddm_fair_value", "dcf_intrinsic_value", "blended_target",
        "margin_of_safety_pct", v.valuation_verdict(c("margin_of_safety_pct")).alias("valuation_verdict"), c("leverage_ratio").alias("debt_to_equity"), "piotroski_score",
        "moat_rating", "volatility_pct", "beta", "sharpe_ratio", "volume_velocity", "eps_cagr", "navps_cagr", "dps_cagr", "dividend_yield", "payout_ratio",
        v.graham_status(c("eps_basic"), c("nav_per_share")).alias("graham_status"), v.solvency_badge(c("equity_mn"), c("leverage_ratio")).alias("solvency_badge"),
        v.piotroski_badge(c("piotroski_rating")).alias("piotroski_badge"), F.lit(as_of).cast("date").alias("updated_at"),
    )


def dividend_statistics(statements: DataFrame) -> DataFrame:
    """Dividends per year with payout, and their sum. The series is bounded by the number of fiscal years."""
    payout = F.when(c("eps_basic") != 0, num.to_fixed(c("dps") / c("eps_basic") * 100.0))
    rows = statements.filter(c("dps").isNotNull()).select("symbol", F.struct(c("fiscal_year").alias("year"), "dps", payout.alias("payout_pct")).alias("r"))
    g = rows.groupBy("symbol").agg(F.array_sort(F.collect_list("r")).alias("series"))
    total = F.aggregate("series", F.lit(0.0), lambda a, r: a + r["dps"])
    return g.select("symbol", "series", num.to_fixed(total).alias("total_per_share"))


def deep_dive(statements: DataFrame, roster: DataFrame, prices: DataFrame, index: DataFrame, shareholding: DataFrame, daily_pe: DataFrame) -> DataFrame:
    """Everything known about a symbol as nested blocks, with its whole timeline.

    The timeline array has one element per calendar day of the symbol, which bounds a row.
    """
    latest = latest_with_price(statements, prices)
    sample = market.pe_sample(daily_pe, statements)
    corridor = market.percentile_floor(sample)
    current = latest.select("symbol", F.when(c("eps_basic") > 0, num.to_fixed(c("ltp") / c("eps_basic"))).alias("current_pe"))
    rank = market.pe_percentile_rank(sample, current)
    pe_block = corridor.join(current, "symbol", "left").join(rank, "symbol", "left").select(
        "symbol",
        F.struct("current_pe", "p25", "median", "p75", "pe_percentile_rank", labels.valuation_status(c("pe_percentile_rank")).alias("status")).alias("valuation_corridor"),
    )
    hl = market.all_time_high_low(prices)
    extremes = hl.select(
        "symbol", F.struct(c("ath_price").alias("price"), c("ath_date").alias("date"), "drawdown_pct").alias("ath"),
        F.struct(c("atl_price").alias("price"), c("atl_date").alias("date"), "rise_pct").alias("atl"),
    )
    block = lambda df, name: df.select("symbol", F.struct(*[x for x in df.columns if x != "symbol"]).alias(name))
    many = lambda df, name, order: df.groupBy("symbol").agg(
        F.array_sort(F.collect_list(F.struct(order, *[x for x in df.columns if x not in ("symbol", order)]))).alias(name)
    )
    timeline = prices.select("symbol", "date", c("close").alias("price"), "volume").join(level_per_day(index), "date", "left")
    stmts = statements.select("symbol", "fiscal_year", "eps_basic", "nav_per_share", "roe", "dividend_yield", "dps", "pe_ratio", "audit_status")
    holders = shareholding.select("symbol", *[f"{h}_pct" for h in HOLDERS])
    growth = growth_rates(latest).select("symbol", "eps_cagr", "navps_cagr")
    disclosures = latest.select("symbol", "eps_basic", "nav_per_share", "paid_up_capital_mn", "market_cap_mn", "dividend_yield")
    blocks = [
        extremes, block(indicators.max_drawdown(prices), "max_drawdown"), block(indicators.trend(prices), "technical"), pe_block,
        block(pe_mean_reversion(latest, corridor), "mean_reversion"), block(graham(latest), "graham"), block(disclosures, "disclosures"),
        block(returns.risk_metrics(prices, index), "risk_metrics"), many(returns.returns_table(prices, statements), "returns_table", "period"),
        block(growth, "fundamentals_growth"), block(indicators.week52(prices), "week52"), block(market.liquidity_profile(prices), "liquidity"),
        many(indicators.sector_pe_percentile(statements, roster).drop("sector"), "sector_percentile_trend", "fiscal_year"), block(holders, "shareholding"),
        many(stmts, "financial_statements", "fiscal_year"), many(timeline, "timeline", "date"),
    ]
    head = roster.select("symbol", "name", "sector", "category").join(latest.select("symbol", "ltp"), "symbol", "left")
    return reduce(lambda a, b: a.join(b, "symbol", "left"), blocks, head)
