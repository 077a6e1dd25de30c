"""Valuation, quality and decision frames (family M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from bourselake.operators import market, recursions, returns, valuation
from bourselake.plans.catalog import query
from bourselake.plans.catalog_series import _ATR, _LONG, _RSI  # noqa: F401
from bourselake.plans.oracle import VIEWS, fx

FIN = ("AFRICA",)

VIEWS["lat"] = (
    ("statements", "bars"),
    f"""SELECT s.*, {fx("(year_end_close * CAST(shares AS DOUBLE) / 1e6::DOUBLE)")} AS market_cap_mn, p.ltp FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY fiscal_year DESC) AS rn FROM statements) WHERE rn = 1) s
        LEFT JOIN (SELECT symbol, arg_max(close, date) AS ltp FROM bars GROUP BY symbol) p USING (symbol)""",
)


def _growth(field: str, name: str) -> str:
    return f"""SELECT symbol, {fx("g")} AS {name}_cagr FROM (SELECT symbol, (pow(arg_max({field}, fiscal_year) / arg_min({field}, fiscal_year), 1.0::DOUBLE / CAST(max(fiscal_year) - min(fiscal_year) AS DOUBLE)) - 1.0::DOUBLE) * 100.0::DOUBLE AS g
      FROM statements WHERE {field} > 0 GROUP BY symbol HAVING max(fiscal_year) > min(fiscal_year))"""


VIEWS["growth"] = (
    ("statements",),
    f"""SELECT symbol, eps_cagr, navps_cagr, dps_cagr, fcf_cagr FROM ({_growth("eps_basic", "eps")}) FULL JOIN ({_growth("nav_per_share", "navps")}) USING (symbol)
        FULL JOIN ({_growth("dps", "dps")}) USING (symbol) FULL JOIN ({_growth("free_cash_flow_mn", "fcf")}) USING (symbol)""",
)
VIEWS["risk"] = (
    ("bars", "market_index"),
    f"""SELECT symbol, {fx("vol")} AS volatility_pct, {fx("b")} AS beta, CASE WHEN y > 0.5 AND vol > 0 THEN {fx("((g - 11.5::DOUBLE) / vol)")} END AS sharpe_ratio FROM (
          SELECT symbol, CASE WHEN n >= 30 THEN sd * sqrt(252.0::DOUBLE) * 100.0::DOUBLE END AS vol, CASE WHEN n >= 30 AND pairs >= 30 AND ivar > 0 THEN cov / ivar END AS b,
            (pow(l / f, 1.0::DOUBLE / y) - 1.0::DOUBLE) * 100.0::DOUBLE AS g, y FROM (
            SELECT symbol, count(r) AS n, stddev_pop(r) AS sd, count(ir) AS pairs, covar_pop(r, ir) AS cov, var_pop(ir) AS ivar, arg_min(close, date) AS f, arg_max(close, date) AS l,
              CAST(max(date) - min(date) AS DOUBLE) / 365.25::DOUBLE AS y FROM (
              SELECT symbol, date, close, CASE WHEN p0 > 0 THEN (close - p0) / p0 END AS r, CASE WHEN p0 > 0 AND i0 > 0 THEN (index_value - i0) / i0 END AS ir FROM (
                SELECT b.symbol, b.date, b.close, i.index_value, lag(b.close) OVER w AS p0, lag(i.index_value) OVER w AS i0 FROM bars b LEFT JOIN market_index i ON i.date = b.date
                WINDOW w AS (PARTITION BY b.symbol ORDER BY b.date))) GROUP BY symbol))""",
)
_DE = fx("((short_term_loan_mn + long_term_loan_mn) / (paid_up_capital_mn + reserve_surplus_mn + oci_mn))")
VIEWS["lev"] = (("lat",), f"SELECT symbol, CASE WHEN paid_up_capital_mn + reserve_surplus_mn + oci_mn > 0 THEN {_DE} END AS debt_to_equity FROM lat")


def _corr(field: str, p: str) -> str:
    return f"""SELECT symbol, {fx("m")} AS {p}_mean, {fx("(m - sd)")} AS {p}_low, {fx("(m + sd)")} AS {p}_high, n AS {p}_sample_count,
      'Calculated from last ' || n || ' years of annual data (FY' || a || '-FY' || b || ')' AS {p}_note FROM (
      SELECT symbol, avg({field}) AS m, stddev_pop({field}) AS sd, count(*) AS n, min(fiscal_year) AS a, max(fiscal_year) AS b FROM (
        SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY fiscal_year DESC) AS k FROM statements WHERE {field} > 0) WHERE k <= 5 GROUP BY symbol)"""


VIEWS["corr"] = (("statements",), f"SELECT * FROM ({_corr('pe_ratio', 'pe')}) FULL JOIN ({_corr('pb_ratio', 'pb')}) USING (symbol)")
_GRAHAM = "CASE WHEN eps_basic > 0 AND nav_per_share > 0 THEN " + fx("sqrt(22.5::DOUBLE * eps_basic * nav_per_share)") + " END"


def _mos(value: str, price: str) -> str:
    return f"CASE WHEN {value} > 0 AND {price} > 0 THEN {fx(f'(({value} - {price}) / {value} * 100.0::DOUBLE)')} END"


@query("m1_graham", "lat", f"SELECT symbol, ltp, graham_number, {_mos('graham_number', 'ltp')} AS margin_of_safety_pct FROM (SELECT symbol, ltp, {_GRAHAM} AS graham_number FROM lat)")
def _(m):
    return valuation.graham(valuation.latest_with_price(m.statements, m.bars))


@query(
    "m2_yield_spread", "lat",
    f"""SELECT symbol, pe, earnings_yield, {fx("(earnings_yield - 11.5::DOUBLE)")} AS bond_spread FROM (SELECT symbol, pe, CASE WHEN pe > 0 THEN {fx("(1.0::DOUBLE / pe * 100.0::DOUBLE)")} END AS earnings_yield FROM (
          SELECT symbol, CASE WHEN eps_basic > 0 THEN {fx("(ltp / eps_basic)")} END AS pe FROM lat))""",
)
def _(m):
    return valuation.yield_spread(valuation.latest_with_price(m.statements, m.bars))


_SAMPLE = "SELECT symbol, pe FROM (SELECT symbol, pe FROM prices_dirty UNION ALL SELECT symbol, pe_ratio FROM statements) WHERE pe > 0 AND pe < 120"
VIEWS["pe_mid"] = (
    ("prices_dirty", "statements"),
    f"SELECT symbol, {fx('x')} AS median FROM (SELECT symbol, l[1 + CAST(floor(n * 0.5) AS BIGINT)] AS x FROM (SELECT symbol, list(pe ORDER BY pe) AS l, count(*) AS n FROM ({_SAMPLE}) GROUP BY symbol))",
)


def _up(t: str) -> str:
    return f"CASE WHEN ltp > 0 THEN {fx(f'(({t} - ltp) / ltp * 100.0::DOUBLE)')} END"


@query(
    "m3_pe_mean_reversion", "lat pe_mid",
    f"SELECT symbol, median, target_price, {_up('target_price')} AS upside_pct FROM (SELECT symbol, ltp, median, CASE WHEN eps_basic > 0 THEN {fx('(median * eps_basic)')} END AS target_price FROM lat JOIN pe_mid USING (symbol))",
)
def _(m):
    corridor = market.percentile_floor(market.pe_sample(m.prices_dirty, m.statements))
    return valuation.pe_mean_reversion(valuation.latest_with_price(m.statements, m.bars), corridor)


_LYNCH = f"SELECT symbol, CASE WHEN eps_basic > 0 AND eps_cagr > 0 THEN {fx('(eps_basic * least(eps_cagr, 50.0::DOUBLE))')} END AS peter_lynch_fair_value FROM lat LEFT JOIN growth USING (symbol)"


@query("m4_peter_lynch", "lat growth", _LYNCH)
def _(m):
    return valuation.peter_lynch(valuation.statement_facts(m.statements))


_DDM = f"""SELECT symbol, {fx("(ke * 100.0::DOUBLE)")} AS cost_of_equity_pct, CASE WHEN dps > 0 AND roe IS NOT NULL AND po IS NOT NULL THEN {fx("(dps * (1.0::DOUBLE + g) / (ke - g))")} END AS ddm_fair_value FROM (
  SELECT *, least(greatest(roe / 100.0::DOUBLE * (1.0::DOUBLE - po), 0.0::DOUBLE), ke - 0.02::DOUBLE) AS g FROM (
    SELECT symbol, dps, roe, CASE WHEN eps_basic > 0 AND dps IS NOT NULL THEN least(dps / eps_basic, 1.0::DOUBLE) WHEN eps_basic > 0 THEN 1.0::DOUBLE END AS po, 0.1037::DOUBLE + coalesce(beta, 1.0::DOUBLE) * 0.055::DOUBLE AS ke FROM lat LEFT JOIN risk USING (symbol)))"""


@query("m5_ddm", "lat risk", _DDM)
def _(m):
    return valuation.ddm(valuation.statement_facts(m.statements), returns.risk_metrics(m.bars, m.index))


_K = "(0.1037::DOUBLE + 0.055::DOUBLE)"
_STAGE = " + ".join(f"pow(q, {t}.0::DOUBLE)" for t in range(1, 11))
_DCF = f"""SELECT symbol, fcf_per_share, CASE WHEN fcf_per_share > 0 AND fcf_cagr IS NOT NULL THEN {fx("w")} END AS dcf_intrinsic_value FROM (
  SELECT *, fcf_per_share * ({_STAGE} + pow(q, 10.0::DOUBLE) * (1.04::DOUBLE / ({_K} - 0.04::DOUBLE))) AS w FROM (
    SELECT symbol, CASE WHEN shares > 0 THEN free_cash_flow_mn * 1e6::DOUBLE / CAST(shares AS DOUBLE) END AS fcf_per_share, fcf_cagr, (1.0::DOUBLE + fcf_cagr / 100.0::DOUBLE) / (1.0::DOUBLE + {_K}) AS q
    FROM lat LEFT JOIN growth USING (symbol)))"""


@query("m6_dcf", "lat growth", _DCF)
def _(m):
    return valuation.dcf(valuation.statement_facts(m.statements))


@query("m7_leverage", "lev", "SELECT symbol, debt_to_equity, CASE WHEN debt_to_equity < 0.5 THEN 'LOW' WHEN debt_to_equity > 1.2 THEN 'HIGH' WHEN debt_to_equity IS NOT NULL THEN 'MODERATE' END AS leverage FROM lev")
def _(m):
    return valuation.leverage(valuation.statement_facts(m.statements))


@query("m8_corridors", "corr", "SELECT * FROM corr")
def _(m):
    return valuation.corridors(valuation.statement_facts(m.statements))


_PB = f"SELECT symbol, pb_mean, target_price, {_up('target_price')} AS upside_pct FROM (SELECT symbol, ltp, pb_mean, CASE WHEN nav_per_share > 0 THEN {fx('(pb_mean * nav_per_share)')} END AS target_price FROM lat JOIN corr USING (symbol))"


@query("m9_pb_mean_reversion", "lat corr", _PB)
def _(m):
    return valuation.pb_mean_reversion(valuation.latest_with_price(m.statements, m.bars))


_SIG = {
    "positive_roa": "roa > 0", "positive_cfo": "cfo > 0", "roa_improving": "roa > p_roa", "cfo_above_income": "cfo > ni", "leverage_falling": "lev < p_lev",
    "liquidity_improving": "cr > p_cr", "no_new_shares": "cap <= p_cap", "margin_improving": "gm > p_gm", "turnover_improving": "tov > p_tov",
}
VIEWS["pio"] = (
    ("statements",),
    f"""SELECT *, CASE WHEN score / max_score >= 7.0::DOUBLE / 9.0::DOUBLE THEN 'Strong' WHEN score / max_score >= 4.0::DOUBLE / 9.0::DOUBLE THEN 'Moderate' ELSE 'Weak' END AS rating FROM (
      SELECT symbol, fiscal_year, {", ".join(f"{e} AS {n}" for n, e in _SIG.items())}, {" + ".join(f"coalesce(CAST({e} AS INTEGER), 0)" for e in _SIG.values())} AS score,
        {" + ".join(f"CAST(({e}) IS NOT NULL AS INTEGER)" for e in _SIG.values())} AS max_score FROM (
        SELECT *, {", ".join(f"lag({x}) OVER w AS p_{x}" for x in ("roa", "lev", "cr", "cap", "gm", "tov"))}, row_number() OVER (PARTITION BY symbol ORDER BY fiscal_year DESC) AS k FROM (
          SELECT symbol, fiscal_year, paid_up_capital_mn AS cap, operating_cash_flow_mn AS cfo, net_income_mn AS ni, net_income_mn / total_assets_mn AS roa,
            (short_term_loan_mn + long_term_loan_mn) / total_assets_mn AS lev, current_assets_mn / current_liabilities_mn AS cr, gross_profit_mn / revenue_mn AS gm, revenue_mn / total_assets_mn AS tov FROM statements)
        WINDOW w AS (PARTITION BY symbol ORDER BY fiscal_year)) WHERE k = 1)""",
)


@query("m10_piotroski", "pio", "SELECT * FROM pio")
def _(m):
    return valuation.piotroski(valuation.statement_facts(m.statements))


VIEWS["moat"] = (
    ("statements", "lev"),
    f"""SELECT symbol, {fx("r")} AS avg_roe, p AS all_profitable, d AS all_paid, CASE WHEN r >= 20 AND debt_to_equity < 0.5 AND p AND d THEN 'Wide' WHEN r >= 12 AND p THEN 'Narrow' WHEN r IS NOT NULL THEN 'None' END AS moat_rating
        FROM (SELECT symbol, avg(roe) AS r, bool_and(coalesce(eps_basic > 0, false)) AS p, bool_and(coalesce(dps > 0, false)) AS d FROM (
          SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY fiscal_year DESC) AS k FROM statements) WHERE k <= 5 GROUP BY symbol) LEFT JOIN lev USING (symbol)""",
)


@query("m11_moat", "moat", "SELECT * FROM moat")
def _(m):
    return valuation.moat(valuation.statement_facts(m.statements))


def _pct(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN {fx(f'({a} / {b} * 100.0::DOUBLE)')} END"


@query(
    "m12_operating_ratios", "lat",
    f"""SELECT symbol, fiscal_year, CASE WHEN revenue_mn > 0 THEN {fx("(market_cap_mn / revenue_mn)")} END AS price_to_sales, {_pct("net_income_mn", "total_assets_mn")} AS return_on_assets_pct,
          {_pct("gross_profit_mn", "revenue_mn")} AS gross_margin_pct, {_pct("operating_profit_mn", "revenue_mn")} AS operating_margin_pct,
          CASE WHEN current_liabilities_mn > 0 THEN {fx("(current_assets_mn / current_liabilities_mn)")} END AS current_ratio, {fx("(current_assets_mn - current_liabilities_mn)")} AS working_capital_mn FROM lat""",
)
def _(m):
    return valuation.operating_ratios(valuation.statement_facts(m.statements))


_EQ = "(total_assets_mn - total_liabilities_mn)"


@query(
    "m13_dupont", "statements",
    f"""SELECT symbol, fiscal_year, CASE WHEN ok THEN {fx("(net_income_mn / revenue_mn * 100.0::DOUBLE)")} END AS net_margin_pct, CASE WHEN ok THEN {fx("(revenue_mn / total_assets_mn)")} END AS asset_turnover,
          CASE WHEN ok THEN {fx("(total_assets_mn / eq)")} END AS equity_multiplier, CASE WHEN ok THEN {fx("(net_income_mn / eq * 100.0::DOUBLE)")} END AS roe_pct
        FROM (SELECT *, {_EQ} AS eq, revenue_mn > 0 AND total_assets_mn > 0 AND {_EQ} > 0 AND net_income_mn IS NOT NULL AS ok FROM statements)""",
)
def _(m):
    return valuation.dupont(m.statements)


@query("m14_free_cash_flow", "statements", f"SELECT symbol, fiscal_year, {fx('(operating_cash_flow_mn - capex_mn)')} AS free_cash_flow_mn FROM statements")
def _(m):
    return valuation.cash_flow(m.statements)


_Z = f"6.56::DOUBLE * ((current_assets_mn - current_liabilities_mn) / total_assets_mn) + 3.26::DOUBLE * (reserve_surplus_mn / total_assets_mn) + 6.72::DOUBLE * (operating_profit_mn / total_assets_mn) + 1.05::DOUBLE * ({_EQ} / total_liabilities_mn)"
VIEWS["alt"] = (
    ("lat", "roster"),
    f"""SELECT symbol, sector, f AS is_financial, altman_z, CASE WHEN f THEN 'NOT_APPLICABLE' WHEN altman_z > 2.6 THEN 'SAFE' WHEN altman_z < 1.1 THEN 'DISTRESS' WHEN altman_z IS NOT NULL THEN 'GREY' END AS zone FROM (
          SELECT symbol, sector, f, CASE WHEN NOT f AND total_assets_mn > 0 AND total_liabilities_mn > 0 THEN {fx("z")} END AS altman_z FROM (
            SELECT l.*, r.sector, coalesce(r.sector = 'AFRICA', false) AS f, {_Z} AS z FROM lat l LEFT JOIN roster r USING (symbol)))""",
)


@query("m15_altman", "alt", "SELECT * FROM alt")
def _(m):
    return valuation.altman(valuation.statement_facts(m.statements), m.roster, FIN)


_PAY = "CASE WHEN eps_basic > 0 THEN " + fx("(dps / eps_basic * 100.0::DOUBLE)", 1) + " END"
_DST = "CASE WHEN coalesce(dps, 0) <= 0 THEN 'NO_DIVIDEND' WHEN eps_basic <= 0 THEN 'DIVIDEND_TRAP' WHEN dps > eps_basic THEN 'RESERVE_DEPLETING' WHEN eps_basic IS NOT NULL THEN 'SAFE_ORGANIC' END"


@query("m16_dividend_sustainability", "lat", f"SELECT *, status = 'SAFE_ORGANIC' AS is_sustainable, status = 'DIVIDEND_TRAP' AS is_trap FROM (SELECT symbol, dps, eps_basic, {_PAY} AS payout_pct, {_DST} AS status FROM lat)")
def _(m):
    return valuation.dividend_sustainability(valuation.statement_facts(m.statements))


@query(
    "m17_smart_money", "shareholding block_trades",
    f"""SELECT symbol, p AS smart_money_pct, CASE WHEN p >= 40 THEN 'HIGH_INSTITUTIONAL' WHEN public_pct >= 60 THEN 'RETAIL_DOMINATED' WHEN p IS NOT NULL THEN 'BALANCED' END AS status, coalesce(n, 0) AS block_trade_count
        FROM (SELECT *, {fx("(institute_pct + foreign_pct)")} AS p FROM shareholding) LEFT JOIN (SELECT symbol, count(*) AS n FROM block_trades GROUP BY symbol) USING (symbol)""",
)
def _(m):
    return valuation.smart_money(m.shareholding, m.block_trades)


_MODELS = ("graham_number", "peter_lynch_fair_value", "ddm_fair_value", "dcf_intrinsic_value", "pb_target")
_SUMV = " + ".join(f"coalesce({x}, 0.0::DOUBLE)" for x in _MODELS)
_CNT = " + ".join(f"CAST({x} IS NOT NULL AS INTEGER)" for x in _MODELS)
VIEWS["models"] = (
    ("lat", "growth", "risk", "corr"),
    f"""SELECT *, {_mos("blended_target", "ltp")} AS margin_of_safety_pct FROM (SELECT *, CASE WHEN {_CNT} > 0 THEN {fx(f"(({_SUMV}) / ({_CNT}))")} END AS blended_target FROM (
          SELECT l.symbol, l.ltp, l.eps_basic, l.nav_per_share, {_GRAHAM.replace("eps_basic", "l.eps_basic").replace("nav_per_share", "l.nav_per_share")} AS graham_number, peter_lynch_fair_value, ddm_fair_value, dcf_intrinsic_value, pb.target_price AS pb_target
          FROM lat l LEFT JOIN ({_LYNCH}) USING (symbol) LEFT JOIN ({_DDM}) USING (symbol) LEFT JOIN ({_DCF}) USING (symbol) LEFT JOIN ({_PB}) pb USING (symbol)))""",
)


@query("m20_intrinsic_models", "models", "SELECT * FROM models")
def _(m):
    return valuation.valuation_models(m.statements, m.bars, returns.risk_metrics(m.bars, m.index))


def _grown(n: int) -> str:
    return "(dps * (" + " + ".join(f"pow(dg, {t}.0::DOUBLE)" for t in range(1, n + 1)) + "))"


VIEWS["decision"] = (
    ("models", "lat", "lev", "alt", "moat", "growth", "roster", "statements"),
    f"""SELECT *, CASE WHEN ltp > 0 AND projected_fair_value_5y + coalesce(d5, 0.0::DOUBLE) > 0 THEN {fx("((pow((projected_fair_value_5y + coalesce(d5, 0.0::DOUBLE)) / ltp, 0.2::DOUBLE) - 1.0::DOUBLE) * 100.0::DOUBLE)")} END AS expected_annual_return_pct FROM (
      SELECT symbol, ltp, CASE WHEN coalesce(zone = 'DISTRESS', false) OR coalesce(eps_basic <= 0 AND debt_to_equity > 1.2, false) THEN 'AVOID_DISTRESS' WHEN margin_of_safety_pct >= 20 THEN 'STRONG_BUY'
          WHEN margin_of_safety_pct >= 5 THEN 'ACCUMULATE' WHEN margin_of_safety_pct >= -15 THEN 'HOLD' WHEN margin_of_safety_pct IS NOT NULL THEN 'REDUCE' ELSE 'INSUFFICIENT_DATA' END AS verdict,
        {fx("(blended_target * 0.82::DOUBLE)")} AS suggested_entry_price, storm AND coalesce(moat_rating = 'Wide', false) AND profit_streak_years >= 5 AND dst = 'SAFE_ORGANIC' AS can_buy_and_forget, storm AS is_storm_proof,
        profit_streak_years, coalesce(eps_basic > 0, false) AS is_profit_making, 'Category ' || category AS category_quality, {fx("p3")} AS projected_dividends_3y, {fx("p10")} AS projected_dividends_10y, {fx("p5")} AS d5, {fx("f5")} AS projected_fair_value_5y
      FROM (SELECT *, {_grown(3)} AS p3, {_grown(5)} AS p5, {_grown(10)} AS p10, blended_target * pow(1.0::DOUBLE + coalesce(eps_cagr, 0.0::DOUBLE) / 100.0::DOUBLE, 5.0::DOUBLE) AS f5 FROM (
        SELECT m.*, v.debt_to_equity, a.zone, t.moat_rating, l.dps, {_DST.replace("eps_basic", "l.eps_basic").replace("dps", "l.dps")} AS dst, g.eps_cagr, 1.0::DOUBLE + coalesce(g.dps_cagr, 0.0::DOUBLE) / 100.0::DOUBLE AS dg, r.category, k.n AS profit_streak_years,
          coalesce(v.debt_to_equity < 0.5, false) AND coalesce(a.zone IN ('SAFE', 'NOT_APPLICABLE'), false) AS storm
        FROM models m LEFT JOIN lat l USING (symbol) LEFT JOIN lev v USING (symbol) LEFT JOIN alt a USING (symbol) LEFT JOIN moat t USING (symbol) LEFT JOIN growth g USING (symbol) LEFT JOIN roster r USING (symbol)
        LEFT JOIN (SELECT symbol, count(*) FILTER (fiscal_year > coalesce(loss, 0)) AS n FROM (SELECT symbol, fiscal_year, max(CASE WHEN NOT coalesce(eps_basic > 0, false) THEN fiscal_year END) OVER (PARTITION BY symbol) AS loss FROM statements) GROUP BY symbol) k USING (symbol))))""",
)
_DEC = "symbol, verdict, suggested_entry_price, can_buy_and_forget, is_storm_proof, profit_streak_years, is_profit_making, category_quality, projected_dividends_3y, projected_dividends_10y, projected_fair_value_5y, expected_annual_return_pct"


def _decisions(m):
    return valuation.decision_summary(m.statements, m.roster, m.bars, returns.risk_metrics(m.bars, m.index), financial=FIN)


@query("m18_decision_summary", "decision", f"SELECT {_DEC} FROM decision")
def _(m):
    return _decisions(m)


@query(
    "m19_technical_fusion", "decision bars",
    f"""WITH {_RSI}, z AS (SELECT s.symbol, {fx("r")} AS rsi_14 FROM (SELECT DISTINCT symbol FROM bars) s LEFT JOIN (SELECT symbol, arg_max(r, rn) AS r FROM rs GROUP BY symbol) USING (symbol)),
        y AS (SELECT *, CASE WHEN rsi_14 IS NULL THEN 'INSUFFICIENT_DATA' WHEN rsi_14 < 30 THEN 'OVERSOLD' WHEN rsi_14 > 70 THEN 'OVERBOUGHT' ELSE 'NEUTRAL' END AS rsi_zone FROM z)
        SELECT symbol, verdict, rsi_14, rsi_zone, CASE WHEN verdict IN ('STRONG_BUY', 'ACCUMULATE') AND rsi_zone = 'OVERSOLD' THEN 'SNIPER_BUY' WHEN verdict IN ('STRONG_BUY', 'ACCUMULATE') THEN 'VALUE_WAIT_FOR_DIP'
          WHEN rsi_zone = 'OVERBOUGHT' THEN 'TAKE_PROFIT' ELSE 'NEUTRAL' END AS timing FROM decision LEFT JOIN y USING (symbol)""",
)
def _(m):
    zones = recursions.latest_rsi_zone(recursions.recursive_indicators(m.bars), m.bars)
    return valuation.technical_fusion(_decisions(m), zones)


_VV = f"(SELECT symbol, {fx('x')} AS volume_velocity FROM (SELECT symbol, avg(volume) FILTER (rn <= 5) / avg(volume) FILTER (rn > 5) AS x FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM bars) WHERE rn <= 25 GROUP BY symbol))"
_SNAP = f"""SELECT m.symbol, m.ltp AS close, l.market_cap_mn, m.graham_number, m.peter_lynch_fair_value, m.ddm_fair_value, m.dcf_intrinsic_value, m.blended_target, m.margin_of_safety_pct,
  CASE WHEN m.margin_of_safety_pct IS NULL THEN 'Neutral' WHEN m.margin_of_safety_pct >= 15 THEN 'Undervalued' WHEN m.margin_of_safety_pct >= -15 THEN 'Fairly Valued' ELSE 'Overvalued' END AS valuation_verdict,
  v.debt_to_equity, p.score AS piotroski_score, t.moat_rating, r.volatility_pct, r.beta, r.sharpe_ratio, vv.volume_velocity, g.eps_cagr, g.navps_cagr, g.dps_cagr, l.dividend_yield,
  {_PAY.replace("eps_basic", "l.eps_basic").replace("dps", "l.dps")} AS payout_ratio,
  CASE WHEN m.eps_basic > 0 AND m.nav_per_share > 0 THEN 'VIABLE' WHEN m.eps_basic <= 0 AND m.nav_per_share <= 0 THEN 'DISTRESSED_DUAL_NEGATIVE' WHEN m.eps_basic <= 0 THEN 'NEGATIVE_EARNINGS' WHEN m.nav_per_share <= 0 THEN 'NEGATIVE_NET_ASSETS' ELSE 'INSUFFICIENT_DATA' END AS graham_status,
  CASE WHEN l.total_assets_mn - l.total_liabilities_mn < 0 THEN '🚨 Critical Distress / Negative Equity' WHEN v.debt_to_equity > 1.2 THEN 'High Leverage' WHEN v.debt_to_equity < 0.5 THEN 'Low Leverage' WHEN v.debt_to_equity IS NOT NULL THEN 'Moderate Leverage' END AS solvency_badge,
  CASE p.rating WHEN 'Strong' THEN 'Excellent Quality' WHEN 'Moderate' THEN 'Stable Health' WHEN 'Weak' THEN 'Weak Health' END AS piotroski_badge, (SELECT d FROM asof_day) AS updated_at
  FROM models m LEFT JOIN lat l USING (symbol) LEFT JOIN lev v USING (symbol) LEFT JOIN pio p USING (symbol) LEFT JOIN moat t USING (symbol) LEFT JOIN risk r USING (symbol) LEFT JOIN {_VV} vv USING (symbol) LEFT JOIN growth g USING (symbol)"""


def _snapshot(m):
    m.settle("bars", "statements", "index")
    return valuation.valuation_snapshot(m.statements, m.roster, m.bars, m.index, as_of=m.as_of)


@query("m20_valuation_snapshot", "models lat lev pio moat risk growth bars asof_day", _SNAP)
def valuation_snapshot(m):
    return _snapshot(m)


@query(
    "k14_valuation_audit", "models lat lev pio moat risk growth bars asof_day",
    f"""SELECT 'valuation' AS entity, 'error' AS severity, 'bad_close' AS "check", symbol AS key FROM (SELECT * REPLACE (CASE WHEN valuation_verdict = 'Neutral' OR symbol LIKE '%7' THEN 0.0::DOUBLE ELSE close END AS close) FROM ({_SNAP})) WHERE NOT coalesce(close > 0, false)
        UNION ALL SELECT 'valuation', 'error', 'unknown_moat', symbol FROM ({_SNAP}) WHERE symbol LIKE '%3'""",
)
def _(m):
    from bourselake.operators import audits

    s = _snapshot(m)
    zero = (F.col("valuation_verdict") == "Neutral") | F.col("symbol").like("%7")
    s = s.withColumn("close", F.when(zero, F.lit(0.0)).otherwise(F.col("close"))).withColumn("moat_rating", F.when(F.col("symbol").like("%3"), "Huge").otherwise(F.col("moat_rating")))
    return audits.findings(audits.audit_valuation(s), "valuation", F.col("symbol"))


@query(
    "m21_deep_dive", "lat roster bars prices_dirty statements shareholding market_index",
    f"""SELECT r.symbol, r.name, r.sector, l.ltp, (SELECT max(close) FROM bars b WHERE b.symbol = r.symbol) AS ath_price, (SELECT count(*) FROM bars b WHERE b.symbol = r.symbol) AS timeline_days,
          (SELECT count(i.index_value) FROM bars b LEFT JOIN market_index i USING (date) WHERE b.symbol = r.symbol) AS days_with_index, (SELECT count(*) FROM statements s WHERE s.symbol = r.symbol) AS statement_years,
          {_GRAHAM} AS graham_number, h.public_pct, (SELECT min(date) FROM bars b WHERE b.symbol = r.symbol) AS first_day
        FROM roster r LEFT JOIN lat l USING (symbol) LEFT JOIN shareholding h USING (symbol)""",
)
def _(m):
    d = deep_dive(m)
    with_index = F.size(F.filter("timeline", lambda t: t["index_value"].isNotNull()))
    return d.select(
        "symbol", "name", "sector", "ltp", F.col("ath.price").alias("ath_price"), F.size("timeline").alias("timeline_days"), with_index.alias("days_with_index"),
        F.size("financial_statements").alias("statement_years"), F.col("graham.graham_number").alias("graham_number"), F.col("shareholding.public_pct").alias("public_pct"),
        F.element_at("timeline", 1)["date"].alias("first_day"),
    )


def deep_dive(m):
    m.settle("bars", "statements", "index")
    return valuation.deep_dive(m.statements, m.roster, m.bars, m.index, m.shareholding, m.prices_dirty)


@query(
    "m22_dividend_statistics", "statements",
    f"""SELECT symbol, count(*) AS years, {fx("sum(dps ORDER BY fiscal_year)")} AS total_per_share, {fx("arg_max(CASE WHEN eps_basic <> 0 THEN dps / eps_basic * 100.0::DOUBLE END, fiscal_year)")} AS last_payout_pct
        FROM statements WHERE dps IS NOT NULL GROUP BY symbol""",
)
def _(m):
    d = valuation.dividend_statistics(m.statements)
    return d.select("symbol", F.size("series").alias("years"), "total_per_share", F.element_at("series", -1)["payout_pct"].alias("last_payout_pct"))
