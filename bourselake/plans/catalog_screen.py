"""Lookups, joins and aggregates (families D, E, F)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from bourselake.functions import labels
from bourselake.functions import numbers as num
from bourselake.operators import asof, lookups, market
from bourselake.operators.lookups import one_row_per_day
from bourselake.plans.catalog import query
from bourselake.plans.oracle import fx, tier

_LATEST_FUND = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY fiscal_year DESC) AS rn FROM fundamentals) WHERE rn = 1"""
_LATEST_PRICE = """SELECT p.* FROM prices p JOIN (SELECT symbol, max(date) AS d FROM prices GROUP BY symbol) x ON p.symbol = x.symbol AND p.date = x.d"""


@query(
    "d1_latest_fundamentals", "fundamentals roster",
    f"""SELECT l.symbol, l.fiscal_year, l.period, l.eps_basic, l.eps_diluted, l.nav_per_share, l.dps, l.paid_up_capital_mn, l.audit_status,
        r.name, r.sector, r.category, r.face_value FROM ({_LATEST_FUND}) l LEFT JOIN roster r USING (symbol)""",
)
def _(m):
    return lookups.latest_fundamentals(m.fundamentals, m.roster).select(
        "symbol", "fiscal_year", "period", "eps_basic", "eps_diluted", "nav_per_share", "dps", "paid_up_capital_mn", "audit_status",
        "name", "sector", "category", "face_value",
    )


@query("d2_latest_price", "prices", f"SELECT symbol, date, close, ycp, change, change_percent, volume, pe FROM ({_LATEST_PRICE})")
def _(m):
    return lookups.latest_price(m.prices)


@query(
    "d3_stock_screen", "statements roster prices",
    f"""SELECT symbol, name, sector, category, eps_basic AS eps, eps_diluted, nav_per_share, paid_up_capital_mn, authorized_capital_mn,
          dividend_yield, fiscal_year, face_value, date AS close_date, close AS ltp, ycp,
          CASE WHEN ycp > 0 THEN {fx("d")} ELSE change END AS change,
          CASE WHEN ycp > 0 THEN {fx("g")} ELSE change_percent END AS change_percent,
          CASE WHEN ycp > 0 THEN {fx("g")} ELSE change_percent END AS momentum, volume,
          CASE WHEN eps_basic > 0 THEN {fx("dpe")} ELSE pe END AS daily_pe,
          CASE WHEN ycp <> 0 AND eps_basic > 0 THEN {fx("ape")} WHEN eps_basic > 0 THEN {fx("dpe")} ELSE pe END AS audited_pe,
          CASE WHEN nav_per_share > 0 THEN {fx("r")} END AS roe,
          CASE WHEN face_value > 0 THEN {fx("mc")} END AS market_cap, debt_to_equity, current_ratio,
          'FY' || fiscal_year || ' ' || period AS audited_period
        FROM (SELECT l.*, r.name, r.sector, r.category, r.face_value, p.date, p.close, p.ycp, p.change, p.change_percent, p.volume, p.pe,
                close - ycp AS d, (close - ycp) / ycp * 100.0::DOUBLE AS g, close / eps_basic AS dpe, ycp / eps_basic AS ape,
                eps_basic / nav_per_share * 100.0::DOUBLE AS r, paid_up_capital_mn / face_value * close AS mc
              FROM ({_LATEST_FUND.replace("fundamentals", "statements")}) l LEFT JOIN roster r USING (symbol)
              LEFT JOIN ({_LATEST_PRICE}) p ON p.symbol = l.symbol)""",
)
def stock_screen(m):
    return lookups.stock_screen(m.statements, m.roster, m.prices)


@query(
    "d4_price_timeline", "prices_dirty",
    """SELECT symbol, date, close AS ltp, ycp, change, change_percent, volume, pe FROM (
         SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY seq DESC) AS k FROM prices_dirty) WHERE k = 1""",
)
def _(m):
    return lookups.price_timeline(m.prices_dirty, seq="seq")


@query(
    "d5_index_timeline", "market_index",
    f"""SELECT date, index_value, advancing, declining, unchanged, total_value_mn, total_volume, source, {tier("source")} AS tier
        FROM market_index""",
)
def _(m):
    return lookups.index_timeline(m.index)


@query(
    "d6_statement_history", "statements",
    """SELECT symbol, fiscal_year AS year, period, eps_basic AS eps, nav_per_share AS navps, roe, dividend_yield, dps, pe_ratio AS pe,
         debt_to_equity, current_ratio, paid_up_capital_mn, audit_status FROM statements""",
)
def _(m):
    return lookups.statement_history(m.statements)


@query(
    "d7_shareholding_view", "shareholding",
    """SELECT symbol, sponsor_pct AS current_sponsor_pct, public_pct AS current_public_pct, as_of_date AS current_as_of,
         prev_as_of_date IS NOT NULL AS has_previous, prev_sponsor_pct AS previous_sponsor_pct, prev_foreign_pct AS previous_foreign_pct FROM shareholding""",
)
def _(m):
    v = lookups.shareholding_view(m.shareholding)
    return v.select(
        "symbol", F.col("current.sponsor_pct").alias("current_sponsor_pct"), F.col("current.public_pct").alias("current_public_pct"),
        F.col("current.as_of_date").alias("current_as_of"), F.col("previous").isNotNull().alias("has_previous"),
        F.col("previous.sponsor_pct").alias("previous_sponsor_pct"), F.col("previous.foreign_pct").alias("previous_foreign_pct"),
    )


@query("d9_strip_internal", "market_index", "SELECT date, index_value, advancing, declining, unchanged, total_value_mn, total_volume FROM market_index")
def _(m):
    return lookups.strip_internal(lookups.index_timeline(m.index))


@query(
    "d10_narrow_window", "roster prices asof_day",
    """SELECT r.symbol, l.last_date, coalesce(greatest(DATE '1995-01-01', l.last_date - 3), DATE '1995-01-01') AS start_date
       FROM roster r LEFT JOIN (SELECT symbol, max(date) AS last_date FROM prices GROUP BY symbol) l USING (symbol)
       WHERE l.last_date IS NULL OR l.last_date < (SELECT d FROM asof_day)""",
)
def _(m):
    return lookups.narrow_window(m.roster, m.prices, cutoff="1995-01-01", until=m.as_of)


@query(
    "d11_index_gap_candidates", "prices market_index",
    """SELECT o.date, o.index_value FROM (SELECT date, index_value FROM market_index WHERE index_value > 1000) o
       WHERE o.date IN (SELECT date FROM prices) AND o.date > (SELECT max(date) FROM market_index WHERE date < DATE '1999-07-01')""",
)
def _(m):
    official = m.index.filter(F.col("index_value") > 1000).select("date", "index_value")
    return lookups.index_gap_candidates(m.prices, m.index.filter(F.col("date") < F.lit("1999-07-01").cast("date")), official)


@query(
    "d12_resume_targets", "roster fundamentals",
    "SELECT symbol, sector FROM roster WHERE symbol NOT IN (SELECT symbol FROM fundamentals WHERE audit_status = 'Provisional' AND net_income_mn < 0)",
)
def _(m):
    return lookups.resume_targets(m.roster.select("symbol", "sector"), m.fundamentals.filter("audit_status = 'Provisional' AND net_income_mn < 0"))


_D13 = {"c_year_end_1995": "1995-06-30", "c_year_end_1998": "1998-06-30", "c_year_end_2001": "2001-06-30"}


@query(
    "d13_price_asof", "prices",
    "SELECT symbol, " + ", ".join(f"arg_max(close, date) FILTER (date <= DATE '{d}') AS {n}" for n, d in _D13.items()) + " FROM prices GROUP BY symbol",
)
def _(m):
    return asof.closes_at(m.prices, {n: dt.date.fromisoformat(d) for n, d in _D13.items()})


# -- joins ------------------------------------------------------------------------------------------------------------


@query(
    "e1_latest_left_join", "fundamentals roster prices",
    f"""SELECT l.symbol, l.fiscal_year, r.sector, r.face_value, p.date, p.close FROM ({_LATEST_FUND}) l
        LEFT JOIN roster r USING (symbol) LEFT JOIN ({_LATEST_PRICE}) p ON p.symbol = l.symbol""",
)
def _(m):
    f = lookups.latest_fundamentals(m.fundamentals, m.roster).select("symbol", "fiscal_year", "sector", "face_value")
    return f.join(lookups.latest_price(m.prices).select("symbol", "date", "close"), "symbol", "left")


@query("e2_max_date_rows", "bars", "SELECT symbol, date, close, high, low, volume FROM bars b WHERE date = (SELECT max(date) FROM bars x WHERE x.symbol = b.symbol)")
def _(m):
    cols = ["close", "high", "low", "volume"]
    return m.bars.groupBy("symbol").agg(F.max("date").alias("date"), *[F.max_by(c, "date").alias(c) for c in cols])


@query("e3_sector_peers", "statements roster", "SELECT s.symbol, s.fiscal_year, s.pe_ratio, r.sector FROM statements s JOIN roster r USING (symbol) WHERE s.pe_ratio > 0 AND r.sector IS NOT NULL")
def _(m):
    return lookups.peers_by_sector(m.statements, m.roster)


@query("e4_index_level_join", "prices market_index", "SELECT p.symbol, p.date, p.close AS price, p.volume, p.pe, i.index_value FROM prices p LEFT JOIN (SELECT * FROM market_index WHERE day(date) <> 9) i ON p.date = i.date")
def _(m):
    return lookups.with_index_level(m.prices, m.index.filter(F.dayofmonth("date") != 9))


@query(
    "e5_asof_backward", "corporate_actions bars",
    """SELECT a.symbol, a.event_date, a.cash_dps, p.close AS asof_close FROM corporate_actions a
       ASOF LEFT JOIN bars p ON a.symbol = p.symbol AND a.event_date >= p.date""",
)
def _(m):
    t = m.corporate_actions.select("symbol", "event_date", "cash_dps")
    return asof.asof_backward(t, m.bars, target_date="event_date", out="asof_close")


@query(
    "e6_asof_forward_45d", "corporate_actions bars",
    """SELECT a.symbol, a.event_date, a.cash_dps, CASE WHEN p.date - a.event_date <= 45 THEN p.date END AS start_date,
         CASE WHEN p.date - a.event_date <= 45 THEN p.close END AS start_close
       FROM corporate_actions a ASOF LEFT JOIN bars p ON a.symbol = p.symbol AND a.event_date <= p.date""",
)
def _(m):
    t = m.corporate_actions.select("symbol", "event_date", "cash_dps")
    return asof.asof_forward(m.bars, t, target_date="event_date")


@query(
    "e7_full_outer_compare", "prices_existing prices_incoming",
    """SELECT count(*) FILTER (a.symbol IS NOT NULL AND b.symbol IS NOT NULL) AS both_sides, count(*) FILTER (a.symbol IS NULL) AS only_incoming,
         count(*) FILTER (b.symbol IS NULL) AS only_existing
       FROM prices_existing a FULL JOIN (SELECT * FROM prices_incoming QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY seq DESC) = 1) b ON a.symbol = b.symbol AND a.date = b.date""",
)
def _(m):
    a = m.prices_existing.select("symbol", "date", F.lit(True).alias("a"))
    b = one_row_per_day(m.prices_incoming, "seq").select("symbol", "date", F.lit(True).alias("b"))
    j = a.join(b, ["symbol", "date"], "full_outer")
    return j.agg(
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both_sides"),
        F.count_if(F.col("a").isNull()).alias("only_incoming"),
        F.count_if(F.col("b").isNull()).alias("only_existing"),
    )


@query("e8_active_semi_join", "prices roster", "SELECT symbol, date, close FROM prices WHERE symbol IN (SELECT symbol FROM roster WHERE is_active)")
def _(m):
    return m.prices.select("symbol", "date", "close").join(m.roster.filter("is_active").select("symbol"), "symbol", "left_semi")


@query("e9_dates_without_index", "bars market_index", "SELECT DISTINCT date FROM bars WHERE date NOT IN (SELECT date FROM market_index WHERE advancing >= declining)")
def _(m):
    have = m.index.filter("advancing >= declining").select("date")
    return m.bars.select("date").distinct().join(have, "date", "left_anti")


@query(
    "e10_orphan_counts", "payments redemptions users",
    """SELECT 'payments' AS child, count(*) AS total, count(*) FILTER (user_id NOT IN (SELECT user_id FROM users WHERE user_id % 10 <> 3)) AS orphaned FROM payments
       UNION ALL SELECT 'redemptions', count(*), count(*) FILTER (user_id NOT IN (SELECT user_id FROM users WHERE user_id % 10 <> 3)) FROM redemptions""",
)
def _(m):
    from bourselake.operators.audits import orphan_counts

    parents = m.users.filter(F.col("user_id") % 10 != 3)
    return orphan_counts({"payments": m.payments, "redemptions": m.redemptions}, parents, "user_id")


@query(
    "e11_existing_row_prefetch", "prices_existing prices_incoming",
    """SELECT b.symbol, b.date, b.close AS incoming_close, b.source AS incoming_source, a.close AS existing_close, a.source AS existing_source
       FROM prices_incoming b LEFT JOIN prices_existing a ON a.symbol = b.symbol AND a.date = b.date""",
)
def _(m):
    b = m.prices_incoming.select("symbol", "date", F.col("close").alias("incoming_close"), F.col("source").alias("incoming_source"))
    a = m.prices_existing.select("symbol", "date", F.col("close").alias("existing_close"), F.col("source").alias("existing_source"))
    return b.join(a, ["symbol", "date"], "left")


@query(
    "e12_payments_with_users", "payments users",
    """SELECT p.txn, p.user_id, u.email, p.amount_bdt, p.status, p.plan, p.created_at FROM payments p LEFT JOIN users u USING (user_id)""",
)
def _(m):
    from bourselake.operators.access import payments_with_users

    return payments_with_users(m.payments, m.users)


# -- aggregates -------------------------------------------------------------------------------------------------------


@query(
    "f1_market_breadth", "prices",
    """SELECT date, count(*) FILTER (close > ycp) AS advancing, count(*) FILTER (close < ycp) AS declining, count(*) FILTER (close = ycp) AS unchanged,
         CAST(sum(volume) AS BIGINT) AS total_volume, CAST(sum(trades) AS BIGINT) AS total_trades, count(*) AS issues FROM prices GROUP BY date""",
)
def _(m):
    return market.market_breadth(m.prices)


@query("f2_symbol_history_stats", "prices", "SELECT symbol, count(*) AS sessions, min(date) AS first_date, max(date) AS last_date, max(close) AS ath_price, min(close) AS atl_price FROM prices GROUP BY symbol")
def _(m):
    return market.symbol_history_stats(m.prices)


@query("f3_source_distribution", "prices", f"SELECT source, count(*) AS rows, {tier('source')} AS tier FROM prices GROUP BY source")
def _(m):
    return market.source_distribution(m.prices)


@query("f5_revenue_totals", "payments", "SELECT count(*) AS success_count, CAST(coalesce(sum(amount_bdt), 0) AS BIGINT) AS total_bdt FROM payments WHERE status = 'SUCCESS'")
def _(m):
    return market.revenue_totals(m.payments)


@query("f5_revenue_by_day", "payments", "SELECT created_at AS day, count(*) AS count, CAST(sum(amount_bdt) AS BIGINT) AS bdt FROM payments WHERE status = 'SUCCESS' AND created_at >= DATE '2001-06-30' - 90 GROUP BY 1")
def _(m):
    return market.revenue_by_day(m.payments, as_of="2001-06-30")


@query("f5_revenue_by_plan", "payments", "SELECT plan, count(*) AS count, CAST(sum(amount_bdt) AS BIGINT) AS bdt FROM payments WHERE status = 'SUCCESS' GROUP BY plan")
def _(m):
    return market.revenue_by_plan(m.payments)


@query("f6_promo_redemption_counts", "promos redemptions", "SELECT p.code, count(r.id) AS redemption_count FROM promos p LEFT JOIN redemptions r USING (code) GROUP BY p.code")
def _(m):
    return market.promo_redemption_counts(m.promos, m.redemptions)


@query("f7_distinct_symbols", "bars", "SELECT DISTINCT symbol FROM bars")
def _(m):
    return m.bars.select("symbol").distinct()


@query("f7_distinct_dates", "bars", "SELECT DISTINCT date FROM bars")
def _(m):
    return m.bars.select("date").distinct()


@query(
    "f8_table_row_counts", "bars market_index fundamentals roster users payments watchlist",
    " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {v}" for t, v in
      {"prices": "bars", "index": "market_index", "fundamentals": "fundamentals", "roster": "roster", "users": "users", "payments": "payments", "watchlist": "watchlist"}.items()),
)
def _(m):
    return market.table_row_counts(
        {"prices": m.bars, "index": m.index, "fundamentals": m.fundamentals, "roster": m.roster, "users": m.users, "payments": m.payments, "watchlist": m.watchlist}
    )


@query(
    "f11_all_time_high_low", "prices",
    f"""SELECT symbol, ath_price, ath_date, atl_price, atl_date, close, {fx("a")} AS drawdown_pct, {fx("b")} AS rise_pct FROM (
          SELECT *, (close - ath_price) / ath_price * 100.0::DOUBLE AS a, (close - atl_price) / atl_price * 100.0::DOUBLE AS b FROM (
            SELECT p.symbol, any_value(hi) AS ath_price, min(date) FILTER (close = hi) AS ath_date, any_value(lo) AS atl_price,
              min(date) FILTER (close = lo) AS atl_date, arg_max(close, date) AS close
            FROM prices p JOIN (SELECT symbol, max(close) AS hi, min(close) AS lo FROM prices WHERE close > 0 GROUP BY symbol) x USING (symbol)
            WHERE close > 0 GROUP BY p.symbol))""",
)
def _(m):
    return market.all_time_high_low(m.prices)


_SAMPLE = "SELECT symbol, pe FROM (SELECT symbol, pe FROM prices_dirty UNION ALL SELECT symbol, pe_ratio FROM statements) WHERE pe > 0 AND pe < 120"


@query(
    "f12_percentile_floor", "prices_dirty statements",
    f"""SELECT symbol, {fx("a")} AS p25, {fx("b")} AS median, {fx("c")} AS p75, n AS sample_size FROM (
          SELECT symbol, l[1 + CAST(floor(n * 0.25) AS BIGINT)] AS a, l[1 + CAST(floor(n * 0.5) AS BIGINT)] AS b, l[1 + CAST(floor(n * 0.75) AS BIGINT)] AS c, n
          FROM (SELECT symbol, list(pe ORDER BY pe) AS l, count(*) AS n FROM ({_SAMPLE}) GROUP BY symbol))""",
)
def _(m):
    return market.percentile_floor(market.pe_sample(m.prices_dirty, m.statements))


@query(
    "f13_pe_percentile_rank", "prices_dirty statements",
    f"""SELECT s.symbol, CAST(floor(CAST(count(*) FILTER (pe < cur) AS DOUBLE) / count(*) * 100.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS pe_percentile_rank
        FROM ({_SAMPLE}) s JOIN (SELECT symbol, arg_max(pe_ratio, fiscal_year) AS cur FROM statements WHERE pe_ratio IS NOT NULL GROUP BY symbol) c USING (symbol)
        GROUP BY s.symbol""",
)
def _(m):
    cur = m.statements.filter(F.col("pe_ratio").isNotNull()).groupBy("symbol").agg(F.max_by("pe_ratio", "fiscal_year").alias("current_pe"))
    return market.pe_percentile_rank(market.pe_sample(m.prices_dirty, m.statements), cur)


@query(
    "f14_liquidity_profile", "prices",
    f"""SELECT symbol, CAST(floor(v + 0.5::DOUBLE) AS BIGINT) AS avg_daily_volume, {fx("a")} AS avg_daily_value_mn,
          CASE WHEN a < 1 THEN 'Illiquid' WHEN a < 10 THEN 'Moderate' ELSE 'Liquid' END AS classification FROM (
          SELECT symbol, avg(volume) AS v, sum(value_mn ORDER BY date) / count(*) AS a FROM (
            SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM prices) WHERE rn <= 90 GROUP BY symbol)""",
)
def _(m):
    return market.liquidity_profile(m.prices)


def _sector_sql(base: str) -> str:
    return f"""
    WITH own AS (SELECT r.symbol, r.sector, CASE WHEN base > 0 THEN {fx("g")} END AS stock_return FROM roster r LEFT JOIN (
        SELECT symbol, base, (latest - base) / base * 100.0::DOUBLE AS g FROM (SELECT symbol, arg_max(close, date) AS latest, {base} AS base FROM prices GROUP BY symbol)) e USING (symbol))
    SELECT symbol, sector, stock_return, CASE WHEN peer_count > 0 THEN {fx("(CAST(rest AS DOUBLE) / 100.0::DOUBLE / peer_count)")} END AS sector_avg_return, peer_count FROM (
      SELECT a.symbol, a.sector, a.stock_return,
        (SELECT coalesce(sum(CAST(round(b.stock_return * 100) AS BIGINT)), 0) FROM own b WHERE b.sector = a.sector AND b.symbol <> a.symbol) AS rest,
        (SELECT count(b.stock_return) FROM own b WHERE b.sector = a.sector AND b.symbol <> a.symbol) AS peer_count FROM own a)"""


@query("f15_sector_performance_1y", "roster prices asof_day", _sector_sql("arg_max(close, date) FILTER (date <= (SELECT d FROM asof_day) - 365)"))
def _(m):
    return market.sector_performance(m.roster, m.prices, as_of=m.as_of, days=365)


@query("f15_sector_performance_all", "roster prices", _sector_sql("arg_min(close, date)"))
def _(m):
    return market.sector_performance(m.roster, m.prices, as_of=None, days=None)


@query("f16_stratified_sample", "roster", "SELECT symbol, name, sector, category FROM roster WHERE is_active AND sector IS NOT NULL ORDER BY sector, symbol LIMIT 50")
def _(m):
    return market.stratified_sample(m.roster, 50)


def _growth_sql(field: str) -> str:
    return f"""SELECT symbol, from_year, to_year, from_value, to_value, {fx("c")} AS cagr_pct FROM (
      SELECT *, (pow(to_value / from_value, 1.0::DOUBLE / CAST(to_year - from_year AS DOUBLE)) - 1.0::DOUBLE) * 100.0::DOUBLE AS c FROM (
        SELECT symbol, min(fiscal_year) AS from_year, max(fiscal_year) AS to_year, arg_min({field}, fiscal_year) AS from_value, arg_max({field}, fiscal_year) AS to_value
        FROM fundamentals WHERE {field} > 0 GROUP BY symbol) WHERE to_year > from_year)"""


@query("f18_eps_growth_cagr", "fundamentals", _growth_sql("eps_basic"))
def _(m):
    return market.growth_cagr(m.fundamentals, "eps_basic")


@query("f18_nav_growth_cagr", "fundamentals", _growth_sql("nav_per_share"))
def _(m):
    return market.growth_cagr(m.fundamentals, "nav_per_share")


@query(
    "f19_volume_velocity", "prices",
    f"""SELECT symbol, {fx("v")} AS volume_velocity FROM (SELECT symbol, avg(volume) FILTER (rn <= 5) / avg(volume) FILTER (rn > 5) AS v FROM (
          SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM prices) WHERE rn <= 25 GROUP BY symbol)""",
)
def _(m):
    return market.volume_velocity(m.prices)
