"""Windows and time-series operators (family G), sorts and limits (H), set operations (I)."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bourselake.operators import indicators, lookups, market, recursions, returns, sets
from bourselake.plans.catalog import query
from bourselake.plans.oracle import fx
from bourselake.session import shared_folder
from bourselake.sinks import paging

_W = "(PARTITION BY symbol ORDER BY date ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"


def _frame(n: int) -> str:
    return _W.format(n=n - 1)


def _sma(n: int) -> str:
    return f"CASE WHEN count(*) OVER {_frame(n)} = {n} THEN avg(close) OVER {_frame(n)} END"


_LONG = "(SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n_all FROM bars) WHERE n_all >= 20)"


@query(
    "g1_sma", "bars",
    f"SELECT symbol, date, {fx('a', 4)} AS sma_20, {fx('b', 4)} AS sma_50, {fx('c', 4)} AS sma_200 FROM (SELECT symbol, date, {_sma(20)} AS a, {_sma(50)} AS b, {_sma(200)} AS c FROM {_LONG})",
)
def _(m):
    return indicators.sma(m.bars)


@query(
    "g2_sma_partial_trend", "bars",
    f"""SELECT *, CASE WHEN sma50 > sma200 AND close > sma50 THEN 'Bullish Golden Cross (Above SMA50 & SMA200)'
          WHEN sma50 < sma200 AND close < sma50 THEN 'Bearish Consolidation (Below SMA50 & SMA200)'
          WHEN close > sma200 THEN 'Long-Term Structural Support (Above SMA200)' ELSE 'Neutral Accumulation' END AS trend_signal FROM (
        SELECT symbol, close, {fx("s")} AS sma50, {fx("l")} AS sma200 FROM (
          SELECT symbol, arg_max(close, date) AS close, avg(close) FILTER (rn <= 50) AS s, avg(close) AS l FROM (
            SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM bars WHERE close > 0) WHERE rn <= 200 GROUP BY symbol))""",
)
def _(m):
    return indicators.trend(m.bars)


# Closed form of a seeded exponential mean, as a sum over all earlier rows of the same symbol.
def _smooth(src: str, value: str, first: int, period: int, alpha: str, out: str) -> str:
    """Rows of ``src`` (symbol, rn, value) from position ``first``; the seed is the mean of the first ``period``."""
    start = first + period - 1
    return f"""SELECT i.symbol, i.rn, max(s.seed) * pow(1 - {alpha}, i.rn - {start})
          + coalesce(sum({alpha} * pow(1 - {alpha}, i.rn - j.rn) * j.{value}) FILTER (j.rn > {start}), 0) AS {out}
        FROM {src} i JOIN (SELECT symbol, avg({value}) AS seed FROM {src} WHERE rn BETWEEN {first} AND {start} GROUP BY symbol HAVING count(*) = {period}) s ON i.symbol = s.symbol
        JOIN {src} j ON j.symbol = i.symbol AND j.rn BETWEEN {start} AND i.rn WHERE i.rn >= {start} GROUP BY i.symbol, i.rn"""


_NUMBERED = f"""n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn,
   lag(close) OVER (PARTITION BY symbol ORDER BY date) AS pc FROM {_LONG} WHERE close > 0)"""
_EMAS = f"""e12 AS ({_smooth("n", "close", 1, 12, "(2.0::DOUBLE / 13)", "v")}), e26 AS ({_smooth("n", "close", 1, 26, "(2.0::DOUBLE / 27)", "v")})"""


@query(
    "g3_ema", "bars",
    f"""WITH {_NUMBERED}, {_EMAS} SELECT n.symbol, n.date, {fx("e12.v", 4)} AS ema_12, {fx("e26.v", 4)} AS ema_26 FROM n
        LEFT JOIN e12 USING (symbol, rn) LEFT JOIN e26 USING (symbol, rn)""",
)
def _(m):
    return recursions.recursive_indicators(m.bars).select("symbol", "date", "ema_12", "ema_26")


@query(
    "g4_macd", "bars",
    f"""WITH {_NUMBERED}, {_EMAS}, md AS (SELECT symbol, rn, e12.v - e26.v AS macd FROM e12 JOIN e26 USING (symbol, rn)),
        sg AS ({_smooth("md", "macd", 26, 9, "(2.0::DOUBLE / 10)", "v")})
        SELECT n.symbol, n.date, {fx("md.macd", 4)} AS macd, {fx("sg.v", 4)} AS macd_signal, {fx("(md.macd - sg.v)", 4)} AS macd_hist
        FROM n LEFT JOIN md USING (symbol, rn) LEFT JOIN sg USING (symbol, rn)""",
)
def _(m):
    return recursions.recursive_indicators(m.bars).select("symbol", "date", "macd", "macd_signal", "macd_hist")


_RSI = f"""{_NUMBERED}, d AS (SELECT symbol, rn, greatest(close - pc, 0) AS gain, greatest(pc - close, 0) AS loss FROM n WHERE rn > 1),
   g AS ({_smooth("d", "gain", 2, 14, "(1.0::DOUBLE / 14)", "v")}), l AS ({_smooth("d", "loss", 2, 14, "(1.0::DOUBLE / 14)", "v")}),
   rs AS (SELECT symbol, rn, 100.0::DOUBLE - 100.0::DOUBLE / (1.0::DOUBLE + CASE WHEN l.v = 0 THEN 100.0::DOUBLE ELSE g.v / l.v END) AS r
          FROM g JOIN l USING (symbol, rn) WHERE rn > 15)"""


@query("g5_rsi", "bars", f"WITH {_RSI} SELECT n.symbol, n.date, {fx('rs.r')} AS rsi_14 FROM n LEFT JOIN rs USING (symbol, rn)")
def _(m):
    return recursions.recursive_indicators(m.bars).select("symbol", "date", "rsi_14")


@query(
    "g6_rsi_zone", "bars",
    f"""WITH {_RSI}, last AS (SELECT symbol, {fx("r")} AS rsi_14 FROM (SELECT symbol, arg_max(r, rn) AS r FROM rs GROUP BY symbol))
        SELECT s.symbol, rsi_14, CASE WHEN rsi_14 IS NULL THEN 'INSUFFICIENT_DATA' WHEN rsi_14 < 30 THEN 'OVERSOLD' WHEN rsi_14 > 70 THEN 'OVERBOUGHT' ELSE 'NEUTRAL' END AS rsi_zone
        FROM (SELECT DISTINCT symbol FROM bars) s LEFT JOIN last USING (symbol)""",
)
def _(m):
    return recursions.latest_rsi_zone(recursions.recursive_indicators(m.bars), m.bars)


_ATR = f"""{_NUMBERED}, t AS (SELECT symbol, rn, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM n WHERE rn > 1),
   a AS ({_smooth("t", "tr", 2, 14, "(1.0::DOUBLE / 14)", "v")})"""


@query("g7_atr", "bars", f"WITH {_ATR} SELECT n.symbol, n.date, {fx('a.v', 4)} AS atr_14 FROM n LEFT JOIN a USING (symbol, rn)")
def _(m):
    return recursions.recursive_indicators(m.bars).select("symbol", "date", "atr_14")


@query(
    "g8_atr_bands", "bars",
    f"""WITH {_ATR} SELECT symbol, close, atr_14, {fx("(close - atr_14 * 2.0::DOUBLE)")} AS stop_loss, {fx("(close + atr_14 * 3.0::DOUBLE)")} AS take_profit FROM (
          SELECT n.symbol, arg_max(close, rn) AS close, {fx("arg_max(a.v, rn)", 4)} AS atr_14 FROM n JOIN a USING (symbol, rn) GROUP BY n.symbol)""",
)
def _(m):
    return recursions.atr_bands(recursions.recursive_indicators(m.bars), m.bars)


@query(
    "g9_bollinger", "bars",
    f"""SELECT symbol, date, {fx("(mid + sd * 2.0::DOUBLE)", 4)} AS boll_upper, {fx("mid", 4)} AS boll_mid, {fx("(mid - sd * 2.0::DOUBLE)", 4)} AS boll_lower FROM (
          SELECT symbol, date, {_sma(20)} AS mid, CASE WHEN count(*) OVER {_frame(20)} = 20 THEN stddev_pop(close) OVER {_frame(20)} END AS sd FROM {_LONG})""",
)
def _(m):
    return indicators.bollinger(m.bars)


@query("g10_rolling_high_low", "bars", f"SELECT symbol, date, max(close) OVER {_frame(252)} AS week52_high, min(close) OVER {_frame(252)} AS week52_low FROM bars")
def _(m):
    return indicators.rolling_high_low(m.bars)


@query(
    "g11_rolling_calendar_range", "bars",
    "SELECT symbol, date, max(close) OVER w AS high, min(close) OVER w AS low FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date RANGE BETWEEN INTERVAL 365 DAYS PRECEDING AND CURRENT ROW)",
)
def _(m):
    return indicators.rolling_calendar_high_low(m.bars)


@query(
    "g11_week52", "bars",
    f"""SELECT symbol, {fx("high")} AS high, {fx("low")} AS low, {fx("o")} AS percent_off_high FROM (
          SELECT *, (close - high) / high * 100.0::DOUBLE AS o FROM (
            SELECT b.symbol, max(b.close) FILTER (b.date >= l.d - 365) AS high, min(b.close) FILTER (b.date >= l.d - 365) AS low, arg_max(b.close, b.date) AS close
            FROM bars b JOIN (SELECT symbol, max(date) AS d FROM bars GROUP BY symbol) l USING (symbol) GROUP BY b.symbol))""",
)
def _(m):
    return indicators.week52(m.bars)


@query(
    "g12_max_drawdown", "bars",
    f"""WITH f AS (SELECT symbol, date, peak, (close - peak) / peak * 100.0::DOUBLE AS fall FROM (
          SELECT *, max(close) OVER (PARTITION BY symbol ORDER BY date) AS peak FROM bars)),
        t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY fall, date) AS k FROM f) WHERE k = 1)
        SELECT symbol, {fx("fall")} AS max_drawdown_pct, CASE WHEN fall < 0 THEN date END AS trough_date,
          CASE WHEN fall < 0 THEN (SELECT min(b.date) FROM bars b WHERE b.symbol = t.symbol AND b.close = t.peak AND b.date <= t.date) END AS peak_date FROM t""",
)
def _(m):
    return indicators.max_drawdown(m.bars)


def _lookback_sql(tail: str = "") -> str:
    ago = ", ".join(f"arg_max(close, date) FILTER (date <= (SELECT d FROM asof_day) - {d}) AS price_{k}_ago" for k, d in returns.LOOKBACK_DAYS.items())
    ret = ", ".join(f"CASE WHEN price_{k}_ago > 0 THEN {fx(f'((last_close / price_{k}_ago - 1.0::DOUBLE) * 100.0::DOUBLE)')} END AS return_{k}" for k in returns.LOOKBACK_DAYS)
    gr = ", ".join(f"{fx(f'((pow(last_close / price_{y}y_ago, 1.0::DOUBLE / {y}.0::DOUBLE) - 1.0::DOUBLE) * 100.0::DOUBLE)')} AS cagr_{y}y" for y in (3, 5, 10))
    return f"SELECT symbol, last_close, {', '.join(f'price_{k}_ago' for k in returns.LOOKBACK_DAYS)}, {ret}, {gr} FROM (SELECT symbol, arg_max(close, date) AS last_close, {ago} FROM bars GROUP BY symbol HAVING count(*) >= 2)"


@query("g13_lookback_returns", "bars asof_day", _lookback_sql())
def _(m):
    return returns.lookback_returns(m.bars, m.as_of)


@query(
    "g14_price_cagr", "bars",
    f"""SELECT symbol, {fx("c")} AS cagr_pct FROM (SELECT symbol, (pow(e / s, 1.0::DOUBLE / y) - 1.0::DOUBLE) * 100.0::DOUBLE AS c FROM (
          SELECT symbol, arg_min(close, date) AS s, arg_max(close, date) AS e, CAST(max(date) - min(date) AS DOUBLE) / 365.25::DOUBLE AS y FROM bars GROUP BY symbol) WHERE y > 0)""",
)
def _(m):
    from bourselake.functions.dates import year_span
    from bourselake.functions.numbers import cagr_pct

    g = m.bars.groupBy("symbol").agg(
        F.min_by("close", "date").alias("s"), F.max_by("close", "date").alias("e"), year_span(F.max("date"), F.min("date")).alias("y")
    )
    return g.filter("y > 0").select("symbol", cagr_pct(F.col("s"), F.col("e"), F.col("y")).alias("cagr_pct"))


_VOL = f"""SELECT symbol, {fx("(sqrt(sd * sd * 252.0::DOUBLE) * 100.0::DOUBLE)")} AS volatility_ann FROM (
   SELECT symbol, stddev_samp(ln(close / pc)) AS sd, count(*) AS n FROM (SELECT symbol, close, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS pc FROM bars)
   WHERE pc > 0 GROUP BY symbol) WHERE n >= 2"""


@query("g15_log_volatility", "bars", _VOL)
def _(m):
    return returns.log_volatility(m.bars)


@query(
    "g16_risk_metrics", "bars market_index",
    f"""WITH q AS (SELECT symbol, date, close, CASE WHEN p0 > 0 THEN (close - p0) / p0 END AS r, CASE WHEN p0 > 0 AND i0 > 0 THEN (index_value - i0) / i0 END AS ir FROM (
          SELECT b.symbol, b.date, b.close, i.index_value, lag(b.close) OVER w AS p0, lag(i.index_value) OVER w AS i0
          FROM bars b LEFT JOIN (SELECT * FROM market_index WHERE day(date) <> 9) i ON i.date = b.date WINDOW w AS (PARTITION BY b.symbol ORDER BY b.date))),
        g AS (SELECT symbol, count(r) AS n, stddev_pop(r) AS sd, count(ir) AS pairs, covar_pop(r, ir) AS cov, var_pop(ir) AS ivar,
          arg_min(close, date) AS f, arg_max(close, date) AS l, CAST(max(date) - min(date) AS DOUBLE) / 365.25::DOUBLE AS y FROM q GROUP BY symbol),
        v AS (SELECT symbol, CASE WHEN n >= 30 THEN sd * sqrt(252.0::DOUBLE) * 100.0::DOUBLE END AS vol,
          CASE WHEN n >= 30 AND pairs >= 30 AND ivar > 0 THEN cov / ivar END AS beta, (pow(l / f, 1.0::DOUBLE / y) - 1.0::DOUBLE) * 100.0::DOUBLE AS c, y FROM g)
        SELECT symbol, {fx("vol")} AS volatility_pct, {fx("beta")} AS beta, CASE WHEN y > 0.5 AND vol > 0 THEN {fx("((c - 11.5::DOUBLE) / vol)")} END AS sharpe_ratio FROM v""",
)
def _(m):
    return returns.risk_metrics(m.bars, m.index.filter(F.dayofmonth("date") != 9))


@query(
    "g17_sharpe_1y", "bars asof_day",
    f"SELECT symbol, CASE WHEN volatility_ann > 0 THEN {fx('((return_1y - 0.04::DOUBLE * 100.0::DOUBLE) / volatility_ann)', 3)} END AS sharpe_ratio FROM ({_lookback_sql()}) JOIN ({_VOL}) USING (symbol)",
)
def _(m):
    return returns.sharpe_1y(returns.lookback_returns(m.bars, m.as_of), returns.log_volatility(m.bars))


_RETURNS = f"""
WITH last AS (SELECT symbol, max(date) AS d1, arg_max(close, date) AS close FROM bars GROUP BY symbol),
t AS (SELECT symbol, d1, close, n, n || 'Y' AS period,
        CASE WHEN month(d1) = 2 AND day(d1) = 29 AND day(CAST(d1 - to_years(n) AS DATE)) = 28 THEN CAST(d1 - to_years(n) AS DATE) + 1 ELSE CAST(d1 - to_years(n) AS DATE) END AS target
      FROM last, (VALUES (1), (3), (5), (10)) v(n)),
s AS (SELECT t.*, b.date AS start_date, b.close AS start_close, CAST(d1 - b.date AS DOUBLE) / 365.25::DOUBLE AS y
      FROM t ASOF JOIN bars b ON t.symbol = b.symbol AND t.target <= b.date),
k AS (SELECT *, (SELECT sum(dps ORDER BY fiscal_year) FROM fundamentals f WHERE f.symbol = s.symbol AND f.dps IS NOT NULL AND f.fiscal_year >= year(s.start_date)) AS dv
      FROM s WHERE start_close > 0 AND start_date - target <= 45 AND y >= n * 0.7::DOUBLE)
SELECT symbol, period, start_date, {fx("pc")} AS price_cagr_pct, CASE WHEN dv > 0 THEN {fx("tc")} ELSE {fx("pc")} END AS total_return_cagr_pct FROM (
  SELECT *, (pow(close / start_close, 1.0::DOUBLE / y) - 1.0::DOUBLE) * 100.0::DOUBLE AS pc, (pow((close + dv) / start_close, 1.0::DOUBLE / y) - 1.0::DOUBLE) * 100.0::DOUBLE AS tc FROM k)"""


@query("g18_returns_table", "bars fundamentals", _RETURNS)
def _(m):
    return returns.returns_table(m.bars, m.fundamentals)


@query(
    "g19_annual_return", "bars",
    f"""SELECT b.symbol, b.date, CASE WHEN y.c > 0 THEN {fx("((b.close / y.c - 1.0::DOUBLE) * 100.0::DOUBLE)")} END AS annual_return_pct
        FROM bars b LEFT JOIN (SELECT symbol, year(date) + 1 AS yr, arg_max(close, date) AS c FROM bars GROUP BY 1, 2) y ON y.symbol = b.symbol AND y.yr = year(b.date)""",
)
def _(m):
    return indicators.annual_return(m.bars)


@query(
    "g20_sector_pe_percentile", "statements roster",
    """WITH p AS (SELECT s.symbol, r.sector, s.fiscal_year, s.pe_ratio, count(*) OVER (PARTITION BY r.sector, s.fiscal_year) AS n,
         rank() OVER (PARTITION BY r.sector, s.fiscal_year ORDER BY s.pe_ratio DESC) - 1 AS above FROM statements s JOIN roster r USING (symbol) WHERE s.pe_ratio > 0)
       SELECT symbol, sector, fiscal_year, CAST(floor(CAST(above AS DOUBLE) / CAST(n - 1 AS DOUBLE) * 100.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS percentile, n AS peer_count FROM p WHERE n >= 4""",
)
def _(m):
    return indicators.sector_pe_percentile(m.statements, m.roster)


_FLAGS = """
WITH a AS (SELECT symbol, count(*) >= 3 AND count(*) FILTER (dps < pd) = 0 AS dividend_aristocrat FROM (
    SELECT symbol, dps, lag(dps) OVER (PARTITION BY symbol ORDER BY fiscal_year) AS pd FROM fundamentals WHERE dps IS NOT NULL) GROUP BY symbol),
t AS (SELECT symbol, eps_basic > 0 AND pe <= 0 AS turnaround FROM (
    SELECT *, lag(eps_basic) OVER (PARTITION BY symbol ORDER BY fiscal_year) AS pe, row_number() OVER (PARTITION BY symbol ORDER BY fiscal_year DESC) AS rn FROM fundamentals) WHERE rn = 1)
SELECT symbol, coalesce(dividend_aristocrat, false) AS dividend_aristocrat, coalesce(turnaround, false) AS turnaround FROM t LEFT JOIN a USING (symbol)
WHERE coalesce(dividend_aristocrat, false) OR coalesce(turnaround, false)"""


@query("g21_dividend_aristocrats", "fundamentals", f"SELECT symbol FROM ({_FLAGS}) WHERE dividend_aristocrat")
def _(m):
    return indicators.screener_flags(m.fundamentals).filter("dividend_aristocrat").select("symbol")


@query("g22_turnarounds", "fundamentals", f"SELECT symbol FROM ({_FLAGS}) WHERE turnaround")
def _(m):
    return indicators.screener_flags(m.fundamentals).filter("turnaround").select("symbol")


@query("g21_screener_flags", "fundamentals", _FLAGS)
def _(m):
    return indicators.screener_flags(m.fundamentals)


@query(
    "g23_price_swing", "bars",
    """SELECT symbol, date, close, pc AS prev_close, close / pc AS ratio FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS pc FROM bars)
       WHERE pc > 0 AND (close / pc > 1.6 OR close / pc < 0.6)""",
)
def _(m):
    return indicators.price_swing(m.bars, up=1.6, down=0.6)


@query(
    "g24_wma", "bars",
    "SELECT symbol, date, close, " + fx("(t / 210.0::DOUBLE)", 4) + " AS wma_20 FROM (SELECT symbol, date, close, close * 20.0::DOUBLE"
    + "".join(f" + lag(close, {i}) OVER w * {20 - i}.0::DOUBLE" for i in range(1, 20)) + " AS t FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date))",
)
def _(m):
    return indicators.wma(m.bars)


@query("g25_dedupe_first", "prices_dirty", "SELECT symbol, date, close, pe, seq FROM (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY seq) AS k FROM prices_dirty) WHERE k = 1")
def _(m):
    return indicators.dedupe_first(m.prices_dirty.select("symbol", "date", "close", "pe", "seq"), "seq")


@query("g26_total_shareholder_return", "bars fundamentals", f"SELECT symbol, period, total_return_cagr_pct FROM ({_RETURNS})")
def _(m):
    return returns.returns_table(m.bars, m.fundamentals).select("symbol", "period", "total_return_cagr_pct")


# -- sorts and limits -------------------------------------------------------------------------------------------------


@query("h1_latest_users", "users", "SELECT user_id, email, name, created_at FROM users ORDER BY created_at DESC, user_id LIMIT 500")
def _(m):
    return sets.newest_rows(m.users.select("user_id", "email", "name", "created_at"), "created_at", "user_id", 500)


@query("h1_newest_gap_dates", "bars market_index", "SELECT DISTINCT date FROM bars WHERE date NOT IN (SELECT date FROM market_index WHERE advancing >= declining) ORDER BY date DESC LIMIT 30")
def _(m):
    have = m.index.filter("advancing >= declining").select("date")
    return m.bars.select("date").distinct().join(have, "date", "left_anti").orderBy(F.desc("date")).limit(30)


@query("h2_newest_90_sessions", "bars", "SELECT symbol, date, close, volume FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM bars) WHERE rn <= 90")
def _(m):
    return lookups.newest_per_key(m.bars.select("symbol", "date", "close", "volume"), "symbol", "date", 90)


@query(
    "h3_pages", "prices",
    """WITH r AS (SELECT symbol, date, close, volume, row_number() OVER (ORDER BY symbol, date) - 1 AS position, count(*) OVER () AS n FROM prices)
       SELECT position // 1000 AS page, position, symbol, date, close, volume FROM r WHERE position // 1000 IN (0, (n - 1) // 2000, (n - 1) // 1000)""",
)
def price_pages(m):
    """The first, middle and last page of 1,000 rows of the ordered price table, each read by its page alone."""
    path = f"{shared_folder(m.spark)}/pages-{uuid.uuid4().hex}"
    paging.write_paged(m.prices.select("symbol", "date", "close", "volume"), path, "symbol", "date")
    last = (paging.row_count(m.spark, path) - 1) // 1000
    found = [paging.read_page(m.spark, path, page, 1000).withColumn("page", F.lit(page).cast("long")) for page in sorted({0, last // 2, last})]
    return reduce(DataFrame.unionByName, found)


@query("h3_ordered_export_rows", "prices", "SELECT symbol, date, open, high, low, close, ycp, change, change_percent, volume, value_mn, pe FROM prices")
def _(m):
    from bourselake.sinks.csv_exports import price_export_rows

    return price_export_rows(m.prices)


@query("h4_tail_200", "bars", "SELECT symbol, avg50, n FROM (SELECT symbol, " + fx("avg(close) FILTER (rn <= 50)") + " AS avg50, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM bars) WHERE rn <= 200 GROUP BY symbol)")
def _(m):
    t = indicators.trend(m.bars).select("symbol", F.col("sma50").alias("avg50"))
    n = lookups.newest_per_key(m.bars.select("symbol", "date"), "symbol", "date", 200).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    return t.join(n, "symbol")


# -- set operations ---------------------------------------------------------------------------------------------------


@query(
    "i1_symbol_difference", "bars roster asof_day",
    """WITH live AS (SELECT DISTINCT symbol FROM bars WHERE date >= (SELECT d FROM asof_day) - 30)
       SELECT symbol, 'missing_from_roster' AS side FROM live WHERE symbol NOT IN (SELECT symbol FROM roster WHERE is_active)
       UNION ALL SELECT symbol, 'not_traded' FROM roster WHERE is_active AND symbol NOT IN (SELECT symbol FROM live)""",
)
def _(m):
    live = m.bars.filter(F.col("date") >= F.date_sub(F.lit(m.as_of), 30)).select("symbol")
    return sets.symbol_difference(live, m.roster.filter("is_active").select("symbol"))


@query("i2_union_pe_samples", "prices_dirty statements", "SELECT symbol, pe FROM (SELECT symbol, pe FROM prices_dirty UNION ALL SELECT symbol, pe_ratio FROM statements) WHERE pe > 0 AND pe < 120")
def _(m):
    return market.pe_sample(m.prices_dirty, m.statements)


@query(
    "i3_priority_union", "market_index ds30",
    """SELECT date, value, origin FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY pr) AS k FROM (
         SELECT date, index_value AS value, 'table' AS origin, 1 AS pr FROM market_index WHERE advancing >= declining
         UNION ALL SELECT date, ds30_index, 'graph', 2 FROM ds30)) WHERE k = 1""",
)
def _(m):
    table = m.index.filter("advancing >= declining").select("date", F.col("index_value").alias("value"), F.lit("table").alias("origin"))
    graph = m.ds30.select("date", F.col("ds30_index").alias("value"), F.lit("graph").alias("origin"))
    return sets.priority_union([table, graph], ["date"])


@query("i4_distinct_union", "watchlist", "SELECT user_id, symbol FROM watchlist UNION SELECT o_custkey, 'S' || lpad(CAST(o_orderkey % 50 AS VARCHAR), 10, '0') FROM orders")
def _(m):
    from bourselake.plans.marts import symbol_of

    local = m.table("orders").select(F.col("o_custkey").alias("user_id"), symbol_of(F.col("o_orderkey") % 50).alias("symbol"))
    return sets.distinct_union(m.watchlist.select("user_id", "symbol"), local)


@query("i5_symbol_intersection", "bars roster", "SELECT symbol FROM bars INTERSECT SELECT symbol FROM roster WHERE is_active")
def _(m):
    return sets.common_symbols(m.bars, m.roster.filter("is_active"))
