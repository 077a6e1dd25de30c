"""Parsers (family A) over pages rendered from the market tables, and export rows (family B)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from bourselake.operators.lookups import one_row_per_day
from bourselake.plans import pages
from bourselake.plans.catalog import query
from bourselake.plans.oracle import fx
from bourselake.session import shared_folder
from bourselake.sinks import csv_exports, reports
from bourselake.sources import csv_files, page_tables, text_lines

D = "CAST({} AS DOUBLE)".format
_CHG = f"CASE WHEN ycp > 0 THEN {fx('(close - ycp)')} END AS change, CASE WHEN ycp > 0 THEN {fx('((close - ycp) / ycp * 100.0::DOUBLE)')} END AS change_percent"


@query(
    "a1_price_csv_rows", "prices roster",
    """SELECT symbol, date, open, high, low, close, volume, 'MENDELEY' AS source FROM prices WHERE date >= DATE '1996-01-01' AND day(date) <> 8 AND symbol IN (SELECT symbol FROM roster WHERE is_active)""",
)
def _(m):
    raw = csv_files.normalize_headers(pages.price_csv_rows(m))
    return csv_files.price_rows(raw, csv_files.active_symbols(m.roster), start="1996-01-01")


@query(
    "a1_price_csv_rejects", "prices",
    """SELECT CASE WHEN day(date) IN (9, 10) THEN 'malformed' WHEN date < DATE '1996-01-01' THEN 'before_start' WHEN day(date) = 8 THEN 'no_close' ELSE 'row' END AS outcome,
         count(*) AS lines, min(date) FILTER (day(date) NOT IN (9, 10) AND date >= DATE '1996-01-01' AND day(date) <> 8) AS first_day FROM prices GROUP BY 1""",
)
def csv_rejects(m):
    """Price files with lines cut short on each 9th and an open quote on each 10th: every line is a row or a reject."""
    raw, day = pages.price_csv_rows(m), F.dayofmonth(F.coalesce(F.try_to_date("Date"), F.try_to_date("Date", "MMM d, yyyy")))
    cells = [F.coalesce(F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"')), F.lit("")) for c in raw.columns]
    line = F.when(day == 9, F.concat_ws(",", *cells[:-2])).when(day == 10, F.concat(F.lit('"'), F.col("Trading Code"), F.lit(","), F.concat_ws(",", *cells[1:]))).otherwise(F.concat_ws(",", *cells))
    path = f"{shared_folder(m.spark)}/prices-{uuid.uuid4().hex}"
    raw.select(line.alias(",".join(raw.columns))).write.option("header", True).option("quote", "").option("sep", "\t").csv(path)
    rows, rejects = csv_files.read_prices_with_rejects(m.spark, path, start="1996-01-01")
    kept = rows.agg(F.lit("row").alias("outcome"), F.count(F.lit(1)).alias("lines"), F.min("date").alias("first_day"))
    return rejects.groupBy(F.col("reason").alias("outcome")).agg(F.count(F.lit(1)).alias("lines")).withColumn("first_day", F.lit(None).cast("date")).unionByName(kept)


@query(
    "a2_index_csv_rows", "market_index",
    """SELECT date, 'DSEX' AS index_label, index_value, CAST(NULL AS DOUBLE) AS index_open, index_value AS index_high, CAST(NULL AS DOUBLE) AS index_low, total_volume, 'MENDELEY' AS source FROM market_index WHERE date >= DATE '1996-01-01'""",
)
def _(m):
    return csv_files.index_rows(csv_files.normalize_headers(pages.index_csv_rows(m)), "DSEX", start="1996-01-01")


@query(
    "a3_day_end_pages", "prices",
    f"SELECT symbol, date, open, high, low, close, ycp, {D('trades')} AS trades, value_mn, {D('volume')} AS volume, 'DSE_SCRAPE' AS source FROM prices WHERE day(date) NOT IN (6, 7)",
)
def _(m):
    return page_tables.extract_day_end(pages.day_end_pages(m))


@query(
    "a4_closing_pages", "prices",
    f"""SELECT symbol, close, ycp, open, high, low, volume, value_mn, CASE WHEN ycp > 0 THEN {fx("(close - ycp)")} END AS change, CASE WHEN ycp > 0 THEN {fx("(ch / ycp * 100.0::DOUBLE)")} END AS change_percent FROM (
          SELECT *, CASE WHEN ycp > 0 THEN {fx("(close - ycp)")} END AS ch FROM (SELECT * REPLACE (CASE WHEN day(date) = 5 THEN NULL ELSE ycp END AS ycp) FROM prices))""",
)
def _(m):
    return page_tables.extract_closing(pages.closing_pages(m))


@query(
    "a5_breadth_pages", "market_index",
    f"""SELECT date AS page_id, index_value, {D("advancing")} AS advancing, {D("declining")} AS declining, {D("unchanged")} AS unchanged, {D("total_trades")} AS total_trades, {D("total_volume")} AS total_volume, total_value_mn FROM market_index""",
)
def _(m):
    return page_tables.extract_breadth(pages.breadth_pages(m))


@query(
    "a6_archive_pages", "prices",
    f"""SELECT symbol, date, open, high, low, close, ycp, {D("volume")} AS volume, value_mn, {D("trades")} AS trades, CASE WHEN key % 2 = 0 THEN {fx("(CAST(trades AS DOUBLE) / 4.0::DOUBLE * 1000.0::DOUBLE)")} END AS market_cap_mn, 'LANKABD' AS source, {_CHG} FROM prices""",
)
def _(m):
    return page_tables.extract_archive(pages.archive_pages(m))


@query("a7_embedded_series", "market_index", "SELECT date, index_value FROM market_index WHERE index_value > 1000 AND day(date) <> 4")
def _(m):
    return page_tables.extract_embedded_series(pages.series_pages(m))


@query("a8_company_details", "roster", "SELECT symbol, name, sector, upper(category[1]) AS category, face_value, total_shares FROM roster")
def _(m):
    return page_tables.extract_company_details(pages.company_pages(m))


_A9 = f"""SELECT symbol, fiscal_year, CASE WHEN key % 2 = 0 THEN {fx("eps_basic")} ELSE {fx("eps_basic")} END AS eps, CAST(NULL AS DOUBLE) AS eps_diluted, {fx("nav_per_share")} AS navps, {fx("net_income_mn")} AS net_income_mn, pe_ratio,
  dps AS dividend_pct, CASE WHEN dps IS NOT NULL THEN bonus_pct END AS bonus_pct, dividend_yield FROM statements"""


@query("a9_yearly_statements", "statements", _A9)
def _(m):
    return page_tables.extract_yearly_statement(pages.statement_pages(m))


@query(
    "a9_statement_records", "statements roster",
    f"""SELECT y.*, {fx("(dividend_pct / 100.0::DOUBLE * face_value)", 4)} AS dps, CASE WHEN navps > 0 THEN {fx("(eps / navps * 100.0::DOUBLE)")} END AS roe FROM ({_A9}) y LEFT JOIN (SELECT symbol, face_value FROM roster) r USING (symbol)""".replace("y.*", "y.symbol, y.fiscal_year, eps, eps_diluted, navps, net_income_mn, pe_ratio, dividend_pct, bonus_pct, dividend_yield"),
)
def _(m):
    return page_tables.statement_records(page_tables.extract_yearly_statement(pages.statement_pages(m)), m.roster)


@query("a10_dividend_cells", "fundamentals", "SELECT symbol, fiscal_year, dps AS cash_pct, CASE WHEN dps IS NOT NULL THEN bonus_pct END AS bonus_pct FROM fundamentals")
def _(m):
    t = F.when(F.col("dps").isNull(), "-").otherwise(F.concat(pages.text("dps"), F.when(F.col("bonus_pct").isNotNull(), F.concat(F.lit(", "), pages.text("bonus_pct"), F.lit("% B"))).otherwise("%")))
    return m.fundamentals.select("symbol", "fiscal_year", page_tables.dividend_cell(t).alias("d")).select("symbol", "fiscal_year", "d.*")


@query(
    "a11_dividend_history", "fundamentals roster",
    f"""SELECT f.symbol, fiscal_year AS year, round(dps * 10) AS dividend_pct, bonus_pct, {fx("(round(dps * 10) / 100.0::DOUBLE * face_value)", 4)} AS dps FROM fundamentals f JOIN (SELECT symbol, face_value FROM roster) r USING (symbol) WHERE dps IS NOT NULL""",
)
def _(m):
    return page_tables.dividend_history(pages.dividend_texts(m), "text", "face_value", "symbol")


@query(
    "a12_balance_sheet_pages", "fundamentals",
    "SELECT symbol, " + ", ".join(f"{fx(f'arg_max({x}, fiscal_year)')} AS {x}" for x in ("reserve_surplus_mn", "oci_mn", "short_term_loan_mn", "long_term_loan_mn", "authorized_capital_mn"))
    + ", '215% 2025, 330% 2024' AS cash_dividend_text FROM (SELECT * FROM fundamentals f WHERE fiscal_year = (SELECT max(fiscal_year) FROM fundamentals x WHERE x.symbol = f.symbol)) GROUP BY symbol",
)
def _(m):
    return page_tables.extract_balance_sheet(pages.balance_sheet_pages(m))


_HP = ("sponsor", "govt", "institute", "foreign", "public")


@query(
    "a13_holder_pages", "shareholding",
    "SELECT symbol, " + ", ".join(f"{fx(f'{h}_pct')} AS {h}_pct, CASE WHEN prev_as_of_date IS NOT NULL THEN {fx(f'prev_{h}_pct')} END AS prev_{h}_pct" for h in _HP) + ", as_of_date, prev_as_of_date FROM shareholding",
)
def _(m):
    return page_tables.extract_shareholding(pages.holder_pages(m))


@query("a14_block_trade_pages", "block_trades", f"SELECT symbol, date, {D('quantity')} AS quantity, value_mn, {D('trades')} AS trades, max_price, min_price, source FROM block_trades WHERE day(date) <> 3")
def _(m):
    return page_tables.extract_block_trades(pages.block_trade_pages(m))


@query(
    "a15_dividend_archive", "corporate_actions",
    """SELECT symbol, event_type, coalesce(CASE WHEN key % 4 <> 2 THEN event_date END, CASE WHEN key % 8 <> 2 THEN record_date END) AS event_date, CASE WHEN key % 8 <> 2 THEN record_date END AS record_date, agm_date,
         CASE WHEN cash_dps > 0 THEN cash_dps END AS cash_dps, CASE WHEN bonus_pct > 0 THEN bonus_pct END AS bonus_pct, CASE WHEN key % 5 <> 3 THEN fiscal_year END AS fiscal_year, 'LANKABD' AS source
       FROM corporate_actions WHERE key % 8 <> 2""",
)
def _(m):
    return page_tables.extract_dividend_archive(pages.dividend_archive_pages(m))


@query("a16_tick_rows", "prices", "SELECT symbol, close AS ltp, change, change_percent FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS k FROM prices WHERE change IS NOT NULL) WHERE k = 1")
def _(m):
    return text_lines.extract_tick_rows(pages.tick_texts(m), "date")


_A17 = f"""SELECT symbol, {fx("e")} AS eps_basic, {fx("n")} AS nav_per_share FROM (SELECT symbol, arg_min(eps_basic, fiscal_year) FILTER (fiscal_year % 2 = 0) AS e, arg_min(nav_per_share, fiscal_year) FILTER (fiscal_year % 2 = 1) AS n FROM fundamentals GROUP BY symbol) WHERE e IS NOT NULL"""


@query("a17_disclosure_prose", "fundamentals", _A17)
def _(m):
    return text_lines.extract_disclosure_prose(pages.prose_texts(m), "symbol", "fiscal_year")


_WORDS = "(revenue|total assets|total liabilities|gross profit|net profit|cash flow|earnings per share|shareholders)"


@query(
    "a18_content_mode", "",
    f"SELECT doc_id, CASE WHEN regexp_replace(coalesce(text, ''), '\\s+', '', 'g') = '' THEN 'EMPTY' WHEN regexp_matches(text, '(?i){_WORDS}') THEN 'DIGITAL_VECTOR' ELSE 'SCANNED_IMAGE' END AS mode FROM documents",
)
def _(m):
    return m.table("documents").select("doc_id", text_lines.content_mode(F.col("text")).alias("mode"))


_LC = ("revenue_mn", "gross_profit_mn", "total_assets_mn", "total_liabilities_mn", "capex_mn", "operating_cash_flow_mn")


@query(
    "a19_statement_lines", "fundamentals",
    f"SELECT *, {fx('(operating_cash_flow_mn - capex_mn)')} AS free_cash_flow_mn FROM (SELECT symbol, fiscal_year, {', '.join(f'{fx(x, 4)} AS {x}' for x in _LC)} FROM fundamentals)",
)
def _(m):
    return text_lines.statement_lines_to_columns(pages.statement_lines(m), "symbol", "fiscal_year")


@query("a20_active_symbols", "roster", "SELECT symbol FROM roster WHERE is_active")
def _(m):
    return csv_files.active_symbols(m.roster)


_A21 = f"""SELECT symbol, close AS ltp, high, low, close, ycp, {D("volume")} AS volume, {fx("value_mn")} AS value_mn, {fx("ch")} AS change, CASE WHEN ycp > 0 THEN {fx("(ch / ycp * 100.0::DOUBLE)")} END AS change_percent FROM (
  SELECT *, coalesce(CASE WHEN key % 2 = 0 THEN change END, close - ycp) AS ch FROM prices p WHERE date = (SELECT max(date) FROM prices x WHERE x.symbol = p.symbol))"""


@query("a21_live_snapshot", "prices", _A21)
def _(m):
    return page_tables.extract_live_snapshot(pages.live_pages(m))


@query(
    "a21_snapshot_breadth", "prices",
    f"SELECT count(*) FILTER (change > 0) AS advancing, count(*) FILTER (change < 0) AS declining, count(*) FILTER (change = 0) AS unchanged, sum(volume) AS total_volume, count(*) AS issues FROM ({_A21})",
)
def _(m):
    return page_tables.snapshot_breadth(page_tables.extract_live_snapshot(pages.live_pages(m)))


@query(
    "a22_recent_index", "market_index",
    f"SELECT date, index_value, CASE WHEN day(date) <> 2 THEN total_value_mn END AS turnover_mn, {D('total_volume')} AS total_volume, 'DSE_OFFICIAL_BENCHMARK' AS source FROM market_index WHERE index_value > 1000",
)
def _(m):
    return page_tables.extract_recent_index(pages.recent_index_pages(m))


@query("a3_rows_per_raw_page", "", "SELECT page_id, len(regexp_extract_all(html, '(?is)<tr[^>]*>(.*?)</tr>', 1)) AS table_rows FROM pages")
def _(m):
    found = F.regexp_extract_all("html", F.lit(page_tables.ROW), F.lit(1))
    return m.table("pages").select("page_id", F.size(found).alias("table_rows"))


# -- export rows: what the writers of family B put into files ---------------------------------------------------------


@query("b1_price_export", "prices", f"SELECT {', '.join(csv_exports.PRICE_COLUMNS)} FROM prices")
def _(m):
    return csv_exports.price_export_rows(m.prices)


@query("b2_index_export", "market_index", f"SELECT {', '.join(csv_exports.INDEX_COLUMNS)} FROM market_index")
def _(m):
    return csv_exports.index_export_rows(m.index)


@query(
    "b3_latest_fundamentals_export", "fundamentals roster",
    f"SELECT {', '.join(csv_exports.LATEST_COLUMNS)} FROM (SELECT f.*, r.name, r.sector, r.category FROM fundamentals f LEFT JOIN (SELECT symbol, name, sector, category FROM roster) r USING (symbol) WHERE fiscal_year = (SELECT max(fiscal_year) FROM fundamentals x WHERE x.symbol = f.symbol))",
)
def _(m):
    return csv_exports.latest_fundamentals_export_rows(m.fundamentals, m.roster)


@query("b4_statement_export", "statements", f"SELECT {', '.join(csv_exports.STATEMENT_COLUMNS)} FROM statements")
def _(m):
    return csv_exports.statement_export_rows(m.statements)


@query("b5_payment_export", "payments users", "SELECT p.txn, p.user_id, u.email, p.amount_bdt, p.status, p.plan, p.created_at FROM payments p LEFT JOIN users u USING (user_id)")
def _(m):
    from bourselake.operators.access import payments_with_users

    return payments_with_users(m.payments, m.users).orderBy(F.desc("created_at"))


@query(
    "b6_snapshot_header", "prices roster",
    """SELECT count(*) AS count, count(*) FILTER (close > ycp) AS advancing, count(*) FILTER (close < ycp) AS declining, count(*) FILTER (close = ycp) AS unchanged FROM prices p WHERE date = (SELECT max(date) FROM prices x WHERE x.symbol = p.symbol)""",
)
def _(m):
    from bourselake.operators.lookups import latest_price

    return reports.snapshot_header(latest_price(m.prices).withColumnRenamed("close", "ltp"))


@query(
    "b7_audit_report_rows", "prices_dirty asof_day",
    """SELECT (SELECT d FROM asof_day) AS run_at, 'prices' AS target_entity, CAST(sum(n) AS BIGINT) AS records_audited, count(*) FILTER (coalesce(c, 0) <= 0) AS errors_count,
         CASE WHEN count(*) FILTER (coalesce(c, 0) <= 0) = 0 THEN 'CERTIFIED_PASSED' ELSE 'AUDIT_FAILED' END AS status
       FROM (SELECT first(close ORDER BY seq) AS c, count(*) AS n FROM prices_dirty GROUP BY symbol, date)""",
)
def _(m):
    from bourselake.operators import audits

    s = audits.summary(audits.audit_prices(m.prices_dirty, "seq"), "prices", F.col("records"))
    return reports.audit_report_rows(s, run_at=m.as_of).drop("report_json", "warnings_count")


@query("b8_mismatch_export", "prices_existing prices_incoming", "SELECT symbol, date, a.close AS db_close, b.close AS other_close, a.source AS db_source FROM prices_existing a JOIN (SELECT * FROM prices_incoming QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY seq DESC) = 1) b USING (symbol, date) WHERE abs(a.close - b.close) > 0.05")
def _(m):
    from bourselake.operators import reconcile

    d = reconcile.price_mismatches(reconcile.paired_prices(m.prices_existing, one_row_per_day(m.prices_incoming, "seq")))
    return d.select("symbol", "date", "db_close", "other_close", "db_source").orderBy("symbol", "date")


_PARSED = "(SELECT symbol || '|' || fiscal_year AS filing, CASE WHEN net_income_mn < 0 THEN NULL ELSE eps_basic END AS eps_basic, CASE WHEN net_income_mn < 0 THEN NULL ELSE nav_per_share END AS nav_per_share FROM fundamentals WHERE audit_status = 'Audited' OR net_income_mn < 0)"


@query(
    "a19_prose_where_missing", "fundamentals",
    f"""SELECT filing, CASE WHEN t.eps_basic IS NULL AND t.nav_per_share IS NULL THEN p.eps_basic ELSE t.eps_basic END AS eps_basic,
         CASE WHEN t.eps_basic IS NULL AND t.nav_per_share IS NULL THEN p.nav_per_share ELSE t.nav_per_share END AS nav_per_share
       FROM {_PARSED} t FULL JOIN (SELECT symbol || '|' || fiscal_year AS filing, eps_basic, nav_per_share FROM fundamentals) p USING (filing)""",
)
def _(m):
    """Tables that hold no figures for years with a loss, and prose that has them for every year."""
    filed = m.fundamentals.withColumn("filing", F.concat_ws("|", "symbol", F.col("fiscal_year").cast("string")))
    loss = F.col("net_income_mn") < 0
    parsed = filed.filter(loss | (F.col("audit_status") == "Audited"))
    parsed = parsed.withColumns({c: F.when(loss, F.lit(None)).otherwise(F.col(c)) for c in ("eps_basic", "nav_per_share")})
    return text_lines.prose_where_missing(parsed, filed.select("filing", "eps_basic", "nav_per_share"), "filing")
