"""Audits (family K), reconciliation (L) and the conditional aggregates of family F that serve them."""

from __future__ import annotations

from pyspark.sql import functions as F

from bourselake.operators import audits, market, reconcile
from bourselake.operators.lookups import one_row_per_day
from bourselake.plans.catalog import query
from bourselake.plans.oracle import fx, tier

_ISO = "'^[0-9]{4}-[0-9]{2}-[0-9]{2}$'"


def finding_sql(entity: str, source: str, key: str, errors: dict[str, str], warnings: dict[str, str] | None = None) -> str:
    parts = [f"SELECT '{entity}' AS entity, 'error' AS severity, '{n}' AS \"check\", {key} AS key FROM {source} WHERE {c}" for n, c in errors.items()]
    parts += [f"SELECT '{entity}', 'warning', '{n}', {key} FROM {source} WHERE {c}" for n, c in (warnings or {}).items()]
    return " UNION ALL ".join(parts)


def counts_sql(source: str, checks: dict[str, str]) -> str:
    return f"SELECT count(*) AS total, {', '.join(f'count(*) FILTER ({c}) AS {n}' for n, c in checks.items())} FROM {source}"


def _key(*cols):
    return F.concat_ws("|", *[F.col(c).cast("string") for c in cols])


# -- price gate -------------------------------------------------------------------------------------------------------

_K1 = """(SELECT *, lag(last_close) OVER (PARTITION BY symbol ORDER BY date) AS prev FROM (
   SELECT symbol, date, first(close ORDER BY seq) AS close, first(ycp ORDER BY seq) AS ycp, first(pe ORDER BY seq) AS pe, first(volume ORDER BY seq) AS volume,
     last(close ORDER BY seq) AS last_close, count(*) AS records FROM prices_dirty GROUP BY symbol, date))"""
_K1_E = {"non_positive_close": "coalesce(close, 0) <= 0"}
_K1_W = {
    "duplicate_day": "records > 1",
    "price_swing": "coalesce(close, 0) > 0 AND prev > 0 AND (close / prev > 3.0 OR close / prev < 0.25)",
    "unusual_pe": "coalesce(close, 0) > 0 AND (pe < 0 OR pe > 300)",
}


@query("k1_price_gate_findings", "prices_dirty", finding_sql("prices", _K1, "symbol || '|' || CAST(date AS VARCHAR)", _K1_E, _K1_W))
def _(m):
    return audits.findings(audits.audit_prices(m.prices_dirty, "seq"), "prices", _key("symbol", "date"))


@query(
    "k1_price_gate_cleaned", "prices_dirty",
    f"""SELECT symbol, date, close, ycp, volume, pe, records, CASE WHEN ycp > 0 THEN {fx("(close - ycp)")} END AS change,
          CASE WHEN ycp > 0 THEN {fx("((close - ycp) / ycp * 100.0::DOUBLE)")} END AS change_percent FROM {_K1} WHERE close > 0""",
)
def _(m):
    return audits.cleaned(audits.audit_prices(m.prices_dirty, "seq")).drop("prev_close")


@query(
    "k1_price_gate_summary", "prices_dirty",
    f"""SELECT 'prices' AS entity, CAST(sum(records) AS BIGINT) AS records, count(*) FILTER ({_K1_E["non_positive_close"]}) AS errors,
          {" + ".join(f"count(*) FILTER ({c})" for c in _K1_W.values())} AS warnings,
          CASE WHEN count(*) FILTER ({_K1_E["non_positive_close"]}) = 0 THEN 'CERTIFIED_PASSED' ELSE 'AUDIT_FAILED' END AS status FROM {_K1}""",
)
def full_price_audit(m):
    return audits.summary(audits.audit_prices(m.prices_dirty, "seq"), "prices", F.col("records"))


# -- statement gate ---------------------------------------------------------------------------------------------------


def _statements_dirty(m):
    """Statements with some values spoiled and some years reported twice."""
    f = m.fundamentals
    k, y = F.col("key"), F.col("fiscal_year")
    copies = F.when(k % 10 == 4, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return (
        f.withColumn("seq", F.explode(copies))
        .withColumn("dps", F.when((k % 6 == 1) & (y % 3 == 0), -F.col("dps")).otherwise(F.col("dps")))
        .withColumn("gross_profit_mn", F.when(k % 8 == 3, F.col("gross_profit_mn") * 2.0).otherwise(F.col("gross_profit_mn")))
        .withColumn("free_cash_flow_mn", F.when(k % 7 == 2, F.col("free_cash_flow_mn") + 0.25).otherwise(F.col("free_cash_flow_mn")))
        .withColumn("short_term_loan_mn", F.when(k % 9 == 5, F.lit(-1.0)).otherwise(F.col("short_term_loan_mn")))
        .withColumn("nav_per_share", F.when(k % 12 == 7, F.lit(0.0)).otherwise(F.col("nav_per_share")))
        .withColumn("fiscal_year", F.when((k % 15 == 8) & (y == 1996), F.lit(1889)).otherwise(y))
    )


_SD = """(SELECT * REPLACE (CASE WHEN key % 6 = 1 AND fiscal_year % 3 = 0 THEN -dps ELSE dps END AS dps, CASE WHEN key % 8 = 3 THEN gross_profit_mn * 2.0::DOUBLE ELSE gross_profit_mn END AS gross_profit_mn,
   CASE WHEN key % 7 = 2 THEN free_cash_flow_mn + 0.25::DOUBLE ELSE free_cash_flow_mn END AS free_cash_flow_mn, CASE WHEN key % 9 = 5 THEN -1.0::DOUBLE ELSE short_term_loan_mn END AS short_term_loan_mn,
   CASE WHEN key % 12 = 7 THEN 0.0::DOUBLE ELSE nav_per_share END AS nav_per_share, CASE WHEN key % 15 = 8 AND fiscal_year = 1996 THEN 1889 ELSE fiscal_year END AS fiscal_year),
   CASE WHEN key % 10 = 4 THEN 2 ELSE 1 END AS records FROM fundamentals)"""
_K2_E = {
    "invalid_year": "fiscal_year < 1990 OR fiscal_year > 2050",
    "negative_dps": "dps < 0",
    "negative_bonus": "bonus_pct < 0",
    "negative_short_loan": "short_term_loan_mn < 0",
    "negative_long_loan": "long_term_loan_mn < 0",
    "negative_revenue": "revenue_mn < 0",
    "gross_above_revenue": "gross_profit_mn > revenue_mn",
    "negative_assets": "total_assets_mn < 0",
    "negative_liabilities": "total_liabilities_mn < 0",
    "cash_flow_mismatch": f"abs(free_cash_flow_mn - {fx('(operating_cash_flow_mn - capex_mn)')}) > 0.05",
}
_K2_W = {"duplicate_year": "records > 1", "outlier_eps": "eps_basic < -200 OR eps_basic > 1000", "non_positive_nav": "nav_per_share <= 0"}


@query("k2_statement_gate_findings", "fundamentals", finding_sql("fundamentals", _SD, "symbol || '|' || fiscal_year", _K2_E, _K2_W))
def _(m):
    return audits.findings(audits.audit_statements(_statements_dirty(m), "seq"), "fundamentals", _key("symbol", "fiscal_year"))


@query(
    "k2_statement_gate_cleaned", "fundamentals",
    f"""SELECT symbol, fiscal_year, records, eps_basic, dps, CASE WHEN nav_per_share > 0 THEN {fx("(eps_basic / nav_per_share * 100.0::DOUBLE)")} END AS roe
        FROM {_SD} WHERE {" AND ".join(f"NOT coalesce({c}, false)" for c in _K2_E.values())}""",
)
def _(m):
    return audits.cleaned(audits.audit_statements(_statements_dirty(m), "seq")).select("symbol", "fiscal_year", "records", "eps_basic", "dps", "roe")


# -- index, breadth, roster, holders, block trades --------------------------------------------------------------------


def _index_dirty(m):
    d = F.dayofmonth("date")
    v = F.when(d == 3, F.col("index_value") * 50.0).when(d != 4, F.col("index_value"))
    fake = (d == 6) & (F.month("date") == 6)
    swap = lambda c, x: F.when(fake, F.lit(x)).otherwise(F.col(c))
    return m.index.select(
        "date", v.alias("index_value"), swap("advancing", 180).cast("long").alias("advancing"), swap("declining", 140).cast("long").alias("declining"),
        swap("unchanged", 60).cast("long").alias("unchanged"), F.when(d == 8, "MADE_UP_SOURCE").when(d != 9, F.col("source")).alias("source"),
    )


_ID = """(SELECT date, CASE WHEN day(date) = 3 THEN index_value * 50.0::DOUBLE WHEN day(date) = 4 THEN NULL ELSE index_value END AS index_value,
   CASE WHEN f THEN 180 ELSE advancing END AS advancing, CASE WHEN f THEN 140 ELSE declining END AS declining, CASE WHEN f THEN 60 ELSE unchanged END AS unchanged,
   CASE WHEN day(date) = 8 THEN 'MADE_UP_SOURCE' WHEN day(date) = 9 THEN NULL ELSE source END AS source FROM (SELECT *, day(date) = 6 AND month(date) = 6 AS f FROM market_index))"""
_OUT = "index_value < 500 OR index_value > 20000"
_FAKE = "advancing = 180 AND declining = 140 AND unchanged = 60"


@query("k3_index_gate_findings", "market_index", finding_sql("index", _ID, "CAST(date AS VARCHAR)", {"out_of_range": _OUT}, {"missing_value": "index_value IS NULL"}))
def _(m):
    return audits.findings(audits.audit_index(_index_dirty(m)), "index", _key("date"))


@query("k4_breadth_gate_findings", "market_index", finding_sql("breadth", _ID, "CAST(date AS VARCHAR)", {"out_of_range": _OUT, "fabricated_breadth": _FAKE}))
def _(m):
    return audits.findings(audits.audit_breadth(_index_dirty(m)), "breadth", _key("date"))


_DS = f"(SELECT *, CASE WHEN prev_close > 0 THEN {fx('((ds30_index - prev_close) / prev_close * 100.0::DOUBLE)')} END AS g FROM (SELECT date, CASE WHEN day(date) = 3 THEN ds30_index * 9.0::DOUBLE ELSE ds30_index END AS ds30_index, prev_close FROM ds30))"


@query(
    "k5_ds30_gate_findings", "ds30",
    finding_sql("ds30", _DS, "CAST(date AS VARCHAR)", {"out_of_range": "ds30_index < 500 OR ds30_index > 8000", "previous_out_of_range": "prev_close < 500 OR prev_close > 8000"}, {"large_change": "abs(g) > 15"}),
)
def _(m):
    d = m.ds30.withColumn("ds30_index", F.when(F.dayofmonth("date") == 3, F.col("ds30_index") * 9.0).otherwise(F.col("ds30_index")))
    return audits.findings(audits.audit_ds30(d), "ds30", _key("date"))


_RO = "(SELECT * REPLACE (CASE WHEN key % 17 = 3 THEN '  ' ELSE symbol END AS symbol, CASE WHEN key % 12 = 1 THEN -5.0::DOUBLE ELSE face_value END AS face_value, CASE WHEN key % 19 = 2 THEN 0.0::DOUBLE ELSE total_shares END AS total_shares) FROM roster)"


@query("k6_roster_gate_findings", "roster", finding_sql("roster", _RO, "name", {"missing_symbol": "trim(symbol) = ''", "bad_face_value": "face_value <= 0", "bad_total_shares": "total_shares <= 0"}))
def _(m):
    k = F.col("key")
    r = (
        m.roster.withColumn("symbol", F.when(k % 17 == 3, "  ").otherwise(F.col("symbol")))
        .withColumn("face_value", F.when(k % 12 == 1, F.lit(-5.0)).otherwise(F.col("face_value")))
        .withColumn("total_shares", F.when(k % 19 == 2, F.lit(0.0)).otherwise(F.col("total_shares")))
    )
    return audits.findings(audits.audit_roster(r), "roster", F.col("name"))


_H = ("sponsor", "govt", "institute", "foreign", "public")
_SHD = "(SELECT * REPLACE (CASE WHEN key % 14 = 3 THEN NULL ELSE govt_pct END AS govt_pct, CASE WHEN key % 16 = 5 THEN -1.0::DOUBLE ELSE foreign_pct END AS foreign_pct) FROM shareholding)"
_K7 = {f"missing_{h}": f"{h}_pct IS NULL" for h in _H} | {f"bad_{h}": f"{h}_pct < 0 OR {h}_pct > 100" for h in _H}
_K7["sum_not_100"] = " AND ".join(f"{h}_pct BETWEEN 0 AND 100" for h in _H) + f" AND abs({' + '.join(f'{h}_pct' for h in _H)} - 100.0) > 1.0"


@query("k7_shareholding_gate_findings", "shareholding", finding_sql("shareholding", _SHD, "symbol", _K7))
def _(m):
    k = F.col("key")
    s = m.shareholding.withColumn("govt_pct", F.when(k % 14 != 3, F.col("govt_pct"))).withColumn("foreign_pct", F.when(k % 16 == 5, F.lit(-1.0)).otherwise(F.col("foreign_pct")))
    return audits.findings(audits.audit_shareholding(s), "shareholding", F.col("symbol"))


_BT = """(SELECT * REPLACE (CASE WHEN day(date) = 2 THEN 0 ELSE quantity END AS quantity, CASE WHEN day(date) IN (2, 5) THEN -1.0::DOUBLE WHEN day(date) = 7 THEN NULL ELSE value_mn END AS value_mn,
   CASE WHEN day(date) = 9 THEN max_price + 1.0::DOUBLE ELSE min_price END AS min_price), CASE WHEN day(date) = 11 THEN 2 ELSE 1 END AS records FROM block_trades)"""


@query(
    "k8_block_trade_gate_findings", "block_trades",
    finding_sql("block_trades", _BT, "symbol || '|' || CAST(date AS VARCHAR)",
                {"bad_quantity": "NOT coalesce(quantity > 0, false)", "bad_value": "quantity > 0 AND value_mn <= 0", "inverted_prices": "quantity > 0 AND NOT coalesce(value_mn <= 0, false) AND min_price > max_price"},
                {"duplicate_day": "records > 1"}),
)
def _(m):
    d = F.dayofmonth("date")
    copies = F.when(d == 11, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    b = (
        m.block_trades.withColumn("quantity", F.when(d == 2, F.lit(0)).otherwise(F.col("quantity")))
        .withColumn("value_mn", F.when(d.isin(2, 5), F.lit(-1.0)).when(d != 7, F.col("value_mn")))
        .withColumn("min_price", F.when(d == 9, F.col("max_price") + 1.0).otherwise(F.col("min_price")))
        .withColumn("seq", F.explode(copies))
    )
    return audits.findings(audits.audit_block_trades(b, "seq"), "block_trades", _key("symbol", "date"))


# -- table audits -----------------------------------------------------------------------------------------------------



def domain_sql(domains: dict[str, audits.Domain], order: tuple[tuple[str, str], ...]) -> dict[str, str]:
    """The conditions of a table of domains in SQL."""
    bounds = (("low", "{0} < {1}"), ("high", "{0} > {1}"), ("above", "{0} <= {1}"))
    out = {}
    for name, d in domains.items():
        broken = [sql.format(name, getattr(d, side)) for side, sql in bounds if getattr(d, side) is not None] + [f"{name} = 0"] * d.nonzero
        out |= {f"{name}_outside": " OR ".join(broken)} if broken else {}
        out |= {f"{name}_missing": f"{name} IS NULL"} if d.required else {}
    return out | {f"{x}_above_{y}": f"{x} > {y}" for x, y in order}


_SOURCE = {"source_unapproved": f"source IS NOT NULL AND {tier('source')} IS NULL"}
_K9 = domain_sql(audits.PRICE_DOMAINS, audits.PRICE_ORDER) | _SOURCE
_F4 = ("close_outside", "ycp_missing", "pe_outside")


@query("k9_price_table_audit", "prices_dirty", counts_sql("prices_dirty", _K9))
def price_table_audit(m):
    return audits.conditional_counts(m.prices_dirty, audits.price_table_checks())


@query("f4_conditional_counts", "prices_dirty", counts_sql("prices_dirty", {k: _K9[k] for k in _F4}))
def _(m):
    c = audits.price_table_checks()
    return audits.conditional_counts(m.prices_dirty, {k: c[k] for k in _F4})


_K10 = {
    "range_violations": f"index_value IS NULL OR {_OUT}", "invalid_date": f"NOT regexp_matches(CAST(date AS VARCHAR), {_ISO})",
    "unapproved_source": f"source IS NOT NULL AND {tier('source')} IS NULL", "fabricated_breadth": _FAKE,
}


@query("k10_index_table_audit", "market_index", counts_sql(_ID, _K10))
def _(m):
    return audits.conditional_counts(_index_dirty(m), audits.index_table_checks("index_value", audits.INDEX_RANGE))


@query("k10_ds30_table_audit", "ds30", counts_sql("ds30", {"range_violations": "ds30_index IS NULL OR ds30_index < 500 OR ds30_index > 8000", "invalid_date": _K10["invalid_date"], "unapproved_source": _K10["unapproved_source"]}))
def _(m):
    return audits.conditional_counts(m.ds30, audits.index_table_checks("ds30_index", audits.DS30_RANGE))


_K11 = domain_sql(audits.STATEMENT_DOMAINS, audits.STATEMENT_ORDER) | _SOURCE
_K11["free_cash_flow_off"] = "abs(free_cash_flow_mn - (operating_cash_flow_mn - capex_mn)) > 0.05"


@query("k11_statement_table_audit", "fundamentals", counts_sql(f"(SELECT *, CASE WHEN key % 11 = 4 THEN 0.0::DOUBLE END AS pe_ratio FROM {_SD})", _K11))
def statement_table_audit(m):
    d = one_row_per_day(_statements_dirty(m), "seq", ("symbol", "fiscal_year")).withColumn("pe_ratio", F.when(F.col("key") % 11 == 4, F.lit(0.0)))
    return audits.conditional_counts(d, audits.statement_table_checks())


_K11_LATEST = """(SELECT * REPLACE (CASE WHEN key % 10 = 2 THEN 0.0::DOUBLE ELSE paid_up_capital_mn END AS paid_up_capital_mn, CASE WHEN key % 12 = 7 THEN 0.0::DOUBLE ELSE nav_per_share END AS nav_per_share),
   CASE key % 9 WHEN 4 THEN 0.0::DOUBLE WHEN 5 THEN NULL ELSE 11.5::DOUBLE END AS pe_ratio, CASE WHEN key % 7 = 2 THEN 0.0::DOUBLE END AS pe_diluted,
   CASE key % 8 WHEN 3 THEN 0.0::DOUBLE WHEN 4 THEN 9.0::DOUBLE END AS pe_trailing
   FROM fundamentals f WHERE fiscal_year = (SELECT max(fiscal_year) FROM fundamentals x WHERE x.symbol = f.symbol))"""


@query(
    "k11_latest_statement_audit", "fundamentals",
    counts_sql(_K11_LATEST, {"zero_pe": "pe_ratio = 0 OR pe_diluted = 0 OR pe_trailing = 0", "zero_paid_up": "paid_up_capital_mn = 0", "bad_nav": "nav_per_share <= 0"}),
)
def _(m):
    from bourselake.operators.lookups import latest_by

    k, zero = F.col("key"), F.lit(0.0)
    latest = latest_by(m.fundamentals, "symbol", "fiscal_year")
    latest = latest.withColumn("paid_up_capital_mn", F.when(k % 10 == 2, zero).otherwise(F.col("paid_up_capital_mn"))).withColumn("nav_per_share", F.when(k % 12 == 7, zero).otherwise(F.col("nav_per_share")))
    latest = latest.withColumn("pe_ratio", F.when(k % 9 == 4, zero).when(k % 9 != 5, 11.5)).withColumn("pe_diluted", F.when(k % 7 == 2, zero)).withColumn("pe_trailing", F.when(k % 8 == 3, zero).when(k % 8 == 4, 9.0))
    return audits.conditional_counts(latest, audits.latest_statement_checks())


def _counts_while_written(m, table, rows, checks):
    """Writes the rows and returns the counts observed on the way, in the form of conditional_counts."""
    from bourselake.plans.catalog_streaming import new_store

    counts = new_store(m).commit({table: (rows, None)}, counts={table: checks}).audit[table]
    return m.spark.createDataFrame([tuple(counts.values())], ", ".join(f"{n} long" for n in counts))


@query("k9_price_audit_while_written", "prices_dirty", counts_sql("prices_dirty", _K9))
def price_audit_while_written(m):
    return _counts_while_written(m, "prices", m.prices_dirty, audits.price_table_checks())


@query("k11_statement_audit_while_written", "fundamentals", counts_sql(f"(SELECT *, CASE WHEN key % 11 = 4 THEN 0.0::DOUBLE END AS pe_ratio FROM {_SD})", _K11))
def _(m):
    d = one_row_per_day(_statements_dirty(m), "seq", ("symbol", "fiscal_year")).withColumn("pe_ratio", F.when(F.col("key") % 11 == 4, F.lit(0.0)))
    return _counts_while_written(m, "fundamentals", d, audits.statement_table_checks())


@query("k10_index_audit_while_written", "market_index", counts_sql(_ID, _K10))
def _(m):
    return _counts_while_written(m, "index", _index_dirty(m), audits.index_table_checks("index_value", audits.INDEX_RANGE))


_SUM = " + ".join(f"coalesce({h}_pct, 0)" for h in _H)


@query("k12_shareholding_table_audit", "shareholding", counts_sql(_SHD, {"missing_symbol": "symbol IS NULL", "bad_as_of": f"NOT regexp_matches(CAST(as_of_date AS VARCHAR), {_ISO})", "sum_off": f"{_SUM} > 0 AND abs({_SUM} - 100.0) > 1.0"}))
def _(m):
    k = F.col("key")
    s = m.shareholding.withColumn("govt_pct", F.when(k % 14 != 3, F.col("govt_pct"))).withColumn("foreign_pct", F.when(k % 16 == 5, F.lit(-1.0)).otherwise(F.col("foreign_pct")))
    return audits.conditional_counts(s, audits.shareholding_table_checks())


@query("k12_roster_table_audit", "roster", counts_sql("roster", {"missing_symbol": "symbol IS NULL", "bad_face_value": "face_value <= 0", "active": "is_active"}))
def _(m):
    return audits.conditional_counts(m.roster, audits.roster_table_checks())


_PRICE = "CASE plan WHEN 'WEEKLY' THEN 100 WHEN 'MONTHLY' THEN 300 WHEN 'QUARTERLY' THEN 700 WHEN 'HALF_YEARLY' THEN 1000 END"


@query("k13_payment_audit", "payments", finding_sql("payments", "payments", "CAST(txn AS VARCHAR)", {"unknown_plan": f"{_PRICE} IS NULL", "amount_mismatch": f"status = 'SUCCESS' AND amount_bdt <> {_PRICE}"}))
def _(m):
    return audits.findings(audits.audit_payments(m.payments), "payments", _key("txn"))


@query("k13_expired_sessions", "payments", "SELECT count(*) AS total, count(*) FILTER (created_at + 30 < DATE '2000-01-01') AS expired FROM payments")
def _(m):
    import datetime as dt

    s = m.payments.select(F.date_add("created_at", 30).alias("expires_at"))
    return audits.expired_sessions(s, as_of=dt.date(2000, 1, 1))


_CA = "(SELECT * REPLACE (CASE WHEN key % 9 = 2 THEN 'SPLIT' ELSE event_type END AS event_type, CASE WHEN key % 10 = 3 THEN 'RUMOUR' ELSE source END AS source, CASE WHEN key % 21 = 5 THEN '' ELSE symbol END AS symbol) FROM corporate_actions)"


@query(
    "k15_corporate_action_audit", "corporate_actions",
    finding_sql("corporate_actions", _CA, "key || '|' || fiscal_year", {
        "bad_symbol": "length(symbol) NOT BETWEEN 1 AND 20", "unknown_type": "event_type NOT IN ('DIVIDEND', 'AGM', 'CATEGORY_CHANGE', 'NEW_LISTING', 'DS30_REBALANCE')",
        "bad_event_date": "event_date IS NULL", "bad_record_date": f"NOT regexp_matches(CAST(record_date AS VARCHAR), {_ISO})", "unapproved_source": f"{tier('source')} IS NULL"}),
)
def _(m):
    k = F.col("key")
    a = (
        m.corporate_actions.withColumn("event_type", F.when(k % 9 == 2, "SPLIT").otherwise(F.col("event_type")))
        .withColumn("source", F.when(k % 10 == 3, "RUMOUR").otherwise(F.col("source")))
        .withColumn("symbol", F.when(k % 21 == 5, "").otherwise(F.col("symbol")))
    )
    return audits.findings(audits.audit_corporate_actions(a), "corporate_actions", _key("key", "fiscal_year"))


@query(
    "k16_macro_audit", "market_index",
    """SELECT records, tbill, bad_dates, CAST(records = 0 AS INTEGER) + CAST(records > 0 AND tbill IS NULL AS INTEGER) + CAST(coalesce(tbill <= 0 OR tbill > 0.30, false) AS INTEGER) + CAST(bad_dates > 0 AS INTEGER) AS n_errors FROM (
         SELECT count(*) AS records, max(value) FILTER (k = 'BANGLADESH_364D_TBILL') AS tbill, CAST(0 AS BIGINT) AS bad_dates FROM (
           SELECT CASE WHEN date = (SELECT max(date) FROM market_index) THEN 'BANGLADESH_364D_TBILL' ELSE 'LEVEL' END AS k, index_value / 1e4::DOUBLE AS value FROM market_index))""",
)
def _(m):
    last = m.as_of
    macro = m.index.select(
        F.when(F.col("date") == F.lit(last), audits.TBILL_KEY).otherwise("LEVEL").alias("indicator_key"), (F.col("index_value") / 1e4).alias("value"), F.col("date").alias("as_of_date")
    )
    return audits.audit_macro(macro).select("records", "tbill", "bad_dates", F.size("errors").alias("n_errors"))


_Q = """(SELECT CASE day(date) % 4 WHEN 0 THEN 'PENDING_USER_APPROVAL' WHEN 1 THEN 'APPROVED_BY_USER' WHEN 2 THEN 'REJECTED_BY_USER' ELSE 'LOST' END AS status, count(*) AS rows FROM bars GROUP BY 1)"""


@query("k17_quarantine_audit", "bars", f"SELECT status, rows, status = 'LOST' AS unknown_status, status = 'PENDING_USER_APPROVAL' AS pending FROM {_Q}")
def _(m):
    d = F.dayofmonth("date") % 4
    q = m.bars.select(F.when(d == 0, "PENDING_USER_APPROVAL").when(d == 1, "APPROVED_BY_USER").when(d == 2, "REJECTED_BY_USER").otherwise("LOST").alias("status"))
    g = audits.audit_quarantine(q)
    return g.select("status", "rows", F.array_contains("errors", "unknown_status").alias("unknown_status"), F.array_contains("errors", "pending").alias("pending"))


# -- gaps -------------------------------------------------------------------------------------------------------------


@query(
    "k18_stale_symbols", "roster bars asof_day",
    """SELECT r.symbol, r.name, l.d AS last_traded, coalesce(l.n, 0) AS total_sessions, coalesce((SELECT d FROM asof_day) - l.d, 9999) AS days_behind
       FROM roster r LEFT JOIN (SELECT symbol, max(date) AS d, count(*) AS n FROM bars GROUP BY symbol) l USING (symbol)
       WHERE r.is_active AND r.trading_status = 'Active' AND (l.d IS NULL OR l.d < (SELECT d FROM asof_day) - 3)""",
)
def _(m):
    return audits.stale_symbols(m.roster, m.bars, market_day=m.as_of, days=3)


@query(
    "k18_statement_gaps", "roster fundamentals",
    """SELECT symbol, sector, coalesce(n, 0) AS years_recorded, latest_year, NOT (a IS NULL AND b IS NULL AND c IS NULL) AS balance_sheet_present, d IS NOT NULL AS dps_present FROM roster r LEFT JOIN (
         SELECT symbol, count(*) AS n, max(fiscal_year) AS latest_year, max(CASE WHEN key % 5 <> 2 THEN reserve_surplus_mn END) AS a, max(CASE WHEN key % 5 <> 2 THEN short_term_loan_mn END) AS b,
           max(CASE WHEN key % 5 <> 2 THEN long_term_loan_mn END) AS c, max(dps) AS d FROM fundamentals GROUP BY symbol) f USING (symbol)
       WHERE r.is_active AND r.sector IS NOT NULL AND (coalesce(n, 0) = 0 OR (a IS NULL AND b IS NULL AND c IS NULL))""",
)
def _(m):
    f = m.fundamentals
    for c in ("reserve_surplus_mn", "short_term_loan_mn", "long_term_loan_mn"):
        f = f.withColumn(c, F.when(F.col("key") % 5 != 2, F.col(c)))
    return audits.statement_gaps(m.roster, f)


#: The stored index holds the days on which the market did not fall; the others are the gaps to find.
_HAVE = "SELECT date FROM market_index WHERE advancing >= declining"


@query("k18_index_date_gaps", "bars market_index", f"SELECT DISTINCT date FROM bars WHERE date >= DATE '1997-01-01' AND date NOT IN ({_HAVE})")
def _(m):
    return audits.index_date_gaps(m.bars, m.index.filter("advancing >= declining"), since="1997-01-01")


@query("k18_metadata_gaps", "roster", "SELECT symbol, category IS NULL AS missing_category, NOT coalesce(face_value > 0, false) AS invalid_face_value FROM roster WHERE is_active AND sector IS NOT NULL AND (category IS NULL OR NOT coalesce(face_value > 0, false))")
def _(m):
    return audits.metadata_gaps(m.roster)


@query("f10_having_gaps", "bars", "SELECT symbol, count(*) AS sessions, max(date) AS last_date FROM bars GROUP BY symbol HAVING count(*) < 530 OR max(date) < DATE '2001-10-25'")
def _(m):
    g = market.symbol_history_stats(m.bars).select("symbol", "sessions", "last_date")
    return g.filter((F.col("sessions") < 530) | (F.col("last_date") < F.lit("2001-10-25").cast("date")))


@query("k19_filed_statement_audit", "fundamentals", finding_sql("filed_statements", _SD, "symbol || '|' || fiscal_year", {k: _K2_E[k] for k in ("gross_above_revenue", "cash_flow_mismatch")}))
def _(m):
    return audits.findings(audits.audit_filed_statements(one_row_per_day(_statements_dirty(m), "seq", ("symbol", "fiscal_year"))), "filed_statements", _key("symbol", "fiscal_year"))


def _sum_checks(c: dict[str, str]) -> str:
    return " + ".join(f"count(*) FILTER ({x})" for x in c.values())


def _summary_sql(entity: str, source: str, records: str, e: dict[str, str], w: dict[str, str]) -> str:
    warn = _sum_checks(w) if w else "0"
    return f"""SELECT '{entity}' AS entity, CAST({records} AS BIGINT) AS records, CAST({_sum_checks(e)} AS BIGINT) AS errors, CAST({warn} AS BIGINT) AS warnings,
      CASE WHEN {_sum_checks(e)} = 0 THEN 'CERTIFIED_PASSED' ELSE 'AUDIT_FAILED' END AS status FROM {source}"""


@query(
    "k20_staging_audit", "prices_dirty fundamentals shareholding market_index",
    " UNION ALL ".join([
        _summary_sql("prices", _K1, "sum(records)", _K1_E, _K1_W), _summary_sql("fundamentals", _SD, "sum(records)", _K2_E, _K2_W),
        _summary_sql("shareholding", "shareholding", "count(*)", _K7, {}), _summary_sql("index", _ID, "count(*)", {"a": _OUT}, {"b": "index_value IS NULL"})]),
)
def staging_audit(m):
    return audits.staging_audit(m.prices_dirty, _statements_dirty(m), m.shareholding, _index_dirty(m), "seq")


@query(
    "k21_result_consistency", "statements prices",
    """WITH p AS (SELECT symbol, CASE WHEN eps_basic <> 0 THEN dps / eps_basic * 100.0::DOUBLE END AS detail FROM statements),
         l AS (SELECT symbol, arg_max(close, date) AS c FROM prices GROUP BY symbol), s AS (SELECT symbol, sum(dps ORDER BY fiscal_year) AS s, count(DISTINCT fiscal_year) AS n, max(key) AS k FROM statements GROUP BY symbol)
       SELECT symbol, 'payout_implausible' AS "check", detail FROM p WHERE detail < -50 OR detail > 1000
       UNION ALL SELECT symbol, 'price_differs', (c + 0.5::DOUBLE) - c FROM l JOIN s USING (symbol) WHERE k % 9 = 1
       UNION ALL SELECT symbol, 'dividend_sum_differs', round(s, 6) FROM s WHERE k % 8 = 1 AND s IS NOT NULL""",
)
def _(m):
    from bourselake.operators.lookups import latest_price

    k9 = m.roster.select("symbol", "key")
    screen = latest_price(m.prices).join(k9, "symbol").select("symbol", F.when(F.col("key") % 9 == 1, F.col("close") + 0.5).otherwise(F.col("close")).alias("ltp"))
    sums = m.statements.groupBy("symbol", "key").agg(F.sum("dps").alias("s"))
    div = sums.select("symbol", F.when(F.col("key") % 8 == 1, F.col("s") + 1.0).otherwise(F.col("s")).alias("total_per_share"))
    out = audits.result_consistency(screen, m.prices, div, m.statements)
    return out.withColumn("detail", F.when(F.col("check") == "dividend_sum_differs", F.round("detail", 6)).otherwise(F.col("detail")))


@query("k21_not_a_number", "prices", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (isnan({c}) OR isinf({c})) AS bad FROM prices" for c in ("open", "high", "low", "close", "ycp", "change", "change_percent", "value_mn", "pe", "market_cap_mn")))
def _(m):
    return audits.not_a_number_counts(m.prices)


@query(
    "k22_sample_verification", "roster bars",
    """SELECT s.symbol, s.sector, coalesce(n, 0) AS total_sessions, first_date, last_date, last_close, coalesce(n > 0 AND last_close > 0, false) AS satisfactory
       FROM (SELECT * FROM roster WHERE is_active AND sector IS NOT NULL ORDER BY sector, symbol LIMIT 50) s
       LEFT JOIN (SELECT symbol, count(*) AS n, min(date) AS first_date, max(date) AS last_date, arg_max(close, date) AS last_close FROM bars GROUP BY symbol) g USING (symbol)""",
)
def _(m):
    return audits.sample_verification(market.stratified_sample(m.roster, 50), m.bars)


_CELLS = ("open", "high", "low", "close", "volume", "value_mn")


@query(
    "k23_promotion_compare", "prices_existing prices_incoming",
    "WITH j AS (SELECT s.symbol, s.date, " + ", ".join(f"CAST(s.{c} AS DOUBLE) AS s_{c}, CAST(t.{c} AS DOUBLE) AS m_{c}" for c in _CELLS)
    + " FROM prices_existing s LEFT JOIN (SELECT * FROM prices_incoming QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY seq DESC) = 1) t USING (symbol, date)) "
    + " UNION ALL ".join(f"SELECT symbol, date, '{c}' AS field, s_{c} AS staged, m_{c} AS main, '{'error' if c == 'close' else 'warning'}' AS severity FROM j WHERE s_{c} IS DISTINCT FROM m_{c}" for c in _CELLS),
)
def _(m):
    return audits.promotion_compare(m.prices_existing, one_row_per_day(m.prices_incoming, "seq"), ["symbol", "date"], list(_CELLS))


@query("k24_rating_audit", "ratings", finding_sql("ratings", "ratings", "symbol || '|' || CAST(rating_date AS VARCHAR)", {"expires_before_rating": "valid_until < rating_date", "missing_date": "rating_date IS NULL"}))
def _(m):
    return audits.findings(audits.audit_ratings(m.ratings), "ratings", _key("symbol", "rating_date"))


@query("k24_lockin_audit", "lockins", finding_sql("lockins", "lockins", "symbol || '|' || CAST(release_date AS VARCHAR)", {"bad_quantity": "NOT coalesce(quantity > 0, false)", "bad_release_date": "release_date IS NULL"}))
def _(m):
    return audits.findings(audits.audit_lockins(m.lockins), "lockins", _key("symbol", "release_date"))


# -- reconciliation ---------------------------------------------------------------------------------------------------

_PAIR = """(SELECT symbol, date, a.close AS db_close, a.source AS db_source, a.here AS in_db, b.close AS other_close, b.here AS in_other
   FROM (SELECT *, true AS here FROM prices_existing) a FULL JOIN (SELECT * REPLACE (CASE WHEN day(date) = 19 THEN NULL ELSE close END AS close), true AS here FROM prices_incoming QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY seq DESC) = 1) b USING (symbol, date) {w})"""
_ALL = _PAIR.format(w="")
_LAST = _PAIR.format(w="WHERE date >= (SELECT d FROM asof_day) - 365")


def _pair(m, as_of=None):
    other = one_row_per_day(m.prices_incoming, "seq").withColumn("close", F.when(F.dayofmonth("date") != 19, F.col("close")))
    a, b = m.prices_existing, other
    if as_of is not None:
        a, b = reconcile.windowed(a, as_of=as_of, days=365), reconcile.windowed(b, as_of=as_of, days=365)
    return reconcile.paired_prices(a, b)


def _check_sql(src: str) -> str:
    return f"""SELECT *, CASE WHEN compared > 0 THEN {fx("(CAST(mismatches AS DOUBLE) / CAST(compared AS DOUBLE) * 100.0::DOUBLE)", 3)} ELSE 0.0 END AS mismatch_rate FROM (
      SELECT count(*) FILTER (db_close IS NOT NULL AND other_close IS NOT NULL) AS compared, count(*) FILTER (abs(db_close - other_close) > 0.05) AS mismatches, count(*) FILTER (in_db IS NULL) AS missing_in_db,
        count(*) FILTER (in_other IS NULL) AS missing_in_other, count(*) FILTER (in_db AND in_other AND (db_close IS NULL OR other_close IS NULL)) AS incomparable FROM {src})"""


@query("l1_price_check_tier1_summary", "prices_existing prices_incoming asof_day", _check_sql(_LAST))
def _(m):
    return reconcile.price_check_summary(_pair(m, m.as_of))


@query("l2_price_check_summary", "prices_existing prices_incoming", _check_sql(_ALL))
def price_check_summary(m):
    return reconcile.price_check_summary(_pair(m))


@query(
    "l2_price_mismatches", "prices_existing prices_incoming",
    f"""SELECT symbol, date, db_close, other_close, {fx("d", 4)} AS diff, {fx("(d / other_close * 100.0::DOUBLE)", 3)} AS diff_pct, db_source FROM (SELECT *, abs(db_close - other_close) AS d FROM {_ALL}) WHERE d > 0.05""",
)
def price_mismatches(m):
    return reconcile.price_mismatches(_pair(m))


@query("l2_incomparable_rows", "prices_existing prices_incoming", f"SELECT symbol, date, db_close, other_close FROM {_ALL} WHERE in_db AND in_other AND (db_close IS NULL OR other_close IS NULL)")
def _(m):
    return reconcile.incomparable_rows(_pair(m))


@query(
    "f9_mismatch_by_source", "prices_existing prices_incoming",
    f"""SELECT db_source, compared, mismatches, {fx("(CAST(mismatches AS DOUBLE) / CAST(compared AS DOUBLE) * 100.0::DOUBLE)", 3)} AS rate_pct FROM (
          SELECT db_source, count(*) AS compared, count(*) FILTER (abs(db_close - other_close) > 0.05) AS mismatches FROM {_ALL} WHERE db_close IS NOT NULL AND other_close IS NOT NULL GROUP BY db_source)""",
)
def _(m):
    return reconcile.mismatch_by_source(_pair(m))


@query(
    "f17_yearly_sample", "prices_existing prices_incoming",
    f"""SELECT year, symbol, date, db_close, other_close, abs(db_close - other_close) <= 0.05 AS match FROM (
          SELECT *, row_number() OVER (PARTITION BY year(date) ORDER BY symbol, date) AS rn, CAST(year(date) AS INTEGER) AS year FROM {_ALL} WHERE db_close IS NOT NULL AND other_close IS NOT NULL) WHERE rn <= 20""",
)
def _(m):
    return reconcile.yearly_sample(_pair(m), 20)


_L3F = ("eps_basic", "nav_per_share", "dps", "bonus_pct", "reserve_surplus_mn", "oci_mn", "short_term_loan_mn", "long_term_loan_mn", "net_income_mn")


@query(
    "l3_statement_field_diff", "fundamentals fundamentals_incoming",
    "WITH j AS (SELECT a.symbol, a.fiscal_year, " + ", ".join(f"a.{c} AS a_{c}, b.{c} AS b_{c}" for c in _L3F) + " FROM fundamentals a JOIN fundamentals_incoming b USING (symbol, fiscal_year)) "
    + " UNION ALL ".join(f"SELECT symbol, fiscal_year, '{c}' AS field, a_{c} AS db_value, b_{c} AS other_value FROM j WHERE (a_{c} IS NULL) <> (b_{c} IS NULL) OR abs(a_{c} - b_{c}) > 0.011" for c in _L3F),
)
def _(m):
    return reconcile.statement_field_diff(m.fundamentals, m.fundamentals_incoming, _L3F)


@query(
    "l3_statement_coverage", "fundamentals fundamentals_incoming",
    "SELECT count(*) FILTER (a AND b) AS years_compared, count(*) FILTER (a IS NULL) AS missing_in_db, count(*) FILTER (b IS NULL) AS missing_in_other FROM (SELECT symbol, fiscal_year, true AS a FROM fundamentals) FULL JOIN (SELECT symbol, fiscal_year, true AS b FROM fundamentals_incoming) USING (symbol, fiscal_year)",
)
def _(m):
    return reconcile.statement_coverage(m.fundamentals, m.fundamentals_incoming)


_LIVE = "(SELECT date, CASE WHEN day(date) = 12 THEN index_value + 1.0::DOUBLE ELSE index_value END AS live_value FROM market_index WHERE date >= DATE '1997-03-01' AND advancing >= declining)"


@query(
    "l4_index_check", "market_index",
    f"""SELECT i.date, i.index_value, i.source, l.live_value, CASE WHEN abs(l.live_value - i.index_value) > 0.05 THEN 'mismatch' WHEN l.live_value IS NOT NULL THEN 'match'
          WHEN i.date < (SELECT min(date) FROM {_LIVE}) THEN 'unreachable' ELSE 'not_in_live' END AS status
        FROM market_index i LEFT JOIN {_LIVE} l USING (date) WHERE i.source LIKE 'DSE_OFFICIAL_%'""",
)
def _(m):
    live = m.index.filter("date >= date'1997-03-01' and advancing >= declining")
    live = live.select("date", F.when(F.dayofmonth("date") == 12, F.col("index_value") + 1.0).otherwise(F.col("index_value")).alias("index_value"))
    return reconcile.index_check(m.index, live)


@query(
    "l5_roster_check", "bars roster asof_day",
    """WITH live AS (SELECT DISTINCT symbol FROM bars WHERE date >= (SELECT d FROM asof_day) - 30), act AS (SELECT symbol FROM roster WHERE is_active)
       SELECT symbol, 'not_traded' AS side FROM act WHERE symbol NOT IN (SELECT symbol FROM live) UNION ALL SELECT symbol, 'missing_from_roster' FROM live WHERE symbol NOT IN (SELECT symbol FROM act)""",
)
def _(m):
    from bourselake.operators.sets import symbol_difference

    live = m.bars.filter(F.col("date") >= F.date_sub(F.lit(m.as_of), 30))
    return symbol_difference(live, m.roster.filter("is_active"))
