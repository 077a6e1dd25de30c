"""Upserts, quarantine, promotion and live overlay (family J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from bourselake.operators import audits, merge, sets
from bourselake.operators.lookups import one_row_per_day
from bourselake.plans.catalog import query
from bourselake.plans.oracle import allows, fx, tier


def merge_sql(existing: str, incoming: str, keys: list[str], policy: dict[str, str], *, tiered: bool = False, guard: str = "true", plain: bool = False) -> str:
    """Reference result of an upsert; ``incoming`` carries ``seq``. With ``plain`` keys are never null and compare by equality."""
    k = ", ".join(keys)
    on = lambda a, b: " AND ".join(f"{a}.{x} {'=' if plain else 'IS NOT DISTINCT FROM'} {b}.{x}" for x in keys)
    pick = ", ".join(f"arg_max({c}, seq) AS {c}" if p == "coalesce" else f"last({c} ORDER BY seq) AS {c}" for c, p in policy.items())
    ok = f"WHERE {allows('e.source', 'i.source')}" if tiered else ""
    out = []
    for c, p in policy.items():
        if p == "insert_only":
            out.append(f"CASE WHEN e.here IS NULL THEN n.{c} ELSE e.{c} END AS {c}")
        else:
            new = f"coalesce(n.{c}, e.{c})" if p == "coalesce" else f"n.{c}"
            out.append(f"CASE WHEN n.here AND (e.here IS NULL OR {guard}) THEN {new} ELSE e.{c} END AS {c}")
    names = ", ".join(f"CASE WHEN e.here THEN e.{x} ELSE n.{x} END AS {x}" for x in keys)
    return f"""SELECT {names}, {", ".join(out)} FROM (SELECT *, true AS here FROM {existing}) e
      FULL JOIN (SELECT {k}, true AS here, {pick} FROM (SELECT i.* FROM ({incoming}) i LEFT JOIN {existing} e ON {on("e", "i")} {ok}) GROUP BY {k}) n ON {on("e", "n")}"""


def _cols(df, keys, policy):
    return df.select(*keys, *policy)


_J1 = {"close": "replace", "source": "replace", "high": "coalesce", "low": "coalesce", "volume": "coalesce", "value_mn": "coalesce", "trades": "coalesce"}
_K = ["symbol", "date"]


@query("j1_upsert_prices", "prices_existing prices_incoming", merge_sql("prices_existing", "SELECT * FROM prices_incoming WHERE close > 0", _K, _J1, tiered=True))
def upsert_prices(m):
    return _cols(merge.upsert_prices(m.prices_existing, m.prices_incoming, seq="seq").rows, _K, _J1)


@query(
    "j1_upsert_stats", "prices_existing prices_incoming",
    f"""SELECT count(*) FILTER (ok) AS upserted, count(*) FILTER (NOT ok) AS blocked, count(*) FILTER (NOT ok AND i.close IS DISTINCT FROM e.close) AS quarantined
        FROM (SELECT i.close, e.close AS c2, {allows("e.source", "i.source")} AS ok, e.close AS ec FROM prices_incoming i LEFT JOIN prices_existing e USING (symbol, date)) i, (SELECT NULL) x,
        LATERAL (SELECT i.ec AS close) e""",
)
def _(m):
    return merge.upsert_prices(m.prices_existing, m.prices_incoming, seq="seq").stats


_J2 = {c: "replace" for c in ("close", "ycp", "change", "change_percent", "volume", "pe")} | {c: "coalesce" for c in ("high", "low", "value_mn", "source")}
def _daily_batch(m):
    b = m.prices_incoming.withColumn("ycp", F.when(F.col("seq") == 1, F.col("close") - 1.25))
    b = b.withColumn("change", F.when(F.col("key") % 2 == 0, F.lit(0.5))).withColumn("change_percent", F.lit(None).cast("double"))
    return b.withColumn("pe", F.col("close") / 100.0)


@query("j2_upsert_daily_close", "stored_prices daily_batch", merge_sql("stored_prices", "SELECT * FROM daily_batch", _K, _J2, tiered=True, plain=True))
def upsert_daily_close(m):
    return m.by_symbol(lambda part: _cols(merge.upsert_daily_close(part(m.prices), part(_daily_batch(m)), seq="seq").rows, _K, _J2))


_J3 = {c: "replace" for c in ("open", "high", "low", "close", "ycp", "change", "change_percent", "volume", "value_mn", "pe")} | {"source": "coalesce"}
@query("j3_upsert_symbol_history", "stored_prices history_batch", merge_sql("stored_prices", "SELECT * FROM history_batch", _K, _J3, tiered=True, plain=True))
def _(m):
    return _cols(merge.upsert_symbol_history(m.prices, _daily_batch(m), seq="seq").rows, _K, _J3)


_IDX_BATCH = """SELECT * REPLACE (index_value + 1.0::DOUBLE AS index_value, CASE WHEN day(date) % 3 = 0 THEN NULL ELSE advancing + 1 END AS advancing, total_trades + 5 AS total_trades,
   CASE WHEN day(date) % 2 = 0 THEN 'LANKABD' ELSE 'DSE_OFFICIAL_GRAPH' END AS source), 0 AS seq FROM market_index WHERE date >= DATE '1993-01-01'"""


def _index_existing(m):
    return m.index.filter("date < date'1993-01-01' or source <> 'LANKABD'")


def _index_batch(m):
    b = m.index.filter("date >= date'1993-01-01'")
    day = F.dayofmonth("date")
    return (
        b.withColumn("index_value", F.col("index_value") + 1.0)
        .withColumn("advancing", F.when(day % 3 != 0, F.col("advancing") + 1))
        .withColumn("total_trades", F.col("total_trades") + 5)
        .withColumn("source", F.when(day % 2 == 0, "LANKABD").otherwise("DSE_OFFICIAL_GRAPH"))
    )


_J4 = {"index_value": "replace", "source": "replace", "total_trades": "insert_only"} | {c: "coalesce" for c in ("advancing", "declining", "unchanged", "total_volume", "total_value_mn")}
_J4C = {c: "replace" for c in ("index_value", "advancing", "declining", "unchanged", "total_trades", "total_volume", "total_value_mn")} | {"source": "coalesce"}
#: What is stored and what arrives overlap, and together they hold every day.
_IDX_OLD = "(SELECT * FROM market_index WHERE date < DATE '1993-01-01' OR source <> 'LANKABD')"


@query("j4_upsert_index", "market_index", merge_sql(_IDX_OLD, _IDX_BATCH, ["date"], _J4, tiered=True))
def _(m):
    return _cols(merge.upsert_index(_index_existing(m), _index_batch(m)).rows, ["date"], _J4)


@query("j4_upsert_index_close", "market_index", merge_sql(_IDX_OLD, _IDX_BATCH, ["date"], _J4C, tiered=True))
def _(m):
    return _cols(merge.upsert_index_close(_index_existing(m), _index_batch(m)).rows, ["date"], _J4C)


_J4D = {"ds30_index": "replace", "prev_close": "coalesce", "source": "coalesce"}


@query(
    "j4_upsert_ds30", "ds30",
    merge_sql("ds30", "SELECT * REPLACE (ds30_index + 2.0::DOUBLE AS ds30_index, CASE WHEN day(date) % 2 = 0 THEN NULL ELSE prev_close END AS prev_close, 'LANKABD' AS source), 0 AS seq FROM ds30", ["date"], _J4D, tiered=True),
)
def _(m):
    b = m.ds30.withColumn("ds30_index", F.col("ds30_index") + 2.0).withColumn("source", F.lit("LANKABD"))
    b = b.withColumn("prev_close", F.when(F.dayofmonth("date") % 2 != 0, F.col("prev_close")))
    return _cols(merge.upsert_ds30(m.ds30, b).rows, ["date"], _J4D)


_J5 = {c: "coalesce" for c in ("trades", "quantity", "value_mn", "min_price", "max_price")} | {"source": "replace"}


@query(
    "j5_upsert_block_trades", "block_trades",
    merge_sql("(SELECT * REPLACE (CASE WHEN key % 3 = 0 THEN 'DSE_SCRAPE' ELSE source END AS source) FROM block_trades)", "SELECT * REPLACE (quantity + 1 AS quantity, CASE WHEN day(date) % 2 = 0 THEN NULL ELSE trades END AS trades), 0 AS seq FROM block_trades", _K, _J5, tiered=True),
)
def _(m):
    old = m.block_trades.withColumn("source", F.when(F.col("key") % 3 == 0, "DSE_SCRAPE").otherwise(F.col("source")))
    new = m.block_trades.withColumn("quantity", F.col("quantity") + 1)
    new = new.withColumn("trades", F.when(F.dayofmonth("date") % 2 != 0, F.col("trades")))
    return _cols(merge.upsert_block_trades(old, new).rows, _K, _J5)


_J6R = {c: "replace" for c in ("long_term_rating", "short_term_rating", "outlook", "valid_until", "rating_action", "source")}
_J6R_NEW = """SELECT symbol, rating_date, coalesce(rating_agency, 'CRISL') AS rating_agency, long_term_rating, short_term_rating, coalesce(outlook, 'Stable') AS outlook,
  valid_until + 10 AS valid_until, coalesce(rating_action, 'Surveillance') AS rating_action, source, 0 AS seq FROM ratings"""


@query("j6_upsert_ratings", "ratings", merge_sql("(SELECT * FROM ratings WHERE key % 4 <> 1)", _J6R_NEW, ["symbol", "rating_date", "rating_agency"], _J6R))
def _(m):
    new = m.ratings.withColumn("valid_until", F.date_add("valid_until", 10))
    keys = ["symbol", "rating_date", "rating_agency"]
    return _cols(merge.upsert_ratings(m.ratings.filter(F.col("key") % 4 != 1), new), keys, _J6R)


_J6L_NEW = "SELECT symbol, coalesce(lockin_category, 'Sponsor/Director') AS lockin_category, release_date, quantity + 7 AS quantity, source, 0 AS seq FROM lockins"


@query("j6_upsert_lockins", "lockins", merge_sql("(SELECT * FROM lockins WHERE key % 4 <> 1)", _J6L_NEW, ["symbol", "lockin_category", "release_date"], {"quantity": "replace", "source": "replace"}))
def _(m):
    new = m.lockins.withColumn("quantity", F.col("quantity") + 7)
    out = merge.upsert_lockins(m.lockins.filter(F.col("key") % 4 != 1), new)
    return out.select("symbol", "lockin_category", "release_date", "quantity", "source")


_J6S = {c: "replace" for c in ("sponsor_pct", "govt_pct", "institute_pct", "foreign_pct", "public_pct", "as_of_date", "prev_sponsor_pct", "prev_as_of_date")}


@query(
    "j6_upsert_shareholding", "shareholding",
    merge_sql("(SELECT * FROM shareholding WHERE prev_as_of_date IS NOT NULL)", "SELECT * REPLACE (as_of_date + 31 AS as_of_date, NULL::DOUBLE AS prev_sponsor_pct), 0 AS seq FROM shareholding WHERE prev_as_of_date IS NULL OR public_pct < 50", ["symbol"], _J6S),
)
def _(m):
    new = m.shareholding.filter("prev_as_of_date is null or public_pct < 50").withColumn("as_of_date", F.date_add("as_of_date", 31)).withColumn("prev_sponsor_pct", F.lit(None).cast("double"))
    return _cols(merge.upsert_shareholding(m.shareholding.filter("prev_as_of_date is not null"), new), ["symbol"], _J6S)


_J6C = {c: "replace" for c in ("record_date", "agm_date", "bonus_pct", "source")}
_J6C_KEYS = ["symbol", "event_type", "event_date", "fiscal_year", "cash_dps"]
_J6C_NEW = """SELECT * REPLACE (record_date + 1 AS record_date, CASE WHEN key % 5 = 1 THEN NULL ELSE cash_dps END AS cash_dps), 0 AS seq FROM corporate_actions"""


@query("j6_upsert_corporate_actions", "corporate_actions", merge_sql("(SELECT * FROM corporate_actions WHERE key % 4 <> 1)", _J6C_NEW, _J6C_KEYS, _J6C))
def _(m):
    new = m.corporate_actions.withColumn("record_date", F.date_add("record_date", 1)).withColumn("cash_dps", F.when(F.col("key") % 5 != 1, F.col("cash_dps")))
    return _cols(merge.upsert_corporate_actions(m.corporate_actions.filter(F.col("key") % 4 != 1), new), _J6C_KEYS, _J6C)


_F = ["symbol", "fiscal_year"]
_J7 = {c: "replace" for c in ("period", "eps_basic", "nav_per_share", "dps", "debt_to_equity", "current_ratio", "paid_up_capital_mn", "audit_status", "source")}
_J7 |= {c: "coalesce" for c in ("eps_diluted", "authorized_capital_mn", "net_income_mn", "reserve_surplus_mn", "oci_mn", "short_term_loan_mn", "long_term_loan_mn", "bonus_pct")}
_OPEN = "NOT (coalesce(e.audit_status = 'Audited', false) AND e.source IS DISTINCT FROM 'STAGING_DB' AND {})"
_J7_GUARD = _OPEN.format(" AND ".join(f"e.{c} IS NOT NULL" for c in ("net_income_mn", "reserve_surplus_mn", "short_term_loan_mn", "long_term_loan_mn")))


@query("j7_upsert_fundamentals_audited", "fundamentals fundamentals_incoming", merge_sql("fundamentals", "SELECT * REPLACE ('Audited' AS audit_status), 0 AS seq FROM fundamentals_incoming", _F, _J7, guard=_J7_GUARD))
def _(m):
    return _cols(merge.upsert_fundamentals_audited(m.fundamentals, m.fundamentals_incoming), _F, _J7)


_J7S = {c: "replace" for c in ("period", "eps_basic", "nav_per_share", "dps", "debt_to_equity", "current_ratio", "paid_up_capital_mn", "audit_status", "source")}


@query("j7_upsert_statements_strict", "fundamentals fundamentals_incoming", merge_sql("fundamentals", "SELECT *, 0 AS seq FROM fundamentals_incoming", _F, _J7S, guard="e.audit_status IS DISTINCT FROM 'Audited'"))
def _(m):
    return _cols(merge.upsert_statements_strict(m.fundamentals, m.fundamentals_incoming), _F, _J7S)


_J7L = {c: "coalesce" for c in ("eps_basic", "oci_mn", "long_term_loan_mn", "revenue_mn", "free_cash_flow_mn")} | {"audit_status": "replace", "source": "replace"}
_J7L_GUARD = _OPEN.format("e.revenue_mn IS NOT NULL AND e.total_assets_mn IS NOT NULL AND e.total_liabilities_mn IS NOT NULL")


@query("j7_upsert_statement_lines", "fundamentals fundamentals_incoming", merge_sql("fundamentals", "SELECT * REPLACE ('Audited' AS audit_status, 'PDF_AUDITED_ANNUAL_REPORT' AS source), 0 AS seq FROM fundamentals_incoming", _F, _J7L, guard=_J7L_GUARD))
def _(m):
    return _cols(merge.upsert_statement_lines(m.fundamentals, m.fundamentals_incoming), _F, _J7L)


@query(
    "j7_roster_balance_sheet", "roster fundamentals",
    """SELECT r.symbol, r.name, arg_max(f.reserve_surplus_mn, f.fiscal_year) AS reserve_surplus_mn, arg_max(f.oci_mn, f.fiscal_year) AS oci_mn,
         arg_max(f.short_term_loan_mn, f.fiscal_year) AS short_term_loan_mn, arg_max(f.long_term_loan_mn, f.fiscal_year) AS long_term_loan_mn
       FROM roster r LEFT JOIN fundamentals f USING (symbol) GROUP BY r.symbol, r.name""",
)
def _(m):
    return merge.roster_balance_sheet(m.roster.select("symbol", "name"), m.fundamentals)


_DELTA = " OR ".join(f"i.{c} IS DISTINCT FROM e.{c}" for c in merge.DELTA_FIELDS)
_J8_CHANGED = f"""SELECT i.* FROM fundamentals_incoming i LEFT JOIN fundamentals e USING (symbol, fiscal_year)
   WHERE e.symbol IS NULL OR (e.audit_status IS DISTINCT FROM 'Audited' AND ({_DELTA}))"""
_J8 = {c: "replace" for c in ("period", "eps_basic", "eps_diluted", "nav_per_share", "debt_to_equity", "current_ratio", "source")}
_J8 |= {c: "coalesce" for c in ("paid_up_capital_mn", "dps", "net_income_mn", "reserve_surplus_mn", "oci_mn", "short_term_loan_mn", "long_term_loan_mn")} | {"audit_status": "insert_only"}


@query("j8_fundamentals_delta", "fundamentals fundamentals_incoming", merge_sql("fundamentals", f"SELECT * REPLACE ('Provisional' AS audit_status), 0 AS seq FROM ({_J8_CHANGED})", _F, _J8, guard=_J7_GUARD))
def fundamentals_delta(m):
    return _cols(merge.fundamentals_delta(m.fundamentals, m.fundamentals_incoming).rows, _F, _J8)


@query(
    "j8_delta_counts", "fundamentals fundamentals_incoming",
    f"SELECT (SELECT count(*) FROM fundamentals_incoming) AS total, count(*) AS changed, (SELECT count(*) FROM fundamentals_incoming) - count(*) AS unchanged FROM ({_J8_CHANGED})",
)
def _(m):
    return merge.fundamentals_delta(m.fundamentals, m.fundamentals_incoming).stats


@query("j8_delta_no_change", "fundamentals", "SELECT count(*) AS total, CAST(0 AS BIGINT) AS changed, count(*) AS unchanged FROM fundamentals")
def fundamentals_delta_no_change(m):
    return merge.fundamentals_delta(m.fundamentals, m.fundamentals).stats


@query(
    "j9_upsert_roster", "roster roster_incoming asof_day",
    """SELECT symbol, coalesce(n.name, o.name) AS name, coalesce(n.sector, o.sector) AS sector, coalesce(n.category, o.category) AS category,
         coalesce(n.face_value, o.face_value) AS face_value, coalesce(n.total_shares, o.total_shares) AS total_shares,
         CASE WHEN n.here THEN true WHEN o.trading_status = 'Active' THEN false ELSE o.is_active END AS is_active,
         CASE WHEN n.here THEN 'Active' WHEN o.trading_status = 'Active' THEN 'Delisted' ELSE o.trading_status END AS trading_status,
         CASE WHEN n.here AND o.here AND n.category <> o.category THEN o.category END AS prev_category,
         CASE WHEN n.here AND o.here AND n.category <> o.category THEN (SELECT d FROM asof_day) END AS category_changed_at,
         o.here IS NULL AS is_new_listing, CASE WHEN o.here IS NULL THEN (SELECT d FROM asof_day) END AS first_seen,
         CASE WHEN o.here AND n.here IS NULL AND o.trading_status = 'Active' THEN (SELECT d FROM asof_day) END AS delisted_date
       FROM (SELECT *, true AS here FROM roster) o FULL JOIN (SELECT *, true AS here FROM roster_incoming) n USING (symbol)""",
)
def _(m):
    lifecycle = ("is_active", "trading_status", "prev_category", "category_changed_at", "is_new_listing", "first_seen", "delisted_date")
    return merge.upsert_roster(m.roster, m.roster_incoming, as_of=m.as_of).select("symbol", *merge.ROSTER_DETAILS, *lifecycle)


@query(
    "j10_prune_orphans", "fundamentals",
    "SELECT symbol, fiscal_year, source, eps_basic FROM fundamentals WHERE source <> 'STAGING_DB' OR fiscal_year <> 1997",
)
def _(m):
    out = merge.prune_orphans(m.fundamentals, m.fundamentals.filter(F.col("fiscal_year") != 1997), ["symbol", "fiscal_year"])
    return out.select("symbol", "fiscal_year", "source", "eps_basic")


_QUAR = f"""SELECT 'price_history' AS target_table, i.symbol, i.date, 'close' AS field_name, e.close AS existing_value, i.close AS incoming_value,
  e.source AS existing_source, i.source AS incoming_source, 'PENDING_USER_APPROVAL' AS status
  FROM prices_incoming i JOIN prices_existing e USING (symbol, date) WHERE NOT {allows("e.source", "i.source")} AND i.close IS DISTINCT FROM e.close"""


@query("j11_quarantine_conflicts", "prices_existing prices_incoming", _QUAR)
def _(m):
    return merge.upsert_prices(m.prices_existing, m.prices_incoming, seq="seq").quarantine


def _conflicts(m):
    q = merge.quarantine_conflicts(m.prices_existing, one_row_per_day(m.prices_incoming, "seq"), ["symbol", "date"], "close", "price_history")
    return q.withColumn("id", F.concat_ws("|", "symbol", F.col("date").cast("string")))


def _decisions(conflicts):
    d = F.dayofmonth("date") % 3
    res = F.when(d == 0, "ACCEPT_INCOMING").when(d == 1, "KEEP_EXISTING")
    return conflicts.select("id", res.alias("resolution"), F.lit("reviewed").alias("note")).filter(F.col("resolution").isNotNull())


_RES = f"""WITH q AS (SELECT * FROM ({_QUAR.replace("FROM prices_incoming i", "FROM (SELECT * FROM prices_incoming QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY seq DESC) = 1) i")}))"""


@query(
    "j12_resolve_quarantine", "prices_existing prices_incoming",
    f"""{_RES} SELECT e.symbol, e.date, coalesce(q.incoming_value, e.close) AS close, coalesce(q.incoming_source, e.source) AS source
        FROM prices_existing e LEFT JOIN (SELECT * FROM q WHERE day(date) % 3 = 0) q USING (symbol, date)""",
)
def _(m):
    c = _conflicts(m)
    return merge.resolve_quarantine(m.prices_existing, c, _decisions(c)).rows.select("symbol", "date", "close", "source")


@query(
    "j12_quarantine_log", "prices_existing prices_incoming",
    f"""{_RES} SELECT symbol, date, existing_value, incoming_value, CASE day(date) % 3 WHEN 0 THEN 'APPROVED_BY_USER' WHEN 1 THEN 'REJECTED_BY_USER' ELSE status END AS status,
        CASE WHEN day(date) % 3 < 2 THEN 'reviewed' END AS notes FROM q""",
)
def _(m):
    c = _conflicts(m)
    return merge.resolve_quarantine(m.prices_existing, c, _decisions(c)).quarantine.select("symbol", "date", "existing_value", "incoming_value", "status", "notes")


@query("d8_quarantine_pending", "prices_existing prices_incoming", f"SELECT symbol, date, field_name, existing_value, incoming_value, status FROM ({_QUAR})")
def _(m):
    from bourselake.operators.access import quarantine_pending

    q = merge.upsert_prices(m.prices_existing, m.prices_incoming, seq="seq").quarantine
    return quarantine_pending(q, "date").select("symbol", "date", "field_name", "existing_value", "incoming_value", "status")


_J13_OLD = "(SELECT date, index_value, CASE WHEN day(date) % 5 = 2 THEN 'MCAP_WEIGHTED_ESTIMATE' ELSE source END AS source FROM market_index WHERE date < DATE '1998-01-01')"
_J13_LIVE = "(SELECT date, CASE WHEN day(date) % 4 = 1 THEN index_value + 0.5::DOUBLE ELSE index_value END AS index_value FROM market_index WHERE date >= DATE '1994-01-01')"


def _j13(stored, official):
    old = stored.select(
        "date", "index_value", F.when(F.dayofmonth("date") % 5 == 2, "MCAP_WEIGHTED_ESTIMATE").otherwise(F.col("source")).alias("source")
    )
    off = F.when(F.dayofmonth("date") % 4 == 1, F.col("index_value") + 0.5).otherwise(F.col("index_value"))
    return merge.upgrade_by_tier(old, official.select("date", off.alias("index_value")))


@query(
    "j13_upgrade_by_tier", "market_index",
    f"""WITH j AS (SELECT date, o.index_value AS stored, l.index_value AS live, o.source, l.index_value IS NOT NULL AND (o.index_value IS NULL OR o.source = 'MCAP_WEIGHTED_ESTIMATE') AS take
          FROM {_J13_OLD} o FULL JOIN {_J13_LIVE} l USING (date)),
        g AS (SELECT count(*) FILTER (take AND (live < 500 OR live > 20000)) AS bad FROM j)
        SELECT date, CASE WHEN bad = 0 AND take THEN live ELSE stored END AS index_value, CASE WHEN bad = 0 AND take THEN 'DSE_OFFICIAL_GRAPH' ELSE source END AS source
        FROM j, g WHERE bad = 0 OR stored IS NOT NULL""",
)
def _(m):
    return _j13(m.index.filter("date < date'1998-01-01'"), m.index.filter("date >= date'1994-01-01'")).rows


#: Every stored day against its official level.
_J13_ALL_OLD = "(SELECT date, index_value, CASE WHEN day(date) % 5 = 2 THEN 'MCAP_WEIGHTED_ESTIMATE' ELSE source END AS source FROM market_index)"
_J13_ALL_LIVE = "(SELECT date, CASE WHEN day(date) % 4 = 1 THEN index_value + 0.5::DOUBLE ELSE index_value END AS index_value FROM market_index)"


@query(
    "j13_tier1_mismatches", "market_index",
    f"SELECT date, o.index_value AS stored, l.index_value AS live, source FROM {_J13_ALL_OLD} o JOIN {_J13_ALL_LIVE} l USING (date) WHERE {tier('source')} = 1 AND abs(o.index_value - l.index_value) > 0.05",
)
def _(m):
    return _j13(m.index, m.index).quarantine


_J14 = {c: "replace" for c in ("high", "low", "close", "volume", "value_mn")} | {"source": "coalesce"}


@query(
    "j14_promote_prices", "prices prices_existing",
    f"""SELECT * FROM ({merge_sql("(SELECT * REPLACE (CASE WHEN key % 3 = 1 THEN 'STAGING_DB' ELSE source END AS source) FROM prices)",
                                  "SELECT * REPLACE ('STAGING_DB' AS source), 0 AS seq FROM prices_existing", _K, _J14, tiered=True)}) x
        WHERE source <> 'STAGING_DB' OR EXISTS (SELECT 1 FROM prices_existing p WHERE p.symbol = x.symbol AND p.date = x.date)
          OR NOT EXISTS (SELECT 1 FROM prices_existing p WHERE p.symbol = x.symbol)""",
)
def _(m):
    main = m.prices.withColumn("source", F.when(F.col("key") % 3 == 1, "STAGING_DB").otherwise(F.col("source")))
    null = F.lit(None).cast("double")
    staged = m.prices_existing.withColumns({c: null for c in ("ycp", "change", "change_percent")})
    return _cols(merge.promote_prices(main, staged), _K, _J14)


def _promotion_store(m):
    from bourselake.plans.catalog_streaming import new_store

    store = new_store(m)
    main = m.prices.withColumn("source", F.when(F.col("key") % 3 == 1, "STAGING_DB").otherwise(F.col("source")))
    store.commit({name: (rows, None) for name, rows in {"prices": sets.slices(main, m.slice_count, "symbol"), "index": m.index, "fundamentals": m.fundamentals, "roster": m.roster, "shareholding": m.shareholding}.items()})
    return store


def _staged(m):
    """Staged tables that pass their gates: other prices, index levels a point higher, statements of a second source, a new roster, later holdings."""
    null = F.lit(None).cast("double")
    return {
        "prices": m.prices_existing.withColumns({c: null for c in ("ycp", "change", "change_percent", "pe")}).withColumn("seq", F.lit(1)),
        "index": audits.cleaned(audits.audit_index(m.index.withColumn("index_value", F.col("index_value") + 1.0))),
        "fundamentals": audits.cleaned(audits.with_checks(m.fundamentals_incoming.withColumn("seq", F.lit(1)), audits.statement_checks()[0])),
        "roster": m.roster_incoming,
        "shareholding": audits.cleaned(audits.audit_shareholding(m.shareholding.withColumn("as_of_date", F.date_add("as_of_date", 31)))),
    }


def _promoted(m, staged):
    """What lies in the five tables after a promotion, in one form: table, key, value, source or state."""
    from bourselake.sinks.promotion import promote_to_store

    store = _promotion_store(m)
    gate = audits.staging_audit(staged["prices"], staged["fundamentals"], staged["shareholding"], staged["index"], "seq")
    promote_to_store(store, staged, gate, as_of=m.as_of)
    at = store.manifest()
    form = lambda name, key, value, label: store.read(name, at=at).select(F.lit(name).alias("table"), key.alias("key"), F.col(value).alias("value"), F.col(label).alias("label"))
    day, year = F.concat_ws("|", "symbol", F.col("date").cast("string")), F.concat_ws("|", "symbol", F.col("fiscal_year").cast("string"))
    rows = form("prices", day, "close", "source").unionByName(form("index", F.col("date").cast("string"), "index_value", "source"))
    rows = rows.unionByName(form("fundamentals", year, "eps_basic", "source")).unionByName(form("roster", F.col("symbol"), "face_value", "trading_status"))
    held = store.read("shareholding", at=at)
    return rows.unionByName(held.select(F.lit("shareholding").alias("table"), F.col("symbol").alias("key"), F.col("sponsor_pct").alias("value"), F.col("as_of_date").cast("string").alias("label")))


def _tables_sql(prices: str, index: str, fundamentals: str, roster: str, shareholding: str) -> str:
    return f"""SELECT 'prices' AS "table", symbol || '|' || CAST(date AS VARCHAR) AS key, close AS value, source AS label FROM {prices}
      UNION ALL SELECT 'index', CAST(date AS VARCHAR), index_value, source FROM {index}
      UNION ALL SELECT 'fundamentals', symbol || '|' || fiscal_year, eps_basic, source FROM {fundamentals}
      UNION ALL SELECT 'roster', symbol, face_value, trading_status FROM {roster}
      UNION ALL SELECT 'shareholding', symbol, sponsor_pct, CAST(as_of_date AS VARCHAR) FROM {shareholding}"""


_MAIN_PRICES = "(SELECT * REPLACE (CASE WHEN key % 3 = 1 THEN 'STAGING_DB' ELSE source END AS source) FROM stored_prices)"
_UNCHANGED = _tables_sql(_MAIN_PRICES, "market_index", "fundamentals", "roster", "shareholding")
_PRICES_AFTER = f"""(SELECT * FROM ({merge_sql(_MAIN_PRICES, "SELECT * REPLACE ('STAGING_DB' AS source), 0 AS seq FROM prices_existing", _K, _J14, tiered=True, plain=True)}) x
   WHERE source <> 'STAGING_DB' OR EXISTS (SELECT 1 FROM prices_existing p WHERE p.symbol = x.symbol AND p.date = x.date) OR NOT EXISTS (SELECT 1 FROM prices_existing p WHERE p.symbol = x.symbol))"""
_INDEX_AFTER = merge_sql("market_index", "SELECT * REPLACE (index_value + 1.0::DOUBLE AS index_value, 'STAGING_DB' AS source), 0 AS seq FROM market_index WHERE index_value + 1.0::DOUBLE BETWEEN 500 AND 20000", ["date"], _J4C, tiered=True)
_ROSTER_AFTER = """(SELECT symbol, coalesce(n.face_value, o.face_value) AS face_value, CASE WHEN n.here THEN 'Active' WHEN o.trading_status = 'Active' THEN 'Delisted' ELSE o.trading_status END AS trading_status
   FROM (SELECT *, true AS here FROM roster) o FULL JOIN (SELECT *, true AS here FROM roster_incoming) n USING (symbol))"""
_GOOD_HOLDINGS = "SELECT * REPLACE (as_of_date + 31 AS as_of_date), 0 AS seq FROM shareholding WHERE " + " AND ".join(f"{h}_pct BETWEEN 0 AND 100" for h in ("sponsor", "govt", "institute", "foreign", "public"))
_GOOD_HOLDINGS += " AND abs(sponsor_pct + govt_pct + institute_pct + foreign_pct + public_pct - 100.0) <= 1.0"
_GOOD_STATEMENTS = f"""SELECT * REPLACE ('STAGING_DB' AS source, 'Audited' AS audit_status), 0 AS seq FROM fundamentals_incoming WHERE NOT (fiscal_year < 1990 OR fiscal_year > 2050
   OR coalesce(dps < 0 OR bonus_pct < 0 OR short_term_loan_mn < 0 OR long_term_loan_mn < 0 OR revenue_mn < 0 OR gross_profit_mn > revenue_mn OR total_assets_mn < 0 OR total_liabilities_mn < 0
     OR abs(free_cash_flow_mn - {fx("(operating_cash_flow_mn - capex_mn)")}) > 0.05, false))"""
_VIEWS = "stored_prices prices_existing market_index fundamentals fundamentals_incoming roster roster_incoming shareholding"


@query(
    "j14_promotion_passed", _VIEWS,
    _tables_sql(
        _PRICES_AFTER, f"({_INDEX_AFTER})", "(" + merge_sql("fundamentals", _GOOD_STATEMENTS, _F, _J7S, guard="e.audit_status IS DISTINCT FROM 'Audited'") + ")",
        _ROSTER_AFTER, "(" + merge_sql("shareholding", _GOOD_HOLDINGS, ["symbol"], _J6S) + ")",
    ),
)
def promotion_passed(m):
    return _promoted(m, _staged(m))


@query("j14_promotion_failed", _VIEWS, _UNCHANGED)
def _(m):
    return _promoted(m, _staged(m) | {"prices": m.prices_dirty})


@query("j14_promotion_empty", _VIEWS, _UNCHANGED)
def _(m):
    return _promoted(m, {name: rows.limit(0) for name, rows in _staged(m).items()})


_STATEMENT_FIELDS = ("eps_basic", "nav_per_share", "dps")
_STATEMENT_CONFLICTS = " UNION ALL ".join(
    f"SELECT symbol, fiscal_year, '{f}' AS field, i.{f} AS v, i.source AS s FROM fundamentals e JOIN fundamentals_incoming i USING (symbol, fiscal_year) WHERE i.{f} IS DISTINCT FROM e.{f}" for f in _STATEMENT_FIELDS
)


@query(
    "j12_resolve_statements", "fundamentals fundamentals_incoming",
    f"""WITH q AS (SELECT * FROM ({_STATEMENT_CONFLICTS}) WHERE fiscal_year % 3 = 0),
        p AS (SELECT symbol, fiscal_year, {", ".join(f"max(CASE WHEN field = '{f}' THEN 1 END) AS has_{f}, max(CASE WHEN field = '{f}' THEN v END) AS {f}" for f in _STATEMENT_FIELDS)}, any_value(s) AS s FROM q GROUP BY ALL)
        SELECT e.symbol, e.fiscal_year, {", ".join(f"CASE WHEN has_{f} = 1 THEN p.{f} ELSE e.{f} END AS {f}" for f in _STATEMENT_FIELDS)}, CASE WHEN p.symbol IS NULL THEN e.source ELSE coalesce(p.s, 'USER_APPROVED_OVERRIDE') END AS source
        FROM fundamentals e LEFT JOIN p USING (symbol, fiscal_year)""",
)
def _(m):
    keys = ["symbol", "fiscal_year"]
    old = m.fundamentals.select(*keys, *[F.col(f).alias(f"o_{f}") for f in _STATEMENT_FIELDS])
    new = m.fundamentals_incoming.select(*keys, F.col("source").alias("incoming_source"), *_STATEMENT_FIELDS).join(old, keys)
    one = lambda f: F.when(~F.col(f).eqNullSafe(F.col(f"o_{f}")), F.struct(F.lit(f).alias("field_name"), F.col(f).alias("incoming_value")))
    found = new.select(*keys, "incoming_source", F.explode(F.array_compact(F.array(*[one(f) for f in _STATEMENT_FIELDS]))).alias("c")).select(*keys, "incoming_source", "c.*")
    found = found.withColumns({"id": F.concat_ws("|", "symbol", "fiscal_year", "field_name"), "target_table": F.lit("fundamentals_history"), "status": F.lit(merge.PENDING)})
    decided = found.filter(F.col("fiscal_year") % 3 != 2).select("id", F.when(F.col("fiscal_year") % 3 == 0, "ACCEPT_INCOMING").otherwise("KEEP_EXISTING").alias("resolution"), F.lit("reviewed").alias("note"))
    done = merge.resolve_quarantine(m.fundamentals, found, decided, table="fundamentals_history", keys=tuple(keys), fields=merge.STATEMENT_FIELDS_APPLICABLE)
    return done.rows.select(*keys, *_STATEMENT_FIELDS, "source")


@query(
    "j15_derived_ratios", "statements",
    f"""SELECT symbol, fiscal_year, year_end_close, pe_ratio, pb_ratio, roe, dividend_yield, shares,
          {fx("(year_end_close * CAST(shares AS DOUBLE) / 1e6::DOUBLE)")} AS market_cap_mn FROM statements""",
)
def _(m):
    return m.statements.select("symbol", "fiscal_year", "year_end_close", "pe_ratio", "pb_ratio", "roe", "dividend_yield", "shares", "market_cap_mn")


@query(
    "j15_december_year_end", "fundamentals bars",
    f"""SELECT symbol, fiscal_year, year_end_close, CASE WHEN nav_per_share > 0 THEN {fx("r", 3)} END AS pb_ratio FROM (
          SELECT f.symbol, f.fiscal_year, f.nav_per_share, p.close AS year_end_close, p.close / f.nav_per_share AS r
          FROM fundamentals f ASOF LEFT JOIN bars p ON f.symbol = p.symbol AND make_date(f.fiscal_year, 12, 31) >= p.date)""",
)
def _(m):
    from bourselake.operators.ratios import derived_ratios

    r = derived_ratios(m.fundamentals, m.bars, month=12, day=31, digits=3)
    return r.select("symbol", "fiscal_year", "year_end_close", "pb_ratio")


@query(
    "j16_roster_activity_refresh", "roster roster_incoming bars asof_day",
    """WITH t AS (SELECT DISTINCT symbol, true AS t FROM bars WHERE date >= (SELECT d FROM asof_day) - 5)
       SELECT symbol, CASE WHEN t THEN coalesce(d.name, r.name) ELSE r.name END AS name, CASE WHEN t THEN coalesce(d.sector, r.sector) ELSE r.sector END AS sector,
         CASE WHEN t THEN coalesce(d.category, r.category) ELSE r.category END AS category, CASE WHEN t THEN coalesce(d.face_value, r.face_value) ELSE r.face_value END AS face_value,
         CASE WHEN t THEN coalesce(d.total_shares, r.total_shares) ELSE r.total_shares END AS total_shares, coalesce(t, false) AS is_active
       FROM (SELECT * FROM roster WHERE key % 10 <> 6) r FULL JOIN t USING (symbol) LEFT JOIN (SELECT * REPLACE (CASE WHEN key % 4 = 0 THEN -5.0::DOUBLE ELSE face_value END AS face_value) FROM roster_incoming
         WHERE NOT (key % 4 = 0)) d USING (symbol)""",
)
def _(m):
    details = m.roster_incoming.withColumn("face_value", F.when(F.col("key") % 4 == 0, F.lit(-5.0)).otherwise(F.col("face_value")))
    out = merge.roster_activity_refresh(m.roster.filter(F.col("key") % 10 != 6), m.bars, details, as_of=m.as_of, days=5)
    return out.select("symbol", *merge.ROSTER_DETAILS, "is_active")


_OVERLAY = f"""
WITH l AS (SELECT symbol, high AS ltp, CASE WHEN k3 = 0 THEN close END AS ycp, CASE WHEN k4 = 1 THEN high - low + CASE WHEN k5 = 2 THEN 900.0::DOUBLE ELSE 0.0::DOUBLE END END AS change,
    CASE WHEN k4 = 1 THEN CASE WHEN k5 = 2 THEN 60.0::DOUBLE ELSE 1.5::DOUBLE END END AS change_percent
  FROM (SELECT symbol, arg_max(high, date) AS high, arg_max(low, date) AS low, arg_max(close, date) AS close, any_value(key % 3) AS k3, any_value(key % 4) AS k4, any_value(key % 5) AS k5 FROM bars WHERE key % 7 <> 0 GROUP BY symbol)),
b AS (SELECT symbol, arg_max(close, date) AS ltp, arg_max(ycp, date) AS ycp, arg_max(change, date) AS change, arg_max(change_percent, date) AS change_percent FROM prices GROUP BY symbol),
e AS (SELECT symbol, arg_max(eps_basic, fiscal_year) AS eps FROM fundamentals GROUP BY symbol),
s1 AS (SELECT b.symbol, e.eps, b.ltp AS b_ltp, b.ycp AS b_ycp, b.change AS b_change, b.change_percent AS b_pct, l.ltp AS l_ltp, l.change AS own, l.change_percent AS own_pct,
    coalesce(l.ycp, {fx("(l.ltp - l.change)")}, b.ycp) AS y, {fx("(l.ltp - l.change)")} AS back, l.symbol IS NOT NULL AS has FROM b LEFT JOIN e USING (symbol) LEFT JOIN l ON l.symbol = b.symbol),
s2 AS (SELECT *, coalesce(own, {fx("(l_ltp - y)")}) AS chg FROM s1),
s3 AS (SELECT *, CASE WHEN own IS NOT NULL OR y IS NULL THEN own_pct ELSE CASE WHEN y > 0 THEN {fx("(chg / y * 100.0::DOUBLE)")} END END AS pct FROM s2),
s4 AS (SELECT *, coalesce(abs(pct) > 25, false) AS wild FROM s3)
SELECT symbol, eps, CASE WHEN has THEN l_ltp ELSE b_ltp END AS ltp, CASE WHEN has THEN CASE WHEN wild THEN back ELSE y END ELSE b_ycp END AS ycp,
  CASE WHEN has THEN CASE WHEN wild THEN own ELSE chg END ELSE b_change END AS change,
  CASE WHEN has THEN CASE WHEN wild THEN CASE WHEN own IS NOT NULL THEN own_pct END ELSE pct END ELSE b_pct END AS change_percent,
  CASE WHEN has AND eps > 0 THEN {fx("(l_ltp / eps)")} END AS daily_pe, has AS is_live FROM s4"""


def live_ticks(m):
    """The day's last session dressed as a live tick: some ticks carry their own change, some a previous close."""
    k = F.col("key")
    g = m.bars.filter(k % 7 != 0).groupBy("symbol", "key").agg(*[F.max_by(c, "date").alias(c) for c in ("high", "low", "close")])
    own = k % 4 == 1
    return g.select(
        "symbol", F.col("high").alias("ltp"), F.when(k % 3 == 0, F.col("close")).alias("ycp"),
        F.when(own, F.col("high") - F.col("low") + F.when(k % 5 == 2, 900.0).otherwise(0.0)).alias("change"),
        F.when(own, F.when(k % 5 == 2, 60.0).otherwise(1.5)).alias("change_percent"),
    )


def live_base(m):
    b = m.prices.groupBy("symbol").agg(F.max_by("close", "date").alias("ltp"), *[F.max_by(c, "date").alias(c) for c in ("ycp", "change", "change_percent")])
    e = m.fundamentals.groupBy("symbol").agg(F.max_by("eps_basic", "fiscal_year").alias("eps"))
    return b.join(e, "symbol", "left").withColumn("daily_pe", F.lit(None).cast("double"))


@query("j17_overlay_live", "bars prices fundamentals", _OVERLAY)
def _(m):
    return merge.overlay_live(live_base(m), live_ticks(m))


@query("e13_live_overlay_join", "prices fundamentals bars", f"SELECT symbol, ltp, is_live FROM ({_OVERLAY})")
def _(m):
    return merge.overlay_live(live_base(m), live_ticks(m)).select("symbol", "ltp", "is_live")


@query(
    "j18_index_membership_changes", "roster asof_day",
    """SELECT symbol, coalesce(o.p, false) AS previous, coalesce(n.c, false) AS current, CASE WHEN coalesce(n.c, false) THEN (SELECT d FROM asof_day) END AS added_date,
         CASE WHEN coalesce(o.p, false) THEN (SELECT d FROM asof_day) END AS removed_date
       FROM (SELECT symbol, ds30 AS p FROM roster) o FULL JOIN (SELECT symbol, (ds30 AND key % 3 <> 0) OR key % 10 = 3 AS c FROM roster WHERE key % 9 <> 8) n USING (symbol)
       WHERE coalesce(o.p, false) <> coalesce(n.c, false)""",
)
def _(m):
    new = m.roster.filter(F.col("key") % 9 != 8).select("symbol", ((F.col("ds30") & (F.col("key") % 3 != 0)) | (F.col("key") % 10 == 3)).alias("ds30"))
    return merge.index_membership_changes(m.roster, new, as_of=m.as_of)
