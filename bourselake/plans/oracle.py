"""The same market tables as ANSI SQL common table expressions, for checking results on another engine."""

from __future__ import annotations


def sym(key: str) -> str:
    return f"('S' || lpad(CAST({key} AS VARCHAR), 10, '0'))"


def fx(x: str, digits: int = 2) -> str:
    """Round on the exact binary value (see ``functions.numbers.to_fixed``); ``x`` should be a short expression."""
    m = f"{float(10**digits)}"
    a = f"abs({x})"
    w = f"({a} * 134217729.0::DOUBLE)"
    hi = f"({w} - ({w} - {a}))"
    lo = f"({a} - {hi})"
    p = f"({a} * {m}::DOUBLE)"
    e = f"(({hi} * {m}::DOUBLE - {p}) + {lo} * {m}::DOUBLE)"
    up = f"(CASE WHEN {p} - floor({p}) > 0.5 OR ({p} - floor({p}) = 0.5 AND {e} >= 0) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
    return f"(sign({x}) * ((floor({p}) + {up}) / {m}::DOUBLE))"


def bars(where: str = "true") -> str:
    return f"""
    SELECT {sym("key")} AS symbol, key, date, CAST(NULL AS DOUBLE) AS open, high, low,
           CAST(vc AS DOUBLE) / 100.0::DOUBLE / CAST(volume AS DOUBLE) AS close,
           volume, CAST(vc AS DOUBLE) / 1e8::DOUBLE AS value_mn, trades, vc AS value_cents,
           CASE key % 3 WHEN 0 THEN 'DSE_SCRAPE' WHEN 1 THEN 'LANKABD' ELSE 'UNKNOWN' END AS source
    FROM (SELECT l_suppkey AS key, CAST(l_shipdate AS DATE) AS date,
                 max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
                 CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS vc,
                 CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS volume, count(*) AS trades
          FROM lineitem WHERE {where} GROUP BY 1, 2)"""


def index_of(where: str) -> str:
    return f"""
    SELECT date, CAST(vc AS DOUBLE) / 100.0::DOUBLE / CAST(total_volume AS DOUBLE) AS index_value,
           advancing, declining, unchanged, total_trades, total_volume,
           CAST(vc AS DOUBLE) / 1e8::DOUBLE AS total_value_mn,
           CASE day(date) % 4 WHEN 0 THEN 'DSE_OFFICIAL_ARCHIVE' WHEN 1 THEN 'DSE_OFFICIAL_BENCHMARK'
                WHEN 2 THEN 'DSE_OFFICIAL_GRAPH' ELSE 'LANKABD' END AS source
    FROM (SELECT date, CAST(sum(value_cents) AS BIGINT) AS vc, CAST(sum(volume) AS BIGINT) AS total_volume,
                 count(*) FILTER (close > ycp) AS advancing, count(*) FILTER (close < ycp) AS declining,
                 count(*) FILTER (close = ycp) AS unchanged, CAST(sum(trades) AS BIGINT) AS total_trades
          FROM prices WHERE {where} GROUP BY date)"""


TIER = {
    "DSE_OFFICIAL_ARCHIVE": 1, "DSE_OFFICIAL_BENCHMARK": 1, "DSE_OFFICIAL_GRAPH": 1, "DSE_SCRAPE": 1, "DSE_OFFICIAL": 1,
    "DSE_LIVE_CLOSING": 1, "DSE_LIVE_TICKER": 1, "STAGING_DB": 1, "LANKABD": 2,
}


def tier(source: str) -> str:
    ones = ", ".join(f"'{s}'" for s, t in TIER.items() if t == 1)
    return f"(CASE WHEN {source} IN ({ones}) THEN 1 WHEN {source} = 'LANKABD' THEN 2 END)"


def allows(existing: str, incoming: str) -> str:
    return f"coalesce({tier(incoming)} <= {tier(existing)}, true)"


def cent(x: str) -> str:
    return f"CAST(round({x} * 100) AS BIGINT)"


_SH = {"sponsor": "'RO'", "govt": "'RF'", "institute": "'AF'", "foreign": "'AO'", "public": "'NO', 'NF'"}


def _shareholding() -> str:
    sums = ", ".join(
        f"coalesce(sum(q) FILTER (flag IN ({f})), 0) AS {h}_now, coalesce(sum(q) FILTER (flag IN ({f}) AND old), 0) AS {h}_prev"
        for h, f in _SH.items()
    )
    now = ", ".join(
        (
            f"CASE WHEN key % 13 = 0 THEN CAST({h}_now AS DOUBLE) * 100.0::DOUBLE / CAST(all_now AS DOUBLE) + 5.0::DOUBLE "
            f"ELSE CAST({h}_now AS DOUBLE) * 100.0::DOUBLE / CAST(all_now AS DOUBLE) END AS {h}_pct"
            if h == "public"
            else f"CAST({h}_now AS DOUBLE) * 100.0::DOUBLE / CAST(all_now AS DOUBLE) AS {h}_pct"
        )
        for h in _SH
    )
    prev = ", ".join(
        f"CASE WHEN has_prev THEN CAST({h}_prev AS DOUBLE) * 100.0::DOUBLE / CAST(all_prev AS DOUBLE) END AS prev_{h}_pct" for h in _SH
    )
    return f"""
    SELECT {sym("key")} AS symbol, key, {now}, {prev}, DATE '2001-12-31' AS as_of_date,
           CASE WHEN has_prev THEN DATE '1998-12-31' END AS prev_as_of_date
    FROM (SELECT *, (key % 10 <> 9 AND all_prev IS NOT NULL) AS has_prev FROM (
          SELECT key, sum(q) AS all_now, sum(q) FILTER (old) AS all_prev, {sums}
          FROM (SELECT l_suppkey AS key, CAST(l_quantity AS BIGINT) AS q, l_returnflag || l_linestatus AS flag,
                       CAST(l_shipdate AS DATE) < DATE '1999-01-01' AS old FROM lineitem) GROUP BY key))"""


_FUND_COLS = """key, fiscal_year, period, eps_basic, eps_diluted, nav_per_share, dps, bonus_pct, paid_up_capital_mn,
  authorized_capital_mn, revenue_mn, gross_profit_mn, operating_profit_mn, net_income_mn, total_assets_mn, total_liabilities_mn,
  current_assets_mn, current_liabilities_mn, reserve_surplus_mn, oci_mn, short_term_loan_mn, long_term_loan_mn,
  operating_cash_flow_mn, capex_mn, free_cash_flow_mn, debt_to_equity, current_ratio, quarterly_disclosure, audit_status, source"""

# name -> (names it reads, body)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "bars": ((), bars()),
    "priced": (("bars",), "SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS ycp FROM bars"),
    "prices": (
        ("priced",),
        f"""SELECT *, CASE WHEN ycp > 0 THEN {fx("(close - ycp)")} END AS change,
            CASE WHEN ycp > 0 THEN {fx("((close - ycp) / ycp * 100.0::DOUBLE)")} END AS change_percent,
            CAST(NULL AS DOUBLE) AS pe, CAST(NULL AS DOUBLE) AS market_cap_mn FROM priced""",
    ),
    "asof_day": ((), "SELECT max(CAST(l_shipdate AS DATE)) AS d FROM lineitem"),
    "prices_dirty": (
        ("prices",),
        """SELECT * REPLACE (close2 AS close, close2 / 100.0::DOUBLE AS pe), unnest(CASE WHEN day(date) = 17 THEN [1, 2] ELSE [1] END) AS seq
           FROM (SELECT *, CASE WHEN key % 5 = 0 AND day(date) = 13 THEN 0.0::DOUBLE ELSE close END AS close2 FROM prices)""",
    ),
    "prices_existing": ((), bars("l_linestatus = 'O'")),
    "prices_incoming": (
        (),
        f"""SELECT * REPLACE (CASE WHEN year(date) % 2 = 0 THEN 'LANKABD' ELSE 'DSE_SCRAPE' END AS source,
              CASE WHEN seq = 2 THEN close + 1.0::DOUBLE ELSE close END AS close, CASE WHEN seq = 2 THEN NULL ELSE high END AS high)
            FROM (SELECT *, unnest(CASE WHEN day(date) = 17 THEN [1, 2] ELSE [1] END) AS seq FROM ({bars("l_returnflag <> 'N'")}))""",
    ),
    "stored_prices": (("prices",), "SELECT * FROM prices"),
    "daily_batch": (
        ("prices_incoming",),
        f"""SELECT symbol, date, seq, close, ycp, coalesce(given, CASE WHEN ycp > 0 THEN {fx("(close - ycp)")} END) AS change,
              CASE WHEN ycp > 0 THEN {fx("((close - ycp) / ycp * 100.0::DOUBLE)")} END AS change_percent, volume, close / 100.0::DOUBLE AS pe, high, low, value_mn, source
            FROM (SELECT *, CASE WHEN seq = 1 THEN close - 1.25::DOUBLE END AS ycp, CASE WHEN key % 2 = 0 THEN 0.5::DOUBLE END AS given FROM prices_incoming)""",
    ),
    "history_batch": (
        ("prices_incoming",),
        """SELECT *, CASE WHEN seq = 1 THEN close - 1.25::DOUBLE END AS ycp, CASE WHEN key % 2 = 0 THEN 0.5::DOUBLE END AS change,
             CAST(NULL AS DOUBLE) AS change_percent, close / 100.0::DOUBLE AS pe FROM prices_incoming""",
    ),
    "market_index": (("prices",), index_of("true")),
    "ds30": (
        ("prices",),
        f"""SELECT date, index_value AS ds30_index, source, lag(index_value) OVER (ORDER BY date) AS prev_close
            FROM ({index_of("key % 4 = 0")})""",
    ),
    "fundamentals": (
        (),
        f"""SELECT {sym("key")} AS symbol, key, fiscal_year, 'Annual' AS period, eps_basic,
              CASE WHEN key % 6 <> 0 THEN eps_basic * 0.95::DOUBLE END AS eps_diluted,
              revenue_mn * 50.0::DOUBLE AS nav_per_share,
              CASE WHEN (key + fiscal_year) % 5 = 0 THEN NULL
                   WHEN key % 4 = 0 THEN CAST(fiscal_year - 1990 AS DOUBLE) * 0.5::DOUBLE
                   ELSE floor(CAST(dq AS DOUBLE) * 10.0::DOUBLE / CAST(q AS DOUBLE)) / 10.0::DOUBLE END AS dps,
              CASE WHEN key % 5 = 1 THEN CAST(fiscal_year % 4 AS DOUBLE) END AS bonus_pct,
              paid_up_capital_mn, paid_up_capital_mn * 2.0::DOUBLE AS authorized_capital_mn,
              revenue_mn, gross_profit_mn, operating_profit_mn, net_income_mn,
              revenue_mn * 3.0::DOUBLE AS total_assets_mn, gross_profit_mn * 2.0::DOUBLE AS total_liabilities_mn,
              revenue_mn * 1.2::DOUBLE AS current_assets_mn, gross_profit_mn * 0.8::DOUBLE AS current_liabilities_mn,
              operating_profit_mn * 1.5::DOUBLE AS reserve_surplus_mn,
              CASE WHEN key % 9 <> 0 THEN revenue_mn * 0.01::DOUBLE END AS oci_mn,
              gross_profit_mn * 2.0::DOUBLE * 0.2::DOUBLE AS short_term_loan_mn,
              CASE WHEN key % 10 <> 3 THEN gross_profit_mn * 2.0::DOUBLE * 0.3::DOUBLE END AS long_term_loan_mn,
              net_income_mn + 1.0::DOUBLE AS operating_cash_flow_mn, 0.5::DOUBLE AS capex_mn,
              net_income_mn + 1.0::DOUBLE - 0.5::DOUBLE AS free_cash_flow_mn,
              CAST(NULL AS DOUBLE) AS debt_to_equity, CAST(NULL AS DOUBLE) AS current_ratio,
              CAST(NULL AS VARCHAR) AS quarterly_disclosure,
              CASE WHEN fiscal_year < 2001 THEN 'Audited' ELSE 'Provisional' END AS audit_status,
              CASE WHEN key % 2 = 0 THEN 'DSE_OFFICIAL' ELSE 'STAGING_DB' END AS source
            FROM (SELECT *, net_income_mn * 20.0::DOUBLE AS eps_basic FROM (
              SELECT key, fiscal_year, dq, q, CAST(ext AS DOUBLE) / 1e8::DOUBLE AS revenue_mn, CAST(gross AS DOUBLE) / 1e10::DOUBLE AS gross_profit_mn,
                CAST(oper AS DOUBLE) / 1e10::DOUBLE AS operating_profit_mn, CAST(net AS DOUBLE) / 1e8::DOUBLE AS net_income_mn,
                CASE WHEN s_acctbal > 0 THEN s_acctbal END AS paid_up_capital_mn
              FROM (SELECT l_suppkey AS key, CAST(year(l_shipdate) AS INTEGER) AS fiscal_year,
                      sum({cent("l_extendedprice")}) AS ext,
                      sum({cent("l_extendedprice")} * (100 - {cent("l_discount")})) AS gross,
                      sum({cent("l_extendedprice")} * (100 - {cent("l_discount")} - {cent("l_tax")})) AS oper,
                      sum(CASE WHEN l_returnflag = 'R' THEN -2 * {cent("l_extendedprice")} ELSE {cent("l_extendedprice")} END) AS net,
                      sum({cent("l_discount")} * CAST(l_quantity AS BIGINT)) AS dq, sum(CAST(l_quantity AS BIGINT)) AS q
                    FROM lineitem GROUP BY 1, 2) LEFT JOIN supplier ON s_suppkey = key))""",
    ),
    "year_close": (
        ("bars", "fundamentals"),
        """SELECT f.symbol, f.fiscal_year, p.close AS year_end_close
           FROM fundamentals f ASOF LEFT JOIN bars p ON f.symbol = p.symbol AND make_date(f.fiscal_year, 6, 30) >= p.date""",
    ),
    "statements": (
        ("fundamentals", "year_close"),
        f"""SELECT f.*, y.year_end_close,
              CASE WHEN eps_basic > 0 THEN {fx("(year_end_close / eps_basic)")} END AS pe_ratio,
              CASE WHEN nav_per_share > 0 THEN {fx("(year_end_close / nav_per_share)")} END AS pb_ratio,
              CASE WHEN nav_per_share > 0 AND eps_basic <> 0 THEN {fx("(eps_basic / nav_per_share * 100.0::DOUBLE)")} END AS roe,
              CASE WHEN dps > 0 AND year_end_close > 0 THEN {fx("(dps / year_end_close * 100.0::DOUBLE)")} END AS dividend_yield,
              CASE WHEN paid_up_capital_mn > 0 THEN CAST(floor(paid_up_capital_mn * 1e6::DOUBLE / 10.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) END AS shares
            FROM fundamentals f JOIN year_close y USING (symbol, fiscal_year)""",
    ),
    "fundamentals_incoming": (
        ("fundamentals",),
        """SELECT * REPLACE (CASE WHEN key % 3 = 0 THEN eps_basic + 1.0::DOUBLE ELSE eps_basic END AS eps_basic,
             CASE WHEN key % 2 = 0 THEN NULL ELSE oci_mn END AS oci_mn,
             coalesce(long_term_loan_mn, short_term_loan_mn * 0.5::DOUBLE) AS long_term_loan_mn) FROM fundamentals
           UNION ALL BY NAME SELECT * REPLACE (2050 AS fiscal_year) FROM fundamentals WHERE fiscal_year = 2000""",
    ),
    "roster": (
        (),
        f"""SELECT {sym("s_suppkey")} AS symbol, s_suppkey AS key, s_name AS name, r_name AS sector, n_name AS category,
              CASE WHEN s_suppkey % 7 <> 0 THEN 10.0::DOUBLE END AS face_value,
              CASE WHEN s_suppkey % 8 <> 0 THEN CAST(s_suppkey * 1000 + 1000000 AS DOUBLE) END AS total_shares,
              s_suppkey % 11 <> 0 AS is_active, s_suppkey % 4 = 0 AS ds30,
              CASE WHEN s_suppkey % 11 <> 0 THEN 'Active' ELSE 'Delisted' END AS trading_status, 'DSE_SCRAPE' AS source
            FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    ),
    "roster_incoming": (
        ("roster",),
        """SELECT * REPLACE (CASE WHEN key % 5 = 2 THEN 'NEW_' || category ELSE category END AS category,
             CASE WHEN key % 2 = 0 THEN face_value END AS face_value) FROM roster WHERE key % 6 <> 5
           UNION ALL BY NAME SELECT * REPLACE ('N' || symbol AS symbol) FROM roster WHERE key % 6 = 1""",
    ),
    "shareholding": ((), _shareholding()),
    "block_trades": (
        (),
        f"""SELECT symbol, key, date, volume AS quantity, value_mn, trades, low AS min_price, high AS max_price, 'LANKABD' AS source
            FROM ({bars("l_quantity >= 45")})""",
    ),
    "corporate_actions": (
        ("fundamentals",),
        """SELECT symbol, key, 'DIVIDEND' AS event_type, make_date(fiscal_year + 1, 3, 31) AS event_date,
             make_date(fiscal_year + 1, 3, 31) + 10 AS record_date, CAST(NULL AS DATE) AS agm_date, dps AS cash_dps, bonus_pct,
             fiscal_year, CASE WHEN key % 2 = 0 THEN 'LANKABD' ELSE 'DSE_OFFICIAL' END AS source
           FROM fundamentals WHERE dps IS NOT NULL""",
    ),
    "ratings": (
        ("fundamentals",),
        """SELECT symbol, key, CASE WHEN key % 3 = 0 THEN NULL ELSE 'CRAB' END AS rating_agency,
             CASE WHEN eps_basic > 20 THEN 'AAA' WHEN eps_basic > 0 THEN 'A' ELSE 'BB' END AS long_term_rating,
             CASE WHEN key % 2 = 0 THEN 'ST-1' END AS short_term_rating, CASE WHEN eps_basic < 0 THEN 'Negative' END AS outlook,
             make_date(fiscal_year, 5, 15) AS rating_date,
             CASE WHEN key % 7 = 0 THEN make_date(fiscal_year, 5, 15) - 1 ELSE make_date(fiscal_year, 5, 15) + 364 END AS valid_until,
             CAST(NULL AS VARCHAR) AS rating_action, 'DSE_OFFICIAL' AS source FROM fundamentals""",
    ),
    "lockins": (
        (),
        f"""SELECT {sym("key")} AS symbol, key, CASE WHEN flag = 'A' THEN NULL ELSE 'Lock-in ' || flag END AS lockin_category,
              CAST(CASE WHEN key % 9 = 0 AND flag = 'R' THEN 0 ELSE q END AS BIGINT) AS quantity, last_day + 365 AS release_date,
              'DSE_OFFICIAL' AS source
            FROM (SELECT l_suppkey AS key, l_returnflag AS flag, sum(CAST(l_quantity AS BIGINT)) AS q,
                         max(CAST(l_shipdate AS DATE)) AS last_day FROM lineitem GROUP BY 1, 2)""",
    ),
    "users": (
        (),
        """SELECT c_custkey AS user_id, c_name AS name, 'u' || c_custkey || '@example.com' AS email,
             DATE '1992-01-01' + CAST(c_custkey % 3650 AS INTEGER) AS created_at FROM customer""",
    ),
    "payments": (
        (),
        """SELECT txn, user_id, plan, CAST(price + CASE WHEN txn % 50 = 0 THEN 1 ELSE 0 END AS INTEGER) AS amount_bdt, status, created_at FROM (
             SELECT *, CASE plan WHEN 'WEEKLY' THEN 100 WHEN 'MONTHLY' THEN 300 WHEN 'QUARTERLY' THEN 700 WHEN 'HALF_YEARLY' THEN 1000 ELSE 5000 END AS price
             FROM (SELECT o_orderkey AS txn, o_custkey AS user_id,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'WEEKLY' WHEN '2-HIGH' THEN 'MONTHLY' WHEN '3-MEDIUM' THEN 'QUARTERLY'
                    WHEN '4-NOT SPECIFIED' THEN 'HALF_YEARLY' ELSE 'LIFETIME' END AS plan,
               CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'PENDING' ELSE 'FAILED' END AS status,
               CAST(o_orderdate AS DATE) AS created_at FROM orders))""",
    ),
    "redemptions": ((), "SELECT o_custkey AS user_id, o_orderpriority AS code, o_orderkey AS id FROM orders"),
    "promos": (
        ("redemptions",),
        """SELECT code, CAST(CASE WHEN code LIKE 'U%' THEN 1 ELSE TRY_CAST(code[1] AS INTEGER) % 3 END AS INTEGER) AS bonus_days,
             CAST(CASE WHEN code LIKE 'U%' THEN NULL WHEN code[1] = '3' THEN 0 ELSE TRY_CAST(code[1] AS INTEGER) * 2 END AS INTEGER) AS bonus_hours,
             code <> '5-LOW' AS active
           FROM (SELECT DISTINCT code FROM redemptions UNION ALL SELECT DISTINCT 'UNUSED-' || code FROM redemptions)""",
    ),
    "watchlist": (
        (),
        f"""SELECT o_custkey AS user_id, {sym("l_suppkey")} AS symbol, min(CAST(o_orderdate AS DATE)) AS added_at
            FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2""",
    ),
    "ticks": ((), f"SELECT {sym('user_id')} AS symbol, event_id, ts, value AS ltp FROM events"),
    "tick_base": (("ticks",), "SELECT symbol, arg_min(ltp, (ts, event_id)) AS ycp FROM ticks GROUP BY symbol"),
}


#: Views that are computed once and not copied into what reads them.
MATERIALIZED = ("stored_prices", "daily_batch", "history_batch")


def with_views(names: str, body: str) -> str:
    """``body`` under the common table expressions it reads, each with what it depends on."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for dep in VIEWS[name][0]:
            visit(dep)
        if name not in ordered:
            ordered.append(name)

    for n in names.split():
        visit(n)
    if not ordered:
        return body.strip()
    head = ",\n".join(f"{n} AS {'MATERIALIZED ' if n in MATERIALIZED else ''}({VIEWS[n][1]})" for n in ordered)
    text = body.strip()
    if text.upper().startswith("WITH "):
        return f"WITH {head},\n{text[5:]}"
    return f"WITH {head}\n{text}"
