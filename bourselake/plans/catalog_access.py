"""Access windows, subscriptions and account joins (family N and the account joins of E and H)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from bourselake.operators import access, lookups
from bourselake.plans.catalog import query
from bourselake.plans.marts import symbol_of
from bourselake.plans.oracle import VIEWS


@query("n1_free_window", "bars asof_day", "SELECT symbol, date, close FROM bars WHERE date >= (SELECT d FROM asof_day) - 183")
def _(m):
    return access.free_window_filter(m.bars.select("symbol", "date", "close"), as_of=m.as_of)


@query("n2_latest_year_only", "fundamentals", "SELECT symbol, fiscal_year, eps_basic, dps FROM fundamentals f WHERE fiscal_year = (SELECT max(fiscal_year) FROM fundamentals x WHERE x.symbol = f.symbol)")
def _(m):
    return access.latest_year_only(m.fundamentals.select("symbol", "fiscal_year", "eps_basic", "dps"))


@query(
    "n3_lock_deep_dive", "roster bars statements asof_day",
    """SELECT symbol, NOT paid AS locked, CASE WHEN NOT paid THEN (SELECT d FROM asof_day) - 183 END AS free_from, NOT paid AS ath_hidden, CASE WHEN paid THEN s ELSE 0 END AS statement_years, CASE WHEN paid THEN n ELSE f END AS timeline_days FROM (
         SELECT r.symbol, r.symbol LIKE '%7' AS paid, (SELECT count(*) FROM statements x WHERE x.symbol = r.symbol) AS s, (SELECT count(*) FROM bars b WHERE b.symbol = r.symbol) AS n,
           (SELECT count(*) FROM bars b WHERE b.symbol = r.symbol AND b.date >= (SELECT d FROM asof_day) - 183) AS f FROM roster r)""",
)
def _(m):
    from bourselake.plans.catalog_valuation import deep_dive

    g = access.lock_deep_dive(deep_dive(m), as_of=m.as_of, entitled=F.col("symbol").like("%7"))
    return g.select("symbol", "locked", "free_from", F.col("ath").isNull().alias("ath_hidden"), F.size("financial_statements").alias("statement_years"), F.size("timeline").alias("timeline_days"))


@query(
    "n4_gate_disclosure_columns", "fundamentals roster prices",
    """SELECT f.symbol, r.name, p.close AS ltp, f.eps_basic AS eps, f.nav_per_share FROM (SELECT * FROM fundamentals f WHERE fiscal_year = (SELECT max(fiscal_year) FROM fundamentals x WHERE x.symbol = f.symbol)) f
       LEFT JOIN roster r USING (symbol) LEFT JOIN (SELECT symbol, arg_max(close, date) AS close FROM prices GROUP BY symbol) p ON p.symbol = f.symbol""",
)
def _(m):
    f = m.fundamentals.withColumn("dividend_yield", F.lit(None).cast("double"))
    gated = access.gate_disclosure_columns(lookups.stock_screen(f, m.roster, m.prices))
    assert not set(access.DISCLOSURE_COLUMNS) & set(gated.columns)
    return gated.select("symbol", "name", "ltp", "eps", "nav_per_share")


_DAYS = "CASE plan WHEN 'WEEKLY' THEN 7 WHEN 'MONTHLY' THEN 30 WHEN 'QUARTERLY' THEN 90 WHEN 'HALF_YEARLY' THEN 180 END"
VIEWS["premium"] = (
    ("payments",),
    f"""SELECT user_id, max(created_at + CAST(tail AS INTEGER)) AS until_day FROM (
          SELECT user_id, created_at, sum({_DAYS}) OVER (PARTITION BY user_id ORDER BY created_at, txn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tail FROM payments WHERE status = 'SUCCESS' AND {_DAYS} IS NOT NULL) GROUP BY user_id""",
)


def _premium(m):
    return access.entitlement_fold(access.payment_grants(m.payments))


@query("n5_entitlement_fold", "premium", "SELECT user_id, until_day FROM premium")
def _(m):
    return _premium(m).select("user_id", F.to_date("premium_until").alias("until_day"))


@query("n6_is_active_at", "premium", "SELECT user_id, until_day > DATE '2001-10-01' AS active FROM premium")
def _(m):
    return access.is_active_at(_premium(m), dt.date(2001, 10, 1)).select("user_id", "active")


@query(
    "n7_validate_promo", "promos",
    """SELECT a.o_orderkey AS id, reason IS NULL AS ok, reason, CASE WHEN reason IS NULL THEN h END AS bonus_hours FROM (
         SELECT a.o_orderkey, h, CASE WHEN NOT coalesce(p.active, false) THEN 'INACTIVE_CODE' WHEN r.code IS NOT NULL THEN 'CODE_ALREADY_REDEEMED' WHEN h <= 0 THEN 'CODE_WITHOUT_BONUS' END AS reason
         FROM (SELECT *, upper(CASE WHEN o_orderkey % 9 = 4 THEN 'GONE' ELSE o_orderpriority END) AS code FROM orders WHERE o_orderstatus <> 'F') a
         LEFT JOIN (SELECT *, coalesce(bonus_days, 0) * 24 + coalesce(bonus_hours, 0) AS h FROM promos) p ON p.code = a.code
         LEFT JOIN (SELECT DISTINCT o_custkey, o_orderpriority AS code FROM orders WHERE o_orderstatus = 'F') r ON r.o_custkey = a.o_custkey AND r.code = a.code) a""",
)
def _(m):
    o = m.table("orders")
    typed = F.when(F.col("o_orderkey") % 9 == 4, "gone").otherwise(F.concat(F.lit(" "), F.lower("o_orderpriority")))
    attempts = o.filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), typed.alias("code"))
    redeemed = o.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("code"))
    return access.validate_promo(attempts, m.promos, redeemed).select("id", "ok", "reason", "bonus_hours")


@query(
    "n8_payment_settlement", "payments",
    """SELECT txn, user_id, plan, amount_bdt, created_at, CASE WHEN status = 'SUCCESS' OR txn % 6 = 5 THEN status WHEN good THEN 'SUCCESS' ELSE 'FAILED' END AS status, status <> 'SUCCESS' AND txn % 6 <> 5 AND good AS granted_now
       FROM (SELECT *, txn % 7 <> 0 AND txn % 5 <> 0 AND txn % 11 <> 0 AND txn % 13 <> 0 AS good FROM payments)""",
)
def _(m):
    t = F.col("txn")
    # Two callbacks per transaction; transactions with remainder 5 never hear back.
    cb = m.payments.filter(t % 6 != 5).select(
        "txn", F.when(t % 7 != 0, F.concat(F.lit("v"), t.cast("string"))).alias("val_id"), F.when(t % 5 == 0, "FAILED").when(t % 2 == 0, "VALID").otherwise("VALIDATED").alias("status"),
        (F.col("amount_bdt") + F.when(t % 11 == 0, 0.6).otherwise(0.2)).alias("amount"), F.when(t % 13 == 0, t + 1).otherwise(t).alias("tran_id"),
    )
    return access.payment_settlement(m.payments, cb.unionByName(cb))


@query("n9_watchlist_view", "watchlist", "SELECT user_id, symbol, added_at FROM watchlist")
def _(m):
    return access.watchlist_view(m.watchlist)


_NEW = "(SELECT o_custkey AS user_id, 'S' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 10, '0') AS symbol, CAST(o_orderdate AS DATE) AS added_at FROM orders)"


def _picked(m):
    o = m.table("orders")
    return o.select(F.col("o_custkey").alias("user_id"), F.concat(F.lit(" "), F.lower(symbol_of(F.col("o_orderkey") % 100))).alias("symbol"), F.col("o_orderdate").cast("date").alias("added_at"))


@query(
    "n9_watchlist_merge", "watchlist",
    f"""SELECT user_id, symbol, coalesce(w.added_at, n.a) AS added_at FROM watchlist w FULL JOIN (SELECT user_id, symbol, min(added_at) AS a FROM {_NEW} GROUP BY 1, 2) n USING (user_id, symbol)""",
)
def _(m):
    return access.watchlist_add(m.watchlist, _picked(m))


@query("n9_watchlist_remove", "watchlist", f"SELECT user_id, symbol, added_at FROM watchlist w WHERE NOT EXISTS (SELECT 1 FROM {_NEW} n WHERE n.user_id = w.user_id AND n.symbol = w.symbol)")
def _(m):
    return access.watchlist_remove(m.watchlist, _picked(m))


@query("e12_users_with_entitlements", "users premium", "SELECT u.user_id, email, name, created_at, until_day FROM users u LEFT JOIN premium USING (user_id)")
def _(m):
    e = access.users_with_entitlements(m.users, _premium(m))
    return e.select("user_id", "email", "name", "created_at", F.to_date("premium_until").alias("until_day"))


@query("b5_user_export", "users premium", "SELECT u.user_id, email, name, created_at, until_day FROM users u LEFT JOIN premium USING (user_id)")
def _(m):
    e = access.users_with_entitlements(m.users, _premium(m)).orderBy(F.desc("created_at"))
    return e.select("user_id", "email", "name", "created_at", F.to_date("premium_until").alias("until_day"))


@query(
    "h1_newest_admin_actions", "users",
    "SELECT o_orderkey AS id, o_custkey AS user_id, o_orderpriority AS action, CAST(o_orderdate AS DATE) AS created_at, u.email AS admin_email FROM orders JOIN users u ON u.user_id = o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey LIMIT 200",
)
def _(m):
    a = m.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("action"), F.col("o_orderdate").cast("date").alias("created_at"))
    return access.actions_with_users(a, m.users, 200)
