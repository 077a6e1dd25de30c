"""Access windows, subscriptions and account tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bourselake.functions.labels import total_bonus_hours
from bourselake.functions.plans import FREE_WINDOW_DAYS, PLAN_DAYS

# Columns only paid users see, reasons a code is refused, and states of the payment gateway that count.
DISCLOSURE_COLUMNS = ("audited_pe", "paid_up_capital_mn", "authorized_capital_mn", "market_cap", "dividend_yield")
REFUSED_INACTIVE, REFUSED_REPEAT, REFUSED_EMPTY = "INACTIVE_CODE", "CODE_ALREADY_REDEEMED", "CODE_WITHOUT_BONUS"
VALID_GATEWAY_STATES = ("VALID", "VALIDATED")
LOCKED_BLOCKS = (
    "ath", "atl", "max_drawdown", "technical", "valuation_corridor", "mean_reversion", "graham", "disclosures", "risk_metrics",
    "fundamentals_growth", "week52", "liquidity", "shareholding",
)
EMPTIED_LISTS = ("financial_statements", "returns_table", "sector_percentile_trend")


def free_window_cutoff(as_of) -> Column:
    return F.date_sub(F.lit(as_of).cast("date"), FREE_WINDOW_DAYS)


def free_window_filter(df: DataFrame, *, as_of, entitled: bool = False) -> DataFrame:
    """Rows a free user may see: the cutoff day itself is inside."""
    return df if entitled else df.filter(F.col("date") >= free_window_cutoff(as_of))


def latest_year_only(statements: DataFrame, entitled: bool = False) -> DataFrame:
    if entitled:
        return statements
    cols = [c for c in statements.columns if c != "symbol"]
    return statements.groupBy("symbol").agg(F.max_by(F.struct(*cols), "fiscal_year").alias("_l")).select("symbol", "_l.*")


def lock_deep_dive(deep: DataFrame, *, as_of, entitled: Column | bool = False) -> DataFrame:
    """Null the paid blocks, empty the paid lists and cut the timeline to the free window, per row."""
    paid = F.lit(entitled) if isinstance(entitled, bool) else entitled
    cutoff = free_window_cutoff(as_of)
    out = deep
    for c in LOCKED_BLOCKS:
        if c in deep.columns:
            out = out.withColumn(c, F.when(paid, F.col(c)))
    for c in EMPTIED_LISTS:
        if c in deep.columns:
            out = out.withColumn(c, F.when(paid, F.col(c)).otherwise(F.filter(c, lambda _: F.lit(False))))
    out = out.withColumn("timeline", F.when(paid, F.col("timeline")).otherwise(F.filter("timeline", lambda t: t["date"] >= cutoff)))
    return out.withColumn("locked", ~paid).withColumn("free_from", F.when(~paid, cutoff))


def gate_disclosure_columns(screen: DataFrame, entitled: bool = False) -> DataFrame:
    return screen if entitled else screen.drop(*DISCLOSURE_COLUMNS)


def entitlement_fold(grants: DataFrame, *, user: str = "user_id", at: str = "granted_at", days: str = "days") -> DataFrame:
    """End of access per user after all grants: each grant extends from the later of now and the current end.

    One grant maps an end x to max(x, at) + days, and such steps compose: a run of grants is one pair (total days,
    latest end it alone leads to). So grants fold first within the second, then within the day, then over days. A
    user with a third of all payments is spread over seconds and days, and the last window has one row per calendar day.
    ``at`` is a timestamp, ``days`` may be fractional. Output: (user, premium_until).
    """
    day_seconds = 86400.0
    t = F.unix_micros(F.col(at).cast("timestamp")).cast("double") / 1e6
    base = grants.select(user, t.alias("t"), (F.col(days) * day_seconds).alias("d")).groupBy(user, "t").agg(F.sum("d").alias("d"))
    base = base.withColumn("m", F.col("t") + F.col("d")).withColumn("day", F.floor(F.col("t") / day_seconds))

    def fold(df: DataFrame, group: list[str], order: str) -> DataFrame:
        later = W.partitionBy(*group).orderBy(order).rowsBetween(1, W.unboundedFollowing)
        tail = F.coalesce(F.sum("d").over(later), F.lit(0.0))
        return df.withColumn("e", F.col("m") + tail).groupBy(*group).agg(F.sum("d").alias("d"), F.max("e").alias("m"))

    per_day = fold(base, [user, "day"], "t")
    done = fold(per_day, [user], "day")
    return done.select(user, F.timestamp_micros(F.rint(F.col("m") * 1e6).cast("long")).alias("premium_until"))


def plan_days(plan: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in PLAN_DAYS.items() for x in kv]), plan)


def payment_grants(payments: DataFrame) -> DataFrame:
    """Access days bought by successful payments of known plans."""
    days = plan_days(F.col("plan"))
    return payments.filter((F.col("status") == "SUCCESS") & days.isNotNull()).select(
        "user_id", F.col("created_at").cast("timestamp").alias("granted_at"), days.cast("double").alias("days")
    )


def is_active_at(entitlements: DataFrame, at) -> DataFrame:
    active = F.coalesce(F.col("premium_until") > F.lit(at).cast("timestamp"), F.lit(False))
    return entitlements.withColumn("active", active)


def validate_promo(attempts: DataFrame, promos: DataFrame, redeemed: DataFrame) -> DataFrame:
    """Each attempt (user_id, code) with the verdict and, where refused, the reason."""
    code = F.upper(F.trim("code"))
    done = redeemed.select("user_id", code.alias("code")).distinct().withColumn("_done", F.lit(True))
    a = attempts.withColumn("code", code)
    j = a.join(promos.select("code", "bonus_days", "bonus_hours", "active"), "code", "left").join(done, ["user_id", "code"], "left")
    hours = total_bonus_hours(F.col("bonus_days"), F.col("bonus_hours"))
    reason = (
        F.when(~F.coalesce(F.col("active"), F.lit(False)), REFUSED_INACTIVE).when(F.col("_done").isNotNull(), REFUSED_REPEAT).when(hours <= 0, REFUSED_EMPTY)
    )
    return j.select(*attempts.columns, reason.isNull().alias("ok"), reason.alias("reason"), F.when(reason.isNull(), hours).alias("bonus_hours"))


def payment_settlement(payments: DataFrame, callbacks: DataFrame) -> DataFrame:
    """New payment states after gateway callbacks (txn, val_id, status, amount, tran_id).

    A settled payment is left alone, so access is granted once however often a callback arrives. A payment succeeds when
    any of its callbacks verifies: valid state, same transaction and the recorded amount after rounding.
    """
    # Repeated callbacks collapse before the join.
    c = callbacks.select("txn", "val_id", F.col("status").alias("gateway"), "amount", "tran_id").distinct()
    known = payments.select("txn", F.col("amount_bdt").alias("recorded"))
    ok = (
        F.col("val_id").isNotNull() & F.col("gateway").isin(*VALID_GATEWAY_STATES)
        & (F.floor(F.col("amount") + 0.5) == F.col("recorded")) & (F.col("tran_id") == F.col("txn"))
    )
    verdict = c.join(known, "txn").groupBy("txn").agg(F.max(F.coalesce(ok, F.lit(False))).alias("verified"))
    j = payments.join(verdict, "txn", "left")
    settled = F.col("status") == "SUCCESS"
    status = F.when(settled | F.col("verified").isNull(), F.col("status")).when(F.col("verified"), "SUCCESS").otherwise("FAILED")
    return j.select(*[c for c in payments.columns if c != "status"], status.alias("status"), (~settled & F.coalesce("verified", F.lit(False))).alias("granted_now"))


# -- watchlists -------------------------------------------------------------------------------------------------------


def watchlist_view(watchlist: DataFrame) -> DataFrame:
    return watchlist.orderBy("user_id", F.desc("added_at"), "symbol")


def watchlist_add(watchlist: DataFrame, added: DataFrame) -> DataFrame:
    """Add (user_id, symbol, added_at); an entry that is already there keeps its day."""
    clean = added.withColumn("symbol", F.upper(F.trim("symbol"))).filter(F.col("symbol") != "")
    return watchlist.unionByName(clean.withColumn("_new", F.lit(1)), allowMissingColumns=True).groupBy("user_id", "symbol").agg(
        F.min_by("added_at", F.struct(F.coalesce("_new", F.lit(0)), "added_at")).alias("added_at")
    )


def watchlist_remove(watchlist: DataFrame, removed: DataFrame) -> DataFrame:
    gone = removed.select("user_id", F.upper(F.trim("symbol")).alias("symbol"))
    return watchlist.join(gone, ["user_id", "symbol"], "left_anti")


# -- account joins ----------------------------------------------------------------------------------------------------


def payments_with_users(payments: DataFrame, users: DataFrame) -> DataFrame:
    """Payments with the buyer's address. One busy buyer is split by Spark's skew join."""
    return payments.join(users.select("user_id", "email"), "user_id", "left").select(
        "txn", "user_id", "email", "amount_bdt", "status", "plan", "created_at"
    )


def users_with_entitlements(users: DataFrame, entitlements: DataFrame) -> DataFrame:
    return users.join(entitlements, "user_id", "left").select("user_id", "email", "name", "created_at", "premium_until")


def actions_with_users(actions: DataFrame, users: DataFrame, n: int) -> DataFrame:
    """Newest admin actions with the address of the admin."""
    j = actions.join(users.select("user_id", F.col("email").alias("admin_email")), "user_id")
    return j.orderBy(F.desc("created_at"), "id").limit(n)


def quarantine_pending(quarantine: DataFrame, newest_by: str) -> DataFrame:
    return quarantine.filter(F.col("status") == "PENDING_USER_APPROVAL").orderBy(F.desc(newest_by))
