"""Upserts as pure functions: (stored rows, incoming batch) -> (new snapshot, quarantine, counts).

One merge is a full outer join on the natural key followed by a fold per key, which reuses the partitioning of the
join. Before the shuffle a batch collapses per (key, fields the guard reads): repeated records of one key, however
many, cost one row per map task. An empty batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bourselake.functions import numbers as num
from bourselake.functions.provenance import PROMOTION_SOURCE, clean_symbol, tier_allows_overwrite, tier_of

# States of a quarantined conflict and the fields a reviewer may apply.
PENDING, APPROVED, REJECTED = "PENDING_USER_APPROVAL", "APPROVED_BY_USER", "REJECTED_BY_USER"
PRICE_FIELDS_APPLICABLE = (
    "open", "high", "low", "close", "ycp", "change", "change_percent", "volume", "value_mn", "pe", "trades", "market_cap_mn", "source",
)

STATEMENT_FIELDS_APPLICABLE = (
    "eps_basic", "eps_diluted", "nav_per_share", "roe", "dividend_yield", "paid_up_capital_mn", "authorized_capital_mn", "pe_ratio", "debt_to_equity",
    "current_ratio", "audit_status", "eps_quarterly", "pe_diluted", "pe_trailing", "quarterly_disclosure", "source", "dps", "net_income_mn",
    "reserve_surplus_mn", "oci_mn", "short_term_loan_mn", "long_term_loan_mn", "bonus_pct", "revenue_mn", "gross_profit_mn", "operating_profit_mn",
    "total_assets_mn",
)

REPLACE, COALESCE, INSERT_ONLY = "replace", "coalesce", "insert_only"
Guard = Callable[[Callable[[str], Column]], Column]


@dataclass(frozen=True)
class MergeResult:
    rows: DataFrame
    quarantine: DataFrame | None = None
    stats: DataFrame | None = None


def _best(field: str) -> Column:
    """The offer value with the highest sequence; unknown ones are passed over."""
    return F.array_max(F.transform("offers", lambda o: o[field]))


def clean_keys(batch: DataFrame, keys: list[str], null_safe: bool = False) -> DataFrame:
    """Records with a usable key: symbols upper-cased and trimmed; a null key (with ``null_safe``: a null symbol) is no record."""
    if "symbol" in keys:
        batch = batch.withColumn("symbol", F.nullif(clean_symbol(F.col("symbol")), F.lit("")))
    return batch.dropna(subset=["symbol"] if null_safe and "symbol" in keys else keys)


def record_order(seq: str | None, columns: list[str]) -> Column:
    """Which of several records of a key is the last: the highest ``seq``; where it ties or is not given, the highest hash of the record."""
    return F.struct(F.col(seq).alias("seq") if seq else F.lit(0).alias("seq"), F.xxhash64(*columns).alias("tie"))


def upsert(
    existing: DataFrame, incoming: DataFrame, keys: list[str], policy: dict[str, str], *, seq: str | None = None,
    tiered: bool = False, guard: Guard | None = None, null_safe: bool = False,
) -> DataFrame:
    """Apply a batch to stored rows.

    ``policy`` says per column what an accepted record does: ``replace`` takes its value even where unknown,
    ``coalesce`` only where known, ``insert_only`` only on a new key. Within a batch the record with the highest
    ``seq`` wins; without one, or where it ties, one whole record wins by its hash, so no two records mix. Keys are cleaned. ``guard`` says whether a stored row may be touched at all. With ``tiered`` a record of a worse
    trust tier than the stored source is left out; the fate of a record then depends on its tier alone, so a key keeps
    one folded offer per tier (at most four) and the stored source is always the one before the batch.
    """
    # the order of a record is worked out once, and columns that take the winner's value travel as one
    incoming = clean_keys(incoming, keys, null_safe).withColumn("_s", record_order(seq, list(policy)))
    filled, whole = [c for c, p in policy.items() if p == COALESCE], [c for c, p in policy.items() if p != COALESCE]
    folded = [F.max(F.when(F.col(c).isNotNull(), F.struct("_s", F.col(c).alias("v")))).alias(f"n_{c}") for c in filled]
    folded += [F.max(F.struct("_s", F.struct(*whole).alias("v"))).alias("n_whole")] if whole else []
    named = [F.col(k).alias(f"k_{k}") for k in keys]
    news = [f"n_{c}" for c in filled] + (["n_whole"] if whole else [])
    if tiered:
        per_tier = incoming.groupBy(*named, tier_of(F.col("source")).alias("tier")).agg(*folded)
        batch = per_tier.groupBy(*[f"k_{k}" for k in keys]).agg(F.collect_list(F.struct("tier", *news)).alias("offers"))
    else:
        batch = incoming.groupBy(*named).agg(*folded)
    batch = batch.withColumn("n_here", F.lit(True))
    stored = existing.select(*[F.col(c).alias(f"o_{c}") for c in existing.columns]).withColumn("o_here", F.lit(True))
    same = [F.col(f"o_{k}").eqNullSafe(F.col(f"k_{k}")) if null_safe else F.col(f"o_{k}") == F.col(f"k_{k}") for k in keys]
    joined = stored.join(batch, same, "full_outer")

    if tiered:
        trusted = F.filter("offers", lambda o: F.coalesce(o["tier"] <= tier_of(F.col("o_source")), F.lit(True)))
        joined = joined.withColumn("offers", trusted)
        joined = joined.select(
            *[c for c in joined.columns if c != "offers"], (F.coalesce(F.size("offers"), F.lit(0)) > 0).alias("_some"),
            *[_best(n).alias(n) for n in news],
        )
    else:
        joined = joined.withColumn("_some", F.col("n_here").isNotNull())
    open_row = F.lit(True) if guard is None else F.coalesce(guard(lambda c: F.col(f"o_{c}")), F.lit(False))
    joined = joined.withColumn("_ok", F.col("_some") & (F.col("o_here").isNull() | open_row))
    out = [F.when(F.col("o_here"), F.col(f"o_{k}")).otherwise(F.col(f"k_{k}")).alias(k) for k in keys]
    for c in [c for c in existing.columns if c not in keys]:
        old, p = F.col(f"o_{c}"), policy.get(c)
        if p is None:
            out.append(old.alias(c))
            continue
        new = F.col(f"n_{c}.v" if p == COALESCE else f"n_whole.v.{c}")
        take = F.col("_ok") & F.col("o_here").isNull() if p == INSERT_ONLY else F.col("_ok")
        out.append(F.when(take, F.coalesce(new, old) if p == COALESCE else new).otherwise(old).alias(c))
    return joined.filter(F.col("o_here") | F.col("_ok")).select(*out)


def quarantine_conflicts(existing: DataFrame, incoming: DataFrame, keys: list[str], field: str, table: str) -> DataFrame:
    """One row per incoming record that its tier keeps out although its value differs; the key stays typed."""
    old = existing.select(*keys, F.col(field).alias("existing_value"), F.col("source").alias("existing_source"))
    new = incoming.select(*keys, F.col(field).alias("incoming_value"), F.col("source").alias("incoming_source"))
    both = new.join(old, keys)
    blocked = ~tier_allows_overwrite(F.col("existing_source"), F.col("incoming_source"))
    return both.filter(blocked & num.value_changed(F.col("existing_value"), F.col("incoming_value"))).select(
        F.lit(table).alias("target_table"), *keys, F.lit(field).alias("field_name"), "existing_value", "incoming_value",
        "existing_source", "incoming_source", F.lit(PENDING).alias("status"),
    )


def merge_stats(existing: DataFrame, incoming: DataFrame, keys: list[str], field: str) -> DataFrame:
    """Records written, kept out by tier, and kept out with a different value."""
    old = existing.select(*keys, F.col(field).alias("ov"), F.col("source").alias("os"))
    both = incoming.select(*keys, F.col(field).alias("nv"), F.col("source").alias("ns")).join(old, keys, "left")
    ok = tier_allows_overwrite(F.col("os"), F.col("ns"))
    return both.agg(
        F.count_if(ok).alias("upserted"), F.count_if(~ok).alias("blocked"),
        F.count_if(~ok & num.value_changed(F.col("ov"), F.col("nv"))).alias("quarantined"),
    )


def _guarded(existing, incoming, keys, policy, field, table, seq) -> MergeResult:
    incoming = clean_keys(incoming, keys)
    rows = upsert(existing, incoming, keys, policy, seq=seq, tiered=True)
    return MergeResult(rows, quarantine_conflicts(existing, incoming, keys, field, table), merge_stats(existing, incoming, keys, field))


def upsert_prices(existing: DataFrame, incoming: DataFrame, *, seq: str | None = None) -> MergeResult:
    """Close and source are replaced, every other known value fills in; unusable closes never enter."""
    batch = incoming.filter(F.col("close") > 0).withColumn("source", F.coalesce("source", F.lit("DSE_SCRAPE")))
    fill = ["open", "high", "low", "ycp", "change", "change_percent", "volume", "value_mn", "trades", "market_cap_mn"]
    policy = {"close": REPLACE, "source": REPLACE} | {c: COALESCE for c in fill if c in incoming.columns}
    return _guarded(existing, batch, ["symbol", "date"], policy, "close", "price_history", seq)


def upsert_daily_close(existing: DataFrame, incoming: DataFrame, *, seq: str | None = None, digits: int | None = 2) -> MergeResult:
    """End-of-day settlement: change is derived where not given; high, low and value only fill in."""
    close, ycp = F.col("close"), F.col("ycp")
    batch = (
        incoming.filter(close > 0)
        .withColumn("change_percent", num.change_pct(close, ycp, F.col("change_percent"), digits))
        .withColumn("change", num.change_abs(close, ycp, F.col("change"), digits))
    )
    policy = {c: REPLACE for c in ("close", "ycp", "change", "change_percent", "volume", "pe")}
    policy |= {c: COALESCE for c in ("high", "low", "value_mn", "source")}
    return _guarded(existing, batch, ["symbol", "date"], policy, "close", "price_history", seq)


def upsert_symbol_history(existing: DataFrame, incoming: DataFrame, *, seq: str | None = None) -> MergeResult:
    """Full overwrite, unknown values included; only an unknown source keeps the stored one."""
    cols = ("open", "high", "low", "close", "ycp", "change", "change_percent", "volume", "value_mn", "pe")
    policy = {c: REPLACE for c in cols} | {"source": COALESCE}
    return _guarded(existing, incoming.filter(F.col("close") > 0), ["symbol", "date"], policy, "close", "price_history", seq)


def upsert_index(existing: DataFrame, incoming: DataFrame, *, seq: str | None = None) -> MergeResult:
    """Index level and source replaced, breadth filled in, trade count kept from the first write."""
    batch = incoming.filter(F.col("index_value") > 0).withColumn("source", F.coalesce("source", F.lit("DSE_OFFICIAL_GRAPH")))
    fill = ("advancing", "declining", "unchanged", "total_volume", "total_value_mn")
    policy = {"index_value": REPLACE, "source": REPLACE, "total_trades": INSERT_ONLY} | {c: COALESCE for c in fill}
    return _guarded(existing, batch, ["date"], policy, "index_value", "index_history", seq)


def upsert_index_close(existing: DataFrame, incoming: DataFrame, *, seq: str | None = None) -> MergeResult:
    """Settlement of one day: level and breadth replaced, unknown values included."""
    cols = ("index_value", "advancing", "declining", "unchanged", "total_trades", "total_volume", "total_value_mn")
    policy = {c: REPLACE for c in cols} | {"source": COALESCE}
    return _guarded(existing, incoming.filter(F.col("index_value") > 0), ["date"], policy, "index_value", "index_history", seq)


def upsert_ds30(existing: DataFrame, incoming: DataFrame, *, seq: str | None = None) -> MergeResult:
    batch = incoming.filter(F.col("ds30_index") > 0).withColumn("source", F.coalesce("source", F.lit("DSE_OFFICIAL_GRAPH")))
    policy = {"ds30_index": REPLACE, "prev_close": COALESCE, "source": COALESCE}
    return _guarded(existing, batch, ["date"], policy, "ds30_index", "ds30_history", seq)


def upsert_block_trades(existing: DataFrame, incoming: DataFrame, *, seq: str | None = None) -> MergeResult:
    batch = incoming.withColumn("source", F.coalesce("source", F.lit("LANKABD")))
    policy = {c: COALESCE for c in ("trades", "quantity", "value_mn", "min_price", "max_price")} | {"source": REPLACE}
    return _guarded(existing, batch, ["symbol", "date"], policy, "quantity", "block_trades", seq)


def upsert_ratings(existing: DataFrame, incoming: DataFrame, *, seq: str | None = None) -> DataFrame:
    batch = incoming.filter(F.col("rating_date").isNotNull())
    for c, default in {"rating_agency": "CRISL", "outlook": "Stable", "rating_action": "Surveillance", "source": "DSE_OFFICIAL"}.items():
        batch = batch.withColumn(c, F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default)))
    policy = {c: REPLACE for c in ("long_term_rating", "short_term_rating", "outlook", "valid_until", "rating_action", "source")}
    return upsert(existing, batch, ["symbol", "rating_date", "rating_agency"], policy, seq=seq)


def upsert_lockins(existing: DataFrame, incoming: DataFrame, *, seq: str | None = None) -> DataFrame:
    batch = incoming.filter(F.col("release_date").isNotNull())
    batch = batch.withColumn("lockin_category", F.coalesce(F.nullif(F.col("lockin_category"), F.lit("")), F.lit("Sponsor/Director")))
    return upsert(existing, batch, ["symbol", "lockin_category", "release_date"], {"quantity": REPLACE, "source": REPLACE}, seq=seq)


def upsert_shareholding(existing: DataFrame, incoming: DataFrame, *, seq: str | None = None) -> DataFrame:
    policy = {c: REPLACE for c in existing.columns if c != "symbol"}
    return upsert(existing, incoming, ["symbol"], policy, seq=seq)


def upsert_corporate_actions(existing: DataFrame, incoming: DataFrame, *, seq: str | None = None) -> DataFrame:
    """Cash amount and year are part of the key and compare null-safe, so bonus-only events are not repeated."""
    keys = ["symbol", "event_type", "event_date", "fiscal_year", "cash_dps"]
    batch = incoming.withColumn("event_type", F.upper(F.trim("event_type")))
    policy = {c: REPLACE for c in ("record_date", "agm_date", "bonus_pct", "source")}
    return upsert(existing, batch, keys, policy, seq=seq, null_safe=True)


# -- statements -------------------------------------------------------------------------------------------------------

BALANCE_SHEET = ("reserve_surplus_mn", "oci_mn", "short_term_loan_mn", "long_term_loan_mn")


def _open_to_audit(*fields: str) -> Guard:
    """A stored row accepts a write unless it is audited, not from promotion, and complete in ``fields``."""

    def guard(old) -> Column:
        settled = old("audit_status").eqNullSafe(F.lit("Audited")) & ~old("source").eqNullSafe(F.lit(PROMOTION_SOURCE))
        for f in fields:
            settled = settled & old(f).isNotNull()
        return ~settled

    return guard


def upsert_fundamentals_audited(existing: DataFrame, incoming: DataFrame, *, seq: str | None = None) -> DataFrame:
    batch = incoming.withColumn("audit_status", F.lit("Audited")).withColumn("source", F.coalesce("source", F.lit("DSE_OFFICIAL")))
    batch = batch.withColumn("period", F.coalesce("period", F.lit("Annual")))
    replaced = (
        "period", "eps_basic", "nav_per_share", "roe", "dividend_yield", "dps", "pe_ratio", "debt_to_equity", "current_ratio",
        "paid_up_capital_mn", "audit_status", "source",
    )
    filled = ("eps_diluted", "authorized_capital_mn", "net_income_mn", *BALANCE_SHEET, "bonus_pct")
    policy = {c: REPLACE for c in replaced if c in existing.columns} | {c: COALESCE for c in filled}
    guard = _open_to_audit("net_income_mn", "reserve_surplus_mn", "short_term_loan_mn", "long_term_loan_mn")
    return upsert(existing, batch, ["symbol", "fiscal_year"], policy, seq=seq, guard=guard)


def upsert_statements_strict(existing: DataFrame, incoming: DataFrame, *, seq: str | None = None) -> DataFrame:
    """The strict route: a stored audited row is never touched."""
    cols = (
        "period", "eps_basic", "nav_per_share", "roe", "dividend_yield", "dps", "pe_ratio", "debt_to_equity", "current_ratio",
        "paid_up_capital_mn", "audit_status", "source",
    )
    guard = lambda old: ~old("audit_status").eqNullSafe(F.lit("Audited"))
    return upsert(existing, incoming, ["symbol", "fiscal_year"], {c: REPLACE for c in cols if c in existing.columns}, seq=seq, guard=guard)


def upsert_statement_lines(existing: DataFrame, incoming: DataFrame, *, seq: str | None = None) -> DataFrame:
    """Line items of filed reports: they only fill in."""
    cols = (
        "period", "eps_basic", "eps_diluted", "nav_per_share", "roe", "paid_up_capital_mn", "net_income_mn", *BALANCE_SHEET, "revenue_mn",
        "gross_profit_mn", "operating_profit_mn", "total_assets_mn", "total_liabilities_mn", "current_assets_mn", "current_liabilities_mn",
        "capex_mn", "operating_cash_flow_mn", "free_cash_flow_mn",
    )
    batch = incoming.withColumn("audit_status", F.lit("Audited"))
    batch = batch.withColumn("source", F.lit("PDF_AUDITED_ANNUAL_REPORT"))
    policy = {c: COALESCE for c in cols if c in existing.columns} | {"audit_status": REPLACE, "source": REPLACE}
    guard = _open_to_audit("revenue_mn", "total_assets_mn", "total_liabilities_mn")
    return upsert(existing, batch, ["symbol", "fiscal_year"], policy, seq=seq, guard=guard)


def roster_balance_sheet(roster: DataFrame, statements: DataFrame) -> DataFrame:
    """Newest known balance-sheet values of a payload copied onto the roster; unknown ones keep the stored value."""
    newest = statements.groupBy("symbol").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("fiscal_year"))).alias(f"n_{c}") for c in BALANCE_SHEET]
    )
    out = roster.join(newest, "symbol", "left")
    stored = [F.col(c) if c in roster.columns else F.lit(None).cast("double") for c in BALANCE_SHEET]
    keep = [c for c in roster.columns if c not in BALANCE_SHEET]
    return out.select(*keep, *[F.coalesce(F.col(f"n_{c}"), s).alias(c) for c, s in zip(BALANCE_SHEET, stored)])


DELTA_FIELDS = (
    "eps_basic", "nav_per_share", "paid_up_capital_mn", "period", "debt_to_equity", "current_ratio", "net_income_mn", *BALANCE_SHEET,
)


def fundamentals_changes(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming statements worth writing: new years, and changed years that are not audited yet."""
    old = existing.select("symbol", "fiscal_year", F.lit(True).alias("_here"), F.col("audit_status").alias("_status"), *[F.col(c).alias(f"_o_{c}") for c in DELTA_FIELDS])
    j = incoming.join(old, ["symbol", "fiscal_year"], "left")
    differs = F.lit(False)
    for c in DELTA_FIELDS:
        differs = differs | num.value_changed(F.col(f"_o_{c}"), F.col(c))
    wanted = F.col("_here").isNull() | (~F.col("_status").eqNullSafe(F.lit("Audited")) & differs)
    return j.filter(wanted).select(*incoming.columns)


def fundamentals_delta(existing: DataFrame, incoming: DataFrame) -> MergeResult:
    """Write only what changed, as provisional rows; counts say how much did."""
    changed = fundamentals_changes(existing, incoming)
    replaced = (
        "period", "eps_basic", "eps_diluted", "nav_per_share", "pe_ratio", "dividend_yield", "debt_to_equity", "current_ratio",
        "quarterly_disclosure", "source",
    )
    filled = ("paid_up_capital_mn", "authorized_capital_mn", "dps", "net_income_mn", *BALANCE_SHEET, "bonus_pct")
    policy = {c: REPLACE for c in replaced if c in existing.columns} | {c: COALESCE for c in filled}
    batch = changed.withColumn("source", F.coalesce("source", F.lit("DSE_OFFICIAL"))).withColumn("audit_status", F.lit("Provisional"))
    guard = _open_to_audit("net_income_mn", "reserve_surplus_mn", "short_term_loan_mn", "long_term_loan_mn")
    rows = upsert(existing, batch, ["symbol", "fiscal_year"], policy | {"audit_status": INSERT_ONLY}, guard=guard)
    flagged = incoming.select("symbol", "fiscal_year").join(changed.select("symbol", "fiscal_year", F.lit(1).alias("c")), ["symbol", "fiscal_year"], "left")
    stats = flagged.agg(
        F.count(F.lit(1)).alias("total"), F.count("c").alias("changed"), (F.count(F.lit(1)) - F.count("c")).alias("unchanged")
    )
    return MergeResult(rows, None, stats)


# -- roster -----------------------------------------------------------------------------------------------------------

ROSTER_DETAILS = ("name", "sector", "category", "face_value", "total_shares")
#: Further details a payload may fill in, and what it replaces.
ROSTER_FILLED, ROSTER_REPLACED = (*ROSTER_DETAILS, "listing_date", "market_cap_mn"), ("source", "fetched_at")


def upsert_roster(existing: DataFrame, incoming: DataFrame, *, as_of, seq: str | None = None) -> DataFrame:
    """A complete roster payload: fill in details, note category changes and new listings, soft-delist what is gone.

    The result has all stored columns and the lifecycle ones (prev_category, category_changed_at, is_new_listing, first_seen,
    delisted_date), which keep their stored values unless this payload changes them. Of several records of a symbol the
    last known value wins. An empty payload is no instruction to delist everything; it returns the stored roster unchanged.
    """
    if incoming.isEmpty():
        return existing
    today = F.lit(as_of).cast("date")
    batch = clean_keys(incoming, ["symbol"])
    offered = [c for c in existing.columns if c in batch.columns and c != "symbol"]
    order = record_order(seq, offered)
    known = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(order.alias("s"), F.col(c).alias("v"))))
    new = batch.groupBy("symbol").agg(*[known(c).alias(f"n_{c}") for c in offered]).withColumn("n_here", F.lit(True))
    j = existing.withColumn("o_here", F.lit(True)).join(new, "symbol", "full_outer")
    here, stored = F.col("n_here").isNotNull(), F.col("o_here").isNotNull()
    value = lambda c: F.col(f"n_{c}.v") if c in offered else F.lit(None)
    old = lambda c, kind: F.col(c) if c in existing.columns else F.lit(None).cast(kind)
    moved = F.coalesce(here & stored & value("category").isNotNull() & (value("category") != F.col("category")), F.lit(False))
    gone = stored & ~here & (F.col("trading_status") == "Active")
    out = {}
    for c in existing.columns:
        if c in ROSTER_FILLED:
            out[c] = F.coalesce(value(c), F.col(c))
        elif c in ROSTER_REPLACED and c in offered:
            out[c] = F.when(here, value(c)).otherwise(F.col(c))
        else:
            out[c] = F.when(stored | F.lit(c == "symbol"), F.col(c)).otherwise(value(c))
    out["is_active"] = F.when(here, True).when(gone, False).otherwise(F.col("is_active"))
    out["trading_status"] = F.when(here, "Active").when(gone, "Delisted").otherwise(F.col("trading_status"))
    out["prev_category"] = F.when(moved, F.col("category")).otherwise(old("prev_category", "string"))
    out["category_changed_at"] = F.when(moved, today).otherwise(old("category_changed_at", "date"))
    out["is_new_listing"] = F.when(~stored, True).otherwise(F.coalesce(old("is_new_listing", "boolean"), F.lit(False)))
    out["first_seen"] = F.when(~stored, today).otherwise(old("first_seen", "date"))
    out["delisted_date"] = F.when(gone, today).otherwise(old("delisted_date", "date"))
    return j.select(*[v.alias(c) for c, v in out.items()])


def prune_orphans(
    stored: DataFrame, payload: DataFrame, keys: list[str], owned: tuple[str, ...] = (PROMOTION_SOURCE,), scope: list[str] | None = None
) -> DataFrame:
    """Drop rows of owned sources that a payload no longer has; an empty payload drops nothing.

    With ``scope`` (some of the keys) the payload is complete only inside the scopes it has rows of, and nothing else is dropped.
    """
    mine = F.coalesce(F.col("source").isin(*owned), F.lit(False))
    if scope is None:
        if payload.isEmpty():
            return stored
        kept = stored.filter(mine).join(payload.select(*keys).distinct(), keys, "left_semi")
        return stored.filter(~mine).unionByName(kept)
    j = stored.join(payload.select(*keys).distinct().withColumn("_here", F.lit(True)), keys, "left")
    j = j.join(payload.select(*scope).distinct().withColumn("_in", F.lit(True)), scope, "left")
    return j.filter(~mine | F.col("_here").isNotNull() | F.col("_in").isNull()).select(*stored.columns)


def roster_activity_refresh(roster: DataFrame, prices: DataFrame, details: DataFrame, *, as_of, days: int = 30) -> DataFrame:
    """Active means traded within ``days``; new details fill in unless they fail the roster gate as a whole."""
    traded = prices.filter(F.col("date") >= F.date_sub(F.lit(as_of).cast("date"), days)).select("symbol").distinct().withColumn("t", F.lit(True))
    valid = (F.coalesce(F.col("face_value") > 0, F.lit(True))) & (F.coalesce(F.col("total_shares") > 0, F.lit(True)))
    d = details.filter(valid).select("symbol", *[F.col(c).alias(f"n_{c}") for c in ROSTER_DETAILS])
    j = roster.join(traded, "symbol", "full_outer").join(d, "symbol", "left")
    live = F.col("t").isNotNull()
    fresh = {c: F.when(live, F.coalesce(F.col(f"n_{c}"), F.col(c))).otherwise(F.col(c)) for c in ROSTER_DETAILS} | {"is_active": live}
    return j.select(*[fresh.get(c, F.col(c)).alias(c) for c in dict.fromkeys([*roster.columns, "is_active"])])


def index_membership_changes(old: DataFrame, new: DataFrame, *, as_of) -> DataFrame:
    """Blue-chip membership before and after, with the day a symbol was added or removed."""
    a = old.select("symbol", F.col("ds30").alias("previous"))
    b = new.select("symbol", F.col("ds30").alias("current"))
    j = a.join(b, "symbol", "full_outer")
    was, now = F.coalesce("previous", F.lit(False)), F.coalesce("current", F.lit(False))
    today = F.lit(as_of).cast("date")
    return j.filter(was != now).select(
        "symbol", was.alias("previous"), now.alias("current"), F.when(now, today).alias("added_date"), F.when(was, today).alias("removed_date")
    )


# -- quarantine, tiers, promotion, live -------------------------------------------------------------------------------


def resolve_quarantine(
    stored: DataFrame, conflicts: DataFrame, decisions: DataFrame, *, table: str = "price_history", keys: tuple[str, ...] = ("symbol", "date"),
    fields: tuple[str, ...] = PRICE_FIELDS_APPLICABLE,
) -> MergeResult:
    """Apply reviewed conflicts: each accepted field takes the incoming value, and the row the incoming source.

    ``conflicts`` carries ``id``; ``decisions`` is (id, resolution, note). Only conflicts of ``table`` on allow-listed fields
    apply; of several accepted ones on a field, and for the source, the highest id wins. For statements pass
    ``fundamentals_history``, (symbol, fiscal_year) and STATEMENT_FIELDS_APPLICABLE.
    """
    c = conflicts.join(decisions, "id", "left")
    decided, accepted = F.col("resolution").isNotNull(), F.col("resolution") == "ACCEPT_INCOMING"
    status = F.when(~decided, F.col("status")).when(accepted, APPROVED).otherwise(REJECTED)
    log = c.withColumn("status", status).withColumnRenamed("note", "notes").drop("resolution")
    usable = c.filter(accepted & F.col("field_name").isin(*fields) & (F.col("target_table") == table))
    taken = [f for f in fields if f in stored.columns and f != "source"]
    of_field = lambda f: F.max(F.when(F.col("field_name") == f, F.struct("id", F.col("incoming_value").alias("v"))))
    tag = F.coalesce("incoming_source", F.lit("USER_APPROVED_OVERRIDE"))
    values = usable.groupBy(*keys).agg(F.max(F.struct("id", tag.alias("v"))).alias("_source"), *[of_field(f).alias(f"_{f}") for f in taken])
    j = stored.join(values, list(keys), "left")
    fresh = {f: F.when(F.col(f"_{f}").isNotNull(), F.col(f"_{f}.v").cast(stored.schema[f].dataType)).otherwise(F.col(f)) for f in taken}
    fresh["source"] = F.coalesce("_source.v", "source")
    return MergeResult(j.select(*[fresh.get(x, F.col(x)).alias(x) for x in stored.columns]), log, None)


def upgrade_by_tier(existing: DataFrame, official: DataFrame, *, tolerance: float = 0.05, source: str = "DSE_OFFICIAL_GRAPH") -> MergeResult:
    """Official index values replace missing days and days of unapproved sources; top-tier days are compared, never overwritten.

    A replaced day keeps its other stored columns, a new day takes those that ``official`` has. The replacements pass the index gate as one batch: a single value outside 500 to 20000 blocks all of them and the
    stored rows stay as they are. One row per calendar day makes that check cheap.
    """
    extra = [c for c in existing.columns if c not in ("date", "index_value", "source")]
    o = official.select("date", F.col("index_value").alias("live"), *[F.col(c).alias(f"_{c}") for c in extra if c in official.columns])
    j = existing.withColumnRenamed("index_value", "stored").withColumn("_stored", F.lit(True)).join(o, "date", "full_outer")
    untrusted = F.col("source").isNotNull() & tier_of(F.col("source")).isNull()
    take = F.col("live").isNotNull() & (F.col("stored").isNull() | untrusted)
    if not j.filter(take & ~F.col("live").between(500, 20000)).isEmpty():
        rows = existing
    else:
        fresh = {"index_value": F.when(take, F.col("live")).otherwise(F.col("stored")), "source": F.when(take, F.lit(source)).otherwise(F.col("source"))}
        fresh |= {c: F.when(F.col("_stored").isNull(), F.col(f"_{c}")).otherwise(F.col(c)) for c in extra if c in official.columns}
        rows = j.select(*[fresh.get(c, F.col(c)).alias(c) for c in existing.columns])
    top = F.coalesce(tier_of(F.col("source")) == 1, F.lit(False))
    off = F.abs(F.col("stored") - F.col("live")) > tolerance
    compared = j.filter(top & F.col("live").isNotNull())
    mismatches = compared.filter(off).select("date", "stored", "live", "source")
    stats = compared.agg(F.count_if(~off).alias("confirmed"), F.count_if(off).alias("mismatched"))
    return MergeResult(rows, mismatches, stats)


def promote_prices(main: DataFrame, staged: DataFrame) -> DataFrame:
    """Promotion of audited staging prices: the full payload overwrites, tagged with the promotion source."""
    payload = staged.withColumn("source", F.lit(PROMOTION_SOURCE)).withColumn("pe", F.lit(None).cast("double"))
    return prune_orphans(upsert_symbol_history(main, payload).rows, clean_keys(payload, ["symbol", "date"]), ["symbol", "date"], scope=["symbol"])


#: The tables that a promotion covers.
PROMOTED = ("prices", "index", "fundamentals", "roster", "shareholding")


def promote(main: dict[str, DataFrame], staged: dict[str, DataFrame], gate: DataFrame, *, as_of) -> dict[str, DataFrame]:
    """Promote staging to main when the audit gate shows no errors; otherwise, or when nothing was audited, main stays as it is.

    ``gate`` is the one-row-per-entity summary of the full staging audit; reading its error total is the only action.
    """
    if gate.agg(F.sum("errors")).first()[0] != 0:
        return main
    tag = lambda df: df.withColumn("source", F.lit(PROMOTION_SOURCE))
    return {
        "prices": promote_prices(main["prices"], staged["prices"]),
        "index": prune_orphans(upsert_index_close(main["index"], tag(staged["index"])).rows, tag(staged["index"]), ["date"]),
        "fundamentals": upsert_statements_strict(main["fundamentals"], tag(staged["fundamentals"]).withColumn("audit_status", F.lit("Audited"))),
        "roster": upsert_roster(main["roster"], staged["roster"], as_of=as_of),
        "shareholding": upsert_shareholding(main["shareholding"], staged["shareholding"]),
    }


def overlay_live(base: DataFrame, live: DataFrame, *, band_pct: float = 25.0, digits: int | None = 2) -> DataFrame:
    """Latest ticks over the stored screen.

    ``base``: symbol, ltp, ycp, change, change_percent, eps, daily_pe. ``live``: symbol, ltp, ycp, change, change_percent.
    """
    t = live.select("symbol", *[F.col(c).alias(f"l_{c}") for c in ("ltp", "ycp", "change", "change_percent")])
    return overlay_rules(base.join(t, "symbol", "left"), base.columns, band_pct=band_pct, digits=digits)


def overlay_rules(joined: DataFrame, base_columns: list[str], *, band_pct: float = 25.0, digits: int | None = 2) -> DataFrame:
    """Stored row and tick (``l_`` columns) side by side to one row; works on a stream as well.

    An unknown previous close is worked out from the tick's own change, else taken from the base, else left unknown.
    A change outside the band is rebuilt from the tick's own change, and dropped where the tick has none.
    """
    own = F.col("l_change")
    back = num.rounded(F.col("l_ltp") - own, digits)
    j = joined.withColumns({"_has": F.coalesce(F.col("l_ltp") != 0, F.lit(False)), "_back": back})
    j = j.withColumn("_ycp", F.coalesce("l_ycp", "_back", "ycp"))
    j = j.withColumn("_chg", F.coalesce(own, num.rounded(F.col("l_ltp") - F.col("_ycp"), digits)))
    pct = F.when(own.isNotNull() | F.col("_ycp").isNull(), F.col("l_change_percent")).otherwise(
        F.when(F.col("_ycp") > 0, num.rounded(F.col("_chg") / F.col("_ycp") * 100.0, digits))
    )
    j = j.withColumn("_pct", pct).withColumn("_wild", F.coalesce(F.abs(F.col("_pct")) > band_pct, F.lit(False)))
    fixed = lambda kept, ok: F.when(F.col("_wild"), kept).otherwise(ok)
    new = {
        "ltp": F.col("l_ltp"),
        "ycp": fixed(F.col("_back"), F.col("_ycp")),
        "change": fixed(own, F.col("_chg")),
        "change_percent": fixed(F.when(own.isNotNull(), F.col("l_change_percent")), F.col("_pct")),
        "daily_pe": F.when(F.col("eps") > 0, num.rounded(F.col("l_ltp") / F.col("eps"), digits)).otherwise(F.col("daily_pe")),
    }
    kept = [c for c in base_columns if c not in new]
    return j.select(*kept, *[F.when(F.col("_has"), v).otherwise(F.col(c)).alias(c) for c, v in new.items()], F.col("_has").alias("is_live"))
