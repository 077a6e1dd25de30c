"""Invariants of upserts, and access rules against plain loops."""

import datetime as dt
import random
from types import SimpleNamespace

from pyspark.sql import functions as F

from bourselake.operators import access, merge
from bourselake.plans import catalog
from bourselake.plans.marts import Marts

D = dt.date(2026, 8, 20)
SCHEMA = "symbol string, date date, open double, high double, low double, close double, ycp double, change double, change_percent double, volume long, value_mn double, trades long, market_cap_mn double, source string, seq int"


def px(spark, *rows):
    full = [(s, D, None, hi, None, c, None, None, None, vol, None, None, None, src, seq) for s, hi, c, vol, src, seq in rows]
    return spark.createDataFrame(full, SCHEMA)


def as_set(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


def test_tiers_order_and_quarantine(spark):
    old = px(spark, ("A", 9.0, 8.0, 5, "DSE_SCRAPE", 0), ("B", 9.0, 8.0, 5, "LANKABD", 0), ("C", 9.0, 8.0, 5, "MADE_UP", 0)).drop("seq")
    new = px(
        spark, ("A", 1.0, 7.0, 1, "LANKABD", 1), ("B", None, 7.0, None, "DSE_SCRAPE", 1), ("B", 6.0, 7.5, None, "LANKABD", 2), ("C", None, 7.0, 2, "LANKABD", 1),
        ("N", None, 3.0, 2, None, 1), ("Z", None, 0.0, 2, "DSE_SCRAPE", 1),
    )
    out = merge.upsert_prices(old, new, seq="seq")
    r = {x.symbol: x for x in out.rows.collect()}
    assert (r["A"].close, r["A"].source) == (8.0, "DSE_SCRAPE")  # a worse tier never gets in
    assert (r["B"].close, r["B"].high, r["B"].volume, r["B"].source) == (7.5, 6.0, 5, "LANKABD")  # later record wins, unknown volume keeps the old one
    assert r["C"].close == 7.0 and r["N"].source == "DSE_SCRAPE" and "Z" not in r
    q = out.quarantine.collect()
    assert [(x.symbol, x.existing_value, x.incoming_value, x.status) for x in q] == [("A", 8.0, 7.0, "PENDING_USER_APPROVAL")]
    s = out.stats.first()
    assert (s.upserted, s.blocked, s.quarantined) == (4, 1, 1)


def test_upsert_is_idempotent_and_empty_is_a_no_op(spark, sf_dir):
    m = Marts(spark, sf_dir)
    once = merge.upsert_prices(m.prices_existing, m.prices_incoming, seq="seq").rows
    twice = merge.upsert_prices(once, m.prices_incoming, seq="seq").rows
    assert as_set(once) == as_set(twice)
    nothing = merge.upsert_prices(m.prices_existing, m.prices_incoming.limit(0), seq="seq").rows
    assert as_set(nothing) == as_set(m.prices_existing.select(nothing.columns))
    assert merge.upsert_roster(m.roster, m.roster.limit(0), as_of=D) is m.roster
    assert merge.prune_orphans(m.fundamentals, m.fundamentals.limit(0), ["symbol", "fiscal_year"]) is m.fundamentals


def test_promotion_needs_a_clean_gate(spark, sf_dir):
    from pyspark.sql import functions as F

    m = Marts(spark, sf_dir)
    main = {"prices": m.prices, "index": m.index, "fundamentals": m.statements, "roster": m.roster, "shareholding": m.shareholding}
    staged = dict(main, prices=m.prices.filter(F.col("key") % 2 == 0))
    gate = lambda n: spark.createDataFrame([("prices", n)], "entity string, errors long")
    assert merge.promote(main, staged, gate(1), as_of=D) is main
    out = merge.promote(main, staged, gate(0), as_of=D)
    assert set(out) == set(main)
    promoted = out["prices"].filter("source = 'STAGING_DB'")
    assert promoted.count() == staged["prices"].count() and out["index"].filter("source <> 'STAGING_DB'").count() == 0


def test_corporate_actions_do_not_repeat_bonus_only_events(spark):
    schema = "symbol string, event_type string, event_date date, record_date date, agm_date date, cash_dps double, bonus_pct double, fiscal_year int, source string"
    rows = [("A", "DIVIDEND", D, None, None, None, 5.0, 2025, "LANKABD"), ("A", "DIVIDEND", D, None, None, 2.0, None, 2025, "LANKABD")]
    df = spark.createDataFrame(rows, schema)
    again = merge.upsert_corporate_actions(df, df)
    assert again.count() == 2


def test_entitlement_fold_against_a_loop(spark):
    rnd = random.Random(7)
    t0 = dt.datetime(2026, 1, 1)
    rows = [(rnd.choice([1, 1, 1, 2, 3]), t0 + dt.timedelta(seconds=rnd.randrange(90 * 86400) // 3600 * 3600), rnd.choice([7.0, 30.0, 0.25])) for _ in range(400)]
    want = {}
    for u, t, d in sorted(rows, key=lambda r: r[1]):
        want[u] = max(want.get(u, t), t) + dt.timedelta(days=d)
    got = access.entitlement_fold(spark.createDataFrame(rows, "user_id int, granted_at timestamp, days double")).collect()
    assert {r.user_id: r.premium_until for r in got} == want


def test_stacking_rules(spark):
    now = dt.datetime(2026, 8, 23)

    def until(*grants):
        df = spark.createDataFrame([(1, t, d) for t, d in grants], "user_id int, granted_at timestamp, days double")
        return access.entitlement_fold(df).first().premium_until

    assert until((now, 7.0)) == now + dt.timedelta(days=7)
    assert until((now - dt.timedelta(days=60), 30.0), (now, 30.0)) == now + dt.timedelta(days=30)  # lapsed
    assert until((now - dt.timedelta(days=10), 30.0), (now, 30.0)) == now + dt.timedelta(days=50)  # stacks
    assert until((now, 6 / 24)) == now + dt.timedelta(hours=6)


def test_promo_reasons(spark):
    promos = spark.createDataFrame([("PULSE24", 1, None, True), ("DEAD", 1, 0, False), ("BROKEN", 0, 0, True), ("FLASH6", 0, 6, True)], "code string, bonus_days int, bonus_hours int, active boolean")
    tries = spark.createDataFrame([(1, " pulse24 "), (2, "PULSE24"), (1, "DEAD"), (1, "NONE"), (1, "BROKEN"), (1, "FLASH6")], "user_id int, code string")
    done = spark.createDataFrame([(2, "PULSE24")], "user_id int, code string")
    got = {(r.user_id, r.code.strip().upper()): (r.ok, r.reason) for r in access.validate_promo(tries, promos, done).collect()}
    assert got[1, "PULSE24"] == (True, None) and got[1, "FLASH6"] == (True, None)
    assert got[2, "PULSE24"][1] == access.REFUSED_REPEAT and got[1, "BROKEN"][1] == access.REFUSED_EMPTY
    assert got[1, "DEAD"][1] == got[1, "NONE"][1] == access.REFUSED_INACTIVE


def test_free_window(spark):
    from bourselake.functions.plans import FREE_WINDOW_DAYS, PLAN_DAYS, PLAN_PRICES

    cutoff = D - dt.timedelta(days=FREE_WINDOW_DAYS)
    df = spark.createDataFrame([(cutoff - dt.timedelta(days=1),), (cutoff,), (D,)], "date date")
    assert access.free_window_filter(df, as_of=D).count() == 2 and access.free_window_filter(df, as_of=D, entitled=True).count() == 3
    assert (PLAN_PRICES["WEEKLY"], PLAN_DAYS["HALF_YEARLY"], len(PLAN_PRICES)) == (100, 180, 4)


def test_tier_upgrade_is_all_or_nothing(spark):
    old = spark.createDataFrame([(D, 5000.0, "MCAP_WEIGHTED_ESTIMATE")], "date date, index_value double, source string")
    day = D + dt.timedelta(days=1)
    live = lambda *v: spark.createDataFrame(list(zip((D, day), v)), "date date, index_value double")
    ok = {r.date: (r.index_value, r.source) for r in merge.upgrade_by_tier(old, live(5001.0, 5002.0)).rows.collect()}
    assert ok == {D: (5001.0, "DSE_OFFICIAL_GRAPH"), day: (5002.0, "DSE_OFFICIAL_GRAPH")}
    assert [tuple(r) for r in merge.upgrade_by_tier(old, live(5001.0, 99999.0)).rows.collect()] == [(D, 5000.0, "MCAP_WEIGHTED_ESTIMATE")]


def test_records_without_sequence_do_not_mix(spark):
    with_pe = lambda df: df.withColumn("pe", F.lit(None).cast("double"))
    old = with_pe(px(spark).drop("seq"))
    new = with_pe(px(spark, ("A", None, 10.0, 100, "DSE_SCRAPE", 1), ("A", None, 9.0, 200, "DSE_SCRAPE", 1)))
    for seq in (None, "seq"):
        (r,) = merge.upsert_symbol_history(old, new, seq=seq).rows.collect()
        assert (r.close, r.volume) in {(10.0, 100), (9.0, 200)}
    assert as_set(merge.upsert_symbol_history(old, new).rows) == as_set(merge.upsert_symbol_history(old, new.orderBy("close")).rows)


def test_keys_are_cleaned(spark):
    old = px(spark, ("A", None, 8.0, 1, "LANKABD", 0)).drop("seq")
    new = px(spark, (" a ", None, 9.0, 2, "DSE_SCRAPE", 1), (None, None, 9.0, 2, "DSE_SCRAPE", 1), ("  ", None, 9.0, 2, "DSE_SCRAPE", 1))
    undated = spark.createDataFrame([("B", None, *[None] * 3, 5.0, *[None] * 7, "DSE_SCRAPE", 1)], SCHEMA)
    out = merge.upsert_prices(old, new.unionByName(undated), seq="seq")
    assert [(r.symbol, r.close) for r in out.rows.collect()] == [("A", 9.0)]
    assert as_set(merge.upsert_prices(out.rows, new.unionByName(undated), seq="seq").rows) == as_set(out.rows)
    assert out.stats.first().upserted == 1


def test_roster_history_survives_the_next_run(spark):
    schema = "symbol string, name string, sector string, category string, face_value double, total_shares long, is_active boolean, trading_status string, ds30 boolean, source string"
    stored = spark.createDataFrame([("A", "a", "s", "B", 10.0, 5, True, "Active", True, "OLD"), ("GONE", "g", "s", "A", 10.0, 5, True, "Active", False, "OLD")], schema)
    payload = spark.createDataFrame([(" a ", None, None, "A", None, 7, True, "Active", None, "NEW"), ("N", "n", "s", "Z", 10.0, 1, True, "Active", False, "NEW")], schema)
    once = merge.upsert_roster(stored, payload, as_of=D)
    later = merge.upsert_roster(once, payload, as_of=D + dt.timedelta(days=1))
    assert set(stored.columns) <= set(once.columns) and as_set(once) == as_set(later)
    r = {x.symbol: x for x in later.collect()}
    assert (r["A"].prev_category, r["A"].category, r["A"].category_changed_at, r["A"].ds30, r["A"].total_shares, r["A"].source) == ("B", "A", D, True, 7, "NEW")
    assert r["N"].is_new_listing and r["N"].first_seen == D
    assert (r["GONE"].trading_status, r["GONE"].delisted_date, r["GONE"].source) == ("Delisted", D, "OLD")


def test_all_approved_fields_apply(spark):
    stored = px(spark, ("A", 9.0, 8.0, 5, "DSE_SCRAPE", 0), ("B", 9.0, 8.0, 5, "DSE_SCRAPE", 0)).drop("seq")
    schema = "id string, target_table string, symbol string, date date, field_name string, incoming_value double, incoming_source string, status string"
    rows = [
        ("1", "price_history", "A", D, "volume", 70.0, None, "PENDING_USER_APPROVAL"), ("2", "price_history", "A", D, "high", 9.5, "LANKABD", "PENDING_USER_APPROVAL"),
        ("3", "price_history", "B", D, "close", 7.0, "LANKABD", "PENDING_USER_APPROVAL"), ("4", "price_history", "B", D, "symbol", 7.0, "LANKABD", "PENDING_USER_APPROVAL"),
        ("5", "fundamentals_history", "B", D, "low", 7.0, "LANKABD", "PENDING_USER_APPROVAL"),
    ]
    decisions = spark.createDataFrame([(i, "KEEP_EXISTING" if i == "3" else "ACCEPT_INCOMING", "ok") for i in "12345"], "id string, resolution string, note string")
    out = merge.resolve_quarantine(stored, spark.createDataFrame(rows, schema), decisions)
    r = {x.symbol: x for x in out.rows.collect()}
    assert (r["A"].volume, r["A"].high, r["A"].close, r["A"].source) == (70, 9.5, 8.0, "LANKABD")
    assert (r["B"].close, r["B"].low, r["B"].source) == (8.0, None, "DSE_SCRAPE")
    assert out.rows.columns == stored.columns and {x.id: x.status for x in out.quarantine.collect()}["3"] == "REJECTED_BY_USER"
    statements = spark.createDataFrame([("A", 2025, 1.0, "X")], "symbol string, fiscal_year int, dps double, source string")
    conflict = spark.createDataFrame([("9", "fundamentals_history", "A", 2025, "dps", 2.0, None, "PENDING_USER_APPROVAL")], schema.replace("date date", "fiscal_year int"))
    decided = spark.createDataFrame([("9", "ACCEPT_INCOMING", "ok")], "id string, resolution string, note string")
    out = merge.resolve_quarantine(statements, conflict, decided, table="fundamentals_history", keys=("symbol", "fiscal_year"), fields=merge.STATEMENT_FIELDS_APPLICABLE)
    assert [tuple(x) for x in out.rows.collect()] == [("A", 2025, 2.0, "USER_APPROVED_OVERRIDE")]


def test_promotion_prunes_inside_its_symbols_only(spark):
    main = px(spark, ("A", None, 8.0, 1, "STAGING_DB", 0), ("B", None, 8.0, 1, "STAGING_DB", 0)).drop("seq")
    other_day = main.filter("symbol = 'A'").withColumn("date", F.date_add("date", 1))
    staged = main.filter("symbol = 'A'").withColumn("close", F.lit(9.0))
    got = merge.promote_prices(main.unionByName(other_day).withColumn("pe", F.lit(None).cast("double")), staged)
    assert sorted((r.symbol, r.date, r.close) for r in got.collect()) == [("A", D, 9.0), ("B", D, 8.0)]
    gate = spark.createDataFrame([], "entity string, errors long")
    untouched = {"prices": main}
    assert merge.promote(untouched, {}, gate, as_of=D) is untouched


def test_tier_upgrade_keeps_other_columns(spark):
    schema = "date date, index_value double, advancing int, source string"
    old = spark.createDataFrame([(D, 5000.0, 7, "MCAP_WEIGHTED_ESTIMATE")], schema)
    day = D + dt.timedelta(days=1)
    live = spark.createDataFrame([(D, 5001.0, 1), (day, 5002.0, 2)], "date date, index_value double, advancing int")
    got = sorted(map(tuple, merge.upgrade_by_tier(old, live).rows.collect()))
    assert got == [(D, 5001.0, 7, "DSE_OFFICIAL_GRAPH"), (day, 5002.0, 2, "DSE_OFFICIAL_GRAPH")]


def test_ds30_upsert_meets_every_stored_day(spark):
    """All days are stored and all days arrive, whatever their date and source."""
    days = [(dt.date(1990, 1, 5), "DSE_SCRAPE"), (dt.date(1990, 1, 6), "LANKABD"), (dt.date(1999, 1, 5), "DSE_SCRAPE"), (dt.date(1999, 1, 6), "LANKABD"), (dt.date(1999, 1, 7), "MADE_UP")]
    rows = spark.createDataFrame([(d, 2000.0, s, 1900.0) for d, s in days], "date date, ds30_index double, source string, prev_close double")
    catalog.load()
    got = {(r.date, r.source): (r.ds30_index, r.prev_close) for r in catalog.QUERIES["j4_upsert_ds30"](SimpleNamespace(ds30=rows)).collect()}
    kept, updated = (2000.0, 1900.0), (2002.0, 1900.0)  # a day that arrives without its previous level keeps the stored one
    assert got == {(d, "LANKABD" if s != "DSE_SCRAPE" else s): kept if s == "DSE_SCRAPE" else updated for d, s in days}


def test_block_trade_upsert_meets_every_stored_trade(spark):
    """All trades are stored and all arrive, whatever their date."""
    days = [dt.date(1990, 1, 5), dt.date(1995, 1, 5), dt.date(1995, 1, 6), dt.date(1999, 1, 5), dt.date(1999, 1, 6)]
    schema = "symbol string, key long, date date, quantity long, value_mn double, trades long, min_price double, max_price double, source string"
    rows = spark.createDataFrame([(f"S{k}", k, d, 10, 1.0, 3, 4.0, 5.0, "LANKABD") for k in (1, 3) for d in days], schema)
    catalog.load()
    got = sorted((r.symbol, r.date, r.quantity, r.trades, r.source) for r in catalog.QUERIES["j5_upsert_block_trades"](SimpleNamespace(block_trades=rows)).collect())
    assert got == [("S1", d, 11, 3, "LANKABD") for d in days] + [("S3", d, 10, 3, "DSE_SCRAPE") for d in days]


def test_tier1_mismatches_meet_every_stored_day(spark):
    """Days of any year are compared; the official level differs on the days 1, 5, 9, ... of a month."""
    days = [dt.date(y, 1, d) for y in (1990, 1995, 1999) for d in (5, 6, 7)]
    rows = spark.createDataFrame([(d, 2000.0, "DSE_OFFICIAL") for d in days] + [(dt.date(1999, 2, 9), 2000.0, "LANKABD")], "date date, index_value double, source string")
    catalog.load()
    got = sorted((r.date, r.stored, r.live, r.source) for r in catalog.QUERIES["j13_tier1_mismatches"](SimpleNamespace(index=rows)).collect())
    assert got == [(dt.date(y, 1, 5), 2000.0, 2000.5, "DSE_OFFICIAL") for y in (1990, 1995, 1999)]


def test_an_upsert_in_slices_of_symbols_equals_the_whole(spark, tmp_path, monkeypatch):
    from bourselake.plans import marts
    from bourselake.session import folder_bytes

    catalog.load()
    rng = random.Random(4)
    start = dt.datetime(1997, 1, 10)
    rows = [(rng.choice([1, 2, 3, 4, 5, None]), float(rng.randrange(1, 50)), float(rng.randrange(100, 90000)), rng.choice("ANR"), "O", start + dt.timedelta(days=rng.randrange(60))) for _ in range(200)]
    spark.createDataFrame(rows, "l_suppkey long, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(str(tmp_path / "lineitem.parquet"))
    names = ("j2_upsert_daily_close", "o5_settlement_batch")
    whole = {name: as_set(catalog.QUERIES[name](Marts(spark, str(tmp_path)))) for name in names}
    monkeypatch.setattr(marts, "SLICE_BYTES", folder_bytes(spark, str(tmp_path / "lineitem.parquet")) // 2)
    m = Marts(spark, str(tmp_path))
    assert 2 <= m.slice_count <= 3
    for name in names:
        assert len(whole[name]) > 100 and as_set(catalog.QUERIES[name](m)) == whole[name]


def test_a_commit_in_pieces_equals_the_whole_and_frees_its_shuffles(spark, sf_dir, tmp_path, monkeypatch):
    from bourselake.sinks import versioned_store
    from bourselake.sinks.promotion import promote_to_store
    from bourselake.streaming import ticks

    m, found = Marts(spark, sf_dir), []
    gate = spark.createDataFrame([("prices", 0)], "entity string, errors long")
    blocks = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    for pieces in (1, 3):
        store = ticks.market_store(spark, str(tmp_path / f"store{pieces}"))
        before = blocks()
        store.commit({"prices": (m.prices, None), "index": (m.index, None), "fundamentals": (m.fundamentals, None), "roster": (m.roster, None), "shareholding": (m.shareholding, None)})
        sizes = store.stored_bytes("prices")
        monkeypatch.setattr(versioned_store, "PIECE_BYTES", sum(sizes.values()) // pieces + 1)
        assert (len(versioned_store._pieces(sorted(sizes), sizes)) >= 3) == (pieces == 3)
        ticks.settle_batch(store)(m.prices.filter("key % 3 <> 0").withColumn("close", F.col("close") + 1.0), 0)
        first = as_set(store.read("prices"))
        promote_to_store(store, {"prices": m.prices_existing.withColumns({c: F.lit(None).cast("double") for c in ("ycp", "change", "change_percent")})}, gate, as_of=D)
        found.append((first, as_set(store.read("prices"))))
        assert blocks() <= before + 4
    assert found[0] == found[1] and found[0][0] != found[0][1]
