"""Indicators and gates on small hand-made series."""

import datetime as dt
import random

from pyspark.sql import functions as F

from bourselake.operators import asof, audits, indicators, market, recursions, returns, skew

DAY0 = dt.date(2026, 1, 1)


def series(spark, closes, symbol="X", spread=0.0):
    rows = [(symbol, DAY0 + dt.timedelta(days=i), x + spread, x - spread, float(x), 100) for i, x in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, date date, high double, low double, close double, volume long")


def test_rsi_zones(spark):
    falling, p = [], 100.0
    for _ in range(30):
        p = max(20.0, p - 2.5)
        falling.append(p)
    rising = [53.0 + 3 * i for i in range(30)]
    px = series(spark, falling, "DOWN").unionByName(series(spark, rising, "UP")).unionByName(series(spark, [10.0, 12.0], "SHORT"))
    z = {r.symbol: r for r in recursions.latest_rsi_zone(recursions.recursive_indicators(px), px).collect()}
    assert z["DOWN"].rsi_zone == "OVERSOLD" and z["UP"].rsi_zone == "OVERBOUGHT" and z["UP"].rsi_14 == 99.01
    assert z["SHORT"].rsi_14 is None and z["SHORT"].rsi_zone == "INSUFFICIENT_DATA"


def test_atr_bands_and_wma(spark):
    rows = [("X", DAY0 + dt.timedelta(days=i), 204.0 + i % 3, 197.0 + i % 3, 201.0 + i % 3) for i in range(30)]
    px = spark.createDataFrame(rows, "symbol string, date date, high double, low double, close double")
    b = recursions.atr_bands(recursions.recursive_indicators(px), px).first()
    assert b.atr_14 > 0 and b.stop_loss < 200 < b.take_profit
    w = indicators.wma(px).orderBy("date").collect()
    assert w[18].wma_20 is None and w[19].wma_20 is not None


def test_ema_brute_force(spark):
    closes = [100 + (i * 37 % 11) - 0.3 * i for i in range(60)]
    got = [r.ema_12 for r in recursions.recursive_indicators(series(spark, closes)).orderBy("date").collect()]
    e, want = sum(closes[:12]) / 12, [None] * 11
    want.append(e)
    for x in closes[12:]:
        e = x * (2 / 13) + e * (11 / 13)
        want.append(e)
    assert all((a is None and b is None) or abs(a - b) < 6e-5 for a, b in zip(got, want))


def test_short_series_gives_nothing(spark):
    assert recursions.recursive_indicators(series(spark, [1.0] * 19)).count() == 0 and indicators.sma(series(spark, [1.0] * 19)).count() == 0


def test_beta_and_velocity(spark):
    px = series(spark, [100 + i * 0.5 + i % 3 for i in range(40)])
    ix = spark.createDataFrame([(DAY0 + dt.timedelta(days=i), 6000.0 + 10 * i) for i in range(40)], "date date, index_value double")
    r = returns.risk_metrics(px, ix).first()
    assert r.volatility_pct > 0 and r.beta is not None
    vol = spark.createDataFrame([("X", DAY0 + dt.timedelta(days=i), 10000 if i < 20 else 30000) for i in range(25)], "symbol string, date date, volume long")
    assert market.volume_velocity(vol).first().volume_velocity == 3.0


def test_percentile_position(spark):
    s = spark.createDataFrame([("X", float(i)) for i in (1, 2, 3, 4)], "symbol string, pe double")
    assert market.percentile_floor(s).first().median == 3.0


def test_count_above_on_one_hot_group(spark):
    values = [1.0 + (i * 7919 % 1009) / 50.0 for i in range(3000)] + [7.0] * 500
    df = spark.createDataFrame([("g", i, x) for i, x in enumerate(values)], "g string, i int, x double")
    got = {r.i: (r.above, r.group_size) for r in skew.count_above(df, ["g"], "x").collect()}
    assert got == {i: (sum(y > x for y in values), len(values)) for i, x in enumerate(values)}


def test_price_gate(spark):
    schema = "symbol string, date date, close double, ycp double, volume long, pe double, seq int"
    d1, d2 = dt.date(2026, 8, 18), dt.date(2026, 8, 19)
    rows = [("OK", d1, 54.2, 53.8, 1, None, 1), ("OK", d2, 55.1, 54.2, 1, None, 1), ("NOY", d1, 33.6, None, 1, None, 1), ("BAD", d1, 0.0, 5.0, 1, None, 1), ("BAD", d1, 9.0, 5.0, 1, None, 2)]
    g = audits.audit_prices(spark.createDataFrame(rows, schema), "seq")
    r = {(x.symbol, x.date): x for x in g.collect()}
    assert r["OK", d1].change == 0.4 and r["OK", d1].errors == []
    assert r["NOY", d1].change is None and r["NOY", d1].ycp is None
    # The unusable first record keeps the day; the second one does not replace it.
    assert r["BAD", d1].errors == ["non_positive_close"] and r["BAD", d1].warnings == ["duplicate_day"]
    s = audits.summary(g, "prices", F.col("records")).first()
    assert (s.records, s.errors, s.status) == (5, 1, "AUDIT_FAILED")


def test_snapshot_gates(spark):
    ix = spark.createDataFrame([(5786.08, 165, 148, 67), (5786.08, 180, 140, 60), (999999.0, None, None, None)], "index_value double, advancing int, declining int, unchanged int")
    assert [len(r.errors) for r in audits.audit_breadth(ix).collect()] == [0, 1, 1]
    ds = spark.createDataFrame([(2450.0, 2410.0), (8001.0, None), (500.0, None)], "ds30_index double, prev_close double")
    got = audits.audit_ds30(ds).collect()
    assert [len(r.errors) for r in got] == [0, 1, 0] and got[0].change_percent is not None
    sh = spark.createDataFrame(
        [(40.0, 0.0, 20.0, 5.0, 35.0), (40.0, 0.0, 20.0, 5.0, 35.5), (40.0, 0.0, 20.0, 5.0, 50.0), (40.0, 0.0, 20.0, 5.0, None)],
        "sponsor_pct double, govt_pct double, institute_pct double, foreign_pct double, public_pct double",
    )
    assert [bool(r.errors) for r in audits.audit_shareholding(sh).collect()] == [False, False, True, True]
    ro = spark.createDataFrame([("BRACBANK", 10.0, 1e6), ("NEWCO", None, None), ("BADCO", -5.0, None), (None, 10.0, None)], "symbol string, face_value double, total_shares double")
    assert [bool(r.errors) for r in audits.audit_roster(ro).collect()] == [False, False, True, True]


def test_asof_joins_of_a_hot_symbol_against_loops(spark):
    """One symbol has half of all rows, over thirty years with gaps of several of them; targets before, between and after."""
    rng = random.Random(3)
    start = dt.date(1990, 1, 1)
    day = lambda: start + dt.timedelta(days=rng.randrange(30 * 365))
    sessions = {("HOT", d): float(i) for i, d in enumerate({day() for _ in range(2000)}) if not 1995 <= d.year <= 1999}
    sessions |= {(f"S{i % 40}", day()): float(i) for i in range(1500)}
    targets = [("HOT", day(), i) for i in range(800)] + [(f"S{i % 45}", day(), i) for i in range(600)] + [("HOT", None, -1), (None, start, -2), ("HOT", start - dt.timedelta(days=9), -3)]
    px = spark.createDataFrame([(s, d, None if c % 97 == 0 else c) for (s, d), c in sessions.items()], "symbol string, date date, close double")
    t = spark.createDataFrame(targets, "symbol string, at date, n int").repartition(3)
    by_symbol = {}
    for (s, d), c in sorted(sessions.items()):
        by_symbol.setdefault(s, []).append((d, None if c % 97 == 0 else c))
    every = asof.asof_backward(t, px, target_date="at")
    assert every.count() == len(targets) and {r.n: r.asof_value for r in every.filter("n < 0").collect()} == {-1: None, -2: None, -3: None}
    seen = {}
    for s, d, n in targets:
        if n < 0:
            continue
        own = by_symbol.get(s, [])
        earlier = [c for x, c in own if x <= d and c is not None]
        later = [(x, c) for x, c in own if x >= d][:1]
        seen.setdefault((s, n), (earlier[-1] if earlier else None, later[0] if later and (later[0][0] - d).days <= 45 else (None, None)))
    pairs = {(r.symbol, r.n): r.asof_value for r in every.collect() if r.n >= 0}
    assert pairs == {k: v[0] for k, v in seen.items()}
    forward = {(r.symbol, r.n): (r.start_date, r.start_close) for r in asof.asof_forward(px, t, target_date="at", max_gap_days=45).collect() if r.n >= 0}
    assert forward == {k: v[1] for k, v in seen.items()}


def test_means_of_a_long_series_against_a_loop(spark):
    """Years with few and with many sessions, a first year shorter than every seed, and highs that are not known."""
    rng = random.Random(11)
    days = [dt.date(1999, 12, 25) + dt.timedelta(days=i) for i in range(7)] + [dt.date(2001, 1, 1) + dt.timedelta(days=i) for i in range(900) if i % 3]
    closes = [round(50 + 10 * rng.random(), 2) for _ in days]
    rows = [("A", d, None if i % 11 == 0 else c + 1, float("nan") if i % 13 == 0 else c - 1, c) for i, (d, c) in enumerate(zip(days, closes, strict=True))]
    rows += [("B", d, None, None, 5.0) for d in days[:19]]
    px = spark.createDataFrame(rows, "symbol string, date date, high double, low double, close double")
    got = {r.date: r for r in recursions.recursive_indicators(px.repartition(4)).collect()}
    assert len(got) == len(days)

    def mean(values, first, period, alpha):
        out, x = [None] * len(values), None
        for i in range(first + period - 1, len(values)):
            x = sum(values[first : i + 1]) / period if x is None else alpha * values[i] + (1 - alpha) * x
            out[i] = x
        return out

    fast, slow = mean(closes, 0, 12, 2 / 13), mean(closes, 0, 26, 2 / 27)
    macd = [None if b is None else a - b for a, b in zip(fast, slow, strict=True)]
    signal = mean(macd, 25, 9, 2 / 10)
    moves = [0.0] + [b - a for a, b in zip(closes, closes[1:], strict=False)]
    gain, loss = mean([max(x, 0.0) for x in moves], 1, 14, 1 / 14), mean([max(-x, 0.0) for x in moves], 1, 14, 1 / 14)
    spread = [(r[4] if r[2] is None else r[2], r[4] if r[3] is None or r[3] != r[3] else r[3]) for r in rows[: len(days)]]
    reach = [0.0] + [max(h - lo, abs(h - p), abs(lo - p)) for (h, lo), p in zip(spread[1:], closes, strict=False)]
    ranges = mean(reach, 1, 14, 1 / 14)
    for i, d in enumerate(days):
        rsi = None if i < 15 else 100 - 100 / (1 + (100.0 if loss[i] == 0 else gain[i] / loss[i]))
        want = (fast[i], slow[i], macd[i], signal[i], None if signal[i] is None else macd[i] - signal[i], ranges[i], rsi)
        r = got[d]
        for a, b, tolerance in zip((r.ema_12, r.ema_26, r.macd, r.macd_signal, r.macd_hist, r.atr_14, r.rsi_14), want, [6e-5] * 6 + [6e-3], strict=True):
            assert (a is None) == (b is None) and (a is None or abs(a - b) < tolerance), (i, a, b)
