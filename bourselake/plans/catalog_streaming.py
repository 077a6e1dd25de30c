"""Streaming jobs (family O): the same transformations on a batch of the tick table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from bourselake.operators import merge, sets
from bourselake.plans.catalog import query
from bourselake.plans.catalog_merge import _F, _J2, _J7_GUARD, _J8, _J8_CHANGED, _K, _cols, _daily_batch, merge_sql
from bourselake.plans.oracle import fx
from bourselake.session import shared_folder
from bourselake.sinks.versioned_store import VersionedStore
from bourselake.streaming import price_gate, ticks


def _ticks(m):
    return ticks.gate(ticks.as_ticks(m.table("events")))


@query("o1_tick_gate", "ticks", "SELECT symbol, event_id, ltp FROM ticks WHERE ltp > 0")
def _(m):
    return _ticks(m).select("symbol", "event_id", "ltp")


_TICK_DAYS = """(SELECT *, lag(last_close) OVER (PARTITION BY symbol ORDER BY date) AS prev FROM (
   SELECT symbol, CAST(ts AS DATE) AS date, arg_min(ltp, (ts, event_id)) AS close, arg_max(ltp, (ts, event_id)) AS last_close, count(*) AS records FROM ticks GROUP BY 1, 2))"""
_TICK_GATE = f"""SELECT symbol, date, close, prev AS prev_close, records,
   CASE WHEN coalesce(close, 0) <= 0 THEN 'non_positive_close' ELSE '' END AS errors,
   concat_ws(',', CASE WHEN records > 1 THEN 'duplicate_day' END, CASE WHEN close > 0 AND prev > 0 AND (close / prev > 3.0 OR close / prev < 0.25) THEN 'price_swing' END) AS warnings FROM {_TICK_DAYS}"""


def _listed(gated):
    return gated.select("symbol", "date", "close", "prev_close", "records", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"))


@query("o1_tick_gate_days", "ticks", _TICK_GATE)
def _(m):
    return _listed(price_gate.gate_days(m.ticks))


@query("o1_tick_gate_stream", "ticks", f"SELECT * FROM ({_TICK_GATE}) WHERE date + 1 <= (SELECT max(ts) FROM ticks) - INTERVAL 1 HOUR")
def tick_gate_stream(m):
    """The same gate as a stream over the tick files, until all that has arrived is processed: the days that the watermark has passed."""
    price_gate.use_keyed_state(m.spark)
    folder = f"{shared_folder(m.spark)}/gate-{uuid.uuid4().hex}"
    gated = _listed(price_gate.gate_days(ticks.read_ticks(m.spark, m.path, "events.parquet")))
    ticks.write_available(gated, f"{folder}/days", f"{folder}/checkpoint").awaitTermination()
    return m.spark.read.schema(gated.schema).parquet(f"{folder}/days")


@query("o2_latest_tick", "ticks", "SELECT symbol, arg_max(ltp, (ts, event_id)) AS ltp FROM ticks WHERE ltp > 0 GROUP BY symbol")
def _(m):
    return ticks.latest_tick(_ticks(m)).select("symbol", "ltp")


@query(
    "o3_breadth_per_window", "ticks tick_base",
    """SELECT strftime(w, '%Y-%m-%d %H:%M') AS window_start, count(*) FILTER (ltp > ycp) AS advancing, count(*) FILTER (ltp < ycp) AS declining, count(*) FILTER (ltp = ycp) AS unchanged, CAST(sum(n) AS BIGINT) AS ticks FROM (
         SELECT time_bucket(INTERVAL '30 minutes', ts) AS w, t.symbol, arg_max(t.ltp, (ts, event_id)) AS ltp, any_value(b.ycp) AS ycp, count(*) AS n FROM ticks t LEFT JOIN tick_base b USING (symbol) WHERE t.ltp > 0 GROUP BY 1, 2) GROUP BY w""",
)
def tick_breadth(m):
    b = ticks.breadth_per_window(_ticks(m), m.tick_base)
    return b.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))


def tick_screen(m):
    """Stored screen of the tick symbols: previous close, and earnings as a tenth of it for every other symbol."""
    null = F.lit(None).cast("double")
    even = F.right("symbol", F.lit(1)).cast("int") % 2 == 0
    return m.tick_base.select("symbol", null.alias("ltp"), "ycp", null.alias("change"), null.alias("change_percent"), F.when(even, F.col("ycp") / 10.0).alias("eps"), null.alias("daily_pe"))


@query(
    "o4_live_overlay", "ticks tick_base",
    f"""WITH j AS (SELECT t.event_id, t.symbol, t.ltp, b.ycp, CASE WHEN CAST(right(t.symbol, 1) AS INTEGER) % 2 = 0 THEN b.ycp / 10.0::DOUBLE END AS eps, {fx("(t.ltp - b.ycp)")} AS chg FROM ticks t LEFT JOIN tick_base b USING (symbol) WHERE t.ltp > 0),
        k AS (SELECT *, CASE WHEN ycp > 0 THEN {fx("(chg / ycp * 100.0::DOUBLE)")} END AS pct FROM j)
        SELECT event_id, symbol, ltp, CASE WHEN coalesce(abs(pct) > 25, false) THEN NULL ELSE ycp END AS ycp, CASE WHEN coalesce(abs(pct) > 25, false) THEN NULL ELSE chg END AS change,
          CASE WHEN coalesce(abs(pct) > 25, false) THEN NULL ELSE pct END AS change_percent, CASE WHEN eps > 0 THEN {fx("(ltp / eps)")} END AS daily_pe FROM k""",
)
def _(m):
    o = ticks.overlay_stream(_ticks(m), tick_screen(m))
    return o.select("event_id", "symbol", "ltp", "ycp", "change", "change_percent", "daily_pe")


@query("o5_settlement_batch", "stored_prices daily_batch", merge_sql("stored_prices", "SELECT * FROM daily_batch", _K, _J2, tiered=True, plain=True))
def _(m):
    return m.by_symbol(lambda part: _cols(merge.upsert_daily_close(part(m.prices), part(_daily_batch(m)), seq="seq").rows, _K, _J2))


def new_store(m) -> VersionedStore:
    """A store of its own in the folder that the cluster shares."""
    return ticks.market_store(m.spark, f"{shared_folder(m.spark)}/store-{uuid.uuid4().hex}")


_FIRST = "(" + merge_sql("stored_prices", "SELECT * FROM daily_batch WHERE seq = 1", _K, _J2, tiered=True, plain=True) + ")"


@query("o5_settlement_writer", "stored_prices daily_batch", merge_sql(_FIRST, "SELECT * FROM daily_batch WHERE seq = 2", _K, _J2, tiered=True, plain=True))
def settlement_writer(m):
    """Two batches, the day's records and then the corrections, and the first one again, which must change nothing."""
    store, batch = new_store(m), _daily_batch(m)
    store.commit({"prices": (sets.slices(m.prices, m.slice_count, "symbol"), None)})
    run = ticks.settle_batch(store, seq="seq")
    for number, seq in ((0, 1), (1, 2), (0, 1)):
        run(batch.filter(F.col("seq") == seq), number)
        store.drop_old()
    return _cols(store.read("prices"), _K, _J2)


@query("o6_drop_repeats", "ticks", "SELECT DISTINCT symbol, event_id, ltp FROM ticks WHERE ltp > 0")
def _(m):
    t = _ticks(m)
    return ticks.drop_repeats(t.unionByName(t)).select("symbol", "event_id", "ltp")


@query("o7_fundamentals_delta_batch", "fundamentals fundamentals_incoming", merge_sql("fundamentals", f"SELECT * REPLACE ('Provisional' AS audit_status), 0 AS seq FROM ({_J8_CHANGED})", _F, _J8, guard=_J7_GUARD))
def _(m):
    return _cols(merge.fundamentals_delta(m.fundamentals, m.fundamentals_incoming).rows, _F, _J8)


@query("o7_delta_writer", "fundamentals fundamentals_incoming", merge_sql("fundamentals", f"SELECT * REPLACE ('Provisional' AS audit_status), 0 AS seq FROM ({_J8_CHANGED})", _F, _J8, guard=_J7_GUARD))
def delta_writer(m):
    """The disclosures of the years before 1996 and those from then on, each batch twice; no year is written by both."""
    store, batch = new_store(m), m.fundamentals_incoming
    store.commit({"fundamentals": (m.fundamentals, None)})
    run = ticks.delta_batch(store)
    for number, part in ((0, F.col("fiscal_year") < 1996), (1, F.col("fiscal_year") >= 1996), (1, F.col("fiscal_year") >= 1996), (0, F.col("fiscal_year") < 1996)):
        run(batch.filter(part), number)
    store.drop_old(keep=1)
    return _cols(store.read("fundamentals"), _F, _J8)
