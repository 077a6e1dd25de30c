"""Files read back, and streams against the same transformation on a batch."""

import datetime as dt
import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from bourselake.operators import audits, merge
from bourselake.plans import pages
from bourselake.plans.marts import Marts
from bourselake.sinks import csv_exports, paging, reports
from bourselake.sinks.promotion import promote_to_store
from bourselake.sinks.versioned_store import AuditFailed, StoreConflict
from bourselake.sources import csv_files
from bourselake.streaming import price_gate, ticks


@pytest.fixture(scope="module")
def m(spark, sf_dir):
    return Marts(spark, sf_dir)


def same(a, b):
    cols = sorted(a.columns)
    return sorted(map(repr, a.select(cols).collect())) == sorted(map(repr, b.select(cols).collect()))


def test_price_csv_round_trip(spark, m, tmp_path):
    path = str(tmp_path / "p.csv")
    pages.price_csv_rows(m).write.option("header", True).option("quoteAll", True).csv(path)
    got = csv_files.read_prices_csv(spark, path, csv_files.active_symbols(m.roster), start="1996-01-01")
    want = csv_files.price_rows(csv_files.normalize_headers(pages.price_csv_rows(m)), csv_files.active_symbols(m.roster), start="1996-01-01")
    assert got.count() > 0 and same(got, want)


def test_index_csv_with_byte_order_mark(spark, tmp_path):
    f = tmp_path / "i.csv"
    f.write_bytes('﻿"Date","Price","Open","High","Low","Vol.","Change %"\n"Sep 21, 2020","5,012.25","5,000.00","5,020.00","4,990.00","120.5","0.2%"\n"Sep 22, 2010","1","","","","",""\n"x","7","","","","",""\n'.encode())
    r = csv_files.read_index_csv(spark, str(f), "DSEX").collect()
    assert [(str(x.date), x.index_value, x.index_open) for x in r] == [("2020-09-21", 5012.25, 5000.0)]


def test_symbol_list(spark, tmp_path):
    f = tmp_path / "s.json"
    f.write_text(json.dumps({"count": 2, "symbols": ["A", "B"]}, indent=2))
    assert sorted(r.symbol for r in csv_files.read_symbol_list(spark, str(f)).collect()) == ["A", "B"]


def test_exports_read_back(spark, m, tmp_path):
    csv_exports.export_prices_csv(m.prices, str(tmp_path / "prices"))
    back = spark.read.option("header", True).csv(str(tmp_path / "prices"))
    assert tuple(back.columns) == csv_exports.PRICE_COLUMNS and back.count() == m.prices.count()
    first = back.filter("ycp is null").count()
    assert first == m.prices.select("symbol").distinct().count() and back.filter("open is not null").count() == 0
    csv_exports.export_index_csv(m.index, str(tmp_path / "index"))
    csv_exports.export_latest_fundamentals_csv(m.fundamentals, m.roster, str(tmp_path / "latest"))
    csv_exports.export_statements_csv(m.statements, str(tmp_path / "statements"))
    csv_exports.export_quoted_csv(spark.createDataFrame([(1, 'say "hi", all')], "id int, name string"), str(tmp_path / "q"))
    text = "".join(p.read_text() for p in (tmp_path / "q").glob("*.csv"))
    assert '"1","say ""hi"", all"' in text
    assert spark.read.option("header", True).csv(str(tmp_path / "latest")).count() == m.fundamentals.select("symbol").distinct().count()


def test_reports(spark, m, tmp_path):
    from bourselake.operators import audits
    from bourselake.operators.lookups import stock_screen

    s = audits.summary(audits.audit_prices(m.prices_dirty, "seq"), "prices", F.col("records"))
    for day in ("2026-01-01", "2026-01-02"):
        reports.append_audit_report(s, str(tmp_path / "reports"), run_at=day)
    rows = spark.read.parquet(str(tmp_path / "reports")).orderBy("run_at").collect()
    assert len(rows) == 2 and json.loads(rows[0].report_json)["status"] == rows[0].status
    screen = stock_screen(m.statements, m.roster, m.prices)
    reports.write_snapshot_json(screen, str(tmp_path / "snap"), timestamp="t", date="d")
    head = spark.read.json(str(tmp_path / "snap/header")).first()
    assert head["count"] == spark.read.json(str(tmp_path / "snap/stocks")).count()


def stream(spark, sf_dir):
    return ticks.gate(ticks.read_ticks(spark, sf_dir, "events.parquet"))


def test_gate_and_repeats_stream(spark, m, sf_dir, tmp_path):
    s = ticks.drop_repeats(stream(spark, sf_dir))
    ticks.write_available(s, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    want = ticks.drop_repeats(ticks.gate(m.ticks))
    assert same(spark.read.parquet(str(tmp_path / "out")), want)


def test_latest_tick_stream(spark, m, sf_dir, tmp_path):
    q = ticks.latest_tick(stream(spark, sf_dir)).writeStream.format("memory").queryName("latest").outputMode("complete")
    q.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert same(spark.table("latest"), ticks.latest_tick(ticks.gate(m.ticks)))


def test_breadth_stream_emits_closed_windows(spark, m, sf_dir, tmp_path):
    s = ticks.breadth_per_window(stream(spark, sf_dir), m.tick_base)
    ticks.write_available(s, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.window_start: tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.window_start: tuple(r) for r in ticks.breadth_per_window(ticks.gate(m.ticks), m.tick_base).collect()}
    last = max(want)
    assert got and all(want[k] == v for k, v in got.items())
    # Only windows the watermark has not passed yet are missing.
    assert all((last - k).total_seconds() <= 2 * 3600 for k in set(want) - set(got))


def test_overlay_stream(spark, m, sf_dir, tmp_path):
    from bourselake.plans.catalog_streaming import tick_screen

    s = ticks.overlay_stream(stream(spark, sf_dir), tick_screen(m))
    ticks.write_available(s, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert same(spark.read.parquet(str(tmp_path / "out")), ticks.overlay_stream(ticks.gate(m.ticks), tick_screen(m)))


def files(root):
    return {str(p) for p in root.rglob("*.parquet")}


COLS = ["symbol", "date", "close", "ycp", "change", "change_percent", "volume", "pe", "high", "low", "value_mn", "source"]


def test_settlement_micro_batches(spark, m, tmp_path):
    src, root = str(tmp_path / "in"), tmp_path / "store"
    day = m.prices_incoming.filter("seq = 1").withColumns({"ycp": F.col("close") - 1.0, "change": F.lit(None).cast("double"), "change_percent": F.lit(None).cast("double"), "pe": F.lit(None).cast("double")}).select(COLS)
    day.coalesce(1).write.parquet(src)
    # A second arrival holds an unusable close and must be skipped as a whole.
    day.limit(5).withColumn("close", F.lit(0.0)).coalesce(1).write.mode("append").parquet(src)
    s = spark.readStream.schema(day.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(src)
    base, store = m.prices.select(COLS), ticks.market_store(spark, str(root))
    store.commit({"prices": (base, None)})
    ticks.run_available(s, str(tmp_path / "cp"), ticks.settle_batch(store)).awaitTermination()
    assert store.manifest().batches == {"settlement": 1}
    assert same(store.read("prices"), merge.upsert_daily_close(base, day).rows)


def test_a_batch_rewrites_only_what_it_touches_and_once(spark, m, tmp_path):
    root = tmp_path / "store"
    store = ticks.market_store(spark, str(root))
    base = m.prices.select(COLS)
    store.commit({"prices": (base, None), "index": (m.index, None)})
    before, run = files(root), ticks.settle_batch(store)
    day = m.prices.filter("date = '1996-03-13'").withColumn("close", F.col("close") + 1.0).select(COLS)
    run(day, 0)
    new = files(root) - before
    size = sum(os.path.getsize(f) for f in new)
    assert new and all("_part=1996-03/" in f for f in new) and size < 0.1 * sum(os.path.getsize(f) for f in before if "/prices/" in f)
    after = store.manifest()
    run(day.withColumn("close", F.col("close") + 7.0), 0)
    assert store.manifest() == after and files(root) - before == new
    assert same(store.read("prices"), merge.upsert_daily_close(base, day).rows)
    assert store.read("prices", ["1996-03"]).filter("date not between '1996-03-01' and '1996-03-31'").isEmpty()
    store.drop_old(keep=1)
    assert same(store.read("prices"), merge.upsert_daily_close(base, day).rows) and same(store.read("index"), m.index)
    assert not [f for f in files(root) if "_part=1996-03/" in f and f not in new and "/prices/" in f]


def test_a_failed_commit_leaves_every_table_as_it_was(spark, m, tmp_path):
    store = ticks.market_store(spark, str(tmp_path / "store"))
    before = store.commit({"prices": (m.prices.select(COLS), None), "index": (m.index, None), "roster": (m.roster, None)})
    broken = m.roster.withColumn("name", F.raise_error(F.lit("no more")).cast("string"))
    with pytest.raises(Exception, match="no more"):
        store.commit({"prices": (m.prices.select(COLS).limit(3), None), "index": (m.index.limit(1), None), "roster": (broken, None)})
    assert store.manifest() == before and same(store.read("index"), m.index)
    store.commit({"index": (m.index.limit(0), [])})
    with pytest.raises(StoreConflict):
        store.commit({"index": (m.index.limit(1), None)}, base=before)
    with pytest.raises(ValueError, match="does not name"):
        store.commit({"index": (m.index, ["1992"])})
    assert same(store.read("index"), m.index) and same(store.read("roster"), m.roster)
    assert store.read("index", ["1800"]).isEmpty() and store.read("index", ["1800"]).schema == m.index.schema


def test_delta_micro_batch(spark, m, tmp_path):
    src = str(tmp_path / "in")
    store = ticks.market_store(spark, str(tmp_path / "store"))
    store.commit({"fundamentals": (m.fundamentals, None)})
    m.fundamentals_incoming.coalesce(1).write.parquet(src)
    s = spark.readStream.schema(m.fundamentals_incoming.schema).parquet(src)
    ticks.run_available(s, str(tmp_path / "cp"), ticks.delta_batch(store)).awaitTermination()
    assert same(store.read("fundamentals"), merge.fundamentals_delta(m.fundamentals, m.fundamentals_incoming).rows)


def test_counts_are_observed_while_rows_are_written(spark, m, tmp_path):
    store = ticks.market_store(spark, str(tmp_path / "store"))
    checks = audits.index_table_checks("index_value", audits.INDEX_RANGE)
    done = store.commit({"index": (m.index, None), "roster": (m.roster, None)}, counts={"index": checks})
    assert done.audit == {"index": audits.conditional_counts(m.index, checks).first().asDict()} == store.manifest().audit
    with pytest.raises(AuditFailed) as failed:
        store.commit({"index": (m.index.limit(3), None), "roster": (m.roster, None)}, counts={"roster": {"rows": F.lit(True)}}, forbidden={"index": {"known": F.col("index_value").isNotNull()}})
    assert failed.value.counts == {"index": {"total": 3, "known": 3}, "roster": {"total": m.roster.count(), "rows": m.roster.count()}}
    assert store.manifest() == done


def test_promotion_is_all_or_nothing(spark, m, tmp_path):
    store = ticks.market_store(spark, str(tmp_path / "store"))
    main = {"prices": m.prices, "index": m.index, "fundamentals": m.fundamentals, "roster": m.roster, "shareholding": m.shareholding}
    before = store.commit({n: (rows, None) for n, rows in main.items()})
    staged = {"prices": m.prices.limit(50), "index": m.index, "fundamentals": m.fundamentals, "roster": m.roster.limit(2), "shareholding": m.shareholding}
    gate = lambda n: spark.createDataFrame([("prices", n)], "entity string, errors long")
    broken = staged | {"roster": staged["roster"].withColumn("name", F.when(F.length("symbol") > 0, F.raise_error(F.lit("torn"))).cast("string"))}
    with pytest.raises(Exception, match="torn"):
        promote_to_store(store, broken, gate(0), as_of="2000-01-01")
    assert promote_to_store(store, staged, gate(1), as_of="2000-01-01") == before == store.manifest()
    assert promote_to_store(store, {n: rows.limit(0) for n, rows in staged.items()}, gate(0), as_of="2000-01-01") == before
    with pytest.raises(AuditFailed):
        promote_to_store(store, staged, gate(0), as_of="2000-01-01", forbidden={"shareholding": {"any": F.lit(True)}})
    assert same(store.read("roster"), m.roster)
    after = promote_to_store(store, {"index": m.index}, gate(0), as_of="2000-01-01")
    assert after.version == before.version + 1 and {n for n in main if after.tables[n] != before.tables[n]} == {"index"}
    assert store.read("index").filter("source <> 'STAGING_DB'").isEmpty()


def test_gate_on_a_stream_equals_the_gate_on_a_batch(spark, tmp_path):
    rng = random.Random(5)
    start = dt.datetime(2024, 3, 1)
    rows, src = [], tmp_path / "in"
    for i in range(400):
        at = start + dt.timedelta(minutes=rng.randrange(9 * 1440))
        rows.append((i, at, rng.choice([1, 1, 1, 2, 3]), "x", rng.choice([None, 0.0, -1.0, 10.0, 11.0, 50.0, 200.0]), None))
    rows += [(900, start, None, "x", 5.0, None), (901, None, 1, "x", 5.0, None)]
    rows.sort(key=lambda r: (r[1] or start, r[0]))
    # arrivals overlap by some hours, in any order inside; the last one moves the watermark past all days before it
    parts = [rows[:150], rows[150:151] + rows[160:300], rows[151:160] + rows[300:], [(999, start + dt.timedelta(days=20), 9, "x", 1.0, None)]]
    for i, part in enumerate(parts):
        rng.shuffle(part)
        spark.createDataFrame(part, ticks.TICK_SCHEMA).coalesce(1).write.parquet(str(src / f"p{i}"))
    files = spark.readStream.schema(ticks.TICK_SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(str(src))
    price_gate.use_keyed_state(spark)
    gated = price_gate.gate_days(ticks.as_ticks(files), delay="2 days")
    ticks.write_available(gated, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    want = price_gate.gate_days(ticks.as_ticks(spark.createDataFrame(rows, ticks.TICK_SCHEMA)))
    got = spark.read.schema(gated.schema).parquet(str(tmp_path / "out"))
    assert got.count() > 15 and same(got, want)
    assert {w for r in got.collect() for w in r.warnings} == {"duplicate_day", "price_swing"}


def test_the_gate_hands_python_closed_days_of_groups_of_symbols(spark, sf_dir):
    """Ticks fold before the stateful processor, which is called for each group and not for each symbol and day."""
    gated = price_gate.gate_days(ticks.read_ticks(spark, sf_dir, "events.parquet"))
    plan = gated._jdf.queryExecution().analyzed().toString()
    stateful = plan.index("TransformWithStateInPySpark")
    assert re.search(r"Aggregate \[symbol#\d+, window#\d+", plan[stateful:]), plan
    assert re.search(r"pmod\(hash\(symbol#\d+, 42\), 1024\) AS group#", plan[stateful:]), plan


def test_pages_are_read_by_their_ranges_alone(spark, tmp_path):
    rows = spark.range(5000).select((F.col("id") * 7 % 5000).alias("k"), (F.col("id") % 3).alias("v"), F.lit("x").alias("position_of"))
    path = str(tmp_path / "paged")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    paging.write_paged(rows.repartition(7), path, "k")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "paged" / "rows").glob("_range=*"))) > 2
    assert paging.row_count(spark, path) == 5000
    for page, size in ((0, 100), (24, 100), (49, 100), (3, 1333), (0, 6000)):
        got = [(r.position, r.k) for r in paging.read_page(spark, path, page, size).collect()]
        assert got == [(i, i) for i in range(page * size, min((page + 1) * size, 5000))]
    assert paging.read_page(spark, path, 50, 100).isEmpty()
    plan = paging.read_page(spark, path, 24, 100)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: .[^]]*_range#[0-9]+ (=|IN)", plan), plan
    paging.write_paged(rows.limit(0), str(tmp_path / "none"), "k")
    assert paging.row_count(spark, str(tmp_path / "none")) == 0 and paging.read_page(spark, str(tmp_path / "none"), 0, 10).isEmpty()


def test_every_line_of_a_price_file_is_a_row_or_a_reject(spark, tmp_path):
    header = "Trading Code,Date,Open,High,Low,Close,Volume"
    good = ['abc,2020-01-02,1,2,1,"1,234.5",10', " Def ,2020-01-03,,,,5,", '"x""y",2020-01-04,1,1,1,7,1']
    bad = {
        "malformed": ["abc,2020-01-02,1,2", "abc,2020-01-02,1,2,1,1,10,99", '"abc,2020-01-02,1,2,1,1,10', "nonsense"],
        "no_symbol": [",2020-01-02,1,2,1,1,10"], "no_day": ["abc,someday,1,2,1,1,10", "abc,,1,2,1,1,10"],
        "before_start": ["abc,2012-12-31,1,2,1,1,10"], "no_close": ["abc,2020-01-05,1,2,1,0,10", "abc,2020-01-05,1,2,1,-,10"],
    }
    lines = good + [x for v in bad.values() for x in v]
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "a.csv").write_text("﻿" + "\n".join([header, *lines[:6], ""]), encoding="utf-8")
    (folder / "b.csv").write_text("\n".join([header, *lines[6:]]), encoding="utf-8")
    rows, rejects = csv_files.read_prices_with_rejects(spark, str(folder))
    assert sorted((r.symbol, str(r.date), r.close) for r in rows.collect()) == [("ABC", "2020-01-02", 1234.5), ("DEF", "2020-01-03", 5.0), ('X"Y', "2020-01-04", 7.0)]
    got = {}
    for r in rejects.collect():
        got.setdefault(r.reason, []).append(r.line)
        assert r.file.endswith("a.csv" if lines.index(r.line) < 6 else "b.csv")
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in bad.items()}
    assert rows.count() + rejects.count() == len(lines)
    active = spark.createDataFrame([("DEF",)], "symbol string")
    assert [r.symbol for r in csv_files.read_prices_with_rejects(spark, str(folder), active)[0].collect()] == ["DEF"]
