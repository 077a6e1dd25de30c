"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from bourselake.plans import catalog  # noqa: E402
from bourselake.session import local_session  # noqa: E402

HEADLINE = (
    "d3_stock_screen",
    "g1_sma", "g4_macd", "g9_bollinger", "g10_rolling_high_low", "g12_max_drawdown",
    "g13_lookback_returns", "g16_risk_metrics", "g20_sector_pe_percentile",
    "k1_price_gate_summary", "k9_price_table_audit", "k11_statement_table_audit", "k20_staging_audit",
    "l2_price_check_summary", "j1_upsert_prices", "j2_upsert_daily_close", "j8_fundamentals_delta", "j8_delta_no_change",
    "f1_market_breadth", "f12_percentile_floor", "f15_sector_performance_1y", "o3_breadth_per_window",
    "a3_day_end_pages", "n5_entitlement_fold", "m18_decision_summary", "m20_valuation_snapshot",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    only = sys.argv[1:]
    spark = local_session("bench", cpus=cpus, shuffle_partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.bound_queries()
    run = lambda name: queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run("f2_symbol_history_stats")  # starts the JVM's code paths; not timed
    times = {}
    for name in only or HEADLINE:
        start = time.perf_counter()
        run(name)
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
