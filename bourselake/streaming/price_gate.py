"""The row gate of prices on a stream of ticks: days as event-time windows, and keyed state that carries the last price on.

Ticks fold to one row a symbol and open day in Spark's own aggregation, which gives a day out once, when the watermark has
passed its end. Only then a symbol's closed days, one row each however many ticks they have, reach the stateful processor:
it holds each against the last price of the day before, as the batch gate does. State is one entry for each symbol and
day the watermark has not passed, and one price a symbol.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from bourselake.operators import audits

DAY_SCHEMA = "symbol string, day int, close double, prev_close double, records long"


#: Symbols are dealt into so many groups: calls into Python, and data frames, are made for a group and not for each symbol.
GROUPS = 1024


class LastClose(StatefulProcessor):
    """Per group of symbols: closed days (symbol, day, close, last_close, records) to the same with the last price of the day closed before.

    Days closed by a later batch are later ones. Unknown prices are NaN, which pandas cannot tell from null.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last_close = handle.getMapState("last_close", "symbol string", "close double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        days = sorted(d for frame in rows for d in zip(*(frame[c].tolist() for c in ("symbol", "day", "close", "last_close", "records")), strict=True))
        out = []
        for symbol, own in groupby(days, key=lambda d: d[0]):
            known = self.last_close.getValue((symbol,))
            before = float("nan") if known is None else known[0]
            for _, day, close, last, records in own:
                out.append((symbol, day, close, before, records))
                before = last
            self.last_close.updateValue((symbol,), (before,))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in DAY_SCHEMA.split(", ")])

    def close(self) -> None:
        pass


def use_keyed_state(spark: SparkSession) -> None:
    """Keyed state of a processor needs the state store on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def gate_days(ticks: DataFrame, delay: str = "1 hour") -> DataFrame:
    """(symbol, date, close, prev_close, records, errors, warnings, ...) by the rules of ``audits.audit_prices``: one row a symbol and day.

    ``ticks``: symbol, ts, event_id, ltp; the earliest record of a day claims it, ties by event_id. On a stream a day appears once,
    when the watermark has passed its end; ticks later than that are dropped. Ticks without symbol or time belong to no day.
    """
    usable = ticks.filter(F.col("symbol").isNotNull() & F.col("ts").isNotNull() & F.col("event_id").isNotNull())
    order, price = F.struct("ts", "event_id"), F.nanvl("ltp", F.lit(None).cast("double"))
    folded = [F.min_by(price, order).alias("close"), F.max_by(price, order).alias("last_close"), F.count(F.lit(1)).alias("records")]
    if ticks.isStreaming:
        # windows begin at midnight UTC, days at midnight of the session's zone
        wall = F.from_utc_timestamp("ts", F.lit(ticks.sparkSession.conf.get("spark.sql.session.timeZone")))
        held = usable.withColumn("wall", wall).withWatermark("wall", delay).groupBy("symbol", F.window("wall", "1 day").alias("w")).agg(*folded)
        known = [F.coalesce(c, F.lit(float("nan"))).alias(c) for c in ("close", "last_close")]
        group = F.pmod(F.hash("symbol"), F.lit(GROUPS)).alias("group")
        held = held.select(group, "symbol", F.floor(F.unix_seconds("w.start") / 86400).cast("int").alias("day"), *known, "records")
        days = held.groupBy("group").transformWithStateInPandas(statefulProcessor=LastClose(), outputStructType=DAY_SCHEMA, outputMode="append", timeMode="None")
        days = days.withColumn("date", F.date_from_unix_date("day")).withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("close", "prev_close")})
    else:
        held = usable.groupBy("symbol", F.col("ts").cast("date").alias("date")).agg(*folded)
        days = held.withColumn("prev_close", F.lag("last_close").over(W.partitionBy("symbol").orderBy("date")))
    unknown = F.lit(None).cast("double")
    days = days.select("symbol", "date", "close", unknown.alias("ycp"), F.lit(None).cast("long").alias("volume"), unknown.alias("pe"), "records", "prev_close")
    return audits.price_checks(days)
