"""As-of joins: the last value on or before a day, and the first value on or after it.

The answer depends on (symbol, day) alone, so targets first collapse to their distinct days. Days and sessions meet in windows of
one symbol and one calendar year; what the years before (or after) end (or begin) with is carried into a year by a window
over one row for each of its symbol's years. So a symbol with a third of all days is spread over as many tasks as it has
years. The answers join back on (symbol, day).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _days_and_sessions(targets: DataFrame, prices: DataFrame, by: str, target_date: str, value: Column, session_first: bool) -> DataFrame:
    """Distinct target days and sessions of every symbol in one frame; ``kind`` orders a session against a target day."""
    days = targets.select(F.col(by).alias("_by"), F.col(target_date).alias("_day")).filter(F.col("_day").isNotNull()).distinct()
    sessions = prices.select(F.col(by).alias("_by"), F.col("date").alias("_day"), F.lit(0 if session_first else 1).alias("_kind"), value.alias("_val"))
    wanted = days.withColumn("_kind", F.lit(1 if session_first else 0)).withColumn("_val", F.lit(None).cast(sessions.schema["_val"].dataType))
    return sessions.unionByName(wanted)


def _nearest(both: DataFrame, backward: bool) -> DataFrame:
    """The rows with ``_seen``: the nearest known value at or before (after) each row of its symbol."""
    known = F.when(F.col("_val").isNotNull(), F.col("_day"))
    both = both.withColumn("_year", F.year("_day"))
    inside = W.partitionBy("_by", "_year").orderBy("_day", "_kind")
    years = W.partitionBy("_by").orderBy("_year")
    if backward:
        here = F.last("_val", ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, 0))
        ends = both.groupBy("_by", "_year").agg(F.max_by("_val", known).alias("_end"))
        carried = F.last("_end", ignorenulls=True).over(years.rowsBetween(W.unboundedPreceding, -1))
    else:
        here = F.first("_val", ignorenulls=True).over(inside.rowsBetween(0, W.unboundedFollowing))
        ends = both.groupBy("_by", "_year").agg(F.min_by("_val", known).alias("_end"))
        carried = F.first("_end", ignorenulls=True).over(years.rowsBetween(1, W.unboundedFollowing))
    ends = ends.select("_by", "_year", carried.alias("_carried"))
    return both.withColumn("_here", here).join(ends, ["_by", "_year"]).withColumn("_seen", F.coalesce("_here", "_carried"))


def _join_back(targets: DataFrame, answers: DataFrame, by: str, target_date: str) -> DataFrame:
    same = (F.col(by) == F.col("_by")) & (F.col(target_date) == F.col("_day"))
    return targets.join(answers, same, "left").drop("_by", "_day")


def asof_backward(
    targets: DataFrame, prices: DataFrame, *, target_date: str, value: str = "close", by: str = "symbol", out: str = "asof_value"
) -> DataFrame:
    """``targets`` plus the last ``value`` of ``prices`` dated on or before ``target_date``; null where there is none."""
    both = _days_and_sessions(targets, prices, by, target_date, F.col(value), True)
    seen = _nearest(both, backward=True).filter(F.col("_kind") == 1)
    return _join_back(targets, seen.select("_by", "_day", F.col("_seen").alias(out)), by, target_date)


def closes_at(prices: DataFrame, days: dict[str, object], *, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Per symbol, the last close on or before each of a fixed set of days, in one pass and one shuffle."""
    aggs = []
    for name, d in days.items():
        reached = F.col("date") <= F.lit(d).cast("date")
        aggs.append(F.max_by("close", F.when(reached, F.col("date"))).alias(name))
    return prices.groupBy(*by).agg(*aggs)


def asof_forward(
    prices: DataFrame, targets: DataFrame, *, target_date: str, max_gap_days: int = 45, by: str = "symbol"
) -> DataFrame:
    """Per target row, the first price row dated on or after it, kept only within ``max_gap_days``."""
    both = _days_and_sessions(targets, prices, by, target_date, F.struct("date", "close"), False)
    seen = _nearest(both, backward=False).filter(F.col("_kind") == 0).withColumnRenamed("_seen", "_next")
    near = F.datediff(F.col("_next.date"), "_day") <= max_gap_days
    answers = seen.select("_by", "_day", F.when(near, F.col("_next.date")).alias("start_date"), F.when(near, F.col("_next.close")).alias("start_close"))
    return _join_back(targets, answers, by, target_date)
