"""Indicators whose every value needs the one before: EMA, MACD, Wilder RSI and Wilder ATR, as a scan of affine maps.

One step of a seeded exponential mean is x -> a * x + b, the sum that its seed is made of included, and so is any number of
steps one after another. A symbol's sessions are cut into calendar years. Each year folds to one map; the maps of the
years before give its start; from there its own sessions are worked out. So a series is spread over as many tasks as it
has years, and only one small row for each year and symbol meets in a window. The MACD signal depends on both means, so its
map has a factor for each of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bourselake.functions import labels
from bourselake.functions import numbers as num
from bourselake.operators.indicators import MIN_SERIES

FAST, SLOW, SIGNAL, WILDER = 12, 26, 9, 14
#: Positions, from 0, of the first value that goes into a mean: closes, the MACD (once the slow mean is there), changes from one close to the next.
_CLOSES, _MACD, _CHANGES = 0, SLOW - 1, 1


def _seeded(i: Column, first: int, period: int, alpha: float) -> tuple[Column, Column]:
    """(a, c) of the step x -> a * x + c * value at position ``i``: nothing before ``first``, then the sum of ``period`` values, its mean, the exponential mean."""
    start = first + period - 1
    a = F.when(i < start, 1.0).when(i == start, 1.0 / period).otherwise(1.0 - alpha)
    c = F.when(i < first, 0.0).when(i < start, 1.0).when(i == start, 1.0 / period).otherwise(alpha)
    return a, c


#: The means of a single series: (name, field of a session, first position, period, weight of a new value).
_MEANS = (
    ("fast", "close", _CLOSES, FAST, 2.0 / (FAST + 1)),
    ("slow", "close", _CLOSES, SLOW, 2.0 / (SLOW + 1)),
    ("gain", "gain", _CHANGES, WILDER, 1.0 / WILDER),
    ("loss", "loss", _CHANGES, WILDER, 1.0 / WILDER),
    ("range", "range", _CHANGES, WILDER, 1.0 / WILDER),
)


def _folded(m: Column, x: Column) -> Column:
    """The map ``m`` (a_ and b_ of each mean; of the signal its factors for fast, slow and itself, and b) followed by the step of session ``x``."""
    out, new = [], {}
    for name, value, *how in _MEANS:
        a, c = _seeded(x["i"], *how)
        new[name] = a * m[f"a_{name}"], a * m[f"b_{name}"] + c * x[value]
        out += [new[name][0].alias(f"a_{name}"), new[name][1].alias(f"b_{name}")]
    a, c = _seeded(x["i"], _MACD, SIGNAL, 2.0 / (SIGNAL + 1))
    (fast_a, fast_b), (slow_a, slow_b) = new["fast"], new["slow"]
    signal = {"s_fast": a * m["s_fast"] + c * fast_a, "s_slow": a * m["s_slow"] - c * slow_a, "s_own": a * m["s_own"], "s_b": a * m["s_b"] + c * (fast_b - slow_b)}
    return F.struct(*out, *[v.alias(n) for n, v in signal.items()])


def _unchanged() -> Column:
    """The map that changes nothing."""
    out = [F.lit(v).alias(f"{k}_{name}") for name, *_ in _MEANS for k, v in (("a", 1.0), ("b", 0.0))]
    return F.struct(*out, F.lit(0.0).alias("s_fast"), F.lit(0.0).alias("s_slow"), F.lit(1.0).alias("s_own"), F.lit(0.0).alias("s_b"))


def _applied(state: Column, m: Column) -> Column:
    """The state after the map."""
    out = [(m[f"a_{name}"] * state[name] + m[f"b_{name}"]).alias(name) for name, *_ in _MEANS]
    signal = m["s_fast"] * state["fast"] + m["s_slow"] * state["slow"] + m["s_own"] * state["signal"] + m["s_b"]
    return F.struct(*out, signal.alias("signal"))


def _stepped(state: Column, x: Column) -> Column:
    """The state after one session."""
    new = {}
    for name, value, *how in _MEANS:
        a, c = _seeded(x["i"], *how)
        new[name] = a * state[name] + c * x[value]
    a, c = _seeded(x["i"], _MACD, SIGNAL, 2.0 / (SIGNAL + 1))
    new["signal"] = a * state["signal"] + c * (new["fast"] - new["slow"])
    return F.struct(*[v.alias(n) for n, v in new.items()])


def _sessions(rows: DataFrame) -> DataFrame:
    """(symbol, year, v): the sessions of each year in order, with their position in the whole series and the change from the close before."""
    held = rows.groupBy("symbol", "year").agg(F.count(F.lit(1)).alias("n"), F.max_by("close", "date").alias("last"))
    by_symbol = W.partitionBy("symbol")
    in_order = by_symbol.orderBy("year")
    before = F.coalesce(F.sum("n").over(in_order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    held = held.select("symbol", "year", before.alias("before"), F.lag("last").over(in_order).alias("close_before"), F.sum("n").over(by_symbol).alias("total"))
    held = held.filter(F.col("total") >= MIN_SERIES).drop("total")
    years = rows.groupBy("symbol", "year").agg(F.array_sort(F.collect_list(F.struct("date", "close", "high", "low"))).alias("v")).join(held, ["symbol", "year"])

    def session(x: Column, k: Column) -> Column:
        prev = F.when(k == 0, F.col("close_before")).otherwise(F.get("v", k - 1)["close"])
        known = lambda c: F.coalesce(c, F.lit(0.0))  # noqa: E731  the first session has no change
        change = x["close"] - prev
        reach = F.greatest(x["high"] - x["low"], F.abs(x["high"] - prev), F.abs(x["low"] - prev))
        return F.struct(
            x["date"].alias("date"), (F.col("before") + k).alias("i"), x["close"].alias("close"), known(F.greatest(change, F.lit(0.0))).alias("gain"),
            known(F.greatest(-change, F.lit(0.0))).alias("loss"), known(reach).alias("range"),
        )

    return years.select("symbol", "year", F.transform("v", session).alias("v"))


def recursive_indicators(prices: DataFrame) -> DataFrame:
    """EMA 12/26, MACD with signal and histogram, RSI 14 and ATR 14 for every session, in one pass.

    Means start from the simple mean of their first values. RSI appears one step after its seed; no losses at all count as a
    strength of 100. An unknown high or low counts as the close. Series of fewer than MIN_SERIES sessions have no rows.
    """
    spread = lambda c: F.coalesce(F.nanvl(c, F.lit(None).cast("double")), F.col("close")).alias(c)
    rows = prices.filter(F.col("close") > 0).select("symbol", "date", "close", spread("high"), spread("low"), F.year("date").alias("year"))
    years = _sessions(rows)
    maps = years.select("symbol", "year", F.aggregate("v", _unchanged(), _folded).alias("m"))
    earlier = F.collect_list("m").over(W.partitionBy("symbol").orderBy("year").rowsBetween(W.unboundedPreceding, -1))
    nothing = F.struct(*[F.lit(0.0).alias(n) for n in (*[n for n, *_ in _MEANS], "signal")])
    starts = maps.select("symbol", "year", F.aggregate(earlier, nothing, _applied).alias("start"))
    # each session's state, in an array that grows by one; a year bounds it
    begun = F.struct(F.col("start").alias("now"), F.array().cast("array<struct<date: date, i: bigint, fast: double, slow: double, gain: double, loss: double, range: double, signal: double>>").alias("all"))

    def grown(done: Column, x: Column) -> Column:
        now = _stepped(done["now"], x)
        row = F.struct(x["date"].alias("date"), x["i"].alias("i"), *[now[n].alias(n) for n in (*[n for n, *_ in _MEANS], "signal")])
        return F.struct(now.alias("now"), F.concat(done["all"], F.array(row)).alias("all"))

    found = years.join(starts, ["symbol", "year"]).select("symbol", F.explode(F.aggregate("v", begun, grown, lambda done: done["all"])).alias("x")).select("symbol", "x.*")
    since = lambda first, value: F.when(F.col("i") >= first, value)
    fast, slow = since(FAST - 1, F.col("fast")), since(SLOW - 1, F.col("slow"))
    signal = since(SLOW + SIGNAL - 2, F.col("signal"))
    strength = F.when(F.col("loss") == 0, 100.0).otherwise(F.col("gain") / F.col("loss"))
    out = {"ema_12": fast, "ema_26": slow, "macd": fast - slow, "macd_signal": signal, "macd_hist": fast - slow - signal, "atr_14": since(WILDER, F.col("range"))}
    rsi = since(WILDER + 1, 100.0 - 100.0 / (1.0 + strength))
    return found.select("symbol", "date", *[num.to_fixed(v, 4).alias(n) for n, v in out.items()], num.to_fixed(rsi, 2).alias("rsi_14"))


def latest_rsi_zone(indicators: DataFrame, prices: DataFrame) -> DataFrame:
    """Newest RSI per symbol with its zone; too short a series has no RSI."""
    last = indicators.groupBy("symbol").agg(F.max_by("rsi_14", "date").alias("rsi_14"))
    every = prices.select("symbol").distinct().join(last, "symbol", "left")
    return every.withColumn("rsi_zone", labels.rsi_zone(F.col("rsi_14")))


def atr_bands(indicators: DataFrame, prices: DataFrame, stop: float = 2.0, target: float = 3.0, digits: int | None = 2) -> DataFrame:
    """Stop-loss and take-profit around the newest close, in multiples of the newest ATR."""
    a = indicators.groupBy("symbol").agg(F.max_by("atr_14", "date").alias("atr_14"))
    c = prices.groupBy("symbol").agg(F.max_by("close", "date").alias("close"))
    return c.join(a.filter(F.col("atr_14").isNotNull()), "symbol").select(
        "symbol", "close", "atr_14",
        num.rounded(F.col("close") - F.col("atr_14") * stop, digits).alias("stop_loss"),
        num.rounded(F.col("close") + F.col("atr_14") * target, digits).alias("take_profit"),
    )
