"""Sorts with limits and set operations over keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def newest_rows(df: DataFrame, order: str, tie: str, n: int) -> DataFrame:
    """The newest ``n`` rows overall; each task keeps only its own top rows before the final merge."""
    return df.orderBy(F.desc(order), tie).limit(n)


def symbol_difference(live: DataFrame, roster: DataFrame) -> DataFrame:
    """Symbols on one side only, with the side that misses them."""
    a, b = live.select("symbol").distinct(), roster.select("symbol").distinct()
    return (
        a.join(b, "symbol", "left_anti").withColumn("side", F.lit("missing_from_roster"))
        .unionByName(b.join(a, "symbol", "left_anti").withColumn("side", F.lit("not_traded")))
    )


def priority_union(sources: list[DataFrame], key: list[str]) -> DataFrame:
    """Union in which an earlier source wins per key."""
    cols = [c for c in sources[0].columns if c not in key]
    tagged = [s.select(*key, F.lit(i).alias("_p"), *cols) for i, s in enumerate(sources)]
    every = reduce(DataFrame.unionByName, tagged)
    best = every.groupBy(*key).agg(F.min_by(F.struct(*cols), "_p").alias("_b"))
    return best.select(*key, "_b.*")


def distinct_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).dropDuplicates()


def common_symbols(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("symbol").intersect(b.select("symbol"))


def slices(rows: DataFrame, n: int, *keys: str | Column) -> list[DataFrame]:
    """The rows in ``n`` parts by a hash of the keys: rows of equal keys, null ones too, lie in one part."""
    return [rows] if n == 1 else [rows.filter(F.pmod(F.xxhash64(*keys), F.lit(n)) == i) for i in range(n)]
