"""Exact joins and order statistics for groups that may be far too large for one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BINS_PER_DOUBLING = 64
SALTS = 64


def salted_join(rows: DataFrame, totals: DataFrame, on: str, spread_by: str, salts: int = SALTS) -> DataFrame:
    """Inner join of many rows with one row per ``on``, where a single ``on`` may hold a third of the rows.

    Rows spread over ``salts`` parts by the hash of ``spread_by``, and each total is repeated once per part, so
    the join needs neither a size guess for a broadcast nor a lucky key distribution.
    """
    salt = F.pmod(F.hash(spread_by), F.lit(salts))
    repeated = totals.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", salt).join(repeated, [on, "_salt"]).drop("_salt")


def count_above(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Each row plus ``above`` (rows of its group with a strictly greater positive ``value``) and ``group_size``.

    A rank window over the group would put a large sector into one task. Here equal values collapse first, values fall
    into fixed logarithmic bins, bin totals (a bounded number per group) give the rows in higher bins, and only rows
    of the same bin are ranked together. The bin of a value depends on the value alone, so a recomputed task agrees.
    """
    slot = F.floor(F.log2(F.col(value)) * BINS_PER_DOUBLING)
    counts = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n")).withColumn("_bin", slot)
    bins = counts.groupBy(*group, "_bin").agg(F.sum("_n").alias("_in_bin"))
    higher = W.partitionBy(*group).orderBy(F.desc("_bin")).rowsBetween(W.unboundedPreceding, -1)
    bins = bins.select(
        *group, "_bin", F.coalesce(F.sum("_in_bin").over(higher), F.lit(0)).alias("_higher"),
        F.sum("_in_bin").over(W.partitionBy(*group)).alias("group_size"),
    )
    inside = W.partitionBy(*group, "_bin").orderBy(F.desc(value)).rowsBetween(W.unboundedPreceding, -1)
    ranked = counts.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(bins, [*group, "_bin"])
    ranks = ranked.select(*group, value, (F.col("_higher") + F.col("_inside")).alias("above"), "group_size")
    return df.join(ranks, [*group, value])
