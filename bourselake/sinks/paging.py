"""Ordered tables that are read page by page: sorted ranges of rows, and an index of how many rows come before each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_AT, _RANGE = "_at", "_range"


def write_paged(rows: DataFrame, path: str, *order: str | Column) -> None:
    """Writes ``rows`` in the order given, as ranges in folders of their own, and the page index beside them.

    The order should be total; rows that tie keep the order they were written in. The index has a row for each range, whatever the data's size.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(_AT, F.monotonically_increasing_id())
    ranged = ranged.withColumn(_RANGE, F.shiftright(_AT, 33).cast("int"))
    ranged.write.partitionBy(_RANGE).parquet(f"{path}/rows")
    ranged.limit(0).coalesce(1).write.parquet(f"{path}/schema")
    held = _rows(rows.sparkSession, path).groupBy(_RANGE).agg(F.min(_AT).alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy(F.lit(0)).orderBy(_RANGE).rowsBetween(W.unboundedPreceding, -1)
    held.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).coalesce(1).write.parquet(f"{path}/index")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{path}/schema").schema).parquet(f"{path}/rows")


def row_count(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(f"{path}/index").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_page(spark: SparkSession, path: str, page: int, size: int) -> DataFrame:
    """Page ``page`` (from 0) of ``size`` rows, in order, with ``position`` (from 0); past the end it is empty. Only the ranges it lies in are read."""
    start, end = page * size, (page + 1) * size
    index = spark.read.parquet(f"{path}/index").filter((F.col("before") < end) & (F.col("before") + F.col("n") > start))
    ranges = index.orderBy(_RANGE).collect()  # a page of fixed size lies in few ranges
    stored = _rows(spark, path).filter(F.col(_RANGE).isin([r[_RANGE] for r in ranges]))
    position = F.lit(None).cast("long")
    for r in ranges:
        position = F.when(F.col(_RANGE) == r[_RANGE], F.col(_AT) - r["first"] + r["before"]).otherwise(position)
    inside = stored.withColumn("position", position).filter((F.col("position") >= start) & (F.col("position") < end))
    return inside.drop(_AT, _RANGE).orderBy("position")
