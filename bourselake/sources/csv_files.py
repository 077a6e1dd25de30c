"""Price and index CSV files of several layouts, read as text columns and typed by name."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from bourselake.functions import numbers as num
from bourselake.functions.dates import normalize_date
from bourselake.functions.provenance import clean_symbol, resolve_alias

# First day of the price and index archive.
ARCHIVE_START = "2013-01-01"


def read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text under their normalised header names; a byte-order mark and quotes are dropped."""
    df = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("encoding", "UTF-8").csv(path)
    return normalize_headers(df)


def normalize_headers(df: DataFrame) -> DataFrame:
    """Lower case, blanks to underscores, everything else that is not a letter, digit or underscore dropped."""
    names = [re.sub(r"[^a-z0-9_]", "", re.sub(r"\s+", "_", c.strip().lower())) for c in df.columns]
    return df.toDF(*names)


def _first(df: DataFrame, *names: str) -> Column:
    """The first of several column names that exists and is not empty."""
    found = [F.nullif(F.col(n), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def price_rows(raw: DataFrame, active: DataFrame | None = None, *, start: str = ARCHIVE_START, source: str = "MENDELEY") -> DataFrame:
    """Typed price rows of active symbols; a row without a day, before ``start`` or without a real close is dropped."""
    volume = num.clean_num(_first(raw, "volume"))
    rows = raw.select(
        resolve_alias(clean_symbol(_first(raw, "trading_code", "symbol"))).alias("symbol"),
        normalize_date(_first(raw, "date")).alias("date"),
        *[num.clean_num(_first(raw, c)).alias(c) for c in ("open", "high", "low", "close")],
        F.floor(volume + 0.5).alias("volume"), F.lit(source).alias("source"),
    )
    rows = rows.filter((F.col("symbol") != "") & (F.col("date") >= F.lit(start).cast("date")) & (F.col("close") > 0))
    return rows if active is None else rows.join(active.select("symbol").distinct(), "symbol", "left_semi")


def index_rows(raw: DataFrame, label: str, *, start: str = ARCHIVE_START, source: str = "MENDELEY") -> DataFrame:
    """Typed index rows; the level is in ``close`` or ``price``, the volume in ``volume`` or ``vol``."""
    volume = num.clean_num(_first(raw, "volume", "vol"))
    rows = raw.select(
        normalize_date(_first(raw, "date")).alias("date"), F.lit(label).alias("index_label"), num.clean_num(_first(raw, "close", "price")).alias("index_value"),
        *[num.clean_num(_first(raw, c)).alias(f"index_{c}") for c in ("open", "high", "low")],
        F.floor(volume + 0.5).alias("total_volume"), F.lit(source).alias("source"),
    )
    return rows.filter((F.col("date") >= F.lit(start).cast("date")) & (F.col("index_value") > 0))


def read_prices_csv(spark: SparkSession, path: str, active: DataFrame | None = None, **options) -> DataFrame:
    return price_rows(read_text_csv(spark, path), active, **options)


def read_index_csv(spark: SparkSession, path: str, label: str, **options) -> DataFrame:
    return index_rows(read_text_csv(spark, path), label, **options)


#: Why a line is no price row, in the order in which it is looked for.
MALFORMED, NO_SYMBOL, NO_DAY, BEFORE_START, NO_CLOSE = "malformed", "no_symbol", "no_day", "before_start", "no_close"


def read_lines_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every line of CSV files but their headers: the text columns of read_text_csv, with ``_file``, ``_line`` and ``_torn``.

    A line with another number of cells than the header, or with a quote that never ends, is torn; nothing is dropped. Cells do not
    reach across lines. Of several files all have the header of the first.
    """
    columns = spark.read.option("header", True).csv(path).columns
    schema = StructType([StructField(f"c{i}", StringType()) for i in range(len(columns))] + [StructField("_torn", StringType())])
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("_file"), F.regexp_replace("value", "^\ufeff", "").alias("_line"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_torn", "escape": '"'}
    cells = F.from_csv("_line", ", ".join(f"{f.name} string" for f in schema), options)
    plain = normalize_headers(spark.createDataFrame([], StructType([StructField(c, StringType()) for c in columns]))).columns
    header = F.transform(F.array(*[F.col(f"cells.c{i}") for i in range(len(columns))]), lambda c: F.coalesce(c, F.lit("")))
    named = lines.select("_file", "_line", cells.alias("cells")).filter((F.trim("_line") != "") & (header != F.array(*[F.lit(c.lstrip("\ufeff")) for c in columns])))
    return named.select(*[F.col(f"cells.c{i}").alias(n) for i, n in enumerate(plain)], "_file", "_line", F.col("cells._torn").isNotNull().alias("_torn"))


def read_prices_with_rejects(spark: SparkSession, path: str, active: DataFrame | None = None, *, start: str = ARCHIVE_START, **options) -> tuple[DataFrame, DataFrame]:
    """(price rows, rejects): each line of the files is a row of read_prices_csv, or a reject (file, line, reason), or of a symbol that is not active."""
    lines = read_lines_csv(spark, path)
    close, day = num.clean_num(_first(lines, "close")), normalize_date(_first(lines, "date"))
    reason = (
        F.when(F.col("_torn"), MALFORMED)
        .when(F.coalesce(resolve_alias(clean_symbol(_first(lines, "trading_code", "symbol"))), F.lit("")) == "", NO_SYMBOL)
        .when(day.isNull(), NO_DAY)
        .when(day < F.lit(start).cast("date"), BEFORE_START)
        .when(~F.coalesce(close > 0, F.lit(False)), NO_CLOSE)
    )
    lines = lines.withColumn("_reason", reason)
    rejects = lines.filter("_reason is not null").select(F.col("_file").alias("file"), F.col("_line").alias("line"), F.col("_reason").alias("reason"))
    return price_rows(lines.filter("_reason is null"), active, start=start, **options), rejects


def read_symbol_list(spark: SparkSession, path: str) -> DataFrame:
    """Symbols of a JSON list file ``{"symbols": [...]}``."""
    return spark.read.option("multiLine", True).json(path).select(F.explode("symbols").alias("symbol"))


def active_symbols(roster: DataFrame) -> DataFrame:
    return roster.filter("is_active").select("symbol")
