"""Cross-checks of a stored table against another source. All are equi-joins on the natural key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bourselake.functions import numbers as num
from bourselake.functions.provenance import tier_of

STATEMENT_FIELDS = (
    "eps_basic", "nav_per_share", "dps", "bonus_pct", "pe_ratio", "dividend_yield", "reserve_surplus_mn", "oci_mn",
    "short_term_loan_mn", "long_term_loan_mn", "net_income_mn",
)


def paired_prices(stored: DataFrame, other: DataFrame) -> DataFrame:
    """Both sides of every (symbol, day), with flags for the side that has it."""
    a = stored.select("symbol", "date", F.col("close").alias("db_close"), F.col("source").alias("db_source"), F.lit(True).alias("in_db"))
    b = other.select("symbol", "date", F.col("close").alias("other_close"), F.lit(True).alias("in_other"))
    return a.join(b, ["symbol", "date"], "full_outer")


def _comparable():
    return F.col("db_close").isNotNull() & F.col("other_close").isNotNull()


def price_mismatches(paired: DataFrame, tolerance: float = 0.05) -> DataFrame:
    diff = F.abs(F.col("db_close") - F.col("other_close"))
    pct = F.when(F.col("other_close") != 0, num.to_fixed(diff / F.col("other_close") * 100.0, 3)).otherwise(F.lit(0.0))
    return paired.filter(_comparable() & (diff > tolerance)).select(
        "symbol", "date", "db_close", "other_close", num.to_fixed(diff, 4).alias("diff"), pct.alias("diff_pct"), "db_source"
    )


def price_check_summary(paired: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Compared, mismatching, missing and incomparable sessions in one aggregation."""
    both = F.col("in_db").isNotNull() & F.col("in_other").isNotNull()
    off = _comparable() & (F.abs(F.col("db_close") - F.col("other_close")) > tolerance)
    g = paired.agg(
        F.count_if(_comparable()).alias("compared"), F.count_if(off).alias("mismatches"), F.count_if(F.col("in_db").isNull()).alias("missing_in_db"),
        F.count_if(F.col("in_other").isNull()).alias("missing_in_other"), F.count_if(both & ~_comparable()).alias("incomparable"),
    )
    rate = F.when(F.col("compared") > 0, num.to_fixed(F.col("mismatches").cast("double") / F.col("compared").cast("double") * 100.0, 3)).otherwise(F.lit(0.0))
    return g.withColumn("mismatch_rate", rate)


def incomparable_rows(paired: DataFrame) -> DataFrame:
    both = F.col("in_db").isNotNull() & F.col("in_other").isNotNull()
    return paired.filter(both & ~_comparable()).select("symbol", "date", "db_close", "other_close")


def mismatch_by_source(paired: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Compared and mismatching sessions per stored source, with the rate."""
    off = F.abs(F.col("db_close") - F.col("other_close")) > tolerance
    g = paired.filter(_comparable()).groupBy("db_source").agg(F.count(F.lit(1)).alias("compared"), F.count_if(off).alias("mismatches"))
    return g.withColumn("rate_pct", num.to_fixed(F.col("mismatches").cast("double") / F.col("compared").cast("double") * 100.0, 3))


def yearly_sample(paired: DataFrame, k: int, tolerance: float = 0.05) -> DataFrame:
    """The first ``k`` compared rows of every year, with the verdict. Spark keeps only ``k`` rows per year and map task."""
    p = paired.filter(_comparable()).withColumn("year", F.year("date"))
    w = W.partitionBy("year").orderBy("symbol", "date")
    r = p.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)
    match = F.abs(F.col("db_close") - F.col("other_close")) <= tolerance
    return r.select("year", "symbol", "date", "db_close", "other_close", match.alias("match"))


def windowed(df: DataFrame, *, as_of, days: int) -> DataFrame:
    return df.filter(F.col("date") >= F.date_sub(F.lit(as_of).cast("date"), days))


def statement_field_diff(stored: DataFrame, other: DataFrame, fields: tuple[str, ...] = STATEMENT_FIELDS, tolerance: float = 0.011) -> DataFrame:
    """Long list of differing fields; a value against an unknown counts as a difference."""
    cells = lambda df, n: df.select("symbol", "fiscal_year", *[F.col(f).alias(f"{n}_{f}") for f in fields])
    j = cells(stored, "db").join(cells(other, "other"), ["symbol", "fiscal_year"])
    item = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"db_{f}").alias("db_value"), F.col(f"other_{f}").alias("other_value")) for f in fields]))
    d = j.select("symbol", "fiscal_year", item.alias("i")).select("symbol", "fiscal_year", "i.*")
    one_sided = F.col("db_value").isNull() != F.col("other_value").isNull()
    return d.filter(one_sided | (F.abs(F.col("db_value") - F.col("other_value")) > tolerance))


def statement_coverage(stored: DataFrame, other: DataFrame) -> DataFrame:
    a = stored.select("symbol", "fiscal_year", F.lit(1).alias("a"))
    b = other.select("symbol", "fiscal_year", F.lit(1).alias("b"))
    j = a.join(b, ["symbol", "fiscal_year"], "full_outer")
    return j.agg(
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("years_compared"), F.count_if(F.col("a").isNull()).alias("missing_in_db"),
        F.count_if(F.col("b").isNull()).alias("missing_in_other"),
    )


def index_check(index: DataFrame, live: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Official stored index days against live levels: matched, mismatched, or outside what the live source reaches."""
    first_live = live.agg(F.min("date")).first()[0]
    official = index.filter(F.col("source").isin("DSE_OFFICIAL_ARCHIVE", "DSE_OFFICIAL_BENCHMARK", "DSE_OFFICIAL_GRAPH"))
    j = official.select("date", "index_value", "source").join(live.select("date", F.col("index_value").alias("live_value")), "date", "left")
    status = (
        F.when(F.col("live_value").isNotNull() & (F.abs(F.col("live_value") - F.col("index_value")) > tolerance), "mismatch")
        .when(F.col("live_value").isNotNull(), "match")
        .when(F.col("date") < F.lit(first_live).cast("date"), "unreachable")
        .otherwise("not_in_live")
    )
    return j.withColumn("status", status)


def top_tier_only(df: DataFrame) -> DataFrame:
    return df.filter(tier_of(F.col("source")) == 1)
