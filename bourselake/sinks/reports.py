"""Report rows and snapshot files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def audit_report_rows(summary: DataFrame, *, run_at) -> DataFrame:
    """Audit summaries as rows of the report table; the whole summary travels along as JSON."""
    return summary.select(
        F.lit(run_at).alias("run_at"), F.col("entity").alias("target_entity"), F.col("records").alias("records_audited"), F.col("errors").alias("errors_count"),
        F.col("warnings").alias("warnings_count"), "status", F.to_json(F.struct("entity", "records", "errors", "warnings", "status")).alias("report_json"),
    )


def append_audit_report(summary: DataFrame, path: str, *, run_at) -> None:
    audit_report_rows(summary, run_at=run_at).write.mode("append").parquet(path)


def snapshot_header(screen: DataFrame) -> DataFrame:
    """Number of symbols and breadth of a screen."""
    ltp, ycp = F.col("ltp"), F.col("ycp")
    return screen.agg(
        F.count(F.lit(1)).alias("count"), F.count_if(ltp > ycp).alias("advancing"), F.count_if(ltp < ycp).alias("declining"), F.count_if(ltp == ycp).alias("unchanged")
    )


def write_snapshot_json(screen: DataFrame, path: str, *, timestamp: str, date: str) -> None:
    """A snapshot as JSON lines: one header line and one line per symbol, in separate folders.

    A single document holding every symbol would pass through one task; lines spread over part files.
    """
    head = snapshot_header(screen).select(F.lit(timestamp).alias("timestamp"), F.lit(date).alias("date"), "*")
    head.write.mode("errorifexists").json(f"{path}/header")
    screen.write.mode("errorifexists").option("ignoreNullFields", False).json(f"{path}/stocks")
