"""Line counts per log and activity per source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.levels import is_error, is_warning
from faultline.operators.ranking import placed

# Fixed text for lines without a source.
UNATTRIBUTED = "(unattributed)"


def line_totals(entries: DataFrame) -> DataFrame:
    """Total, error and warning lines of every log with entries."""
    return entries.groupBy("log_id").agg(
        F.count("*").alias("total_lines"),
        F.count_if(is_error(F.col("level"))).alias("error_lines"),
        F.count_if(is_warning(F.col("level"))).alias("warning_lines"),
    )


def log_stats(logs: DataFrame, entries: DataFrame) -> DataFrame:
    """``line_totals`` of every log; logs without entries count 0."""
    return (
        logs.select("log_id")
        .join(line_totals(entries), "log_id", "left")
        .fillna(0, ["total_lines", "error_lines", "warning_lines"])
    )


def log_overview(entries: DataFrame) -> DataFrame:
    """Counts plus the first and last line number by position."""
    return entries.groupBy("log_id").agg(
        F.count("*").alias("total_lines"),
        F.count_if(is_error(F.col("level"))).alias("error_lines"),
        F.count_if(is_warning(F.col("level"))).alias("warning_lines"),
        F.min_by("line_number", "pos").alias("first_line"),
        F.max_by("line_number", "pos").alias("last_line"),
    )


# Rates that lie half way between two thousandths and whose nearest double is
# rounded down when rounding exactly: numerators over 2000.
_HALF_DOWN = [n for n in range(1, 2000, 2) if round(n / 2000, 3) < n / 2000]


def _rate(part: Column, whole: Column) -> Column:
    """``part / whole`` to three places, rounded on the exact binary value."""
    halves = F.when(F.pmod(part * 2000, whole) == 0, (part * 2000 / whole).cast("bigint"))
    return F.when(halves.isin(_HALF_DOWN), (halves - 1) / 2000).otherwise(
        F.round(part / whole, 3)
    )


def source_stats(entries: DataFrame) -> DataFrame:
    """Volume, errors, warnings, error rate and active time range per source."""
    timed = F.when(F.col("time") != "", F.struct("pos", "time"))
    named = F.when(F.col("source") != "", F.col("source")).otherwise(UNATTRIBUTED)
    return (
        entries.groupBy("log_id", named.alias("source"))
        .agg(
            F.count("*").alias("total"),
            F.count_if(is_error(F.col("level"))).alias("errors"),
            F.count_if(is_warning(F.col("level"))).alias("warnings"),
            F.min(timed)["time"].alias("first_seen"),
            F.max(timed)["time"].alias("last_seen"),
            F.min("pos").alias("first_pos"),
        )
        .withColumn("error_rate", _rate(F.col("errors"), F.col("total")))
    )


def source_report(entries: DataFrame, limit: int | None = None) -> DataFrame:
    """Sources by errors, volume, first appearance: all, or ``limit`` per log and how many that leaves out."""
    sources = source_stats(entries)
    order = [F.col("errors").desc(), F.col("total").desc(), F.col("first_pos")]
    report = placed(sources, ["log_id"], order, limit)
    if limit is None:
        truncated = F.lit(0).cast("bigint")
    else:
        report = report.join(sources.groupBy("log_id").agg(F.count("*").alias("_sources")), "log_id")
        truncated = F.greatest(F.lit(0), F.col("_sources") - limit)
    return report.withColumn("sources_truncated", truncated).drop("_sources", "first_pos")
