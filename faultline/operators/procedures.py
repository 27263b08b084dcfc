"""Triage and root-cause steps as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.levels import ERROR_LEVELS, is_error, is_warning
from faultline.operators.search import DEFAULT_CONTEXT, context_window
from faultline.operators.groups import error_groups
from faultline.operators.stats import UNATTRIBUTED


def error_onset(entries: DataFrame) -> DataFrame:
    """First error of every source; the earliest of a log is the prime suspect."""
    errors = entries.where(F.col("level").isin(*ERROR_LEVELS))
    named = F.when(F.col("source") != "", F.col("source")).otherwise(UNATTRIBUTED)
    first = F.min_by(F.struct("time", "line_number"), "pos")
    onset = errors.groupBy("log_id", named.alias("source")).agg(
        F.min("pos").alias("pos"), first.alias("first")
    )
    earliest = errors.groupBy("log_id").agg(F.min("pos").alias("log_pos"))
    return onset.join(earliest, "log_id").select(
        "log_id",
        "source",
        F.col("first.time").alias("first_error_time"),
        F.col("first.line_number").alias("first_error_line"),
        (F.col("pos") == F.col("log_pos")).alias("prime_suspect"),
    )


def pre_onset_context(entries: DataFrame, n: int = DEFAULT_CONTEXT) -> DataFrame:
    """Lines just before the first error of each log, and that error."""
    centers = (
        entries.where(F.col("level").isin(*ERROR_LEVELS))
        .groupBy("log_id")
        .agg(F.min_by("line_number", "pos").alias("center"))
    )
    return (
        context_window(entries, centers, n).where(F.col("line_number") <= F.col("center")).drop("note")
    )


def triage_class(logs: DataFrame, entries: DataFrame) -> DataFrame:
    """Quiet, warnings only, one error group or a cascade; with the earliest error group."""
    error, warning = is_error(F.col("level")), is_warning(F.col("level"))
    shape = (
        error_groups(entries)
        .groupBy("log_id")
        .agg(
            F.count_if(error).alias("error_groups"),
            F.count_if(warning).alias("warning_groups"),
            F.min_by("message_signature", F.when(error, F.col("first_pos"))).alias(
                "earliest_error_group"
            ),
        )
    )
    kind = (
        F.when(F.col("error_groups") > 1, "several_groups")
        .when(F.col("error_groups") == 1, "one_group")
        .when(F.col("warning_groups") > 0, "warnings_only")
        .otherwise("none")
    )
    return (
        logs.select("log_id")
        .join(shape, "log_id", "left")
        .fillna(0, ["error_groups", "warning_groups"])
        .withColumn("triage", kind)
    )
