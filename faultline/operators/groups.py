"""Error and warning lines grouped by message signature."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.levels import ERROR_LEVELS, WARNING_LEVELS, is_error
from faultline.functions.text import message_signature, trim_excerpt
from faultline.operators.ranking import head, placed
from faultline.operators.stats import line_totals
from faultline.operators.trace import CHUNK_LINES
from faultline.schemas import Limits

_CHUNKS_PER_SPAN = 1024
_KEY = ["log_id", "level", "message_signature"]


def filter_errors_warnings(entries: DataFrame) -> DataFrame:
    return entries.where(F.col("level").isin(*ERROR_LEVELS, *WARNING_LEVELS))


def first_samples(entries: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """First lines of each group by position, one row per sample."""
    loud = filter_errors_warnings(entries).select(
        "log_id",
        "level",
        message_signature(F.col("message"), limits.signature_chars).alias("message_signature"),
        "pos",
        "line_number",
    )
    return head(loud, _KEY, [F.col("pos")], limits.samples).drop("pos")


def _merge(parts: DataFrame, samples: int, *by: str) -> DataFrame:
    return parts.groupBy(*_KEY, *by).agg(
        F.sum("count").alias("count"),
        F.min("first_entry").alias("first_entry"),
        F.min("first_timed").alias("first_timed"),
        F.max("last_timed").alias("last_timed"),
        F.array_distinct(F.flatten(F.collect_list("sources"))).alias("sources"),
        F.slice(F.array_sort(F.flatten(F.collect_list("samples"))), 1, samples).alias("samples"),
    )


def error_groups(entries: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Error and warning groups: count, sources, time range, sample message, first lines with their text.

    Lines are reduced first inside chunks of a log, then inside spans of
    chunks, then per group: a list that is collected never holds more than one
    chunk's lines or a few samples per chunk, however large the log is.  Every
    step aggregates inside the task before it shuffles.
    """
    timed = F.struct("pos", "time")
    lines = filter_errors_warnings(entries).select(
        "log_id",
        "level",
        message_signature(F.col("message"), limits.signature_chars).alias("message_signature"),
        F.expr(f"pos div {CHUNK_LINES}").alias("_chunk"),
        "pos",
        "line_number",
        "raw",
        "time",
        "source",
        trim_excerpt(F.col("message")).alias("message"),
    )
    sample = F.struct("pos", "line_number", "raw", "time", "source")
    in_chunk = lines.groupBy(*_KEY, "_chunk").agg(
        F.count("*").alias("count"),
        F.min(F.struct("pos", "message", "time")).alias("first_entry"),
        F.min(F.when(F.col("time").isNotNull(), timed)).alias("first_timed"),
        F.max(F.when(F.col("time") != "", timed)).alias("last_timed"),
        F.collect_set(F.when(F.col("source") != "", F.col("source"))).alias("sources"),
        F.slice(F.array_sort(F.collect_list(sample)), 1, limits.samples).alias("samples"),
    )
    spans = in_chunk.withColumn("_span", F.expr(f"_chunk div {_CHUNKS_PER_SPAN}"))
    return _merge(_merge(spans, limits.samples, "_span"), limits.samples).select(
        *_KEY,
        "count",
        F.array_sort("sources").alias("sources"),
        F.col("first_timed.time").alias("first_seen"),
        F.coalesce("last_timed.time", "first_entry.time").alias("last_seen"),
        F.col("first_entry.message").alias("sample_message"),
        F.transform("samples", lambda s: s["line_number"]).alias("sample_line_numbers"),
        F.transform("samples", lambda s: s.dropFields("pos")).alias("samples"),
        F.col("first_entry.pos").alias("first_pos"),
    )


def ranked_groups(entries: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Groups with their ``rank`` in the log: errors first, then count, then first appearance."""
    order = [F.when(is_error(F.col("level")), 0).otherwise(1), F.col("count").desc(), F.col("first_pos")]
    return placed(error_groups(entries, limits), ["log_id"], order, limits.groups)


def error_group_report(entries: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Ranked groups with the log's line totals and the number of groups a limit left out."""
    report = ranked_groups(entries, limits)
    if limits.groups is None:
        truncated = F.lit(0).cast("bigint")
    else:
        counted = error_groups(entries, limits).groupBy("log_id").agg(F.count("*").alias("_groups"))
        report = report.join(counted, "log_id")
        truncated = F.greatest(F.lit(0), F.col("_groups") - limits.groups)
    return (
        report.join(line_totals(entries), "log_id")
        .withColumn("groups_truncated", truncated)
        .drop("_groups", "first_pos", "samples")
    )
