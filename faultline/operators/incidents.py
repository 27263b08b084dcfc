"""Error groups folded to incidents.

An incident is a title; its groups are ordered by cause.  The order is a struct
that every group carries, so a title's leading group, its totals and its lines
are plain aggregates over (log, title), with partial sums inside each task, and
no step looks at all groups of a log at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.levels import is_error
from faultline.functions.playbook import (
    GENERIC_TITLE,
    playbook_rank,
    playbook_solutions,
    playbook_title,
)
from faultline.functions.text import first_chars, none_if_empty
from faultline.operators.groups import error_groups, ranked_groups
from faultline.operators.ranking import head, numbered, placed
from faultline.operators.stats import line_totals
from faultline.schemas import Limits

MIN_WARNING_COUNT = 3
_TITLE = ["log_id", "title"]

# ---- fixed values: texts of a report ----

EVIDENCE_REASON = "Occurrence of the failing pattern this incident is based on."
TITLE_START, TITLE_MIDDLE = "Repeated ", "s: "
TEXT_START = "The logs show "
TEXT_COUNT = " occurrence(s) of this problem affecting "
TEXT_NO_SOURCE = "the logs"
TEXT_BETWEEN, TEXT_AND = " between ", " and "
TEXT_QUOTE = '. The recurring message looks like: "'
TEXT_END = (
    '". This pattern usually means the service could not do its normal work and '
    "requests started failing. The cited lines below are the concrete evidence."
)

# ---- end of fixed values ----


def playbook_match(groups: DataFrame) -> DataFrame:
    """Add the playbook's title (null without a hit) and suggested actions."""
    sample = F.coalesce(none_if_empty(F.col("sample_message")), F.col("message_signature"))
    return (
        groups.withColumn("sample", sample)
        .withColumn(
            "_entry", playbook_rank(F.concat_ws(" ", F.col("message_signature"), F.col("sample")))
        )
        .withColumns(
            {
                "playbook_title": playbook_title(F.col("_entry")),
                "solutions": playbook_solutions(F.col("_entry")),
            }
        )
        .drop("_entry")
    )


def with_cause(matched: DataFrame) -> DataFrame:
    """Add ``known`` and ``cause``, which orders the groups of a log.

    Known causes come first, then errors, then frequent groups, then the order
    of the groups, of which only the first appearance is left to compare.
    """
    known = F.coalesce(F.col("playbook_title") != GENERIC_TITLE, F.lit(False))
    cause = F.struct(
        (~known).alias("unknown"),
        (~is_error(F.col("level"))).alias("warning"),
        (-F.col("count")).alias("seldom"),
        F.col("first_pos").alias("first_pos"),
    )
    return matched.withColumns({"known": known, "cause": cause})


def known_cause_rank(matched: DataFrame) -> DataFrame:
    """Place of every group of a log by ``cause``."""
    return numbered(with_cause(matched), ["log_id"], [F.col("cause")], "cause_rank")


def drop_noise_warnings(groups: DataFrame) -> DataFrame:
    """Occasional warnings are normal operation."""
    return groups.where((F.col("level") != "WARNING") | (F.col("count") >= MIN_WARNING_COUNT))


def fallback_title(groups: DataFrame, chars: int | None = None) -> DataFrame:
    """Title of a group the playbook does not know: its level and (the start of) its sample."""
    own = F.concat(
        F.lit(TITLE_START), F.lower("level"), F.lit(TITLE_MIDDLE), first_chars(F.col("sample"), chars)
    )
    return groups.withColumn("title", F.coalesce("playbook_title", own))


def titled_groups(groups: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Groups that count, with their title and their order within the log."""
    return fallback_title(drop_noise_warnings(with_cause(playbook_match(groups))), limits.title_chars)


def incident_lines(titled: DataFrame, leaders: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """First distinct lines of each incident, ``limits.evidence`` at most, as ``place`` and ``line``.

    All samples of the leading group come first, then the first
    ``limits.later_samples`` of each other one, in the order of causes.
    """
    leading = F.col("cause") == F.col("_leader")
    sampled = (
        titled.join(leaders.select(*_TITLE, F.col("cause").alias("_leader")), _TITLE)
        .select(*_TITLE, "cause", leading.alias("_leading"), F.posexplode("samples").alias("_i", "line"))
        .where(F.col("_leading") | (F.col("_i") < limits.later_samples))
    )
    at = F.struct("cause", "_i")
    first = sampled.groupBy(*_TITLE, "line.line_number").agg(F.min(at).alias("_at"), F.min_by("line", at).alias("line"))
    return head(first, _TITLE, [F.col("_at")], limits.evidence).select(
        *_TITLE, (F.col("rank") - 1).alias("place"), "line"
    )


def merge_incidents(titled: DataFrame, totals: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per title, ``incident_rank`` by the best cause among its groups.

    The group with the best cause leads: severity, confidence and quoted text
    come from it.  The others add counts, sources, time range and lines.
    ``totals`` are the line totals of the logs.
    """
    leader = F.struct("level", "count", "sample", "known", "solutions", "first_seen", "last_seen")
    merged = titled.groupBy(*_TITLE).agg(
        F.min("cause").alias("cause"),
        F.min_by(leader, "cause").alias("leader"),
        F.sum("count").alias("count"),
        F.min(none_if_empty(F.col("first_seen"))).alias("first_seen"),
        F.max(none_if_empty(F.col("last_seen"))).alias("last_seen"),
        F.bool_or(F.col("level") == "CRITICAL").alias("any_critical"),
    )
    kept = placed(merged, ["log_id"], [F.col("cause")], limits.incidents, "incident_rank")
    sources = (
        titled.select(*_TITLE, F.explode("sources").alias("source"))
        .distinct()
        .groupBy(*_TITLE)
        .agg(F.array_sort(F.collect_list("source")).alias("sources"))
    )
    lines = (
        incident_lines(titled, merged, limits)
        .groupBy(*_TITLE)
        .agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("_lines"))
    )
    return (
        kept.join(sources, _TITLE, "left")
        .join(lines, _TITLE, "left")
        .join(totals, "log_id")
        .withColumns(
            {
                "first_seen": F.coalesce("first_seen", "leader.first_seen"),
                "last_seen": F.coalesce("last_seen", "leader.last_seen"),
                "sources": F.coalesce("sources", F.array().cast("array<string>")),
                "lines": F.transform("_lines", lambda p: p["line"]),
            }
        )
        .drop("cause", "_lines")
    )


def severity(
    level: Column, count: Column, any_critical: Column, errors: Column, total: Column
) -> Column:
    """Critical lines are critical, warnings go by count, errors by their share."""
    share = errors / F.greatest(total, F.lit(1))
    return (
        F.when(any_critical, "critical")
        .when((level != "ERROR") & (count >= MIN_WARNING_COUNT), "medium")
        .when(level != "ERROR", "low")
        .when(share >= 0.25, "critical")
        .when((share >= 0.08) | (errors >= 20), "high")
        .when((share >= 0.025) | (errors >= 5), "medium")
        .otherwise("low")
    )


def incident_severity(incidents: DataFrame) -> DataFrame:
    return incidents.withColumn(
        "severity",
        severity(
            F.col("leader.level"),
            F.col("leader.count"),
            F.col("any_critical"),
            F.col("error_lines"),
            F.col("total_lines"),
        ),
    )


def incident_confidence(incidents: DataFrame) -> DataFrame:
    known, often = F.col("leader.known"), F.col("leader.count") >= 3
    return incidents.withColumn(
        "confidence",
        F.when(known & often, 0.95).when(known, 0.9).when(often, 0.75).otherwise(0.7),
    )


def incident_text(incidents: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Explanation from count, sources, time range and the leading message."""
    affected = F.coalesce(none_if_empty(F.array_join("sources", ", ")), F.lit(TEXT_NO_SOURCE))
    span = F.when(
        F.col("first_seen") != "",
        F.concat(F.lit(TEXT_BETWEEN), "first_seen", F.lit(TEXT_AND), "last_seen"),
    ).otherwise("")
    text = F.concat(
        F.lit(TEXT_START),
        F.col("count").cast("string"),
        F.lit(TEXT_COUNT),
        affected,
        span,
        F.lit(TEXT_QUOTE),
        first_chars(F.col("leader.sample"), limits.quote_chars),
        F.lit(TEXT_END),
    )
    return incidents.withColumn("human_explanation", text)


def incident_evidence(incidents: DataFrame) -> DataFrame:
    """The incident's lines with their text, each with the reason it is cited."""
    return incidents.withColumn(
        "evidence",
        F.transform(
            "lines",
            lambda n: F.struct(
                n["line_number"].alias("line_number"),
                n["raw"].alias("raw_text"),
                n["time"].alias("timestamp"),
                n["source"].alias("source"),
                F.lit(EVIDENCE_REASON).alias("why_relevant"),
            ),
        ),
    )


def build_incidents(groups: DataFrame, totals: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Incident rows of every log, with the text of their lines, from its groups and line totals."""
    merged = merge_incidents(titled_groups(groups, limits), totals, limits)
    full = incident_evidence(incident_text(incident_confidence(incident_severity(merged)), limits))
    return full.select(
        "log_id",
        F.col("incident_rank").alias("incident_pos"),
        "title",
        "severity",
        "confidence",
        "human_explanation",
        F.col("leader.solutions").alias("possible_solutions"),
        "evidence",
        F.col("sources").alias("affected_sources"),
        "first_seen",
        "last_seen",
    )


def groups_to_fold(entries: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The groups that incidents are made of: all, or the leading ones of each log."""
    if limits.groups is None:
        return error_groups(entries, limits)
    return ranked_groups(entries, limits).drop("rank")


def log_incidents(entries: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``build_incidents`` straight from entries."""
    return build_incidents(groups_to_fold(entries, limits), line_totals(entries), limits)


def overall_status(stats: DataFrame, incidents: DataFrame) -> DataFrame:
    """Status per log: any critical incident, else any error line, else healthy."""
    critical = incidents.groupBy("log_id").agg(
        F.bool_or(F.col("severity") == "critical").alias("_critical")
    )
    status = (
        F.when(F.col("_critical"), "critical")
        .when(F.col("error_lines") > 0, "degraded")
        .otherwise("healthy")
    )
    return (
        stats.join(critical, "log_id", "left")
        .withColumn("overall_status", status)
        .drop("_critical")
    )
