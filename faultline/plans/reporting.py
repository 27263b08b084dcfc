"""Whole jobs: logs in, one report per log out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.operators import reports as R
from faultline.operators.incidents import build_incidents, groups_to_fold, overall_status
from faultline.operators.parse import parse_lines
from faultline.operators.stats import line_totals, log_stats
from faultline.operators.trace import inherit_trace_level
from faultline.schemas import Limits
from faultline.session import write_once
from faultline.sources.raw_logs import split_lines


def parse_once(lines: DataFrame, loud_only: bool = False) -> DataFrame:
    """Entries of numbered raw lines, stack traces included.

    Every line is parsed once, without a shuffle, and stored; levels of traces
    are found from positions alone.  Each later step reads just the columns it
    needs.
    """
    return inherit_trace_level(write_once(parse_lines(lines, loud_only, mark=True), "lines"))


def text_entries(logs: DataFrame, loud_only: bool = False) -> DataFrame:
    """Entries of ``(log_id, text)``."""
    return parse_once(split_lines(logs), loud_only)


def analyze_logs(logs: DataFrame, entries: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Built-in analysis of every log, over all its groups unless ``limits`` says otherwise.

    Line totals and incidents are small next to the entries and read by several
    branches, so each is written once.  Incidents carry the text of their lines.
    Only structured logs may repeat a line number, so only theirs are looked up
    in the entries, of which the last one counts.  Entries parsed with
    ``loud_only`` will do.
    """
    totals = write_once(line_totals(entries), "totals")
    incidents = write_once(build_incidents(groups_to_fold(entries, limits), totals, limits), "incidents")
    listed = logs.where("kind = 'structured'").select("log_id")
    cited = incidents.join(listed, "log_id", "left_semi")
    checked = incidents.join(listed, "log_id", "left_anti").unionByName(
        R.verify_evidence(cited, entries).drop("cited_count")
    )
    status = overall_status(logs.select("log_id", "log_source").join(totals, "log_id"), incidents)
    analysed = R.assemble_result(status, checked, limits.incidents)
    return analysed.unionByName(R.empty_log_reports(R.logs_without_entries(logs, totals)))


def check_reports(
    logs: DataFrame, entries: DataFrame, candidates: DataFrame, limit: int | None = None
) -> DataFrame:
    """Reports written elsewhere, ``(log_id, attempt, content)``, made safe to publish.

    The picked reports and the counts, one row per log each, are written once:
    several branches read them.  A report keeps all its incidents, or ``limit``.
    """
    checked = R.validate_report(R.extract_report_json(candidates))
    picked = write_once(R.pick_attempt(checked), "picked")
    counted = write_once(log_stats(logs, entries).where("total_lines > 0"), "counts")
    known = logs.select("log_id", "log_source").join(counted, "log_id")
    answered = known.join(picked.drop("incidents"), "log_id", "left")
    incidents = R.penalize_unverified(
        R.verify_evidence(R.report_incidents(picked.where("attempt IS NOT NULL")), entries)
    )
    valid = R.assemble_result(answered.where("attempt IS NOT NULL"), incidents, limit)
    reason = F.when(F.col("tried"), "malformed").otherwise("unreached")
    unanswered = (
        known.join(picked.select("log_id", "attempt", F.lit(True).alias("tried")), "log_id", "left")
        .where("attempt IS NULL")
        .withColumn("reason", reason)
    )
    return (
        valid.unionByName(R.inconclusive_report(unanswered))
        .unionByName(R.empty_log_reports(R.logs_without_entries(logs, counted)))
    )
