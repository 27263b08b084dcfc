"""Reports written elsewhere, checked against the log they speak about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import variants as V
from faultline.functions.text import first_match, strip
from faultline.operators.lookup import only_wanted
from faultline.operators.ranking import head
from faultline.schemas import (
    EVIDENCE,
    INCIDENT,
    INCIDENT_FIELDS,
    MAX_SOLUTIONS,
    SEVERITIES,
    STATUSES,
)
from faultline.session import write_once

UNVERIFIED_CONFIDENCE = 0.3

# ---- fixed values: texts of reports that no model wrote ----

UNVERIFIED_NOTE = (
    " (Note: the cited log lines could not be verified against the input, so treat this "
    "finding with caution.)"
)
VERDICT_TITLE = "Classifier flagged this log as %s"
VERDICT_EXPLANATION = (
    "The upstream classifier marked '%s' as %s, but no per-line log entries were provided, "
    "so the root cause cannot be determined from this input alone. Re-submit the raw log "
    "file (or the parser's per-entry JSON) to get a full analysis with evidence."
)
VERDICT_SOLUTIONS = (
    "Re-run the analysis with the raw log file so the agent can inspect individual lines.",
    "Upgrade the parser call to return per-entry JSON (time, file, status, description).",
)
INCONCLUSIVE_TITLE = "Analysis could not be completed"
NO_ENTRIES = (
    "The input contained no log entries, so there is nothing to analyze.",
    ("Check that the log file is not empty and was uploaded correctly.",),
)
MALFORMED = (
    "The analysis engine produced a malformed report twice, so no conclusion is available "
    "for this run.",
    (
        "Re-run the analysis.",
        "If this repeats, check the model deployment configuration.",
    ),
)
UNREACHED = (
    "The analysis engine (LLM) could not be reached, so the log was not investigated. "
    "Technical detail: no report was delivered",
    (
        "Check the report writer's configuration and network access.",
        "Run the built-in analysis, which needs no report.",
    ),
)

# ---- end of fixed values ----


def extract_report_json(candidates: DataFrame) -> DataFrame:
    """Add ``report``: the JSON object inside ``content``, or null.

    A fenced object wins; otherwise the text from the first ``{`` to the last
    ``}`` counts.
    """
    body = F.coalesce(
        first_match(F.col("_text"), r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1), F.col("_text")
    )
    start = F.locate("{", F.col("_body"))
    end = F.length("_body") - F.locate("}", F.reverse("_body")) + 1
    closed = (start > 0) & F.col("_body").contains("}") & (end > start)
    json_text = F.substring(F.col("_body"), start, end - start + 1)
    return (
        candidates.withColumn("_text", strip(F.col("content")))
        .withColumn("_body", body)
        .withColumn("report", F.when(closed, V.parse_document(json_text)))
        .drop("_text", "_body")
    )


def _is_string(parent: Column, key: str) -> Column:
    return V.is_kind(V.child(parent, key), "STRING")


def _is_optional_string(parent: Column, key: str) -> Column:
    return F.coalesce(V.kind(V.child(parent, key)).isin("STRING", "VOID"), F.lit(True))


def _absent(parent: Column, key: str) -> Column:
    return V.kind(V.child(parent, key)).isNull()


def _all_strings(parent: Column, key: str) -> Column:
    values = V.items(V.child(parent, key))
    return F.coalesce(F.forall(values, lambda v: V.is_kind(v, "STRING")), F.lit(False))


def _valid_evidence(item: Column) -> Column:
    return (
        V.is_kind(item, "OBJECT")
        & V.is_whole_number(V.child(item, "line_number"))
        & _is_string(item, "why_relevant")
        & (_absent(item, "raw_text") | _is_string(item, "raw_text"))
        & _is_optional_string(item, "timestamp")
        & _is_optional_string(item, "source")
    )


def _incident_problem(inc: Column) -> Column:
    """First rule the incident breaks, or null."""
    severity = V.string(V.child(inc, "severity"))
    confidence = V.real_number(V.child(inc, "confidence"))
    solutions = F.size(V.items(V.child(inc, "possible_solutions")))
    evidence = V.child(inc, "evidence")
    rules = (
        ("incident is not an object", V.is_kind(inc, "OBJECT")),
        ("title", _is_string(inc, "title")),
        ("severity", _is_string(inc, "severity") & severity.isin(*SEVERITIES)),
        ("confidence", F.coalesce(confidence.between(0.0, 1.0), F.lit(False))),
        ("human_explanation", _is_string(inc, "human_explanation")),
        (
            "possible_solutions",
            _all_strings(inc, "possible_solutions") & solutions.between(1, MAX_SOLUTIONS),
        ),
        (
            "evidence",
            _absent(inc, "evidence")
            | F.coalesce(F.forall(V.items(evidence), _valid_evidence), F.lit(False)),
        ),
        ("affected_sources", _absent(inc, "affected_sources") | _all_strings(inc, "affected_sources")),
        ("first_seen", _is_optional_string(inc, "first_seen")),
        ("last_seen", _is_optional_string(inc, "last_seen")),
    )
    return F.coalesce(*[F.when(~ok, name) for name, ok in rules])


def _read_incident(inc: Column) -> Column:
    def text(key: str) -> Column:
        return V.string(V.child(inc, key)).alias(key)

    def texts(key: str) -> Column:
        read = F.transform(V.items(V.child(inc, key)), V.string)
        return F.coalesce(read, F.array().cast("array<string>")).alias(key)

    cited = F.transform(
        V.items(V.child(inc, "evidence")),
        lambda e: F.struct(
            V.whole_number(V.child(e, "line_number")).alias("line_number"),
            V.string(V.child(e, "why_relevant")).alias("why_relevant"),
        ),
    )
    return F.struct(
        text("title"),
        text("severity"),
        V.real_number(V.child(inc, "confidence")).alias("confidence"),
        text("human_explanation"),
        texts("possible_solutions"),
        F.coalesce(
            cited, F.array().cast("array<struct<line_number:bigint,why_relevant:string>>")
        ).alias("evidence"),
        texts("affected_sources"),
        text("first_seen"),
        text("last_seen"),
    )


def validate_report(extracted: DataFrame) -> DataFrame:
    """Add ``problem`` (null if valid), ``overall_status`` and typed ``incidents``.

    One bad incident fails the report.  Missing incidents, an empty object or an
    empty string are an empty list, a missing status is inconclusive.
    """
    report = F.col("report")
    status = V.child(report, "overall_status")
    incidents = V.child(report, "incidents")
    listed = V.items(incidents)
    nothing = V.is_kind(incidents, "OBJECT", "STRING") & V.string(incidents).isin("{}", "")
    bad_incidents = F.array_compact(F.transform(listed, _incident_problem))
    problem = (
        F.when(~V.is_kind(report, "OBJECT"), "no JSON object found")
        .when(V.kind(incidents).isNotNull() & ~V.is_kind(incidents, "ARRAY") & ~nothing, "incidents")
        .when(F.size(bad_incidents) > 0, F.get(bad_incidents, 0))
        .when(
            V.kind(status).isNotNull()
            & ~(V.is_kind(status, "STRING") & V.string(status).isin(*STATUSES)),
            "overall_status",
        )
    )
    valid = F.col("problem").isNull()
    return (
        extracted.withColumn("problem", problem)
        .withColumns(
            {
                "overall_status": F.when(
                    valid, F.coalesce(V.string(status), F.lit("inconclusive"))
                ),
                "incidents": F.when(
                    valid & listed.isNotNull(), F.transform(listed, _read_incident)
                ),
            }
        )
        .drop("report")
    )


def pick_attempt(checked: DataFrame, limit: int | None = None) -> DataFrame:
    """First valid report per log, among all attempts or the first ``limit``.

    ``attempt`` is null when none is valid.
    """
    tried = checked if limit is None else head(checked, ["log_id"], [F.col("attempt")], limit)
    best = F.struct("attempt", "overall_status", "incidents")
    return (
        tried.groupBy("log_id")
        .agg(F.min_by(best, F.when(F.col("problem").isNull(), F.col("attempt"))).alias("best"))
        .select("log_id", "best.*")
    )


def report_incidents(picked: DataFrame) -> DataFrame:
    """Incident rows of the picked reports, numbered as written."""
    return picked.select("log_id", F.posexplode("incidents").alias("incident_pos", "inc")).select(
        "log_id", (F.col("incident_pos") + 1).cast("bigint").alias("incident_pos"), "inc.*"
    )


def verify_evidence(incidents: DataFrame, entries: DataFrame) -> DataFrame:
    """Keep citations of lines that exist and take their text from the entries.

    Entries are reduced to cited lines where they are read, so no other text
    moves.  Of repeated line numbers the last entry counts.
    """
    line = F.col("cited.line_number")
    cited = incidents.select(
        "log_id", "incident_pos", F.posexplode("evidence").alias("evidence_pos", "cited")
    ).select("log_id", "incident_pos", "evidence_pos", line.alias("line_number"), "cited.why_relevant")
    wanted = write_once(cited.select("log_id", "line_number").distinct(), "cited")
    lines = entries.select("log_id", "line_number", "pos", "raw", "time", "source")
    facts = (
        only_wanted(lines, wanted, ["log_id", "line_number"])
        .groupBy("log_id", "line_number")
        .agg(F.max_by(F.struct("raw", "time", "source"), "pos").alias("fact"))
    )
    verified = (
        cited.join(facts, ["log_id", "line_number"])
        .groupBy("log_id", "incident_pos")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "evidence_pos",
                        F.struct(
                            "line_number",
                            F.col("fact.raw").alias("raw_text"),
                            F.col("fact.time").alias("timestamp"),
                            F.col("fact.source").alias("source"),
                            "why_relevant",
                        ).alias("item"),
                    )
                )
            ).alias("verified")
        )
    )
    kept = F.coalesce(F.transform("verified", lambda v: v["item"]), F.array().cast(EVIDENCE))
    return (
        incidents.withColumn("cited_count", F.size("evidence").cast("bigint"))
        .drop("evidence")
        .join(verified, ["log_id", "incident_pos"], "left")
        .withColumn("evidence", kept)
        .drop("verified")
    )


def penalize_unverified(verified: DataFrame) -> DataFrame:
    """Incidents that lost all their citations get low confidence and a caution."""
    lost = (F.col("cited_count") > 0) & (F.size("evidence") == 0)
    return verified.withColumns(
        {
            "confidence": F.when(
                lost, F.least("confidence", F.lit(UNVERIFIED_CONFIDENCE))
            ).otherwise(F.col("confidence")),
            "human_explanation": F.when(
                lost, F.concat("human_explanation", F.lit(UNVERIFIED_NOTE))
            ).otherwise(F.col("human_explanation")),
        }
    ).drop("cited_count")


def _stats() -> Column:
    return F.struct(
        F.col("total_lines"), F.col("error_lines"), F.col("warning_lines")
    ).alias("stats")


def _no_incidents() -> Column:
    return F.array().cast(f"array<{INCIDENT.simpleString()}>")


def assemble_result(status: DataFrame, incidents: DataFrame, limit: int | None = None) -> DataFrame:
    """Nested report per log: incidents by severity, confidence, order; all, or ``limit`` at most.

    ``status`` holds ``log_id, log_source, overall_status`` and the line counts.
    """
    weight = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    order = {"weight": weight, "doubt": -F.col("confidence"), "pos": F.col("incident_pos")}
    leading = incidents if limit is None else head(incidents, ["log_id"], list(order.values()), limit)
    place = [c.alias(n) for n, c in order.items()]
    nested = leading.groupBy("log_id").agg(
        F.array_sort(
            F.collect_list(F.struct(*place, F.struct(*INCIDENT_FIELDS).alias("incident")))
        ).alias("ranked")
    )
    listed = F.coalesce(F.transform("ranked", lambda r: r["incident"]), _no_incidents())
    return status.join(nested, "log_id", "left").select(
        "log_id", "log_source", "overall_status", _stats(), listed.alias("incidents")
    )


def _single_incident(
    title: Column, severity: Column, confidence: float, text: Column, solutions: Column
) -> Column:
    nothing = F.lit(None).cast("string")
    return F.array(
        F.struct(
            title.alias("title"),
            severity.alias("severity"),
            F.lit(confidence).alias("confidence"),
            text.alias("human_explanation"),
            solutions.alias("possible_solutions"),
            F.array().cast(EVIDENCE).alias("evidence"),
            F.array().cast("array<string>").alias("affected_sources"),
            nothing.alias("first_seen"),
            nothing.alias("last_seen"),
        )
    )


def _fixed_list(items: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, items[:MAX_SOLUTIONS]))


def logs_without_entries(logs: DataFrame, stats: DataFrame) -> DataFrame:
    """Logs for which no line was counted, with zero counts."""
    return logs.join(stats, "log_id", "left_anti").withColumns(
        {name: F.lit(0).cast("bigint") for name in ("total_lines", "error_lines", "warning_lines")}
    )


def verdict_only_report(empty_logs: DataFrame) -> DataFrame:
    """Reports for logs of which only a classifier status is known."""
    verdict = F.col("classifier_status")
    failed = verdict == "FAIL"
    incident = _single_incident(
        F.format_string(VERDICT_TITLE, verdict),
        F.when(failed, "medium").otherwise("low"),
        0.3,
        F.format_string(VERDICT_EXPLANATION, F.col("log_source"), verdict),
        _fixed_list(VERDICT_SOLUTIONS),
    )
    passed = verdict == "PASS"
    return empty_logs.where(verdict != "").select(
        "log_id",
        "log_source",
        F.when(passed, "healthy").when(failed, "degraded").otherwise("inconclusive").alias(
            "overall_status"
        ),
        _stats(),
        F.when(passed, _no_incidents()).otherwise(incident).alias("incidents"),
    )


def inconclusive_report(logs: DataFrame) -> DataFrame:
    """Reports for logs with a ``reason``: no_entries, malformed or unreached."""
    reasons = {"no_entries": NO_ENTRIES, "malformed": MALFORMED, "unreached": UNREACHED}
    reason = F.col("reason")
    text = F.coalesce(*[F.when(reason == k, t) for k, (t, _) in reasons.items()])
    steps = F.coalesce(*[F.when(reason == k, _fixed_list(s)) for k, (_, s) in reasons.items()])
    incident = _single_incident(F.lit(INCONCLUSIVE_TITLE), F.lit("low"), 0.0, text, steps)
    return logs.select(
        "log_id",
        "log_source",
        F.lit("inconclusive").alias("overall_status"),
        _stats(),
        incident.alias("incidents"),
    )


def empty_log_reports(empty_logs: DataFrame) -> DataFrame:
    """Verdict-only or inconclusive report for every log without entries."""
    unknown = empty_logs.where(F.coalesce("classifier_status", F.lit("")) == "").withColumn(
        "reason", F.lit("no_entries")
    )
    return verdict_only_report(empty_logs).unionByName(inconclusive_report(unknown))


def summary_line(results: DataFrame) -> DataFrame:
    """One line of text per report."""
    return results.select(
        "log_id",
        F.concat(
            F.upper("overall_status"),
            F.lit(" — "),
            F.size("incidents").cast("string"),
            F.lit(" incident(s), "),
            F.col("stats.error_lines").cast("string"),
            F.lit(" errors / "),
            F.col("stats.warning_lines").cast("string"),
            F.lit(" warnings in "),
            F.col("stats.total_lines").cast("string"),
            F.lit(" lines"),
        ).alias("summary"),
    )
