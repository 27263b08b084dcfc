"""Registered queries: every operator over corpora from the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import corpora as C
from faultline.functions import fields, levels, text
from faultline.operators import cards as K
from faultline.operators import classify as CL
from faultline.operators import groups as G
from faultline.operators import incidents as I
from faultline.operators import pattern_search as PS
from faultline.operators import procedures as PR
from faultline.operators import reports as R
from faultline.operators import search as SE
from faultline.operators import stats as ST
from faultline.operators import timeline as TL
from faultline.operators.parse import parse_lines
from faultline.plans.intake import analyze_documents, take_in
from faultline.plans.reporting import analyze_logs, check_reports, parse_once
from faultline.schemas import BRIEF
from faultline.session import scratch_path, write_once
from faultline.sources import raw_logs, routing, sinks, structured, verdicts

Query = Callable[[SparkSession, str], DataFrame]
SEARCHES = ("pool|timed out", r"\bTask\b.*failed", "econnrefused", r"status=5\d\d", "nothing matches this")
DOC_SEARCHES = (r"\b(?:die|des|été)\b", r"TASK|exit code \d")


# ------------------------------------------------------------------ inputs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines_of_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = raw_logs.split_lines(C.doc_logs(spark, sf_dir))
    return C.event_lines(spark, sf_dir).unionByName(docs)


def event_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_once(C.event_lines(spark, sf_dir))


def loud_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For queries that look at levels and at errors and warnings only."""
    return parse_once(C.event_lines(spark, sf_dir), loud_only=True)


def event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log per user, and one log without a line per event type."""
    events = table(spark, sf_dir, "events")
    status = (
        F.when(F.col("event_type") == "error", "FAIL")
        .when(F.col("event_type") == "view", "PASS")
        .when(F.col("event_type") == "click", "UNKNOWN")
    )
    with_lines = events.select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("log_id"),
        F.lit("raw").alias("kind"),
        F.lit(None).cast("string").alias("classifier_status"),
    )
    without = events.select(
        F.concat(F.lit("empty-"), "event_type").alias("log_id"),
        F.lit("verdict").alias("kind"),
        status.alias("classifier_status"),
    )
    return (
        with_lines.unionByName(without)
        .distinct()
        .withColumn("log_source", F.concat("log_id", F.lit(".log")))
    )


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.ranked_groups(loud_entries(spark, sf_dir))


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.playbook_match(ranked(spark, sf_dir))


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = loud_entries(spark, sf_dir)
    return I.merge_incidents(I.titled_groups(G.error_groups(entries)), ST.line_totals(entries))


def doc_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_once(raw_logs.split_lines(C.doc_logs(spark, sf_dir)))


def doc_log_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.doc_logs(spark, sf_dir).select(
        "log_id",
        F.concat("log_id", F.lit(".txt")).alias("log_source"),
        F.lit("raw").alias("kind"),
        F.lit(None).cast("string").alias("classifier_status"),
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.candidate_reports(spark, sf_dir)


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.validate_report(R.extract_report_json(candidates(spark, sf_dir)))


def cited_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = R.pick_attempt(checked(spark, sf_dir))
    return R.report_incidents(picked.where("attempt IS NOT NULL"))


# ------------------------------------------------------- flat result columns


def joined(column: str | Column, separator: str = ",") -> Column:
    values = F.col(column) if isinstance(column, str) else column
    return F.array_join(values.cast("array<string>"), separator)


def flat_groups(df: DataFrame) -> DataFrame:
    return df.drop("samples").withColumns(
        {"sources": joined("sources", ", "), "sample_line_numbers": joined("sample_line_numbers")}
    )


def evidence_columns() -> dict[str, Column]:
    def each(name: str) -> Column:
        values = F.transform("evidence", lambda e: F.coalesce(e[name].cast("string"), F.lit("-")))
        return F.array_join(values, "\n")

    return {
        "evidence_lines": each("line_number"),
        "evidence_text": each("raw_text"),
        "evidence_times": each("timestamp"),
        "evidence_sources": each("source"),
        "evidence_reasons": each("why_relevant"),
    }


def flat_incidents(df: DataFrame) -> DataFrame:
    return (
        df.withColumns(evidence_columns())
        .withColumns(
            {
                "possible_solutions": joined("possible_solutions", "\n"),
                "affected_sources": joined("affected_sources", ", "),
            }
        )
        .drop("evidence")
    )


def flat_results(results: DataFrame) -> DataFrame:
    """One row per incident; reports without incidents keep one row."""
    rows = results.select(
        "log_id",
        "log_source",
        "overall_status",
        "stats.*",
        F.posexplode_outer("incidents").alias("place", "inc"),
    )
    rows = rows.withColumn("place", F.col("place").cast("bigint"))
    return flat_incidents(rows.select("*", "inc.*").drop("inc"))


def flat_cards(cards: DataFrame) -> DataFrame:
    others = F.transform(
        "other_incidents", lambda o: F.concat_ws("|", o["title"], o["severity"], o["explanation"])
    )
    return cards.select(
        *[n for n in ("log_id", "parser_status", "analysed") if n in cards.columns],
        "file_name",
        "severity",
        "summary",
        "root_cause",
        joined("recommendations", "\n").alias("recommendations"),
        "confidence",
        joined(F.transform("evidence", lambda e: e["line_number"])).alias("evidence_lines"),
        joined("affected_sources", ", ").alias("affected_sources"),
        "stats.*",
        F.array_join(others, "\n").alias("other_incidents"),
    )


# ------------------------------------------------------------------ queries


def line_query(name: str, value: Callable[[Column], Column]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines = lines_of_both(spark, sf_dir)
        return lines.select("log_id", "line_number", value(F.col("raw")).alias(name))

    return run


def log_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder with one text file per user log, written from all events."""
    path = scratch_path(spark, "files")
    sinks.write_log_files(C.event_lines(spark, sf_dir), path)
    return path


def log_name(path: str) -> Column:
    return F.regexp_extract(path, "log_id=([^/]+?)(?:[.]log$|/)", 1)


def read_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = raw_logs.read_log_lines(spark, log_files(spark, sf_dir))
    return lines.select(log_name("log_id").alias("log_id"), "pos", "line_number", "raw")


def read_raw_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole files and their ``logs`` rows, joined by the log_id that both give."""
    path = log_files(spark, sf_dir)
    files = raw_logs.file_logs(spark, path).drop("log_source")
    texts = raw_logs.read_raw_logs(spark, path)
    return texts.join(files, "log_id").select(log_name("log_id").alias("log_id"), "kind", "classifier_status", "text")


def split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_logs.split_lines(C.doc_logs(spark, sf_dir)).drop("pos")


def normalize_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.level_spellings(spark, sf_dir).withColumn(
        "level", levels.level_or_info(F.col("spelling"))
    )


def infer_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lines_of_both(spark, sf_dir)
    return lines.where(levels.looks_like_error(F.col("raw"))).select("log_id", "line_number", "raw")


def infer_warning(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lines_of_both(spark, sf_dir)
    return lines.where(levels.looks_like_warning(F.col("raw"))).select("log_id", "line_number", "raw")


def extract_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.extract_source(lines_of_both(spark, sf_dir)).drop("pos", "raw")


def clean_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_lines(lines_of_both(spark, sf_dir)).select("log_id", "line_number", "message")


def parsed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_lines(lines_of_both(spark, sf_dir)).drop("pos")


def message_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = parse_lines(lines_of_both(spark, sf_dir))
    return entries.select(
        "log_id", "line_number", text.message_signature(F.col("message")).alias("signature")
    )


def read_structured_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structured.read_structured_entries(C.structured_docs(spark, sf_dir))


def structured_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structured.structured_logs(C.structured_docs(spark, sf_dir))


def coalesce_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = structured.structured_items(C.structured_docs(spark, sf_dir))
    return structured.coalesce_aliases(items.where("kind = 'OBJECT'")).drop("item", "kind")


def read_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.read_verdicts(C.verdict_docs(spark, sf_dir))


def route_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.route_inputs(C.mixed_docs(spark, sf_dir)).drop("doc")


def quarantine_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.quarantine_empty(C.uploads(spark, sf_dir)).drop("doc")


def intake_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return take_in(C.intake_docs(spark, sf_dir)).logs


def intake_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return take_in(C.intake_docs(spark, sf_dir)).entries.drop("pos")


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return take_in(C.intake_docs(spark, sf_dir)).quarantine


def conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whatever arrives is reported or quarantined."""
    return take_in(C.intake_docs(spark, sf_dir), loud_only=True).conservation()


def intake_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status and line counts of every delivered document that is not refused."""
    reports = analyze_documents(C.intake_docs(spark, sf_dir))
    return reports.select("log_id", "log_source", "stats.*", F.size("incidents").cast("bigint").alias("incidents"))


def filter_errors_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.filter_errors_warnings(loud_entries(spark, sf_dir))


def search_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SE.search_logs(event_entries(spark, sf_dir), "error|warn|fail", 5)


def search_logs_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SE.search_logs_batch(event_entries(spark, sf_dir), SEARCHES)


def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SE.search_logs_batch(doc_entries(spark, sf_dir), DOC_SEARCHES)


def search_pattern_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's own patterns in the user's log, and patterns of all logs."""
    return PS.search_pattern_table(event_entries(spark, sf_dir), C.search_patterns(spark, sf_dir))


def invalid_pattern_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PS.pattern_problems(C.search_patterns(spark, sf_dir))


def inherit_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = parse_once(lines_of_both(spark, sf_dir), loud_only=True)
    return entries.select("log_id", "line_number", "level")


def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Around the first error of each log, and one number that no log has."""
    entries = event_entries(spark, sf_dir)
    first = (
        entries.where(levels.is_error(F.col("level")))
        .groupBy("log_id")
        .agg(F.min_by("line_number", "pos").alias("center"))
    )
    centers = first.unionByName(first.select("log_id", F.lit(-100).cast("bigint").alias("center")))
    return SE.context_window(entries, centers, 15)


def first_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.first_samples(loud_entries(spark, sf_dir))


def log_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.log_stats(event_logs(spark, sf_dir), loud_entries(spark, sf_dir))


def log_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.log_overview(loud_entries(spark, sf_dir))


def error_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_groups(G.error_groups(loud_entries(spark, sf_dir)))


def error_group_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_groups(G.error_group_report(loud_entries(spark, sf_dir)))


def source_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.source_stats(event_entries(spark, sf_dir)).drop("first_pos")


def source_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.source_report(event_entries(spark, sf_dir))


def playbook_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched(spark, sf_dir).select(
        "log_id", "rank", "sample", "playbook_title", joined("solutions", "\n").alias("solutions")
    )


def known_cause_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = I.known_cause_rank(matched(spark, sf_dir))
    return ranks.select("log_id", "rank", "known", "cause_rank")


def drop_noise_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.drop_noise_warnings(ranked(spark, sf_dir)).select("log_id", "rank", "level", "count")


def fallback_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    causes = I.known_cause_rank(matched(spark, sf_dir))
    titles = I.fallback_title(I.drop_noise_warnings(causes))
    return titles.select("log_id", "rank", "cause_rank", "title")


def merge_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(spark, sf_dir).select(
        "log_id",
        "incident_rank",
        "title",
        F.col("leader.level").alias("leader_level"),
        F.col("leader.count").alias("leader_count"),
        "count",
        joined("sources", ", ").alias("sources"),
        "first_seen",
        "last_seen",
        joined("lines.line_number").alias("line_numbers"),
        "any_critical",
    )


def incident_part(step: Callable[[DataFrame], DataFrame], column: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return step(merged(spark, sf_dir)).select("log_id", "incident_rank", column)

    return run


def incident_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = I.incident_evidence(merged(spark, sf_dir))
    return cited.select(
        "log_id", "incident_rank", F.posexplode("evidence").alias("place", "cited")
    ).select("log_id", "incident_rank", F.col("place").cast("bigint").alias("place"), "cited.line_number", "cited.why_relevant")


def overall_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = loud_entries(spark, sf_dir)
    totals = write_once(ST.line_totals(entries), "totals")
    return I.overall_status(totals, I.build_incidents(G.error_groups(entries), totals))


def analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The built-in report of every log."""
    return analyze_logs(event_logs(spark, sf_dir), loud_entries(spark, sf_dir))


def incident_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_results(analysis(spark, sf_dir))


def brief_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The short form: ten groups, three incidents, shortened titles and quotes per log."""
    return flat_results(analyze_logs(event_logs(spark, sf_dir), loud_entries(spark, sf_dir), BRIEF))


def write_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports written as JSON and read back."""
    path = scratch_path(spark, "results")
    results = analysis(spark, sf_dir)
    sinks.write_results(results, path)
    return flat_results(sinks.read_results(spark, path).where("problem IS NULL"))


def summary_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.summary_line(analysis(spark, sf_dir))


def verify_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    verified = R.verify_evidence(cited_incidents(spark, sf_dir), doc_entries(spark, sf_dir))
    return verified.select("log_id", "incident_pos", "cited_count", "evidence").withColumns(
        evidence_columns()
    ).drop("evidence")


def penalize_unverified(spark: SparkSession, sf_dir: str) -> DataFrame:
    verified = R.verify_evidence(cited_incidents(spark, sf_dir), doc_entries(spark, sf_dir))
    return R.penalize_unverified(verified).select(
        "log_id", "incident_pos", "confidence", "human_explanation"
    )


def verdict_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = {n: F.lit(0).cast("bigint") for n in ("total_lines", "error_lines", "warning_lines")}
    return read_verdicts(spark, sf_dir).withColumns(none)


def verdict_only_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_results(R.verdict_only_report(verdict_logs(spark, sf_dir)))


def inconclusive_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = verdict_logs(spark, sf_dir)
    place = F.col("log_id").substr(F.lit(5), F.length("log_id")).cast("bigint") % 3
    reason = F.when(place == 0, "no_entries").when(place == 1, "malformed").otherwise("unreached")
    return flat_results(R.inconclusive_report(logs.withColumn("reason", reason)))


def extract_report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.extract_report_json(candidates(spark, sf_dir))
    title = F.try_variant_get("report", "$.incidents[0].title", "string")
    return found.select(
        "log_id", "attempt", F.col("report").isNotNull().alias("found"), title.alias("first_title")
    )


def validate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(spark, sf_dir).select(
        "log_id",
        "attempt",
        "problem",
        "overall_status",
        F.coalesce(F.size("incidents"), F.lit(0)).cast("bigint").alias("incident_count"),
    )


def pick_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pick_attempt(checked(spark, sf_dir)).drop("incidents")


def assemble_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate reports checked against the documents they speak about."""
    entries = doc_entries(spark, sf_dir)
    return flat_results(
        check_reports(doc_log_table(spark, sf_dir), entries, candidates(spark, sf_dir))
    )


def report_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_cards(K.report_cards(analysis(spark, sf_dir)))


def fallback_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs, entries = event_logs(spark, sf_dir), loud_entries(spark, sf_dir)
    spare = R.verdict_only_report(logs.join(ST.log_stats(logs, entries), "log_id"))
    cards = K.report_cards(analyze_logs(logs, entries)).where("stats.total_lines > 0")
    return K.cards_with_fallback(logs, cards, K.report_cards(spare))


def cards_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every labelled log: its analysis if it has lines, else its verdict."""
    return flat_cards(fallback_cards(spark, sf_dir))


def fallback_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.fallback_count(fallback_cards(spark, sf_dir))


def last_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CL.last_marker(C.doc_logs(spark, sf_dir)).drop("text", "doc_id")


def first_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CL.first_category(C.doc_logs(spark, sf_dir)).drop("text", "doc_id")


def classify_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CL.classify_log(C.doc_logs(spark, sf_dir)).select("log_id", "status", "category")


def classify_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CL.classify_lines(C.event_lines(spark, sf_dir))


def classify_document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as lines: the same verdicts as ``classify_log``, also where a pattern spans lines."""
    return CL.classify_lines(raw_logs.split_lines(C.doc_logs(spark, sf_dir), segments=True))


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CL.audit_classification(
        C.expected_labels(spark, sf_dir), CL.classify_log(C.doc_logs(spark, sf_dir))
    )


def audit_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CL.audit_failures(audit(spark, sf_dir))


def error_onset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PR.error_onset(loud_entries(spark, sf_dir))


def event_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = TL.event_times(event_entries(spark, sf_dir))
    return times.select("log_id", "line_number", "source", "level", F.unix_micros("event_time").alias("micros"))


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = TL.activity(TL.event_times(event_entries(spark, sf_dir)))
    return counts.select(F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "source", "level", "lines")


def pre_onset_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PR.pre_onset_context(event_entries(spark, sf_dir), 15)


def triage_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PR.triage_class(event_logs(spark, sf_dir), loud_entries(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "read_log_lines": read_log_lines,
    "read_raw_logs": read_raw_logs,
    "split_lines": split_lines,
    "read_structured_entries": read_structured_entries,
    "structured_logs": structured_logs,
    "read_verdicts": read_verdicts,
    "route_inputs": route_inputs,
    "quarantine_empty": quarantine_empty,
    "intake_logs": intake_logs,
    "intake_entries": intake_entries,
    "intake_report": intake_report,
    "quarantine": quarantine,
    "conservation": conservation,
    "write_results": write_results,
    "extract_time": line_query("time", fields.extract_time),
    "extract_short_level": line_query("level", levels.extract_short_level),
    "extract_level_token": line_query("level", levels.extract_level_token),
    "infer_error": infer_error,
    "infer_warning": infer_warning,
    "default_info": line_query("level", levels.line_level),
    "normalize_level": normalize_level,
    "extract_source": extract_source,
    "clean_message": clean_message,
    "parse_lines": parsed_lines,
    "coalesce_aliases": coalesce_aliases,
    "message_signature": message_signature,
    "trim_excerpt": line_query("excerpt", text.trim_excerpt),
    "summary_line": summary_line,
    "filter_errors_warnings": filter_errors_warnings,
    "search_logs": search_logs,
    "search_logs_batch": search_logs_batch,
    "search_documents": search_documents,
    "search_pattern_table": search_pattern_table,
    "invalid_pattern_report": invalid_pattern_report,
    "inherit_trace_level": inherit_levels,
    "context_window": context_window,
    "first_samples": first_samples,
    "log_stats": log_stats,
    "log_overview": log_overview,
    "error_groups": error_groups,
    "error_group_report": error_group_report,
    "source_stats": source_stats,
    "source_report": source_report,
    "playbook_match": playbook_match,
    "known_cause_rank": known_cause_rank,
    "drop_noise_warnings": drop_noise_warnings,
    "fallback_title": fallback_title,
    "merge_incidents": merge_incidents,
    "incident_severity": incident_part(I.incident_severity, "severity"),
    "incident_confidence": incident_part(I.incident_confidence, "confidence"),
    "incident_text": incident_part(I.incident_text, "human_explanation"),
    "incident_evidence": incident_evidence,
    "overall_status": overall_status,
    "incident_report": incident_report,
    "brief_report": brief_report,
    "verify_evidence": verify_evidence,
    "penalize_unverified": penalize_unverified,
    "verdict_only_report": verdict_only_report,
    "inconclusive_report": inconclusive_report,
    "extract_report_json": extract_report_json,
    "validate_report": validate_report,
    "pick_attempt": pick_attempt,
    "assemble_result": assemble_result,
    "report_cards": report_cards,
    "cards_with_fallback": cards_with_fallback,
    "fallback_count": fallback_count,
    "last_marker": last_marker,
    "first_category": first_category,
    "classify_log": classify_log,
    "classify_lines": classify_lines,
    "classify_document_lines": classify_document_lines,
    "audit_classification": audit,
    "audit_failures": audit_failures,
    "error_onset": error_onset,
    "pre_onset_context": pre_onset_context,
    "triage_class": triage_class,
    "event_time": event_time,
    "activity": activity,
}
