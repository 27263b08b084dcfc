"""Reports flattened to display cards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.schemas import MAX_SOLUTIONS

# ---- fixed values: display texts ----

HEALTHY_SUMMARY = "No issues found — this log looks healthy."
HEALTHY_CAUSE = "Scanned %d lines: %d errors and %d warnings, nothing actionable."
INCONCLUSIVE_SUMMARY = "Analysis inconclusive — not enough evidence to name a root cause."
INCONCLUSIVE_CAUSE = "The analysis engine could not reach a conclusion for this log."

# ---- end of fixed values ----


def report_cards(results: DataFrame) -> DataFrame:
    """Leading incident of each report with a count of the others."""
    top = F.get("incidents", F.lit(0))
    extra = F.size("incidents") - 1
    healthy = F.col("overall_status") == "healthy"
    has_top = F.size("incidents") > 0
    more = F.concat(
        F.lit(" (+"),
        extra.cast("string"),
        F.lit(" related finding"),
        F.when(extra > 1, "s").otherwise(""),
        F.lit(")"),
    )
    counts = ("stats.total_lines", "stats.error_lines", "stats.warning_lines")
    return results.select(
        "log_id",
        F.col("log_source").alias("file_name"),
        F.when(has_top, F.initcap(top["severity"])).otherwise("Low").alias("severity"),
        F.when(has_top, F.concat(top["title"], F.when(extra > 0, more).otherwise("")))
        .when(healthy, HEALTHY_SUMMARY)
        .otherwise(INCONCLUSIVE_SUMMARY)
        .alias("summary"),
        F.when(has_top, top["human_explanation"])
        .when(healthy, F.format_string(HEALTHY_CAUSE, *counts))
        .otherwise(INCONCLUSIVE_CAUSE)
        .alias("root_cause"),
        F.coalesce(
            F.slice(top["possible_solutions"], 1, MAX_SOLUTIONS), F.array().cast("array<string>")
        ).alias("recommendations"),
        top["confidence"].alias("confidence"),
        F.transform(
            top["evidence"],
            lambda e: F.struct(
                e["line_number"].alias("line_number"),
                e["raw_text"].alias("raw_text"),
                e["why_relevant"].alias("why_relevant"),
            ),
        ).alias("evidence"),
        top["affected_sources"].alias("affected_sources"),
        "stats",
        F.when(
            has_top,
            F.transform(
                F.slice("incidents", F.lit(2), F.size("incidents") - 1),
                lambda i: F.struct(
                    i["title"].alias("title"),
                    F.initcap(i["severity"]).alias("severity"),
                    i["human_explanation"].alias("explanation"),
                ),
            ),
        ).alias("other_incidents"),
    )


def cards_with_fallback(logs: DataFrame, cards: DataFrame, fallback: DataFrame) -> DataFrame:
    """The analysed card of every log where there is one, else the verdict-only card."""
    both = (
        logs.select("log_id", F.col("classifier_status").alias("parser_status"))
        .join(cards.select("log_id", F.struct(*cards.columns).alias("card")), "log_id", "left")
        .join(fallback.select("log_id", F.struct(*cards.columns).alias("spare")), "log_id", "left")
    )
    fields = [
        F.when(F.col("card").isNotNull(), F.col(f"card.{n}")).otherwise(F.col(f"spare.{n}")).alias(n)
        for n in cards.columns
        if n != "log_id"
    ]
    return both.select("log_id", "parser_status", F.col("card").isNotNull().alias("analysed"), *fields)


def fallback_count(cards: DataFrame) -> DataFrame:
    """How many logs have no analysis of their own."""
    return cards.agg(F.count("*").alias("files"), F.count_if(~F.col("analysed")).alias("failed"))
