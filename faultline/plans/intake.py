"""From delivered documents to logs, entries and a quarantine; nothing gets lost on the way."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.plans.reporting import analyze_logs, parse_once
from faultline.schemas import ENTRY_FIELDS, LOGS, Limits
from faultline.session import write_once
from faultline.sources.raw_logs import split_lines
from faultline.sources.routing import quarantine_empty, route_inputs
from faultline.sources.structured import read_structured_entries, structured_logs
from faultline.sources.verdicts import read_verdicts

# Reason for documents that cannot be told apart.
NO_LOG_ID = "document has no log_id"
#: Kinds of documents that become a log.
REPORTED = ("raw", "structured", "verdict")


@dataclass(frozen=True)
class Intake:
    """``logs`` and ``entries`` to work with; ``quarantine`` holds what was refused, with the reason.

    ``routed`` has every document once, with its kind; ``items`` every element
    of a structured document, with the problem of those that are no entry.
    """

    routed: DataFrame
    items: DataFrame
    logs: DataFrame
    entries: DataFrame
    quarantine: DataFrame

    def conservation(self) -> DataFrame:
        """Documents and list items by kind: how many came in, were taken over and refused.

        Counts of what came in are taken before, the others after the split, so
        ``arrived = reported + quarantined`` is a check and no identity.
        """
        arrived = self.routed.groupBy("kind").agg(F.count("*").alias("arrived"))
        logs = self.logs.groupBy("kind").agg(F.count("*").alias("reported"))
        refused = self.quarantine.where("pos IS NULL").groupBy("kind").agg(F.count("*").alias("quarantined"))
        taken = self.entries.where("kind = 'structured'").agg(F.count("*").alias("reported"))
        bad = self.quarantine.where("pos IS NOT NULL").agg(F.count("*").alias("quarantined"))
        items = self.items.agg(F.count("*").alias("arrived"))
        parts = [
            arrived, logs, refused,
            *(df.withColumn("kind", F.lit("item")) for df in (items, taken, bad)),
        ]
        counts = ("arrived", "reported", "quarantined")
        whole = [p.select("kind", *(F.col(c) if c in p.columns else F.lit(0).cast("bigint").alias(c) for c in counts)) for p in parts]
        merged = whole[0]
        for part in whole[1:]:
            merged = merged.unionByName(part)
        return (
            merged.groupBy("kind")
            .agg(*(F.sum(c).alias(c) for c in counts))
            .withColumn("balanced", F.col("arrived") == F.col("reported") + F.col("quarantined"))
        )


def take_in(docs: DataFrame, loud_only: bool = False) -> Intake:
    """Sort ``(log_id, log_source, origin, doc)`` in one pass and read each kind.

    Documents are parsed for their shape once and stored by kind, so each reader
    scans its own folder.  Empty documents, shapes that no reader knows and
    documents without log_id go to quarantine, and so do single list items
    that are no entry.  Log_ids are expected to be unique.
    """
    whole = quarantine_empty(docs.select("log_id", "log_source", "origin", "doc"))
    unnamed = F.when(F.col("log_id").isNull(), NO_LOG_ID)
    refused = whole.withColumn("_refused", F.coalesce(unnamed, "problem")).drop("problem")
    kind = F.when(F.col("_refused").isNotNull(), "reject").otherwise(F.col("kind"))
    routed = write_once(
        route_inputs(refused)
        .withColumns({"kind": kind, "problem": F.coalesce("_refused", "problem")})
        .drop("_refused"),
        "routed",
        by=["kind"],
    )

    raw, listed, verdicts = (routed.where(F.col("kind") == kind) for kind in REPORTED)
    logs = (
        raw.select("log_id", "log_source", "kind", F.lit(None).cast("string").alias("classifier_status"))
        .unionByName(structured_logs(listed).select(*LOGS.fieldNames()))
        .unionByName(read_verdicts(verdicts).select(*LOGS.fieldNames()))
    )
    items = write_once(read_structured_entries(listed), "items")
    lines = split_lines(raw.select("log_id", F.col("doc").alias("text")))
    entries = (
        parse_once(lines, loud_only)
        .select(*ENTRY_FIELDS, F.lit("raw").alias("kind"))
        .unionByName(items.where("problem IS NULL").select(*ENTRY_FIELDS, F.lit("structured").alias("kind")))
    )
    nothing = F.lit(None).cast("bigint").alias("pos")
    quarantine = (
        routed.where("kind = 'reject'")
        .select("log_id", nothing, "kind", "problem", F.col("doc").alias("content"))
        .unionByName(
            items.where("problem IS NOT NULL").select(
                "log_id", "pos", F.lit("item").alias("kind"), "problem", F.col("raw").alias("content")
            )
        )
    )
    return Intake(routed, items, logs, entries, quarantine)


def analyze_documents(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One report per delivered document that is not refused."""
    intake = take_in(docs, loud_only=True)
    return analyze_logs(intake.logs, intake.entries.drop("kind"), limits)
