"""Column contracts shared by the operators.

``entries``: one row per log line.  ``pos`` orders the lines of a log;
``line_number`` is what people cite and may have gaps or repeats.
``logs``: one row per log, kept even when the log has no entries.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

ENTRIES = T.StructType(
    [
        T.StructField("log_id", T.StringType()),
        T.StructField("pos", T.LongType()),
        T.StructField("line_number", T.LongType()),
        T.StructField("raw", T.StringType()),
        T.StructField("time", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("message", T.StringType()),
    ]
)

LOGS = T.StructType(
    [
        T.StructField("log_id", T.StringType()),
        T.StructField("log_source", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("classifier_status", T.StringType()),
    ]
)

EVIDENCE = T.ArrayType(
    T.StructType(
        [
            T.StructField("line_number", T.LongType()),
            T.StructField("raw_text", T.StringType()),
            T.StructField("timestamp", T.StringType()),
            T.StructField("source", T.StringType()),
            T.StructField("why_relevant", T.StringType()),
        ]
    )
)

# One finding of a report, in the order its fields are published.
INCIDENT = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("human_explanation", T.StringType()),
        T.StructField("possible_solutions", T.ArrayType(T.StringType())),
        T.StructField("evidence", EVIDENCE),
        T.StructField("affected_sources", T.ArrayType(T.StringType())),
        T.StructField("first_seen", T.StringType()),
        T.StructField("last_seen", T.StringType()),
    ]
)

# A published report: what is written, and what is read back.
REPORT = T.StructType(
    [
        T.StructField("analysis_id", T.StringType()),
        T.StructField("generated_at", T.StringType()),
        T.StructField("log_id", T.StringType()),
        T.StructField("log_source", T.StringType()),
        T.StructField("overall_status", T.StringType()),
        T.StructField(
            "stats",
            T.StructType([T.StructField(n, T.LongType()) for n in ("total_lines", "error_lines", "warning_lines")]),
        ),
        T.StructField("incidents", T.ArrayType(INCIDENT)),
        T.StructField("run_id", T.StringType()),
    ]
)

INCIDENT_FIELDS = INCIDENT.fieldNames()
ENTRY_FIELDS = ENTRIES.fieldNames()

SEVERITIES = ("critical", "high", "medium", "low")
STATUSES = ("critical", "degraded", "healthy", "inconclusive")
MAX_SOLUTIONS = 3


@dataclass(frozen=True)
class Limits:
    """How much of a result is kept, per log or per row of it; None keeps everything.

    Groups, incidents and titles are never cut unless a caller asks for it.
    Sample lines and evidence are the first lines of a group, by definition few.
    """

    groups: int | None = None
    signature_chars: int | None = None
    samples: int = 5
    later_samples: int = 2  # lines an incident takes from each group but its leading one
    evidence: int = 4
    incidents: int | None = None
    title_chars: int | None = None
    quote_chars: int | None = None


#: The fixed sizes of a short report, for readers and models with little room.
BRIEF = Limits(groups=10, signature_chars=160, incidents=3, title_chars=60, quote_chars=120)
