"""Lines to typed entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.fields import clean_message, extract_source, extract_time
from faultline.functions.levels import (
    ERROR_LEVELS,
    WARNING_LEVELS,
    line_level,
)
from faultline.operators.trace import continues_trace
from faultline.schemas import ENTRY_FIELDS


def parse_lines(lines: DataFrame, loud_only: bool = False, mark: bool = False) -> DataFrame:
    """Add time, source, level and message to ``(log_id, pos, line_number, raw)``.

    Projections only: no shuffle, and a column nobody reads is never computed.
    With ``loud_only``, lines that can be neither error nor warning keep only
    their level: raw, time, source and message are null.  Error groups and
    incidents never look at those, and skipping them saves most of the work and
    of the bytes moved.  With ``mark``, ``continuation`` tells which lines may
    belong to a stack trace.
    """
    raw = F.col("raw")
    levelled = lines.withColumn("level", line_level(raw)).withColumn(
        "continuation", continues_trace(F.col("level"), raw)
    )
    loud = F.col("level").isin(*ERROR_LEVELS, *WARNING_LEVELS) | F.col("continuation")
    text = F.col("_text")
    timed = levelled.withColumn("_text", F.when(loud, raw) if loud_only else raw).withColumn(
        "time", extract_time(text)
    )
    with_message = timed.withColumn("message", clean_message(text, F.col("time")))
    return extract_source(with_message, "_text").withColumn("raw", text).select(
        *ENTRY_FIELDS, *(["continuation"] if mark else [])
    )
