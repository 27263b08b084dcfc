"""Time, source and message of one log line, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.regex import extract, replace
from faultline.functions.text import first_match, strip

# ---- fixed values: shapes of times and sources, words that are no source ----

TIME_SHAPES = (
    r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?",
    r"\d{2}/[A-Z][a-z]{2}/\d{4}:\d{2}:\d{2}:\d{2}(?: [+-]\d{4})?",
    r"[A-Z][a-z]{2} [ \d]\d \d{2}:\d{2}:\d{2}",
    r"\b\d{2}:\d{2}:\d{2}(?:[.,]\d+)?\b",
)

SOURCE_SHAPES = (
    r"(?i)\b(?:service|svc|app|component|logger)[=:]\s*([\w.\-]+)",
    r"\[([a-zA-Z][\w.\-]{1,40})\]",
    r"(?:ERROR|WARN(?:ING)?|INFO|DEBUG|CRITICAL|FATAL)\s+([a-zA-Z][\w.\-]{1,40})\s+-\s",
    r"\]\s+([a-zA-Z][\w.\-]{1,40})\s+-\s",
)
# The loosest shape is trusted only near the start of the line.
LEADING_SOURCE_SHAPE = r"(?:^|\s)([a-z][\w\-]{2,30})(?:\[\d+\])?:\s"
LEADING_SOURCE_CHARS = 70

NOT_SOURCES = (
    "error", "warn", "warning", "info", "debug", "critical", "fatal", "trace", "notice",
    "statement", "duration", "detail", "hint", "context", "query", "log", "state",
    "level", "msg", "message", "line", "task", "tasks", "queued", "running", "exception",
    "caused", "reason", "status", "result", "note", "stack", "file", "at", "in", "the",
)

LEADING_LEVEL_WORD = (
    r"(?i)^(?:CRITICAL|FATAL|SEVERE|ERROR|ERR|WARNING|WARN|NOTICE|INFO|DEBUG|TRACE)\]?\s*[-:]?\s+"
)
TIME_PREFIX_CHARS = 8
TIME_SEPARATORS = " -:[]"

# ---- end of fixed values ----


def extract_time(raw: Column) -> Column:
    """Leftmost match of the first time shape that occurs; stays a string."""
    return F.coalesce(*[first_match(raw, shape) for shape in TIME_SHAPES])


def extract_source(lines: DataFrame, raw: str = "raw", to: str = "source") -> DataFrame:
    """Add the emitter named by the first shape whose leftmost hit is a usable name.

    One projection per shape, each looking only where the ones before found
    nothing: every regex runs at most once per line, and the generated methods
    stay small enough to be compiled to machine code.
    """
    text = F.col(raw)
    head = F.substring(text, 1, LEADING_SOURCE_CHARS)
    shapes = [(text, shape) for shape in SOURCE_SHAPES] + [(head, LEADING_SOURCE_SHAPE)]
    unusable = F.lower(to).isin("", *NOT_SOURCES)
    for number, (part, shape) in enumerate(shapes):
        hit = extract(part, shape, 1)
        lines = lines.withColumn(
            to, hit if number == 0 else F.when(unusable, hit).otherwise(F.col(to))
        )
    return lines.withColumn(to, F.when(~unusable, F.col(to)))


def clean_message(raw: Column, time: Column) -> Column:
    """The line without a leading time and one leading level word."""
    at = F.instr(raw, time)
    rest = F.substring(raw, at + F.length(time), F.length(raw))
    message = F.when(
        time.isNotNull() & (at <= TIME_PREFIX_CHARS), F.ltrim(rest, F.lit(TIME_SEPARATORS))
    ).otherwise(raw)
    return strip(replace(message, LEADING_LEVEL_WORD, ""))
