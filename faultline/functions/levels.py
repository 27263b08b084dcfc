"""Severity level of one log line, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.functions.regex import contains_any, matches
from faultline.functions.text import first_match, none_if_empty, strip

# ---- fixed values: level names, aliases and the patterns that find them ----

LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")
ERROR_LEVELS = ("ERROR", "CRITICAL")
WARNING_LEVELS = ("WARNING",)

LEVEL_ALIASES = {
    "WARN": "WARNING",
    "ERR": "ERROR",
    "FATAL": "CRITICAL",
    "CRIT": "CRITICAL",
    "PANIC": "CRITICAL",
    "EMERG": "CRITICAL",
    "ALERT": "CRITICAL",
    "TRACE": "DEBUG",
    "NOTICE": "INFO",
    "FAIL": "ERROR",
    "SEVERE": "ERROR",
}

SHORT_LEVELS = {
    "F": "CRITICAL",
    "C": "CRITICAL",
    "E": "ERROR",
    "W": "WARNING",
    "N": "INFO",
    "I": "INFO",
    "D": "DEBUG",
    "T": "DEBUG",
}

SHORT_LEVEL = r"(?i)\b(?:lvl|level|sev|severity)\s*[=:]\s*([EWIDFCTN])\b"
LEVEL_TOKEN = (
    r"(?i)(?:^|[\s\[\(:])(?:level[=:]\s*)?"
    r"(CRITICAL|CRIT|PANIC|EMERG|ALERT|FATAL|SEVERE|ERROR|ERR|WARNING|WARN|NOTICE|INFO|DEBUG|TRACE)"
    r"(?:[\s\]\):=,]|$)"
)
HTTP_5XX = r'(?:"\s*|status[=: ])(5\d{2})\b'
HTTP_4XX = r'(?:"\s*|status[=: ])(4\d{2})\b'
EXCEPTION_WORD = r"\w(?:Exception|Error)\b"
TRACEBACK_HEADER = "Traceback (most recent call last)"
SEVERE_EVENTS = (
    "out of memory", "killed process", "no space left on device", "kernel panic",
    "segmentation fault", "segfault", "read-only file system", "i/o error",
)
CONTINUATION = (
    r"(?i)^\s+\S|^Traceback \(most recent call last\)|^Caused by:|^\w[\w.]*(?:Error|Exception)\b"
)

# ---- end of fixed values ----


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.create_map(*pairs)[key]


def normalize_level(value: Column) -> Column:
    """Map any spelling to one of the five levels; unknown or missing is INFO."""
    table = LEVEL_ALIASES | {name: name for name in LEVELS}
    return F.coalesce(_lookup(table, F.upper(strip(value))), F.lit("INFO"))


def extract_short_level(raw: Column) -> Column:
    """Level behind a one-letter key such as ``lvl=E``; null without one."""
    return _lookup(SHORT_LEVELS, F.upper(first_match(raw, SHORT_LEVEL, 1)))


def extract_level_token(raw: Column) -> Column:
    """Level of the leftmost delimited level word; null without one."""
    table = LEVEL_ALIASES | {name: name for name in LEVELS}
    return _lookup(table, F.upper(first_match(raw, LEVEL_TOKEN, 1)))


def looks_like_error(raw: Column) -> Column:
    """HTTP 5xx, an exception name, a traceback header or a severe system event."""
    # The substring tests are cheap and spare most lines the regexes.
    names_exception = (raw.contains("Exception") | raw.contains("Error")) & matches(
        raw, EXCEPTION_WORD
    )
    return (
        (_may_hold_status(raw) & matches(raw, HTTP_5XX))
        | names_exception
        | raw.contains(TRACEBACK_HEADER)
        | contains_any(raw, SEVERE_EVENTS)
    )


def _may_hold_status(raw: Column) -> Column:
    return raw.contains('"') | raw.contains("status")


def looks_like_warning(raw: Column) -> Column:
    """HTTP 4xx."""
    return _may_hold_status(raw) & matches(raw, HTTP_4XX)


def infer_error(raw: Column) -> Column:
    return F.when(looks_like_error(raw), F.lit("ERROR"))


def infer_warning(raw: Column) -> Column:
    return F.when(looks_like_warning(raw), F.lit("WARNING"))


def line_level(raw: Column) -> Column:
    """Explicit short level, else level word, else a guess from the text, else INFO."""
    return F.coalesce(
        extract_short_level(raw),
        extract_level_token(raw),
        infer_error(raw),
        infer_warning(raw),
        F.lit("INFO"),
    )


def is_continuation(raw: Column) -> Column:
    """Indented line, traceback header, ``Caused by:`` or leading exception name."""
    return matches(raw, CONTINUATION)


def is_error(level: Column) -> Column:
    return level.isin(*ERROR_LEVELS)


def is_warning(level: Column) -> Column:
    return level.isin(*WARNING_LEVELS)


def level_or_info(value: Column) -> Column:
    """``normalize_level`` for tolerant input, where an empty level also means INFO."""
    return normalize_level(none_if_empty(value))
