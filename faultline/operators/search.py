"""Regex search over raw lines and context around lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.text import trim_excerpt
from faultline.operators.ranking import head_with_totals, numbered
from faultline.operators.trace import CHUNK_LINES

DEFAULT_CONTEXT = 5
SHOWN = ["line_number", "level", "time", "source"]

# Fixed text of a center without lines.
NOT_FOUND = "line %d not found in input"


def _search_regex(pattern: str) -> str:
    # any case, with Unicode classes for \w, \d, \s and \b
    return f"(?iU){pattern}"


def ranked_hits(hits: DataFrame, keys: Sequence[str], limit: int | None) -> DataFrame:
    """Hits by position with ``rank`` and ``total_matches`` of their key: all, or the first ``limit``."""
    if limit is None:
        return numbered(hits, keys, [F.col("pos")], total="total_matches").drop("pos")
    return head_with_totals(
        hits,
        keys,
        [F.col("pos")],
        max(1, int(limit)),
        {"total_matches": F.lit(1)},
        [F.expr(f"pos div {CHUNK_LINES}"), F.expr(f"pos div {CHUNK_LINES * 1024}")],
    ).drop("pos")


def search_logs_batch(
    entries: DataFrame, patterns: Sequence[str], limit: int | None = None
) -> DataFrame:
    """Matches of several patterns per log and pattern: all lines, or the first ``limit``, and their number.

    All patterns are tested in one pass over the lines.  They are constants of
    the plan, so each is compiled once per task and no join is needed.
    """
    tests = [
        F.when(F.col("raw").rlike(_search_regex(p)), F.lit(p)) for p in dict.fromkeys(patterns)
    ]
    hits = entries.select(
        "log_id",
        F.explode(F.array_compact(F.array(*tests))).alias("pattern"),
        "pos",
        *SHOWN,
        trim_excerpt(F.col("raw")).alias("raw"),
    )
    return ranked_hits(hits, ["log_id", "pattern"], limit)


def search_logs(entries: DataFrame, pattern: str, limit: int | None = None) -> DataFrame:
    """Matches of one pattern per log; see ``search_logs_batch``."""
    return search_logs_batch(entries.where(F.col("raw").rlike(_search_regex(pattern))), [pattern], limit)


def context_window(
    entries: DataFrame, centers: DataFrame, n: int = DEFAULT_CONTEXT
) -> DataFrame:
    """Lines within ``n`` numbers of each ``(log_id, center)``; a center asked for twice counts once.

    The wanted numbers are listed per center, so the lookup is an equi-join and
    not a range join; they filter the entries before any text moves.  A center
    without any line keeps one row with a note.
    """
    n = max(1, int(n))
    asked = centers.select("log_id", "center").distinct()
    around = asked.select(
        "log_id",
        "center",
        F.explode(F.sequence(F.col("center") - n, F.col("center") + n)).alias("line_number"),
    )
    found = around.join(
        entries.select("log_id", *SHOWN, trim_excerpt(F.col("raw")).alias("raw")),
        ["log_id", "line_number"],
    )
    missing = F.format_string(NOT_FOUND, F.col("center"))
    return asked.join(found, ["log_id", "center"], "left").select(
        "log_id",
        "center",
        *SHOWN,
        "raw",
        F.when(F.col("line_number").isNull(), missing).alias("note"),
    )
