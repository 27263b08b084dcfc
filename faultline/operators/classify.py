"""Whole-log verdicts: PASS or FAIL and a failure category."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.regex import extract, folded, matches
from faultline.operators.trace import CHUNK_LINES

# ---- fixed values: end-of-run markers and category patterns, in order ----

PASS_MARKERS = ("Marking task as SUCCESS", "Task exited with return code 0")
FAIL_MARKERS = (
    "Marking task as FAILED",
    "Task failed with exception",
    r"Task exited with return code [1-9]\d*",
)

CATEGORIES = (
    ("SQL_SCHEMA_ERROR", (r'relation "[^"]+" does not exist', r"column [a-z0-9_.]+ does not exist", r"UndefinedTable", r"UndefinedColumn")),
    ("SQL_SYNTAX_ERROR", (r"syntax error at or near", r"psycopg2\.errors\.SyntaxError")),
    ("SQL_TYPE_MISMATCH", (r"operator does not exist:", r"cannot be matched", r"is of type [a-z]+ but expression is of type [a-z]+", r"psycopg2\.errors\.UndefinedFunction")),
    ("DB_RESOURCE_EXHAUSTION", (r"high VMem usage", r"out of memory", r"OOM", r"memory limit")),
    ("DB_CONNECTION_ERROR", (r"connection to server [^\n]* failed", r"remaining connection slots are reserved", r"could not connect", r"connection reset", r"broken pipe", r"OperationalError")),
    ("PERMISSION_ERROR", (r"permission denied", r"InsufficientPrivilege", r"forbidden", r"unauthorized")),
    ("MODULE_IMPORT_ERROR", (r"No module named", r"ImportError", r"ModuleNotFoundError")),
    ("TIMEOUT", (r"timed out", r"timeout", r"execution timeout", r"deadline exceeded")),
    ("RETURN_CODE_FAILURE", (r"Task exited with return code [1-9]\d*", r"exit code [1-9]\d*")),
)

GENERIC_FAILURE = "FAILURE_GENERIC"
UNKNOWN = "UNKNOWN"

# ---- end of fixed values ----

# The two patterns that a line break can fall into, taken apart there: a quoted name may hold
# any break, a server's name any but a line feed.
_NAME_OPENS, _NAME_CLOSES = r'(?i)relation "[^"]*$', r'(?i)^[^"]*" does not exist'
_SERVER_OPENS, _SERVER_CLOSES = "connection to server ", " failed"
_RANKS = {name: number for number, (name, _) in enumerate(CATEGORIES, start=1)}


def _any_of(text: Column, patterns: Sequence[str]) -> Column:
    return matches(text, "(?i)" + "|".join(patterns))


def last_match(text: Column, patterns: Sequence[str]) -> Column:
    """Start of the last match of any pattern, from 0; -1 without a match."""
    upto = extract(text, rf"(?is)^(.*)(?:{'|'.join(patterns)})", 1)
    return F.when(_any_of(text, patterns), F.length(upto)).otherwise(-1).cast("bigint")


def last_marker(logs: DataFrame) -> DataFrame:
    """Add the positions of the last PASS and the last FAIL marker."""
    text = F.col("text")
    return logs.withColumns(
        {
            "pass_pos": last_match(text, PASS_MARKERS),
            "fail_pos": last_match(text, FAIL_MARKERS),
        }
    )


def category_rank(text: Column) -> Column:
    """Number (from 1) of the first category with a matching pattern, or null."""
    tests = [
        F.when(_any_of(text, patterns), number)
        for number, (_, patterns) in enumerate(CATEGORIES, start=1)
    ]
    return F.coalesce(*tests)


def _category(rank: Column, failed: Column) -> Column:
    named = F.get(F.array(*[F.lit(name) for name, _ in CATEGORIES]), rank - 1)
    return F.coalesce(named, F.when(failed, GENERIC_FAILURE), F.lit(UNKNOWN))


def first_category(logs: DataFrame) -> DataFrame:
    """Add the first category that matches anywhere in the text."""
    text = F.col("text")
    return logs.withColumn(
        "category", _category(category_rank(text), _any_of(text, FAIL_MARKERS))
    )


def _verdict(passed: Column, category: Column) -> dict[str, Column]:
    return {
        "status": F.when(passed, "PASS").otherwise("FAIL"),
        "category": F.when(passed, "PASS").otherwise(category),
    }


def classify_log(logs: DataFrame) -> DataFrame:
    """``(log_id, text)`` to status and category; the later marker decides."""
    passed = (F.col("pass_pos") >= 0) & (F.col("pass_pos") >= F.col("fail_pos"))
    marked = last_marker(logs)
    category = _category(category_rank(F.col("text")), F.col("fail_pos") >= 0)
    return marked.withColumns(_verdict(passed, category)).drop("text")


def _names_across_lines(lines: DataFrame, chunk_lines: int) -> DataFrame:
    """``log_id, rank`` of logs in which a quoted name begins in one line and ends in a later one.

    Of the lines that hold a quote, the one before must leave a name open.
    Only their positions move, and a chunk of a log needs one number from the
    chunks before it.
    """
    raw = F.col("raw")
    quoted = lines.where(raw.contains('"')).select(
        "log_id",
        "pos",
        F.expr(f"floor(pos / {chunk_lines})").alias("chunk"),
        (F.col("pos") * 2 + matches(raw, _NAME_OPENS).cast("bigint")).alias("opens"),
        matches(raw, _NAME_CLOSES).alias("closes"),
    )
    earlier = Window.partitionBy("log_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        quoted.groupBy("log_id", "chunk")
        .agg(F.max("opens").alias("last"))
        .select("log_id", "chunk", F.max("last").over(earlier).alias("carried"))
    )
    above = Window.partitionBy("log_id", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return (
        quoted.withColumn("above", F.max("opens").over(above))
        .join(carried, ["log_id", "chunk"])
        .where(F.col("closes") & (F.coalesce("above", "carried") % 2 == 1))
        .select("log_id", F.lit(_RANKS["SQL_SCHEMA_ERROR"]).alias("rank"))
    )


def _servers_across_lines(lines: DataFrame) -> DataFrame:
    """``log_id, rank`` of logs in which a failed connection is broken within a segment."""
    low = folded(F.col("raw"))
    return (
        lines.groupBy("log_id", "segment")
        .agg(
            F.min(F.when(low.contains(_SERVER_OPENS), F.col("pos"))).alias("opens"),
            F.max(F.when(low.contains(_SERVER_CLOSES), F.col("pos"))).alias("closes"),
        )
        .where("opens < closes")
        .select("log_id", F.lit(_RANKS["DB_CONNECTION_ERROR"]).alias("rank"))
    )


def classify_lines(lines: DataFrame, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """Verdicts from ``(log_id, pos, raw)``, for logs of any size; equal to ``classify_log``.

    Every line is reduced to numbers, and those are aggregated per log.  Where
    a pattern spans lines, its two ends are found apart.  Lines are taken to be
    parted by line feeds unless a column ``segment`` tells which are not
    (``split_lines``).
    """
    raw = F.col("raw")
    markers = lines.select(
        "log_id",
        "pos",
        category_rank(raw).alias("rank"),
        last_match(raw, PASS_MARKERS).alias("pass_at"),
        last_match(raw, FAIL_MARKERS).alias("fail_at"),
    )

    # 2 * pos, plus 1 for the marker that comes last in its line: plain numbers,
    # so the partial aggregation runs on a hash map.
    def place(at: str, other: str) -> Column:
        return F.when(
            F.col(at) >= 0, F.col("pos") * 2 + (F.col(at) > F.col(other)).cast("bigint")
        )

    spanning = _names_across_lines(lines, chunk_lines)
    if "segment" in lines.columns:
        spanning = spanning.unionByName(_servers_across_lines(lines))
    across = spanning.groupBy("log_id").agg(F.min("rank").alias("across"))
    per_log = (
        markers.groupBy("log_id")
        .agg(
            F.min("rank").alias("rank"),
            F.max(place("pass_at", "fail_at")).alias("passed"),
            F.max(place("fail_at", "pass_at")).alias("failed"),
        )
        .join(across, "log_id", "left")
        .withColumn("rank", F.least("rank", "across"))
    )
    passed = F.col("passed").isNotNull() & (
        F.col("failed").isNull() | (F.col("passed") > F.col("failed"))
    )
    category = _category(F.col("rank"), F.col("failed").isNotNull())
    return per_log.select(
        "log_id", *[c.alias(name) for name, c in _verdict(passed, category).items()]
    )


def audit_classification(expected: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Compare ``(log_id, status, category)`` labels with verdicts; a missing log fails."""
    found = verdicts.select(
        "log_id", F.col("status").alias("actual_status"), F.col("category").alias("actual_category")
    )
    return expected.join(found, "log_id", "left").withColumn(
        "ok",
        F.col("status").eqNullSafe(F.col("actual_status"))
        & F.col("category").eqNullSafe(F.col("actual_category")),
    )


def audit_failures(audit: DataFrame) -> DataFrame:
    return audit.agg(
        F.count("*").alias("logs"), F.count_if(~F.col("ok")).alias("failures")
    )
