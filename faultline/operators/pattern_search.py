"""Search with patterns that come as a table.

A line is tested only against patterns whose required text it holds.  Every
pattern names three-letter texts (grams) of which a match needs one.  Patterns
and lines of a log are dealt to the same tasks and sorted so that a task reads
the patterns of a log first, keeps them by gram, and then streams the lines.
Logs of very many lines or patterns are dealt out in parts, so a task keeps a
bounded number of patterns.  Patterns that ask all logs meet all lines that way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.literals import GRAM_CHARS, required_grams
from faultline.functions.regex import folded
from faultline.functions.text import trim_excerpt
from faultline.operators.search import SHOWN, ranked_hits
from faultline.session import write_once

_PART_LINES = 100_000  # lines that meet the same patterns in one task, about
_BLOCK_PATTERNS = 10_000  # patterns that a task keeps at once, about
ANY_LINE = ""  # gram of patterns that need no text
_PATTERN = "_p_log string, pattern string, problem string, grams array<string>"
_GROUP = ["_log", "_part", "_block"]

# Fixed start of a problem text.
INVALID = "invalid regex: "


@lru_cache(1 << 13)
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.IGNORECASE)


def read_patterns(patterns: DataFrame) -> DataFrame:
    """Distinct ``(log_id, pattern)`` with ``problem`` or required ``grams``.

    A null log_id asks all logs, a null pattern is the empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            problems, grams = [], []
            for pattern in batch.column(1).to_pylist():
                try:
                    _compiled(pattern)
                except (re.error, RecursionError, OverflowError) as error:
                    problems.append(f"{INVALID}{error}")
                    grams.append([])
                else:
                    problems.append(None)
                    grams.append(required_grams(pattern) or [ANY_LINE])
            columns = [*batch.columns, pa.array(problems, pa.string()), pa.array(grams, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["_p_log", "pattern", "problem", "grams"])

    asked = patterns.select("log_id", F.coalesce("pattern", F.lit("")).alias("pattern")).distinct()
    return asked.mapInArrow(run, _PATTERN)


def pattern_problems(patterns: DataFrame) -> DataFrame:
    """One row per pattern that does not compile, with the reason; such patterns match nothing."""
    bad = read_patterns(patterns).where("problem IS NOT NULL")
    return bad.select(F.col("_p_log").alias("log_id"), "pattern", F.col("problem").alias("error"))


def _parts(lines: DataFrame, known: DataFrame) -> DataFrame:
    """``_log, parts, blocks`` of logs whose lines or patterns are too many for one task: a short table."""
    many = lines.groupBy(F.col("log_id").alias("_log")).agg(F.count("*").alias("n")).where(f"n > {_PART_LINES}")
    asking = known.groupBy(F.col("_p_log").alias("_log")).agg(F.count("*").alias("n")).where(f"n > {_BLOCK_PATTERNS}")
    parts = many.select("_log", F.ceil(F.col("n") / _PART_LINES).alias("parts"), F.lit(1).cast("bigint").alias("blocks"))
    blocks = asking.select("_log", F.lit(1).cast("bigint").alias("parts"), F.ceil(F.col("n") / _BLOCK_PATTERNS).alias("blocks"))
    both = parts.unionByName(blocks).where("_log IS NOT NULL")
    return write_once(both.groupBy("_log").agg(F.max("parts").alias("parts"), F.max("blocks").alias("blocks")), "parts")


def _dealt(rows: DataFrame, own: str, other: str, by: list[str]) -> DataFrame:
    """Rows with ``_part`` and ``_block``: one of the count ``own`` by their hash, and a copy for each of ``other``."""
    names = {"parts": "_part", "blocks": "_block"}
    each = F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1)
    return rows.withColumn(names[own], F.pmod(F.xxhash64(*by), F.col(own))).withColumn(names[other], F.explode(each)).drop(own, other)


def _meeting(lines: DataFrame, patterns: DataFrame) -> DataFrame:
    """Lines and patterns, each with ``_log, parts, blocks``, in tasks where patterns come before the lines they meet."""
    asked = _dealt(patterns, "blocks", "parts", ["pattern"]).select(*_GROUP, "pattern", "grams")
    read = _dealt(lines, "parts", "blocks", ["log_id", "pos"])
    met = asked.unionByName(read, allowMissingColumns=True).withColumn("_line", F.col("pattern").isNull())
    return met.repartition(*_GROUP).sortWithinPartitions(*_GROUP, "_line")


class _Patterns:
    """Patterns that the lines at hand meet, by gram."""

    def __init__(self) -> None:
        self.by_gram: dict[str, list[str]] = {}

    def add(self, pattern: str, grams: list[str]) -> None:
        for gram in grams:
            self.by_gram.setdefault(gram, []).append(pattern)

    def matching(self, raw: str, letters: str) -> list[str]:
        by_gram = self.by_gram
        if len(by_gram) <= len(letters):
            held = [g for g in by_gram if g in letters]
        else:
            grams = {letters[i : i + GRAM_CHARS] for i in range(len(letters) - GRAM_CHARS + 1)}
            held = [g for g in (*grams, ANY_LINE) if g in by_gram]
        # a line that holds several grams of a pattern is tested once
        candidates = dict.fromkeys(p for g in held for p in by_gram[g])
        return [p for p in candidates if _compiled(p).search(raw)]


def search_pattern_table(entries: DataFrame, patterns: DataFrame, limit: int | None = None) -> DataFrame:
    """Matches per log and pattern: all lines, or the first ``limit``, and their number.

    ``patterns`` holds ``log_id, pattern``; the search ignores letter case and
    reads patterns as Python does.  A pattern asked for twice counts once.
    """
    known = write_once(read_patterns(patterns).where("problem IS NULL").drop("problem"), "patterns")
    lines = entries.where("raw IS NOT NULL").select("log_id", "pos", *SHOWN, "raw", folded(F.col("raw")).alias("_letters"))
    cut = F.broadcast(_parts(lines, known))
    one = {n: F.coalesce(n, F.lit(1).cast("bigint")) for n in ("parts", "blocks")}
    of_log = known.where("_p_log IS NOT NULL").withColumnRenamed("_p_log", "_log").join(cut, "_log", "left").withColumns(one)
    own = lines.where("log_id IS NOT NULL").withColumn("_log", F.col("log_id")).join(cut, "_log", "left").withColumns(one)
    met = _meeting(own, of_log)
    of_all = known.where("_p_log IS NULL")
    if asking := of_all.count():
        sizes = {
            "_log": F.lit(None).cast("string"),
            "parts": F.lit(-(-entries.count() // _PART_LINES) or 1).cast("bigint"),
            "blocks": F.lit(-(-asking // _BLOCK_PATTERNS)).cast("bigint"),
        }
        met = met.unionByName(_meeting(lines.withColumns(sizes), of_all.withColumns(sizes)))
    shown = ["log_id", "pattern", "pos", *SHOWN, "raw"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, at_hand = None, _Patterns()
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in (*_GROUP, "_line", "pattern", "grams", "raw", "_letters")]
            places, found = [], []
            for place, (log, part, block, is_line, pattern, grams, raw, letters) in enumerate(zip(*columns, strict=True)):
                if group != (log, part, block):
                    group, at_hand = (log, part, block), _Patterns()
                if not is_line:
                    at_hand.add(pattern, grams)
                elif at_hand.by_gram:
                    hits = at_hand.matching(raw, letters)
                    places += [place] * len(hits)
                    found += hits
            rows = batch.take(pa.array(places, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.string()) if n == "pattern" else rows.column(n) for n in shown], shown
            )

    kinds = dict(met.dtypes)
    hits = met.mapInArrow(run, ", ".join(f"{n} {kinds[n]}" for n in shown)).withColumn("raw", trim_excerpt(F.col("raw")))
    # a pattern of one log that is also asked of all logs finds each line twice
    twice = known.groupBy("pattern").agg(F.bool_or(F.col("_p_log").isNull()).alias("_all"), F.count("*").alias("_n"))
    if twice.where("_all AND _n > 1").limit(1).count():
        hits = hits.dropDuplicates(["log_id", "pattern", "pos"])
    if limit is None:  # sorting over all tasks reads its rows twice, to sample and to deal them out
        hits = write_once(hits, "hits")
    return ranked_hits(hits, ["log_id", "pattern"], limit)
