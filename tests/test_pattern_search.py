"""Patterns from a table against testing every line with every pattern."""

import random
import re

import pytest

from faultline.functions.literals import required_grams
from faultline.operators import pattern_search as P
from faultline.plans.reporting import text_entries

PATTERNS = [
    r"pool|timed out", r"\bTask\b.*failed", "econnrefused", r"status=5\d\d", r"(a|b)cde?f", r"abc{2}d", "ab?cdef",
    r"[abc]+xyz\.q", r"(?i)abc", r"\x41bcd", "a|bcd", "x{2,}yyyy", r"abc{", r"(foo|bar)", r"abc(def)?ghi", r"(?P<n>x)abcd(?P=n)",
    r"\(abc\)", "", "été abc", r"^\s*$", "größe", "task", "KELVIN", "straße", r"a[]x]bcd", r"a[^]]bcd", "(?x) a b c", r"\bdisk\b|\bioerr",
    "(", "[z-a]", "*", "a{3}{2}", "ab\\",
]
PIECES = [
    "pool", "Timed Out", "task", " failed", "ECONNREFUSED", "status=5", "0", "03", "acdf", "bcde", "f", "abccd", "abcd", "acdef", "abcdef",
    "cxyz.q", "xyzq", "ABC", "Abcd", "xx", "yyyy", "abc{", "foo", "abcghi", "abcdefghi", "xabcdx", "(abc)", "été abc", " ", "Größe", "tasK",
    "KELVIN", "ſtatuſ=500", "dıſK", "ioerr", "🙂", "straſse", "STRAẞE", "]bcd", "a]bcd",
]


def test_grams_are_in_every_match():
    dice = random.Random(1)
    for pattern in PATTERNS[:-5]:
        grams = required_grams(pattern)
        for _ in range(3_000):
            line = "".join(dice.choices(PIECES, k=dice.randrange(1, 6)))
            if grams and re.search(pattern, line, re.IGNORECASE):
                folded = line.translate(str.maketrans("ſıİK", "siik")).lower()
                assert any(g in folded for g in grams), (pattern, line)


@pytest.mark.parametrize("limit", [None, 2])
def test_search_equals_testing_everything(spark, limit, monkeypatch):
    monkeypatch.setattr(P, "_BLOCK_PATTERNS", 2)
    dice = random.Random(2)
    texts = {f"log{i}": ["".join(dice.choices(PIECES, k=dice.randrange(1, 7))) for _ in range(60)] for i in range(4)}
    logs = spark.createDataFrame([(n, "\n".join(t)) for n, t in texts.items()], "log_id string, text string")
    asked = {(dice.choice([None, *texts, "gone"]), p) for p in PATTERNS for _ in range(2)} | {("log0", p) for p in PATTERNS} | {(None, "pool|timed out")}
    patterns = spark.createDataFrame([*asked, *asked, ("log1", None)], "log_id string, pattern string")
    asked.add(("log1", ""))
    valid, broken = set(), set()
    for log, pattern in asked:
        try:
            re.compile(pattern)
            valid.add((log, pattern))
        except re.error:
            broken.add((log, pattern))
    expected = set()
    for log, lines in texts.items():
        for pattern in {p for x, p in valid if x in (None, log)}:
            hits = [i + 1 for i, line in enumerate(lines) if line.strip() and re.search(pattern, line, re.IGNORECASE)]
            expected |= {(log, pattern, n, rank, len(hits)) for rank, n in enumerate(hits[:limit], 1)}
    found = P.search_pattern_table(text_entries(logs), patterns, limit).collect()
    assert len(found) == len(expected)
    assert {(r.log_id, r.pattern, r.line_number, r.rank, r.total_matches) for r in found} == expected
    problems = P.pattern_problems(patterns).collect()
    assert {(r.log_id, r.pattern) for r in problems} == broken and all(r.error.startswith("invalid regex: ") for r in problems)


def test_empty_tables(spark):
    logs = spark.createDataFrame([("a", "x\ny")], "log_id string, text string")
    patterns = spark.createDataFrame([("a", "x")], "log_id string, pattern string")
    entries = text_entries(logs)
    assert P.search_pattern_table(entries.limit(0), patterns).count() == 0
    assert P.search_pattern_table(entries, patterns.limit(0)).count() == 0


def test_lines_meet_their_patterns_in_parts_and_once(spark, monkeypatch):
    monkeypatch.setattr(P, "_BLOCK_PATTERNS", 3)
    monkeypatch.setattr(P, "_PART_LINES", 7)
    dice = random.Random(3)
    rows = [(log, n, "".join(dice.choices(PIECES, k=dice.randrange(1, 7)))) for log, lines in (("big", 90), ("small", 5), (None, 20)) for n in range(lines)]
    entries = spark.createDataFrame(
        [(log, n, n + 1, "INFO", None, None, raw) for log, n, raw in rows],
        "log_id string, pos bigint, line_number bigint, level string, time string, source string, raw string",
    )
    asked = {(log, p) for log in ("big", "small", None) for p in PATTERNS[:-5] if dice.random() < 0.6}
    expected = {(log, p, n) for log, n, raw in rows for of, p in asked if of in (None, log) and re.search(p, raw, re.IGNORECASE)}
    patterns = spark.createDataFrame([*asked], "log_id string, pattern string")
    found = P.search_pattern_table(entries, patterns, 1000)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan  # nothing runs once for each letter of a line
    found = found.collect()
    assert len(found) == len(expected) and {(r.log_id, r.pattern, r.line_number - 1) for r in found} == expected
