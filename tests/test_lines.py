"""Line parsing and level inheritance on hand-made lines."""

import random

from pyspark.sql import functions as F

from faultline.functions import regex, text
from faultline.operators.parse import parse_lines
from faultline.operators import trace
from faultline.operators.trace import inherit_trace_level
from faultline.plans.reporting import text_entries
from faultline.session import write_once


def parse(spark, content):
    logs = spark.createDataFrame([("log", content)], "log_id string, text string")
    return text_entries(logs).orderBy("pos").collect()


def test_every_common_shape(spark):
    lines = [
        "2026-01-05T08:02:14Z ERROR [billing-service] pool exhausted",
        "2026-01-05 08:02:14,120 WARN  app.worker - slow call",
        '10.0.0.1 - - [05/Jan/2026:08:02:14 +0000] "GET /x HTTP/1.1" 504 12',
        '10.0.0.1 - - [05/Jan/2026:08:02:14 +0000] "GET /x HTTP/1.1" 404 12',
        "Jan  5 08:02:05 db-01 postgres[991]: PANIC:  could not write",
        "2026-01-05T08:02:14.234Z [ERROR] pipeline.worker - refused",
        "LOG:  duration: 41 ms  statement: SELECT 1",
        "service=cart level=warn took long",
        "12:30:45.5 tick",
        '{"level":"error","msg":"quoted levels are not seen"}',
    ]
    rows = parse(spark, "\n".join(lines))
    assert [(r.time, r.source, r.level) for r in rows] == [
        ("2026-01-05T08:02:14Z", "billing-service", "ERROR"),
        ("2026-01-05 08:02:14,120", "app.worker", "WARNING"),
        ("05/Jan/2026:08:02:14 +0000", None, "ERROR"),
        ("05/Jan/2026:08:02:14 +0000", None, "WARNING"),
        ("Jan  5 08:02:05", "postgres", "CRITICAL"),
        ("2026-01-05T08:02:14.234Z", "pipeline.worker", "ERROR"),
        (None, None, "INFO"),
        (None, "cart", "WARNING"),
        ("12:30:45.5", None, "INFO"),
        (None, None, "INFO"),
    ]
    assert [rows[i].message for i in (0, 1, 8)] == [
        "[billing-service] pool exhausted",
        "app.worker - slow call",
        "tick",
    ]


def test_short_levels_need_their_key(spark):
    rows = parse(
        spark, "A lvl=I x\nA lvl=W x\nB sev: e INFO\nC severity=F\n2026-01-01 ok, grade E for effort"
    )
    assert [r.level for r in rows] == ["INFO", "WARNING", "ERROR", "CRITICAL", "INFO"]


def test_severe_events_without_level(spark):
    rows = parse(
        spark,
        "node kernel: EXT4-fs: No space left on device\nkernel: Out of Memory: killed\nall fine in the room",
    )
    assert [r.level for r in rows] == ["ERROR", "ERROR", "INFO"]


def test_trace_lines_inherit_and_blank_lines_count(spark):
    rows = parse(
        spark,
        "  indented first\nERROR failed\n\nTraceback (most recent call last):\n  at x\n"
        "ValueError: bad\r\nINFO going on\n  detail\nWARN low\n  detail",
    )
    assert [(r.line_number, r.level) for r in rows] == [
        (1, "INFO"), (2, "ERROR"), (4, "ERROR"), (5, "ERROR"), (6, "ERROR"),
        (7, "INFO"), (8, "INFO"), (9, "WARNING"), (10, "INFO"),
    ]


def test_chunks_do_not_change_inheritance(spark, monkeypatch):
    rng = random.Random(7)
    kinds = ["ERROR a", "FATAL b", "INFO c", "WARN d", "  more", "  more", "  more", "Caused by: x"]
    places = sorted([*rng.sample(range(100_000), 300), *range(200_000, 200_700)])
    lines = [(f"log{i % 3}", i, i, rng.choice(kinds)) for i in places]
    expected, above = {}, {}
    for log, pos, _, raw in lines:
        own = {"E": "ERROR", "F": "CRITICAL", "W": "WARNING"}.get(raw[0], "INFO")
        if raw[0] in " C" and above.get(log) in ("ERROR", "CRITICAL"):
            own = above[log]
        above[log] = expected[pos] = own
    raw = spark.createDataFrame(lines, "log_id string, pos bigint, line_number bigint, raw string")
    stored = write_once(parse_lines(raw, mark=True), "lines")
    for chunk_cells in (1, 4, 1000):
        found = inherit_trace_level(stored, chunk_cells).collect()
        assert {r.pos: r.level for r in found} == expected and len(found) == len(lines)
    monkeypatch.setattr(trace, "fits_broadcast", lambda table: False)
    entries = inherit_trace_level(stored)
    assert {r.pos: r.level for r in entries.collect()} == expected and entries.count() == len(lines)


def test_no_text_is_shuffled_for_traces(spark):
    raw = spark.createDataFrame([("a", i, i, "ERROR x" if i % 3 else "  at y") for i in range(50)], "log_id string, pos bigint, line_number bigint, raw string")
    stored = write_once(parse_lines(raw, mark=True), "lines")
    for plan in (trace.trace_levels(stored), inherit_trace_level(stored)):
        text = plan._jdf.queryExecution().executedPlan().toString()
        shuffled = [line for line in text.splitlines() if "Exchange" in line and "BroadcastExchange" not in line]
        assert all("raw" not in line and "message" not in line for line in shuffled)
    assert "SortMergeJoin" not in text and "Exchange hash" not in text


def test_non_ascii_lines_follow_the_same_rules(spark):
    rows = parse(spark, "änderungError trat auf\n  eingerückt　\nservice=größe ERROR: x\nlevel=é warning")
    assert [(r.level, r.source) for r in rows] == [
        ("ERROR", None), ("ERROR", None), ("ERROR", "größe"), ("WARNING", None)
    ]


def test_both_spellings_agree_on_ascii(spark):
    assert regex.ascii_regex(r"(?i)\bx\s[\s\d]\b") == r"(?i)\bx[\s\x1c-\x1f][\s\x1c-\x1f\d]\b"
    row = spark.range(1).select(
        text.message_signature(F.lit('t=30001ms v1.2.3 0xFF "a b" Größe 7')).alias("plain"),
        text.trim_excerpt(F.lit("é" * 301)).alias("cut"),
    ).first()
    assert row.plain == 't=<n>ms v<n> <hex> "<str>" Größe <n>'
    assert row.cut == "é" * 300 + "…"
