"""Delivered documents of every shape: what is read, what is refused, and that the counts agree."""

import json

from faultline.plans.intake import analyze_documents, take_in

SCHEMA = "log_id string, log_source string, origin string, doc string"
DOCS = [
    ("t1", "a.log", "text", "INFO fine\n\nERROR pool exhausted\n  at x"),
    ("t2", "b.log", "text", '{"status": "pass", "filename": "v.log"}'),
    ("t3", "c.log", "text", '{"unknown": 1}'),
    ("t4", "d.log", "text", "{broken"),
    ("t5", "e.log", "text", " \n\t"),
    ("t6", "f.log", "text", ""),
    ("t7", "g.log", "text", None),
    ("o1", None, "object", '{"entries": ["ERROR down", {"msg": "m", "level": "warn"}, 5, null], "filename": "s.json"}'),
    ("o2", None, "object", '{"entries": []}'),
    ("o3", None, "object", '{"unknown": 1}'),
    ("o4", None, "object", "[1]"),
    ("o5", None, "object", "{broken"),
    ("o6", None, "object", '{"status": "FAIL"}'),
    (None, "x.log", "text", "ERROR nobody's"),
]


def test_every_document_is_reported_or_refused(spark):
    intake = take_in(spark.createDataFrame([(*d, "extra") for d in DOCS], SCHEMA + ", kind string"))
    logs = {r.log_id: r for r in intake.logs.collect()}
    assert {k: r.kind for k, r in logs.items()} == {
        "t1": "raw", "t2": "verdict", "t3": "raw", "t4": "raw", "o1": "structured", "o2": "structured", "o6": "verdict",
    }
    assert logs["t1"].log_source == "a.log" and logs["o1"].log_source == "s.json" and logs["t2"].classifier_status == "PASS"
    lines = {(r.log_id, r.line_number): r.level for r in intake.entries.collect()}
    assert lines == {
        ("t1", 1): "INFO", ("t1", 3): "ERROR", ("t1", 4): "ERROR", ("t3", 1): "INFO", ("t4", 1): "INFO",
        ("o1", 1): "ERROR", ("o1", 2): "WARNING",
    }
    refused = {(r.log_id, r.pos): (r.problem, r.content) for r in intake.quarantine.collect()}
    assert refused == {
        ("t5", None): ("uploaded file is empty", " \n\t"), ("t6", None): ("uploaded file is empty", ""), ("t7", None): ("uploaded file is empty", None),
        ("o3", None): ("unrecognized JSON shape", '{"unknown": 1}'), ("o4", None): ("not a JSON object", "[1]"), ("o5", None): ("not a JSON object", "{broken"),
        (None, None): ("document has no log_id", "ERROR nobody's"), ("o1", 2): ("item is bigint", "5"), ("o1", 3): ("item is void", None),
    }
    counts = {r.kind: r for r in intake.conservation().collect()}
    assert all(r.balanced for r in counts.values())
    assert sum(r.arrived for k, r in counts.items() if k != "item") == len(DOCS)
    assert (counts["item"].arrived, counts["item"].reported, counts["item"].quarantined) == (4, 2, 2)


def test_reports_follow_from_documents(spark):
    reports = {r.log_id: r for r in analyze_documents(spark.createDataFrame(DOCS, SCHEMA)).collect()}
    assert {k: r.overall_status for k, r in reports.items()} == {
        "t1": "critical", "t2": "healthy", "t3": "healthy", "t4": "healthy", "o1": "critical", "o2": "inconclusive", "o6": "degraded",
    }
    assert [e.line_number for e in reports["t1"].incidents[0].evidence] == [3]
    assert json.loads(DOCS[1][3])["filename"] == reports["t2"].log_source


def test_no_documents(spark):
    intake = take_in(spark.createDataFrame([], SCHEMA))
    assert intake.logs.count() == intake.entries.count() == intake.quarantine.count() == 0
    assert [(r.kind, r.arrived, r.balanced) for r in intake.conservation().collect()] == [("item", 0, True)]
