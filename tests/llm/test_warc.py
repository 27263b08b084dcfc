"""Archives with repeated rows, damaged files and nested captures."""

import gzip
import hashlib

import pytest

pytest.importorskip("faultline.llm")

from faultline.llm import warc as W  # noqa: E402

LONG = "<p>" + "x" * 200
ROWS = [
    (1, "http://a/1", LONG, "k"), (1, "http://a/2", LONG, "k"), (1, "http://a/2", LONG, "k"), (2, "http://b", LONG, "k"), (None, "http://n", LONG, "k"),
    (3, None, None, "k"), (3, None, "", "k"), (4, "http://c", "short", "k"), (5, "http://c", "short", "k"), (6, "http://d", "é" * 400_000, "k"),
]


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def test_every_row_is_a_capture(spark):
    pages = spark.createDataFrame(ROWS, "page_id bigint, url string, html string, serial string").repartition(3)
    found = sorted(map(str, (tuple(r) for r in W.archive_pages(pages).collect())))
    expected = []
    for page, _, html, _ in ROWS:
        again = html == LONG and page != 1
        size = len((html or "").encode())
        expected.append(str((page, size, sha(html), "revisit" if again else "response", 1 if again else None)))
    assert found == sorted(expected)
    assert W.archive_pages(pages.limit(0)).count() == 0


def test_captures_are_nested_with_their_headers(spark, tmp_path):
    pages = spark.createDataFrame([r[:3] for r in ROWS[:5]], "page_id bigint, url string, html string")
    W.write_warc(pages, str(tmp_path / "warc"))
    captures = W.assemble(W.read_warc(spark, str(tmp_path / "warc"))).collect()
    assert len(captures) == 5
    for row in captures:
        assert row.request.type == "request" and row.metadata.type == "metadata"
        assert row.response.headers["warc-record-id"] == row.capture_id == row.request.concurrent_to == row.metadata.concurrent_to
        assert row.response.http_headers["content-type"] == "text/html; charset=utf-8"
    ids = {r.capture_id for r in captures}
    assert {r.response.refers_to for r in captures if r.response.type == "revisit"} <= ids


def record(payload, length=None):
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <{payload.decode()}>\r\nContent-Length: {len(payload) if length is None else length}\r\n\r\n"
    return head.encode() + payload + b"\r\n\r\n"


def ids(data):
    return [r["record_id"] for r in W.parse_records(data)]


def test_damaged_archives_give_what_is_whole():
    whole = record(b"one") + record(b"two") + record(b"three")
    assert ids(whole) == ids(gzip.compress(whole)) == ["<one>", "<two>", "<three>"]
    members = b"".join(gzip.compress(record(x)) for x in (b"one", b"two"))
    assert ids(members) == ["<one>", "<two>"]
    assert ids(members[:-5]) in (["<one>"], ["<one>", "<two>"]) and ids(members + b"junk") == ["<one>", "<two>"]
    assert ids(whole[:-8]) == ["<one>", "<two>"]
    assert ids(record(b"one") + record(b"two", "5o") + record(b"three")) == ["<one>"]
    assert ids(record(b"one") + record(b"two", "-1")) == ["<one>"]
    assert ids(b"") == ids(b"no archive") == ids(b"\x1f\x8bbroken") == []
    cut = gzip.compress(whole + record(b"x" * 5000))[:60]
    assert ids(cut) == ["<one>", "<two>", "<three>"][: len(ids(cut))]
