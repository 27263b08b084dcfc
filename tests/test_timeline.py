"""Typed times of lines."""

import datetime

import pytest

from faultline.operators.timeline import event_times
from faultline.plans.reporting import text_entries

UTC = datetime.UTC


def at(*parts):
    return datetime.datetime(*parts)


LOG = [
    ("Dec 31 23:59:50 a b: x", at(2025, 12, 31, 23, 59, 50)),  # before the first dated line: the one after counts
    ("23:59:59,5 y", at(2025, 12, 31, 23, 59, 59, 500000)),
    ("2026-01-01T00:00:05.25Z ERROR z", at(2026, 1, 1, 0, 0, 5, 250000)),
    ("Dec 31 23:59:55 a b: late", at(2025, 12, 31, 23, 59, 55)),
    ("no time", None),
    ("Feb 29 10:00:00 a b: no such day in the years around", None),
    ("00:00:01 tick", at(2026, 1, 1, 0, 0, 1)),
    ('1.2.3.4 - - [05/Jan/2026:08:02:14 +0130] "GET /" 200', at(2026, 1, 5, 6, 32, 14)),
    ("23:00:00 the evening before", at(2026, 1, 4, 23)),
    ("2026-06-30 12:00:00,120 WARN a - b", at(2026, 6, 30, 12, 0, 0, 120000)),
    ("Jan  5 08:02:05 a b: winter", at(2026, 1, 5, 8, 2, 5)),
    ("2026-06-30T12:00:00+0530 c", at(2026, 6, 30, 6, 30)),
    ("Foo 05 08:02:05 no month", None),
    ("25:61:61 no clock", None),
    ("2026-13-45T12:00:00Z no date", None),
]


@pytest.mark.parametrize("chunk_lines", [1, 4, 1000])
def test_times_take_year_and_day_from_near_lines(spark, chunk_lines):
    logs = spark.createDataFrame([("a", "\n".join(line for line, _ in LOG)), ("b", "Jan  5 08:02:05 alone\n10:00:00 too")], "log_id string, text string")
    found = {(r.log_id, r.line_number): r.event_time for r in event_times(text_entries(logs), chunk_lines).collect()}
    for number, (line, time) in enumerate(LOG, 1):
        assert found["a", number] == time, line
    assert found["b", 1] is None and found["b", 2] is None and len(found) == len(LOG) + 2
