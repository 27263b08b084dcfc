"""Streams over arriving parts against the batch readers over whole logs."""

import datetime
import random

import pytest

from faultline.plans.reporting import text_entries
from faultline.streaming.live import entry_stream, live_activity, parse_stream, read_line_stream

LINES = ["ERROR a", "FATAL b", "INFO c", "WARN d", "  more", "\tmore", "  more", "Caused by: x", "", "  ", "größe\x0bINFO y"]


def run(spark, stream, name, folder, steps):
    """Rows that a stream gives while ``steps`` write files; it is started anew after each and goes on from its checkpoint."""
    out = str(folder / f"out-{name}")
    for step in steps:
        step()
        query = (
            stream.writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", str(folder / f"state-{name}")).trigger(availableNow=True).start(out)
        )
        try:
            assert query.awaitTermination(60)
        finally:
            query.stop()
    return spark.read.schema(stream.schema).parquet(out).collect(), query.lastProgress


@pytest.mark.parametrize("files_per_batch", [1000, 1])
def test_parts_in_order_equal_the_whole_log(spark, tmp_path, files_per_batch):
    rng = random.Random(9)
    logs = {f"log{i}": ["".join(rng.choice(LINES) + "\n" for _ in range(rng.randrange(1, 9))) for _ in range(5)] for i in range(3)}
    folder = tmp_path / "logs"
    for name in logs:
        (folder / name).mkdir(parents=True)

    def step(number):
        def write():
            for name, parts in logs.items():
                (folder / name / f"part-{number:03}.log").write_text(parts[number], encoding="utf-8")

        return write

    stream = entry_stream(read_line_stream(spark, str(folder), files_per_batch))
    rows, _ = run(spark, stream, f"levels{files_per_batch}", tmp_path, [step(i) for i in range(5)])
    whole = spark.createDataFrame([(n, "".join(parts)) for n, parts in logs.items()], "log_id string, text string")
    want = {(r.log_id, r.pos, r.line_number, r.raw, r.time, r.source, r.level, r.message) for r in text_entries(whole).collect()}
    got = [(r.log_id.rsplit("/", 1)[-1], r.pos, r.line_number, r.raw, r.time, r.source, r.level, r.message) for r in rows]
    assert len(got) == len(want) and set(got) == want and not any(r.late for r in rows)


def test_late_parts_stand_alone(spark, tmp_path):
    folder = tmp_path / "logs" / "a"
    folder.mkdir(parents=True)
    steps = [
        lambda: (folder / "2.log").write_text("INFO x\nERROR y\n"),
        lambda: (folder / "1.log").write_text("  early\nFATAL z\n  more\n"),
        lambda: (folder / "3.log").write_text("  at y\n"),
    ]
    rows, _ = run(spark, entry_stream(read_line_stream(spark, str(tmp_path / "logs"))), "late", tmp_path, steps)
    assert {(r.part, r.line_number, r.level, r.late) for r in rows} == {
        ("2.log", 1, "INFO", False), ("2.log", 2, "ERROR", False), ("1.log", 1, "INFO", True), ("1.log", 2, "CRITICAL", True),
        ("1.log", 3, "CRITICAL", True), ("3.log", 3, "ERROR", False),
    }


def test_windows_close_and_their_state_goes(spark, tmp_path):
    folder = tmp_path / "logs" / "a"
    folder.mkdir(parents=True)

    def part(name, *lines):
        return lambda: (folder / name).write_text("".join(f"2026-01-05T{clock}Z {level} [db] x\n" for clock, level in lines))

    steps = [
        part("1.log", ("08:00:01", "ERROR"), ("08:59:59", "ERROR"), ("08:30:00", "INFO")),
        part("2.log", ("10:30:00", "INFO")),  # closes the window of eight
        part("3.log", ("08:00:02", "ERROR"), ("10:40:00", "INFO")),  # the first line comes too late
        part("4.log", ("13:00:00", "WARN")),
    ]
    stream = live_activity(read_line_stream(spark, str(tmp_path / "logs")))
    rows, progress = run(spark, stream, "windows", tmp_path, steps)
    hour = lambda h: datetime.datetime(2026, 1, 5, h)
    assert {tuple(r) for r in rows} == {
        (hour(8), hour(9), "db", "ERROR", 2), (hour(8), hour(9), "db", "INFO", 1), (hour(10), hour(11), "db", "INFO", 2),
    }
    assert sum(s["numRowsTotal"] for s in progress["stateOperators"]) == 1


def test_parsing_needs_no_state(spark, tmp_path):
    folder = tmp_path / "logs" / "a"
    folder.mkdir(parents=True)
    steps = [lambda: (folder / "1.log").write_text("INFO x\nlvl=E y\n\n"), lambda: (folder / "2.log").write_text("status=503 v")]
    rows, _ = run(spark, parse_stream(read_line_stream(spark, str(tmp_path / "logs"))).where("trim(raw) <> ''"), "plain", tmp_path, steps)
    assert sorted((r.raw, r.level) for r in rows) == [("INFO x", "INFO"), ("lvl=E y", "ERROR"), ("status=503 v", "ERROR")]
