"""Log files written by task, one per log."""

from pyspark.sql import functions as F

from catalog.queries import log_name
from faultline.sources import raw_logs, sinks

LINES = "log_id string, pos bigint, raw string"


def test_folders_do_not_grow_with_the_logs(spark, tmp_path):
    path = f"file:{tmp_path}/logs"
    named = [f"user-{i}" for i in range(150)] + ["a/b=c %", "été"]
    rows = [(log, pos, f"{log} line {pos}") for log in named for pos in (20, 3, 7)]
    odd = [(None, 1, "of no log"), ("", 2, "nor this"), (None, 0, "first é")]
    lines = spark.createDataFrame(rows + odd, LINES).repartition(5)
    sinks.write_log_files(lines, path)
    assert len(list((tmp_path / "logs").iterdir())) == sinks.LOG_FOLDERS
    files = [f.name for f in (tmp_path / "logs").glob("*/*")]
    assert len(files) == len(named) + 1 and not any(f.startswith(".") for f in files)

    got = {}
    for r in raw_logs.read_raw_logs(spark, path).collect():
        got[r.text.split(" line ")[0]] = r.text
    want = {log: "".join(f"{log} line {pos}\n" for pos in (3, 7, 20)) for log in named}
    assert got == want | {"first é\nof no log\nnor this\n": "first é\nof no log\nnor this\n"}
    assert raw_logs.file_logs(spark, path).count() == len(named) + 1
    numbered = raw_logs.read_log_lines(spark, path).where(F.col("log_id").contains("user-77.")).orderBy("pos").collect()
    assert [(r.pos, r.line_number, r.raw) for r in numbered] == [(i, i + 1, f"user-77 line {p}") for i, p in enumerate((3, 7, 20))]


def test_no_lines_give_no_files_and_a_repeated_run_replaces(spark, tmp_path):
    path = str(tmp_path / "logs")
    none = spark.createDataFrame([], LINES)
    sinks.write_log_files(none, path)
    assert raw_logs.read_log_lines(spark, path).count() == 0 == raw_logs.read_raw_logs(spark, path).count()
    for text in ("old", "new"):
        sinks.write_log_files(spark.createDataFrame([("a", 0, text)], LINES), path)
    assert [r.text for r in raw_logs.read_raw_logs(spark, path).collect()] == ["new\n"]


def test_folders_of_spark_where_tasks_open_no_files(spark, tmp_path, monkeypatch):
    assert not sinks._is_folder("s3a://logs/x") and sinks._is_folder(f"file:{tmp_path}")
    lines = spark.createDataFrame([("user-1", 2, "b"), ("user-1", 0, "a"), ("user-2", 1, "c"), (None, 0, "d")], LINES)
    found = []
    for path in (str(tmp_path / "flat"), str(tmp_path / "deep")):
        sinks.write_log_files(lines, path)
        files = raw_logs.read_raw_logs(spark, path)
        found.append({r.log_id: r.text for r in files.select(log_name("log_id").alias("log_id"), "text").collect()})
        monkeypatch.setattr(sinks, "_is_folder", lambda path: False)
    assert found[0] == found[1] == {"user-1": "a\nb\n", "user-2": "c\n", sinks.NO_LOG: "d\n"}
