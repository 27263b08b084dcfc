"""Writing reports, and reading them back."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.schemas import MAX_SOLUTIONS, REPORT, SEVERITIES, STATUSES


def stamp(results: DataFrame, run_id: str | None = None) -> DataFrame:
    """Add the report's own id, its run and the time.

    A run is named by ``run_id``, by default the day.  The id of a report
    follows from run and log, so a repeated run gives the same ids.
    """
    run = F.date_format(F.current_timestamp(), "yyyy-MM-dd") if run_id is None else F.lit(run_id)
    digest = F.sha2(F.concat_ws("\n", F.col("run_id"), F.coalesce("log_id", F.lit(""))), 256)
    pieces = [F.substring(digest, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return results.withColumn("run_id", run).select(
        F.concat_ws("-", *pieces).alias("analysis_id"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("generated_at"),
        *results.columns,
        "run_id",
    )


def write_results(results: DataFrame, path: str, fmt: str = "json", run_id: str | None = None) -> None:
    """Write stamped reports under ``path``, one folder per run.

    A run that is written again, say after it failed half way, replaces its own
    folder and no other.  A run without reports leaves what is there.  Reports
    that are not of the declared type are refused.
    """
    (
        stamp(results, run_id)
        .to(REPORT)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id")
        .format(fmt)
        .save(path)
    )


def _incident_problem(incident: Column) -> Column:
    """First field of a published incident that breaks its rules, or null."""
    rules = {
        "title": incident["title"].isNotNull(),
        "severity": incident["severity"].isin(*SEVERITIES),
        "confidence": incident["confidence"].between(0.0, 1.0),
        "human_explanation": incident["human_explanation"].isNotNull(),
        "possible_solutions": F.size(incident["possible_solutions"]).between(1, MAX_SOLUTIONS),
        "evidence": F.forall(
            incident["evidence"],
            lambda e: e["line_number"].isNotNull() & e["raw_text"].isNotNull() & e["why_relevant"].isNotNull(),
        ),
        "affected_sources": incident["affected_sources"].isNotNull(),
    }
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])


def report_problem() -> Column:
    """First field of a published report that breaks its rules, or null."""
    bad = F.array_compact(F.transform("incidents", _incident_problem))
    rules = {
        "analysis_id": F.col("analysis_id").isNotNull(),
        "generated_at": F.col("generated_at").isNotNull(),
        "log_source": F.col("log_source").isNotNull(),
        "overall_status": F.col("overall_status").isin(*STATUSES),
        "stats": (F.col("stats.total_lines") >= 0) & (F.col("stats.error_lines") >= 0) & (F.col("stats.warning_lines") >= 0),
        "incidents": F.col("incidents").isNotNull(),
    }
    found = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return F.coalesce(*found, F.get(bad, F.lit(0)))


def read_results(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Reports below ``path`` in the declared type, with ``problem``: the field that breaks its rules, or null.

    Text that is no such report gives a row whose fields are null, so it is
    seen and not lost.
    """
    return spark.read.schema(REPORT).format(fmt).load(path).withColumn("problem", report_problem())


#: Folders that log files are dealt out to.
LOG_FOLDERS = 64
#: Name of the file with the lines of no log.
NO_LOG = "__HIVE_DEFAULT_PARTITION__"


def _is_folder(path: str) -> bool:
    """Whether tasks can open files below ``path`` by themselves: a local or mounted folder."""
    return urlsplit(path).scheme in ("", "file")


def write_log_files(lines: DataFrame, path: str) -> None:
    """Write ``(log_id, pos, raw)`` as one text file per log, ``folder=<n>/log_id=<name>.log``.

    Spark's writer makes a folder per value, which costs more than the lines of
    a small log and makes readers list as many folders as there are logs; it is
    used, as ``log_id=<name>/<part>``, where ``path`` is no folder that all
    executors share.  Else each task streams its logs, sorted, to files.  A file
    gets its name when it is whole; a repeated task replaces it.
    """
    log = F.when(F.col("log_id") != "", F.col("log_id")).otherwise(NO_LOG).alias("log_id")
    ordered = lines.select(log, "pos", "raw").repartition("log_id").sortWithinPartitions("log_id", "pos").drop("pos")
    if not _is_folder(path):
        ordered.write.partitionBy("log_id").text(path)
        return
    fs, root = FileSystem.from_uri(path)
    for n in range(LOG_FOLDERS):  # so that a table without lines can be read, too
        fs.create_dir(f"{root}/folder={n}", recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(path)
        rows = ((log, raw) for b in batches for log, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        files = 0
        for log, found in groupby(rows, key=lambda row: row[0]):
            folder, name = f"{root}/folder={zlib.crc32(log.encode()) % LOG_FOLDERS}", f"log_id={quote(log, safe='')}.log"
            part = f"{folder}/.{name}.{TaskContext.get().taskAttemptId()}"
            with fs.open_output_stream(part, buffer_size=1 << 16) as out:
                for _, raw in found:
                    out.write(raw.encode() + b"\n")
            fs.move(part, f"{folder}/{name}")
            files += 1
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], ["files"])

    ordered.mapInArrow(run, "files bigint").agg(F.sum("files")).collect()
