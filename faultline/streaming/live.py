"""Log lines as they arrive.

A log arrives in parts: files of one folder whose names sort in the order they
were written.  Parsing looks at one line at a time, so the batch expressions
apply unchanged.  What a line needs from earlier parts (its number, the level
of the error above it) is three values per log, kept in Spark's state store.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from faultline.functions.event_time import dated_time
from faultline.functions.levels import ERROR_LEVELS
from faultline.functions.regex import LINE_BREAK
from faultline.functions.text import strip
from faultline.operators.parse import parse_lines
from faultline.schemas import ENTRY_FIELDS

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_DAY_MS = 24 * 3600 * 1000
_LEVELLED = (
    "log_id string, pos bigint, line_number bigint, raw string, time string, source string, level string, message string, "
    "part string, late boolean"
)


def read_line_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """``log_id, part, raw`` and the line's place in its part, for files as they arrive under ``path``.

    The folder of a file is its log.  A part must fit a row; a batch takes at
    most ``files_per_batch`` of them.  Blank lines are dropped but counted.
    """
    name = F.col("_metadata.file_path")
    return (
        spark.readStream.option("maxFilesPerTrigger", files_per_batch)
        .text(path, wholetext=True, recursiveFileLookup=True)
        .select(
            F.regexp_extract(name, "^(.*)/[^/]*$", 1).alias("log_id"),
            F.element_at(F.split(name, "/"), -1).alias("part"),
            F.make_valid_utf8("value").alias("text"),
        )
        # a line break at the end starts no further line
        .select("log_id", "part", F.split(F.regexp_replace("text", f"(?:{LINE_BREAK})\\z", ""), LINE_BREAK).alias("lines"))
        .select("log_id", "part", F.size("lines").alias("part_lines"), F.posexplode("lines").alias("pos", "raw"))
        .where((strip(F.col("raw")) != "") | (F.col("pos") == F.col("part_lines") - 1))
        .select("log_id", "part", F.col("pos").cast("bigint").alias("pos"), (F.col("pos") + 1).cast("bigint").alias("line_number"), "raw", "part_lines")
    )


def parse_stream(lines: DataFrame) -> DataFrame:
    """Entries of arriving lines, each judged by itself, with ``part``, ``part_lines`` and ``continuation``."""
    carried = F.struct("part", "part_lines")
    parsed = parse_lines(lines.withColumn("log_id", F.struct("log_id", carried.alias("of"))), mark=True)
    return parsed.select(
        F.col("log_id.log_id").alias("log_id"),
        *(n for n in ENTRY_FIELDS if n != "log_id"),
        "continuation",
        F.col("log_id.of.part").alias("part"),
        F.col("log_id.of.part_lines").alias("part_lines"),
    )


class TraceLevels(StatefulProcessor):
    """Numbers lines across parts and lets trace lines take the level of the error above them.

    A part that sorts before one already seen is late: it is numbered and
    levelled by itself, marked, and leaves the state as it is.
    """

    def __init__(self, silent_ms: int | None):
        self.silent_ms = silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "part string, lines bigint, anchor string", self.silent_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, lines, anchor = self.seen.get() if self.seen.exists() else ("", 0, None)
        arrived = pd.concat(list(rows), ignore_index=True)
        for name, part in arrived.sort_values(["part", "pos"]).groupby("part", sort=True):
            late = name <= last
            above, levels = None if late else anchor, []
            for level, continuation in zip(part["level"], part["continuation"], strict=True):
                above = above if continuation else level
                levels.append(above if continuation and above in ERROR_LEVELS else level)
            levelled = part.assign(level=levels, late=late)
            if not late:
                levelled["pos"] += lines
                levelled["line_number"] += lines
                last, lines, anchor = name, lines + int(part["part_lines"].iloc[0]), above
            shown = levelled[levelled["raw"].str.strip() != ""]
            yield shown[[c.split()[0] for c in _LEVELLED.split(", ")]]
        self.seen.update((last, lines, anchor))

    def close(self) -> None:
        pass


def entry_stream(lines: DataFrame, silent_days: float | None = None) -> DataFrame:
    """Entries of ``read_line_stream`` with line numbers and trace levels across parts, and ``late``.

    Parts that arrive in order give what the batch reader gives for the whole
    log.  With ``silent_days``, a log that was silent for so long is forgotten
    and starts anew; such a query looks at the clock and runs batches without
    data too, so it suits continuous triggers only.
    """
    lines.sparkSession.conf.set(STATE_STORE, ROCKSDB)  # the only store that holds such state
    processor = TraceLevels(None if silent_days is None else int(silent_days * _DAY_MS))
    mode = "None" if silent_days is None else "ProcessingTime"
    return (
        parse_stream(lines)
        .groupBy("log_id")
        .transformWithStateInPandas(processor, outputStructType=_LEVELLED, outputMode="Append", timeMode=mode)
    )


def live_activity(lines: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Lines per window of time, source and level, each window once, when it is complete.

    A window is complete when a line ``delay`` younger than its end has come;
    its state is dropped then and lines that come later are left out.  Lines
    that do not name their year have no place in time and are left out too.
    """
    return (
        parse_stream(lines)
        .withColumn("event_time", dated_time(F.col("time")))
        .where("event_time IS NOT NULL")
        .withWatermark("event_time", delay)
        .groupBy(F.window("event_time", width).alias("window"), "source", "level")
        .agg(F.count("*").alias("lines"))
        .select("window.start", "window.end", "source", "level", "lines")
    )
