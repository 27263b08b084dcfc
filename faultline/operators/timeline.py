"""When every line of a log happened."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.event_time import dated_time, time_near
from faultline.operators.trace import CHUNK_LINES


def event_times(entries: DataFrame, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """``log_id, pos, line_number, source, level, event_time`` of every entry; no text moves.

    Lines that name their year carry their own time.  Others take the year, or
    the day, that lies nearest to the last such line before them or, where none
    is, the first one after.  Lines without time, and logs without any dated
    line, have a null ``event_time``.

    Logs are scanned in chunks of positions; from the other chunks a chunk needs
    the last time before and the first time after it.
    """
    times = entries.select(
        "log_id",
        "pos",
        "line_number",
        "source",
        "level",
        "time",
        dated_time(F.col("time")).alias("dated"),
        F.expr(f"floor(pos / {chunk_lines})").alias("chunk"),
    )
    whole = Window.partitionBy("log_id").orderBy("chunk")
    ends = (
        times.where("dated IS NOT NULL")
        .groupBy("log_id", "chunk")
        .agg(F.min(F.struct("pos", "dated")).alias("first"), F.max(F.struct("pos", "dated")).alias("last"))
    )
    chunks = times.select("log_id", "chunk").distinct().join(ends, ["log_id", "chunk"], "left")
    carried = chunks.select(
        "log_id",
        "chunk",
        F.last("last", ignorenulls=True).over(whole.rowsBetween(Window.unboundedPreceding, -1))["dated"].alias("earlier"),
        F.first("first", ignorenulls=True).over(whole.rowsBetween(1, Window.unboundedFollowing))["dated"].alias("later"),
    )
    chunk = Window.partitionBy("log_id", "chunk").orderBy("pos")
    before = F.last("dated", ignorenulls=True).over(chunk.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("dated", ignorenulls=True).over(chunk.rowsBetween(0, Window.unboundedFollowing))
    return (
        times.withColumns({"before": before, "after": after})
        .join(carried, ["log_id", "chunk"])
        .withColumn("anchor", F.coalesce("before", "earlier", "after", "later"))
        .select(
            "log_id",
            "pos",
            "line_number",
            "source",
            "level",
            F.coalesce("dated", time_near(F.col("time"), F.col("anchor"))).alias("event_time"),
        )
    )


def activity(times: DataFrame, width: str = "1 hour") -> DataFrame:
    """Lines per window of time, source and level; lines without time are left out."""
    return (
        times.where("event_time IS NOT NULL")
        .groupBy(F.window("event_time", width).alias("window"), "source", "level")
        .agg(F.count("*").alias("lines"))
        .select("window.start", "window.end", "source", "level", "lines")
    )
