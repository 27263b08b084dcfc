"""Raw log text: files, documents, lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.functions.regex import LINE_BREAK
from faultline.functions.text import strip
from faultline.session import BROADCAST_BYTES, fits_broadcast, write_once

MAX_FILE_GROUPS = 64


def split_lines(logs: DataFrame, segments: bool = False) -> DataFrame:
    """``(log_id, text)`` to numbered lines; blank lines are dropped but counted.

    With ``segments``, lines that no line feed parts share a ``segment``: they
    were broken by a rarer character.
    """
    if segments:
        outer = F.transform(
            F.split("text", "\r\n|\n"),
            lambda part, i: F.transform(F.split(part, LINE_BREAK), lambda raw: F.struct(i.alias("segment"), raw.alias("raw"))),
        )
        lines = logs.select("log_id", F.posexplode(F.flatten(outer)).alias("pos", "line")).select("log_id", "pos", "line.*")
    else:
        lines = logs.select("log_id", F.posexplode(F.split("text", LINE_BREAK)).alias("pos", "raw"))
    return lines.where(strip(F.col("raw")) != "").select(
        "log_id",
        F.col("pos").cast("bigint").alias("pos"),
        (F.col("pos") + 1).cast("bigint").alias("line_number"),
        "raw",
        *(["segment"] if segments else []),
    )


def _file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_logs(spark: SparkSession, path: str) -> DataFrame:
    """The ``logs`` rows of the files at ``path``, empty ones included; reads no content."""
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("log_id"))
    return files.select(
        "log_id",
        _file_name(F.col("log_id")).alias("log_source"),
        F.lit("raw").alias("kind"),
        F.lit(None).cast("string").alias("classifier_status"),
    )


def read_raw_logs(spark: SparkSession, path: str) -> DataFrame:
    """Log files as one text each: ``(log_id, log_source, text)``.

    For files that fit a row.  ``read_log_lines`` takes files of any size and
    gives the same log_ids.  Bytes that are no UTF-8 are replaced.
    """
    return (
        spark.read.format("binaryFile")
        .load(path)
        .select(
            F.col("_metadata.file_path").alias("log_id"),
            _file_name(F.col("_metadata.file_path")).alias("log_source"),
            F.make_valid_utf8(F.col("content").cast("string")).alias("text"),
        )
    )


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their split and a row id that grows within it, since one task reads a split from start to end."""
    return (
        spark.read.text(path)
        .select(
            F.col("_metadata.file_path").alias("log_id"),
            F.col("_metadata.file_block_start").alias("_start"),
            F.make_valid_utf8("value").alias("value"),
        )
        # further line boundaries that the reader does not know
        .select("log_id", "_start", F.explode(F.split("value", LINE_BREAK)).alias("raw"))
        .withColumn("_row", F.monotonically_increasing_id())
    )


def read_log_lines(spark: SparkSession, path: str, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Log files of any size as numbered lines; text is never shuffled.

    Splits of a file are read by different tasks.  A first pass counts the
    lines of each split and stores one row per split: where its row ids start
    and how many lines of the file lie before it.  The second pass looks that
    up where it reads.  If the table is too large to be sent to every executor,
    files are read in groups whose part of it is small enough.
    """
    pieces = _pieces(spark, path)
    before = Window.partitionBy("log_id").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = write_once(
        pieces.groupBy("log_id", "_start")
        .agg(F.min("_row").alias("_first"), F.count("*").alias("_lines"))
        .select("log_id", "_start", (F.coalesce(F.sum("_lines").over(before), F.lit(0)) - F.col("_first")).alias("_shift")),
        "splits",
    )
    groups = 1
    while groups < MAX_FILE_GROUPS and not fits_broadcast(splits, broadcast_bytes * groups):
        groups *= 2
    group = F.pmod(F.xxhash64("log_id"), F.lit(groups))
    parts = [
        pieces.where(group == i).join(F.broadcast(splits.where(group == i)), ["log_id", "_start"])
        for i in range(groups)
    ]
    pos = F.col("_row") + F.col("_shift")
    return (
        reduce(DataFrame.unionByName, parts)
        .where(strip(F.col("raw")) != "")
        .select("log_id", pos.alias("pos"), (pos + 1).alias("line_number"), "raw")
    )
