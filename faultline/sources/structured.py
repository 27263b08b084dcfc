"""Parsed logs delivered as JSON documents with an ``entries`` list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import variants as V
from faultline.functions.fields import clean_message, extract_source, extract_time
from faultline.functions.levels import line_level, normalize_level
from faultline.schemas import ENTRY_FIELDS

# ---- fixed values: accepted names of each field, in order of preference ----

TIME_KEYS = ("time", "timestamp", "ts", "datetime", "date")
SOURCE_KEYS = ("source", "file", "service", "component", "logger", "origin")
LEVEL_KEYS = ("level", "status", "severity", "loglevel")
MESSAGE_KEYS = ("message", "description", "msg", "text", "body")
RAW_KEYS = ("raw", "raw_line", "line", "original")
LINE_NUMBER_KEYS = ("line_number", "lineno", "line_no", "n", "index")

DEFAULT_LOG_SOURCE = "parsed-json"

# ---- end of fixed values ----


def first_present(item: Column, keys: Sequence[str]) -> Column:
    """Value of the first key that is present and not null."""
    values = [V.child(item, key) for key in keys]
    return F.coalesce(*[F.when(~V.is_kind(v, "VOID"), v) for v in values])


def coalesce_aliases(items: DataFrame) -> DataFrame:
    """Fields of object items ``(log_id, pos, item)``; ``problem`` names a bad value.

    Missing raw text falls back to the message and the other way round; a
    missing or zero line number falls back to the place in the list.  Other
    columns stay.
    """
    item = F.col("item")
    found = items.withColumns(
        {
            "_time": first_present(item, TIME_KEYS),
            "_source": first_present(item, SOURCE_KEYS),
            "_level": first_present(item, LEVEL_KEYS),
            "_message": first_present(item, MESSAGE_KEYS),
            "_raw": first_present(item, RAW_KEYS),
            "_number": first_present(item, LINE_NUMBER_KEYS),
        }
    )

    def text_if_truthy(name: str) -> Column:
        return F.when(V.is_truthy(F.col(name)), V.as_text(F.col(name)))

    place = F.col("pos") + 1
    numbered = V.is_truthy(F.col("_number"))
    number = V.truncated_int(F.col("_number"))
    problem = F.when(
        V.is_truthy(F.col("_raw")) & ~V.is_kind(F.col("_raw"), "STRING"), "raw is not a string"
    ).when(numbered & number.isNull(), "line number is not an integer")
    return (
        found.withColumn(
            "raw", F.coalesce(text_if_truthy("_raw"), text_if_truthy("_message"), F.lit(""))
        )
        .withColumns(
            {
                "line_number": F.when(numbered, number).otherwise(place),
                "time": V.as_text(F.col("_time")),
                "source": V.as_text(F.col("_source")),
                "level": normalize_level(text_if_truthy("_level")),
                "message": F.coalesce(text_if_truthy("_message"), F.col("raw")),
                "problem": problem,
            }
        )
        .drop("_time", "_source", "_level", "_message", "_raw", "_number")
    )


def structured_items(docs: DataFrame) -> DataFrame:
    """``(log_id, doc)`` to one row per list item, with its JSON kind."""
    return (
        docs.select("log_id", V.parse_document(F.col("doc")).alias("doc"))
        .select("log_id", F.posexplode(V.items(V.child(F.col("doc"), "entries"))).alias("pos", "item"))
        .select(
            "log_id",
            F.col("pos").cast("bigint").alias("pos"),
            "item",
            V.kind(F.col("item")).alias("kind"),
        )
    )


def read_structured_entries(docs: DataFrame) -> DataFrame:
    """Entries of ``(log_id, doc)``; ``problem`` is set on items that cannot be one.

    A plain string is parsed like a raw line.  Levels stay as delivered: lines
    of a stack trace inherit nothing here.
    """
    is_line, is_object = F.col("kind") == "STRING", F.col("kind") == "OBJECT"

    def of_line(name: str, value: Column) -> Column:
        return F.when(is_line, value).otherwise(F.when(is_object, F.col(name)))

    raw = F.col("raw")
    read = (
        coalesce_aliases(structured_items(docs))
        .withColumn("raw", F.when(is_object, raw).otherwise(F.col("item").cast("string")))
        .withColumn("_line", F.when(is_line, raw))
        .withColumn("time", of_line("time", extract_time(raw)))
    )
    return (
        extract_source(read, "_line", "_emitter")
        .withColumns(
            {
                "source": of_line("source", F.col("_emitter")),
                "level": of_line("level", line_level(raw)),
                "message": of_line("message", clean_message(raw, F.col("time"))),
                "problem": F.when(is_object, F.col("problem")).when(
                    ~is_line, F.concat(F.lit("item is "), F.lower("kind"))
                ),
            }
        )
        .select(*ENTRY_FIELDS, "problem")
    )


def structured_logs(docs: DataFrame) -> DataFrame:
    """The ``logs`` rows of structured documents."""
    doc = V.parse_document(F.col("doc"))
    names = [
        F.when(V.is_truthy(V.child(F.col("_doc"), key)), V.as_text(V.child(F.col("_doc"), key)))
        for key in ("log_source", "filename")
    ]
    return docs.withColumn("_doc", doc).select(
        "log_id",
        F.coalesce(*names, F.lit(DEFAULT_LOG_SOURCE)).alias("log_source"),
        F.lit("structured").alias("kind"),
        F.lit(None).cast("string").alias("classifier_status"),
    )
