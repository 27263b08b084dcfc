"""Sorting incoming documents by what they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions import variants as V
from faultline.functions.text import strip

EMPTY_UPLOAD = "uploaded file is empty"
UNKNOWN_SHAPE = "unrecognized JSON shape"
NOT_AN_OBJECT = "not a JSON object"


def quarantine_empty(uploads: DataFrame) -> DataFrame:
    """Mark ``(doc_id, doc)`` uploads that hold nothing but white space."""
    return uploads.withColumn(
        "problem",
        F.when(F.col("doc").isNull() | (strip(F.col("doc")) == ""), EMPTY_UPLOAD),
    )


def route_inputs(docs: DataFrame) -> DataFrame:
    """Add ``kind`` (structured, verdict, raw, reject) and ``problem``.

    ``origin`` tells apart text, which falls back to raw lines when it is no
    known JSON, from objects, which are rejected then.
    """
    text = strip(F.col("doc"))
    value = F.when(
        (F.col("origin") == "object") | text.startswith("{"), V.parse_document(text)
    )
    doc = F.col("_value")
    is_object = V.is_kind(doc, "OBJECT")
    is_text = F.col("origin") == "text"
    kind = (
        F.when(is_object & V.is_kind(V.child(doc, "entries"), "ARRAY"), "structured")
        .when(
            is_object
            & (V.kind(V.child(doc, "filename")).isNotNull() | V.kind(V.child(doc, "status")).isNotNull()),
            "verdict",
        )
        .when(is_text, "raw")
        .otherwise("reject")
    )
    problem = F.when(
        F.col("kind") == "reject", F.when(is_object, UNKNOWN_SHAPE).otherwise(NOT_AN_OBJECT)
    )
    return (
        docs.withColumn("_value", value)
        .withColumn("kind", kind)
        .withColumn("problem", problem)
        .drop("_value")
    )
