"""Bare classifier verdicts: a file name and a status, without lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions import variants as V

# Fixed defaults of a verdict record.
DEFAULT_LOG_SOURCE = "classifier"
DEFAULT_STATUS = "UNKNOWN"


def read_verdicts(docs: DataFrame) -> DataFrame:
    """``(log_id, doc)`` to ``logs`` rows; other keys of the document are ignored."""
    doc = F.col("_doc")
    return docs.withColumn("_doc", V.parse_document(F.col("doc"))).select(
        "log_id",
        F.coalesce(V.as_text(V.child(doc, "filename")), F.lit(DEFAULT_LOG_SOURCE)).alias(
            "log_source"
        ),
        F.lit("verdict").alias("kind"),
        F.upper(
            F.coalesce(V.as_text(V.child(doc, "status")), F.lit(DEFAULT_STATUS))
        ).alias("classifier_status"),
    )
