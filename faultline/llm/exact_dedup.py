"""Exact dedup by distributed MSD radix partitioning.

Documents are split by successive runs of bytes.  A round groups the open
documents by (group so far, next bytes, length); Spark combines each group
before the shuffle, so a group with a third of all rows is a few rows per task.
Groups of one are settled, groups whose texts end in this run are equal texts
(the length says where a text ends, so it is part of the key),
the rest go on with a longer run.  No digest decides equality: two documents
share a group exactly if all bytes read so far are the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import text_of
from faultline.session import write_once

FIRST_BYTES = 64
GROWTH = 8


def radix_groups(
    docs: DataFrame,
    carry: Sequence[str] = (),
    keep_text: bool = False,
    first_bytes: int = FIRST_BYTES,
    growth: int = GROWTH,
) -> DataFrame:
    """One row per document: ``doc_id, carried, text, group_id, group_size, keep_id, text_sha256``.

    ``carried`` is a struct of the columns named in ``carry``; ``text`` is null
    unless ``keep_text``.  ``group_id`` is null for texts without a copy.
    Null texts count as empty.  Rows that repeat a document count as copies of
    it.  ``keep_id`` is the largest doc_id of the group, null if none has one.
    An empty table gives an empty result.  Other columns are ignored.
    """
    open_rows = docs.select(
        F.col("doc_id").alias("doc_id"),
        (F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.lit(None).cast("int")).alias("carried"),
        text_of().alias("text"),
        F.lit(0).cast("bigint").alias("group_id"),
        F.sha2(text_of(), 256).alias("text_sha256"),
    )
    settled: list[DataFrame] = []
    at, width = 0, first_bytes
    while True:
        keyed = open_rows.withColumns(
            {
                "_next": F.expr(f"substring(cast(text AS binary), {at + 1}, {width})"),
                "_length": F.octet_length("text"),
            }
        )
        groups = write_once(
            keyed.groupBy("group_id", "_next", "_length")
            .agg(F.count(F.lit(1)).alias("_size"), F.max("doc_id").alias("_keep"))
            .where("_size > 1")
            .withColumn("_group", F.monotonically_increasing_id()),
            "radix-groups",
        )
        ended = F.col("_length") <= at + width
        going_on = ~ended & F.col("_size").isNotNull()
        rows = write_once(
            # the groups grow with the corpus: one plan at every size, whose hot keys Spark splits
            keyed.join(groups.hint("merge"), ["group_id", "_next", "_length"], "left").select(
                "doc_id",
                "carried",
                (F.col("text") if keep_text else F.when(going_on, F.col("text"))).alias("text"),
                F.col("_group").alias("group_id"),
                F.coalesce("_size", F.lit(1)).alias("group_size"),
                F.when(F.col("_size").isNull(), F.col("doc_id")).otherwise(F.col("_keep")).alias("keep_id"),
                "text_sha256",
                going_on.alias("_open"),
                F.lit(at).alias("_round"),
            ),
            "radix-rows",
        )
        settled.append(rows.where("NOT _open").drop("_open"))
        if groups.where(~ended).isEmpty():
            break
        open_rows = rows.where("_open").select("doc_id", "carried", "text", "group_id", "text_sha256")
        at, width = at + width, width * growth
    result = settled[0]
    for more in settled[1:]:
        result = result.unionByName(more)
    return result


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the largest doc_id stays; rows that repeat that
    doc_id are all marked.  A group without any doc_id marks all its rows.
    """
    return radix_groups(docs).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their columns; one row for each distinct text."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = radix_groups(docs, others, keep_text=True)
    kept = rows.where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    single = kept.where("group_size = 1")
    # rows that repeat the doc_id that stays: any one of them
    several = kept.where("group_size > 1").dropDuplicates(["_round", "group_id"])
    return single.unionByName(several).select(
        *[(F.col(c) if c in ("doc_id", "text") else F.col("carried")[c].alias(c)) for c in docs.columns]
    )


ORACLE = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
