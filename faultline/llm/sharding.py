"""Sharding by rendezvous hashing over weighted shards.

Every record scores each shard by its key and takes the best; a new shard only
takes the records it scores best for, so no record moves between old shards.
All of it is column expressions; only counts per (shard, block) are summed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import text_of
from faultline.session import write_once

SHARDS = 40
BLOCK_ROWS = 50_000
MIN_BLOCKS = 64


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """Index of the shard with the highest ``-weight / ln(u)``, u in (0, 1) by key and shard.

    A null key is a key of its own.  Ties go to the lower shard.
    """
    scores = []
    for shard, weight in enumerate(weights):
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11)
        u = (bits.cast("double") + 0.5) / float(1 << 53)
        scores.append(F.struct((-F.lit(float(weight)) / F.log(u)).alias("score"), F.lit(-shard).alias("shard")))
    return (-F.array_max(F.array(*scores))["shard"]).cast("int")


def shard_documents(
    docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS, grown: Sequence[float] | None = None
) -> DataFrame:
    """Per document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    ``grown`` are the weights after growth, one more shard of weight 1 unless
    given.  Slots number a shard's records from 0 in the order of (block,
    doc_id, crc, size), blocks being a hash of these; they bound what one task
    sorts.  Null texts have no bytes, null ids share a key, and equal rows are
    counted first and expanded at the end, so a repeated row is no hot spot.
    An empty table gives an empty result; other columns are ignored.
    """
    grown = [*weights, 1.0] if grown is None else grown
    distinct = write_once(
        docs.select(
            F.col("doc_id").alias("doc_id"),
            (F.octet_length(text_of()) + 16).cast("bigint").alias("size"),
            F.crc32(text_of()).alias("text_crc32"),
        )
        .groupBy("doc_id", "size", "text_crc32")
        .agg(F.count(F.lit(1)).alias("_copies"))
        .withColumns({"shard": rendezvous_shard(F.col("doc_id"), weights), "grown_shard": rendezvous_shard(F.col("doc_id"), grown)}),
        "sharded",
    )
    blocks = max(MIN_BLOCKS, distinct.count() // (len(weights) * BLOCK_ROWS))
    blocked = distinct.withColumn("_block", F.pmod(F.xxhash64("doc_id", "text_crc32", "size", F.lit(7)), F.lit(blocks)))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        blocked.groupBy("shard", "_block")
        .agg(F.sum("_copies").alias("_in_block"))
        .select("shard", "_block", F.coalesce(F.sum("_in_block").over(before), F.lit(0)).alias("_start"))
    )
    inside = (
        Window.partitionBy("shard", "_block")
        .orderBy("doc_id", "text_crc32", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        blocked.join(starts, ["shard", "_block"])
        .withColumn("_first", F.col("_start") + F.coalesce(F.sum("_copies").over(inside), F.lit(0)))
        .select("*", F.explode(F.sequence("_first", F.col("_first") + F.col("_copies") - 1)).alias("slot"))
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
    )
