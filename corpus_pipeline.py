"""Corpus pipeline: from raw documents to tokenised training text.

Stages in order, each over all documents that the one before kept:

1. ``toxicity`` scores every document by ordinal regression; rejected ones go.
2. ``exact_dedup`` keeps the largest doc_id of equal texts.
3. ``near_dedup`` keeps the smallest doc_id of each group of near copies
   (five-word shingles, similarity 0.8 or more).
4. ``decontamination`` drops documents that hold a benchmark item.
5. ``byte_bpe`` encodes each text and decodes it again; the result has the
   columns of documents, the ids and their number.

Nulls, empty texts, repeated rows and extra columns are handled as the
operators state; a table without rows passes through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import bpe, decontamination, exact_dedup, minhash, toxicity
from faultline.llm.common import free_name, table
from faultline.session import write_once

RANKS = "byte_bpe_50k.tiktoken"


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_civil(docs, table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with ``ids`` and ``n_tokens`` behind their columns; ids that do not decode to the text are an error.

    Names that are taken get an underscore.
    """
    coded = bpe.with_ids(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return coded.withColumn(free_name(coded.columns, "n_tokens"), F.size(coded.columns[-1]))


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("byte_bpe", byte_bpe_stage),
]

#: The stages train models and compare by hashes that SQL does not have; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = write_once(docs, name)
    return docs
