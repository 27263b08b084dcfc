"""Token files: ids of whole texts in ascending doc_id order, in blocks coded by ``rans``.

A file set is a folder with ``table`` (the shared frequencies) and ``blocks``.
A block holds whole documents, decodes alone, and knows the ids before it in
its part; parts are doc_id ranges in order.
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import rans
from faultline.llm.common import text_of
from faultline.llm.units import Units
from faultline.session import arrow_rows, scratch_path, write_once

BLOCK_IDS = 1 << 17
SOME_TEXTS, SOME_WORDS, SOME_ROWS = 200, 256, 1000
SPACE = "Ġ"  # as byte-level vocabularies spell it
END_ID = 0


@cache
def _units(path: str) -> Units:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    spaced = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True), bool)
    spaced[[i for token, i in tokenizer.get_vocab().items() if token.startswith(SPACE)]] = True

    def encode(texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def whole(texts: list[str]) -> list[bytes]:
        # an encoding is far larger than its ids
        return [ids.tobytes() for i in range(0, len(texts), SOME_TEXTS) for ids in encode(texts[i : i + SOME_TEXTS])]

    def words(some: list[str]) -> list[bytes]:
        """Ids of words that follow a space, many in one text: only a word's first token starts with a space."""
        coded: list[bytes] = []
        for i in range(0, len(some), SOME_WORDS):
            part = some[i : i + SOME_WORDS]
            (ids,) = encode(["".join([" " + w for w in part])])
            starts = [*(4 * np.flatnonzero(spaced[ids])).tolist(), ids.nbytes]
            coded += map(ids.tobytes().__getitem__, map(slice, starts, starts[1:]))
        return coded

    return Units(whole, words, [token.content for token in tokenizer.get_added_tokens_decoder().values()])


def _forget() -> None:
    """Gives back what ``tokenize`` keeps in a Python worker, which also runs tasks of the later steps."""
    if _units.cache_info().currsize:
        _units.cache_clear()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
        if trim:
            trim(0)


def tokenize(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """``doc_id, ids``: little-endian ids of each text with ``end_id`` behind, 2 bytes each if all fit, else 4.

    The first byte tells the width.  Null texts are empty; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _units(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for batch in (whole.slice(at, SOME_ROWS) for whole in batches for at in range(0, len(whole), SOME_ROWS)):
            rows = []
            for coded in units.encode_texts(batch.column(1).to_pylist()):
                ids = np.frombuffer(coded + end, "<u4")
                small = int(ids.max()) < 1 << 16
                rows.append((b"\2" if small else b"\4") + (ids.astype("<u2") if small else ids).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["doc_id", "ids"])

    plain = docs.select("doc_id", text_of().alias("text"))
    return plain.mapInArrow(run, f"doc_id {dict(plain.dtypes)['doc_id']}, ids binary")


def unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u2" if packed[0] == 2 else "<u4", offset=1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    _forget()
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for at in range(0, len(batch), SOME_TEXTS):
            found = np.bincount(np.concatenate([unpack(p) for p in batch.column(0).slice(at, SOME_TEXTS).to_pylist()]))
            if len(found) > len(total):
                total = np.concatenate([total, np.zeros(len(found) - len(total), np.int64)])
            total[: len(found)] += found
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen])], ["id", "n"])


def id_counts(tokens: DataFrame) -> dict[int, int]:
    """Occurrences of each id over all rows: at most one number per id of the vocabulary."""
    rows = tokens.select("ids").mapInArrow(_count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    return {r.id: r.n for r in rows.collect()}


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID) -> None:
    """Writes the file set.  Repeated doc_ids lie side by side, null ones come first; no rows give no blocks."""
    with arrow_rows(docs.sparkSession, SOME_ROWS):
        _write(docs, tokenizer, path, end_id)


def _write(docs: DataFrame, tokenizer: str, path: str, end_id: int) -> None:
    tokens = write_once(tokenize(docs, tokenizer, end_id), "tokens")
    spark = docs.sparkSession
    table = rans.Table(id_counts(tokens))
    shares = list(zip(table.ids.tolist(), table.share.tolist(), strict=True))
    spark.createDataFrame(shares, "id bigint, share bigint").coalesce(1).write.parquet(f"{path}/table")
    kind = dict(tokens.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget()
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        doc_ids: list = []
        waiting: list[np.ndarray] = []
        size = 0

        def block() -> pa.RecordBatch:
            ids = np.concatenate(waiting)
            row = {
                "part": [part], "seq": [seq], "before": [before], "n": [len(ids)],
                "doc_ids": pa.array([doc_ids], pa.list_(id_type)), "lengths": pa.array([[len(w) for w in waiting]], pa.list_(pa.int32())),
                "block": [rans.encode_block(ids, table)],
            }
            types = {"part": pa.int32(), "seq": pa.int32(), "before": pa.int64(), "n": pa.int64(), "block": pa.binary()}
            return pa.RecordBatch.from_arrays(
                [v if isinstance(v, pa.Array) else pa.array(v, types[k]) for k, v in row.items()], list(row)
            )

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc_id, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = unpack(packed)
                doc_ids.append(doc_id)
                waiting.append(ids)
                size += len(ids)
                if size >= BLOCK_IDS:
                    yield block()
                    seq, before = seq + 1, before + size
                    doc_ids, waiting, size = [], [], 0
        if waiting:
            yield block()

    schema = f"part int, seq int, before bigint, n bigint, doc_ids array<{kind}>, lengths array<int>, block binary"
    ordered = tokens.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(run, schema).write.parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of a file set; ``ids`` are unsigned 32-bit little-endian bytes.

    ``start`` counts the ids of all documents before.  Each block is decoded
    where it is read; only the sizes of the parts are added up on the driver.
    """
    blocks = spark.read.parquet(f"{path}/blocks")
    shares = {r.id: r.share for r in spark.read.parquet(f"{path}/table").collect()}  # at most the vocabulary
    table = rans.Table.of_shares(shares)
    totals = sorted((r.part, r.n) for r in blocks.groupBy("part").agg(F.sum("n").alias("n")).collect())
    starts, at = {}, 0
    for part, n in totals:
        starts[part] = at
        at += n
    kind = dict(blocks.dtypes)["doc_ids"].removeprefix("array<").removesuffix(">")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_type = batch.schema.field("doc_ids").type.value_type
            for row in batch.to_pylist():
                ids = rans.decode_block(row["block"], table)
                lengths = np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                data = [ids[e - n : e].tobytes() for e, n in zip(ends, lengths, strict=True)]
                first = starts[row["part"]] + row["before"] + ends - lengths
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], id_type), pa.array(first), pa.array(lengths), pa.array(data, pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    return blocks.mapInArrow(run, f"doc_id {kind}, start bigint, n_tokens bigint, ids binary")


def token_index(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Writes the ids of ``docs``, reads them back: ``doc_id, start, n_tokens, ids_crc32``."""
    path = scratch_path(docs.sparkSession, "token-files")
    write_tokens(docs, tokenizer, path, end_id)
    return read_tokens(docs.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
