"""Byte-level BPE by longest matches and backtracking.

Token bytes are mapped to Latin-1 strings, so an Aho-Corasick automaton over
characters finds the tokens of a pre-token; ``backtracking`` steps through its
longest matches and gives what the merges give.  Each distinct pre-token is
encoded once as long as the task remembers it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from faultline.llm.backtracking import LongestMatches
from faultline.llm.common import free_name, text_of
from faultline.llm.recent import Recent

MEMO_PIECES = 200_000
SOME_ROWS = 500  # of a batch that are coded at a time
PIECE_CHARS = 48  # longer pre-tokens are rare and are not kept


class BytePairs:
    """Encoder and decoder for ``{token bytes: rank}`` and a pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("some byte is no token")
        self.pattern = regex.compile(pattern)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.ranks = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.coded = {token: np.array([rank], "<u4").tobytes() for token, rank in self.ranks.items()}
        self.matches = LongestMatches(self.ranks, self.merged)
        self.memo = Recent(MEMO_PIECES)

    @classmethod
    def from_file(cls, path: str, pattern: str) -> BytePairs:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)

    def merged(self, text: str) -> list[str]:
        """Plain merging: the lowest rank first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            joined = [self.ranks.get(a + b, 1 << 60) for a, b in pairwise(parts)]
            best = min(joined)
            if best == 1 << 60:
                break
            at = joined.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def encode_piece(self, piece: str) -> bytes:
        """Ids of one pre-token, as little-endian unsigned 32-bit integers."""
        text = piece.encode("utf-8", "surrogatepass").decode("latin-1")
        whole = self.coded.get(text)  # a token stands for itself, however its bytes would merge
        return whole or b"".join(map(self.coded.__getitem__, self.matches.split(text)))

    def encode_text(self, text: str) -> bytes:
        pieces = self.pattern.findall(text)
        if pieces and max(map(len, pieces)) > PIECE_CHARS:
            return b"".join([self.encode_piece(p) if len(p) > PIECE_CHARS else self.memo.each([p], self.encode_piece)[0] for p in pieces])
        return b"".join(self.memo.each(pieces, self.encode_piece))

    def encode_texts(self, texts: Sequence[str]) -> list[bytes]:
        return list(map(self.encode_text, texts))

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@cache
def _worker(path: str, pattern: str) -> BytePairs:
    return BytePairs.from_file(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: ``doc_id, ids`` (array of int).  Null texts are empty; other columns are ignored.

    A map over the rows as they are read: no shuffle, repeated rows give
    repeated rows, an empty table an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _worker(path, pattern)
        for batch in batches:
            coded = pairs.encode_texts(batch.column(1).to_pylist())
            offsets = np.concatenate([[0], np.cumsum([len(c) // 4 for c in coded])]).astype("int32")
            values = np.frombuffer(b"".join(coded), "<u4").astype("int32")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["doc_id", "ids"]
            )

    plain = docs.select("doc_id", text_of().alias("text"))
    return plain.mapInArrow(run, f"doc_id {dict(plain.dtypes)['doc_id']}, ids array<int>")


def with_ids(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` with ``ids`` behind its columns, checked by decoding them.

    If ``docs`` has a column of that name, the new one is called ``ids_``.
    """
    name = free_name(docs.columns, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _worker(path, pattern)
        for batch in (b.slice(at, SOME_ROWS) for b in batches for at in range(0, b.num_rows, SOME_ROWS)):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            coded = pairs.encode_texts(texts)
            for text, ids in zip(texts, coded, strict=True):
                if pairs.decode(np.frombuffer(ids, "<u4").tolist()) != text.encode("utf-8", "surrogatepass"):
                    raise ValueError("ids do not decode to the text")
            offsets = np.concatenate([[0], np.cumsum([len(c) // 4 for c in coded])]).astype("int32")
            values = np.frombuffer(b"".join(coded), "<u4").astype("int32")
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, ArrayType(IntegerType()))]))


def decode(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per row of ``encode``: ``doc_id, bytes``, the decoded bytes.  Null ids give empty bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _worker(path, pattern)
        for batch in batches:
            data = [pairs.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["doc_id", "bytes"])

    plain = coded.select("doc_id", "ids")
    return plain.mapInArrow(run, f"doc_id {dict(plain.dtypes)['doc_id']}, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encodes and decodes each text: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    ``ids_sha256`` is over the decimal ids joined by one space.  Cases as in ``encode``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _worker(path, pattern)
        decimal = {rank: str(rank) for rank in pairs.tokens}
        for batch in batches:
            counts, id_sums, text_sums = [], [], []
            texts = batch.column(1).to_pylist()
            for text in texts:
                ids = np.frombuffer(pairs.encode_text(text), "<u4").tolist()
                counts.append(len(ids))
                id_sums.append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                text_sums.append(hashlib.sha256(pairs.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_sums, pa.string()), pa.array(text_sums, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    plain = docs.select("doc_id", text_of().alias("text"))
    kind = dict(plain.dtypes)["doc_id"]
    return plain.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
