"""SentencePiece BPE by longest matches and backtracking, and its decoding.

Merges take the best score first and the leftmost of equals; ``backtracking``
finds what they give from longest matches.  Texts are cut before every run of
spaces if no piece holds a space behind another character: no merge can cross
such a place, and each distinct unit between two of them is encoded once.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterable, Iterator, Sequence
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from faultline.llm.backtracking import LongestMatches
from faultline.llm.common import text_of
from faultline.llm.recent import Recent

MEMO_UNITS = 400_000
UNIT_CHARS = 48  # longer units are rare and are not kept

# ---- fixed values: numbers of the model file's fields, its types, its space and unknown marks ----

FIELD_PIECES, FIELD_TRAINER, FIELD_NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_TYPE = 1, 2, 3
TRAINER_KIND, TRAINER_SUFFIX_SPACE, TRAINER_BYTES, TRAINER_UNKNOWN = 3, 24, 35, 44
NORMALIZER_MAP, NORMALIZER_PREFIX, NORMALIZER_TRIM, NORMALIZER_ESCAPE = 2, 3, 4, 5
KIND_BPE = 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
SPACE = "▁"
UNKNOWN_TEXT = " ⁇ "

# ---- end of fixed values ----


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol-buffer message: number and value."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        number, wire = divmod(varint(), 8)
        if wire == 0:
            yield number, varint()
            continue
        size = varint() if wire == 2 else 8 if wire == 1 else 4
        yield number, data[at : at + size]
        at += size


class Pieces:
    """Encoder and decoder of a model file's bytes.

    Models that normalise characters, trim spaces, put spaces behind words or
    hold user-defined or unused pieces are refused: their texts would come out
    different.
    """

    def __init__(self, model: bytes):
        self.scores: dict[str, float] = {}
        self.ids: dict[str, tuple[int, ...]] = {}
        surface: list[bytes] = []
        starts_with_space: list[bool] = []
        self.bytes: dict[int, int] = {}
        self.control: list[int] = []
        unknown = None
        trainer: dict = {}
        normalizer: dict = {}
        self.named: dict[str, int] = {}
        for field, value in _fields(model):
            if field == FIELD_TRAINER:
                trainer = dict(_fields(value))
            elif field == FIELD_NORMALIZER:
                normalizer = dict(_fields(value))
            if field != FIELD_PIECES:
                continue
            entry = dict(_fields(value))
            text, number = entry[PIECE_TEXT].decode(), len(surface)
            (score,) = struct.unpack("<f", entry.get(PIECE_SCORE, bytes(4)))
            kind = entry.get(PIECE_TYPE, NORMAL)
            if kind in (USER_DEFINED, UNUSED):
                raise ValueError(f"piece {text!r} is user-defined or unused")
            plain = text.replace(SPACE, " ")
            self.named[text] = number
            starts_with_space.append(kind == NORMAL and plain.startswith(" "))
            if kind == NORMAL:
                self.scores[plain], self.ids[plain] = score, (number,)
                surface.append(plain.encode())
            elif kind == BYTE:
                self.bytes[int(text[3:5], 16)] = number
                surface.append(bytes([int(text[3:5], 16)]))
            elif kind == UNKNOWN:
                unknown = number
                surface.append(trainer.get(TRAINER_UNKNOWN, UNKNOWN_TEXT.encode()))
            else:
                self.control.append(number)
                surface.append(b"")
        if trainer.get(TRAINER_UNKNOWN) and unknown is not None:
            surface[unknown] = trainer[TRAINER_UNKNOWN]
        if trainer.get(TRAINER_KIND, 1) != KIND_BPE or not trainer.get(TRAINER_BYTES) or len(self.bytes) < 256:
            raise ValueError("not a BPE model with byte fallback")
        if normalizer.get(NORMALIZER_MAP) or normalizer.get(NORMALIZER_TRIM, 1) or not normalizer.get(NORMALIZER_ESCAPE, 1) or trainer.get(TRAINER_SUFFIX_SPACE):
            raise ValueError("the model normalises texts")
        self.prefix = " " if normalizer.get(NORMALIZER_PREFIX, 1) else ""
        self.starts_with_space = np.array(starts_with_space)
        self.is_control = np.zeros(len(surface), bool)
        self.is_control[self.control] = True
        self.surface = pa.array(surface, pa.binary())

        # a character that only longer pieces hold takes part in merges and ends as its bytes
        for char in {c for text in self.scores for c in text}.difference(self.scores):
            self.ids[char] = tuple(self.bytes[b] for b in char.encode())
        self.known = frozenset(c for text in self.ids for c in text)
        # pieces that merging never makes are no candidates
        self.ids = {text: ids for text, ids in self.ids.items() if self.merged(text) == [text]}
        self.matches = LongestMatches(self.ids, self.merged)
        self.coded = {text: np.array(ids, "<u4").tobytes() for text, ids in self.ids.items()}
        crossed = any(b == " " != a for text in self.scores for a, b in pairwise(text))
        self.units = None if crossed else re.compile(" +[^ ]*|[^ ]+")
        self.memo = Recent(MEMO_UNITS)

    # ------------------------------------------------------------ encoding

    def merged(self, text: str) -> list[str]:
        """Plain merging of characters: best score first, leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            joined = [self.scores.get(a + b) for a, b in pairwise(parts)]
            best = max((s for s in joined if s is not None), default=None)
            if best is None:
                break
            at = joined.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def encode_unit(self, text: str) -> bytes:
        whole = self.coded.get(text)
        if whole is not None:
            return whole
        if self.known.issuperset(text):
            return b"".join(map(self.coded.__getitem__, self.matches.split(text)))
        out, at = [], 0
        for i, char in enumerate([*text, ""]):
            if char not in self.known:  # no piece holds it: merges stop on both sides
                if at < i:
                    out += [self.coded[p] for p in self.matches.split(text[at:i])]
                out.append(np.array([self.bytes[b] for b in char.encode()], "<u4").tobytes())
                at = i + 1
        return b"".join(out)

    def encode_text(self, text: str) -> bytes:
        """Ids of a text without begin and end, as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        plain = self.prefix + text.replace(SPACE, " ")
        units = self.units.findall(plain) if self.units else [plain]
        if max(map(len, units)) > UNIT_CHARS:
            return b"".join([self.encode_unit(u) if len(u) > UNIT_CHARS else self.memo.each([u], self.encode_unit)[0] for u in units])
        return b"".join(self.memo.each(units, self.encode_unit))

    def encode_texts(self, texts: Iterable[str]) -> Iterator[bytes]:
        return map(self.encode_text, texts)

    # ------------------------------------------------------------ decoding

    def decode_many(self, rows: Sequence[np.ndarray]) -> list[bytes]:
        """Texts of id sequences as UTF-8; the one space put before a text is taken off again.

        Bytes that are no UTF-8 become U+FFFD, one each.
        """
        if not rows:
            return []
        if any(self.is_control[row[1:-1]].any() for row in rows):  # control ids part the bytes on both sides
            return [self._decode_parts(row) for row in rows]
        ids = np.concatenate(rows).astype(np.int64)
        joined = self.surface.take(pa.array(ids))
        ends = np.frombuffer(joined.buffers()[1], "<i4")
        data = joined.buffers()[2]
        data = data.to_pybytes() if data else b""
        texts, at = [], 0
        for row in rows:
            text = data[ends[at] : ends[at + len(row)]]
            if self.prefix and text[:1] == b" ":
                first = next(i for i in row if not self.is_control[i])
                text = text[1:] if self.starts_with_space[first] else text
            try:
                text.decode()
            except UnicodeDecodeError:
                text = _repaired(text)
            texts.append(text)
            at += len(row)
        return texts

    def _decode_parts(self, row: np.ndarray) -> bytes:
        parts = [part[~self.is_control[part]] for part in np.split(row, np.flatnonzero(self.is_control[row]))]
        parts = [part for part in parts if len(part)]
        texts = self.decode_many(parts)
        return b"".join(
            b" " + text if i and self.prefix and self.starts_with_space[part[0]] else text
            for i, (part, text) in enumerate(zip(parts, texts, strict=True))
        )


def _repaired(text: bytes) -> bytes:
    out, at = [], 0
    while at < len(text):
        for size in (1, 2, 3, 4):
            try:
                out.append(text[at : at + size].decode())
                break
            except UnicodeDecodeError:
                pass
        else:
            size = 1
            out.append("�")
        at += size
    return "".join(out).encode()


@cache
def _worker(path: str) -> Pieces:
    with open(path, "rb") as model:
        return Pieces(model.read())


def _framed(pieces: Pieces, texts: Sequence[str]) -> Iterator[np.ndarray]:
    begin, end = (np.array([pieces.named[n]], "<u4").tobytes() for n in ("<s>", "</s>"))
    for ids in pieces.encode_texts(texts):
        yield np.frombuffer(begin + ids + end, "<u4")


def _batches(texts: Sequence[str], some: int = 256) -> Iterator[Sequence[str]]:
    for at in range(0, len(texts), some):
        yield texts[at : at + some]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Per document ``doc_id, ids`` (array of int) with begin and end ids.

    ``path`` names the model file, which every executor has.  A map over the
    rows as they are read: no shuffle.  Null texts are empty and give the two
    framing ids; repeated rows give repeated rows, an empty table an empty
    result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _worker(path)
        for batch in batches:
            rows = list(_framed(pieces, batch.column(1).to_pylist()))
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype("int32")
            values = np.concatenate([*rows, np.empty(0, "<u4")]).astype("int32")
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    plain = docs.select("doc_id", text_of().alias("text"))
    return plain.mapInArrow(run, f"doc_id {dict(plain.dtypes)['doc_id']}, ids array<int>")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """Per row of ``encode``: ``doc_id, text``.  Null ids give an empty text; ids outside the model fail."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _worker(path)
        for batch in batches:
            rows = [np.array(ids or (), "<u4") for ids in batch.column(1).to_pylist()]
            texts = [t.decode() for t in pieces.decode_many(rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    plain = coded.select("doc_id", "ids")
    return plain.mapInArrow(run, f"doc_id {dict(plain.dtypes)['doc_id']}, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encodes and decodes each text: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    ``n_tokens`` counts all ids; ``ids_sha256`` is over the ids as little-endian
    unsigned 32-bit integers.  Cases as in ``encode``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _worker(path)
        for batch in batches:
            counts, id_sums, text_sums = [], [], []
            for some in _batches(batch.column(1).to_pylist()):
                rows = list(_framed(pieces, some))
                counts += map(len, rows)
                id_sums += (hashlib.sha256(r).hexdigest() for r in rows)
                text_sums += (hashlib.sha256(t).hexdigest() for t in pieces.decode_many(rows))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_sums, pa.string()), pa.array(text_sums, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    plain = docs.select("doc_id", text_of().alias("text"))
    kind = dict(plain.dtypes)["doc_id"]
    return plain.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
