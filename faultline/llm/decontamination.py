"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages; a distributed randomised SVD of their
TF-IDF matrix gives the latent space.  IDF counts all documents.  Every
document is scanned with overlapping windows, projected into that space, and a
window whose cosine with a passage is high enough is a candidate.  Candidates
are settled on the words: the longest common subsequence with the passage must
cover enough of it, and its answer words (the rarest ones) must be there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from faultline.llm.common import free_name, text_of
from faultline.llm.recent import Recent
from faultline.session import write_once

WIDTH = 1 << 15  # hashed words
RANK, SPARE, POWER = 64, 16, 2  # of the SVD
PASSAGE = 48  # words of a passage of an item; the last one of an item is as long
WINDOW, STRIDE = 32, 8  # words of a window of a document
KNOWN_SHARE = 0.25  # of a window's squared IDF that must be on words of the benchmark
COSINE = 0.55  # between window and passage in the latent space
COMMON = 0.6  # share of a passage's words in the common subsequence
ANSWER_WORDS, ANSWER_SHARE = 5, 0.6
LEAST_WORDS = 8  # shorter passages are asked for in full
ITEMS_AT_ONCE = 20_000  # passages that one scan is sent; more take more scans
MEMO_WORDS = 100_000
_EDGES = ".,;:!?\"'()[]{}*#$%&-"


def plain_words(text: str | None) -> list[str]:
    """Words in lower case without punctuation at their ends."""
    return [b for w in (text or "").lower().split() if (b := w.strip(_EDGES))]


def _place(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word) % WIDTH


def passages_of(words: list[str]) -> list[list[str]]:
    if len(words) <= PASSAGE:
        return [words] if words else []
    starts = [*range(0, len(words) - PASSAGE, PASSAGE), len(words) - PASSAGE]
    return [words[s : s + PASSAGE] for s in starts]


def common_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & places.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _place_or_none(word: str) -> int:
    """Place of a word before its punctuation is taken off, plus 2; 1 if nothing is left of it."""
    bare = word.strip(_EDGES)
    return _place(bare) + 2 if bare else 1


@cache
def _places() -> Recent:
    return Recent(MEMO_WORDS)


def word_places(text: str | None) -> np.ndarray:
    """Hashed place of every word of ``plain_words``, two bytes each."""
    found = np.array(_places().each((text or "").lower().split(), _place_or_none), np.int64)
    return (found[found > 1] - 2).astype("<u2")


def with_places(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with the places of all words as bytes in ``name``; a map without shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [word_places(t).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, BinaryType())]))


def inverse_frequency(placed: DataFrame, name: str) -> np.ndarray:
    """IDF of each hashed word over all documents: at most ``WIDTH`` counts reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(WIDTH, np.int64), 0
        for batch in batches:
            for places in batch.column(0).to_pylist():
                rows += 1
                seen[np.unique(np.frombuffer(places, "<u2"))] += 1
        found = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(found, -1)), pa.array(np.append(seen[found], rows))], ["place", "n"]
        )

    rows = placed.select(name).mapInArrow(run, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).collect()
    counts = {r.place: r.n for r in rows}
    total = counts.pop(-1, 0)
    idf = np.full(WIDTH, np.log(1 + total))
    for place, n in counts.items():
        idf[place] = np.log((1 + total) / (1 + n)) + 0.05
    return idf


def cut_passages(items: DataFrame) -> DataFrame:
    """``item_id, passage`` (array of words); items without words have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for words in passages_of(plain_words(text)):
                    ids.append(item)
                    found.append(words)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(found, pa.list_(pa.string()))], ["item_id", "passage"])

    plain = items.select("item_id", text_of().alias("text"))
    return plain.mapInArrow(run, f"item_id {dict(plain.dtypes)['item_id']}, passage array<string>")


def _tf_idf(words: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    places, times = np.unique([_place(w) for w in words], return_counts=True)
    values = times * idf[places]
    return places, values / max(float(np.linalg.norm(values)), 1e-12)


def latent_space(passages: DataFrame, idf: np.ndarray) -> np.ndarray:
    """``WIDTH x RANK`` basis: right singular vectors of the TF-IDF matrix of ``passages``.

    Each round multiplies by ``AᵀA`` on the executors; a partition sends one row
    per word it has, their sum is at most ``WIDTH`` rows of ``RANK + SPARE`` numbers.
    """
    wide = RANK + SPARE

    def multiply(basis: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((WIDTH, wide))
            for batch in batches:
                for words in batch.column(0).to_pylist():
                    places, values = _tf_idf(words, idf)
                    total[places] += values[:, None] * (values @ basis[places])[None, :]
            used = np.flatnonzero(np.abs(total).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(used), pa.FixedSizeListArray.from_arrays(pa.array(total[used].ravel()), wide).cast(pa.list_(pa.float64()))], ["place", "row"]
            )

        parts = passages.select("passage").mapInArrow(run, "place bigint, row array<double>")
        sums = parts.groupBy("place").agg(F.array(*[F.sum(F.col("row")[i]) for i in range(wide)]).alias("row"))
        out = np.zeros((WIDTH, wide))
        for r in sums.collect():
            out[r.place] = r.row
        return out

    basis = np.random.default_rng(7).standard_normal((WIDTH, wide))
    for _ in range(POWER):
        basis, _ = np.linalg.qr(multiply(basis))
    image = multiply(basis)  # AᵀA on the range found: its small eigenproblem orders the directions
    values, turn = np.linalg.eigh(basis.T @ image)
    top = np.argsort(-values)[:RANK]
    return (basis @ turn[:, top[values[top] > 1e-9]]).astype(np.float32)


@dataclass
class Searcher:
    """Finds passages in texts; all of its parts have a bounded size."""

    idf: np.ndarray
    space: np.ndarray
    ids: list
    passages: list[list[str]]

    def prepare(self) -> Searcher:
        self.squares = (self.idf**2).astype(np.float64)
        self.rows = (self.space * self.idf[:, None]).astype(np.float32)
        self.known = np.abs(self.rows).sum(axis=1) > 0
        latent, answers, unseen = [], [], float(self.idf.max())
        for words in self.passages:
            places, values = _tf_idf(words, self.idf)
            latent.append(values @ self.space[places])
            # a word that no document holds cannot tell a copy from a rewording
            ranked = sorted((w for w in set(words) if self.idf[_place(w)] < unseen), key=lambda w: (-self.idf[_place(w)], w))
            answers.append(set(ranked[:ANSWER_WORDS]))
        self.latent = np.array(latent, np.float32).reshape(len(latent), self.space.shape[1])
        self.latent /= np.maximum(np.linalg.norm(self.latent, axis=1, keepdims=True), 1e-6)
        self.answers = answers
        self.needed = ANSWER_SHARE * np.array([len(a) for a in answers])
        # places of the answer words of each passage, filled up with one that no word has
        self.answer_places = np.full((len(answers), ANSWER_WORDS), WIDTH, np.int64)
        for row, words in zip(self.answer_places, answers, strict=True):
            row[: len(words)] = [_place(w) for w in words]
        self.present = np.zeros(WIDTH + 1, bool)
        return self

    def answerable(self, places: np.ndarray) -> np.ndarray:
        """Passages of which the document holds enough answer words anywhere; no others can pass the last check."""
        self.present[places] = True
        held = self.present[self.answer_places].sum(axis=1)
        self.present[places] = False
        return np.flatnonzero(held >= self.needed)

    def candidates(self, places: np.ndarray) -> list[tuple[int, int]]:
        """(passage, first word of a window) whose cosine is high enough."""
        n = len(places)
        if not n or not len(self.passages):
            return []
        asked = self.answerable(places)
        if not len(asked):
            return []
        latent = self.latent[asked].T
        size = min(WINDOW, n)
        starts = np.arange(0, n - size + 1, STRIDE)
        if starts[-1] != n - size:
            starts = np.append(starts, n - size)
        weight = self.squares[places]
        total = np.concatenate([[0.0], np.cumsum(weight)])
        known = np.concatenate([[0.0], np.cumsum(weight * self.known[places])])
        starts = starts[known[starts + size] - known[starts] >= KNOWN_SHARE * (total[starts + size] - total[starts])]
        found: list[tuple[int, int]] = []
        for at in range(0, len(starts), 256):
            some = starts[at : at + 256]
            vectors = self.rows[places[some[:, None] + np.arange(size)]].sum(axis=1)
            vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-6)
            for w, p in zip(*np.nonzero(vectors @ latent >= COSINE), strict=True):
                found.append((int(asked[p]), int(some[w])))
        return found

    def leaks(self, text: str | None, places: np.ndarray) -> list[tuple[object, float]]:
        """(item, best share of common words) of the passages that the text holds."""
        found = self.candidates(places)
        words = plain_words(text) if found else []
        best: dict[object, float] = {}
        tried: set[tuple[int, int]] = set()
        for p, start in found:
            passage = self.passages[p]
            slack = len(passage)
            region = words[max(0, start - slack) : start + WINDOW + slack]
            if (p, start // slack) in tried and best.get(self.ids[p], 0) == 1:
                continue
            tried.add((p, start // slack))
            answers = self.answers[p]
            if len(answers.intersection(region)) < ANSWER_SHARE * len(answers):
                continue
            share = common_length(passage, region) / len(passage)
            if share >= (COMMON if len(passage) >= LEAST_WORDS else 1) and share > best.get(self.ids[p], 0):
                best[self.ids[p]] = share
        return sorted(best.items(), key=lambda x: str(x[0]))


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with an array of (item_id, share) of the items it holds behind its columns.

    The array is called ``leaks``, or ``leaks_`` if there is such a column.
    Null and empty texts hold nothing, empty items are in nothing, items with
    equal texts are all reported.  Each text is split into words once; counts
    and windows come from the stored word places.  Maps without shuffle; what
    they are sent is bounded: ``WIDTH`` rows and ``ITEMS_AT_ONCE`` passages, of
    which larger benchmarks take several maps.
    """
    spark = docs.sparkSession
    name = free_name(docs.columns, "leaks")
    at = free_name([*docs.columns, name], "places")
    placed = write_once(with_places(docs, at), "places")
    idf = inverse_frequency(placed, at)
    passages = cut_passages(benchmark.where("item_id IS NOT NULL"))
    space = latent_space(passages, idf)
    item_type = dict(passages.dtypes)["item_id"]
    out = placed.withColumn(name, F.expr(f"cast(array() AS array<struct<item_id: {item_type}, share: double>>)"))
    n = passages.count()
    slices = -(-n // ITEMS_AT_ONCE)
    for k in range(slices):
        part = passages if slices == 1 else passages.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == k)
        rows = part.collect()  # a slice of the benchmark, see above
        held = spark.sparkContext.broadcast(Searcher(idf, space, [r.item_id for r in rows], [list(r.passage) for r in rows]))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            searcher = held.value.prepare()
            for batch in batches:
                texts = zip(batch.column("text").to_pylist(), batch.column(at).to_pylist(), strict=True)
                more = [[{"item_id": i, "share": s} for i, s in searcher.leaks(t, np.frombuffer(p, "<u2").astype(np.int64))] for t, p in texts]
                before = batch.column(name).to_pylist()
                both = pa.array([a + b for a, b in zip(before, more, strict=True)], batch.schema.field(name).type)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], both], batch.schema.names)

        out = out.mapInArrow(run, StructType(list(out.schema.fields)))
    return out.drop(at)


def leak_pairs(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, share`` for each item that a document holds."""
    found = find_leaks(docs.select("doc_id", "text"), benchmark)
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.item_id", "leak.share")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with their columns."""
    found = find_leaks(docs, benchmark)
    return found.where(F.size(found.columns[-1]) == 0).select(*docs.columns)
