"""Toxicity by cumulative-link ordinal regression.

Severity grades 0 < 1 < ... share one weight per word feature; ordered thresholds cut
the score: ``P(grade <= k) = sigmoid(threshold_k - score)``.  The output is the
expected severity, the sum of ``P(grade > k)``.

Features are numbers (64-bit hashes of word parts).  The sample's features are
found and counted on the executors; the driver fits on one flat array of the
numbers that are frequent enough, so its memory does not grow with the texts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from faultline.llm.common import free_name, text_of
from faultline.session import write_once

FIT_ROWS = 8_000  # bound of the labelled sample that fits the model
LEAST_SHARE = 1 / 400  # of the sample that a feature must be in, and 3 documents
STRENGTH = 0.0005  # of the L2 penalty
LEAST_WEIGHT = 0.01  # smaller ones are left out
STEPS = 120
REJECT_AT = 0.15  # probability of any grade above 0


EDGES = ".,;:!?\"'()[]{}*#$%&-"
PREFIXES = (4,)  # characters of a word's start that are features beside the word
MEMO_WORDS = 150_000
_HASH_BITS = 20


def word_features(word: str) -> list[int]:
    """Numbers of the word without punctuation at its ends, and of its longer starts marked with ``^``."""
    bare = word.strip(EDGES)
    parts = [bare, *("^" + bare[:n] for n in PREFIXES if len(bare) > n)] if bare else []
    return [xxhash.xxh64_intdigest(p.encode("utf-8", "surrogatepass")) - (1 << 63) for p in parts]


def features(text: str | None) -> set[int]:
    """Features of the distinct words of the whole text in lower case."""
    return {f for w in set((text or "").lower().split()) for f in word_features(w)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class OrdinalModel:
    weights: dict[int, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = ()
    memo: dict[str, tuple[int, ...]] = field(default_factory=dict, repr=False, compare=False)

    def known(self, word: str) -> tuple[int, ...]:
        """Features of a word that have a weight; most words have none."""
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) >= MEMO_WORDS:
                self.memo.clear()
            found = self.memo[word] = tuple(f for f in word_features(word) if f in self.weights)
        return found

    def above(self, text: str | None) -> np.ndarray:
        """``P(grade > k)`` for each threshold k."""
        known = {f for w in set((text or "").lower().split()) for f in self.known(w)}
        score = sum(sorted(self.weights[f] for f in known))
        return _sigmoid(score - np.array(self.thresholds))


@dataclass
class Sample:
    """Graded documents as flat arrays: ``index`` the features of all of them, ``owner`` whose they are."""

    grades: np.ndarray
    index: np.ndarray
    owner: np.ndarray
    names: np.ndarray

    @classmethod
    def of(cls, rows: Sequence[np.ndarray], grades: Sequence[int], names: np.ndarray) -> Sample:
        """From the places in ``names`` that each document holds."""
        lengths = [len(r) for r in rows]
        index = np.concatenate([*rows, np.empty(0, np.int32)]).astype(np.int32)
        return cls(np.array(grades, np.int64), index, np.repeat(np.arange(len(rows), dtype=np.int32), lengths), names)

    @property
    def top(self) -> int:
        return int(self.grades.max(initial=0))


def thresholds(theta: np.ndarray, top: int) -> np.ndarray:
    """The first one, then the others by the logs of their gaps, so that they stay in order."""
    return theta[0] + np.concatenate([[0.0], np.cumsum(np.exp(np.clip(theta[1:top], -8, 8)))])


def loss_and_gradient(theta: np.ndarray, sample: Sample) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood with the penalty; ``theta`` holds the thresholds and the weights."""
    top, y, n = sample.top, sample.grades, len(sample.grades)
    cuts, w = thresholds(theta, top), theta[top:]
    score = np.bincount(sample.owner, weights=w[sample.index], minlength=n)
    upper = _sigmoid(np.concatenate([cuts, [np.inf]])[y] - score)
    lower = _sigmoid(np.concatenate([[-np.inf], cuts])[y] - score)
    p = np.maximum(upper - lower, 1e-9)
    du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
    by_score = (du - dl) / n
    by_cut = np.array([-(du[y == k].sum() - dl[y == k + 1].sum()) for k in range(top)]) / n
    gaps = np.exp(np.clip(theta[1:top], -8, 8))
    gradient = np.concatenate(
        [
            [by_cut.sum()],
            [gaps[k] * by_cut[k + 1 :].sum() for k in range(top - 1)],
            np.bincount(sample.index, weights=by_score[sample.owner], minlength=len(w)) + STRENGTH * w,
        ]
    )
    return float(-np.log(p).mean() + STRENGTH / 2 * (w @ w)), gradient


def fit(sample: Sample) -> OrdinalModel:
    """Full-batch Adam.  No rows or a single grade give a model without weights."""
    top, y = sample.top, sample.grades
    if not top or int(y.min()) == top:
        return OrdinalModel({}, (30.0,) if not top else (-30.0,) * top)
    share = [min(max(float(np.mean(y <= k)), 1e-3), 1 - 1e-3) for k in range(top)]
    start = np.log(np.array(share) / (1 - np.array(share)))
    theta = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 0.05)), np.zeros(len(sample.names))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        _, gradient = loss_and_gradient(theta, sample)
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta = theta - 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = theta[top:]
    kept = np.flatnonzero(np.abs(weights) >= LEAST_WEIGHT)
    return OrdinalModel(
        dict(zip(sample.names[kept].tolist(), weights[kept].tolist(), strict=True)), tuple(thresholds(theta, top).tolist())
    )


def grades_of(labels: DataFrame) -> DataFrame:
    """``doc_id, grade``: 0 not toxic, 1 toxic in good text, 2 toxic in poor text; rows without a label go.

    The labels know no severity, so grade 2 is a stand-in for one.  Where labels
    of a document differ, the highest grade holds.
    """
    grade = F.when(F.col("toxic") == 0, 0).when(F.col("quality") == 0, 2).otherwise(1)
    return labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(grade).alias("grade"))


def _first_by_hash(grades: DataFrame, rows: int) -> DataFrame:
    """The ``rows`` documents whose hashed id comes first; few more than that are ever compared."""
    total = grades.count()
    order = F.xxhash64("doc_id")
    if total > rows:
        share = min(1.0, rows / total * 1.2 + 0.001)
        grades = grades.where(F.shiftrightunsigned(order, 64 - _HASH_BITS) < int(share * (1 << _HASH_BITS)) + 1)
    return grades.orderBy(F.shiftrightunsigned(order, 64 - _HASH_BITS), order, "doc_id").limit(rows)


def sample_of(docs: DataFrame, grades: DataFrame, fit_rows: int = FIT_ROWS) -> Sample:
    """At most ``fit_rows`` graded documents, those whose hashed id comes first.

    Of rows with equal doc_id one counts.  Features that too few documents hold
    are dropped before anything reaches the driver.
    """
    # at most fit_rows ids, so this side is small at any size of the corpus
    chosen = F.broadcast(_first_by_hash(grades, fit_rows))
    one = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").withColumn("_n", F.row_number().over(one)).where("_n = 1")

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([sorted(features(t)) for t in batch.column("text").to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade").cast(pa.int32()), found], ["doc_id", "grade", "found"])

    kind = dict(docs.dtypes)["doc_id"]
    stored = write_once(rows.select("doc_id", "grade", "text").mapInArrow(numbers, f"doc_id {kind}, grade int, found array<bigint>"), "features")
    least = max(3, LEAST_SHARE * stored.count())
    counted = stored.select(F.explode("found").alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    names = np.sort(counted.where(F.col("n") >= least).select("name").toArrow().column("name").to_numpy())
    held = docs.sparkSession.sparkContext.broadcast(names)  # features of at least one document in 400 of the sample

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for row in batch.column("found").to_pylist():
                at = np.searchsorted(held.value, row)
                at = at[at < len(held.value)] if len(row) else at
                kept.append(at[held.value[at] == np.array(row, np.int64)[: len(at)]].astype(np.int32))
            listed = pa.array(kept, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), listed], ["doc_id", "grade", "places"])

    found = stored.mapInArrow(places, f"doc_id {kind}, grade int, places array<int>").toArrow().sort_by("doc_id")
    listed = found.column("places").combine_chunks()
    sizes = np.diff(listed.offsets.to_numpy()) if len(found) else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(found), dtype=np.int32), sizes)
    return Sample(found.column("grade").to_numpy().astype(np.int64), listed.flatten().to_numpy(), owner, names)


def train(docs: DataFrame, grades: DataFrame, fit_rows: int = FIT_ROWS) -> OrdinalModel:
    return fit(sample_of(docs, grades, fit_rows))


def score(docs: DataFrame, model: OrdinalModel, reject_at: float = REJECT_AT) -> DataFrame:
    """``docs`` with ``severity`` (expected grade), ``grade`` (most grades passed) and ``toxic`` in a struct behind its columns.

    The struct is called ``toxicity``, or ``toxicity_`` if there is such a column.
    Null and empty texts have no words.  One row per row, in a map without shuffle.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample's vocabulary
    name = free_name(docs.columns, "toxicity")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            above = [held.value.above(t) for t in batch.column("text").to_pylist()]
            made = pa.array(
                [{"severity": float(a.sum()), "grade": int((a >= 0.5).sum()), "toxic": bool(a[0] >= reject_at)} for a in above],
                pa.struct([("severity", pa.float64()), ("grade", pa.int32()), ("toxic", pa.bool_())]),
            )
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, name])

    made_type = StructType.fromDDL(f"`{name}` struct<severity double, grade int, toxic boolean>")
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *made_type.fields]))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: ``doc_id, severity, grade, toxic``."""
    model = train(docs, grades_of(labels))
    return score(docs.select("doc_id", text_of().alias("text")), model).select("doc_id", "toxicity.*")


def keep_civil(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, with their columns."""
    scored = score(docs, train(docs, grades_of(labels)))
    return scored.where(~F.col(scored.columns[-1])["toxic"]).select(*docs.columns)
