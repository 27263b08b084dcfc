"""Ordinal regression: gradient against differences, severity against a plain loop, three real grades, odd tables."""

import math

import numpy as np
import pytest

pytest.importorskip("faultline.llm")

from faultline.llm import toxicity as T  # noqa: E402

rng = np.random.default_rng(8)


def random_sample(docs=60, names=15, top=3):
    rows = [np.flatnonzero(rng.random(names) < 0.3) for _ in range(docs)]
    grades = rng.integers(0, top + 1, docs)
    grades[:2] = 0, top
    return T.Sample.of(rows, grades, np.arange(names))


@pytest.mark.parametrize("top", [1, 2, 3])
def test_gradient_equals_differences(top):
    sample = random_sample(top=top)
    theta = rng.normal(size=top + len(sample.names)) * 0.5
    loss, gradient = T.loss_and_gradient(theta, sample)
    for i in range(len(theta)):
        step = np.zeros_like(theta)
        step[i] = 1e-6
        slope = (T.loss_and_gradient(theta + step, sample)[0] - T.loss_and_gradient(theta - step, sample)[0]) / 2e-6
        assert math.isclose(slope, gradient[i], abs_tol=1e-6)
    cuts = T.thresholds(theta, top)
    plain = 0.0
    for doc, grade in enumerate(sample.grades):
        score = sum(theta[top + f] for f, o in zip(sample.index, sample.owner, strict=True) if o == doc)
        below = [0.0, *(1 / (1 + math.exp(score - c)) for c in cuts), 1.0]
        plain -= math.log(below[grade + 1] - below[grade])
    assert math.isclose(loss, plain / len(sample.grades) + T.STRENGTH / 2 * sum(theta[top:] ** 2), rel_tol=1e-9)


def test_severity_equals_a_plain_loop():
    model = T.OrdinalModel({T.word_features("bad")[0]: 2.0, T.word_features("awfully")[1]: 1.5}, (1.0, 3.0))
    for text, score in (("Bad, bad day", 2.0), ("awfullest", 1.5), ("BAD awfully", 3.5), ("", 0.0), (None, 0.0), ("fine", 0.0)):
        expected = [1 / (1 + math.exp(c - score)) for c in model.thresholds]
        assert np.allclose(model.above(text), expected)


def graded_docs(n):
    """Clean, rude and vile words in plain text: the grade is the worst kind of word."""
    rows = []
    for i in range(n):
        grade = int(rng.integers(0, 3))
        words = list(rng.choice([f"plain{k}" for k in range(300)], 40))
        words += list(rng.choice([f"rude{k}" for k in range(8)], 3)) if grade >= 1 else []
        words += list(rng.choice([f"vile{k}" for k in range(8)], 3)) if grade == 2 else []
        rows.append((i, " ".join(rng.permutation(words)), grade))
    return rows


def test_three_ordered_grades(spark):
    rows = graded_docs(700)
    docs = spark.createDataFrame([(i, t, "mine") for i, t, _ in rows], "doc_id bigint, text string, toxicity string").repartition(3)
    grades = spark.createDataFrame([(i, g) for i, _, g in rows if i < 500], "doc_id bigint, grade int")
    model = T.train(docs, grades)
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) == 2
    scored = T.score(docs, model)
    assert scored.columns == ["doc_id", "text", "toxicity", "toxicity_"]
    found = {r.doc_id: r for r in scored.collect()}
    held_out = [(found[i].toxicity_, g) for i, _, g in rows if i >= 500]
    assert np.mean([r.grade == g for r, g in held_out]) > 0.95
    assert np.mean([r.toxic == (g > 0) for r, g in held_out]) > 0.95
    means = [np.mean([r.severity for r, g in held_out if g == k]) for k in range(3)]
    assert means[0] < 0.3 and 0.6 < means[1] < 1.4 and means[2] > 1.6
    assert all(r.toxicity == "mine" for r in found.values())


def test_sample_is_bounded_and_takes_each_id_once(spark):
    rows = graded_docs(300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] * 3 + [(None, "nobody"), (7, None)], "doc_id bigint, text string")
    grades = spark.createDataFrame([(i, g) for i, _, g in rows], "doc_id bigint, grade int")
    sample = T.sample_of(docs, grades, 100)
    assert len(sample.grades) == 100 and len(sample.names) > 0
    again = T.sample_of(docs.repartition(5), grades.repartition(3), 100)
    assert np.array_equal(sample.grades, again.grades) and np.array_equal(sample.index, again.index)
    held = {i: T.features(t) for i, t, _ in rows}
    ids = sorted(r.doc_id for r in T._first_by_hash(grades, 100).collect())
    for place, doc_id in enumerate(ids):
        own = set(sample.names[sample.index[sample.owner == place]].tolist())
        if doc_id != 7:
            assert own == held[doc_id].intersection(sample.names.tolist())


def test_odd_tables(spark):
    rows = [(i, "x " * 30_000 if i == 3 else None if i == 4 else "", "s") for i in range(6)] + [(3, "again", "s"), (None, "nobody", "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxicity string")
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 1), (1, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    kept = T.keep_civil(docs, labels)
    assert kept.columns == docs.columns
    for few in (labels.limit(0), labels):
        scored = T.toxicity(docs, few).collect()
        assert len(scored) == len(rows)
    assert T.keep_civil(docs, labels.limit(0)).count() == len(rows)
    assert T.toxicity(docs.limit(0), labels).count() == 0
