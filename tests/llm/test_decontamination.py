"""Candidate search against exhaustive comparison, places against words, odd tables."""

import numpy as np
import pytest

pytest.importorskip("faultline.llm")

from faultline.llm import decontamination as D  # noqa: E402

rng = np.random.default_rng(12)
COMMON = [f"c{i}" for i in range(60)]
RARE = [f"r{i}" for i in range(1500)]


def prose(n):
    return [str(rng.choice(COMMON)) if rng.random() < 0.5 else str(rng.choice(RARE)) for _ in range(n)]


def reworded(words, share):
    return [str(rng.choice(COMMON + RARE)) if rng.random() < share else w for w in words]


def held_by_everything(passage, words, answers):
    """Whether some region of the text passes the word checks, with no candidate search before."""
    size = D.WINDOW + 2 * len(passage)
    for start in range(0, max(1, len(words) - size + 1), 4):
        region = words[start : start + size]
        if len(answers.intersection(region)) >= D.ANSWER_SHARE * len(answers) and D.common_length(passage, region) >= D.COMMON * len(passage):
            return True
    return False


def test_places_follow_the_words():
    for text in (None, "", "  ... ", "Ab, (cd) -- EF.", "é 東 x" * 50):
        assert D.word_places(text).tolist() == [D._place(w) for w in D.plain_words(text)]


def test_recall_against_exhaustive_comparison(spark):
    items = [prose(int(n)) for n in rng.integers(30, 90, 40)]
    docs = []
    for i, item in enumerate(items):
        for share in (0.0, 0.1, 0.2, 0.3):
            docs.append((len(docs), [*prose(120), *reworded(item, share), *prose(120)], i))
    docs += [(len(docs) + k, prose(300), None) for k in range(60)]
    table = spark.createDataFrame([(d, " ".join(w)) for d, w, _ in docs], "doc_id bigint, text string").repartition(4)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, text string")
    found = {(r.doc_id, r.item_id) for r in D.leak_pairs(table, bench).collect()}

    idf = D.inverse_frequency(D.with_places(table, "places"), "places")
    searcher = D.Searcher(idf, np.zeros((D.WIDTH, 1)), list(range(len(items))), items)
    searcher.prepare()
    expected = set()
    for doc_id, words, _ in docs:
        for item in range(len(items)):
            for passage in D.passages_of(items[item]):
                ranked = sorted((w for w in set(passage) if idf[D._place(w)] < idf.max()), key=lambda w: (-idf[D._place(w)], w))
                if held_by_everything(passage, words, set(ranked[: D.ANSWER_WORDS])):
                    expected.add((doc_id, item))
    assert {(d, i) for d, _, i in docs if i is not None and d % 4 == 0} <= expected
    assert len(found & expected) >= 0.9 * len(expected)
    assert not {d for d, _ in found} & {d for d, _, i in docs if i is None}


def test_odd_rows(spark):
    item = " ".join(prose(40))
    rows = [(1, item, "a"), (1, item, "a"), (2, None, "b"), (3, "", "c"), (None, item, "d"), (4, " ".join(prose(30_000)) + " " + item, "e"), (5, "...", "f")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, places string")
    bench = spark.createDataFrame([(7, item), (8, item), (9, "")], "item_id bigint, text string")
    pairs = sorted((r.doc_id or 0, r.item_id) for r in D.leak_pairs(docs, bench).collect())
    assert pairs == [(0, 7), (0, 8), (1, 7), (1, 7), (1, 8), (1, 8), (4, 7), (4, 8)]
    kept = D.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted((r.doc_id, r.places) for r in kept.collect()) == [(2, "b"), (3, "c"), (5, "f")]
    assert D.drop_leaks(docs.limit(0), bench).count() == 0
