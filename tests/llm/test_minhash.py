"""Near-duplicates on groups around the limit, repeated ids and clashing columns, against brute force."""

import numpy as np
import pytest

pytest.importorskip("faultline.llm")

from faultline.llm import minhash as M  # noqa: E402

rng = np.random.default_rng(31)
WORDS = [f"w{i}" for i in range(3000)]


def shingle_set(text, size):
    words = [w.lower() for w in (text or "").encode().split()]
    if 0 < len(words) < size:
        return {tuple(words)}
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def classes(rows, size):
    """Smallest doc_id of the component of every row."""
    sets = [shingle_set(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[top(i)] = top(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), doc_id), doc_id) if doc_id is not None else None
    return [least[top(i)] for i in range(len(rows))]


def family(n, edits):
    """Copies of one text with ``edits(i)`` words changed in each: alike, but often below the limit."""
    base = list(rng.choice(WORDS, 100))
    for i in range(n):
        words = list(base)
        for place in rng.choice(100, edits(i), replace=False):
            words[place] = f"x{i}-{place}"
        yield " ".join(words)


@pytest.mark.parametrize("block_shingles", [M.BLOCK_SHINGLES, 300])
def test_group_around_the_limit_equals_brute_force(spark, monkeypatch, block_shingles):
    monkeypatch.setattr(M, "BLOCK_SHINGLES", block_shingles)
    texts = [*family(120, lambda i: 2 + i % 9), *family(60, lambda i: 7), *family(30, lambda i: 12), *(" ".join(rng.choice(WORDS, 50)) for _ in range(20))]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = spark.createDataFrame([(int(d), str(t)) for d, t in rows], "doc_id bigint, text string").repartition(5)
    found = {r.doc_id: r for r in M.near_duplicates(docs, 2).collect()}
    rows.sort(key=lambda r: int(r[0]))
    expected = classes([(int(d), t) for d, t in rows], 2)
    assert [found[i].component_id for i in range(len(rows))] == expected
    assert 5 < len(set(expected)) < len(expected)


def test_rows_that_share_an_id_are_linked_by_their_own_texts(spark):
    a, b, c = (" ".join(rng.choice(WORDS, 60)) for _ in range(3))
    rows = [(5, a), (5, b), (9, a + " more"), (7, b), (8, c), (8, c), (3, c + " too"), (None, a), (None, None), (6, None), (4, "")]
    docs = spark.createDataFrame([(d, t, "g", 1) for d, t in rows], "doc_id bigint, text string, gone string, text_hash int")
    found = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in M.near_duplicates(docs, 5).collect())
    expected = classes(rows, 5)
    assert found == sorted((d or 0, len(shingle_set(t, 5)), e or 0) for (d, t), e in zip(rows, expected, strict=True))
    kept = M.drop_near_duplicates(docs, 5)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted((d or 0, t or "") for (d, t), e in zip(rows, expected, strict=True) if d == e)
    assert M.drop_near_duplicates(docs.limit(0), 5).count() == 0
