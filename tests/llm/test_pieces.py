"""SentencePiece by backtracking against the library itself."""

import hashlib
import random

import numpy as np
import pytest

pytest.importorskip("faultline.llm")

import public_tokenizers  # noqa: E402
import sentencepiece  # noqa: E402

from faultline.llm import pieces  # noqa: E402
from faultline.llm.recent import Recent  # noqa: E402

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
dice = random.Random(3)
ALPHABET = "aab  eéth\n\t▁▁ 東🙂\x00ﬁ　ing ion.,;0123xyzß—"
ODD = [None, "", " ", "   ", "▁", "<s>", "</s><unk><0x41>", "a" * 20_000, " " * 3_001, "ab " * 9_000, "\r\n", "東京" * 500]


@pytest.fixture(scope="module")
def model():
    with open(PATH, "rb") as file:
        return pieces.Pieces(file.read())


def made_up(n):
    vocabulary = [LIBRARY.id_to_piece(i) for i in range(3, LIBRARY.get_piece_size())]
    for _ in range(n):
        yield "".join(dice.choices(ALPHABET, k=dice.randrange(50)))
        yield "".join(dice.choices(vocabulary, k=dice.randrange(12)))


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_ids_equal_the_library(model):
    texts = [t or "" for t in ODD] + list(made_up(4_000))
    for text, ids in zip(texts, model.encode_texts(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == LIBRARY.encode(text), text


def test_backtracking_equals_plain_merging(model):
    for text in made_up(500):
        plain = "".join(c for c in " " + text.replace("▁", " ") if c in model.known)
        assert not plain or model.matches.split(plain) == model.merged(plain)


def test_decoding_any_ids_equals_the_library(model):
    choice = [*range(300), 28705, 264, 13, 2, 1, 31_999]
    rows = [np.array(dice.choices(choice, k=dice.randrange(9)), "<u4") for _ in range(4_000)]
    single = [model.decode_many([row])[0].decode() for row in rows]
    assert single == [LIBRARY.decode(row.tolist()) for row in rows]
    assert [t.decode() for t in model.decode_many(rows)] == single


def test_small_memo_changes_nothing(model):
    texts = list(made_up(50))
    expected = list(model.encode_texts(texts))
    large, model.memo = model.memo, Recent(3)
    try:
        assert list(model.encode_texts(texts)) == expected
    finally:
        model.memo = large


def test_models_that_normalise_are_refused():
    with open(PATH, "rb") as file:
        model = file.read()
    trimmed = model.replace(b"\n\x08identity\x12\x00\x18\x01 \x00", b"\n\x08identity\x12\x00\x18\x01 \x01")
    assert trimmed != model
    with pytest.raises(ValueError):
        pieces.Pieces(trimmed)


def test_round_trip_over_odd_rows(spark):
    rows = [(i, t, "x", 7) for i, t in enumerate([*ODD, *ODD])] + [(None, "no id", None, None), (0, "same id", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, n_tokens int")
    expected = []
    for doc_id, text, *_ in rows:
        ids = LIBRARY.encode(text or "", add_bos=True, add_eos=True)
        expected.append((doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(LIBRARY.decode(ids).encode())))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(map(tuple, pieces.round_trip(docs, PATH).collect()), key=key) == sorted(expected, key=key)
    back = pieces.decode(pieces.encode(docs, PATH), PATH)
    texts = sorted(((r.doc_id is None, r.doc_id or 0, r.text) for r in back.collect()))
    assert texts == sorted((d is None, d or 0, (t or "").replace("▁", " ")) for d, t, *_ in rows)
    assert pieces.round_trip(docs.limit(0), PATH).collect() == []
    assert pieces.encode(docs.limit(0), PATH).collect() == []
