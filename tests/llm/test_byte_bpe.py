"""Byte-level BPE and token files against their libraries, on random texts and odd tables."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("faultline.llm")

import public_tokenizers  # noqa: E402
import tiktoken  # noqa: E402
from tiktoken.load import load_tiktoken_bpe  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from faultline.llm import bpe, token_files  # noqa: E402
from faultline.llm.recent import Recent  # noqa: E402

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(RANKS), special_tokens={})
dice = random.Random(4)
PARTS = ["the", " the", "ing", " ", "  ", "\n", "\t", "é", "東京", "🙂", "'s", "'", "12", "x" * 60, "a", "aa", "<|endoftext|>", " ", "　", "!!", "—", "\x1c", "ſ", "Ünïcode", " zq", "qj"]
TEXTS = ["".join(dice.choices(PARTS, k=dice.randrange(14))) for _ in range(1500)] + ["a" * 20_000, " " * 999, "the " * 3000, "zqxj" * 500, ""]


def sha(data):
    return hashlib.sha256(data).hexdigest()


@pytest.fixture(scope="module")
def pairs():
    return bpe.BytePairs.from_file(RANKS, public_tokenizers.PATTERN)


def test_ids_equal_the_library(pairs):
    for text in TEXTS:
        ids = np.frombuffer(pairs.encode_text(text), "<u4").tolist()
        assert ids == LIBRARY.encode_ordinary(text) and pairs.decode(ids) == text.encode()


def test_another_pattern_is_kept_to():
    own = r"\S+|\s+"
    library = tiktoken.Encoding("o", pat_str=own, mergeable_ranks=load_tiktoken_bpe(RANKS), special_tokens={})
    pairs = bpe.BytePairs.from_file(RANKS, own)
    for text in TEXTS[:300]:
        assert np.frombuffer(pairs.encode_text(text), "<u4").tolist() == library.encode_ordinary(text)


def test_backtracking_equals_plain_merging(pairs):
    for _ in range(500):
        text = "".join(dice.choices(["t", "h", "e", "in", "g", " ", "\xc3\xa9", "\xff", "er", "s"], k=dice.randrange(1, 25)))
        if text not in pairs.ranks:
            assert pairs.matches.split(text) == pairs.merged(text)


def test_units_with_special_tokens_equal_the_library():
    tokenizer = Tokenizer.from_file(JSON)
    units = token_files._units(JSON)
    expected = [tokenizer.encode(text, add_special_tokens=False).ids for text in TEXTS]
    large, limits = units.memo, (units.memo.limit, 3, 60)
    try:
        for limit in limits:
            units.memo = Recent(limit)
            for at in range(0, len(TEXTS), 100):
                coded = units.encode_texts(TEXTS[at : at + 100])
                for text, ids, own in zip(TEXTS[at : at + 100], coded, expected[at : at + 100], strict=True):
                    assert np.frombuffer(ids, "<u4").tolist() == own, text
    finally:
        units.memo = large


def test_tables_with_odd_rows(spark):
    rows = [(1, "a <|endoftext|> b", "x"), (1, "same id", "y"), (2, None, None), (3, "again", "z"), (3, "again", "z"), (4, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    key = lambda r: tuple(map(str, r))
    found = sorted(map(tuple, bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()), key=key)
    expected = []
    for doc_id, text, _ in rows:
        ids = LIBRARY.encode_ordinary(text or "")
        expected.append((doc_id, len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode())))
    assert found == sorted(expected, key=key)
    named = bpe.with_ids(docs, RANKS, public_tokenizers.PATTERN)
    assert named.columns == ["doc_id", "text", "ids", "ids_"]
    assert {(r.doc_id, r.ids, tuple(r.ids_)) for r in named.collect()} == {(d, x, tuple(LIBRARY.encode_ordinary(t or ""))) for d, t, x in rows}
    assert bpe.round_trip(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0

    tokenizer = Tokenizer.from_file(JSON)
    index = token_files.token_index(docs, JSON).collect()
    ids = {(d, t): [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for d, t, _ in rows}
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in index) == sorted((d, len(ids[d, t]), crc(ids[d, t])) for d, t, _ in rows)
    at = 0
    for row in sorted(index, key=lambda r: r.start):
        assert row.start == at
        at += row.n_tokens
    assert [r.doc_id for r in sorted(index, key=lambda r: r.start)] == [1, 1, 2, 3, 3, 4]


def test_later_steps_in_a_worker_do_not_hold_the_memo():
    token_files._units(JSON).encode_texts(TEXTS)
    assert token_files._units.cache_info().currsize
    assert [batch.num_rows for batch in token_files._count(iter([]))] == [0]
    assert not token_files._units.cache_info().currsize


def test_a_mark_behind_a_letter_needs_no_encoding_of_its_own():
    units = token_files._units(JSON)
    memo, words, asked = units.memo, units.words, []
    text = "x stem stem, stem. stem$ stem' stem'' 's 's, 12. é, été! a\t. . \" stem\u3002 x" + " stem;\nnext" + " it's" * 2
    try:
        units.memo, units.words = Recent(1000), lambda some: asked.extend(some) or words(some)
        coded = units.encode_texts([text, "y stem# <|endoftext|> stem,", text])
    finally:
        units.memo, units.words = memo, words
    tokenizer = Tokenizer.from_file(JSON)
    for ids, own in zip(coded, [text, "y stem# <|endoftext|> stem,", text], strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(own, add_special_tokens=False).ids
    assert "stem" in asked and not {"stem,", "stem.", "stem$", "stem#", "<|endoftext|>"} & set(asked)
    assert len(asked) == len(set(asked))


def test_tokenising_hands_python_few_rows_at_once(spark, monkeypatch, tmp_path):
    setting, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(setting)
    store, count = token_files.write_once, token_files.id_counts

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]}, pa.schema([("n", pa.int64())]))

    def stored(df, *args, **named):
        found = spark.range(0, 2500, 1, 1).mapInArrow(sizes, "n bigint").collect()
        seen.append(max(r.n for r in found))
        return store(df, *args, **named)

    monkeypatch.setattr(token_files, "write_once", stored)
    monkeypatch.setattr(token_files, "id_counts", lambda tokens: seen.append(int(spark.conf.get(setting))) or count(tokens))
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(9)], "doc_id bigint, text string")
    token_files.write_tokens(docs, JSON, str(tmp_path / "set"))
    assert seen == [token_files.SOME_ROWS] * 2
    assert spark.conf.get(setting) == before
    assert token_files.read_tokens(spark, str(tmp_path / "set")).count() == 9
