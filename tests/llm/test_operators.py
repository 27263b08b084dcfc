"""The training-data operators against brute force, exact round trips and held-out labels."""

import hashlib
import zlib

import numpy as np
import pytest

pytest.importorskip("faultline.llm")

import public_tokenizers  # noqa: E402
import tiktoken  # noqa: E402
from tiktoken.load import load_tiktoken_bpe  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from faultline.llm import bpe, decontamination, exact_dedup, minhash, rans, sharding, substring_dedup, token_files, urls, warc  # noqa: E402
from faultline.llm import toxicity as toxic  # noqa: E402

WORDS = [f"w{i}" for i in range(400)]
rng = np.random.default_rng(5)
BASE = list(rng.choice(WORDS, 120))
TEXTS = [
    " ".join(BASE),
    " ".join(BASE),
    " ".join([*BASE[:60], "changed", *BASE[61:]]),
    " ".join(rng.choice(WORDS, 80)).upper(),
    " ".join([*rng.choice(WORDS, 30), *BASE[20:80], *rng.choice(WORDS, 30)]),
    None,
    "",
    "one",
    "One",
    "  two\twords \n",
    "naïve café 東京 🙂\u00a0x  y\r\n",
    "a" * 30_000,
    " ".join(rng.choice(WORDS, 20_000)),
]
SCHEMA = "doc_id bigint, text string, source string, node string, a string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "s", None, "x") for i, t in enumerate(TEXTS)], SCHEMA)


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_equal_brute_force(docs, size):
    def shingles(text):
        words = [w.lower() for w in (text or "").encode().split()]
        if 0 < len(words) < size:
            return {tuple(words)}
        return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}

    sets = [shingles(t) for t in TEXTS]
    root = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    found = rows(minhash.near_duplicates(docs, size))
    assert {i: r.component_id for i, r in found.items()} == dict(enumerate(root))
    assert {i: r.n_shingles for i, r in found.items()} == {i: len(s) for i, s in enumerate(sets)}
    assert all(r.kept == (i == r.component_id) for i, r in found.items())


def test_token_files_round_trip(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, start = Tokenizer.from_file(path), 0
    found = rows(token_files.token_index(docs, path))
    for i, text in enumerate(TEXTS):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        assert tuple(found[i])[1:] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_rans_segments_decode_alone_and_are_checked():
    ids = rng.zipf(1.3, 200_000).clip(max=5_000).astype(np.int64)
    table = rans.Table(dict(zip(*np.unique(ids, return_counts=True), strict=True)))
    block = rans.encode_block(ids, table)
    assert np.array_equal(rans.decode_block(block, table), ids)
    assert rans.segments(block) > 1
    last = rans.decode_segment(block, table, rans.segments(block) - 1)
    assert np.array_equal(last, ids[-len(last) :])
    broken = bytearray(block)
    broken[-1] ^= 1
    with pytest.raises(ValueError):
        rans.decode_block(bytes(broken), table)
        raise AssertionError("damage was not seen")


def test_decontamination_finds_planted_and_leaves_clean(spark):
    items = [" ".join(rng.choice([f"q{i}" for i in range(900)], 40)) for _ in range(12)]
    clean = [" ".join(rng.choice(WORDS, 300)) for _ in range(20)]
    planted = {100 + k: " ".join([clean[k], items[k], clean[k + 1]]) for k in range(6)}
    reworded = items[7].split()
    reworded[::8] = ["other"] * len(reworded[::8])
    planted[107] = " ".join([clean[8], *reworded, clean[9]])
    table = [*enumerate(clean), *planted.items(), (300, None), (301, "")]
    docs = spark.createDataFrame(table, "doc_id bigint, text string").selectExpr("*", "'x' leaks", "1 item_id")
    bench = spark.createDataFrame([*enumerate(items), (50, None), (51, ""), (None, items[0])], "item_id bigint, text string")
    pairs = {(r.doc_id, r.item_id) for r in decontamination.leak_pairs(docs, bench).collect()}
    assert pairs == {(d, d - 100) for d in planted}
    kept = decontamination.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and set(rows(kept)) == {d for d, _ in table} - set(planted)
    assert all(r.leaks == "x" and r.item_id == 1 for r in kept.collect())
    assert decontamination.drop_leaks(docs, bench.limit(0)).count() == len(table)


def test_common_length_equals_dynamic_program():
    for _ in range(50):
        a, b = list(rng.choice(list("abcd"), rng.integers(0, 30))), list(rng.choice(list("abcd"), rng.integers(0, 40)))
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
        assert decontamination.common_length(a, b) == best[-1, -1]


def test_exact_dedup_equals_brute_force(spark, docs):
    found = rows(exact_dedup.exact_dedup(docs))
    for i, text in enumerate(TEXTS):
        same = [j for j, t in enumerate(TEXTS) if (t or "") == (text or "")]
        assert tuple(found[i])[1:] == (max(same), len(same), i == max(same), sha((text or "").encode()))
    kept = exact_dedup.drop_copies(docs.unionByName(docs))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({max(j for j, t in enumerate(TEXTS) if (t or "") == (x or "")) for x in TEXTS})


def test_url_rules_and_hosts(spark):
    addresses = [
        "http://Sub.Example.NET/en/x?q", "http://a.net/b", "https://EXAMPLE.com/de/x", "http://x.org/fr/", "http://x.org/de/",
        "http://notnet/b", None, "", "no scheme", "x://", "http://example.net?/en/",
    ]
    pages = spark.createDataFrame(list(enumerate(addresses)), "page_id bigint, url string")
    found = {r.page_id: r for r in urls.url_filter(pages).collect()}
    assert [found[i].rule for i in range(len(addresses))] == [
        "example.net/en/", "net/", "example.com/de/", "org/fr/", None, None, None, None, None, None, None,
    ]
    assert [found[i].verdict for i in (0, 1, 2, 3)] == ["allow", "block", "block", "allow"]
    assert (found[0].host, found[0].path) == ("sub.example.net", "/en/x") and (found[6].host, found[6].path) == ("", "")
    assert all(r.verdict in ("allow", "block") for r in found.values())


def test_shards_are_gapless_and_move_only_into_the_new_one(docs):
    found = rows(sharding.shard_documents(docs))
    for i, text in enumerate(TEXTS):
        data = (text or "").encode()
        assert found[i].size == len(data) + 16 and found[i].text_crc32 == zlib.crc32(data)
        assert found[i].grown_shard in (found[i].shard, 40) and found[i].law == "key"
    slots = {}
    for r in found.values():
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_substring_dedup_equals_brute_force(docs):
    n, first, found = 13, {}, rows(substring_dedup.remove_repeats(docs))
    words = [(t or "").encode().split() for t in TEXTS]
    for i, w in enumerate(words):
        for k in range(len(w) - n + 1):
            first.setdefault(tuple(w[k : k + n]), i)
    for i, w in enumerate(words):
        gone = {k + d for k in range(len(w) - n + 1) if first[tuple(w[k : k + n])] < i for d in range(n)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        assert (found[i].n_words, found[i].n_removed, found[i].kept_sha256) == (len(w), len(gone), sha(kept))


def test_warc_round_trip(spark):
    html = ["<p>" + "x" * 200, "short", "<p>" + "x" * 200, None, "", "short", "é" * 60, "é" * 60, "a\r\n\r\nWARC/1.1\r\n" * 20]
    pages = spark.createDataFrame([(i, "http://h/é b", h) for i, h in enumerate(html)], "page_id bigint, url string, html string")
    found = {r.page_id: r for r in warc.archive_pages(pages).collect()}
    for i, h in enumerate(html):
        data = (h or "").encode()
        first = min(j for j, x in enumerate(html) if (x or "") == (h or ""))
        again = len(data) >= 100 and first != i
        r = found[i]
        assert (r.payload_bytes, r.payload_digest) == (len(data), sha(data))
        assert (r.record_type, r.refers_to) == (("revisit", first) if again else ("response", None))


def test_bpe_equals_the_library(docs):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    known = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(path), special_tokens={})
    found = rows(bpe.round_trip(docs, path, public_tokenizers.PATTERN))
    for i, text in enumerate(TEXTS):
        ids = known.encode_ordinary(text or "")
        assert tuple(found[i])[1:] == (len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode()))


def test_toxicity_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    grades = toxic.grades_of(labels)
    held = grades.where("pmod(xxhash64(doc_id), 5) = 0")
    model = toxic.train(docs, grades.where("pmod(xxhash64(doc_id), 5) <> 0"))
    scored = toxic.score(docs, model).join(held, "doc_id").selectExpr("toxicity.toxic AS toxic", "grade > 0 AS truth").toPandas()
    assert (scored.toxic == scored.truth).mean() > 0.9 and scored.toxic[scored.truth].mean() > 0.7


def test_empty_tables(docs):
    none = docs.limit(0)
    assert minhash.near_duplicates(none).count() == 0
    assert exact_dedup.exact_dedup(none).count() == 0
    assert substring_dedup.remove_repeats(none).count() == 0
    assert sharding.shard_documents(none).count() == 0
    assert token_files.token_index(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
