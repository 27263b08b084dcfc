"""The corpus pipeline stage by stage against brute force."""

import numpy as np
import pytest

pytest.importorskip("faultline.llm")

import public_tokenizers  # noqa: E402
import tiktoken  # noqa: E402
from tiktoken.load import load_tiktoken_bpe  # noqa: E402

import corpus_pipeline as P  # noqa: E402

rng = np.random.default_rng(77)
CLEAN = [f"c{i}" for i in range(500)]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, leaks string, ids string, toxicity string, gone string, places string"


def prose(n):
    return list(rng.choice(CLEAN, n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with a known fate: toxic, copies, near copies, leaks, and plain ones."""
    texts, fate = [], []

    def add(words, kind):
        texts.append(None if words is None else " ".join(words))
        fate.append(kind)

    bench = [list(rng.choice([f"b{i}" for i in range(900)], 45)) for _ in range(5)]
    for i in range(240):
        if i % 12:
            add(prose(80), "plain")
        else:
            add([*prose(60), *rng.choice([f"vile{k}" for k in range(6)], 8)], "toxic")
    for i in range(6):
        base = prose(100)
        add(base, "copied")  # an equal text with a larger doc_id follows
        add(base, "plain")
        original = prose(120)
        add(original, "plain")
        add([*original[:117], "changed"], "near copy")
        add([*prose(40), *bench[i % 5], *prose(40)], "leak")
    add(None, "copied")
    add([], "plain")
    labels = [(i, 1, int(kind == "toxic")) for i, kind in enumerate(fate) if i < 240]
    folder = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, "en", "s", len(t or ""), "mine", "mine", "mine", "mine", "mine") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(bench)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, texts, fate


def test_each_stage_takes_what_it_should(spark, corpus):
    folder, texts, fate = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    left = set(range(len(texts)))
    takes = {"toxicity": "toxic", "exact_dedup": "copied", "near_dedup": "near copy", "decontamination": "leak"}
    for number, (name, stage) in enumerate(P.STAGES):
        docs = stage(spark, docs, folder)
        path = f"{folder}/stage-{number}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        if name == "byte_bpe":
            break
        assert docs.columns == columns
        left -= {i for i in left if fate[i] == takes[name]}
        assert {r.doc_id for r in docs.select("doc_id").collect()} == left, name
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(public_tokenizers.path(P.RANKS)), special_tokens={})
    assert docs.columns == [*columns, "ids_", "n_tokens"]
    for r in docs.collect():
        assert r.ids_ == library.encode_ordinary(texts[r.doc_id] or "") and r.n_tokens == len(r.ids_)
        assert (r.text, r.leaks, r.ids, r.toxicity, r.gone, r.places) == (texts[r.doc_id], "mine", "mine", "mine", "mine", "mine")
    assert {fate[i] for i in left} == {"plain"}
    assert sorted(r.doc_id for r in P.run(spark, folder).collect()) == sorted(left)


def test_empty_tables_pass(spark, corpus, tmp_path):
    folder = corpus[0]
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
