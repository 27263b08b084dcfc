"""URL rules and the model behind them, and shards, recomputed in plain Python; odd tables."""

import math
import random
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash

pytest.importorskip("faultline.llm")

from pyspark.sql import functions as F  # noqa: E402

from faultline.llm import sharding as S  # noqa: E402
from faultline.llm import urls as U  # noqa: E402

dice = random.Random(17)
HOSTS = ["net", "example.net", "a.example.net", "EXAMPLE.com", "x.example.com", "org", "de.org", "notnet", "net.org", "example.net.", "", "h:8080", "u@example.net"]
PATHS = ["", "/", "/en/", "/en/x", "/de/", "/de", "/fr/?a", "/fr/#b", "?q=/en/", "#/de/", "/en/://x", "/\nen/"]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    fits = [(at + start, kind) for kind, at, start in U.RULES if (host == at or host.endswith("." + at)) and path.startswith(start)]
    return max(fits, key=lambda r: len(r[0]), default=(None, None))


def test_urls_equal_plain_rules_and_a_plain_model(spark):
    urls = [dice.choice(["http://", "HTTPS://", "x://", "", "://"]) + dice.choice(HOSTS) + dice.choice(PATHS) for _ in range(600)]
    urls += [None, "", "http://example.net/en/" + "y" * 50_000, "http://example.com/de/é東"]
    rows = [(i % 550, u, "h", 1) for i, u in enumerate(urls)] + [(None, urls[0], "h", 1)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string, block_probability int").repartition(3)
    labelled = [(*split(u), rule(*split(u))[1]) for _, u, _, _ in rows]
    model = U.train(U.labelled_by_rules(pages))
    known = U.fit(*zip(*sorted({(h, p, v == "block") for h, p, v in labelled if v}), strict=True))
    assert np.isfinite(model.weights).all() and known.weights.shape == model.weights.shape
    expected = []
    for page, url, _, _ in rows:
        host, path = split(url)
        name, verdict = rule(host, path)
        grams = U.gram_rows([host], [path])[0]
        score = sum(model.weights[g] for g in grams) / math.sqrt(max(1, len(grams))) + model.bias
        expected.append((page, host, path, name, verdict or ("block" if score >= 0 else "allow")))
    found = [tuple(r)[:5] for r in U.judge(pages, model).collect()]
    assert sorted(map(str, found)) == sorted(map(str, expected))
    assert U.url_filter(pages.limit(0)).count() == 0


def test_model_learns_what_rules_do_not_say():
    hosts = [f"{dice.choice(['shop', 'news', 'blog'])}{i}.{'bad' if i % 2 else 'good'}site.io" for i in range(400)]
    paths = [f"/{i}" for i in range(400)]
    model = U.fit(hosts[:300], paths[:300], [i % 2 == 1 for i in range(300)])
    judged = model.block_probability(hosts[300:], paths[300:]) >= 0.5
    assert np.mean(judged == [i % 2 == 1 for i in range(300, 400)]) > 0.95


def shard(key, weights):
    best = None
    for number, weight in enumerate(weights):
        first = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
        bits = xxhash.xxh64_intdigest(struct.pack("<i", number), first) >> 11
        score = -weight / math.log((bits + 0.5) / (1 << 53))
        if best is None or score > best[0]:
            best = (score, number)
    return best[1]


@pytest.mark.parametrize("weights", [(1.0,) * S.SHARDS, (1.0, 3.0, 0.5, 2.5)])
def test_shards_equal_rendezvous_scores(spark, weights):
    rows = [(i * 7 - 300, "t" * (i % 9) + "é" * (i % 3), "s") for i in range(700)] + [(None, None, "s"), (None, "x", "s"), (5, None, "s"), (5, None, "s"), (5, "", "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, shard string").repartition(4)
    found = S.shard_documents(docs, weights).collect()
    assert len(found) == len(rows)
    slots = {}
    for r in found:
        assert r.shard == shard(r.doc_id, weights) and r.grown_shard == shard(r.doc_id, [*weights, 1.0])
        assert r.grown_shard in (r.shard, len(weights))
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    facts = sorted((str(r.doc_id), r.size, r.text_crc32) for r in found)
    data = [(str(d), (t or "").encode()) for d, t, _ in rows]
    assert facts == sorted((d, len(b) + 16, zlib.crc32(b)) for d, b in data)
    assert S.shard_documents(docs.limit(0), weights).count() == 0


def test_weights_set_the_shares(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    counts = {r.shard: r["count"] for r in S.shard_documents(docs, (1.0, 3.0, 4.0)).groupBy("shard").count().collect()}
    for number, share in enumerate((1 / 8, 3 / 8, 4 / 8)):
        assert abs(counts[number] / 20_000 - share) < 0.02
