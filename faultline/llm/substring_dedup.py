"""Substring dedup by relative Lempel-Ziv parsing over runs of words.

The corpus is cut into reference blocks of documents with neighbouring ids.
Every window of ``LENGTH`` words of a document is looked up in the indexes of
all blocks; the parse then greedily extends a factor as long as the next window
has an earlier reference too, and a word without one is a literal.  A factor is
sufficiently long by construction, ends are exact to the word, and its words
are the duplicate span.

Not every window travels.  A window's anchor is its smallest hashed run of
``ANCHOR`` words, so equal windows have equal anchors.  First the anchors of each block
go to buckets by hash, which answer with those that other blocks have too;
only windows with such an anchor go on, again once per block and window.  A
passage in a third of all documents is thus one entry per block, never a group
of all its places.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import text_of, words_of
from faultline.session import write_once

LENGTH, ANCHOR = 13, 7
BLOCK_BITS = 8  # 256 neighbouring ids are a block
BUCKET_BYTES = 2 << 20  # of text for each bucket
MIN_BUCKETS = 256
U = np.uint64


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * U(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(29))


def run_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words, from runs of 1, 2, 4 ... words."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, U)
    done, at, part, width = None, 0, hashes, 1
    while True:
        if n & width:
            piece = part[at : at + m]
            done = piece.copy() if done is None else _join(done, piece)
            at += width
        if width * 2 > n:
            return done
        part = _join(part[:-width], part[width:])
        width *= 2


def windows(words: list[bytes], length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window, and of its anchor."""
    if len(words) < length:
        return np.empty(0, U), np.empty(0, U)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U, len(words))
    own = run_hashes(hashes, length)
    runs = run_hashes(hashes, anchor)
    least = runs[: len(own)].copy()
    for i in range(1, length - anchor + 1):
        np.minimum(least, runs[i : i + len(own)], out=least)
    return own, least


def factors(has_reference: np.ndarray, length: int = LENGTH) -> list[tuple[int, int]]:
    """Greedy parse: (first word, words) of each factor; words in between are literals."""
    starts = np.flatnonzero(np.diff(np.concatenate([[False], has_reference])) & has_reference)
    ends = np.flatnonzero(has_reference & ~np.concatenate([has_reference[1:], [False]]))
    return [(int(s), int(e - s + length)) for s, e in zip(starts, ends, strict=True)]


def _by_bucket(found: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    place = found & U(buckets - 1)
    order = np.argsort(place, kind="stable")
    found, place = found[order], place[order]
    cuts = np.flatnonzero(np.diff(place)) + 1
    for part, start in zip(np.split(found, cuts), np.concatenate([[0], cuts]).astype(int), strict=True):
        if len(part):
            yield int(place[start]), part.astype("<u8").tobytes()


def _messages(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    bucket, block, data = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket, pa.int32()), pa.array(block, pa.int64()), pa.array(data, pa.binary())], ["bucket", "block", "hashes"]
    )


def _entries(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(hash, block) of a bucket's messages, each once, in order."""
    data = table["hashes"].to_pylist()
    hashes = np.frombuffer(b"".join(data), "<u8")
    blocks = np.repeat(table["block"].to_numpy(), [len(d) // 8 for d in data])
    order = np.lexsort((blocks, hashes))
    hashes, blocks = hashes[order], blocks[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (blocks[1:] != blocks[:-1])
    return hashes[new], blocks[new]


def _answer(hashes: np.ndarray, blocks: np.ndarray) -> pa.Table:
    order = np.argsort(blocks, kind="stable")
    hashes, blocks = hashes[order], blocks[order]
    cuts = np.flatnonzero(np.diff(blocks)) + 1
    parts = np.split(hashes, cuts) if len(hashes) else []
    firsts = blocks[np.concatenate([[0], cuts]).astype(int)] if len(hashes) else []
    return pa.table(
        {"block": pa.array(firsts, pa.int64()), "hashes": pa.array([p.astype("<u8").tobytes() for p in parts], pa.binary())}
    )


def _in_other_blocks(table: pa.Table) -> pa.Table:
    """Each block's hashes that another block has too."""
    hashes, blocks = _entries(table)
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    same[:-1] |= same[1:]
    return _answer(hashes[same], blocks[same])


def _in_earlier_blocks(table: pa.Table) -> pa.Table:
    """Each block's hashes that an earlier block has too."""
    hashes, blocks = _entries(table)
    later = np.zeros(len(hashes), bool)
    later[1:] = hashes[1:] == hashes[:-1]
    return _answer(hashes[later], blocks[later])


def _member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in ``known``, which is sorted."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _received(table: pa.Table) -> np.ndarray:
    return np.unique(np.frombuffer(b"".join(table["hashes"].to_pylist()), "<u8"))


_STEP = "bucket int, block bigint, hashes binary, doc_id bigint, text string, n_words bigint, n_removed bigint, kept_text string, kept_sha256 string"


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Per document: ``doc_id, n_words, n_removed, kept_text, kept_sha256``.

    ``kept_text`` (the words left, joined by a space) is null unless
    ``with_text``.  A word goes if it lies in a window whose words also start
    in a document with a smaller doc_id; windows are judged on the input.  Null
    and empty texts have no words.  Documents without an id neither lose words
    nor count as a reference.  doc_ids are expected to be a key: rows that
    repeat one are judged alike, never against each other, and lie in one
    block.  Other columns are ignored; no rows give no rows.
    """
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 << max(MIN_BUCKETS - 1, size // BUCKET_BYTES).bit_length()
    block = F.when(F.col("doc_id").isNotNull(), F.shiftright("doc_id", BLOCK_BITS))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[int, list[np.ndarray]] = {}
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                _, anchors = windows(words_of(text.as_py()))
                if len(anchors):
                    held.setdefault(doc_id.as_py() >> BLOCK_BITS, []).append(np.unique(anchors))
            rows = []
            for key, parts in held.items():
                rows += [(b, key, data) for b, data in _by_bucket(np.unique(np.concatenate(parts)), buckets)]
                if len(rows) > 20_000:
                    yield _messages(rows)
                    rows = []
            yield _messages(rows)

    sent = own.where("doc_id IS NOT NULL").mapInArrow(send, "bucket int, block bigint, hashes binary")
    shared = sent.groupBy("bucket").applyInArrow(_in_other_blocks, "block bigint, hashes binary")

    def result_columns(n: int, **given: list) -> dict:
        kinds = {
            "bucket": pa.int32(), "block": pa.int64(), "hashes": pa.binary(), "doc_id": pa.int64(), "text": pa.string(),
            "n_words": pa.int64(), "n_removed": pa.int64(), "kept_text": pa.string(), "kept_sha256": pa.string(),
        }
        return {k: pa.array(given.get(k, [None] * n), kind) for k, kind in kinds.items()}

    def whole(words: list[bytes]) -> str | None:
        return b" ".join(words).decode("utf-8", "replace") if with_text else None

    def select(left: pa.Table, right: pa.Table) -> pa.Table:
        """Of a block: finished documents, open ones, and messages with the open windows."""
        others = _received(right)
        split = [words_of(t) for t in left["text"].to_pylist()]
        found = [windows(w) for w in split]
        every = np.concatenate([np.unique(a) for _, a in found]) if found else np.empty(0, U)
        values, times = np.unique(every, return_counts=True)
        live = np.union1d(others, values[times > 1])
        done: dict[str, list] = {k: [] for k in ("doc_id", "n_words", "n_removed", "kept_text", "kept_sha256")}
        going: dict[str, list] = {k: [] for k in ("block", "doc_id", "text")}
        wanted = []
        for doc_id, text, key, words, (own_hashes, anchors) in zip(left["doc_id"].to_pylist(), left["text"], left["block"].to_pylist(), split, found, strict=True):
            hit = _member(anchors, live) if key is not None else np.zeros(len(anchors), bool)
            if hit.any():
                wanted.append(np.unique(own_hashes[hit]))
                for k, v in (("block", key), ("doc_id", doc_id), ("text", text.as_py())):
                    going[k].append(v)
            else:
                for k, v in (("doc_id", doc_id), ("n_words", len(words)), ("n_removed", 0), ("kept_text", whole(words)), ("kept_sha256", _sha(words))):
                    done[k].append(v)
        message = list(_by_bucket(np.unique(np.concatenate(wanted)), buckets)) if wanted else []
        parts = [
            result_columns(len(done["doc_id"]), **done),
            result_columns(len(going["doc_id"]), **going),
            result_columns(
                len(message), bucket=[b for b, _ in message], block=[going["block"][0]] * len(message) if message else [], hashes=[d for _, d in message]
            ),
        ]
        return pa.concat_tables([pa.table(p) for p in parts])

    # documents without an id go by a hash of the text: they only need their words counted
    keyed = own.where("doc_id IS NOT NULL").withColumn("block", block)
    step = write_once(
        keyed.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(select, _STEP), "parse"
    )
    earlier = (
        step.where("bucket IS NOT NULL").select("bucket", "block", "hashes").groupBy("bucket").applyInArrow(_in_earlier_blocks, "block bigint, hashes binary")
    )

    def parse(left: pa.Table, right: pa.Table) -> pa.Table:
        references = _received(right)
        ids = left["doc_id"].to_pylist()
        split = [words_of(t) for t in left["text"].to_pylist()]
        found = [windows(w)[0] for w in split]
        every = np.concatenate(found) if found else np.empty(0, U)
        owner = np.repeat(np.array(ids, np.int64), [len(f) for f in found])
        order = np.lexsort((owner, every))
        values, first = np.unique(every[order], return_index=True)
        first_id = owner[order][first]
        rows: dict[str, list] = {k: [] for k in ("doc_id", "n_words", "n_removed", "kept_text", "kept_sha256")}
        for doc_id, words, own_hashes in zip(ids, split, found, strict=True):
            has = _member(own_hashes, references)
            if len(own_hashes):
                has |= first_id[np.searchsorted(values, own_hashes)] < doc_id
            gone = np.zeros(len(words), bool)
            for start, length in factors(has):
                gone[start : start + length] = True
            kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            for k, v in (("doc_id", doc_id), ("n_words", len(words)), ("n_removed", int(gone.sum())), ("kept_text", whole(kept)), ("kept_sha256", _sha(kept))):
                rows[k].append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(rows.items(), kinds, strict=True)})

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [words_of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(w) for w in split], pa.int64()), pa.array([0] * len(split), pa.int64()),
                 pa.array([whole(w) for w in split], pa.string()), pa.array([_sha(w) for w in split], pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"],
            )

    result = "doc_id bigint, n_words bigint, n_removed bigint, kept_text string, kept_sha256 string"
    open_docs = step.where("bucket IS NULL AND text IS NOT NULL").select("block", "doc_id", "text")
    return (
        step.where("bucket IS NULL AND text IS NULL")
        .select("doc_id", "n_words", "n_removed", "kept_text", "kept_sha256")
        .unionByName(open_docs.groupBy("block").cogroup(earlier.groupBy("block")).applyInArrow(parse, result))
        .unionByName(own.where("doc_id IS NULL").mapInArrow(plain, result))
    )


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w)),
f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g),
d AS (SELECT g.doc_id, i FROM g JOIN f USING (g) WHERE f.first < g.doc_id),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM d),
c AS (SELECT doc_id, list(p) AS gone FROM r GROUP BY doc_id),
k AS (SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
      list_filter(w, lambda x, i: NOT list_contains(coalesce(gone, []), i)) AS kept FROM w LEFT JOIN c USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
"""
