"""Near-duplicates by MinHash: universal hash minima, banding, verification, components.

A document's shingle set is hashed by ``BANDS * ROWS`` universal functions; the
minima are its signature, runs of ``ROWS`` minima its bands.  Documents that
share a band are candidates.  With 32 bands of 4 rows two sets of similarity
0.8 share none with a probability of 5e-8.  Candidates are verified by their
signatures, then on the full sets.  No bucket is paired with itself at first:
its members meet three leaders each, one of them the member with the fullest
buckets (the likely original of a group of copies).  Members that are still in
different components afterwards are compared in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import free_name, text_of, words_of
from faultline.llm.components import components
from faultline.session import write_once

BANDS, ROWS = 32, 4
PERCENT = 80
BLOCK_SHINGLES = 1 << 16  # of a block of documents that are compared together
GUEST_BLOCKS = 4
BLOCK_COLUMNS = 1 << 12  # shingles of two blocks that are compared at once
SURE_BELOW = 78  # of 128 equal minima: at similarity 0.8 fewer have a probability of about 2e-7
U = np.uint64
_rng = np.random.default_rng(20260105)
FACTORS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * U(2) + U(1)
OFFSETS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * U(2)
del _rng


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Distinct hashes of runs of ``size`` words, A-Z in lower case; fewer words are one shingle."""
    words = [w.lower() for w in words_of(text)]  # bytes: only A-Z change
    if not words:
        return np.empty(0, U)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], U)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U, len(words))
    runs = np.zeros(len(words) - size + 1, U)
    for i in range(size):
        runs = _mix(runs * U(0x9E3779B97F4A7C15) + hashes[i : len(words) - size + 1 + i])
    return np.unique(runs)


def minima(found: np.ndarray) -> np.ndarray:
    """Smallest value of each universal function ``(factor * x + offset) mod 2**64`` over the set."""
    least = np.full(len(FACTORS), np.iinfo(U).max, U)
    for i in range(0, len(found), 2048):
        values = FACTORS[:, None] * found[None, i : i + 2048]
        values += OFFSETS[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    return least >> U(32)


def band_keys(signature: np.ndarray) -> np.ndarray:
    keys = np.arange(1, BANDS + 1, dtype=U)
    for row in signature.reshape(BANDS, ROWS).T:
        keys = _mix(keys * U(0x9E3779B97F4A7C15) + row)
    return keys.view(np.int64)


def profiles(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, text_hash, n_shingles, digest, signature, bands``; the last three are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, signatures, bands = [], [], [], []
            for text in batch.column(2).to_pylist():
                found = shingles(text, size)
                counts.append(len(found))
                if len(found):
                    signature = minima(found)
                    digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                    signatures.append(signature.astype("<u2").tobytes())
                    bands.append(band_keys(signature))
                else:
                    digests.append(None)
                    signatures.append(None)
                    bands.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "n_shingles", "digest", "signature", "bands"],
            )

    return _texts(docs).mapInArrow(run, "doc_id bigint, text_hash bigint, n_shingles bigint, digest binary, signature binary, bands array<bigint>")


def _texts(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, text``; the hash tells rows apart that share a doc_id."""
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    return plain.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")


def _node_texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, text`` of the documents that stand for ``nodes`` (``node, doc_id, text_hash``)."""
    # the ids grow with the corpus: one plan at every size
    found = _texts(docs).join(nodes.hint("merge"), ["doc_id", "text_hash"])
    return found.select("node", "text").dropDuplicates(["node"])


def _alike(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs ``a, b`` whose set sizes and signatures do not rule out the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (
                np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, BANDS * ROWS) for i in (2, 3)
            )
            near = (left == right).sum(axis=1) >= SURE_BELOW
            yield batch.select([0, 1]).filter(pa.array(near))

    one, two = (known.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("signature").alias(f"s_{x}")) for x in "ab")
    both = pairs.join(one, "a").join(two, "b").where(f"100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)")
    return both.select("a", "b", "s_a", "s_b").mapInArrow(run, "a bigint, b bigint")


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """Pairs whose full sets have ``100 * common >= PERCENT * all``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, np.empty(0, U)
        for batch in batches:
            near = []
            for a, b, text_a, text_b in zip(*(batch.column(i) for i in range(4)), strict=True):
                if a != last:
                    last, left = a, shingles(text_a.as_py(), size)
                right = shingles(text_b.as_py(), size)
                common = len(np.intersect1d(left, right, assume_unique=True))
                near.append(100 * common >= PERCENT * (len(left) + len(right) - common))
            yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))

    one, two = (texts.select(F.col("node").alias(x), F.col("text").alias(f"t_{x}")) for x in "ab")
    return pairs.join(two, "b").join(one, "a").select("a", "b", "t_a", "t_b").mapInArrow(run, "a bigint, b bigint")


def _links(pairs: DataFrame, known: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    near = write_once(_alike(pairs, known), "near-pairs")
    wanted = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    asked = known.select("node", "doc_id", "text_hash").join(wanted.hint("merge"), "node", "left_semi")
    texts = write_once(_node_texts(docs, asked), "pair-texts")
    return write_once(_confirmed(near, texts, size), "links")


def _near_members(left: list[tuple], right: list[tuple]) -> Iterator[tuple[int, int]]:
    """Similar pairs of members ``(node, component, sorted shingles)`` in different components.

    One pair for each member of ``left`` and component of ``right``.
    """
    sets = [[m[2] for m in side] for side in (left, right)]
    shared = np.intersect1d(*(np.unique(np.concatenate(s)) for s in sets), assume_unique=True)
    found = []
    for some in sets:
        values, owners = np.concatenate(some), np.repeat(np.arange(len(some)), [len(x) for x in some])
        places = np.searchsorted(shared, values)
        known = places < len(shared)
        known[known] = shared[places[known]] == values[known]
        found.append((owners[known], places[known]))
    common = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(shared), BLOCK_COLUMNS):
        width = min(BLOCK_COLUMNS, len(shared) - at)
        grids = []
        for some, (owners, places) in zip(sets, found, strict=True):
            here = (places >= at) & (places < at + width)
            grid = np.zeros((len(some), width), np.float32)
            grid[owners[here], places[here] - at] = 1
            grids.append(grid)
        common += grids[0] @ grids[1].T
    sizes = [np.array([len(x) for x in some]) for some in sets]
    parts = [np.array([m[1] for m in side]) for side in (left, right)]
    near = (100 * common >= PERCENT * (sizes[0][:, None] + sizes[1][None, :] - common)) & (parts[0][:, None] != parts[1][None, :])
    seen = set()
    for i, j in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
        if (i, right[j][1]) not in seen:
            seen.add((i, right[j][1]))
            yield left[i][0], right[j][0]


def _links_between_blocks(open_rows: DataFrame, known: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """``a, b``: links between members of one bucket that lie in different components.

    ``open_rows`` are ``key, node, component, fullest``.  Nodes are dealt into
    blocks of about ``BLOCK_SHINGLES`` shingles: nodes with the same fullest
    leader lie together, hashed over as many blocks as their sets need.  A
    component that fills a block has blocks of its own, which are never compared
    with each other.  Two blocks that meet in a bucket are compared as a whole
    on the full sets, so no candidate pair is left out, and rows grow with
    blocks, not with pairs.  Of buckets in which the same blocks meet, one asks.
    The larger block of a pair is the host; its guests come to it in parts of
    about ``GUEST_BLOCKS`` blocks, so a large block is not copied for each small
    one that it meets.
    """
    members = open_rows.groupBy("node").agg(F.min("component").alias("component"), F.max("fullest").alias("fullest"))
    members = members.join(known.select("node", "n_shingles"), "node").select("node", "component", F.col("fullest.node").alias("anchor"), "n_shingles")
    members = write_once(members, "open-members")
    needed = F.sum("n_shingles") / BLOCK_SHINGLES
    large = members.groupBy("anchor", "component").agg(F.ceil(needed).alias("own")).where("own > 1")
    dealt = members.join(large, ["anchor", "component"], "left").withColumn("whole", F.when(F.col("own").isNotNull(), F.col("component")))
    shared = dealt.where("own IS NULL").groupBy("anchor").agg(F.ceil(needed).alias("parts"))
    block = F.struct("anchor", "whole", F.pmod(F.xxhash64("node"), F.coalesce("own", "parts")).alias("part"))
    members = write_once(dealt.join(shared, "anchor", "left").select("node", "component", "n_shingles", block.alias("block")), "members")

    met = write_once(open_rows.select("key", "node").join(members.select("node", "block"), "node").select("key", "block").distinct(), "met")
    sums = [F.sum(F.xxhash64("block", F.lit(i)).cast("decimal(38,0)")).alias(f"_{i}") for i in range(2)]
    alike = met.groupBy("key").agg(F.count("*").alias("_n"), *sums).groupBy("_n", "_0", "_1").agg(F.min("key").alias("key"))
    asking = met.join(alike.select("key").hint("merge"), "key", "left_semi")
    one, two = (asking.select("key", F.col("block").alias(x)) for x in "ab")
    apart = (F.col("one.key") == F.col("two.key")) & (F.col("a") <= F.col("b")) & ~F.coalesce(F.col("a.whole") == F.col("b.whole"), F.lit(False))
    pairs = one.alias("one").join(two.alias("two"), apart).select("a", "b").distinct()
    weights = members.groupBy("block").agg(F.sum("n_shingles").alias("weight"))
    for side in "ab":
        pairs = pairs.join(weights.select(F.col("block").alias(side), F.struct("weight", "block").alias(f"w_{side}")), side)
    pairs = write_once(pairs.select(F.greatest("w_a", "w_b").alias("host"), F.least("w_a", "w_b").alias("guest")), "block-pairs")
    met_others = F.col("host.block") != F.col("guest.block")
    parts = pairs.where(met_others).groupBy("host").agg(F.ceil(F.sum("guest.weight") / (GUEST_BLOCKS * BLOCK_SHINGLES)).alias("parts"))
    part = F.when(met_others, F.pmod(F.xxhash64("guest"), F.col("parts"))).otherwise(-1)
    visits = pairs.join(parts, "host", "left").select(F.struct(F.col("host.block").alias("block"), part.alias("part")).alias("task"), "host", "guest")
    hosts = visits.select("task", F.lit(0).alias("side"), F.col("host.block").alias("block")).distinct()
    guests = visits.where(met_others).select("task", F.lit(1).alias("side"), F.col("guest.block").alias("block"))
    dealt = write_once(hosts.unionByName(guests), "visits")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, size).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "found"])

    texts = _node_texts(docs, known.select("node", "doc_id", "text_hash").join(members.select("node").hint("merge"), "node", "left_semi"))
    sets = write_once(texts.mapInArrow(to_sets, "node bigint, found binary").join(members.hint("merge"), "node"), "member-sets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sides = None, ([], [])

        def links() -> pa.RecordBatch:
            left, right = sides[0], sides[1] or sides[0]
            found = list(_near_members(left, right)) if left else []
            return pa.RecordBatch.from_arrays([pa.array([min(p) for p in found], pa.int64()), pa.array([max(p) for p in found], pa.int64())], ["a", "b"])

        for batch in batches:
            for task, side, node, component, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if task != last:
                    yield links()
                    last, sides = task, ([], [])
                sides[side].append((node, component, np.frombuffer(found, U)))
        yield links()

    rows = dealt.join(sets.drop("n_shingles"), "block").select("task", "side", "node", "component", "found")
    # a task without guests compares its host with itself
    compared = rows.repartition("task").sortWithinPartitions("task").mapInArrow(compare, "a bigint, b bigint")
    return write_once(compared.distinct(), "more-links")


def near_duplicates(docs: DataFrame, size: int = 5) -> DataFrame:
    """Per document: ``doc_id, n_shingles, component_id, kept``; see ``classified``."""
    return classified(docs, size).drop("text_hash")


def classified(docs: DataFrame, size: int = 5) -> DataFrame:
    """Per document: ``doc_id, text_hash, n_shingles, component_id, kept``.

    Words are ``[^\\x20\\x09-\\x0D]+``.  Empty and null texts have no shingles
    and are linked with nothing.  Equal sets are one node, the smallest doc_id
    for it.  A null doc_id is linked with nothing and kept, its component null.
    Rows that repeat a doc_id are documents of their own, linked by their own
    texts.  Other columns are ignored.
    """
    known = write_once(profiles(docs, size), "profiles")
    sets = known.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    # one node per set, numbered; its smallest row stands for it
    least = sets.groupBy("digest").agg(F.min(F.struct("doc_id", "text_hash")).alias("least"))
    nodes = write_once(least.select("digest", "least.*", F.monotonically_increasing_id().alias("node")), "nodes")
    bands = write_once(
        sets.join(nodes.hint("merge"), ["digest", "doc_id", "text_hash"])
        .select("node", "doc_id", "text_hash", "n_shingles", "signature", "bands")
        .dropDuplicates(["node"]),
        "bands",
    )
    rows = bands.select("node", F.explode("bands").alias("key"))

    counts = write_once(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bucket-sizes")
    full = write_once(rows.join(counts, "key"), "bucket-rows")
    # what a group of copies was made from shares the most bands, so it is in the largest buckets
    degrees = write_once(full.groupBy("node").agg(F.sum("n").alias("degree")), "degrees")
    leaders = write_once(
        full.join(degrees, "node")
        .groupBy("key")
        .agg(
            F.min("node").alias("l0"),
            F.max(F.struct("degree", "node")).alias("fullest"),
            F.min_by("node", F.xxhash64("node", F.lit(1))).alias("l2"),
        ),
        "buckets",
    )
    rows = full.select("node", "key")
    stars = (
        rows.join(leaders, "key")
        .select("node", F.explode(F.array_distinct(F.array("l0", "fullest.node", "l2"))).alias("leader"))
        .where("node <> leader")
        .select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"))
        .distinct()
    )
    tried = write_once(stars, "star-pairs")
    links = _links(tried, bands, docs, size)
    joined = write_once(components(links), "components")

    # members of one bucket in different components: only these can still hold a link
    placed = write_once(
        rows.join(joined, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component")),
        "placed",
    )
    mixed = write_once(
        placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key"), "mixed"
    )
    open_rows = write_once(placed.join(mixed, "key", "left_semi").join(leaders.select("key", "fullest"), "key"), "open-rows")
    more = _links_between_blocks(open_rows, bands, docs, size)
    # the late links join whole components, so only these are merged
    ends = joined.select("node", "component")
    late = (
        more.join(ends.toDF("a", "ca"), "a", "left")
        .join(ends.toDF("b", "cb"), "b", "left")
        .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    )
    merged = write_once(components(late).toDF("component", "whole"), "merged")
    final = (
        nodes.join(joined, "node", "left")
        .select("digest", "doc_id", F.coalesce("component", "node").alias("component"))
        .join(merged, "component", "left")
        .select("digest", "doc_id", F.coalesce("whole", "component").alias("class"))
    )
    final = write_once(final, "classes")
    names = final.groupBy("class").agg(F.min("doc_id").alias("component"))
    classes = write_once(final.join(names, "class").select("digest", "component"), "named-classes")
    return (
        known.select("doc_id", "text_hash", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
        .join(classes, "digest", "left")
        .select(
            "doc_id",
            "text_hash",
            "n_shingles",
            F.coalesce("component", "doc_id").alias("component_id"),
            (F.coalesce("component", "doc_id").eqNullSafe(F.col("doc_id"))).alias("kept"),
        )
    )


def drop_near_duplicates(docs: DataFrame, size: int = 5) -> DataFrame:
    """One document of each group stays, the one with the smallest doc_id, with its columns.

    Documents that are linked with nothing stay, those without an id or text too.
    """
    name, text = free_name(docs.columns, "gone"), free_name(docs.columns, "gone_text")
    gone = classified(docs, size).where("NOT kept").select(F.col("doc_id").alias(name), F.col("text_hash").alias(text)).distinct()
    same = (F.col("doc_id").cast("bigint") == F.col(name)) & (F.xxhash64(text_of()) == F.col(text))
    return docs.join(gone.hint("merge"), same, "left_anti").select(*docs.columns)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.t = b.t AND a.doc_id < b.doc_id
      WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id AS a, doc_id AS c FROM s UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.a),
c AS (SELECT a AS doc_id, min(c) AS component_id FROM r GROUP BY a)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
"""
