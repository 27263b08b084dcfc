"""Prefix trie of conversations by ROLLUP over positional turn columns.

A conversation is one row per block of ``WIDTH`` turns with a column per
position; a turn is the digest of its role and text with the text's length.

    GROUP BY block, prior, ROLLUP (t0, t1, ...)

gives all prefixes of all blocks together, and GROUPING_ID their depth.
``prior`` is the node in which the block before ended, so conversations of any
length go on in further blocks of the same statement.  Spark combines rolled up
rows inside the tasks before it shuffles them: a first turn that a third of all
conversations share is a few rows by then.

Sums over subtrees need no walk.  A node belongs to its smallest member, which
also passes all nodes above it.  So each conversation carries what its nodes are
worth, the same ROLLUP adds that up over the members, and what the smallest
member owns above a node is taken off again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.conversation_repair import crc32_sql
from faultline.session import write_once

WIDTH = 8
GROUP = 100  # conversation c starts like c - c % GROUP
MOST_SHARED = 6  # with crc32(c) % MOST_SHARED turns
DIGEST = 16  # bytes of SHA-256 that stand for a turn or a node
ROOT = hashlib.sha256(b"").digest()[:DIGEST]
NOTHING = hashlib.sha256(b"").hexdigest()
TURN = "struct<digest:binary,length:int>"


def conversation_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, at, turn`` without texts; null role or text is empty, rows without conv_id are left out."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    both = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    digest = F.substring(F.unhex(F.sha2(both, 256)), 1, DIGEST)
    return conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").alias("at"),
        F.struct(digest.alias("digest"), F.length(text).alias("length")).alias("turn"),
    )


def _heads(turns: DataFrame, group: int, most: int) -> DataFrame:
    """Per conversation its number of shared turns and those turns of the first one of its group."""
    order = Window.partitionBy("conv_id").orderBy("at", "turn")
    shared = (
        turns.where(F.col("conv_id") % group == 0)
        .withColumn("_place", F.row_number().over(order))
        .where(F.col("_place") < most)
        .groupBy(F.col("conv_id").alias("_base"))
        .agg(F.array_sort(F.collect_list(F.struct("_place", "turn"))).alias("_head"))
    )
    n = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    head = F.coalesce(F.transform(F.slice("_head", 1, F.col("n")), lambda t: t["turn"]), F.array().cast(f"array<{TURN}>"))
    return (
        turns.select("conv_id").distinct().withColumns({"n": n, "_base": F.col("conv_id") - F.col("conv_id") % group})
        .join(shared, "_base", "left")
        .select("conv_id", "n", head.alias("head"))
    )


def node_key(prior: bytes, digests: Sequence[bytes]) -> bytes:
    """Name of the node that ``digests`` lead to from ``prior``; SQL builds the same in ``_key``."""
    return hashlib.sha256(prior + b"".join(digests)).digest()[:DIGEST] if digests else prior


def rebuilt_blocks(conversations: DataFrame, width: int = WIDTH, group: int = GROUP, most: int = MOST_SHARED) -> DataFrame:
    """``conv_id, block, prior, turns`` (at most ``width``) and ``ends`` of every rebuilt conversation.

    A conversation starts with the first ``n`` turns of the first one of its
    group and goes on with its own after the first ``n``.  Turns are ordered by
    turn, null first, then by digest.  One without turns has one block without
    turns.  The rows of a conversation pass one task in order, which holds no
    more than a block of them.
    """
    turns = write_once(conversation_turns(conversations), "turns")
    stream = _heads(turns, group, most).unionByName(turns, allowMissingColumns=True).withColumn("_own", F.col("turn").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple] = []
        now: tuple = ()

        def blocks() -> pa.RecordBatch:
            ids, places, priors, parts, ends = zip(*ready, strict=True)
            flat = [turn for part in parts for turn in part]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype("int32"))
            fields = [pa.array([d for d, _ in flat], pa.binary()), pa.array([n for _, n in flat], pa.int32())]
            listed = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, ["digest", "length"]))
            columns = [pa.array(ids, pa.int64()), pa.array(places, pa.int32()), pa.array(priors, pa.binary()), listed, pa.array(ends)]
            return pa.RecordBatch.from_arrays(columns, ["conv_id", "block", "prior", "turns", "ends"])

        conv_id = skip = place = prior = None
        part: list[tuple[bytes, int]] = []

        def add(turn: tuple[bytes, int]) -> None:
            nonlocal part, place, prior
            if len(part) == width:  # full, and one more turn follows
                ready.append((conv_id, place, prior, part, False))
                prior = node_key(prior, [d for d, _ in part])
                place, part = place + 1, []
            part.append(turn)

        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            for now, n, head, digest, length in rows:
                if head is not None:
                    if conv_id is not None:
                        ready.append((conv_id, place, prior, part, True))
                    conv_id, skip, place, prior, part = now, n, 0, ROOT, []
                    for turn in head:
                        add((turn["digest"], turn["length"]))
                elif skip:
                    skip -= 1
                else:
                    add((digest, length))
            if len(ready) > 1000:
                yield blocks()
                ready.clear()
        if conv_id is not None:
            ready.append((conv_id, place, prior, part, True))
            yield blocks()

    ordered = stream.repartition("conv_id").sortWithinPartitions("conv_id", "_own", "at", "turn")
    return ordered.select("conv_id", "n", "head", "turn.digest", "turn.length").mapInArrow(
        run, f"conv_id bigint, block int, prior binary, turns array<{TURN}>, ends boolean"
    )


def _columns(width: int) -> list[str]:
    return [f"t{i}" for i in range(width)]


def _key(prior: Column, digests: Sequence[Column]) -> Column:
    nothing = F.lit(b"")
    joined = F.concat(prior, *(F.coalesce(d, nothing) for d in digests))
    return F.when(digests[0].isNull(), prior).otherwise(F.substring(F.unhex(F.sha2(joined, 256)), 1, DIGEST))


def _rolled_up(blocks: DataFrame, width: int, sums: str) -> DataFrame:
    """``sums`` per node with its ``key``, ``parent`` key, ``depth`` and the length of its last text."""
    names = ", ".join(_columns(width))
    rolled = blocks.sparkSession.sql(
        f"SELECT block, prior, {names}, {width} - bit_count(GROUPING_ID()) AS level, {sums} "
        f"FROM {{blocks}} GROUP BY block, prior, ROLLUP ({names})",
        blocks=blocks,
    )
    turns = [F.col(n) for n in _columns(width)]
    last = F.get(F.array(*turns), F.col("level") - 1)
    # a group whose last column is null counts conversations that ended before
    nodes = rolled.where((F.col("level") > 0) | (F.col("block") == 0)).withColumn("_last", last).where("level = 0 OR _last IS NOT NULL")
    digests = [t["digest"] for t in turns]
    above = [F.when(F.col("level") - 1 > i, d) for i, d in enumerate(digests)]
    return nodes.select(
        _key(F.col("prior"), digests).alias("key"),
        F.when(F.col("level") > 0, _key(F.col("prior"), above)).alias("parent"),
        (F.col("block") * width + F.col("level")).cast("bigint").alias("depth"),
        F.coalesce(F.col("_last.length"), F.lit(0)).cast("bigint").alias("length"),
        *[c for c in rolled.columns if c not in {"block", "prior", "level", *_columns(width)}],
    )


def _ends(blocks: DataFrame, width: int) -> DataFrame:
    """``key, ends_sha256`` over the ids of the conversations that end in a node, hashed one by one in order."""
    ended = blocks.where("ends").select(_key(F.col("prior"), [F.col(n)["digest"] for n in _columns(width)]).alias("key"), "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest, ready = None, hashlib.sha256(), []

        def sums() -> pa.RecordBatch:
            keys, found = zip(*ready, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.string())], ["key", "ends_sha256"])

        for batch in batches:
            for key, conv_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key == last:
                    digest.update(f",{conv_id}".encode())
                    continue
                if last is not None:
                    ready.append((last, digest.hexdigest()))
                last, digest = key, hashlib.sha256(str(conv_id).encode())
            if ready:
                yield sums()
                ready.clear()
        if last is not None:
            ready.append((last, digest.hexdigest()))
            yield sums()

    return ended.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(run, "key binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, width: int = WIDTH, group: int = GROUP, most: int = MOST_SHARED) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations.

    ``conv_id`` is the smallest member and, with ``depth``, names the node;
    ``parent_conv_id`` is null for the root.  Null roles and texts are empty,
    rows with a null conv_id are no conversation, repeated rows are turns of
    their own, other columns are ignored.  An empty table has no nodes, not
    even a root.
    """
    stored = write_once(rebuilt_blocks(conversations, width, group, most), "blocks")
    blocks = stored.select("conv_id", "block", "prior", "ends", *(F.get("turns", F.lit(i)).alias(n) for i, n in enumerate(_columns(width))))
    nodes = write_once(_rolled_up(blocks, width, "min(conv_id) AS conv_id, count(*) AS n_convs"), "nodes")

    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    worth = (F.col("n_convs") - 1) * F.col("length")
    whole = nodes.join(children, "key", "left").fillna(0, ["n_children"]).withColumns({"worth": worth, "leaf": (F.col("n_children") == 0).cast("bigint")})
    own = whole.groupBy("conv_id").agg(F.sum("worth").alias("worth"), F.sum("leaf").alias("leaves"))
    weighed = blocks.join(own, "conv_id", "left").fillna(0, ["worth", "leaves"])
    sums = _rolled_up(weighed, width, "sum(worth) AS saved, sum(leaves) AS n_leaves").select("key", "saved", "n_leaves")

    path = Window.partitionBy("conv_id").orderBy("depth")
    above = F.coalesce(F.sum("worth").over(path.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    full = (
        whole.join(sums, "key")
        .join(_ends(blocks, width), "key", "left")
        # below a node of the same smallest member, the parent is that node
        .withColumns({"_above": above, "_parent_owner": F.lag("conv_id").over(path)})
    )
    wanted = F.when(F.col("_parent_owner").isNull(), F.col("parent"))
    parents = nodes.select(F.col("key").alias("_key"), F.col("conv_id").alias("_conv"))
    return full.join(parents, wanted == F.col("_key"), "left").select(
        "conv_id",
        "depth",
        F.coalesce("_parent_owner", "_conv").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        (F.col("saved") - F.col("_above")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
    )


ORACLE = f"""
with named as materialized (select conv_id, turn, dense_rank() over (order by coalesce(role, ''), coalesce(text, '')) as id,
  length(coalesce(text, '')) as size, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as digest
  from conversations where conv_id is not null),
sizes as (select distinct id, size from named),
own as materialized (select conv_id, list(id order by turn nulls first, digest) as turns from named group by conv_id),
headed as (select conv_id, conv_id - conv_id % {GROUP} as base, {crc32_sql("conv_id::varchar")} % {MOST_SHARED} as h, turns from own),
rebuilt as materialized (select a.conv_id, list_concat(list_slice(coalesce(b.turns, []), 1, a.h), list_slice(a.turns, a.h + 1, len(a.turns))) as turns
  from headed a left join own b on b.conv_id = a.base),
prefixes as (select conv_id, len(turns) as n, unnest(range(len(turns) + 1)) as depth, turns from rebuilt),
members as materialized (select conv_id, n = depth as ended, depth, list_slice(turns, 1, depth) as path from prefixes),
nodes as materialized (select path, depth, min(conv_id) as conv_id, count(*) as n_convs,
  coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ended), '') as ends from members group by path, depth),
children as (select list_slice(path, 1, depth - 1) as path, count(*) as n from nodes where depth > 0 group by 1),
valued as materialized (select n.*, coalesce(c.n, 0) as n_children, case when n.depth = 0 then 0 else (n.n_convs - 1) * s.size end as worth
  from nodes n left join children c on c.path = n.path left join sizes s on s.id = n.path[n.depth]),
climbed as (select list_slice(path, 1, up) as path, worth, n_children from (select path, worth, n_children, unnest(range(depth + 1)) as up from valued) u),
subtrees as (select path, sum(worth)::bigint as saved, count(*) filter (n_children = 0) as leaves from climbed group by path)
select v.conv_id, v.depth, p.conv_id as parent_conv_id, v.n_convs, v.n_children, s.leaves as n_leaves, s.saved as saved_tokens, sha256(v.ends) as ends_sha256
from valued v join subtrees s on s.path = v.path left join nodes p on v.depth > 0 and p.path = list_slice(v.path, 1, v.depth - 1)"""
