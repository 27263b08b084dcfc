"""The prefix trie against dictionaries of prefixes and against its SQL."""

import hashlib
import random
import zlib

import duckdb
import pytest

pytest.importorskip("faultline.llm")

from faultline.llm import prefix_trie as T  # noqa: E402

dice = random.Random(23)
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute_force(rows):
    digest = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
    own = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own.setdefault(conv_id, []).append((turn, role or "", text or ""))
    for turns in own.values():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, digest(r)))
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = own.get(c - c % 100, []) if c >= 0 else own.get(c + -c % 100, [])
        rebuilt[c] = tuple(t[1:] for t in [*base[:h], *turns[h:]])
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    found = set()
    for path, own_members in members.items():
        below = [p for p in members if p[: len(path)] == path]
        ends = ",".join(map(str, sorted(c for c in own_members if len(rebuilt[c]) == len(path))))
        found.add(
            (
                min(own_members),
                len(path),
                min(members[path[:-1]]) if path else None,
                len(own_members),
                len(children.get(path, [])),
                sum(p not in children for p in below),
                sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p),
                hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return found


def made_up():
    texts = [None, "", "Hi.", "Hi.", "yes é東", "no", "x" * 20_000]
    rows = []
    for c in [*range(0, 140), 250, 300, 301, 355, -7, -100, -142, 2**40]:
        turns = [None, *range(3)] if c == 100 else range(dice.randrange(1, 9))
        rows += [(c, t, dice.choice([None, "user", "assistant"]), dice.choice(texts)) for t in turns]
    rows += [(c, t, "user", f"t{t}") for c in (500, 501, 502) for t in range(60)] + [(502, 60, "user", "end")]
    rows += [(600, 0, "user", "a"), (600, 0, "user", "a"), (600, 0, "user", "b"), (600, None, "x", "n"), (600, None, "x", "n")]
    rows += [(c, 0, "user", "lone") for c in range(700, 720)] + [(None, 0, "user", "nobody"), (None, None, None, None)]
    return rows


@pytest.mark.parametrize("width", [T.WIDTH, 3])
def test_trie_equals_brute_force(spark, width):
    rows = made_up()
    table = spark.createDataFrame([(*r, "x", 1, b"k") for r in rows], SCHEMA + ", depth string, block int, key binary")
    found = [tuple(r) for r in T.prefix_trie(table.repartition(5), width).collect()]
    expected = brute_force(rows)
    assert len(found) == len(expected)
    assert set(found) == expected
    assert T.prefix_trie(table.limit(0), width).collect() == []


def test_conversation_without_turns_belongs_to_the_root(spark):
    c = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 0)
    rows = [(c, 0, "user", "skipped")]
    found = [tuple(r) for r in T.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert found == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    assert set(found) == brute_force(rows)


def test_query_equals_sql(spark):
    path = "/root/testdata/sf0.01/conversations.parquet"
    found = sorted(map(str, map(tuple, T.prefix_trie(spark.read.parquet(path)).collect())))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{path}'")
    assert sorted(map(str, con.execute(T.ORACLE).fetchall())) == found
