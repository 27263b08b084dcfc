"""Conversation repair against a search over all edits and against its SQL."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pytest

pytest.importorskip("faultline.llm")

from faultline.llm import conversation_repair as C  # noqa: E402

dice = random.Random(11)


def kinds_of(rows):
    seen, kinds = set(), []
    for _, role, text in rows:
        body = text.strip(C.WHITE)
        fault = C.BLANK if not body else C.DUPLICATE if (role, text) in seen else C.TRUNCATED if body[-1] not in ".!?" else C.CLEAN
        kinds.append(C.INITIALS.get(role[:1], 0) * 4 + fault)
        seen.add((role, text))
    return bytes(kinds)


def cheapest(kinds):
    """Uniform-cost search over (rows done, initials so far legal), audits in ASCII order."""
    heap = [(0, "", 0, "")]
    done = set()
    while heap:
        cost, audit, at, last = heapq.heappop(heap)
        if (at, last) in done:
            continue
        done.add((at, last))
        if at == len(kinds) and last in ("", "a"):
            return cost, audit
        wanted = {"": "u", "s": "u", "u": "a", "a": "u"}[last]
        heapq.heappush(heap, (cost + 2, audit + "I", at, wanted))
        if at < len(kinds):
            initial, fault = divmod(kinds[at], 4)
            initial = "xsua"[initial]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, last))
            if fault not in (C.BLANK, C.DUPLICATE):
                extra = fault == C.TRUNCATED
                heapq.heappush(heap, (cost + 2 + extra, audit + "R", at + 1, wanted))
                if initial == wanted or (initial == "s" and last == ""):
                    heapq.heappush(heap, (cost + extra, audit + "K", at + 1, initial))
    raise AssertionError


def brute_force(rows):
    """Expected result of one conversation's original rows."""
    damaged = []
    for conv_id, turn, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (conv_id, turn))
        code = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        damaged += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    digest = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()[:16]
    damaged.sort(key=lambda r: (r[0] is not None, r[0] or 0, digest(r)))
    kinds = kinds_of(damaged)
    cost, audit = cheapest(kinds)
    turns = {t for t, _, _ in damaged if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    initials = [r[1][:1] for r in damaged]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))  # noqa: B905
    lines, last, rest = [], "", iter(damaged)
    for edit in audit:
        wanted = {"": "u", "s": "u", "u": "a", "a": "u"}[last]
        role = {"u": "user", "a": "assistant"}[wanted]
        if edit == "I":
            lines.append(role + ":")
        else:
            _, own, text = next(rest)
            if edit == "D":
                continue
            role = own if edit == "K" else role
            lines.append(f"{role}:{text}")
        last = role[:1]
    assert re.fullmatch("(s?(ua)+)?", "".join(line[0] for line in lines))
    faults = [sum(k % 4 == f for k in kinds) for f in (C.BLANK, C.DUPLICATE, C.TRUNCATED)]
    return (gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def random_kinds(n):
    return bytes(dice.randrange(16) for _ in range(n))


def test_hirschberg_equals_search():
    for _ in range(1_500):
        kinds = random_kinds(dice.randrange(14))
        cost, audit = cheapest(kinds)
        assert C.repair(kinds) == audit and C.cost_of(kinds, audit) == cost, kinds


def test_blocks_give_the_same_audit():
    for _ in range(800):
        kinds = random_kinds(dice.randrange(1, 30))
        cuts = sorted({0, len(kinds), *dice.choices(range(len(kinds)), k=4)})
        blocks = [kinds[a:b] for a, b in zip(cuts, cuts[1:])]  # noqa: B905
        states = C.block_states([C.summary(b) for b in blocks])
        parts = [C.crossed(b, *s) for b, s in zip(blocks, states, strict=True)]
        assert "".join(parts) + C.TAIL[states[-1][1]][1] == C.repair(kinds)


def test_long_conversation_needs_little_time():
    kinds = random_kinds(20_000)
    assert C.cost_of(kinds, C.repair(kinds)) > 0


TEXTS = [None, "", " \t\n", "Yes.", "No", "What?\n", "a.b!", "x" * 30_000 + ".", "é 東。", "..."]
ROLES = [None, "", "system", "user", "assistant", "tool", "uncle"]


def made_up():
    rows = []
    for conv in [*range(60), None]:
        turns = [None, *range(-2, 9)] if conv == 7 else range(dice.randrange(1, 9))
        rows += [(conv, t, dice.choice(ROLES), dice.choice(TEXTS)) for t in turns]
    rows += [(3, 1, "user", "again."), (3, 1, "user", "again."), (3, None, "user", None), (3, None, "user", None)]
    rows += [(1000, t, "user" if t % 2 else "assistant", dice.choice(["ok.", "ok", f"n{t}!"])) for t in range(700)]
    rows += [(-5, 2**40, "assistant", "far."), (-5, 0, "user", "near.")]
    return rows


@pytest.mark.parametrize("block_rows", [C.BLOCK_ROWS, 3])
def test_repair_equals_brute_force(spark, block_rows):
    rows = made_up()
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, audit string, _tag int")
    found = {r[0]: tuple(r)[1:] for r in C.repair_conversations(table.repartition(5), block_rows).collect()}
    by_conversation = {}
    for row in rows:
        by_conversation.setdefault(row[0], []).append(row)
    assert found.keys() == by_conversation.keys()
    for conv_id, own in by_conversation.items():
        assert found[conv_id] == brute_force(own), conv_id
    assert C.repair_conversations(table.limit(0), block_rows).collect() == []


def test_conversation_that_loses_every_row(spark):
    gone = [(c, t) for c in range(60) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0][0]
    table = spark.createDataFrame([(*gone, "user", "Hi.")], "conv_id bigint, turn bigint, role string, text string")
    (row,) = C.repair_conversations(table).collect()
    assert tuple(row) == (gone[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_query_equals_sql(spark):
    path = "/root/testdata/sf0.01/conversations.parquet"
    found = sorted(map(tuple, C.repair_conversations(spark.read.parquet(path)).collect()))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{path}'")
    assert sorted(con.execute(C.ORACLE).fetchall()) == found
