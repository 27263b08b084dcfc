"""Conversation structure repair by Hirschberg's divide and conquer.

A repair edits a conversation's rows in order: keep (K, 0), rerole to user or
assistant (R, 2), delete (D, 3; the only edit of blank and repeated rows) and
insert an empty turn (I, 2); a truncated row that stays adds 1.  The initials of
what is left must read ``(s?(ua)+)?``, which an automaton of four states checks.
Of the cheapest audits (strings of edits) the ASCII-least one counts.

Two audits of the same rows that end in different states differ before either
ends, because each ends with the edit of the last row.  So a cost per state and
the order of the four least audits are all that a scan has to carry, and at a
crossing the order of the halves before it decides between equal costs.
Hirschberg's scheme needs no more: forward and backward vectors meet in the
middle, the crossing is chosen, both halves follow in the same way.

Spark sorts short rows (no text) by conversation and turn over all tasks and
packs them in blocks of at most ``BLOCK_ROWS`` rows, one byte a row.  A
conversation of several blocks is crossed between blocks first, from a 4 x 4
summary of each; then all blocks are solved on their own.  Last, edits and texts
of a conversation meet in one sorted stream, whose digest is computed line by
line: a task holds one batch of rows and the audit, however long the texts are.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator, Sequence
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.session import write_once

BLOCK_ROWS = 1 << 16
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
INITIALS = {"s": 1, "u": 2, "a": 3}  # as the states they lead to; others 0
CLEAN, BLANK, DUPLICATE, TRUNCATED = range(4)
#: State after a turn of an inserted or reroled row; which of the two roles it gets follows from the state before.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
TAIL = {START: (0, ""), SYSTEM: (2 * INSERT_COST, "II"), USER: (INSERT_COST, "I"), ASSISTANT: (0, "")}
FAR = 1 << 60
WHITE = " \t\n\x0b\x0c\r"


def keeps(state: int, initial: int) -> bool:
    """Whether a row may stay as it is."""
    return (initial == SYSTEM and state == START) or (initial == USER and state != USER) or (initial == ASSISTANT and state == USER)


@cache
def steps(kind: int) -> tuple[tuple[int, int, int, str], ...]:
    """Best ways over one row of ``kind`` (initial * 4 + fault): state before, state after, cost, edits.

    Edits of a row are insertions before it and then its own; more than two
    insertions lead back to a state that one or none reaches.
    """
    initial, fault = divmod(kind, 4)
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for before in STATES:
        state = before
        for inserted in range(3):
            options = [(state, DELETE_COST, DELETE)]
            if fault not in (BLANK, DUPLICATE):
                extra = TRUNCATED_COST if fault == TRUNCATED else 0
                options.append((NEXT[state], REROLE_COST + extra, REROLE))
                if keeps(state, initial):
                    options.append((initial, extra, KEEP))
            for after, cost, edit in options:
                way = (inserted * INSERT_COST + cost, INSERT * inserted + edit)
                best[before, after] = min(best.get((before, after), way), way)
            state = NEXT[state]
    return tuple((b, a, *best[b, a]) for b, a in sorted(best))


def forward(kinds: Sequence[int], start: int) -> tuple[list[int], list[int]]:
    """Least cost of reaching each state over ``kinds``, and the order of the least audits among the states."""
    costs, order = [FAR] * 4, [0] * 4
    costs[start] = 0
    for kind in kinds:
        best = [(FAR, 0, "")] * 4
        for before, after, cost, edits in steps(kind):
            if costs[before] < FAR:
                way = (costs[before] + cost, order[before], edits)
                if way < best[after]:
                    best[after] = way
        costs = [b[0] for b in best]
        for place, state in enumerate(sorted(STATES, key=lambda s: best[s][1:])):
            order[state] = place
    return costs, order


def backward(kinds: Sequence[int], end: int) -> list[int]:
    """Least cost from each state over ``kinds`` to ``end``."""
    costs = [FAR] * 4
    costs[end] = 0
    for kind in reversed(kinds):
        best = [FAR] * 4
        for before, after, cost, _ in steps(kind):
            if costs[after] + cost < best[before]:
                best[before] = costs[after] + cost
        costs = best
    return costs


def crossed(kinds: bytes, start: int, end: int) -> str:
    """The least audit from ``start`` to ``end``."""
    edits, todo = [], [(0, len(kinds), start, end)]
    while todo:
        low, high, first, last = todo.pop()
        if high - low == 0:
            continue
        if high - low == 1:
            edits.append(next(e for b, a, _, e in steps(kinds[low]) if (b, a) == (first, last)))
            continue
        middle = (low + high) // 2
        costs, order = forward(kinds[low:middle], first)
        rest = backward(kinds[middle:high], last)
        state = min(STATES, key=lambda s: (costs[s] + rest[s], order[s]))
        todo += [(middle, high, state, last), (low, middle, first, state)]  # the left half comes next
    return "".join(edits)


def goal(costs: Sequence[int], order: Sequence[int]) -> int:
    """The state after the last row of a cheapest audit."""
    return min(STATES, key=lambda s: (costs[s] + TAIL[s][0], order[s]))


def cost_of(kinds: bytes, audit: str) -> int:
    """Cost of an audit over its rows."""
    total, at = 0, 0
    for edit in audit:
        if edit == INSERT:
            total += INSERT_COST
            continue
        if edit == DELETE:
            total += DELETE_COST
        else:
            total += (edit == REROLE) * REROLE_COST + (kinds[at] % 4 == TRUNCATED) * TRUNCATED_COST
        at += 1
    return total


def repair(kinds: bytes) -> str:
    """The least audit of a whole conversation."""
    if not kinds:
        return ""
    end = goal(*forward(kinds, START))
    return crossed(kinds, START, end) + TAIL[end][1]


def summary(kinds: bytes) -> list[int]:
    """Costs between all states over a block, and for each first state the order of the last ones: 32 numbers."""
    parts = [forward(kinds, s) for s in STATES]
    return [n for costs, _ in parts for n in costs] + [n for _, order in parts for n in order]


def block_states(summaries: Sequence[Sequence[int]]) -> list[tuple[int, int]]:
    """First and last state of each block on the least audit over all of them."""
    costs, order = [0, FAR, FAR, FAR], [0] * 4
    vectors = [(costs, order)]
    for numbers in summaries:
        best = []
        for after in STATES:
            ways = [(costs[b] + numbers[b * 4 + after], order[b], numbers[16 + b * 4 + after]) for b in STATES]
            best.append(min(ways))
        costs = [min(b[0], FAR) for b in best]
        places = sorted(STATES, key=lambda s: best[s][1:])
        order = [places.index(s) for s in STATES]
        vectors.append((costs, order))
    last = goal(*vectors[-1])
    found = []
    for numbers, (costs, order) in zip(reversed(summaries), reversed(vectors[:-1]), strict=True):
        first = min(STATES, key=lambda s: (costs[s] + numbers[s * 4 + last], order[s]))
        found.append((first, last))
        last = first
    return found[::-1]


# ------------------------------------------------------------------ Spark


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after the damage by crc32(``conv_id:turn``) % 20.

    0 drops the row, 1 empties its text, 2 takes its ``[.!?]`` away, 3 repeats
    it, 4 makes its role user.  Nulls of role and text, and of ids in the key,
    are one space.
    """
    key = F.concat_ws(":", *(F.coalesce(F.col(n).cast("string"), F.lit(" ")) for n in ("conv_id", "turn")))
    code = F.col("_code")
    return (
        conversations.select("conv_id", "turn", "role", "text", (F.crc32(key) % 20).alias("_code"))
        .where(code != 0)
        .select(
            "conv_id",
            "turn",
            F.when(code == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
            F.when(code == 1, "").when(code == 2, F.regexp_replace(F.coalesce("text", F.lit(" ")), "[.!?]", "")).otherwise(F.coalesce("text", F.lit(" "))).alias("text"),
            F.explode(F.when(code == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
        )
        .drop("_copy")
    )


def _digest() -> F.Column:
    """Sixteen bytes of the SHA-256 of role and text."""
    both = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    return F.substring(F.unhex(F.sha2(both, 256)), 1, 16)


def _kinds(rows: DataFrame) -> DataFrame:
    """One short row per row: conversation, order in it, and its kind as a number."""
    body = F.rtrim(F.col("text"), F.lit(WHITE))
    initial = F.coalesce(*[F.when(F.substring("role", 1, 1) == c, n) for c, n in INITIALS.items()], F.lit(0))
    fault = F.when(body == "", BLANK).when(~F.right(body, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(CLEAN)
    short = write_once(
        rows.select(
            "conv_id",
            "turn",
            _digest().alias("digest"),
            (initial * 4 + fault).cast("tinyint").alias("kind"),
            F.monotonically_increasing_id().alias("uid"),
        ),
        "turns",
    )
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"), F.col("uid").alias("uid"))
    repeated = (
        short.groupBy(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest"))
        .agg(F.min(place).alias("_first"), F.count("*").alias("_n"))
        .where("_n > 1")
        .select("_conv", "_digest", F.col("_first.uid").alias("_first"))
    )
    again = F.col("_first").isNotNull() & (F.col("_first") != F.col("uid")) & (F.col("kind") % 4 != BLANK)
    return short.join(repeated, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest")), "left").select(
        "conv_id",
        "turn",
        "digest",
        "uid",
        F.when(again, F.expr(f"kind div 4 * 4 + {DUPLICATE}")).otherwise(F.col("kind")).cast("tinyint").alias("kind"),
    )


def _blocks(short: DataFrame, block_rows: int) -> DataFrame:
    """Rows of one conversation packed in order: first turn and digest, place of the block, kinds."""
    types = dict(short.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId() << 33, 0
        head, kinds, schema = None, bytearray(), None
        ready: list[tuple] = []

        def table() -> pa.RecordBatch:
            names = ["conv_id", "turn", "digest", "place", "kinds"]
            kinds_of = [schema.field("conv_id").type, schema.field("turn").type, pa.binary(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*ready), kinds_of, strict=True)], names)  # noqa: B905

        for batch in batches:
            schema = batch.schema
            for conv_id, turn, digest, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if head is None or head[0] != conv_id or len(kinds) == block_rows:
                    if head is not None:
                        ready.append((*head, part + seq, bytes(kinds)))
                        seq += 1
                    head, kinds = (conv_id, turn, digest), bytearray()
                kinds.append(kind)
            if len(ready) > 1000:
                yield table()
                ready.clear()
        if head is not None:
            ready.append((*head, part + seq, bytes(kinds)))
            yield table()

    order = ["conv_id", "turn", "digest", "uid"]
    ordered = short.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "digest", "kind")
    return ordered.mapInArrow(run, f"conv_id {types['conv_id']}, turn {types['turn']}, digest binary, place bigint, kinds binary")


def _with_states(blocks: DataFrame) -> DataFrame:
    """Blocks with ``first`` and ``last`` state and whether they end the conversation; null for its only block."""
    counted = blocks.groupBy(F.col("conv_id").alias("_conv")).agg(F.count("*").alias("_n")).where("_n > 1")
    same = F.col("conv_id").eqNullSafe(F.col("_conv"))
    many = blocks.join(counted, same).select("conv_id", "place", "kinds")
    kind = dict(blocks.dtypes)["conv_id"]

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = [summary(k) for k in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(numbers, pa.list_(pa.int64()))], ["conv_id", "place", "numbers"])

    def states(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        found = block_states(table.column("numbers").to_pylist())
        first, last = zip(*found, strict=True)
        ends = [False] * (len(found) - 1) + [True]
        columns = [table.column("conv_id"), table.column("place"), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(ends)]
        return pa.table(columns, ["_conv", "_place", "first", "last", "ends"])

    crossings = (
        many.mapInArrow(summaries, f"conv_id {kind}, place bigint, numbers array<bigint>")
        .groupBy("conv_id")
        .applyInArrow(states, f"_conv {kind}, _place bigint, first int, last int, ends boolean")
    )
    return blocks.join(crossings, same & (F.col("place") == F.col("_place")), "left").drop("_conv", "_place")


def _audits(blocks: DataFrame) -> DataFrame:
    """Blocks with their part of the audit, its cost and the faults in it."""
    types = dict(blocks.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            audits, costs, faults = [], [], {BLANK: [], DUPLICATE: [], TRUNCATED: []}
            for kinds, first, last, ends in zip(*(batch.column(n).to_pylist() for n in ("kinds", "first", "last", "ends")), strict=True):
                if first is None:
                    audit = repair(kinds)
                else:
                    audit = crossed(kinds, first, last) + (TAIL[last][1] if ends else "")
                audits.append(audit)
                costs.append(cost_of(kinds, audit))
                for fault, counts in faults.items():
                    counts.append(sum(k % 4 == fault for k in kinds))
            columns = [*(batch.column(n) for n in ("conv_id", "turn", "digest", "place")), pa.array(audits, pa.string())]
            columns += [pa.array(c, pa.int64()) for c in (costs, *faults.values())]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "turn", "digest", "place", "audit", "cost", "blank", "duplicate", "truncated"])

    schema = f"conv_id {types['conv_id']}, turn {types['turn']}, digest binary, place bigint, audit string, cost bigint, blank bigint, duplicate bigint, truncated bigint"
    return blocks.select("conv_id", "turn", "digest", "place", "kinds", "first", "last", "ends").mapInArrow(run, schema)


class _Conversation:
    """Running result of one conversation while its edits and rows pass by."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "cost"), 0)
        self.audit: list[str] = []
        self.edits: deque[Iterator[str]] = deque()
        self.turns = self.gaps_low = self.gaps_high = None
        self.distinct = self.illegal = 0
        self.before: str | None = None
        self.state = START
        self.digest = hashlib.sha256()
        self.lines = 0

    def add_block(self, audit: str, **counts: int) -> None:
        self.audit.append(audit)
        self.edits.append(iter(audit))
        for name, value in counts.items():
            self.counts[name] += value

    def write(self, line: str) -> None:
        if self.lines:
            self.digest.update(b"\n")
        self.digest.update(line.encode())
        self.lines += 1

    def insert(self) -> None:
        self.state = NEXT[self.state]
        self.write(ROLE_OF[self.state] + ":")

    def next_edit(self) -> str | None:
        while self.edits:
            for edit in self.edits[0]:
                return edit
            self.edits.popleft()
        return None

    def add_row(self, turn, role: str, text: str) -> None:
        if turn is not None and turn != self.gaps_high:
            self.gaps_low = turn if self.gaps_low is None else self.gaps_low
            self.gaps_high = turn
            self.distinct += 1
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        while (edit := self.next_edit()) == INSERT:
            self.insert()
        if edit == REROLE:
            self.state = NEXT[self.state]
            self.write(f"{ROLE_OF[self.state]}:{text}")
        elif edit == KEEP:
            self.state = INITIALS[role[:1]]
            self.write(f"{role}:{text}")

    def result(self) -> tuple:
        while self.next_edit() == INSERT:
            self.insert()
        gaps = 0 if self.gaps_low is None else self.gaps_high - self.gaps_low + 1 - self.distinct
        c = self.counts
        return (self.conv_id, gaps, c["blank"], c["duplicate"], c["truncated"], self.illegal, c["cost"], "".join(self.audit), self.digest.hexdigest())


RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def _report(originals: DataFrame, audits: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per conversation from its marker, its blocks and its rows in order."""
    kind = dict(originals.dtypes)["conv_id"]
    marker, block, row = 0, 1, 2
    stream = (
        originals.select("conv_id", F.lit(marker).cast("tinyint").alias("_tag"))
        .unionByName(audits.withColumn("_tag", F.lit(block).cast("tinyint")), allowMissingColumns=True)
        .unionByName(rows.withColumns({"digest": _digest(), "_tag": F.lit(row).cast("tinyint")}), allowMissingColumns=True)
    )
    used = ["_tag", "conv_id", "turn", "role", "text", "audit", "cost", "blank", "duplicate", "truncated"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Conversation | None = None
        ready: list[tuple] = []
        id_type = None

        def table() -> pa.RecordBatch:
            names = ["conv_id", *(f.split()[0] for f in RESULT.split(", "))]
            types = [id_type, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*ready), types, strict=True)], names)  # noqa: B905

        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            for tag, conv_id, turn, role, text, audit, cost, blank, duplicate, truncated in zip(
                *(batch.column(n).to_pylist() for n in used), strict=True
            ):
                if tag == marker:
                    if now is not None:
                        ready.append(now.result())
                    now = _Conversation(conv_id)
                elif tag == block:
                    now.add_block(audit, cost=cost, blank=blank, duplicate=duplicate, truncated=truncated)
                else:
                    now.add_row(turn, role, text)
            if ready:
                yield table()
                ready.clear()
        if now is not None:
            ready.append(now.result())
            yield table()

    ordered = stream.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "digest", "_tag", "place")
    return ordered.select(*used).mapInArrow(run, f"conv_id {kind}, {RESULT}")


def repair_conversations(conversations: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Faults, cheapest repair and digest of the repaired text of every conversation after ``damage``.

    Rows of a conversation are taken by turn, nulls first, and rows of equal
    turn by the digest of role and text, so repeated rows lie side by side.  A
    null conv_id is a conversation of its own.  A conversation without rows
    after the damage has zeros, an empty audit and the digest of nothing; an
    empty table gives no rows.  Other columns are ignored.
    """
    rows = damage(conversations)
    blocks = write_once(_blocks(_kinds(rows), block_rows), "blocks")
    audits = _audits(_with_states(blocks))
    return _report(conversations.select("conv_id").distinct(), audits, rows)


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII expression for DuckDB, which has no such function."""
    step = "xor(x >> 1, 3988292384 * (x & 1))"
    byte = f"list_reduce([xor(h, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: {step})"
    codes = f"list_transform(string_split({text}, ''), lambda c: ord(c)::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {codes}), lambda h, b: {byte}), 4294967295)"


def _way(state: str, cost: int | str, edits: str, line: str) -> str:
    text = f"{state}.o || {line}" if line else f"{state}.o"
    return f"case when {state} is not null then {{'c': {state}.c + {cost}, 'e': {state}.e || '{edits}', 'o': {text}}} end"


def _least(*ways: str) -> str:
    return f"list_min(list_filter([{', '.join(ways)}], lambda w: w is not null))"


def _oracle() -> str:
    """Row by row over four states, each with its cheapest, then ASCII-least edits and the text they give."""
    to_user, to_assistant = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    own = "chr(10) || r.role || ':' || r.text"
    stays = "r.fault not in (1, 2)"

    def when(condition: str, way: str) -> str:
        return f"case when {condition} then {way} end"

    def keep(state: str, initial: str) -> str:
        return when(f"{stays} and r.initial = '{initial}'", _way(state, "(r.fault = 3)::int", "K", own))

    def rerole(state: str, role: str) -> str:
        return when(stays, _way(state, "2 + (r.fault = 3)::int", "R", f"{role} || r.text"))

    both = f"{to_user} || {to_assistant}"
    inserted = {
        "g0": "f0",
        "g1": "f1",
        "g2": _least("f2", _way("f0", 2, "I", to_user), _way("f1", 2, "I", to_user), _way("f3", 2, "I", to_user)),
        "g3": _least("f3", _way("f2", 2, "I", to_assistant), _way("f0", 4, "II", both), _way("f1", 4, "II", both)),
    }
    after = {
        "f0": _way("g0", 3, "D", ""),
        "f1": _least(_way("g1", 3, "D", ""), keep("g0", "s")),
        "f2": _least(_way("g2", 3, "D", ""), *(m(g, x) for g in ("g0", "g1", "g3") for m, x in ((keep, "u"), (rerole, to_user)))),
        "f3": _least(_way("g3", 3, "D", ""), keep("g2", "a"), rerole("g2", to_assistant)),
    }
    nothing = "null::struct(c bigint, e varchar, o varchar)"
    gaps = ", ".join(f"{v} as {k}" for k, v in inserted.items())
    moves = ", ".join(f"{v} as {k}" for k, v in after.items())
    ends = _least("f0", _way("f1", 4, "II", both), _way("f2", 2, "I", to_assistant), "f3")
    key = "coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')"
    return f"""
with recursive coded as materialized (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {crc32_sql(key)} % 20 as code from conversations),
damaged as (select conv_id, turn, case when code = 4 then 'user' else role end as role,
  case when code = 1 then '' when code = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
  unnest(case when code = 3 then [0, 1] else [0] end) as copy from coded where code <> 0),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, sha256(length(role) || ':' || role || text), copy) as n,
  rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as body from damaged),
judged as materialized (select conv_id, turn, n, role, text, left(role, 1) as initial,
  case when body = '' then 1 when row_number() over (partition by conv_id, role, text order by n) > 1 then 2
  when right(body, 1) not in ('.', '!', '?') then 3 else 0 end as fault,
  lag(left(role, 1)) over (partition by conv_id order by n) as before from placed),
walk as (select conv_id, 0::bigint as n, {{'c': 0::bigint, 'e': '', 'o': ''}}::struct(c bigint, e varchar, o varchar) as f0, {nothing} as f1, {nothing} as f2, {nothing} as f3
  from (select distinct conv_id from conversations) c
  union all select conv_id, n, f0, f1, f2, f3 from (select r.conv_id, r.n, {moves} from
    (select conv_id, n, {gaps} from walk) w join judged r on r.conv_id is not distinct from w.conv_id and r.n = w.n + 1) s),
ended as (select conv_id, arg_max({ends}, n) as best from walk group by conv_id),
counted as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 1) as blank,
  count(*) filter (fault = 2) as duplicate, count(*) filter (fault = 3) as truncated,
  count(*) filter (n > 1 and before || initial not in ('su', 'ua', 'au')) as illegal from judged group by conv_id)
select e.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
  coalesce(illegal, 0) as illegal, best.c as cost, best.e as audit, sha256(substring(best.o, 2)) as repaired_sha256
from ended e left join counted c on c.conv_id is not distinct from e.conv_id"""


ORACLE = _oracle()
