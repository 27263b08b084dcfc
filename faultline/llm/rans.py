"""Static range asymmetric numeral coding of ids: interleaved lanes, checkpoints, checksums.

One frequency table, scaled to ``1 << BITS``, is shared by all blocks.  A block
deals its ids to lanes; each step codes one id per lane with numpy.  The state
of every lane and the place in the words are kept at checkpoints, so segments
between checkpoints decode independently; each has a checksum of its ids.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Mapping

import numpy as np

BITS = 20
LANES = 2048  # a numpy call costs as much as a thousand lanes
STEPS = 72  # between checkpoints; states of all lanes are kept there
LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<4sIIIII")  # magic, table's checksum, ids, lanes, steps, segments
_MAGIC = b"RAN1"
U = np.uint64


class Table:
    """Frequencies of at most ``1 << BITS`` ids, each at least 1, that sum to ``1 << BITS``."""

    def __init__(self, counts: Mapping[int, int]):
        ids = np.array(sorted(i for i, n in counts.items() if n > 0), np.int64)
        n = np.array([counts[i] for i in ids.tolist()], np.float64)
        if len(ids) > 1 << BITS:
            raise ValueError("more ids than the table has places")
        share = np.maximum(1, np.floor(n / n.sum() * (1 << BITS))).astype(np.int64) if len(ids) else n.astype(np.int64)
        left = (1 << BITS) - int(share.sum())
        order = np.argsort(-share, kind="stable")
        for i in order:  # too many places go to the most frequent id, too few are taken from the largest
            if not left:
                break
            step = left if left > 0 else -min(-left, int(share[i]) - 1)
            share[i] += step
            left -= step
        self.ids, self.share = ids, share
        self.first = np.concatenate([[0], np.cumsum(share)[:-1]]).astype(np.int64) if len(ids) else share
        self.place = np.repeat(np.arange(len(ids), dtype=np.int32), share)
        self.index = np.full(int(ids.max()) + 1 if len(ids) else 0, -1, np.int32)
        self.index[ids] = np.arange(len(ids), dtype=np.int32)
        self.check = zlib.crc32(ids.astype("<u4").tobytes() + share.astype("<u4").tobytes())
        self.f, self.c = share.astype(U), self.first.astype(U)

    @classmethod
    def of_shares(cls, shares: Mapping[int, int]) -> Table:
        """The table whose stored shares are given."""
        return cls(shares)


def encode_block(ids: np.ndarray, table: Table) -> bytes:
    n = len(ids)
    lanes = max(1, min(LANES, n // 64))
    symbols = table.index[ids]
    if n and int(symbols.min()) < 0:
        raise ValueError("an id is not in the table")
    steps = -(-n // lanes)
    state = np.full(lanes, LOW, U)
    words: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []  # words so far, states; from the last segment to the first
    written = 0
    shift, bits, half = U(63 - BITS), U(BITS), U(32)
    for step in range(steps - 1, -1, -1):
        s = symbols[step * lanes : (step + 1) * lanes]
        x, f = state[: len(s)], table.f[s]
        full = x >= (f << shift)
        if full.any():
            out = x[full]
            words.append(out.astype(np.uint32))
            written += len(out)
            x[full] = out >> half
        q = x // f
        x[:] = (q << bits) + (x - q * f) + table.c[s]
        if step % STEPS == 0:
            marks.append((written, state.copy()))
    parts = [_HEAD.pack(_MAGIC, table.check, n, lanes, STEPS, len(marks))]
    for k, (at, states) in enumerate(reversed(marks)):
        segment = ids[k * STEPS * lanes : (k + 1) * STEPS * lanes]
        parts += [struct.pack("<II", written - at, zlib.crc32(segment.astype("<u4").tobytes())), states.astype("<u8").tobytes()]
    return b"".join(parts + [np.concatenate(words[::-1]).astype("<u4").tobytes() if words else b""])


def segments(block: bytes) -> int:
    return _HEAD.unpack_from(block)[5]


def decode_segment(block: bytes, table: Table, segment: int) -> np.ndarray:
    """Ids between two checkpoints; raises ValueError where the checksum differs."""
    magic, check, n, lanes, steps, count = _HEAD.unpack_from(block)
    if magic != _MAGIC or check != table.check:
        raise ValueError("not a block of this table")
    at = _HEAD.size + segment * (8 + 8 * lanes)
    place, crc = struct.unpack_from("<II", block, at)
    x = np.frombuffer(block, "<u8", lanes, at + 8).astype(U)
    words = np.frombuffer(block, "<u4", offset=_HEAD.size + count * (8 + 8 * lanes)).astype(U)
    start, end = segment * steps * lanes, min(n, (segment + 1) * steps * lanes)
    out = np.empty(end - start, np.int32)
    mask, bits, half = U((1 << BITS) - 1), U(BITS), U(32)
    for i in range(0, end - start, lanes):
        y = x[: min(lanes, end - start - i)]
        slot = y & mask
        s = table.place[slot.astype(np.int64)]
        out[i : i + len(y)] = s
        y[:] = table.f[s] * (y >> bits) + slot - table.c[s]
        short = y < LOW
        need = int(np.count_nonzero(short))
        if need:
            y[short] = (y[short] << half) | words[place : place + need]
            place += need
    ids = table.ids[out].astype("<u4")
    if zlib.crc32(ids.tobytes()) != crc:
        raise ValueError("checksum of a segment differs")
    return ids


def decode_block(block: bytes, table: Table) -> np.ndarray:
    parts = [decode_segment(block, table, k) for k in range(segments(block))]
    return np.concatenate(parts) if parts else np.empty(0, "<u4")
