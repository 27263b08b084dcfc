"""The sequence of tokens that merging gives, from longest matches.

A sequence is what the merges of a text give exactly if merging the joined
characters of every two neighbours alone gives these two again.  So the longest
token at each place is taken (Aho-Corasick) while neighbours are compatible,
else the next shorter one, else a step back.  A bitfield marks places from
which no way led on; none is entered twice, which makes it linear.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import pairwise

import ahocorasick

MEMO_PAIRS = 200_000


class LongestMatches:
    """``merged`` merges a short text plainly; ``tokens`` are all texts it can end in, single characters included."""

    def __init__(self, tokens: Iterable[str], merged: Callable[[str], list[str]]):
        self.merged = merged
        self.automaton = ahocorasick.Automaton()
        known = set(tokens)
        for token in known:
            self.automaton.add_word(token, token)
        self.automaton.make_automaton()
        self.shorter = {t: next((t[:n] for n in range(len(t) - 1, 0, -1) if t[:n] in known), None) for t in known}
        self.fits: set[tuple[str, str]] = set()
        self.clash: set[tuple[str, str]] = set()

    def compatible(self, pair: tuple[str, str]) -> bool:
        if pair in self.fits:
            return True
        if pair in self.clash:
            return False
        good = self.merged(pair[0] + pair[1]) == [*pair]
        known = self.fits if good else self.clash
        if len(known) >= MEMO_PAIRS:
            known.clear()
        known.add(pair)
        return good

    def split(self, text: str) -> list[str]:
        """Tokens of a text whose characters are all tokens."""
        path = [token for _, token in self.automaton.iter_long(text)]
        pairs = list(pairwise(path))
        if self.fits.issuperset(pairs):
            return path
        for place, pair in enumerate(pairs, 1):
            if not self.compatible(pair):
                return self._backtrack(text, path[:place], path[place])
        return path

    def _backtrack(self, text: str, path: list[str], token: str) -> list[str]:
        """Goes on behind ``path`` where ``token`` does not fit."""
        fits, shorter, longest = self.fits, self.shorter, self.automaton.iter_long
        size = len(text)
        open_at = bytearray(b"\xff" * (size // 8 + 1))
        at = sum(map(len, path))
        while True:
            token = shorter[token]
            while token is None:  # no token leads on from here
                open_at[at >> 3] &= ~(1 << (at & 7))
                token = path.pop()  # the plain merges are a way, so there is one
                at -= len(token)
                token = shorter[token]
            end = at + len(token)
            while open_at[end >> 3] >> (end & 7) & 1 and (not path or (path[-1], token) in fits or self.compatible((path[-1], token))):
                path.append(token)
                at = end
                if at == size:
                    return path
                token = next(longest(text, at))[1]
                end = at + len(token)
