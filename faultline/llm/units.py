"""Ids of texts that are cut where a pre-token always ends.

A single space before a character that is no white space always starts a new
pre-token of the byte-level pattern, so a text can be cut there and each
distinct word encoded once.  Texts with other runs of white space at a space,
with very long words or with added tokens are encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Collection, Sequence
from string import ascii_letters

from faultline.llm.recent import Recent

LIMIT = 200_000
BATCH_CHARS = 250_000  # texts encoded together, so that a batch's words stay few
WORD_CHARS = 64
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
_ODD = re.compile(r" (?:\s|$)")
_MARKS, _LETTERS = frozenset(MARKS), frozenset(ascii_letters)


class Units:
    """``whole`` gives the ids of texts, ``words`` those of distinct words that each follow a space.

    ``added`` are tokens that the library takes out of a text before the pattern.
    """

    def __init__(
        self,
        whole: Callable[[Sequence[str]], list[bytes]],
        words: Callable[[Sequence[str]], list[bytes]],
        added: Sequence[str] = (),
        limit: int = LIMIT,
    ):
        self.whole, self.words, self.added, self.memo = whole, words, added, Recent(limit)
        self.marks = dict(zip(MARKS, whole(list(MARKS)), strict=True))

    def encode_texts(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of each text."""
        out: list[bytes] = []
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size > BATCH_CHARS:
                out += self._some(group)
                group, size = [], 0
        return out + self._some(group)

    def _odd(self, words: Collection[str]) -> set[str]:
        """Those of ``words`` that cannot be encoded by themselves."""
        together = " " + " ".join(words)
        if max(map(len, words), default=0) <= WORD_CHARS and not _ODD.search(together) and not any(map(together.__contains__, self.added)):
            return set()
        return {w for w in words if len(w) > WORD_CHARS or _ODD.match(" " + w) or any(map(w.__contains__, self.added))}

    def _learn(self, words: set[str]) -> None:
        """Keeps ids of ``words``.  A mark between a letter and a space is a pre-token of its own, so only the stem is encoded."""
        young, marks, letters = self.memo.young, _MARKS, _LETTERS
        marked = [w for w in words if w[-1] in marks and w[-2:-1] in letters]
        self.memo.learn(list(words.difference(marked).union([w[:-1] for w in marked])), self.words)
        young.update([(w, young[w[:-1]] + self.marks[w[-1]]) for w in marked])

    def _some(self, texts: Sequence[str]) -> list[bytes]:
        self.memo.age()
        known = self.memo.young.get
        firsts, split, founds = [], [], []
        missing: set[str] = set()
        for text in texts:
            first, *words = text.split(" ")
            found = list(map(known, words))
            if None in found:
                missing.update([w for w, ids in zip(words, found, strict=True) if ids is None])
            firsts.append(first)
            split.append(words)
            founds.append(found)
        odd = self._odd(missing)
        if odd:
            for i, words in enumerate(split):
                if not odd.isdisjoint(words):
                    firsts[i], split[i], founds[i] = texts[i], [], []
        self._learn(missing - odd)
        new = self.memo.young
        return [
            first + b"".join([ids or new[w] for w, ids in zip(words, found, strict=True)])
            for first, words, found in zip(self.whole(firsts), split, founds, strict=True)
        ]
