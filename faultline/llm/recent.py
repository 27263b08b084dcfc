"""A bounded memo for tasks: what was not asked for lately is forgotten first."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Sequence
from typing import Any


class Recent:
    """Keeps answers (true values) in two generations of about ``limit`` entries each.

    An old entry that is asked for becomes young again; when the young ones are
    full they become the old ones and the former old ones are dropped.  Results
    never depend on what is kept.
    """

    def __init__(self, limit: int):
        self.limit = limit
        self.young: dict[Hashable, Any] = {}
        self.old: dict[Hashable, Any] = {}

    def age(self) -> None:
        """Makes the young answers old if they are too many; asking does so by itself, first thing."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}

    def each(self, keys: Sequence[Hashable], ask: Callable[[Any], Any]) -> list:
        """Answer of every key; ``ask`` gives an unknown one."""
        self.age()
        young, old = self.young, self.old
        found = list(map(young.get, keys))
        if not all(found):
            for i, answer in enumerate(found):
                if answer is None:
                    key = keys[i]
                    answer = young.get(key) or old.get(key) or ask(key)
                    found[i] = young[key] = answer
        return found

    def learn(self, keys: Sequence[Hashable], ask: Callable[[list], Sequence]) -> None:
        """Makes the answers of distinct ``keys`` young; ``ask`` gives all unknown ones at once."""
        self.age()
        young, old = self.young, self.old
        missing = []
        for key in keys:
            if key not in young:
                answer = old.get(key)
                if answer is None:
                    missing.append(key)
                else:
                    young[key] = answer
        if missing:
            young.update(zip(missing, ask(missing), strict=True))
