"""Text that every match of a regular expression must hold.

A line without that text cannot match, so it need not be tested.  The scan is
careful rather than complete: whatever it does not know ends a literal.
"""

from __future__ import annotations

GRAM_CHARS = 3
# From common to rare in English text; everything else is rarer still.
_COMMON_LETTERS = " etaoinsrhldcumfpgwybvkxjqz"


def _branches(pattern: str) -> list[list[str]] | None:
    """Literals of each alternative, split where anything else stands; None if the pattern is beyond the scan."""
    branches: list[list[str]] = [[""]]
    at, depth = 0, 0

    def end_literal() -> None:
        if branches[-1][-1]:
            branches[-1].append("")

    while at < len(pattern):
        char, at = pattern[at], at + 1
        if char == "[":  # a class: skip to its end
            at += pattern.startswith("^", at)
            at += pattern.startswith("]", at)
            while at < len(pattern) and pattern[at] != "]":
                at += 2 if pattern[at] == "\\" else 1
            at += 1
            end_literal()
        elif char == "(":
            if pattern.startswith("?", at) and not pattern.startswith(("?:", "?=", "?!", "?<", "?P<", "?P=", "?>"), at):
                return None  # flags may change what characters mean
            depth += 1
            end_literal()
        elif char == ")":
            depth -= 1
            end_literal()
        elif char == "|":
            if depth == 0:
                branches.append([""])
        elif char in "*?{":
            if depth == 0:  # the character before may be missing
                branches[-1][-1] = branches[-1][-1][:-1]
            if char == "{":
                close = pattern.find("}", at)
                if close < 0 or not pattern[at:close].replace(",", "").isdigit():
                    return None
                at = close + 1
            end_literal()
        elif char in "+.^$":
            end_literal()
        elif char == "\\":
            escaped, at = pattern[at : at + 1], at + 1
            if depth == 0 and escaped and not escaped.isalnum() and escaped.isascii():
                branches[-1][-1] += escaped
            elif escaped.isalnum() and escaped not in "dDwWsSbBAZ":
                return None  # a code or a reference: its digits are no literal
            else:
                end_literal()
        elif depth == 0:
            if char.isascii():
                branches[-1][-1] += char.lower()
            else:
                end_literal()
    return branches


def _rarity(gram: str) -> tuple[int, ...]:
    places = [_COMMON_LETTERS.find(c) for c in gram]
    return tuple(sorted((len(_COMMON_LETTERS) if p < 0 else p for p in places), reverse=True))


def required_grams(pattern: str) -> list[str]:
    """Three-letter texts of which a matching line holds at least one, in any letter case.

    One per alternative, the rarest of its literals; empty if a match needs none.
    """
    found = []
    for literals in _branches(pattern) or [[]]:
        grams = [x[i : i + GRAM_CHARS] for x in literals for i in range(len(x) - GRAM_CHARS + 1)]
        if not grams:
            return []
        found.append(max(grams, key=lambda g: (_rarity(g), g)))
    return list(dict.fromkeys(found))
