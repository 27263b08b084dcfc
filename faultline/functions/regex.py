"""Regular expressions that mean the same on ASCII and on other text.

Patterns are written in plain notation.  In Java, ``\\w``, ``\\s``, ``\\d`` and
``\\b`` are ASCII or depend on the JDK version, and their Unicode forms are
slow.  So every pattern is used in two spellings: the plain one on lines that
are pure ASCII, and one with explicit Unicode classes on all others.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space of Unicode text.
SPACE_CHARS = "".join(
    chr(c)
    for c in (
        *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
        *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    )
)

# Every line boundary of Unicode text, two-character form first.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

_ASCII = {"s": r"\s\x1c-\x1f"}
_UNICODE = {
    "d": r"\p{Nd}",
    "w": r"\p{L}\p{N}_",
    "s": r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000",
}
_WORD = f"[{_UNICODE['w']}]"


def _spell(pattern: str, classes: dict[str, str], start: str, end: str) -> str:
    # A leading \b stands before a word character, any other one behind one.
    out, in_class, chars = [], False, iter(pattern)
    for char in chars:
        if char == "\\":
            name = next(chars)
            if name == "b" and not in_class:
                out.append(start if "".join(out) in ("", "(?i)") else end)
            elif name == "S":
                out.append(f"[^{classes['s']}]")
            elif name in classes:
                out.append(classes[name] if in_class else f"[{classes[name]}]")
            else:
                out.append(char + name)
            continue
        in_class = (in_class or char == "[") and char != "]"
        out.append(char)
    return "".join(out)


def ascii_regex(pattern: str) -> str:
    return _spell(pattern, _ASCII, r"\b", r"\b")


def unicode_regex(pattern: str) -> str:
    return _spell(pattern, _UNICODE, f"(?<!{_WORD})", f"(?!{_WORD})").replace("(?i", "(?iu", 1)


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def extract(text: Column, pattern: str, group: int = 0) -> Column:
    """A group of the leftmost match; empty without a match."""
    return F.when(
        is_ascii(text), F.regexp_extract(text, ascii_regex(pattern), group)
    ).otherwise(F.regexp_extract(text, unicode_regex(pattern), group))


def matches(text: Column, pattern: str) -> Column:
    return F.when(is_ascii(text), text.rlike(ascii_regex(pattern))).otherwise(
        text.rlike(unicode_regex(pattern))
    )


def replace(text: Column, pattern: str, value: str) -> Column:
    return F.when(
        is_ascii(text), F.regexp_replace(text, ascii_regex(pattern), value)
    ).otherwise(F.regexp_replace(text, unicode_regex(pattern), value))


def folded(text: Column) -> Column:
    """Lower case; the four other letters that match ASCII ones in any case are spelled as those."""
    return F.lower(F.translate(text, "ſıİK", "siik"))


def contains_any(text: Column, phrases: tuple[str, ...]) -> Column:
    """Whether a phrase occurs in any letter case."""
    low = F.lower(text)
    plain = F.lit(False)
    for phrase in phrases:
        plain = plain | low.contains(phrase)
    return F.when(is_ascii(text), plain).otherwise(text.rlike("(?iu)" + "|".join(phrases)))
