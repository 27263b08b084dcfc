"""Text projections: trimming, excerpts, signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.functions.regex import SPACE_CHARS, extract, replace

MAX_EXCERPT_CHARS = 300


def strip(text: Column) -> Column:
    """Remove Unicode white space at both ends."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def none_if_empty(text: Column) -> Column:
    return F.when(text != "", text)


def first_match(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost match of ``pattern``, or null (an empty match counts as none)."""
    hit = extract(text, pattern, group)
    return F.when(hit != "", hit)


def trim_excerpt(text: Column) -> Column:
    """Shorten to 300 characters and mark the cut with an ellipsis."""
    return F.when(
        F.length(text) > MAX_EXCERPT_CHARS,
        F.concat(F.substring(text, 1, MAX_EXCERPT_CHARS), F.lit("…")),
    ).otherwise(text)


def first_chars(text: Column, chars: int | None) -> Column:
    """The first ``chars`` characters; None keeps all."""
    return text if chars is None else F.substring(text, 1, chars)


def message_signature(message: Column, chars: int | None = None) -> Column:
    """Replace hex numbers, numbers and quoted strings, so repeats group together.

    With ``chars``, messages that agree that far share a signature.
    """
    sig = F.regexp_replace(message, "0x[0-9a-fA-F]+", "<hex>")
    sig = replace(sig, r"\d+(?:\.\d+)*", "<n>")
    sig = F.regexp_replace(sig, '"[^"]*"', '"<str>"')
    return first_chars(strip(sig), chars)
