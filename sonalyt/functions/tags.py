"""Inline tags: <name>text</name>. Names that aren't asked for stay text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _pattern(names: list[str]) -> str:
    return "|".join(names)


def tagged(text: Column, name: str) -> Column:
    """What stands in a tag, as an array, in order."""
    return F.regexp_extract_all(text, F.lit(f"<{name}>([^<]*)</{name}>"), 1)


def strip_tags(text: Column, names: list[str]) -> Column:
    return F.regexp_replace(text, f"</?(?:{_pattern(names)})>", "")


def same_text(a: Column, b: Column) -> Column:
    """Equal but for white space."""
    return F.regexp_replace(F.trim(a), r"\s+", " ") == F.regexp_replace(F.trim(b), r"\s+", " ")


def pieces(text: Column) -> Column:
    """Words with the white space after them; joined they give the text from its first word on."""
    return F.regexp_extract_all(text, F.lit(r"\S+\s*"), 0)


def loops(words: Column, longest: int = 5, times: int = 3, least: int = 6) -> Column:
    """Whether an n-gram of up to `longest` words comes back to back at least `times` times over at least `least` words.

    For each n, whether a word equals the one n later is a string of flags; so many repeats are a run of so many flags.
    """
    found = F.lit(False)
    for n in range(1, longest + 1):
        again = max(times, -(-least // n))  # repeats that satisfy both
        pairs = F.zip_with(words, F.slice(words, n + 1, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.when(a == b, "1").otherwise("0"))
        found = found | F.array_join(pairs, "").rlike("1{%d}" % (n * (again - 1)))
    return found


def snr_level(clip_id: Column) -> Column:
    """The level in a prefix as snr+05- or snr-10-, null for other clips."""
    return F.nullif(F.regexp_extract(clip_id, r"^snr([+-]\d{2})-", 1), F.lit("")).cast("int")
