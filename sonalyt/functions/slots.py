"""Whether a transcript has the value of a slot, by Spark's own expressions over its normal form.

The value's canonical form becomes a pattern that allows what transcripts do to values of its class (digits and letters of ids apart at spaces, a month before or after its day, a currency's
word in either number), always from one token's start to another's end. Nothing else is looked for, so no candidates are listed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .entities import CLASSES, MONTHS, canonical
from .languages import normalize

UNITS = {"dollars": "dollars?", "euros": "euros?", "pounds": "pounds?", "yen": "yen"}  # fixed values: currency words, each with what it may be said as
ID_TOKEN, ID_TOKENS, ID_LEAST = 8, 8, 3  # fixed values: letters of a token and tokens of an id at most, letters of an id at least
_START, _END = r"(?<!\S)", r"(?!\S)"


def _quoted(text: Column) -> Column:
    return F.regexp_replace(text, r"([^\p{L}\p{N} ])", r"\\$1")


def _apart(text: Column) -> Column:
    """The characters with at most one space between any two."""
    return F.regexp_replace(_quoted(text), r"(?<=[\p{L}\p{N}])(?=[\p{L}\p{N}\\])", " ?")


def pattern(entity: Column, value: Column) -> Column:
    """What a canonical value looks like in a normal form; null for values that none can have."""
    number = F.when(value.rlike(r"^\d+$"), F.concat(F.lit(_START), _apart(value), F.lit(_END)))
    mixed = (F.length(value) >= ID_LEAST) & value.rlike(r"\d") & value.rlike(r"\p{L}")
    one_id = F.when(mixed, F.concat(F.lit(_START), F.lit(rf"(?=\S{{1,{ID_TOKEN}}}(?: \S{{1,{ID_TOKEN}}}){{0,{ID_TOKENS - 1}}}{_END})"), _apart(value), F.lit(_END)))
    amount, unit = F.regexp_extract(value, r"^(\d+) (\S+)$", 1), F.regexp_extract(value, r"^(\d+) (\S+)$", 2)
    said = F.element_at(F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair]), unit)
    currency = F.when(amount != "", F.concat(F.lit(_START), _apart(amount), F.lit(" "), said, F.lit(_END)))
    month, day = F.regexp_extract(value, r"^(\S+) 0?(\d+)$", 1), F.regexp_extract(value, r"^(\S+) 0?(\d+)$", 2)
    known = month.isin(*MONTHS["en"].split()) & (F.length(day) <= 2)
    days = F.concat(F.when(F.length(day) == 1, "0?").otherwise(""), day)
    date = F.when(known, F.concat(F.lit(f"{_START}(?:"), month, F.lit(" (?:the )?"), days, F.lit("|"), days, F.lit(r" (?:(?!\d{1,2} )\S+ )?"), month, F.lit(f"){_END}")))
    name = F.when(value != "", F.concat(F.lit(_START), _quoted(value), F.lit(_END)))
    of = {"number": number, "id": one_id, "currency": currency, "date": date, "name": name}
    chosen = F.when(entity.isNull() | ~entity.isin(*CLASSES), F.raise_error(F.concat(F.lit("unknown class of slot: "), F.coalesce(entity, F.lit("null")))))
    for k, p in of.items():
        chosen = chosen.when(entity == k, p)
    return chosen


def extracted(entity: Column, written: Column, text: Column, language: Column) -> Column:
    """The canonical form of a written value if the transcript has it, else null."""
    value = canonical(entity, written, language)
    said = F.trim(F.regexp_replace(F.coalesce(normalize(text, language), F.lit("")), r"\s+", " "))
    return F.when(F.regexp_like(said, pattern(entity, value)), value)
