"""What names, replies and ids say: conditions, sessions, providers, verdicts, labels, families, display cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What other tools write and read.
TRANSIENT = ("concurrent", "concurrency", "too many", "rate limit", "rate_limit", "quota", "429", "503", "temporarily unavailable")
CONDITIONS = {"silence-": "silence", "noise-": "noise", "trailsil-": "trailing_silence", "lowsnr-": "low_snr"}
FAMILIES = {"gemini": "gemini", "gpt-": "openai"}
SEVERITY = ("entity", "meaning-changing", "harmless")
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


def transient(error: Column) -> Column:
    """Whether an error is a refusal for lack of capacity, which says nothing about the provider."""
    return F.lower(error).rlike("|".join(m.replace(" ", r"\x20") for m in TRANSIENT))


def condition(clip_id: Column) -> Column:
    """The condition that a clip id begins with, null for others."""
    out = F.lit(None).cast("string")
    for prefix, name in CONDITIONS.items():
        out = F.when(clip_id.startswith(prefix), name).otherwise(out)
    return out


def telephony(clip_id: Column) -> Column:
    return clip_id.startswith("tel8k-")


def stem(path: Column) -> Column:
    """A file's name without folders and its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def session_id(path: Column) -> Column:
    """A file's session: the UUID that its name begins with, else the name without _merged."""
    name = F.regexp_replace(stem(path), "_merged$", "")
    found = F.regexp_extract(name, UUID, 0)
    return F.when(found != "", found).otherwise(name)


def provider_of_file(name: Column) -> Column:
    """What stands before -batch-, else before -stream-, in a recording's file name; empty without either."""
    base = F.regexp_replace(name, r"\.wav$", "")
    return F.when(base.contains("-batch-"), F.substring_index(base, "-batch-", 1)).when(base.contains("-stream-"), F.substring_index(base, "-stream-", 1)).otherwise("")


def verdict(reply: Column) -> Column:
    """The first of first, second, tie that a reply names, null if none."""
    return F.nullif(F.regexp_extract(F.lower(reply), r"\b(first|second|tie)\b", 1), F.lit(""))


def label(reply: Column) -> Column:
    """The label of a reply: that of its JSON, else the gravest that its text names; a reply without one fails the job."""
    told = F.get_json_object(reply, "$.label")
    low = F.lower(reply)
    named = F.when(told.isin(*SEVERITY), told)
    for x in SEVERITY:
        named = named.when(low.contains(x), x)
    return named.otherwise(F.raise_error(F.concat(F.lit("no label in "), F.coalesce(reply, F.lit("a null reply")))))


def family(model: Column) -> Column:
    """The family of a judge's model; an unknown one fails the job."""
    out = None
    for prefix, name in FAMILIES.items():
        out = F.when(model.startswith(prefix), name) if out is None else out.when(model.startswith(prefix), name)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown family of "), F.coalesce(model, F.lit("a null model")))))


def unit_count(text: Column, by_character: Column) -> Column:
    """Characters that aren't white space, or words, of a text as it is."""
    return F.when(by_character, F.length(F.regexp_replace(text, r"\s", ""))).otherwise(F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))).cast("long")


def cell(value: Column, places: int = 3, suffix: str = "") -> Column:
    """A number for display, a dash for null."""
    return F.when(value.isNull(), "—").otherwise(F.concat(F.format_string(f"%.{places}f", value.cast("double")), F.lit(suffix)))


def cache_key(*parts: Column) -> Column:
    """A content address: SHA-256 over the parts as a JSON array; null and empty differ."""
    return F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256)
