"""Text scalars: normalisation and edit distances."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .align import edit_counts

#: categories that punctuation stripping drops; currency signs and other symbols stay
PUNCTUATION = r"[\p{Pc}\p{Pd}\p{Pe}\p{Pf}\p{Pi}\p{Po}\p{Ps}\p{Sm}\p{Sk}]"
#: fixed values: primary language subtags that are scored by characters
BY_CHARACTER = ("ja", "zh", "th", "lo", "my", "km")


def strip_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, PUNCTUATION, "")


def squash(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normalize(text: Column) -> Column:
    """The generic normaliser: compatibility forms, lower case, no punctuation, single spaces."""
    return squash(strip_punctuation(F.lower(nfkc(text))))


def subtag(language: Column) -> Column:
    return F.lower(F.substring_index(F.regexp_replace(language, "_", "-"), "-", 1))


def by_character(language: Column) -> Column:
    return subtag(language).isin(*BY_CHARACTER)


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), " "), lambda w: w != "")


def characters(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda w: (w != "") & (w != " "))


def token_distance(reference: Column, hypothesis: Column) -> Column:
    """Edits between two arrays of tokens, with Spark's own levenshtein(): of the letters as they are, else each distinct token becomes one character of a private code.

    Up to 60,000 distinct tokens in a pair have codes of their own, from U+0100 on without the surrogates; a pair with more is no utterance and fails the job.
    """
    letters, others = F.array_join(reference, ""), F.array_join(hypothesis, "")
    single = (F.length(letters) == F.size(reference)) & (F.length(others) == F.size(hypothesis))
    both = F.array_distinct(F.concat(reference, hypothesis))
    known = F.when(F.size(both) > 60_000, F.raise_error(F.lit("more than 60,000 distinct tokens in a pair"))).otherwise(both)

    def coded(tokens: Column, codes: Column) -> Column:
        place = F.transform(tokens, lambda t: F.array_position(codes, t))
        return F.decode(F.unhex(F.array_join(F.transform(place, lambda p: F.lpad(F.hex(p + F.when(p >= 0xD700, 0x900).otherwise(0x100)), 4, "0")), "")), "UTF-16BE")

    once = F.transform(F.array(known), lambda codes: F.levenshtein(coded(reference, codes), coded(hypothesis, codes)))  # a variable of a lambda is worked out once a pair
    return F.when(single, F.levenshtein(letters, others)).otherwise(F.get(once, F.lit(0)))


EDITS = T.StructType([T.StructField(c, T.LongType()) for c in ("substitutions", "deletions", "insertions", "reference_length")])


@F.pandas_udf(EDITS)
def edits(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
    """Edit counts by kind between arrays of tokens."""
    rows = []
    for r, h in zip(reference, hypothesis, strict=True):
        r, h = list(r if r is not None else ()), list(h if h is not None else ())
        rows.append((*edit_counts(r, h), len(r)))
    return pd.DataFrame(rows, columns=["substitutions", "deletions", "insertions", "reference_length"])


def error_rate(errors: Column, length: Column) -> Column:
    """Errors by reference length; errors against an empty reference are infinite."""
    return F.when(length > 0, errors / length).when(errors > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))
