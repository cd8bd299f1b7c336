"""Alignments of two token sequences: spans by kind, runs of insertions, errors within marked spans."""

from __future__ import annotations

from collections import Counter
from math import isqrt

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN = T.StructType([T.StructField("kind", T.StringType())] + [T.StructField(c, T.IntegerType()) for c in ("ref_from", "ref_to", "hyp_from", "hyp_to")])
SCORE = T.StructType([T.StructField("class", T.StringType())] + [T.StructField(c, T.LongType()) for c in ("occurrences", "exact", "substitutions", "deletions", "insertions", "tokens")])


def _columns(place: dict, hypothesis: list, start: int, plus: int, minus: int, full: int) -> list[tuple[int, int, int]]:
    """Columns of the cost table after each token from `start` on, bit i for token i of the reference (Hyyrö's form of Myers' algorithm): where a cost is one more
    than the one above it, where it is one less, and where it equals the one before it on the diagonal. Integers of any length stand for words of 64 bits in a row."""
    out = []
    for token in hypothesis[start:]:
        same = place.get(token, 0)
        level = (((same & plus) + plus) ^ plus | same | minus) & full
        right = (minus | ~(level | plus)) << 1 & full | 1
        left = (level & plus) << 1 & full
        plus, minus = left | ~(level | right) & full, level & right
        out.append((plus, minus, level))
    return out


def steps(reference: list, hypothesis: list) -> list[tuple[str, int, int]]:
    """A least-cost alignment as (kind, place in reference, place in hypothesis), in order. Of equal ways, traced from the end, a match or substitution
    is taken before a deletion, and that before an insertion.

    Costs are differences kept as bits, a column of the table in a few integers. Of a long pair every so manyth column is kept, and the columns between two of
    those are worked out again on the way back, so memory grows with the reference's length times the root of the hypothesis'."""
    n, m = len(reference), len(hypothesis)
    tail = 0  # equal tokens at the end are matches in any case
    while tail < min(n, m) and reference[n - 1 - tail] == hypothesis[m - 1 - tail]:
        tail += 1
    i, j = n - tail, m - tail
    out = [("equal", n - 1 - k, m - 1 - k) for k in range(tail)]
    place: dict = {}
    for k in range(i):
        place[reference[k]] = place.get(reference[k], 0) | 1 << k
    full, every = (1 << i) - 1, max(64, isqrt(j) + 1)
    kept = [(full, 0)]
    for at in range(0, j - 1, every):
        kept.append(_columns(place, hypothesis[: at + every], at, *kept[-1], full)[-1][:2])
    block: list[tuple[int, int, int]] = []
    first = j
    while i and j:
        if j - 1 < first:
            first = (j - 1) // every * every
            block = _columns(place, hypothesis[:j], first, *kept[first // every], full)
        bit = 1 << (i - 1)
        plus, _, level = block[j - 1 - first]
        if reference[i - 1] == hypothesis[j - 1] or not level & bit:
            i, j = i - 1, j - 1
            out.append(("equal" if reference[i] == hypothesis[j] else "substitute", i, j))
        elif plus & bit:
            i -= 1
            out.append(("delete", i, j))
        else:
            j -= 1
            out.append(("insert", i, j))
    out += [("delete", k, 0) for k in range(i - 1, -1, -1)] + [("insert", 0, k) for k in range(j - 1, -1, -1)]
    return out[::-1]


def edit_counts(reference: list, hypothesis: list) -> tuple[int, int, int]:
    """Substitutions, deletions and insertions of that alignment."""
    kinds = Counter(kind for kind, _, _ in steps(reference, hypothesis))
    return kinds["substitute"], kinds["delete"], kinds["insert"]


def spans(reference: list, hypothesis: list) -> list[tuple[str, int, int, int, int]]:
    """The steps with neighbours of one kind put together."""
    out: list[list] = []
    for kind, i, j in steps(reference, hypothesis):
        a, b = i + (kind != "insert"), j + (kind != "delete")
        if out and out[-1][0] == kind:
            out[-1][2], out[-1][4] = a, b
        else:
            out.append([kind, i, a, j, b])
    return [tuple(x) for x in out]


def marked(reference: list, marks: list[tuple[str, int, int]], hypothesis: list) -> list[tuple]:
    """By class of marks (class, from, to; to exclusive): occurrences, those without error, and errors; an insertion counts only strictly inside a mark."""
    way = steps(reference, hypothesis)
    score: dict[str, list[int]] = {}
    for name, a, b in marks:
        s = sum(k == "substitute" and a <= i < b for k, i, _ in way)
        d = sum(k == "delete" and a <= i < b for k, i, _ in way)
        n = sum(k == "insert" and a < i < b for k, i, _ in way)
        row = score.setdefault(name, [0] * 6)
        for at, v in enumerate((1, int(s + d + n == 0), s, d, n, b - a)):
            row[at] += v
    return [(k, *v) for k, v in score.items()]


@F.pandas_udf(T.ArrayType(SPAN))
def alignment(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    names = SPAN.names
    return pd.Series([[dict(zip(names, x, strict=True)) for x in spans(list(r if r is not None else ()), list(h if h is not None else ()))] for r, h in zip(reference, hypothesis, strict=True)])


def marked_errors(mark):
    """mark: tokens -> marks; the scores by class of each row."""

    @F.pandas_udf(T.ArrayType(SCORE))
    def run(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
        rows = []
        for r, h in zip(reference, hypothesis, strict=True):
            r, h = list(r if r is not None else ()), list(h if h is not None else ())
            rows.append([dict(zip(SCORE.names, x, strict=True)) for x in marked(r, mark(r), h)])
        return pd.Series(rows)

    return run
