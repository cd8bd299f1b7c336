"""Alignments, distances and tables over texts, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from sonalyt.functions import align
from sonalyt.functions import text as X
from sonalyt.operators import transcripts


def table_of_costs(r, h):
    """(kind, place, place) by the full table: traced from the end, match or substitution before deletion before insertion."""
    cost = [[i + j if not i or not j else 0 for j in range(len(h) + 1)] for i in range(len(r) + 1)]
    for i in range(1, len(r) + 1):
        for j in range(1, len(h) + 1):
            cost[i][j] = min(cost[i - 1][j - 1] + (r[i - 1] != h[j - 1]), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    out, i, j = [], len(r), len(h)
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (r[i - 1] != h[j - 1]):
            i, j = i - 1, j - 1
            out.append(("equal" if r[i] == h[j] else "substitute", i, j))
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
            out.append(("delete", i, j))
        else:
            j -= 1
            out.append(("insert", i, j))
    return out[::-1]


def test_steps_against_a_table():
    r = random.Random(8)
    for _ in range(400):
        v = r.choice((2, 4, 30))
        a = [r.randrange(v) for _ in range(r.choice((0, 1, 4, 30, 66)))]
        b = [x for x in a if r.random() < 0.8] + [r.randrange(v) for _ in range(r.randrange(4))] if r.random() < 0.5 else [r.randrange(v) for _ in range(r.choice((0, 1, 5, 90)))]
        want = table_of_costs(a, b)
        assert align.steps(a, b) == want
        assert align.edit_counts(a, b) == tuple(sum(k == kind for k, _, _ in want) for kind in ("substitute", "delete", "insert"))


def test_long_pairs_by_blocks():
    r = random.Random(2)
    a = [r.randrange(40) for _ in range(900)]
    b = [x if r.random() < 0.85 else r.randrange(40) for x in a if r.random() < 0.95]
    assert align.steps(a, b) == table_of_costs(a, b)


def test_distances_of_letters_and_words(spark):
    rows = [(["a", "b"], ["b"]), (["ab", "b"], ["b"]), ([], ["x"]), ([], []), (["é", "日"], ["é"]), (["ab", "a"], ["a", "ba"]), (["𝄞", "x"], ["x"]), (None, ["a"])]
    got = [r.d for r in spark.createDataFrame(rows, "r array<string>, h array<string>").select(X.token_distance(F.col("r"), F.col("h")).alias("d")).collect()]
    assert got == [1, 1, 1, 0, 1, 2, 1, None]


def test_edits_by_kind_of_repeated_and_null_texts(spark):
    rows = [("p", "stream", "nl", "a b c", "a x c d"), ("p", "stream", "nl", "a b c", "a x c d"), ("p", "stream", "nl", None, "a"), ("p", "stream", "nl", "a", None), ("p", "batch", "ja", "ab", "b")]
    frame = spark.createDataFrame(rows, "provider string, mode string, language string, reference string, text string").withColumn("pair_language", F.lit("clash"))
    got = {(r.mode, r.language): tuple(r[k] for k in ("clips", *transcripts.KINDS)) for r in transcripts.edit_kinds(frame).collect()}
    assert got == {("stream", "nl"): (4, 2, 1, 3, 7), ("batch", "ja"): (1, 0, 1, 0, 2)}


@pytest.fixture(scope="module")
def cells(spark):
    said = "lane string, clip_id string, language string, text string, error string, seq int"
    rows = [("a", "1", "en", "x y", None, 1), ("b", "1", "en", "x z", None, 1), ("a", "2", "nl", "p q r s", None, 1), ("b", "2", "nl", "p q r s", None, 1), ("c", "3", "en", "alone", None, 1), ("b", "1", "en", "old", None, 0)]
    return transcripts.agreement(spark.createDataFrame(rows, said)).cache()


def test_agreement_over_all_languages_is_pooled(cells):
    got = {(r.lane_a, r.lane_b, r.language): (r.clips, r.edits, r.tokens) for r in cells.collect()}
    assert got == {("a", "b", "en"): (1, 1, 4), ("a", "b", "nl"): (1, 0, 8), ("a", "b", "all"): (2, 1, 12), ("a", "c", None): (None, None, None), ("b", "c", None): (None, None, None)}


def test_agreement_matrix(cells):
    got = {r.lane: (r.a, r.b, r.c) for r in transcripts.agreement_matrix(cells).collect()}
    assert got == {"a": (None, 2 / 12, None), "b": (2 / 12, None, None), "c": (None, None, None)}
