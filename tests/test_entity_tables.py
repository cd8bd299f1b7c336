"""Scores of entities within transcripts, and the tables made of them."""

import pytest
from pyspark.sql import functions as F

from sonalyt.functions import entities as E
from sonalyt.operators import entities as scores

ROWS = "provider string, mode string, language string, reference string, annotated string, text string, error string"


def test_segments():
    assert [x for x in E.segments("a <number>1</number> <odd>b</odd> <date>c</name> <name>d</name>") if x[0]] == [("a ", None), ("1", "number"), (" <odd>b</odd> <date>c</name> ", None), ("d", "name")]


def test_scores_by_class():
    said = "call <name>Ann Lee</name> at <number>twenty one</number>"
    assert E.scored(said, "call ann lee at 21", "en") == [("name", 1, 1, 0, 0, 0, 2), ("number", 1, 1, 0, 0, 0, 1)]
    assert E.scored(said, "call ann um lee at 22", "en") == [("name", 1, 0, 0, 0, 1, 2), ("number", 1, 0, 1, 0, 0, 1)]
    assert E.scored(said, "um call oh ann lee", "en") == [("name", 1, 1, 0, 0, 0, 2), ("number", 1, 0, 0, 1, 0, 1)]  # beside a tag is not in it
    assert E.scored("no tags", "no tags", "en") == [] and E.scored("<name> </name> x", "x", "en") == []
    assert E.scored("<name>コーヒー</name>", "こーひー", "ja") == [("name", 1, 1, 0, 0, 0, 4)]


@pytest.fixture(scope="module")
def told(spark):
    rows = [
        ("p", "s", "en", "pay $5 to Ann", "pay <currency>$5</currency> to <name>Ann</name>", "pay 5 dollars to anna", None), ("p", "s", "en", "pay $5 to Ann", "pay <currency>$5</currency> to <name>Ann</name>", "pay 5 dollars to anna", None),
        ("p", "s", "en", "in 1999", None, "in 1999", None), ("p", "s", "en", "in 1999", None, None, "broken"), ("q", "s", "en", "nothing here", None, "x", None), ("q", "s", None, None, None, None, None),
    ]
    return scores.with_scores(spark.createDataFrame(rows, ROWS).withColumn("class", F.lit("clash"))).cache()


def test_tables(told):
    table = scores.by_class(told)
    got = {(r["provider"], r["class"]): (r.occurrences, r.exact, r.substitutions, r.tokens, r.error_rate, r.exact_rate) for r in table.collect()}
    assert got == {("p", "currency"): (2, 2, 0, 4, 0.0, 1.0), ("p", "name"): (2, 0, 2, 2, 1.0, 0.0), ("p", "date"): (1, 1, 0, 1, 0.0, 1.0)}
    one = scores.as_map(table).collect()
    assert len(one) == 1 and sorted(one[0].entities) == ["currency", "date", "name"] and one[0].entities["name"].substitutions == 2
    assert scores.wide(table).columns == ["provider", "mode", "language"] + [f"ent_{k}[{c}]" for c in ("currency", "date", "name") for k in ("err", "exact")]
    assert sorted((r["provider"], r.d) for r in told.select("provider", scores.damaged(F.col("entities")).alias("d")).collect() if r.d is not None) == [("p", False), ("p", True), ("p", True)]
