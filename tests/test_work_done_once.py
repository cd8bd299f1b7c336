"""What grows with the rows is worked out once and stays off the driver."""

import pandas as pd
from pyspark.sql import functions as F

from sonalyt.operators import entities, judging, records, transcripts
from sonalyt.plans import entities as plan


def counted(spark, kind):
    """A pandas function that gives its text back, and how many rows it has seen."""
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf(kind)
    def run(x: pd.Series) -> pd.Series:
        seen.add(len(x))
        return x

    return run, seen


def test_a_text_of_many_clips_is_tagged_once(spark):
    run, seen = counted(spark, "string")
    got = plan._tagged(spark.range(1000).select(F.lit("two cats").alias("said")), run(F.col("said"))).collect()
    assert [tuple(r) for r in got] == [("two cats", 1000)] and seen.value == 1


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


ROWS = [("a", "stream", "en-US", "pay two dollars", None, "pay two dollars", None), ("b", "stream", "en-US", "pay two dollars", None, "pay dollars", None)]
COLUMNS = "provider string, mode string, language string, reference string, annotated string, text string, error string"


def test_scores_and_edits_are_not_broadcast(spark):
    rows = spark.createDataFrame(ROWS, COLUMNS)
    for df in (entities.with_scores(rows), transcripts.with_edit_kinds(rows)):
        assert "SortMergeJoin" in plan_of(df) and "BroadcastHashJoin" not in plan_of(df)


def test_columns_found_in_the_data_cost_no_second_run(spark):
    run, seen = counted(spark, "double")
    classes = spark.createDataFrame([("a", "stream", "en", "date", 0.5, 1.0), ("a", "stream", "en", "id", 0.0, 1.0)], "provider string, mode string, language string, class string, error_rate double, exact_rate double").coalesce(1)
    assert [tuple(r) for r in entities.wide(classes.withColumn("error_rate", run("error_rate"))).collect()] == [("a", "stream", "en", 0.5, 1.0, 0.0, 1.0)] and seen.value == 2
    run, seen = counted(spark, "long")
    counts = spark.createDataFrame([("t", "batch", "j", 1, 1, 0, 0, 4)], "provider string, mode string, judge string, clips long, substitutions long, deletions long, insertions long, reference_length long").coalesce(1)
    got = judging.roundtrip_table(counts.withColumn("insertions", run("insertions")), spark.createDataFrame([("t", "x")], "key string, family string")).collect()
    assert [tuple(r) for r in got] == [("t", "batch", 0.25, False, 0.25, False)] and seen.value == 1


def test_a_line_is_parsed_once(spark):
    lines = spark.createDataFrame([('{"utt_id": "u", "text": "long enough to be kept", "duration": 4.0}',), ('{"utt_id": "u", "te',), (None,)], "value string")
    got = records.tolerant_candidates(lines, "s")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
    assert [tuple(r) for r in got.collect()] == [("u", "", "s", 0.0, 4.0, "long enough to be kept")]


def test_texts_that_differ_in_digits_are_read_once(monkeypatch):
    """Their spans are those that each text has by itself; years, numbers of another length and other languages are read anew."""
    from sonalyt.functions import entities as tags

    seen = []
    monkeypatch.setattr(tags, "candidates", lambda text, primary, read=tags.candidates: seen.append(text) or read(text, primary))
    for k in range(20):
        assert tags.tag(f"Met Ann on may {k % 9 + 1} to pay 4{k % 10}$ for ref q{500 + k}z or {3000 + k}", "en").endswith(f" for ref <id>q{500 + k}z</id> or <number>{3000 + k}</number>")
    assert len(seen) == 1
    assert tags.tag("in 1987, not in 3987 or 20199", "en") == "in <date>1987</date>, not in <number>3987</number> or <number>20199</number>"
    assert tags.tag("in 3987, not in 2087 or 40199", "en") == "in <number>3987</number>, not in <date>2087</date> or <number>40199</number>"
    texts = ["$5 or 12,500 €, 3rd of may 2024; 19:30 a1b2 10000000", "٣ 19 1９99 x2019y 2019. 201 0119 20190 1,999 12/05/19 12/05/2019", "pay 5 - 6 7 dollars, twenty 3 and 4th"]
    for text in texts:
        for other in (text, *(text.replace(a, b) for a, b in ("52", "93", "06"))):
            for primary in ("en", "de", "fr", "es", "ko", "ja", ""):
                assert list(tags.spans(other, primary)) == tags.best(tags.candidates(other, primary))
