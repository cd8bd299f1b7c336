"""Values of slots in transcripts, similarity of segments, suites and scenarios, lanes as they come in."""

import json

import pytest
from pyspark.sql import functions as F

from sonalyt.functions import slots
from sonalyt.operators import judging, ranking
from sonalyt.sources import corpus
from sonalyt.streaming import lanes

SLOTS = [
    ("number", "555-0142", "it is five five five zero one four two", "5550142"), ("number", "12", "one hundred twenty five", None), ("number", "5550142", "call 555 0142 9", "5550142"), ("number", "none", "none", None),
    ("id", "XK-4792 B", "the code is x k 4792 b", "xk4792b"), ("id", "ab", "ab", None), ("id", "a1b", "a1bc", None), ("id", "abcdefghi1", "abcdefghi1", None), ("id", "a1", "a 1", None),
    ("currency", "$95,000", "ninety five thousand dollars", "95000 dollars"), ("currency", "€5", "5 dollars", None), ("date", "May 3", "on the 3rd of may", "may 3"), ("date", "may 3", "may the 3", "may 3"), ("date", "may 3", "may 13", None), ("date", "may 3", "3 4 may", None),
    ("name", "Ann Lee", "hello ann  LEE!", "ann lee"), ("name", "Ann", "anna", None), ("name", "A.B (c)", "a b c", None), ("name", None, "x", None), ("name", "x", None, None),
]


def test_slots(spark):
    rows = spark.createDataFrame([(*x, "en") for x in SLOTS], "entity string, written string, text string, want string, language string")
    got = rows.select("*", slots.extracted(F.col("entity"), F.col("written"), F.col("text"), F.col("language")).alias("got")).collect()
    assert [(r.written, r.text, r.got) for r in got] == [(r.written, r.text, r.want) for r in got]
    with pytest.raises(Exception, match="unknown class"):
        rows.select(slots.extracted(F.lit("colour"), F.lit("x"), F.lit("x"), F.lit("en"))).collect()


def test_segment_similarity(spark):
    rows = [(1, "a b c", "a b c"), (2, "a b c", "a x c"), (3, "a b", "a"), (4, None, ""), (5, "a", None), (6, "a b", "a zero"), (7, "a b", "a minus"), (8, "a b", "a unknown")]
    vectors = [("b", [1.0, 0.0]), ("x", [0.6, 0.8]), ("zero", [0.0, 0.0]), ("minus", [-1.0, 0.0]), ("b", [1.0, 0.0]), ("none", None)]
    frame = spark.createDataFrame(rows, "id int, reference string, text string").withColumn("language", F.lit("nl"))
    got = {r.id: round(r.similarity, 6) for r in judging.segment_similarity(frame, spark.createDataFrame(vectors, "text string, vector array<double>"), ["id"]).collect()}
    assert got == {1: 1.0, 2: round(2.6 / 3, 6), 3: 0.5, 4: 1.0, 5: 0.0, 6: 0.5, 7: 0.5, 8: 0.5}


def test_divergence(spark):
    rows = spark.createDataFrame([("p", 0.9, 1.0), ("q", 0.8, 3.0), ("r", 0.7, 2.0), ("s", None, None)], "v string, success double, mean double")
    assert [tuple(r)[0::5] for r in ranking.divergence(rows, "v", "success", "mean").collect()] == [("q", -1.0), ("r", 1.0), ("p", 0.0), ("s", 0.0)]


def test_suite(spark, tmp_path):
    line = {"prompt_id": "p1", "text": " Hi\n there ", "language": "en", "category": "c", "license": "l", "source": "s"}
    (tmp_path / "suite.jsonl").write_text(json.dumps(line) + "\n\n" + json.dumps(line | {"prompt_id": "p2", "text": " ", "annotated": "x"}) + "\n")
    rows = corpus.read_suite(spark, str(tmp_path / "suite.jsonl"))
    corpus.write_suite(rows, str(tmp_path / "out"))
    assert sorted(map(str, corpus.read_suite(spark, str(tmp_path / "out")).collect())) == sorted(map(str, rows.collect()))
    corpus.write_prompt_text(rows, str(tmp_path / "text"))
    assert [r.value for r in spark.read.text(str(tmp_path / "text")).collect()] == ["Hi there"]
    for bad in ("{not json", json.dumps({k: v for k, v in line.items() if k != "license"})):
        (tmp_path / "bad.jsonl").write_text(bad)
        with pytest.raises(Exception):  # noqa: B017
            corpus.read_suite(spark, str(tmp_path / "bad.jsonl")).collect()


def test_scenarios(spark, tmp_path):
    slot = {"name": "who", "kind": "person", "question": "Who?"}
    good = {"id": "s1", "slots": [slot, slot | {"name": "n", "kind": "phone", "entity": "id"}]}
    (tmp_path / "a.json").write_text(json.dumps([good], indent=1))
    got = corpus.read_scenarios(spark, str(tmp_path / "a.json")).collect()
    assert [(r.scenario_id, r.language, r.description, r.place, r.name, r.entity) for r in got] == [("s1", "en-US", "", 0, "who", "name"), ("s1", "en-US", "", 1, "n", "id")]
    for bad in (good | {"id": ""}, good | {"slots": []}, good | {"slots": [slot | {"kind": "odd"}]}, good | {"slots": [slot | {"entity": "odd"}]}, good | {"slots": [slot | {"question": None}]}, {"id": "x"}):
        (tmp_path / "b.json").write_text(json.dumps(bad))
        with pytest.raises(Exception):  # noqa: B017
            corpus.read_scenarios(spark, str(tmp_path / "b.json")).collect()


def test_lanes_survive_a_batch_that_ends_before_its_mark(spark, tmp_path):
    schema = "provider string, mode string, clip int"
    for k in range(3):
        spark.createDataFrame([(f"p{k % 2}", "stream", 10 * k + i) for i in range(4)], schema).coalesce(1).write.json(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in" / "*"))
    out = str(tmp_path / "out")

    def fails(batch):
        if batch == 1:
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        lanes.sink(stream, out, before_mark=fails).awaitTermination()
    clips = lambda: sorted(r.clip for r in lanes.read(spark, out, schema).collect())
    assert len(clips()) == 4  # the second batch's rows are there, but not marked
    lanes.sink(stream, out).awaitTermination()
    assert clips() == sorted(10 * k + i for k in range(3) for i in range(4))


def test_curated_times_of_a_million_seconds(spark, tmp_path):
    """A time in an id has eight digits at least; a longer one is read whole."""
    ids = ["v1-00000-00000150-00000650", "v2-00000-99999900-100000400", "v3-00000-100000000-100000500", "v4-00000-0000015-00000650"]
    (tmp_path / "m.json").write_text("".join(json.dumps({"source": "yodas2", "subset": "en", "shard": "00000000", "utt_id": i}) + "\n" for i in ids))
    kept, skipped = corpus.read_curated(spark, str(tmp_path / "m.json"), ("yodas2",))
    assert sorted((r.start_s, r.end_s) for r in kept.collect()) == [(1.5, 6.5), (999999.0, 1000004.0), (1000000.0, 1000005.0)] and skipped.count() == 1


def test_long_ids_and_repeated_customers_against_sql(spark, tmp_path):
    """Tokens of more than eight letters are in no id, as SQL says too; a key that comes twice counts twice, not four times."""
    import duckdb

    from sonalyt.plans import slots as plan

    keys = [1, 2, 2, 9, 39_999, 40_000, 69_999, 70_000, 99_899, 99_900, 99_901, 900_005]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    from sonalyt.plans.queries import ORACLE_SQL

    want = sorted(con.execute(ORACLE_SQL["slot_success"]).fetchall())
    assert sorted(tuple(r) for r in plan.slot_success(spark, str(tmp_path)).collect()) == want
