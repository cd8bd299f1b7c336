"""What can be judged, summaries by condition, sinks of agreement, recordings in a row."""

import json
from glob import glob

import pytest
from pyspark.sql import functions as F

from sonalyt.operators import judging, lanes, ranking, recordings, transcripts


def test_judgeable(spark):
    rows = [("p", "s", "1", "ref", None, None, 1), ("p", "s", "1", "ref", None, None, 2), ("p", "s", "2", " ", None, None, 1), ("p", "s", "3", None, None, None, 1), ("p", "s", "4", "r", "e", None, 1), ("p", "s", "5", "r", None, "unverified", 1)]
    got = lanes.judgeable(spark.createDataFrame(rows, "provider string, mode string, clip_id string, reference string, error string, gold_status string, seq int"), ["seq"]).collect()
    assert [(r.clip_id, r.seq) for r in got] == [("1", 2)]


def test_snr_and_line(spark):
    one = lambda clip, error, s, n, f: ("p", "stream", None, clip, error, s, 0, 0, n, f)
    rows = [one("snr+10-a", None, 0, 10, 1.0), one("snr+00-a", None, 5, 10, 3.0), one("snr-05-a", "x", None, None, None), one("tel8k-a", None, 2, 10, None), one("tel8k-b", "x", None, None, None), one("plain", None, 9, 10, 9.0), one("snr+05-a", None, None, None, 2.0)]
    frame = spark.createDataFrame(rows, "provider string, mode string, language string, clip_id string, error string, substitutions long, deletions long, insertions long, reference_length long, finalize_s double")
    got = lanes.snr_summary(frame).collect()
    assert [(r.language, r.failures, r.levels, r.auc, r.finalize_change_s, r.line_clips, r.line_error_rate) for r in got] == [("en-US", 1, 2, 0.25, 2.0, 2, 0.2)]
    assert lanes.snr_summary(frame.where("clip_id = 'plain'")).count() == 0


def test_population_has_to_match(spark):
    left, right = (spark.createDataFrame(x, "k int, v string") for x in ([(1, "a"), (2, None)], [(1, "b"), (2, "c")]))
    assert tuple(judging.compared_in_full(left, right, ["k"], "v").first()) == (2, 0, 1, 0)
    with pytest.raises(Exception, match="only one"):
        judging.compared_in_full(left, right.where("k = 1"), ["k"], "v").collect()


def test_mean_agreement(spark):
    pairs = spark.createDataFrame([("a", "b", 0.5, 0.0), ("a", "c", 1.0, None)], "rater_a string, rater_b string, observed double, kappa double")
    assert tuple(ranking.mean_agreement(pairs).first()) == (2, 0.75, 0.0) and tuple(ranking.mean_agreement(pairs.limit(0)).first()) == (0, None, None)


def test_agreement_files(spark, tmp_path):
    said = "lane string, clip_id string, language string, text string, error string, seq int"
    rows = [("a", "1", "en", "x y", None, 1), ("b", "1", "en", "x z", None, 1), ("c", "3", "en", "alone", None, 1)]
    transcripts.write_agreement(transcripts.agreement(spark.createDataFrame(rows, said)), str(tmp_path / "out"))
    lines = sorted((json.loads(x) for f in glob(f"{tmp_path}/out/matrix/language=en/*.json") for x in open(f)), key=lambda x: x["lane"])
    assert lines == [{"lane": "a", "a": None, "b": 0.5, "c": None}, {"lane": "b", "a": 0.5, "b": None, "c": None}, {"lane": "c", "a": None, "b": None, "c": None}]
    assert sum(1 for f in glob(f"{tmp_path}/out/pairs/*.json") for _ in open(f)) == 4


def test_recordings_in_a_row_and_scores(spark):
    frame = spark.createDataFrame([(1, b"ab", b"cd"), (2, None, b"cd")], "id int, x binary, y binary")
    got = {r.id: r.p for r in frame.select("id", recordings.pair_audio("x", "y", 10, 0.2).alias("p")).collect()}
    assert bytes(got[1]) == b"ab\0\0\0\0cd" and got[2] is None
    assert [r.score for r in recordings.with_score(frame, "x", lambda b: float(len(b))).orderBy("id").collect()] == [2.0, None]


def test_kept_sentences(spark):
    rows = [("en", " one two three four ", 2), ("en", "one two three four", 1), ("en", "too short", 1), ("ja", "短い", 1), ("ja", "これは 十分に 長い文", 3), (None, "a b c d e", 1), ("en", None, 1)]
    got = transcripts.kept_sentences(spark.createDataFrame(rows, "language string, line string, at int"), "line", ["at"]).collect()
    assert sorted((str(r.language), r.line, r.at) for r in got) == [("None", "a b c d e", 1), ("en", "one two three four", 1), ("ja", "これは 十分に 長い文", 3)]
