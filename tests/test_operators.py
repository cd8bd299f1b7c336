import json
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonalyt.functions import text as X
from sonalyt.operators import lanes, ranking, sessions
from sonalyt.plans import queries
from sonalyt.sources import runs as R

SF = "/root/testdata/sf0.001"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_token_distance_and_edits_agree_with_a_plain_table(spark):
    r = random.Random(0)
    rows = [([r.choice(["a", "bb", "é", "日本", "𝄞", "z z"]) for _ in range(r.randrange(9))], [r.choice(["a", "bb", "é", "日本", "𝄞", "q"]) for _ in range(r.randrange(9))]) for _ in range(200)]
    rows.append(([f"w{i}" for i in range(600)], [f"w{i + 1}" for i in range(600)]))
    df = spark.createDataFrame(rows, "r array<string>, h array<string>")
    got = df.select("r", "h", X.token_distance(F.col("r"), F.col("h")).alias("d"), X.edits("r", "h").alias("e")).collect()
    for x in got:
        assert x.d == distance(x.r, x.h) == x.e.substitutions + x.e.deletions + x.e.insertions
        assert x.e.reference_length == len(x.r) and len(x.h) - len(x.r) == x.e.insertions - x.e.deletions


def test_word_error_rate_sums_match(spark):
    for r in queries.word_error_rate(spark, SF).collect():
        assert r.distance == r.substitutions + r.deletions + r.insertions and r.error_rate == pytest.approx(r.distance / r.reference_length, abs=1e-6)


def test_normalize(spark):
    df = spark.createDataFrame([("  Ｆｕｌｌ－Width, “quotes”… costs $4 €5!\n",), (None,)], "t string")
    assert [r[0] for r in df.select(X.normalize(F.col("t"))).collect()] == ["fullwidth quotes costs $4 €5", None]
    langs = spark.createDataFrame([("ja-JP",), ("ZH_cn",), ("en-US",)], "l string")
    assert [r[0] for r in langs.select(X.by_character(F.col("l"))).collect()] == [True, True, False]


def test_error_rate_of_empty_references(spark):
    df = spark.createDataFrame([(0, 0), (2, 0), (1, 4)], "e int, n int")
    assert [r[0] for r in df.select(X.error_rate(F.col("e"), F.col("n"))).collect()] == [0.0, float("inf"), 0.25]


def test_readers(spark, tmp_path):
    first = {"provider": "a", "clip_id": "1", "mode": "stream", "text": "x", "language": "en", "total_s": 2.0, "audio_s": 4.0, "partials": [{"t_s": 0.1, "text": "x", "is_final": True}, {"t_s": 0.0, "text": "", "is_final": False, "kind": "eou"}]}
    (tmp_path / "a.jsonl").write_text(json.dumps(first) + "\n\n" + json.dumps({"provider": "a", "clip_id": "2", "mode": "stream", "error": "bad"}) + "\n")
    (tmp_path / "b.jsonl").write_text(json.dumps({"provider": "a", "clip_id": "3", "mode": "stream"}) + "\n")
    got = {r.clip_id: r for r in R.read_stt(spark, str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl")).collect()}
    assert got["1"].rtf == 0.5 and [p.kind for p in got["1"].partials] == ["segment_final", "eou"] and got["2"].audio_s == 0.0 and got["2"].rtf is None and not got["2"].ok and got["3"].partials == []
    assert [r.clip_id for r in lanes.supersede(R.read_stt(spark, str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl"))).collect()] == ["3"]
    (tmp_path / "t.jsonl").write_text(json.dumps({"provider": "t", "prompt_id": "p", "mode": "batch", "audio_s": 1.0, "roundtrip_text": "hi", "roundtrip_provider": "j"}) + "\n")
    t = R.read_tts(spark, str(tmp_path / "t.jsonl")).first()
    assert t.ok and t.load == 1 and t.roundtrip[0].text == "hi" and R.kind_of(spark, str(tmp_path / "t.jsonl")) == "tts" and R.kind_of(spark, str(tmp_path / "a.jsonl")) == "stt"
    (tmp_path / "bad.jsonl").write_text("{not json\n")
    with pytest.raises(Exception):
        R.read_stt(spark, str(tmp_path / "bad.jsonl")).collect()


def test_lines_of_a_lane_are_replaced_alone(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "provider string, n int")
    R.write_lines(df, str(tmp_path / "out"), "provider")
    R.write_lines(spark.createDataFrame([("b", 3)], "provider string, n int"), str(tmp_path / "out"), "provider")
    assert sorted((r.provider, r.n) for r in spark.read.json(str(tmp_path / "out")).collect()) == [("a", 1), ("b", 3)]


def test_churn_and_counts_over_arrays(spark):
    p = lambda t, f=False, k="interim": {"t_s": 0.0, "text": t, "is_final": f, "kind": k}
    rows = [([p("a"), p("ab"), p("x"), p("", False), p("xyz", True, "segment_final")], "", 2.0), ([p("a")], "ref", 0.0), ([], "", 1.0)]
    df = spark.createDataFrame(rows, f"partials {R.PARTIAL}, reference string, audio_s double")
    got = df.select(sessions.churn(F.col("partials")).alias("c"), sessions.interim_rate(F.col("partials"), F.col("audio_s")).alias("i"), sessions.phantom_finals(F.col("partials"), F.col("reference")).alias("f")).collect()
    assert [tuple(r) for r in got] == [(0.5, 2.0, 1), (None, None, 0), (None, None, 0)]


def test_intervals_against_loops(spark):
    r = random.Random(3)
    pauses = [("s", i, a := r.randrange(1000) / 2, a + r.randrange(0, 300) / 2) for i in range(60)]
    points = [("s", r.randrange(1400) / 2) for _ in range(80)]
    hit = sessions.pauses_hit(spark.createDataFrame(pauses, "s string, pause_id int, start_s double, end_s double"), spark.createDataFrame(points, "s string, t_s double"), "s").collect()
    assert {(h.pause_id, h.hits) for h in hit} == {(i, sum(a <= t < b for _, t in points)) for _, i, a, b in pauses}
    first = sessions.first_after(spark.createDataFrame([(s, i, a) for s, i, a, _ in pauses], "s string, start_id long, start_s double"), spark.createDataFrame(points, "s string, t_s double"), "s").collect()
    assert {(f.start_id, f.first_s) for f in first} == {(i, min((t for _, t in points if t >= a), default=None)) for _, i, a, _ in pauses}
    merged = sessions.islands(spark.createDataFrame(pauses, "s string, i int, a double, b double"), "s", "a", "b")
    covered = {x for _, _, a, b in pauses for x in range(int(2 * a), int(2 * b))}
    assert sum(2 * (m.end_s - m.start_s) for m in merged.collect()) == len(covered)
    bounds = spark.createDataFrame([("s", 100.0, 600.0), ("t", 0.0, 5.0)], "s string, from_s double, to_s double")
    gaps = sessions.complement(merged, bounds, "s").collect()
    assert sum(2 * (g.end_s - g.start_s) for g in gaps if g.s == "s") == len(set(range(200, 1200)) - covered) and [(g.start_s, g.end_s) for g in gaps if g.s == "t"] == [(0.0, 5.0)]


def test_average_rank_and_pareto(spark):
    rows = [("a", 1.0, 5.0), ("b", 1.0, 5.0), ("c", 2.0, 1.0), ("d", None, 3.0), ("e", None, 9.0), ("f", 3.0, 1.0)]
    df = spark.createDataFrame(rows, "s string, x double, y double").withColumn("g", F.lit(1))
    assert {r.s: r["rank"] for r in ranking.average_rank(df, ["g"], "x").collect()} == {"a": 1.5, "b": 1.5, "c": 3.0, "f": 4.0, "d": 5.5, "e": 5.5}
    assert {r.s for r in ranking.pareto(df, "x", "y").collect()} == {"a", "b", "c"}


def test_majority_breaks_ties_by_severity(spark):
    df = spark.createDataFrame([(1, "harmless"), (1, "entity"), (2, "meaning"), (2, "harmless"), (2, "harmless")], "i int, label string")
    assert {r.i: (r.majority, r.unanimous) for r in ranking.majority(df, ["i"], "label", queries.SEVERITY).collect()} == {1: ("entity", False), 2: ("harmless", False)}


def test_kappa_of_degenerate_marginals(spark):
    for rows, want in (([("x", "x")] * 3, 1.0), ([("x", "y")] * 3, 0.0), ([("x", "x"), ("y", "y")], 1.0)):
        assert ranking.kappa(spark.createDataFrame(rows, "a string, b string"), "a", "b").first()["kappa"] == want


def test_bradley_terry(spark):
    r = random.Random(0)
    true = {"a": 4.0, "b": 2.0, "c": 1.0}
    rows = []
    for i in range(900):
        x, y = r.sample(sorted(true), 2)
        rows.append(("q", f"p{i % 60}", x, y, x if r.random() < true[x] / (true[x] + true[y]) else y))
    df = spark.createDataFrame(rows, "aspect string, prompt_id string, first string, second string, winner string")
    got = {r.system: r for r in ranking.bradley_terry(df, replicates=60).collect()}
    assert got["a"].strength / got["c"].strength == pytest.approx(4, rel=0.4) and all(g.low <= g.strength <= g.high for g in got.values())
    assert np.exp(np.mean([np.log(g.strength) for g in got.values()])) == pytest.approx(1)
    pairs = {(p.better, p.worse) for p in ranking.separated(ranking.bradley_terry(df, replicates=60)).collect()}
    assert pairs == {(x, y) for x, y in combinations(sorted(got), 2) if got[x].low > got[y].high}


def test_streamed_fold_equals_the_batch(spark):
    events = queries.table(spark, SF, "events")
    want = events.groupBy("user_id").agg(F.count("*").alias("n"), F.sum((F.col("event_type") == "purchase").cast("int")).alias("f"), F.round(F.sum("value"), 4).alias("v")).collect()
    got = {r.user_id: r for r in queries.streamed_sessions(spark, SF).collect()}
    assert {w.user_id: (w.n, w.f) for w in want} == {k: (g.events, g.finals) for k, g in got.items()} and all(abs(got[w.user_id].total_value - w.v) < 1e-3 for w in want)


def test_library_does_not_import_the_training_data_operators():
    import pathlib
    import re

    root = pathlib.Path(R.__file__).parents[1]
    assert not [p for p in root.rglob("*.py") if root / "llm" not in p.parents and re.search(r"import .*\bllm\b|from .*\bllm\b", p.read_text())]


SPOKEN = {
    "en": {
        "Hello, World!": "hello world", "I can't won't don't": "i cannot will not do not", "ＨＥＬＬＯ": "hello", "Room 101.": "room 101", "four hundred and twenty": "420", "twenty five dollars": "25 dollars", "$25": "25 dollars", "1,234": "1234",
        "one thousand two hundred thirty four": "1234", "one million two hundred thousand": "1200000", "February third": "february 3", "February 3rd": "february 3", "nine one seven three": "9173", "nineteen eighty four": "19 84",
        "cats and dogs": "cats and dogs", "hundred": "hundred", "one thousand and": "1000 and", "five and twenty": "5 20", "the fiftieth, I'd": "the 50 i would", "twenty-one": "twentyone", "zero": "0", "": "",
    },
    "de": {"vierhundertzwanzig Euro": "420 euro", "420 €": "420 euro", "einundzwanzig": "21", "achtung elfmeter": "achtung elfmeter", "To-do-Liste": "to do liste", "E-Mail ge-emailt": "email geemailt", "zweitausendsechsundzwanzig": "2026", "hundert": "100", "schwarz und weiß": "schwarz und weiß"},
    "fr": {"quatre-vingt-dix-sept": "97", "soixante et onze": "71", "cent vingt": "120", "mille neuf cent": "1900", "20 €": "20 euros", "vingt euros": "20 euros", "chats et chiens": "chats et chiens", "quatre-vingts": "80"},
    "es": {"ciento veintiuno": "121", "treinta y cinco": "35", "mil quinientos": "1500", "$25": "25 dólares", "veinticinco dólares": "25 dólares", "blanco y negro": "blanco y negro", "un e-mail": "1 email", "dos millones": "2000000"},
    "ko": {"삼월": "3월", "이십삼 명": "23명", "세 시": "3시", "30 분": "30분", "사이": "사이", "유월": "6월", "이천이십육년": "2026년", "스물네 시간": "24시간"},
    "ja": {"こんにちは、世界。": "こんにちは世界", "今日 は いい": "今日はいい", "ｱｲｳ": "アイウ", "ABC": "ABC"},
    "nl": {"Één, twee!": "één twee"},
}


def test_normal_forms_by_language(spark):
    from sonalyt.functions import languages

    rows = [(f"{k.upper()}-XX", said, want) for k, cases in SPOKEN.items() for said, want in cases.items()] + [(None, "Ab, c", "ab c"), ("en", None, None)]
    got = spark.createDataFrame(rows, "language string, said string, want string").select("*", languages.normalize(F.col("said"), F.col("language")).alias("got")).collect()
    assert [(r.said, r.got) for r in got] == [(r.said, r.want) for r in got]
    tokens = spark.createDataFrame([("ja-JP", "コーヒー です"), ("en", "a  b"), ("zh", "你 好"), ("en", "")], "l string, t string").select(languages.tokens(F.col("t"), F.col("l")).alias("x")).collect()
    assert [r.x for r in tokens] == [list("こーひーです"), ["a", "b"], ["你", "好"], []]


def test_numbers_below_a_hundred_come_back():
    from sonalyt.functions import languages

    for k in languages.RULES:
        assert [languages.NORMALIZERS[k](languages.spell(n, k)) for n in range(100)] == [str(n) for n in range(100)], k


def test_loops_against_a_scan(spark):
    r = random.Random(4)

    def scan(w):
        for n in range(1, 6):
            for s in range(len(w)):
                k = 1
                while w[s + k * n : s + (k + 1) * n] == w[s : s + n]:
                    k += 1
                if k >= 3 and k * n >= 6:
                    return True
        return False

    from sonalyt.functions import tags

    rows = [([r.choice("ab" if i % 2 else "abcd") for _ in range(r.randrange(16))],) for i in range(300)]
    got = spark.createDataFrame(rows, "w array<string>").select("w", tags.loops(F.col("w")).alias("l")).collect()
    assert all(x.l == scan(x.w) for x in got) and {x.l for x in got} == {True, False}


def test_tags_and_prefixes(spark):
    from sonalyt.functions import labels, tags

    df = spark.createDataFrame([("a <date>1 May</date> <b>x</b> <date>2</date>", "snr+05-c1", "tel8k-c2")], "t string, c string, d string")
    r = df.select(tags.tagged(F.col("t"), "date"), tags.strip_tags(F.col("t"), ["date"]), tags.snr_level(F.col("c")), labels.telephony(F.col("d")), labels.condition(F.col("c")), tags.snr_level(F.col("d")), tags.pieces(F.lit(" a  b ")), tags.same_text(F.lit(" a  b"), F.lit("a b "))).first()
    assert tuple(r) == (["1 May", "2"], "a 1 May <b>x</b> 2", 5, True, None, None, ["a  ", "b "], True)


def test_speech_bounds(spark):
    from sonalyt.functions import pcm

    rate = 16_000
    tone = (np.sin(np.arange(rate // 2) / 5) * 20000).astype("<i2")
    quiet = np.zeros(rate // 4, "<i2")
    signal = np.concatenate([quiet, tone, quiet, tone, quiet]).tobytes()
    df = spark.createDataFrame([(signal,), (b"",), (None,), (quiet.tobytes() + b"x",)], "b binary").select(pcm.speech_bounds(rate)("b").alias("s")).select("s.*")
    a, b, c, d = df.collect()
    assert (round(a.onset_s, 2), round(a.speech_end_s, 2), a.pauses) == (0.24, 1.5, 1) and abs(a.longest_pause_s - 0.24) < 0.03 and a.duration_s == 1.75
    assert (b.duration_s, b.onset_s, b.pauses) == (0.0, None, 0) and c.duration_s is None and (d.onset_s, d.speech_end_s) == (None, 0.25)
    x, noise = np.frombuffer(signal, "<i2") / 32768.0, np.random.default_rng(0).normal(size=8000)
    for level in (20, 0):
        mixed = pcm.mix(x * 0.2, noise, level, rate) - x * 0.2
        assert abs(10 * np.log10(((x[rate // 4 : 3 * rate // 4] * 0.2) ** 2).mean() / (mixed**2).mean()) - level) < 1.5


def test_gate_and_permutations(spark):
    assert ranking.permutation_p([1, 2, 3, 4], [1, 2, 3, 4]) == pytest.approx(1 / 24)
    df = spark.createDataFrame([("a", 1.0, 1.0), ("b", 2.0, 2.0), ("c", 3.0, 3.0), ("d", 4.0, 4.0)], "s string, x double, y double")
    g = ranking.gate(df, "s", "x", "y").first()
    assert (g.systems, g.verdict) == (4, "pass") and g.rho == pytest.approx(1)
    assert ranking.gate(df.limit(2), "s", "x", "y").first().verdict == "pending"
    assert ranking.gate(df.withColumn("x", F.lit(1.0)), "s", "x", "y").first().verdict == "uncomputable"


def test_alignment_costs_and_spans():
    from sonalyt.functions import align

    r = random.Random(6)
    for _ in range(300):
        a, b = [r.choice("abcd") for _ in range(r.randrange(10))], [r.choice("abcd") for _ in range(r.randrange(10))]
        way = align.steps(a, b)
        assert sum(k != "equal" for k, _, _ in way) == distance(a, b)
        assert [i for k, i, _ in way if k != "insert"] == list(range(len(a))) and [j for k, _, j in way if k != "delete"] == list(range(len(b)))
        at = (0, 0)
        for kind, i, i2, j, j2 in align.spans(a, b):
            assert (i, j) == at and (kind != "equal" or a[i:i2] == b[j:j2])
            at = (i2, j2)
        assert at == (len(a), len(b))
    assert align.marked(list("abc"), [("x", 0, 2), ("x", 2, 3)], list("azbc")) == [("x", 2, 1, 0, 0, 1, 3)]
    assert align.marked(list("ab"), [("x", 0, 1)], list("zab")) == [("x", 1, 1, 0, 0, 0, 1)]


def test_segments_are_merged_and_split(spark):
    df = spark.createDataFrame([("s", 0.0, 1.0), ("s", 5.0, 10.0), ("s", 50.0, 51.0), ("s", 90.0, 121.0), ("t", 0.0, 0.5), ("u", 0.0, 95.0), ("v", 0.0, 61.0)], "k string, start_s double, end_s double")
    merged = sessions.merge_short(df, "k")
    assert sorted(map(tuple, merged.collect())) == [("s", 0.0, 10.0), ("s", 90.0, 121.0), ("u", 0.0, 95.0), ("v", 0.0, 61.0)]
    assert sorted(map(tuple, sessions.split_long(merged).collect())) == [("s", 0.0, 10.0), ("s", 90.0, 120.0), ("u", 0.0, 30.0), ("u", 30.0, 60.0), ("u", 60.0, 90.0), ("u", 90.0, 95.0), ("v", 0.0, 30.0), ("v", 30.0, 60.0)]


def test_judging(spark):
    from sonalyt.operators import judging

    rows = spark.createDataFrame([("a", "x", 1, 10), ("a", "y", 5, 10), ("b", "x", 0, 0)], "provider string, judge string, edits int, reference_length int")
    families = spark.createDataFrame([("a", "f"), ("x", "f")], "key string, family string")
    got = {r.provider: (r.judges, r.pooled_rate, r.diverges) for r in judging.cross_family_rate(rows, families).collect()}
    assert got == {"a": (2, 0.5, True), "b": (1, None, False)}
    alerts = judging.mean_score_alerts(spark.createDataFrame([("a", 3.0), ("b", 3.0)], "provider string, score double"), spark.createDataFrame([("a", 3.5)], "provider string, mean double")).collect()
    assert {r.provider: r.alert for r in alerts} == {"a": True, "b": False}


def fails(df):
    from pyspark.errors import PySparkException

    with pytest.raises((PySparkException, ValueError)):
        df().collect()


def test_readers_refuse_what_they_must(spark, tmp_path):
    from sonalyt.sources import corpus as C

    def lines(name, *rows):
        (tmp_path / name).write_text("\n".join(rows) + "\n")
        return str(tmp_path / name)

    spark.createDataFrame([(1, "a")], "id long, utt string").write.parquet(str(tmp_path / "c.parquet"))
    assert C.read_corpus(spark, str(tmp_path / "c.parquet"), {"clip_id": "id"}, "fr-FR").first() == (1, "fr-FR")
    fails(lambda: C.read_corpus(spark, str(tmp_path / "c.parquet"), {"clip_id": "name"}))
    fails(lambda: C.read_manifest(spark, lines("m", '{"id": "x"}'), "/b"))
    fails(lambda: C.read_votes(spark, lines("v", '{"rater": "r", "winner": "third"}')))
    fails(lambda: C.read_realdata(spark, lines("r", '{"clip": "a.wav", "duration_s": 10.0, "measured_s": 10.3}')))
    fails(lambda: C.read_anchor(spark, lines("a.csv", "clip_id,label", "c,entity"), ("entity",)))
    fails(lambda: C.read_anchor(spark, lines("b.csv", "clip_id,provider,label", "c,p,entity", "c,p,entity"), ("entity",)))
    fails(lambda: C.read_anchor(spark, lines("d.csv", "clip_id,provider,label", "c,p,odd"), ("entity",)))
    fails(lambda: C.read_arena(spark, lines("s", '{"systems": ["x", "x"], "model": "m", "pairs": [{"prompt_id": "1"}]}'), ["x"]))
    fails(lambda: C.read_arena_prompts(spark, [("/a/p.txt", 1), ("/b/p.txt", 1)], 1))
    assert C.manifest_shape(spark, lines("k", "", '{"clip": "c", "session_id": "s", "duration_s": 1, "more": 2}')) == "realdata"
    fails(lambda: C.manifest_shape(spark, lines("o", '{"x": 1}')))
    got = C.read_arena_prompts(spark, [(lines("one.txt", "a", "", " b "), None), (lines("two.txt", "c", "d", "e"), 2)], 1).collect()
    assert [(r.prompt_id, r.text) for r in got][:2] == [("one-000", "a"), ("one-002", "b")] and len(got) == 4
    (tmp_path / "n" / "m").mkdir(parents=True)
    for f in ("b.wav", "m/a.flac", "c.txt"):
        (tmp_path / "n" / f).write_bytes(b"1")
    assert [r.path[-6:] for r in C.audio_files(spark, str(tmp_path / "n")).collect()] == ["/b.wav", "a.flac"]


def test_records_refuse_what_they_must(spark):
    from sonalyt.functions import labels
    from sonalyt.operators import records, transcripts

    one = spark.range(1)
    fails(lambda: one.select(labels.family(F.lit("llama"))))
    fails(lambda: one.select(labels.label(F.lit("nothing"))))
    fails(lambda: records.within_cap(spark.createDataFrame([(3.0,), (4.0,)], "usd double"), 5.0))
    clips = "clip_path string, session_id string, language string, duration double, source string, start_offset string"
    fails(lambda: records.clip_candidates(spark.createDataFrame([("c", "s", "en", 3.0, "tape", None)], clips)))
    fails(lambda: records.clip_candidates(spark.createDataFrame([("c", None, "en", 3.0, "user", None)], clips)))
    assert records.clip_candidates(spark.createDataFrame([("c", "s", "en", 3.0, None, "x"), ("c", "s", "de", 3.0, "tape", None)], clips)).collect() == [("c", "s", "en", 3.0, "merged", 0.0)]
    said = "lane string, clip_id string, language string, text string, error string, seq long"
    fails(lambda: transcripts.agreement(spark.createDataFrame([("a", "c", "en", "x", None, 1), ("b", "c", "ja", "x", None, 1)], said)))
    got = transcripts.agreement(spark.createDataFrame([("a", "c", None, "x y", None, 1), ("b", "c", None, "x z", None, 1), ("d", "e", "en", "x", None, 1)], said)).collect()
    assert sorted((r.lane_a, r.lane_b, r.language, r.disagreement) for r in got if r.clips) == [("a", "b", "all", 0.5), ("a", "b", "und", 0.5)] and len(got) == 4


def test_no_machine_local_folder_on_a_cluster():
    from types import SimpleNamespace as N

    from sonalyt.sources.folders import shared_folder

    far = N(conf=N(get=lambda *_: None), sparkContext=N(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        shared_folder(far)


def test_percentiles_without_a_group_in_one_buffer(spark):
    from sonalyt.operators.quantiles import percentiles

    r = random.Random(7)
    rows = [(g, r.choice((r.uniform(0, 9), float(r.randrange(4))))) for g in "aab" for _ in range(997)] + [("c", 5.0), ("d", None), ("b", None)]
    got = percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"p50": 0.5, "p99": 0.99, "p0": 0.0, "p100": 1.0}, 16).collect()
    for x in got:
        own = [v for g, v in rows if g == x.g and v is not None]
        assert np.allclose([x.p50, x.p99, x.p0, x.p100], np.percentile(own, [50, 99, 0, 100]))
    assert sorted(x.g for x in got) == ["a", "b", "c"]


def test_kappa_interval_by_resampling(spark):
    r = random.Random(5)
    pairs = [(a, a if r.random() < 0.7 else r.choice("xyz")) for a in (r.choice("xyz") for _ in range(150))]
    got = ranking.kappa_interval(spark.createDataFrame(pairs, "a string, b string"), "a", "b").first()

    def kappa(p):
        n = len(p)
        chance = sum(sum(x == c for x, _ in p) * sum(y == c for _, y in p) for c in "xyz") / n**2
        return (sum(x == y for x, y in p) / n - chance) / (1 - chance)

    draws = [kappa([r.choice(pairs) for _ in pairs]) for _ in range(1000)]
    assert got.n == 150 and abs(got.kappa - kappa(pairs)) < 1e-9 and abs(got.low - np.percentile(draws, 2.5)) < 0.03 and abs(got.high - np.percentile(draws, 97.5)) < 0.03


def test_entities_by_rule():
    from sonalyt.functions import entities as E

    cases = {
        ("en", "pay $42 or five dollars, now"): "pay <currency>$42</currency> or <currency>five dollars</currency>, now", ("en", "we may go in may 3"): "we may go in <date>may 3</date>", ("en", "He met Ann Lee today"): "He met <name>Ann Lee</name> today",
        ("en", "ref 12ab, 12345678"): "ref <id>12ab</id>, <id>12345678</id>", ("en", "in 1999 on 1/2/03"): "in <date>1999</date> on <date>1/2/03</date>", ("en", "nine one seven three"): "<number>nine one seven three</number>", ("en", ""): "",
        ("de", "am 3 mai für zwanzig euro, ein Haus"): "am <date>3 mai</date> für <currency>zwanzig euro</currency>, ein Haus", ("fr", "le mars bleu, deux cafés"): "le mars bleu, <number>deux</number> cafés", ("ko", "삼월 사이 세 시"): "<date>삼월</date> 사이 <number>세 시</number>",
    }
    for (language, text), want in cases.items():
        assert E.tag(text, language) == want
    assert E.tag_slots("[date : next week] call [song_name : Blue] and [person : ann] two", "en") == "<date>next week</date> call <name>Blue</name> and <name>ann</name> <number>two</number>"
    assert E.best([(0, 5, "number"), (3, 9, "id"), (9, 9, "date"), (10, 12, "name"), (10, 12, "number")]) == [(3, 9, "id"), (10, 12, "number")]
