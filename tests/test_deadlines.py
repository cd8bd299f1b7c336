"""Sessions with deadlines: both ways to end, late rows, state that is let go."""

from datetime import datetime, timedelta

import pytest

from sonalyt.streaming import deadlines

T0 = datetime(2024, 1, 1)


def frame(session, seq, at, kind, text=None, clip=10.0, speech=4.0):
    return (session, seq, T0 + timedelta(seconds=at), kind, text, T0, clip, speech)


ROWS = [
    frame(1, 1, 1, "interim", "a"), frame(1, 2, 2, "interim", "ab"), frame(1, 3, 3, "eou"), frame(1, 4, 4, "interim", "x"), frame(1, 5, 6, "eou"), frame(1, 6, 7, "eou"), frame(1, 7, 16, "final", "x"),  # past 10 + 5: doesn't count
    frame(2, 1, 1, "interim", "a"), frame(2, 2, 2, "audio_end"), frame(2, 3, 6, "final", "a"), frame(2, 4, 8, "final", "late"), frame(2, 5, 5, "eou"),  # the audio ends, so 2 + 5; the last one is out of order and counts
    frame(3, 1, 40, "interim", "never"),  # nothing before its deadline
    frame(4, 1, 1, "eou", None, 10.0, None), (5, 1, T0, "eou", None, None, 3.0, 1.0), (None, 1, T0, "eou", None, T0, 3.0, 1.0),
]
WANT = {1: ("clip", 15.0, 6, 2, 1, 0, 1, 2.0), 2: ("audio", 7.0, 3, 0, 0, 1, 0, 1.0), 4: ("clip", 15.0, 1, 0, 0, 0, 0, None)}


@pytest.mark.parametrize("cuts", [1, 3])
def test_ends_and_state(spark, cuts):
    far = [frame(9, 1_000_000, 1_000_000, "interim", "z")]  # only moves the watermark on
    rows = [r[:1] + (k,) + r[2:] for k, r in enumerate(ROWS + far)]
    frames = spark.createDataFrame(rows, deadlines.IN).withColumn("extra", deadlines.F.lit("clash"))
    got, left = deadlines.replayed(frames, 5.0, cuts=cuts, late="1 minute")
    assert {r.session: tuple(r)[1:] for r in got.collect()} == WANT and left == 0


def test_nothing(spark):
    assert deadlines.replayed(spark.createDataFrame([], deadlines.IN), 5.0, cuts=1)[0].count() == 0


def test_halves_of_a_millisecond_against_sql(spark, tmp_path):
    """A session four times five days after the first one, whose end lies half a millisecond after a whole one; two copies of each event under other ids."""
    import duckdb

    from sonalyt.plans import deadlines as plan

    at = [(0, 4 * 432000 + 54243.0, 212, "error"), (1, 4 * 432000 + 54243.8035, 212, "signup"), (2, 29 * 86400.0, 1, "view")]
    rows = [(k + copy * 100, T0 + timedelta(microseconds=round(s * 1e6)), user, kind, 3.0 + copy) for k, s, user, kind in at for copy in (0, 1)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(plan.SQL).fetchall()
    assert [tuple(r) for r in plan.session_deadlines(spark, str(tmp_path)).collect()] == want == [(1700, "audio", 75843.804, 2, 0, 0, 2, 0, None)]


def test_late_end_of_audio_against_sql(spark, tmp_path):
    """The end of the audio arrives two hours late, after a row that is past the clip's own deadline and in time by that end."""
    import duckdb

    from sonalyt.plans import deadlines as plan

    day, hour = 86400.0, 3600.0
    at = [(1, day, 1, "view"), (17, 2 * day + 5.5 * hour, 1, "signup"), (18, 2 * day + 6.5 * hour, 1, "error"), (34, 2 * day + 5 * hour, 1, "click"), (3, 29 * day, 2, "view")]
    rows = [(k, T0 + timedelta(seconds=s), user, kind, float(k % 5)) for k, s, user, kind in at]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(plan.SQL).fetchall()
    for query in (plan.session_deadlines, plan.session_deadlines_in_five):
        assert [tuple(r) for r in query(spark, str(tmp_path)).collect()] == want == [(8, "audio", 214200.0, 3, 1, 0, 1, 0, None)]


def plainly(rows, grace):
    """The sessions' rows in order of arrival, once all are known."""
    out = {}
    for session in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == session), key=lambda r: r[1])
        s = [((r[2] - T0).total_seconds(), r[3], r[4]) for r in own]
        ends = [t for t, kind, _ in s if kind == "audio_end" and t <= own[0][6] + grace]
        end = (ends[0] if ends else own[0][6]) + grace
        said = [(t, kind, text) for t, kind, text in s if kind != "audio_end" and t <= end]
        shown = [text for _, kind, text in said if kind == "interim" and text]
        eou = [t for t, kind, _ in said if kind == "eou"]
        after = [t - own[0][7] for t in eou if t >= own[0][7]]
        if said or ends:
            pairs = list(zip(shown, shown[1:], strict=False))
            out[session] = ("audio" if ends else "clip", end, len(said), len(pairs), sum(not b.startswith(a) for a, b in pairs), sum(k == "final" for _, k, _ in said), len(eou) - len(after), after[0] if after else None)
    return out


@pytest.mark.parametrize("cuts", [1, 4])
def test_any_order_of_arrival(spark, cuts):
    """Rows up to 50 seconds late, with a grace of 5: ends of audio come after rows that they let in or leave out."""
    import random

    of = random.Random(7)
    rows = []
    for session in range(80):
        clip = of.choice([4.0, 10.0, 20.0])
        for _ in range(of.randrange(1, 12)):
            at = of.randrange(0, 4 * int(clip + 10)) / 4
            kind = of.choices(["interim", "eou", "final", "audio_end", "other"], [6, 3, 2, 2, 1])[0]
            rows.append((at + of.random() * 50, frame(session, 0, at, kind, of.choice(["a", "ab", "abc", "x", "", None]), clip, 4.0)))
    rows = [r[:1] + (k,) + r[2:] for k, (_, r) in enumerate(sorted(rows, key=lambda x: x[0]))]
    got, left = deadlines.replayed(spark.createDataFrame([*rows, frame(999, len(rows), 1_000_000, "interim", "z")], deadlines.IN), 5.0, cuts=cuts, late="1 minute")
    assert {r.session: tuple(r)[1:] for r in got.collect()} == plainly(rows, 5.0) and left == 0
