"""Choices in turn against the sequential rule, and the bootstrap over prompts."""

import random
from collections import Counter, defaultdict
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonalyt.operators import ranking, records

SCHEMA = "id long, session string, lang string, size string, tier int"


def sequential(rows, count, cap, quotas, seed):
    """The rule itself, one row after the other over all rows."""
    d = lambda r: (md5(":".join([str(seed), *([r[1]] if r[1] is not None else []), str(r[0])]).encode()).hexdigest(), r[0])
    sessions, langs, out = Counter(), Counter(), []
    for tier in sorted({r[4] for r in rows}):
        waiting = defaultdict(list)
        for r in sorted((r for r in rows if r[4] == tier), key=d):
            waiting[r[2] or "", r[3]].append(r)
        moved = True
        while moved and len(out) < count:
            moved = False
            for key in sorted(waiting):
                if len(out) == count or (quotas is not None and langs[key[0]] >= quotas.get(key[0], 0)):
                    continue
                while waiting[key]:
                    r = waiting[key].pop(0)
                    if sessions[r[1]] < cap:
                        out.append(r[0])
                        sessions[r[1]] += 1
                        langs[key[0]] += 1
                        moved = True
                        break
    return out


@pytest.mark.parametrize("count, cap, quotas", [(40, 2, None), (40, 1, {"en": 9, "fr": 30}), (0, 1, None), (500, 3, {"de": 50})])
def test_quota_take(spark, count, cap, quotas):
    r = random.Random(count + cap)
    # one session holds a third of all rows
    rows = [(i, "hot" if r.random() < 0.35 else None if r.random() < 0.05 else f"s{r.randrange(40)}", r.choice(("en", "fr", "de")), r.choice("abc"), r.choice((0, 1))) for i in range(600)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("turn", F.lit("clash")).repartition(5)
    got = ranking.quota_take(frame, count, ["lang", "size"], "id", "session", 7, cap, "lang", quotas, "tier").orderBy("place").collect()
    assert [x.id for x in got] == sequential(rows, count, cap, quotas, 7) and [x.place for x in got] == list(range(1, len(got) + 1))


def test_quota_take_refuses(spark):
    frame = spark.createDataFrame([(1, "s", "en", "a", 0)], SCHEMA)
    for how in ({"count": -1}, {"count": 1, "cap": 0}, {"count": 1, "quota": "tier", "quotas": {}}):
        with pytest.raises(ValueError):
            ranking.quota_take(frame, strata=["lang"], key="id", session="session", seed=1, **how)
    assert ranking.quota_take(frame.limit(0), 5, ["lang"], "id", "session", 1).count() == 0


def test_pilot_rows(spark):
    rows = [("s1", "/d/set/s1/0007.wav", "en", 3.0, "video", 2), ("s2", "/else/0007.flac", "ja", 4.0, "mp3", 1)]
    got = records.pilot_rows(spark.createDataFrame(rows, "session_id string, clip_path string, language string, duration double, source string, place int"), "/d/set/").collect()
    assert [(r.id, r.clip) for r in got] == [("s2-0007", "/else/0007.flac"), ("s1-0007", "s1/0007.wav")]


def test_draws_add_up_and_are_fair():
    sizes = np.array([5, 0, 300, 7, 1])
    total = int(sizes.sum())
    counts = np.hstack([ranking.draws(total, sizes, b, 400, 3) for b in range(len(sizes))])
    assert (counts.sum(axis=1) == total).all() and (counts == np.hstack([ranking.draws(total, sizes, b, 400, 3) for b in range(len(sizes))])).all()
    assert abs(counts.mean() - 1) < 1e-9 and abs(counts.var() - (1 - 1 / total)) < 0.05  # of a multinomial draw
    assert abs(np.corrcoef(counts[:, :5].sum(axis=1), counts[:, 5:305].sum(axis=1))[0, 1]) > 0.3  # ranges share what there is


def test_bradley_terry_intervals(spark, monkeypatch):
    monkeypatch.setattr(ranking, "CLUSTER", 16)
    r = random.Random(4)
    rows = [(f"p{i % 60}", a, b, r.choice((a, a, b, "tie", None))) for i in range(900) for a, b in [r.sample(("x", "y", "z"), 2)]]
    got = {x.system: x for x in ranking.bradley_terry(spark.createDataFrame(rows, "prompt_id string, first string, second string, winner string"), replicates=300).collect()}
    systems = sorted(got)

    def matrix(chosen):
        m = np.zeros((3, 3))
        for _, a, b, w in chosen:
            if w:
                c = 1.0 if w == a else 0.5 if w == "tie" else 0.0
                m[systems.index(a), systems.index(b)] += c
                m[systems.index(b), systems.index(a)] += 1 - c
        return m

    by_prompt = defaultdict(list)
    for x in rows:
        by_prompt[x[0]].append(x)
    plain = [ranking.strengths(matrix([x for p in r.choices(sorted(by_prompt), k=60) for x in by_prompt[p]])) for _ in range(300)]
    low, high = np.percentile(plain, [2.5, 97.5], axis=0)
    best = ranking.strengths(matrix(rows))
    for k, s in enumerate(systems):
        assert abs(got[s].strength - best[k]) < 1e-6 and abs(got[s].low - low[k]) < 0.06 and abs(got[s].high - high[k]) < 0.06
        assert got[s].games == sum(s in (a, b) and w is not None for _, a, b, w in rows)
