import math
import re

import numpy as np
import pytest

from sonalyt.llm import mixing


def brute(rows, labelled, targets, vocabulary):
    """The classifier and the fit with plain loops; labelled: doc_id -> domain."""
    domains = list(targets)
    tokens = {}
    for r in rows:
        tokens.setdefault(r[0], []).extend(w for w in re.split(r"[\x20\x09-\x0D]+", (r[1] or "").lower()) if w)
    counts, have = {}, dict.fromkeys(domains, 0)
    for d, k in labelled.items():
        if d in tokens:
            for w in tokens[d]:
                counts.setdefault(w, dict.fromkeys(domains, 0))[k] += 1
        have[k] += 1
    known = sorted(counts, key=lambda w: (-sum(counts[w].values()), w))[:vocabulary]
    total = {k: sum(counts[w][k] for w in known) for k in domains}
    logs = {w: [math.log((counts[w][k] + 0.5) / (total[k] + 0.5 * len(known) + 0.5)) for k in domains] for w in known}
    prior = [math.log((have[k] + 1) / (sum(have.values()) + len(domains))) for k in domains]
    ids = list(tokens)
    p = []
    for d in ids:
        hit = [logs[w] for w in tokens[d] if w in logs]
        x = np.array(prior) + (np.sum(hit, axis=0) if hit else 0) * mixing.EVIDENCE / max(len(hit), mixing.EVIDENCE)
        e = np.exp(x - x.max())
        p.append(e / e.sum())
    p, n = np.array(p), np.array([len(tokens[d]) for d in ids], float)
    rate = np.ones(len(ids))
    aims = np.array([t / sum(targets.values()) for t in targets.values()]) * n.sum()
    start = n @ p
    for _ in range(mixing.STEPS):
        gap = aims - (n * rate) @ p
        if np.abs(gap).max() <= mixing.CLOSE * n.sum():
            break
        rate = np.maximum(0, rate + p @ (gap / start))
    return {d: (len(tokens[d]), p[i], rate[i]) for i, d in enumerate(ids)}


@pytest.fixture(scope="module")
def labelled(rows):
    return {r[0]: r[2] for r in rows if r[0] is not None and r[0] % 2 and r[2] in ("en", "fr", "de")}


TARGETS = {"en": 0.2, "fr": 0.5, "de": 0.3}


def test_rates_against_plain_loops(spark, docs, rows, labelled):
    marks = spark.createDataFrame(list(labelled.items()), "doc_id long, domain string")
    got = {r.doc_id: r for r in mixing.mix(docs, marks, TARGETS, vocabulary=60).collect()}
    want = brute(rows, labelled, TARGETS, 60)
    assert set(got) == set(want)
    for d, (n, p, rate) in want.items():
        assert got[d].n_tokens == n and np.allclose(got[d].p, p, atol=1e-9) and abs(got[d].rate - rate) < 1e-6
        assert got[d].copies in (math.floor(got[d].rate + 1e-9), math.floor(got[d].rate + 1e-9) + 1)


def test_totals_meet_targets(spark):
    words = {"en": "the of and", "fr": "le de et", "de": "der und zu"}
    rows = [(i, " ".join([words[k]] * (1 + i % 7)), k) for i, k in enumerate(["en"] * 60 + ["fr"] * 30 + ["de"] * 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    mixed = mixing.mix(docs, docs.selectExpr("doc_id", "lang as domain"), TARGETS).collect()
    total = sum(np.array(r.p) * r.n_tokens * r.rate for r in mixed)
    assert np.allclose(total / total.sum(), list(TARGETS.values()), atol=1e-4) and min(r.rate for r in mixed) >= 0
    again = mixing.mix(docs, docs.selectExpr("doc_id", "lang as domain"), TARGETS, keep_all=True).collect()
    assert min(r.copies for r in again) >= 1
    out = mixing.remix(docs, docs.selectExpr("doc_id", "lang as domain"), TARGETS, keep_all=True)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in again) and out.select("doc_id").distinct().count() == 100


def test_impossible_targets_stay_nonnegative(spark):
    docs = spark.createDataFrame([(i, "the of and", "en") for i in range(10)], "doc_id long, text string, lang string")
    mixed = mixing.mix(docs, docs.selectExpr("doc_id", "lang as domain"), {"en": 0.0, "fr": 1.0}).collect()
    assert all(r.rate >= 0 and math.isfinite(r.rate) for r in mixed)
    with pytest.raises(ValueError):
        mixing.mix(docs, docs.selectExpr("doc_id", "lang as domain"), {"en": 0.0})


def test_no_python_in_the_plan(docs, spark):
    plan = mixing.words_of(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_empty_and_unlabelled(spark, nothing, docs):
    none = spark.createDataFrame([], "doc_id long, domain string")
    assert mixing.mix(nothing, none, TARGETS).count() == 0
    assert all(np.allclose(r.p, 1 / 3) for r in mixing.mix(docs, none, TARGETS).collect())


def test_a_domain_out_of_reach_takes_no_document_away(spark):
    words = {"en": "the of and", "fr": "le de et", "de": "der und zu"}
    rows = [(i, " ".join([words[k]] * (1 + i % 7)), k) for i, k in enumerate(["en"] * 60 + ["fr"] * 30 + ["de"] * 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    more = TARGETS | {"es": 0.4}
    got = mixing.mix(docs, docs.selectExpr("doc_id", "lang as domain"), more, keep_all=True).collect()
    total = sum(np.array(r.p) * r.n_tokens * r.rate for r in got)
    assert len(got) == 100 and min(r.copies for r in got) >= 1 and np.allclose(total[:3] / total[:3].sum(), list(TARGETS.values()), atol=1e-2)
