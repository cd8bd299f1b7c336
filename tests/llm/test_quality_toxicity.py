import pickle
import random
import zlib
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from sonalyt.llm import quality, toxicity

from .conftest import sentence


def labelled(spark, n=900, seed=2):
    r = random.Random(seed)
    rows, labels = [], []
    bad_words = ("zugglewump", "blorfnik", "snarvle")
    for i in range(n):
        low, toxic = r.random() < 0.3, r.random() < 0.3
        text = " ".join(sentence(r, r.randrange(5, 20)) for _ in range(r.randrange(2, 8)))
        if low:
            text = " ".join([r.choice(text.split())] * 40) if r.random() < 0.5 else text.upper().replace(" ", "!! ")
        if toxic:
            w = r.choice(bad_words)
            w = r.choice((w, w, w, w[:3] + "x" + w[3:], "-".join(w), w + "s"))
            parts = text.split()
            parts.insert(r.randrange(len(parts)), w)
            text = " ".join(parts)
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, int(not low), int(toxic)))
    rows += [(n, None, None, None, None), (n + 1, "", None, None, 0), (None, "the", "en", "s", 3), (1, rows[1][1], "en", "s", 1)]
    labels += [(n, None, None), (None, 1, 1), (1, *labels[1][1:])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def accuracy(got, labels, column):
    want = {x[0]: x[column] for x in labels if x[0] is not None}
    pairs = [(r.predicted, want[r.doc_id]) for r in got if r.held_out and want.get(r.doc_id) is not None]
    return np.mean([a == b for a, b in pairs]), len(pairs)


def test_held_out_accuracy_and_contract(spark):
    docs, labels, told = labelled(spark)
    got = quality.quality(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    share, n = accuracy(got, told, 1)
    assert n > 100 and share > 0.97
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    share, n = accuracy(got, told, 2)
    assert n > 100 and share > 0.95


def test_held_out_labels_are_not_learned_from(spark):
    docs, labels, _ = labelled(spark, 300)
    turned = labels.withColumn("quality", F.when(quality.held_out(5, 0), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({(r.doc_id, r.score) for r in quality.quality(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_without_labels_or_rows(spark, nothing, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.quality(nothing, none).count() == 0 and toxicity.toxicity(nothing, none).count() == 0
    for f in (quality.quality, toxicity.toxicity):
        assert {r.score for r in f(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(i * 3 + 1, 1, 1) for i in range(20)], "doc_id long, quality int, toxic int")
    for f in (quality.quality, toxicity.toxicity):
        assert all(r.score > 0.5 for r in f(docs, one).collect())


def test_keep_good_keeps_rows_as_they_are(spark):
    docs, labels, _ = labelled(spark, 300)
    kept = quality.keep_good(docs, labels)
    good = {r.doc_id for r in quality.quality(docs, labels).where("predicted = 1").collect()}
    assert kept.columns == docs.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(r.doc_id) for r in docs.collect() if r.doc_id in good)


def test_additive_score_is_the_sum_of_its_tables():
    r = np.random.default_rng(0)
    x = r.normal(size=(500, 4))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (r.random(500) < 0.02)).astype(float)
    m = quality.train(x, y)
    assert (0, 1) in [tuple(sorted(p)) for p in m.pairs]
    assert ((m.score(x) > 0.5) == y).mean() > 0.9
    row = x[7]
    total = m.base + sum(t[np.searchsorted(e, v, side="right")] for e, t, v in zip(m.edges, m.tables, row, strict=True))
    total += sum(t[np.searchsorted(m.pair_edges[i], row[i], side="right"), np.searchsorted(m.pair_edges[j], row[j], side="right")] for (i, j), t in zip(m.pairs, m.pair_tables, strict=True))
    assert np.isclose(m.score(x[7:8])[0], 1 / (1 + np.exp(-total)))


def test_quality_by_plain_loops(spark):
    docs, labels, told = labelled(spark, 400)
    texts_, marks = {r.doc_id: r.text or "" for r in docs.collect()}, {d: q for d, q, _ in told if d is not None and q is not None}
    learned = sorted(d for d in marks if d in texts_ and zlib.crc32(str(d).encode()) % 5)
    model = quality.train(quality.features([texts_[d] for d in learned]), np.array([marks[d] for d in learned], float))
    want = dict(zip(texts_, model.score(quality.features(list(texts_.values()))), strict=True))
    assert all(abs(r.score - want[r.doc_id]) < 1e-9 for r in quality.quality(docs, labels).collect())


def test_toxicity_by_plain_loops(spark):
    docs, labels, told = labelled(spark, 400)
    machines = toxicity.learn(docs, labels, "toxic", quality.held_out(3, 1))
    got = {r.doc_id: r.x for r in toxicity.values(docs, machines).collect()}
    for r in docs.collect():
        own = sorted({u for u, _ in toxicity.units(r.text or "")})
        top = sorted(machines[-1].values(own).tolist() if own else [], reverse=True)[: toxicity.TOP]
        assert np.allclose(got[r.doc_id], [*top, *[toxicity.FLOOR] * (toxicity.TOP - len(top)), np.log1p(len(set((r.text or "").lower().split())))], atol=1e-5)
    known = sorted({d for d, _, t in told if d is not None and t is not None and zlib.crc32(str(d).encode()) % 3 != 1})
    fold = {r.doc_id: r.f for r in docs.select("doc_id", toxicity.fold().alias("f")).collect()}
    by = {t: {r.doc_id: r.x for r in toxicity.values(docs, {-1: m}).collect()} for t, m in machines.items() if t >= 0}
    y = {d: t for d, _, t in told}
    weights = toxicity.calibrate(np.array([by.get(fold[d], got)[d] for d in known]), np.array([y[d] for d in known], float))
    for r in toxicity.toxicity(docs, labels).collect():
        assert abs(r.score - 1 / (1 + np.exp(-(np.dot(got[r.doc_id], weights[:-1]) + weights[-1])))) < 1e-6


def brute_kernel(s, t):
    """The mean over sizes of normalised sums of gap-weighted subsequences, the norm over summed features."""

    def explicit(word, size):
        letters, out = ["begin", *word, "stop"], {}
        for places in combinations(range(len(letters)), size):
            if places[-1] - places[0] < toxicity.SPAN:
                key = tuple(letters[i] for i in places)
                out[key] = out.get(key, 0) + toxicity.DECAY ** (places[-1] - places[0] + 1)
        return out, sum(v * v for v in out.values()) ** 0.5

    total = 0.0
    for size in toxicity.SIZES:
        (a, n), (b, m) = explicit(s, size), explicit(t, size)
        total += sum(v * b.get(k, 0) for k, v in a.items()) / (n * m) / len(toxicity.SIZES)
    return total


def test_kernel_is_that_of_gapped_subsequences():
    words = ["idiot", "idxiot", "banana", "abc", "thequickbrownfox", "achlichlich", "ababab"]
    got = toxicity.Maps(words).kernel(words)
    assert np.allclose(got, [[brute_kernel(w, m) for m in words] for w in words], atol=1e-4) and np.allclose(np.diag(got), 1, atol=1e-4)


def test_folded_machine_equals_its_landmarks():
    bad, good = ["zuggle", "zugglex", "blorf"], ["thing", "other", "stone", "plain"]
    m = toxicity._fit(bad, good, {}, landmarks=7)
    assert m.values(bad).min() > m.values(good).max()
    w = ["zuggly", "stoner"]
    assert np.allclose(m.values(w), pickle.loads(pickle.dumps(m)).values(w))


def test_clean_stems_of_insults_stay_clean_in_each_language(spark):
    r = random.Random(8)
    stems = {"en": ("idiot", "moron", "scum"), "de": ("achlich", "keitung"), "fr": ("reeuxan", "quement")}
    ends = ("er", "te", "ung", "sch", "pf")
    insults = {x: [s + e for s in w for e in ends] if x != "en" else list(w) for x, w in stems.items()}
    rows, labels, plain = [], [], {x: [w + e for w in ("ver", "lich", "ment", "tion", "aux") for e in ("ge", "be", "on", x)] for x in stems}
    for i in range(1500):
        lang, toxic = r.choice(list(stems)), r.random() < 0.25
        words = [r.choice(plain[lang]) for _ in range(r.randrange(10, 60))]
        if lang != "en" and r.random() < 0.5:
            words.insert(r.randrange(len(words)), r.choice(stems[lang]))
        for _ in range(r.randrange(2, 5) if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice(insults[lang]))
        rows.append((i, " ".join(words) + ".", lang, "s", 0))
        labels.append((i, 1, int(toxic)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = [x for x in toxicity.toxicity(docs, known).collect() if x.held_out]
    for lang in stems:
        own = [x for x in got if rows[x.doc_id][2] == lang]
        assert np.mean([x.predicted for x in own if labels[x.doc_id][2]]) >= 0.95 and np.mean([x.predicted for x in own if not labels[x.doc_id][2]]) <= 0.01


def test_calibration_never_lowers_a_score_by_an_insult():
    r = np.random.default_rng(1)
    x = np.hstack([np.sort(r.uniform(-1, 1.5, (400, toxicity.TOP)), axis=1)[:, ::-1], r.uniform(0, 9, (400, 1))])
    y = (x[:, 0] - x[:, 1] + r.normal(0, 0.3, 400) > 0.5).astype(float)
    assert toxicity.calibrate(x, y)[: toxicity.TOP].min() >= 0


def test_spaced_letters_are_one_unit():
    for text in ("you i d i o t there", "you i-d-i-o-t!", "i.d.i.o.t"):
        assert "idiot" in {u for u, _ in toxicity.units(text)}
