import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from sonalyt.llm import search


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, top):
    found = [(d, Counter(terms(t))) for d, t in docs]
    found = [(d, c) for d, c in found if c]
    n, size = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    sought = defaultdict(set)
    for i, t in items:
        if i is not None:
            sought[i] |= set(terms(t))
    out = []
    for i, ts in sought.items():
        scores = []
        for d, c in found:
            m = 50 + 50 * sum(c.values()) * n // size
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in ts if t in c)
            if s > 0 and d is not None:
                scores.append((-s, d))
        out += [(i, k, d, -s) for k, (s, d) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out)


def made(rows, seed=2):
    r = random.Random(seed)
    common = [f"w{k}" for k in range(40)]
    docs = [(d, t) for d, t, *_ in rows]
    docs += [(2000 + i, " ".join(r.choice(common) if r.random() < 0.8 else f"r{r.randrange(300)}" for _ in range(r.randrange(1, 60)))) for i in range(900)]
    docs += [(9000 - i, "w1 W2 r3 r4, r5") for i in range(200)]  # copies, ties
    items = [(i, " ".join(r.choice(common) if r.random() < 0.5 else f"r{r.randrange(300)}" for _ in range(r.randrange(1, 30)))) for i in range(30)]
    items += [(40, None), (41, ""), (42, "nowhere"), (43, "w1"), (43, "r3 r4 r5"), (None, "w1"), (44, "é 日本 ü"), (45, "w1 w1 w1")]
    return docs, items


def run(spark, docs, items, **how):
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("norm", F.lit("clash")).repartition(3)
    return sorted(tuple(r) for r in search.search(frame, spark.createDataFrame(items, "item_id long, text string"), **how).collect())


def test_against_brute_force(spark, rows, monkeypatch):
    docs, items = made(rows)
    assert run(spark, docs, items) == brute(docs, items, 50)
    monkeypatch.setattr(search, "SEEDS", 60)  # most documents then come after the thresholds
    assert run(spark, docs, items, top=5) == brute(docs, items, 5)
    assert run(spark, docs, items, top=3, block=150) == brute(docs, items, 3)


def test_nothing(spark, nothing, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "the an")], "item_id long, text string")
    assert search.search(nothing, some).count() == 0 and search.search(docs, none).count() == 0
    assert run(spark, [(1, "a"), (2, "a")], [(1, "b"), (2, None)]) == []


def test_words_of_one_hash():
    import numpy as np
    import pyarrow as pa

    from sonalyt.llm.wordbytes import words

    known = search.Vocabulary(["ab", "cd", "long word"[:4]])
    _, w = next(words(pa.array(["cd ab xx long", None, "ab"]), search.SEPARATORS))
    assert [a.tolist() for a in known.numbers(w)] == [[0, 1, 3, 4], [1, 0, 2, 0]]
    w.hash = np.full_like(w.hash, known.hash[0])  # as if all hashes clashed
    assert [a.tolist() for a in known.numbers(w)] == [[0, 1, 3, 4], [1, 0, 2, 0]]
