import hashlib
import random
import re

from pyspark.sql import functions as F

from sonalyt.llm import decontamination

ITEMS = "item_id long, text string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def planted(rows, seed=3):
    """Items with whole, partial, cut and changed passages in some documents."""
    r = random.Random(seed)
    items = [(k, " ".join(f"w{r.randrange(60)}" for _ in range(n))) for k, n in enumerate((30, 10, 11, 9, 3, 1, 25, 14))]
    items += [(8, items[0][1]), (9, None), (10, ""), (11, "?!"), (None, items[6][1]), (1, "Another ROW of one item, that has é ü and more words in it"), (12, "a a a a a a a a a a a a")]
    docs = list(rows)
    for i, (_, text) in enumerate(items[:8]):
        w = text.split()
        docs.append((1000 + i, f"before {' - '.join(w).upper()}! after", "en", "s", 1))
        docs.append((1100 + i, f"{' '.join(w[2:])} tail {' '.join(w[:-1])}", "en", "s", 1))
        docs.append((1200 + i, " ".join(w[:5] + ["odd"] + w[5:]), "en", "s", 1))
    docs += [(1300, "a " * 40, "en", "s", 1), (1300, "another ROW of one item that has é ü and more words in it.", "en", "s", 1), (None, items[0][1], "en", "s", 1)]
    return docs, items


def brute(docs, items, window=10):
    out = []
    sought = [(i, w[q : q + min(window, len(w))]) for i, t in items for w in [words(t)] if w for q in range(len(w) - min(window, len(w)) + 1)]
    for row in docs:
        w, hit, found = words(row[1]), set(), set()
        said = "\x00" + "\x00".join(w) + "\x00"
        for i, x in sought:
            if "\x00" + "\x00".join(x) + "\x00" not in said:
                continue
            for p in range(len(w) - len(x) + 1):
                if w[p : p + len(x)] == x:
                    hit |= set(range(p, p + len(x)))
                    found |= {i} - {None}
        out.append((row[0], len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items, **how):
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").withColumn("hash", F.lit(1)).withColumn("window", F.lit("clash")).repartition(3)
    return sorted((tuple(r) for r in decontamination.report(decontamination.find(frame, spark.createDataFrame(items, ITEMS), **how)).drop("mark").collect()), key=str)


def test_against_brute_force(spark, rows):
    docs, items = planted(rows)
    want = brute(docs, items)
    assert run(spark, docs, items) == want and sum(x[-1] for x in want) > 10
    assert run(spark, docs, items, gram=1) == want and run(spark, docs, items, window=4, gram=3) == brute(docs, items, 4)


def test_share_of_shingles(spark):
    item = " ".join(f"i{k}" for k in range(10))
    near = item.replace("i9", "other")  # 5 of 6 shingles of five words
    docs = [(1, near), (2, item), (3, item.replace("i4", "other")), (4, f"{near} {item[:20]}")]
    frame, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], ITEMS)
    assert sorted(tuple(r) for r in decontamination.passages(frame, items, share=0.8).collect()) == [(1, 7, 0, 10), (2, 7, 0, 10), (4, 7, 0, 10)]
    assert sorted(r.doc_id for r in decontamination.decontaminated(frame, items, share=0.8).collect()) == [3]


def test_nothing(spark, docs, nothing):
    none = spark.createDataFrame([], ITEMS)
    assert decontamination.report(decontamination.find(nothing, spark.createDataFrame([(1, "a b")], ITEMS))).count() == 0
    assert decontamination.report(decontamination.find(docs, none)).where("contaminated or n_items > 0").count() == 0
    assert decontamination.decontaminated(docs, none).columns == docs.columns
