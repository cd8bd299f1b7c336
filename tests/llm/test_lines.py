import random

from sonalyt.llm import lines

from .conftest import SCHEMA, sentence


def brute(rows):
    """Every later document with each first holder of its lines, aligned on whole texts."""

    def worth(text):
        return [x.strip() if len(x.split()) >= lines.WORDS and x.strip().count(" ") >= lines.WORDS - 1 else None for x in (text or "").split("\n")]

    held = {}
    for d, text in sorted((r[:2] for r in rows if r[0] is not None), key=lambda r: r[0]):
        for x in worth(text):
            if x:
                held.setdefault(x, d)
    texts = {r[0]: worth(r[1]) for r in rows}
    gone = {}
    for d, own in texts.items():
        for first in {held[x] for x in own if x and d is not None} - {d}:
            there = texts[first]
            shared = {x for x in own if x and held[x] == first}
            pairs = lines.align([([i for i, y in enumerate(there) if y == x], [i for i, y in enumerate(own) if y == x]) for x in shared])
            assert all(there[a] == own[b] for a, b in pairs) and len({b for _, b in pairs}) == len(pairs)
            gone.setdefault(d, set()).update(b for _, b in pairs)
    return gone


def test_aligned_lines(docs, rows):
    got = {r.doc_id: set(r.gone) for r in lines.aligned_lines(docs).collect()}
    assert got == {d: g for d, g in brute(rows).items() if g} and got


def test_patience_order_and_repeats():
    assert sorted(lines.align([([0], [2]), ([1], [0]), ([2], [1])])) == [(1, 0), (2, 1)]  # the moved line stays
    assert sorted(lines.align([([0], [0]), ([1, 3], [1, 3]), ([2], [2])])) == [(0, 0), (1, 1), (2, 2), (3, 3)]
    assert lines.align([]) == []


def test_later_copy_goes_and_first_stays(spark):
    r = random.Random(1)
    a, b = "\n".join(sentence(r, 8) for _ in range(5)), sentence(r, 8)
    df = spark.createDataFrame([(1, a, "en", "s", 0), (2, a, "en", "s", 0), (3, f"{b}\n{a}", "en", "s", 0), (4, b, "en", "s", 0), (5, None, "en", "s", None), (None, a, "en", "s", 0), (6, "a\nb", "en", "s", 3)], SCHEMA)
    kept = {r.doc_id: (r.text, r.n_chars) for r in lines.remove_lines(df).collect()}
    assert kept == {1: (a, 0), 3: (b, len(b)), 5: (None, None), None: (a, 0), 6: ("a\nb", 3)}


def test_many_holders_pair_with_the_first_only(spark):
    r = random.Random(2)
    line = sentence(r, 8)
    df = spark.createDataFrame([(i, f"{sentence(r, 9)}\n{line}", "en", "s", 0) for i in range(400)], SCHEMA)
    assert {r.doc_id: r.gone for r in lines.aligned_lines(df).collect()} == {i: [1] for i in range(1, 400)}


def every_pair(rows):
    """Every later document with every earlier one, aligned on all the lines that they share."""
    own = {d: text.split("\n") for d, text in rows}
    gone = {}
    for d, e in ((d, e) for d in own for e in own if e < d):
        shared = set(own[d]) & set(own[e])
        gone.setdefault(d, set()).update(y for _, y in lines.align([([i for i, y in enumerate(own[e]) if y == x], [i for i, y in enumerate(own[d]) if y == x]) for x in shared]))
    return gone


def test_lines_in_another_order_than_the_first_holders_meet_each_other(spark):
    r = random.Random(3)
    a, b, c = (sentence(r, 8) for _ in range(3))
    texts = {12: [a, b], 32: [b, a], 40: [b, a], 199: [b, a], 200: [c], 201: [sentence(r, 8), b, a]}
    df = spark.createDataFrame([(d, "\n".join(x), "en", "s", 0) for d, x in texts.items()], SCHEMA)
    got = {x.doc_id: x.gone for x in lines.aligned_lines(df).collect()}
    assert len(got.pop(32)) == 1 and got == {40: [0, 1], 199: [0, 1], 201: [1, 2]}


def test_no_line_stays_that_any_pair_aligns(spark):
    r = random.Random(4)
    some = [sentence(r, 8) for _ in range(7)]
    rows = [(d, "\n".join(r.choice((*some, *some, sentence(r, 8))) for _ in range(r.randrange(1, 9)))) for d in range(90)]
    got = {x.doc_id: set(x.gone) for x in lines.aligned_lines(spark.createDataFrame([(*x, "en", "s", 0) for x in rows], SCHEMA)).collect()}
    first, every = brute(rows), every_pair(rows)
    assert got == {d: g for d, _ in rows if (g := first.get(d, set()) | every.get(d, set()))}
    assert any(every[d] - first.get(d, set()) for d in every)


def test_short_lines_go_with_their_block(spark):
    r = random.Random(5)
    a, b, c = (sentence(r, 8) for _ in range(3))
    texts = {
        1: ["Yes.", a, "", "Ment que.", b, "End."], 2: ["Yes.", a, "", "Ment que.", b, "End."], 3: [c, b, "End.", "Yes."], 4: ["No.", "Ment que."], 5: ["No.", "Ment que."], 6: ["No.", "Ment que.", "No."],
        7: ["one\ttwo\tthree\tfour", "eins\u00a0zwei\u00a0drei\u00a0vier", "これは長い日本語の文です", "https://example.org/a/b/c"],
    }
    texts[8] = [sentence(r, 7), *texts[7]]
    df = spark.createDataFrame([(d, "\n".join(x), "en", "s", 0) for d, x in texts.items()], SCHEMA)
    assert {x.doc_id: x.gone for x in lines.aligned_lines(df).collect()} == {2: [0, 1, 2, 3, 4, 5], 3: [1, 2], 5: [0, 1], 8: [1, 2, 3, 4]}
    assert sorted(x.doc_id for x in lines.remove_lines(df).collect()) == [1, 3, 4, 6, 7, 8]


def test_copies_leave_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    first = {}
    for d, text in sorted((x.doc_id, x.text) for x in docs.select("doc_id", "text").collect() if x.text and x.text.strip()):
        first.setdefault(text, []).append(d)
    copies = {d for ids in first.values() for d in ids[1:]}
    assert copies and not copies & {x.doc_id for x in lines.remove_lines(docs).select("doc_id").collect()}


def test_empty(nothing):
    assert lines.remove_lines(nothing).count() == 0 and lines.aligned_lines(nothing).count() == 0


def test_repeated_lines_in_full():
    """Many repeated lines align in full, whatever their number."""
    once, often = "one line of five words", "another line of five words"
    first, second = [once] * 500 + [often] * 2, [often] * 2 + [once] * 500
    places = [([k for k, x in enumerate(first) if x == line], [k for k, x in enumerate(second) if x == line]) for line in (once, often)]
    assert len(lines.align(places)) == 500
    assert len(lines.align([(list(range(3000)), list(range(3000)))])) == 3000


def test_repeated_lines_against_a_table():
    r = random.Random(6)
    for _ in range(300):
        v = r.choice((1, 2, 4))
        a, b = ([r.randrange(v) for _ in range(r.randrange(2, 25))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                best[i][j] = best[i - 1][j - 1] + 1 if x == y else max(best[i - 1][j], best[i][j - 1])
        found = lines._repeated([([k for k, x in enumerate(a) if x == t], [k for k, x in enumerate(b) if x == t]) for t in range(v) if t in a and t in b] or [([], [])])
        assert len(found) == best[-1][-1] and all(a[x] == b[y] for x, y in found) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:], strict=False))
