import hashlib
import re

import pytest

from sonalyt.llm import substrings


def brute(rows, window=13):
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = {}
    for d, w in words:
        for i in range(len(w) - window + 1) if d is not None else ():
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1) if d is not None else ():
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((str(d), len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [1000, 3, 1])
def test_against_all_windows(docs, rows, hot):
    got = substrings.remove_repeats(docs, digest=True, hot=hot).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute([r[:2] for r in rows])


def test_text_is_what_the_digest_says(docs):
    a = {(r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in substrings.remove_repeats(docs).collect()}
    assert a == {(r.doc_id, r.kept_sha256) for r in substrings.remove_repeats(docs, digest=True).collect()}


@pytest.mark.parametrize("window,gram", [(4, 4), (5, 2), (13, 1)])
def test_other_windows(docs, rows, window, gram):
    got = substrings.remove_repeats(docs, digest=True, window=window, gram=gram).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute([r[:2] for r in rows], window)


def test_automaton_matching_statistics():
    import random

    r = random.Random(5)
    for _ in range(200):
        known = [[r.choice("abc") for _ in range(r.randrange(1, 12))] for _ in range(3)]
        a = substrings.Automaton()
        for k in known:
            a.add(k)
        query = [r.choice("abc") for _ in range(15)]
        covered = set()
        for i in range(len(query)):
            for j in range(i + 3, len(query) + 1):
                if any(query[i:j] == k[s : s + j - i] for k in known for s in range(len(k))):
                    covered |= set(range(i, j))
        assert {x for s, e in a.matches(query, 3) for x in range(s, e)} == covered


def test_empty(nothing):
    assert substrings.remove_repeats(nothing).count() == 0
