import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonalyt.llm import manifest
from sonalyt.llm.manifest import leaf, missing


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        at = levels[-1]
        levels.append([h(*at[k : k + 2]) for k in range(0, len(at), 2)])
    return levels


def way(levels, at):
    """For each level below the root the sibling and whether it is on the left; None where the run has no other."""
    out = []
    for level in levels[:-1]:
        s = at ^ 1
        out.append((level[s] if s < len(level) else None, s < at))
        at >>= 1
    return out


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf_of(*r), r))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: tree([g[2] for g in sorted(groups[x], key=lambda g: g[:3])]) for x in names}
    top = tree([trees[x][-1][0] for x in names])
    out = []
    for g, x in enumerate(names):
        for i, (_, _, own, r) in enumerate(sorted(groups[x], key=lambda g: g[:3])):
            steps = way(trees[x], i) + way(top, g)
            now = leaf_of(*r[:4], r[4] + 1) if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else own
            for s, left in steps:
                now = h(now) if s is None else h(s, now) if left else h(now, s)
            out.append((r[0], own, trees[x][-1][0], top[-1][0], h(*[s for s, _ in steps if s]), now, now == top[-1][0]))
    return sorted(out, key=str)


def run(docs):
    other = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.when(F.col("n_chars").isNotNull(), leaf(n_chars=F.col("n_chars") + 1)))
    return sorted((tuple(r) for r in manifest.proofs(manifest.manifest(docs, other=other), siblings=False).drop("siblings").collect()), key=str)


def test_against_brute_force(docs, rows):
    want = brute([(r[0], r[1], r[2], r[3], r[4]) for r in rows])
    assert run(docs) == want and 0 < sum(not x[-1] for x in want) < len(want) / 2


def test_several_leaf_partitions(spark):
    r = random.Random(5)
    rows = [(i * 3, f"text {i}", "en" if r.random() < 0.9 else None, "s", i) for i in range(14_000)]
    r.shuffle(rows)
    assert run(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)) == brute(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13])
def test_missing_is_least(n):
    levels = tree([str(i) for i in range(n)])
    for mask in range(1, 1 << min(n, 8)):
        held = np.array([i for i in range(n) if mask >> i & 1])
        asked = missing(held, n)
        known = {(0, int(i)) for i in held} | set(asked)
        for level in range(len(levels) - 1):
            for x in {int(i) >> level for i in held}:
                assert x ^ 1 >= len(levels[level]) or (level, x ^ 1) in known
                known.add((level + 1, x >> 1))
        assert len(set(asked)) == len(asked) and not any((x << level) <= i < ((x + 1) << level) for level, x in asked for i in held)


def test_edges(spark, nothing):
    assert run(nothing) == [] and manifest.manifest(nothing).root() is None
    one = [(1, "a", None, None, None)]
    frame = spark.createDataFrame(one, "doc_id long, text string, lang string, source string, n_chars long")
    own = leaf_of(*one[0])
    assert run(frame) == [(1, own, own, own, h(), own, True)] and manifest.manifest(frame).root() == own
    proof = manifest.proofs(manifest.manifest(frame.union(frame), other=F.lit(None).cast("binary"))).collect()
    assert [p.siblings for p in proof] == [[own], [own]] and {p.root for p in proof} == {h(own, own)}
