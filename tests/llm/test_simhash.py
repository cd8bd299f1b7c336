import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from sonalyt.llm import simhash

from .conftest import SCHEMA, sentence


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps):
    """doc_id -> smallest reachable, by all pairs; fps: (doc_id, fp)."""
    label = list(range(len(fps)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, j in combinations(range(len(fps)), 2):
        if (fps[i][1] ^ fps[j][1]).bit_count() <= 4:
            label[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(fps):
        if doc is not None:
            low[find(i)] = min(low.get(find(i), doc), doc)
    return [low.get(find(i)) for i in range(len(fps))]


def test_fingerprints_and_components(docs, rows):
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    fps = [(r[0], brute(r[1])) for r in rows]
    assert got == sorted((str(d), f"{f:016x}", c) for (d, f), c in zip(fps, groups(fps), strict=True))


def test_long_document_counts_every_shingle():
    text = " ".join(f"w{i % 977}" for i in range(70_000))
    assert simhash.fingerprint(text) == brute(text)


def test_clusters_of_near_fingerprints_lose_no_link(spark):
    r = np.random.default_rng(3)
    centre = int(r.integers(0, 1 << 63))
    fps = {int(x) for x in r.integers(0, 1 << 63, 300)} | {centre ^ sum(1 << int(b) for b in r.choice(18, r.integers(0, 7), replace=False)) for _ in range(700)}
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(sorted(fps))]
    df = spark.createDataFrame(rows, "rep long, fp long")
    for hot in (8192, 40):  # the second deals keys out again as pairs of blocks
        roots = {r.node: r.root for r in simhash.components(simhash.links(df, 4, hot)).collect()}
        assert [roots.get(i, i) for i, _ in rows] == groups([(i, f & (1 << 64) - 1) for i, f in rows])


def test_keep_one_keeps_every_group(docs, rows):
    kept = [r.doc_id for r in simhash.keep_one(docs).collect()]
    comps = jaccard_components([r[:2] for r in rows if r[0] is not None])
    assert sorted(x for x in kept if x is not None) == sorted(set(comps.values()))
    assert kept.count(None) == 2


def test_empty(nothing):
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.keep_one(nothing).count() == 0


def test_runs_over_cut_batches():
    import pyarrow as pa

    from sonalyt.llm.common import runs

    r = np.random.default_rng(0)
    for over in (False, True):
        for size in (1, 3, 7, 50):
            key = np.sort(r.integers(0, 12, 120))
            key[20:75] = key[20]
            key = np.sort(key)
            batches = [pa.RecordBatch.from_pydict({"k": key[i : i + size], "v": np.arange(len(key))[i : i + size]}) for i in range(0, len(key), size)]
            seen, parts = [], []

            def fn(starts, cols):
                seen.extend((int(cols["k"][s]), e - s, int(cols["v"][s])) for s, e in zip(starts, [*starts[1:], len(cols["k"])]))

            def to_over(cols):
                parts.append(cols)
                return cols

            list(runs(["k"], ["v"], fn, to_over if over else None, most=16)(iter(batches)))
            far = np.concatenate([p["v"] for p in parts]) if parts else np.zeros(0, int)
            assert set(key[far]).isdisjoint(k for k, _, _ in seen) and len(set(far)) == len(far)
            assert sorted(seen) == sorted((int(k), int((key == k).sum()), int(np.argmax(key == k))) for k in set(key) - set(key[far]))
            assert {k for k in set(key) if (key == k).sum() >= 16 + size} <= set(key[far]) or not over
            assert len(far) == sum((key == k).sum() for k in set(key[far]))


def jaccard_components(rows, least=0.8):
    """Every pair of rows by the sets of their five-word shingles."""
    sets = {}
    for d, text in rows:
        words = (text or "").encode().lower().split()
        sets[d] = {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    low = {d: d for d in sets}

    def root(d):
        while low[d] != d:
            d = low[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])):
                x, y = sorted((root(a), root(b)))
                low[y] = x
    return {d: root(d) for d in sets}


def changed(r, words, n):
    words = list(words)
    for i in r.sample(range(len(words)), n):
        words[i] = f"new{r.randrange(10**6)}"
    return " ".join(words)


def test_near_copies_by_brute_force(spark):
    r = random.Random(11)
    rows = [(i, sentence(r, r.randrange(1, 60))) for i in range(60)]
    for g in range(12):
        words = sentence(r, 150).split()
        rows += [(1000 + 20 * g + k, changed(r, words, k % 6)) for k in range(12)]
    rows += [(2000, None), (2001, ""), (2002, " \t"), (2003, "one two"), (2004, "One two"), (2005, "the " * 4000), (2006, "the " * 3000)]
    df = spark.createDataFrame([(*x, "en", "s", 0) for x in rows], SCHEMA)
    for hot in (simhash.HOT, 4):
        got = {x.doc_id: x.component_id for x in simhash.near_copies(df, hot=hot).collect()}
        assert got == jaccard_components(rows)


def test_a_large_group_of_near_copies_is_one(spark):
    r = random.Random(12)
    words = sentence(r, 200).split()
    rows = [(i, changed(r, words, 2)) for i in range(300)]
    df = spark.createDataFrame([(*x, "en", "s", 0) for x in rows], SCHEMA)
    assert {x.component_id for x in simhash.near_copies(df).collect()} == {0}
    assert [x.doc_id for x in simhash.keep_one(df).collect()] == [0]


def boilerplate(n, seed):
    """Texts of one boilerplate: unlike ones at about 0.7, twins of some above 0.8."""
    r = random.Random(seed)
    base, out = [f"b{k}" for k in range(100)], []
    while len(out) < n:
        if out and r.random() < 0.3:
            own = list(r.choice(out))
            own[-r.randrange(1, 4)] = f"t{r.randrange(10**9)}"
        else:
            own = base[:82] + [f"o{r.randrange(10**9)}" for _ in range(18)]
        out.append(own)
    return [" ".join(w) for w in out]


@pytest.mark.parametrize("n", [49, 300])
def test_crowded_keys_lose_no_link(spark, n):
    said = boilerplate(n, n)
    sets = [set(simhash.hashes(t, 5).tolist()) for t in said]
    links = [(a, b) for a in range(n) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    frame = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(frame, hot=64).collect()}
    want = simhash.lowest(n, *(np.array(x) for x in zip(*links, strict=True)))
    assert len(links) > n / 3 and got == dict(enumerate(want.tolist()))


def test_repeated_phrases_hide_no_link(spark):
    """Sets of shingles decide; what one text repeats very often doesn't make its fingerprint another's."""
    r = random.Random(21)
    rows = []
    for g in range(12):
        common = [f"c{g}x{k}" for k in range(100)]
        rows += [(10 * g + k, " ".join(common + [f"w{r.randrange(10**9)}"] * 1500)) for k in range(2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {x.doc_id: x.component_id for x in simhash.near_copies(frame).collect()}
    assert got == jaccard_components(rows) and len(set(got.values())) == 12


def similar(r, n, share, many):
    """Pairs of sets of n hashes with a Jaccard similarity of at least share."""
    both = int(np.ceil(2 * n * share / (1 + share) - 1e-9))
    all_ = [r.integers(0, 1 << 63, 2 * n - both, np.uint64) for _ in range(many)]
    return [np.unique(x[:n]) for x in all_], [np.unique(x[n - both :]) for x in all_]


def test_wide_fingerprints_are_majorities():
    r = np.random.default_rng(31)
    sets = [np.unique(r.integers(0, 1 << 63, n, np.uint64)) for n in (1, 2, 255, 0, 256, 70_000, 3)]
    for u, words in zip(sets, simhash.wide(sets), strict=True):
        mixed = (u ^ u >> np.uint64(29)) * simhash._odd(simhash.WORDS)
        mixed ^= mixed >> np.uint64(32)
        assert [simhash._majority(m) if len(u) else 0 for m in mixed] == words.tolist()


@pytest.mark.parametrize("n", [50, 200_000, 12_000_000])
def test_candidates_meet_on_the_pivots_table(n):
    r = np.random.default_rng(32)
    windows, many = simhash.table_of_windows(n, 0.8)
    for size, share, least in ((300, 0.8, 0.98), (300, 0.9, 0.999), (9, 0.8, 0.98)):
        x, y = (simhash.wide(s) for s in similar(r, size, share, 500))
        met = (simhash.coordinates(x, windows[:many]) == simhash.coordinates(y, windows[:many])).any(axis=0)
        assert met.mean() >= least
    five = [np.unique(r.integers(0, 1 << 63, 5, np.uint64)) for _ in range(500)]
    x, y = simhash.wide(five), simhash.wide([u[:4] for u in five])
    assert (simhash.coordinates(x, windows) == simhash.coordinates(y, windows)).any(axis=0).mean() >= 0.98
    unlike = (simhash.coordinates(x, windows[:many]) == simhash.coordinates(x[::-1].copy(), windows[:many])).mean()
    assert unlike < 3 * 2.0 ** -len(windows[0]) + 1e-3


def test_the_table_discards_no_near_pair():
    r = np.random.default_rng(33)
    x = r.integers(0, 1 << 63, (400, 2), np.uint64)
    x[200:] = x[:200] ^ (r.integers(0, 1 << 63, (200, 2), np.uint64) & r.integers(0, 1 << 63, (200, 2), np.uint64) & r.integers(0, 1 << 63, (200, 2), np.uint64))
    fp, told = simhash._short({"f0": x[:, 0].view(np.int64), "f1": x[:, 1].view(np.int64)})
    i, j = np.triu_indices(400, 1)
    far = np.bitwise_count(x[i] ^ x[j]).sum(axis=1)
    got = simhash._distance(fp, told, i, j, 39)
    assert (got[far <= 39] == far[far <= 39]).all() and (got[far > 39] > 39).all() and (far <= 39).sum() > 100


def test_spanning_forests_are_least():
    r = np.random.default_rng(41)
    for n, m in ((1, 0), (2, 1), (40, 60), (40, 400), (300, 200)):
        a, b = np.sort(r.integers(0, n, (2, m)), axis=0) if n > 1 else np.zeros((2, 0), np.int64)
        a, b = a[a < b], b[a < b]
        weight = r.integers(0, 9, len(a))
        low, best = list(range(n)), []
        for k in np.argsort(weight, kind="stable"):
            x, y = int(a[k]), int(b[k])
            while low[x] != x:
                x = low[x]
            while low[y] != y:
                y = low[y]
            if x != y:
                low[max(x, y)] = min(x, y)
                best.append(int(k))
        assert sorted(best) == simhash.spanning(n, a, b, weight).tolist()


@pytest.mark.parametrize("sizes", [(40, 3, 48, 1, 2), (49, 200, 30)])
def test_candidates_of_a_key_grow_with_its_rows(sizes):
    """Texts that look alike, similar or not, are no more pairs than rows; what isn't returned as a pair is left to the crowd."""
    r = np.random.default_rng(42)
    n = sum(sizes)
    noise = r.integers(0, 1 << 63, (3, n, 2), np.uint64)
    fp = r.integers(0, 1 << 63, (1, 2), np.uint64) ^ (noise[0] & noise[1] & noise[2])  # about 28 of 128 bits between two of them
    key = np.repeat(np.arange(len(sizes)), sizes)
    cols = {"key": key, "rep": np.arange(n) * 3, "f0": fp[:, 0].copy().view(np.int64), "f1": fp[:, 1].copy().view(np.int64)}
    out = simhash._candidates(0.8, 256)(np.flatnonzero(np.diff(key, prepend=-1)), cols)
    pairs = set(zip(out["a"][out["kind"] == 0].tolist(), out["b"][out["kind"] == 0].tolist(), strict=True))
    crowd = set(out["a"][out["kind"] == 2].tolist())
    i, j = np.triu_indices(n, 1)
    near = (key[i] == key[j]) & (np.bitwise_count(fp[i] ^ fp[j]).sum(axis=1) <= simhash._within(0.8, 128, 5))
    assert near.sum() > 5 * n and len(pairs) == (out["kind"] == 0).sum() < n
    assert all((a, b) in pairs or {a, b} <= crowd for a, b in zip((3 * i[near]).tolist(), (3 * j[near]).tolist(), strict=True))


def test_a_large_component_beside_strangers_costs_its_rows(spark):
    rows = [(1, i, 0) for i in range(2000)] + [(1, 5000 + i, 5000 + i // 2) for i in range(6)] + [(2, i, 7) for i in range(50)] + [(3, i, i % 40) for i in range(120)]
    got = simhash._blocks(spark.createDataFrame(rows, "key long, rep long, comp long"), simhash.F.lit(0.05)).collect()
    held = {}
    for x in got:
        held.setdefault((x.key, x.x, x.y), set()).add(x.rep)
    assert sum(x.key == 1 for x in got) < 2 * 2000 and not any(x.key == 2 for x in got)
    for key in (1, 3):
        own = [(rep, comp) for k, rep, comp in rows if k == key]
        meets = {}
        for (k, *block), reps in held.items():
            if k == key:
                for rep in reps:
                    meets.setdefault(rep, set()).add(tuple(block))
        assert all(meets[a] & meets[b] for a, x in own for b, y in own if x != y)


@pytest.mark.parametrize("hot", [256, 16])
def test_chains_in_a_crowd_stay_whole(spark, hot):
    """Each text is similar to the next alone; all look alike enough to be candidates."""
    r, rows = random.Random(43), []
    for g in range(3):
        words = [f"c{k}" for k in range(240)]
        for i in range(30):
            rows.append((100 * g + i, " ".join(words)))
            for k in r.sample(range(240), 4):
                words[k] = f"g{g}n{i}k{k}"
    r.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {x.doc_id: x.component_id for x in simhash.near_copies(frame, hot=hot).collect()}
    assert got == jaccard_components(rows) and len(set(got.values())) < 60


def test_a_key_that_fits_a_block_is_dealt_once(spark):
    rows = [(1, i, i % 7) for i in range(30)]
    got = simhash._blocks(spark.createDataFrame(rows, "key long, rep long, comp long"), simhash.F.lit(0.03)).collect()
    assert sorted((x.x, x.y, x.rep) for x in got) == [(0, 0, i) for i in range(30)]
