"""SimHash near-duplicates by pivot distance tables.

Every fingerprint has its Hamming distances to PIVOTS reference fingerprints, kept by six windows of the 64 bits.
A pair that differs in at most 4 bits agrees in at least two of six windows, so in both windows its distances to every
pivot are equal: those coordinates of the table are the key on which candidate pairs meet, 15 keys for each fingerprint
(15 ways to take two windows). Within a key, a pair is discarded when its largest coordinate difference, over the
distances to all pivots, is above 4 (triangle inequality), and what survives is verified on the fingerprints.
Distances to whole pivots alone cannot deal pairs out: between unlike fingerprints they differ by 4 or less more often than
not, so every pair would have to meet. With the windows no pair within the limit is lost and few others meet.

near_copies(), which the pipeline's stage uses, links by the similarity of whole texts instead (five-word shingles, Jaccard 0.8 or more). Its candidates
come from wider fingerprints by a table of the same kind; see there.

Copies are gone before this: a fingerprint is one row, whatever the number of its documents. A key with very many
fingerprints is dealt out again as pairs of blocks, and each task returns a star of links, not its pairs.

Nulls: a null text is empty; a text without words has fingerprint zero, which links like any other. A null doc_id gets its
fingerprint's component but never names one. Ties: a bit set in just half of the hashes is 0. Repeated rows give repeated rows. Very long texts are
hashed whole, in parts of bounded size. Empty table: empty result. Other columns aren't read.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, lowest, map_batches, pieces, runs, table, texts

SHINGLE, BITS, SEED = 4, 4, 42
WINDOWS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
PIVOTS, KEYED = 16, 8  # reference fingerprints; those whose distances make the keys
WORDS, REFERENCES, NARROW_PIVOTS, MISSED, FEW, PART = 8, 10, 4, 0.002, 7, 256  # of near_copies(): words of a fingerprint, pivots whose distances make a key, pivots within bytes, pairs at the similarity that may agree in no window, members of a small set, texts of a key in one part
SMALL, HOT, CROWD, HELD, WIDE = 48, 8192, 1024, 1 << 20, 4096  # a run up to SMALL is compared by shifts; one above HOT is dealt out again; texts of a crowded key that are compared at a time, and shingles that they hold; columns at a time


def pivots() -> list[int]:
    return [xxhash.xxh64_intdigest(f"pivot {i}".encode(), SEED) for i in range(PIVOTS)]


def hashes(text: str, shingle: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included: words lower-cased in A-Z, joined by a space; fewer words than a shingle has are one."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    if n <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    whole = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, n)
    end = np.cumsum(size + 1) - 1
    begin = (end - size)[: n - shingle + 1].tolist()
    return np.fromiter(map(xxhash.xxh64_intdigest, [whole[s:e] for s, e in zip(begin, end[shingle - 1 :].tolist(), strict=True)], repeat(SEED)), np.uint64, len(begin))


def _majority(found: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), 1 << 15):
        ones += np.unpackbits(found[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    return _majority(hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a long)."""

    def one(c):
        fps = [fingerprint(t, shingle) for _, part in pieces(c["text"]) for t in part]
        return {"doc_id": c["doc_id"], "fp": np.array(fps, np.uint64).view(np.int64)}

    return map_batches(texts(docs), one, "doc_id long, fp long")


def _near(fp: np.ndarray, i: np.ndarray, j: np.ndarray, distances: np.ndarray, bits: int) -> np.ndarray:
    """Which of the pairs i-j survive the table and the verification."""
    ok = np.abs(distances[i].astype(np.int16) - distances[j]).max(axis=1) <= bits if len(i) else np.zeros(0, bool)
    ok[ok] = np.bitwise_count(fp[i[ok]] ^ fp[j[ok]]) <= bits
    return ok


def _star(fp: np.ndarray, distances: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is within reach in a long run. What one leader reaches is linked at once and not compared with itself."""
    a, b, rest = [], [], np.arange(len(fp))
    while len(rest) > 1:
        lead = rest[0]
        far = np.bitwise_count(fp[rest] ^ fp[lead])
        own, other = rest[far <= bits], rest[far > bits]
        a.append(np.full(len(own) - 1, lead))
        b.append(own[1:])
        reach = rest[(far > bits) & (far <= 2 * bits)]  # triangle inequality with the leader as a pivot
        for x in own[1:] if len(reach) else ():
            hit = reach[_near(fp, np.full(len(reach), x), reach, distances, bits)]
            a.append(np.full(len(hit), x))
            b.append(hit)
        rest = other
    return (np.concatenate(a), np.concatenate(b)) if a else (rest[:0], rest[:0])


def _again(cols: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Rows of a key that is to be dealt out again."""
    n = len(cols["fp"])
    return {"kind": np.ones(n, np.int64)} | {k: cols[k] for k in ("ways", "k1", "k2", "fp", "rep")} | {"other": np.zeros(n, np.int64)}


def _compare(bits: int, hot: int | None):
    refs = np.array(pivots(), np.uint64)

    def fn(starts: np.ndarray, cols: dict[str, np.ndarray]):
        n = len(cols["fp"])
        size = np.diff(np.append(starts, n))
        out = {k: [] for k in ("kind", "ways", "k1", "k2", "fp", "rep", "other")}

        def put(part):
            for k, v in part.items():
                out[k].append(v)

        rep = cols["rep"]
        if hot and (size > hot).any():
            put(_again({k: v[np.repeat(size > hot, size)] for k, v in cols.items()}))
        keep = (size > 1) & (size <= hot) if hot else size > 1
        at = np.repeat(keep, size).nonzero()[0]
        if len(at):
            fp, rep = cols["fp"][at].view(np.uint64), rep[at]
            run = np.repeat(np.arange(keep.sum()), size[keep])
            sizes = np.repeat(size[keep], size[keep])
            distances = np.bitwise_count(fp[:, None] ^ refs)
            a, b = [], []
            small = sizes <= SMALL
            for d in range(1, min(SMALL, int(sizes[small].max(initial=1)))):
                i = np.flatnonzero((run[d:] == run[:-d]) & small[d:])
                ok = _near(fp, i, i + d, distances, bits)
                a.append(i[ok])
                b.append(i[ok] + d)
            firsts = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
            for s in firsts[~small[firsts]]:
                e = s + sizes[s]
                x, y = _star(fp[s:e], distances[s:e], bits)
                a.append(x + s)
                b.append(y + s)
            a, b = np.concatenate(a) if a else np.zeros(0, int), np.concatenate(b) if b else np.zeros(0, int)
            label = lowest(len(fp), a, b)
            linked = np.flatnonzero(label != np.arange(len(fp)))
            put({k: cols[k][at[linked]] for k in ("ways", "k1", "k2", "fp", "rep")} | {"kind": np.zeros(len(linked), np.int64), "other": rep[label[linked]]})
        return {k: np.concatenate(v) for k, v in out.items()} if out["fp"] else None

    return fn


SCHEMA = "kind long, ways long, k1 long, k2 long, fp long, rep long, other long"


def _keys(c: dict[str, pa.Array]) -> dict[str, np.ndarray]:
    """15 rows for each fingerprint: its distances to the keyed pivots within two windows, four bits for each distance."""
    fp, rep = c["fp"].to_numpy(zero_copy_only=False), c["rep"].to_numpy(zero_copy_only=False)
    codes = []
    for at, wide in WINDOWS:
        mask, code = np.uint64(((1 << wide) - 1) << at), np.zeros(len(fp), np.int64)
        for p in pivots()[:KEYED]:
            code = code << 4 | np.bitwise_count((fp.view(np.uint64) ^ np.uint64(p)) & mask)
        codes.append(code)
    pairs = list(combinations(range(len(WINDOWS)), 2))
    return {
        "ways": np.repeat(np.arange(len(pairs)), len(fp)), "k1": np.concatenate([codes[x] for x, _ in pairs]), "k2": np.concatenate([codes[y] for _, y in pairs]),
        "fp": np.tile(fp, len(pairs)), "rep": np.tile(rep, len(pairs)),
    }


def links(fps: DataFrame, bits: int = BITS, hot: int = HOT) -> DataFrame:
    """(a, b) of representatives, enough to connect every pair of fps (fp, rep) within bits of each other."""
    if not 0 <= bits <= 4:
        raise ValueError("two of six windows agree only for pairs within 4 bits")
    keyed = map_batches(fps.where("rep is not null"), _keys, "ways long, k1 long, k2 long, fp long, rep long")
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartition(n, "ways", "k1", "k2").sortWithinPartitions("ways", "k1", "k2", "fp")
    found = cut(dealt.mapInArrow(runs(["ways", "k1", "k2"], ["fp", "rep"], _compare(bits, hot), _again), SCHEMA))
    near = found.where("kind = 0").select(F.col("rep").alias("a"), F.col("other").alias("b"))
    again = found.where("kind = 1")
    if again.isEmpty():
        return near
    sizes = again.groupBy("ways", "k1", "k2").agg(F.ceil(F.count("*") * 2 / hot).cast("long").alias("g"))
    blocks = again.join(sizes, ["ways", "k1", "k2"]).withColumn("x", F.pmod(F.xxhash64("fp"), F.col("g"))).select("ways", "k1", "k2", "fp", "rep", "x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)).alias("y"))
    blocks = blocks.select("ways", "k1", "k2", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "fp", "rep")
    keys = ["ways", "k1", "k2", "x", "y"]
    more = blocks.repartition(n, *keys).sortWithinPartitions(*keys, "fp").mapInArrow(runs(keys, ["fp", "rep"], _compare(bits, None)), SCHEMA)
    return near.union(more.select(F.col("rep").alias("a"), F.col("other").alias("b")))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS, hot: int = HOT) -> DataFrame:
    """doc_id, fingerprint, component_id for each row of docs; hot: rows of one key above which it is dealt out again."""
    each = cut(fingerprints(docs, shingle))
    fps = cut(each.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = components(links(fps, bits, hot))
    named = fps.join(roots, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return each.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _odd(n: int) -> np.ndarray:
    return (np.random.default_rng(SEED).integers(1, 1 << 63, n, np.uint64) << np.uint64(1) | np.uint64(1))[:, None]


def wide(sets: list[np.ndarray]) -> np.ndarray:
    """A fingerprint of WORDS times 64 bits for each set of hashes, a row of words: a bit is 1 if it is set in over half of the set's members.

    Members are counted in bytes, eight bits of a word at a time, so a part of a set has at most 255 of them and a block 256 parts."""
    out = np.zeros((len(sets), WORDS), np.uint64)
    size = np.array([len(u) for u in sets], np.int64)
    if not size.sum():
        return out
    factors, ones = _odd(WORDS), np.uint64(0x0101010101010101)
    members, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), -(-size // 255))
    begin = np.concatenate([np.arange(0, n, 255) + at for n, at in zip(size, np.cumsum(size) - size, strict=True)])
    counts = np.zeros((len(sets), WORDS * 64), np.int32)
    for at in range(0, len(begin), 256):
        part = begin[at : at + 256]
        v = members[part[0] : begin[at + 256] if at + 256 < len(begin) else len(members)]
        v = (v ^ v >> np.uint64(29)) * factors
        v ^= v >> np.uint64(32)
        lanes = np.stack([np.add.reduceat(v >> np.uint64(bit) & ones, part - part[0], axis=1) for bit in range(8)], axis=-1)  # word, part, bit of a byte
        found = lanes.view(np.uint8).reshape(WORDS, len(part), 8, 8).transpose(1, 0, 3, 2).reshape(len(part), -1)  # part; word, byte, bit
        own = of[at : at + 256]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        counts[own[first]] += np.add.reduceat(found, first, axis=0, dtype=np.int32)
    return np.packbits(2 * counts > size[:, None], axis=1, bitorder="little").view(np.uint64)


def _sketch(shingle: int):
    """For each text: what tells its set of shingles from others, and the set's wide fingerprint."""

    def one(c):
        out: dict[str, list] = {k: [] for k in ("n", "total", "mix")}
        fps = []
        for _, part in pieces(c["text"], 1_000_000):
            sets = [np.unique(hashes(t, shingle)) for t in part]
            for u in sets:
                mix = np.bitwise_xor.reduce((u ^ u >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9), initial=np.uint64(0))
                for k, x in zip(out, (len(u), u.sum(dtype=np.uint64), mix), strict=True):
                    out[k].append(int(np.uint64(x).view(np.int64)))
            fps.append(wide(sets))
        return {"doc_id": c["doc_id"]} | {k: pa.array(v, pa.int64()) for k, v in out.items()} | {"words": _lists(np.concatenate(fps).view(np.int64))}

    return one


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def apart(similarity: float) -> float:
    """The share of bits in which fingerprints of equally large sets with that Jaccard similarity are expected to differ."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def _within(similarity: float, bits: int, deviations: float) -> int:
    """A number of differing bits that fingerprints of similar sets don't exceed, but for that many standard deviations."""
    p = apart(similarity)
    return int(bits * p + deviations * (bits * p * (1 - p)) ** 0.5)


def table_of_windows(n: int, similarity: float) -> tuple[list[np.ndarray], int]:
    """The windows of the pivots' table for n fingerprints, and how many of them a set needs that has more than FEW members.

    Each window is some bits of the wide fingerprint, all windows are as wide.

    A window has about log2(n) bits, less five, so that some 32 unlike fingerprints agree in it however many there are; there are as many windows as
    it takes for all but MISSED of the pairs at the similarity to agree in one. Their number grows with about the fourth root of n.
    Sets of four and five members may differ in 19 % of their bits instead of 15 %, so small ones have three times as many windows."""
    bits = min(max(8, int(np.ceil(np.log2(max(n, 2)))) - 5), 22)  # five bits hold a distance
    agree = min((1 - apart(similarity)) ** bits, 0.9)
    many = int(np.ceil(np.log(MISSED) / np.log1p(-agree)))
    r, each, most = np.random.default_rng(SEED), WORDS * 64 // bits, 3 * many
    dealt = [r.permutation(WORDS * 64)[: each * bits].reshape(each, bits) for _ in range(-(-most // each))]
    return list(np.concatenate(dealt)[:most]), many


def _wide_pivots() -> np.ndarray:
    """Bits of the table's reference fingerprints, a row for each."""
    words = [[xxhash.xxh64_intdigest(f"pivot {p} word {w}".encode(), SEED) for w in range(WORDS)] for p in range(REFERENCES)]
    return np.unpackbits(np.array(words, np.uint64).view(np.uint8), axis=1, bitorder="little").astype(np.float32)


def coordinates(words: np.ndarray, windows: list[np.ndarray], first: int = 0) -> np.ndarray:
    """The pivots' table, a row for each window: every fingerprint's Hamming distances to all pivots within it, five bits for each distance, after the window's number."""
    bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").astype(np.float32)
    refs, out = _wide_pivots(), np.zeros((len(windows), len(words)), np.int64)
    for i, window in enumerate(windows):
        x, ref = bits[:, window], refs[:, window]
        far = (x.sum(axis=1)[:, None] + ref.sum(axis=1) - 2 * x @ ref.T).astype(np.int64)
        out[i] = first + i
        for p in range(REFERENCES):
            out[i] = out[i] << 5 | far[:, p]
    return out


def _words(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, WORDS)


def _meet(windows: list[np.ndarray], many: int):
    """A row for each fingerprint and window: the coordinates on which candidates meet, and the fingerprint's first words."""

    def fn(c):
        for at in range(0, len(c["rep"]), 2048):
            part = {k: v.slice(at, 2048) for k, v in c.items()}
            words, rep, n = _words(part["words"]), part["rep"].to_numpy(zero_copy_only=False), part["n"].to_numpy(zero_copy_only=False)
            for own, first, last in ((n > 0, 0, many), (n <= FEW, many, len(windows))):
                if own.any() and last > first:
                    key = coordinates(words[own], windows[first:last], first)
                    yield {"key": key.ravel(), "rep": np.tile(rep[own], len(key))} | {w: np.tile(words[own, i].view(np.int64), len(key)) for i, w in enumerate(SHORT)}

    return fn


SHORT = ["f0", "f1"]  # the words that meet; the others are asked for pairs only


def _short(cols: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The words that meet, and their pivots' table: distances to NARROW_PIVOTS pivots within each byte; pivot, row, byte."""
    fp = np.stack([cols[w] for w in SHORT], axis=1).view(np.uint64)
    refs = np.array([[xxhash.xxh64_intdigest(f"narrow {p} word {w}".encode(), SEED) for w in range(len(SHORT))] for p in range(NARROW_PIVOTS)], np.uint64)
    return fp, np.stack([np.bitwise_count((fp ^ ref).view(np.uint8)) for ref in refs]).view(np.int8)


def _distance(fp: np.ndarray, told: np.ndarray, i: np.ndarray, j: np.ndarray, limit: int) -> np.ndarray:
    """Differing bits of pairs, or more than limit for those that the pivots' table discards: within each byte a pair differs in no less than its largest difference of coordinates."""
    out = np.full(len(i), limit + 1, np.int64)
    for at in range(0, len(i), 1 << 16):
        x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        least = np.abs(told[0][x] - told[0][y])
        for t in told[1:]:
            np.maximum(least, np.abs(t[x] - t[y]), out=least)
        left = np.flatnonzero(least.sum(axis=1, dtype=np.int16) <= limit)
        out[at + left] = np.bitwise_count(fp[x[left]] ^ fp[y[left]]).sum(axis=1)
    return out


def spanning(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which of the links a-b of nodes 0 to n-1 make a spanning forest of least weight (Boruvka); ties go to the earlier link."""
    order = np.argsort(weight, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    label, kept, left = np.arange(n), np.zeros(len(a), bool), np.arange(len(a))
    while True:
        left = left[label[a[left]] != label[b[left]]]
        if not len(left):
            return np.flatnonzero(kept)
        best = np.full(n, len(a))
        np.minimum.at(best, label[a[left]], place[left])
        np.minimum.at(best, label[b[left]], place[left])
        chosen = order[np.unique(best[best < len(a)])]
        kept[chosen] = True
        label = lowest(n, label[a[chosen]], label[b[chosen]])[label]


def _candidates(similarity: float, hot: int | None):
    """Of runs of fingerprints with equal coordinates: pairs (kind 0), rows of a run above hot, which is dealt out again (1), rows of pairs that are near enough but weren't returned (2).

    The pairs of a run that are near enough would grow with the square of a group of near copies. So only a spanning forest of least distance leaves the
    task, less pairs than rows: a chain of near pairs between two texts is there with pairs as near or nearer. _open() and _across() look at what that leaves out."""
    limit = _within(similarity, 64 * len(SHORT), 5)
    small, most = min(SMALL, hot or SMALL), min(hot, CROWD) if hot else None

    def fn(starts: np.ndarray, cols: dict[str, np.ndarray]):
        n = len(starts)
        size = np.diff(np.append(starts, len(cols["rep"])))
        fp, told = _short(cols)
        rep, key = cols["rep"], cols["key"]
        run, sizes = np.repeat(np.arange(n), size), np.repeat(size, size)
        a, b, crowd = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def put(i, j, far, first, last):
            forest = spanning(last - first, i - first, j - first, far)
            a.append(i[forest])
            b.append(j[forest])
            crowd.append(np.unique([np.delete(i, forest), np.delete(j, forest)]))

        near = [(np.zeros(0, np.int64),) * 3]
        for d in range(1, min(small, int(sizes[sizes <= small].max(initial=1)) - 1) + 1):
            i = np.flatnonzero((run[d:] == run[:-d]) & (sizes[d:] <= small))
            far = _distance(fp, told, i, i + d, limit)
            near.append((i[far <= limit], i[far <= limit] + d, far[far <= limit]))
        put(*(np.concatenate(x) for x in zip(*near, strict=True)), 0, len(rep))
        for s, e in zip(starts, starts + size, strict=True):
            if e - s <= small or most and e - s > most:
                continue
            i, j = (x + s for x in np.triu_indices(e - s, 1))
            far = _distance(fp, told, i, j, limit)
            put(i[far <= limit], j[far <= limit], far[far <= limit], s, e)
        again = np.flatnonzero(sizes > most) if most else np.zeros(0, np.int64)
        i, j, crowd = np.concatenate(a), np.concatenate(b), np.concatenate(crowd)
        one = np.concatenate([i, again, crowd])
        out = {"kind": np.repeat([0, 1, 2], [len(i), len(again), len(crowd)]), "key": key[one], "a": rep[one], "b": np.concatenate([rep[j], rep[again], rep[crowd]])}
        low = np.minimum(out["a"], out["b"])
        return out | {"a": low, "b": np.maximum(out["a"], out["b"])} | {w: cols[w][one] for w in SHORT}

    return fn


def _hot(cols: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {"kind": np.ones(len(cols["rep"]), np.int64), "key": cols["key"], "a": cols["rep"], "b": cols["rep"]} | {w: cols[w] for w in SHORT}


MET = "kind long, key long, a long, b long, f0 long, f1 long"


def _open(similarity: float):
    """Of a pair of blocks of a key: its rows that are near a row of another component whose set isn't too small or large to be similar."""
    limit = _within(similarity, 64 * len(SHORT), 5)

    def fn(starts: np.ndarray, cols: dict[str, np.ndarray]):
        fp, told = _short(cols)
        comp, n, left = cols["comp"], cols["n"], np.zeros(len(cols["rep"]), bool)
        for s, e in zip(starts, np.append(starts[1:], len(comp)), strict=True):
            for x in range(s, e - 1):
                j = np.flatnonzero((comp[x + 1 : e] != comp[x]) & (np.minimum(n[x + 1 : e], n[x]) >= np.maximum(n[x + 1 : e], n[x]) * (similarity - 1e-12))) + x + 1
                j = j[np.bitwise_count(fp[j] ^ fp[x]).sum(axis=1) <= limit]
                left[j] = True
                left[x] |= len(j) > 0
        return {k: cols[k][left] for k in ("key", "x", "y", "rep", "comp")} | {"n": n[left]}

    return fn


def _across(similarity: float):
    """Of some blocks of texts' sets: links between components, enough to connect those that hold similar texts of a block."""

    def linked(comp: np.ndarray, size: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        held = np.repeat(np.arange(len(comp)), size)
        _, column, many = np.unique(members, return_inverse=True, return_counts=True)
        held, column = held[many[column] > 1], column[many[column] > 1]  # what one text holds alone is in no intersection
        _, column = np.unique(column, return_inverse=True)
        order = np.argsort(column, kind="stable")
        held, column = held[order], column[order]
        common = np.zeros((len(comp), len(comp)), np.float32)  # whole numbers, exact up to 2 to the 24
        columns = int(column[-1]) + 1 if len(column) else 0
        for first in range(0, columns, WIDE):
            s, e = np.searchsorted(column, [first, first + WIDE])
            own = np.zeros((len(comp), min(WIDE, columns - first)), np.float32)
            own[held[s:e], column[s:e] - first] = 1
            common += own @ own.T
        i, j = np.nonzero(np.triu(common >= (size[:, None] + size - common) * (similarity - 1e-9), 1) & (comp[:, None] != comp))
        low = lowest(len(comp), i, j)
        other = np.flatnonzero(low != np.arange(len(comp)))
        return comp[low[other]], comp[other]

    def fn(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(k, "ascending") for k in ("key", "x", "y")]).combine_chunks()
        block = np.stack([rows[k].to_numpy() for k in ("key", "x", "y")])
        starts = np.flatnonzero(np.append(True, (block[:, 1:] != block[:, :-1]).any(axis=0)))
        comp, lists = rows["comp"].to_numpy(), rows["members"].combine_chunks()
        at, members = lists.offsets.to_numpy(), lists.values.to_numpy()
        found = [linked(comp[s:e], np.diff(at[s : e + 1]), members[at[s] : at[e]]) for s, e in zip(starts, np.append(starts[1:], len(comp)), strict=True)]
        return pa.table({"a": np.concatenate([a for a, _ in found]), "b": np.concatenate([b for _, b in found])})

    return fn


def _blocks(crowd: DataFrame, weight: Column) -> DataFrame:
    """Rows of crowd (key, rep, comp and others) in pairs x-y of blocks of their key, a weight of about one each, so that rows of different components meet.

    Rows of a key's largest component don't meet each other: they are only dealt to the blocks of the others, so a large group beside a few strangers costs
    its rows, not their square."""
    each = crowd.groupBy("key", "comp").agg(F.sum(weight).alias("w"))
    sides = each.groupBy("key").agg(F.max_by("comp", F.struct("w", "comp")).alias("big"), F.when(F.sum("w") <= 1, 0).otherwise(F.ceil(F.max("w"))).cast("long").alias("h"), F.ceil(F.sum("w") - F.max("w")).cast("long").alias("g")).where("g > 0")
    of = F.xxhash64("rep")
    alone = (F.col("comp") == F.col("big")) & (F.col("h") > 0)  # h: blocks of the largest component, none if the whole key is one block
    rows = crowd.join(sides, "key").withColumn("own", F.when(alone, F.col("g") + F.pmod(of, F.col("h"))).otherwise(F.pmod(of, F.col("g"))))
    last = F.when(alone, F.col("g")).otherwise(F.col("g") + F.col("h")) - 1
    return rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last))).withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other"))


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, hot: int = PART) -> DataFrame:
    """doc_id, component_id for rows with a doc_id: linked are texts whose sets of word shingles have a Jaccard similarity of `similarity` or more.

    So wide a link leaves about 15 % of a fingerprint's bits different, more than windows of 64 bits can find at scale. Fingerprints therefore have
    WORDS times 64 bits here, of sets, and the pivots' table has as many windows as it takes (table_of_windows()). Candidates are fingerprints with equal
    distances to all pivots within a window. The table of distances within bytes discards pairs by the triangle inequality, Hamming distances of
    two words and then of all words discard those far below the similarity, and what is left is verified on the whole sets.
    A key with over SMALL fingerprints is first held against leaders, in salted parts of about `hot` if it has more. Once those links are verified, its
    fingerprints that are near one of another component, looked for in pairs of blocks, meet with their whole sets, and what they have in common is counted
    for all of them at once: only links leave the task, a group of copies costs no more than its leader, and no pair is lost for the key's size.
    Equal sets are one text before all this.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = map_batches(texts(docs).where("doc_id is not null"), _sketch(shingle), "doc_id long, n long, total long, mix long, words array<long>")
    kind = ["n", "total", "mix"]
    each = cut(each)
    reps = cut(each.groupBy(*kind).agg(F.min("doc_id").alias("rep"), F.first("words").alias("words")))
    windows, many = table_of_windows(reps.count(), similarity)
    keyed = map_batches(reps.where("n > 0").select("rep", "n", "words"), _meet(windows, many), "key long, rep long, f0 long, f1 long")
    found = cut(keyed.repartition(parts, "key").sortWithinPartitions("key", "rep").mapInArrow(runs(["key"], ["rep", *SHORT], _candidates(similarity, hot), _hot, most=1 << 16), MET))
    pairs = found.where("kind = 0").select("a", "b")
    again = found.where("kind = 1").select("key", F.col("a").alias("rep"), *SHORT)
    if not again.isEmpty():
        sizes = again.groupBy("key").agg(F.count("*").alias("many"), F.min("rep").alias("lead"))
        rows = again.join(sizes, "key").withColumn("salt", F.pmod(F.xxhash64("rep"), F.ceil(F.col("many") / hot)).cast("long"))
        dealt = rows.drop("many", "lead").repartition(parts, "key", "salt").sortWithinPartitions("key", "salt", "rep")
        within = dealt.mapInArrow(runs(["key", "salt"], ["rep", *SHORT], _candidates(similarity, None), most=1 << 16), MET).where("kind = 0")
        pairs = pairs.union(within.select("a", "b")).union(rows.where("rep != lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")))
    far = " + ".join(f"bit_count(x[{i}] ^ y[{i}])" for i in range(WORDS))
    known = pairs.distinct().join(reps.select(F.col("rep").alias("a"), F.col("words").alias("x")), "a").join(reps.select(F.col("rep").alias("b"), F.col("words").alias("y")), "b")
    pairs = cut(known.where(f"{far} <= {_within(similarity, WORDS * 64, 6)}").select("a", "b"))

    def whole(c):
        for at, part in pieces(c["text"], 1_000_000):
            found = [np.unique(hashes(t, shingle)) for t in part]
            own = np.array([u.sum(dtype=np.uint64) for u in found], np.uint64).view(np.int64)
            yield {"rep": c["doc_id"].slice(at, len(part)), "total": c["total"].slice(at, len(part)), "own": own, "members": pa.array([u.view(np.int64) for u in found], pa.list_(pa.int64()))}

    def sets(used: DataFrame) -> DataFrame:
        """rep and members: the whole sets of some representatives."""
        named = used.join(reps.select("rep", *kind), "rep")
        told = map_batches(texts(docs).join(named.select(F.col("rep").alias("doc_id"), "total"), "doc_id"), whole, "rep long, total long, own long, members array<long>")
        return cut(told.where("own = total").groupBy("rep").agg(F.first("members").alias("members")))

    def verified(pairs: DataFrame) -> DataFrame:
        held = sets(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct())
        both = pairs.join(held.select(F.col("rep").alias("a"), F.col("members").alias("x")), "a").join(held.select(F.col("rep").alias("b"), F.col("members").alias("y")), "b")
        both = both.where(F.least(F.size("x"), F.size("y")) >= F.greatest(F.size("x"), F.size("y")) * (similarity - 1e-12))
        common = F.size(F.array_intersect("x", "y"))
        return both.where(common >= (F.size("x") + F.size("y") - common) * (similarity - 1e-12)).select("a", "b")

    roots = components(verified(pairs)).withColumnRenamed("node", "rep")
    named = reps.join(roots, "rep", "left").select("rep", *kind, F.coalesce("root", "rep").alias("component_id"))
    crowd = cut(found.where("kind > 0").select("key", F.col("a").alias("rep"), *SHORT).join(named.select("rep", "n", F.col("component_id").alias("comp")), "rep"))
    dealt = _blocks(crowd, F.greatest(F.lit(2 / CROWD), F.col("n") * 2 / HELD)).select("key", "x", "y", "rep", "comp", "n", *SHORT).repartition(parts, "key", "x", "y").sortWithinPartitions("key", "x", "y", "rep")
    crowd = cut(dealt.mapInArrow(runs(["key", "x", "y"], ["rep", "comp", "n", *SHORT], _open(similarity), most=1 << 16), "key long, x long, y long, rep long, comp long, n long"))
    total = crowd.agg(F.sum("n")).first()[0]
    if total:
        lot = F.pmod(F.xxhash64("key", "x", "y"), F.lit(max(4 * parts, -(-total // HELD))))  # blocks are small and many: some go to a task together
        blocks = crowd.join(sets(crowd.select("rep").distinct()), "rep").select(lot.alias("lot"), "key", "x", "y", "comp", "members")
        more = cut(blocks.groupBy("lot").applyInArrow(_across(similarity), "a long, b long").distinct())
        if not more.isEmpty():
            higher = components(more).select(F.col("node").alias("component_id"), "root")
            named = named.join(higher, "component_id", "left").select(*kind, F.coalesce("root", "component_id").alias("component_id"))
    return each.join(named.select(*kind, "component_id"), kind).select("doc_id", "component_id")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its group of near copies, once each. Rows without doc_id can't be judged and stay."""
    stay = near_copies(docs, **how).where("doc_id = component_id").select("doc_id").distinct()
    known = F.col("doc_id").cast("long").isNotNull()
    kept = docs.where(known).join(stay, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns)
    return kept.unionByName(docs.where(~known))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
