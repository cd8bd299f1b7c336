"""Toxicity: a support vector machine with a gap-weighted subsequence kernel and Nyström landmarks.

A unit is a word without anything but letters, or single letters in a row that spaces or marks hold apart, between a mark for its
begin and one for its end. The kernel of two units is the mean, over subsequences of three, four and five letters, of the normalised kernels of
gap-weighted subsequences: each shared one counts DECAY to the power of its span, for spans up to SPAN, so letters may be inserted between,
and a unit's weights are summed for each subsequence before its norm is taken. The end mark and the longer subsequences tell
a clean stem from an insult that is built on it.

Sentences of labelled documents train it: a sentence is clean if any clean document holds it. A unit counts once for each word that
comes before it, so copies and near copies of a document don't add up. Units that toxic sentences hold far more often than clean ones (G
statistic) are examples of label 1. Clean units are those of label 0: some drawn at random, the most frequent, and, twice over, those
that the machine so far takes nearest to insults, of all that were counted. Examples from both classes are the landmarks; the Nyström map of the kernel to
them goes into a linear machine with squared hinge loss, whose weights, taken back through the map, are one table of subsequences
(hashed to 2^PLACES places), so a unit's value is one sum, looked up for all new words of a batch at once.

A document's score is a logistic curve over the TOP largest values among its different units, and its number of words, as a long clean text
meets more words that look like insults. The curve is fitted on labelled rows by machines that didn't learn from them (FOLDS folds).

Only aggregates come to the driver: at most UNITS + 1.5 x PLAIN + 2 x HARD units for each of FOLDS + 1 machines and SAMPLE calibration
rows of TOP + 1 numbers. At most DOCS documents of each label are learned from, the first by a hash of doc_id, of them the INSULTS surest examples.
Nulls: a null or empty text has no units and the least values, like a text of digits alone. Null labels aren't learned from. Without both
labels the score is the smoothed share of label 1. Ties: a doc_id with several labels has the largest. Repeated rows are scored each,
learned from once. Very long texts are scored whole, some million bytes at a time. Empty table: empty result. Other columns aren't read.
"""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from heapq import nlargest
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, map_batches, pieces, table, texts
from .quality import held_out, sample

DECAY, SPAN, SIZES = 0.6, 5, (3, 4, 5)
OTHERS = 24  # classes of letters beyond a to z
BEGIN, STOP, PAD = 26 + OTHERS, 27 + OTHERS, 99
LETTERS = 28 + OTHERS
PLACES = 20  # bits of a place in the table of subsequences
NOWHERE = 1 << PLACES
DOCS, UNITS, LANDMARKS, SAMPLE = 2500, 4_000, 160, 20_000
PLAIN, INSULTS, FOLDS = 3000, 1500, 3  # clean units drawn at random, examples of insults, folds of the calibration
HARD = 1500  # clean units nearest to insults that are learned from beside those drawn at random
TOP = 3  # units of a document that its score is made of
FLOOR, CEILING = -1.0, 1.5
THRESHOLD = 0.7
_REMEMBERED = 500_000
_OFFSETS = {p: [(0, *inner, last) for last in range(p - 1, SPAN) for inner in combinations(range(1, last), p - 2)] for p in SIZES}
_WEIGHTS = np.array([DECAY ** (last + 1) for last in range(7)] + [0.0], np.float32)
_SENTENCE = re.compile(r"[.!?\n]+")
_APART = re.compile(r"(?<!\S)[^\W\d_](?:[\s.*_-]{1,2}[^\W\d_]){3,}(?!\w)")
_LETTERS = re.compile(r"[\W\d_]+")


def unit(word: str) -> str:
    return _LETTERS.sub("", word)


def units(text: str) -> set[tuple[str, str]]:
    """The units of a text, each with the word before it."""
    low = text.lower()
    words = [unit(w) for w in low.split()]
    return {(u, b) for b, u in zip(["", *words], words) if len(u) > 2} | {(unit(x), "") for x in _APART.findall(low)}


def _codes(words: list[str]) -> np.ndarray:
    """a to z as 0 to 25, other letters in classes above, BEGIN and STOP around; PAD fills up."""
    wide = max(map(len, words))
    x = np.frombuffer("".join(w.ljust(wide, "\0") for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), wide).astype(np.int64)
    c = np.full((len(words), wide + 2), PAD, np.int64)
    c[:, 0] = BEGIN
    c[:, 1:-1] = np.where((x >= 97) & (x <= 122), x - 97, np.where(x > 0, 26 + x % OTHERS, PAD))
    c[np.arange(len(words)), [len(w) + 1 for w in words]] = STOP
    return c


def subsequences(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each size of subsequence: their places in the table (NOWHERE fills up), and their weights by the word's own norm over summed features."""
    c = _codes(words)
    n, wide = c.shape
    real = c < PAD
    c = c.view(np.uint64)
    out = []
    for size in SIZES:
        keys = []
        for offsets in _OFFSETS[size]:
            last = offsets[-1]
            if wide > last:
                code = np.full((n, wide - last), size, np.uint64)
                for o in offsets:
                    code *= np.uint64(LETTERS)
                    code += c[:, o : wide - last + o]
                code *= np.uint64(0x9E3779B97F4A7C15)
                code >>= np.uint64(64 - PLACES)
                keys.append(np.where(real[:, last:], code.astype(np.int32) << 3 | last, NOWHERE << 3 | 7))
        if not keys:
            out.append((np.zeros((n, 0), np.int32), np.zeros((n, 0), np.float32)))
            continue
        key = np.sort(np.hstack(keys), axis=1)  # equal places side by side
        place, weight = key >> 3, _WEIGHTS[key & 7]
        new = np.ones(place.shape, bool)
        new[:, 1:] = place[:, 1:] != place[:, :-1]
        starts = np.flatnonzero(new.ravel())
        summed = np.add.reduceat(weight.ravel(), starts)
        norm = np.sqrt(np.bincount(starts // place.shape[1], summed * summed, n) * len(SIZES))
        out.append((place, weight / np.maximum(norm, 1e-9)[:, None].astype(np.float32)))
    return out


def _grouped(words: list[str], most: int = 6_000):
    """Places in words of groups of like length, of bounded size together."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    group: list[int] = []
    for i in order:
        if group and (len(group) + 1) * (len(words[i]) + 2) > most:
            yield group
            group = []
        group.append(i)
    if group:
        yield group


class Maps:
    """The explicit feature maps of landmarks, over the places that any of them has."""

    def __init__(self, words: list[str]):
        rows, places, weights = [], [], []
        for group in _grouped(words):
            for place, weight in subsequences([words[i] for i in group]):
                rows.append(np.repeat(group, place.shape[1]))
                places.append(place.ravel())
                weights.append(weight.ravel())
        row, place, weight = np.concatenate(rows), np.concatenate(places), np.concatenate(weights)
        self.places = np.unique(place[weight > 0])
        self.at = np.full(NOWHERE + 1, len(self.places), np.int64)
        self.at[self.places] = np.arange(len(self.places))
        self.maps = np.zeros((len(self.places) + 1, len(words)), np.float32)  # the last row stands for all other places
        np.add.at(self.maps, (self.at[place], row), weight)
        self.maps[-1] = 0

    def kernel(self, words: list[str]) -> np.ndarray:
        """Of each word with each landmark."""
        out = np.zeros((len(words), self.maps.shape[1]))
        for group in _grouped(words, 500):
            out[group] = sum((weight[:, None, :].astype(np.float32) @ self.maps[self.at[place]])[:, 0] for place, weight in subsequences([words[i] for i in group]))
        return out


class Machine:
    """value(word) = sum over its subsequences of their entry in the table, by the word's own norms, plus bias."""

    def __init__(self, places: np.ndarray, entries: np.ndarray, bias: float):
        self.places, self.entries, self.bias, self.table = places, entries.astype(np.float32), bias, None

    def __getstate__(self):
        return self.places, self.entries, self.bias, None

    def __setstate__(self, state):
        self.places, self.entries, self.bias, self.table = state

    def values(self, words: list[str]) -> np.ndarray:
        if self.table is None:
            self.table = np.zeros(NOWHERE + 1, np.float32)
            self.table[self.places] = self.entries
        out = np.full(len(words), FLOOR)
        for group in _grouped(words):
            total = self.bias + sum(np.einsum("np,np->n", self.table[place], weight) for place, weight in subsequences([words[i] for i in group]))
            out[group] = np.clip(total, FLOOR, CEILING)
        return out


def _hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, strength: float = 2e-5, steps: int = 60) -> np.ndarray:
    """Squared hinge loss by Newton steps over the rows within the margin; the last column of x is the bias."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], strength)
    ridge[-1] = 1e-6
    total = weight.sum()
    for _ in range(steps):
        near = 1 - y * (x @ w) > 0
        a = x[near] * weight[near, None]
        new = np.linalg.solve(x[near].T @ a / total + np.diag(ridge), a.T @ y[near] / total)
        if np.abs(new - w).max() < 1e-6:
            break
        w = 0.5 * w + 0.5 * new if _ > 10 else new
    return w


def _fit(bad: list[str], good: list[str], counts: dict[str, int], hard: int = 0, landmarks: int = LANDMARKS) -> Machine:
    """counts: how often an example of label 1 was seen; it weighs by the root of that. The first of good that are hard weigh as much as the others."""
    some = min(len(bad), landmarks // 2)
    maps = Maps([*bad[:some], *good[: landmarks - some]])
    gram = (maps.maps.T @ maps.maps).astype(float)
    vals, vecs = np.linalg.eigh((gram + gram.T) / 2)
    keep = vals > 1e-4 * vals.max()
    project = vecs[:, keep] / np.sqrt(vals[keep])
    x = np.hstack([maps.kernel([*bad, *good]) @ project, np.ones((len(bad) + len(good), 1))])
    y = np.array([1.0] * len(bad) + [-1.0] * len(good))
    share = np.sqrt([counts.get(u, 1) for u in bad])
    weight = np.concatenate([0.5 * share / share.sum(), np.full(hard, 0.25 / max(hard, 1)), np.full(len(good) - hard, (0.25 if hard else 0.5) / max(len(good) - hard, 1))])
    w = _hinge(x, y, weight)
    return Machine(maps.places, (maps.maps @ (project @ w[:-1]))[:-1], float(w[-1]))


def insults(counted: list[tuple[str, int, int]], share: float, tested: int) -> list[str]:
    """Units that toxic sentences hold more often than chance has it, the surest first; counted: unit, how often toxic and clean sentences hold it;
    share: of toxic ones among all; tested: units from which counted is chosen."""
    evidence = max(15.0, 2 * np.log(tested))  # so large a G statistic is less likely by chance than one unit among those tested
    scored = []
    for u, bad, good in counted:
        n = bad + good
        if bad > n * share:
            scored.append((2 * (bad * np.log(bad / (n * share)) + (good * np.log(good / (n * (1 - share))) if good else 0.0)), u))
    sure = [u for g, u in sorted(scored, reverse=True) if g >= evidence]
    clear = {u for u, b, g in counted if g <= 0.2 * b}
    return [u for u in sure if u in clear] or sure


def _sentences(c):
    out: dict[str, list] = {"sentence": [], "y": [], "part": [], "units": []}
    y, fold = c["y"].to_pylist(), c["part"].to_pylist()
    for at, part in pieces(c["text"]):
        for i, text in enumerate(part, at):
            for s in set(_SENTENCE.split(text.lower())):
                if found := units(s):
                    out["sentence"].append(xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass")))
                    out["y"].append(y[i])
                    out["part"].append(fold[i])
                    out["units"].append([{"unit": u, "before": b} for u, b in sorted(found)])
    kinds = {"y": pa.float64(), "part": pa.int64(), "units": pa.list_(pa.struct([("unit", pa.string()), ("before", pa.string())]))}
    return {"sentence": np.array(out["sentence"], np.uint64).view(np.int64)} | {k: pa.array(out[k], t) for k, t in kinds.items()}


def fold():
    """The fold of a document, by a hash of its id."""
    return F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS))


def learn(docs: DataFrame, labels: DataFrame, label: str, held, most: int = DOCS) -> dict[int, Machine]:
    """The machine of all learned rows as -1, and for each fold that of the other folds' rows; a machine without examples is left out."""
    source = texts(docs)
    ids = source.select("doc_id")
    some = reduce(DataFrame.union, [sample(ids, labels.where(F.col(label) == k), label, held, most) for k in (0, 1)])
    told = map_batches(source.join(F.broadcast(some), "doc_id").withColumn("part", fold()), _sentences, "sentence long, y double, part long, units array<struct<unit: string, before: string>>")
    teams = F.filter(F.array(*[F.lit(g).cast("long") for g in range(-1, FOLDS)]), lambda g: g != F.col("part"))
    once = told.withColumn("team", F.explode(teams)).groupBy("team", "sentence").agg(F.min("y").alias("y"), F.first("units").alias("units"))
    told = once.select("team", "y", F.explode("units").alias("u")).groupBy("team", "u.unit", "u.before").agg(F.min("y").alias("y"))
    counted = cut(told.groupBy("team", "unit").agg(F.sum("y").cast("long").alias("bad"), F.sum(1 - F.col("y")).cast("long").alias("good")))
    sums = {r.team: r for r in counted.groupBy("team").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count("*").alias("tested")).collect()}
    shares = {t: r.bad / (r.bad + r.good) for t, r in sums.items() if r.bad and r.good}
    if not shares:
        return {}

    share = reduce(lambda a, t: a.when(F.col("team") == t, shares[t]), shares, F.when(F.lit(False), 0.0))
    known = counted.where(F.col("team").isin(*shares))

    def first(rows: DataFrame, kind: str, most: int, *order) -> DataFrame:
        at = F.row_number().over(Window.partitionBy("team").orderBy(*order, "unit"))
        return rows.withColumn("at", at).where(F.col("at") <= most).select(F.lit(kind).alias("kind"), "team", "unit", "bad", "good")

    over = F.col("bad") * (1 - share) - F.col("good") * share
    clean = known.where("good > bad")
    chosen = first(known.where(over > 0), "top", UNITS, over.desc()).union(first(clean, "plain", PLAIN, F.xxhash64("unit"))).union(first(clean, "plain", PLAIN // 2, F.desc("good")))
    chosen = [tuple(r) for r in chosen.collect()]
    bad, good, counts = {}, {}, {}
    for t in shares:
        own = sorted((u, b, g) for kind, team, u, b, g in chosen if team == t and kind == "top")
        bad[t] = insults(own, shares[t], sums[t].tested)[:INSULTS]
        counts[t] = {u: b for u, b, _ in own}
        good[t] = sorted({u for kind, team, u, _, _ in chosen if team == t and kind == "plain"}, key=lambda u: xxhash.xxh3_64_intdigest(u.encode()))
    hard: dict[int, list[str]] = {t: [] for t in shares if bad[t] and good[t]}

    def fitted() -> dict[int, Machine]:
        def one(t: int) -> Machine:
            near = set(hard[t])
            return _fit(bad[t], [*hard[t], *(u for u in good[t] if u not in near)], counts[t], len(hard[t]))

        with ThreadPoolExecutor() as pool:
            return dict(zip(hard, pool.map(one, hard), strict=True))

    machines = fitted()
    for _ in range(2 if machines else 0):  # the clean units, of all that were counted, that come nearest to insults
        found = sorted(tuple(r) for r in _nearest(clean, machines).collect())
        for t in machines:
            own = set(bad[t])
            hard[t] = [u for u in dict.fromkeys([*hard[t], *(u for k, u in found if k == t)]) if u not in own]
        machines = fitted()
    return machines


def _nearest(clean: DataFrame, machines: dict[int, Machine]) -> DataFrame:
    """(team, unit) of the HARD units to which a team's machine gives the largest values."""

    def one(c):
        team, unit_ = np.array(c["team"].to_pylist()), np.array(c["unit"].to_pylist(), dtype=object)
        for t, m in machines.items():
            own = unit_[team == t]
            value = m.values(own.tolist())
            best = np.argsort(-value, kind="stable")[:HARD]  # of a batch; no more of it can be among all
            yield {"team": np.full(len(best), t), "unit": pa.array(own[best].tolist(), pa.string()), "value": value[best]}

    at = F.row_number().over(Window.partitionBy("team").orderBy(F.desc("value"), "unit"))
    return map_batches(clean.select("team", "unit"), one, "team long, unit string, value double").withColumn("at", at).where(F.col("at") <= HARD).select("team", "unit")


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights of a logistic curve over the columns of x and its offset, with softened labels (Platt, 1999); the first TOP never lower a score."""
    n1, n0 = y.sum(), (1 - y).sum()
    full = np.zeros(x.shape[1] + 1)
    full[-1] = np.log((n1 + 1) / (n0 + 1))
    if not n1 or not n0 or np.ptp(x[:, 0]) == 0:
        return full
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    use = list(range(x.shape[1]))
    while True:
        a = np.hstack([x[:, use], np.ones((len(x), 1))])
        b, keep = np.zeros(len(use) + 1), ridge * np.append(np.ones(len(use)), 1e-3)
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
            step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(keep), a.T @ (p - t) + keep * b)
            b -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
            if np.abs(step).max() < 1e-8:
                break
        low = min((b[k], j) for k, j in enumerate(use) if j < TOP) if any(j < TOP for j in use) else (0.0, 0)
        if low[0] >= 0:
            full[[*use, -1]] = b
            return full
        use.remove(low[1])


class _Values(dict):
    """Values of words under one machine, remembered by a worker."""

    def __init__(self, machine: Machine):
        super().__init__()
        self.machine = machine

    def tops(self, texts: list[str]) -> list[list[float]]:
        """For each text: the largest values of its units and the logarithm of its number of words."""
        lows = [t.lower() for t in texts]
        words = [set(low.split()) for low in lows]
        if len(self) > _REMEMBERED:
            self.clear()
        new = [w for w in set().union(*words) if w not in self]
        plain = [unit(w) for w in new]
        self.update(dict.fromkeys(new, FLOOR))
        long = [i for i, u in enumerate(plain) if len(u) > 2]
        self.update(zip([new[i] for i in long], self.machine.values([plain[i] for i in long]).tolist(), strict=True))
        out = []
        for low, ws in zip(lows, words, strict=True):
            found = {unit(w): v for w in ws if (v := self[w]) > FLOOR}
            apart = [u for x in _APART.findall(low) if (u := unit(x)) not in found]
            found.update(zip(apart, self.machine.values(apart).tolist(), strict=True))
            out.append([*nlargest(TOP, [*found.values(), *[FLOOR] * TOP]), float(np.log1p(len(ws)))])
        return out


def values(docs: DataFrame, machines: dict[int, Machine], part=None) -> DataFrame:
    """doc_id and x: the TOP largest values of its units (as far as it has so many) and the logarithm of its number of words.

    part: a column that names the machine of a row, if it isn't that of all."""
    known = {t: _Values(m) for t, m in machines.items()}
    nothing = [*[FLOOR] * TOP, 0.0]

    def one(c):
        whose = c["part"].to_pylist()
        out: list[list[float]] = [nothing] * len(whose)
        for at, texts_ in pieces(c["text"]):
            for t in set(whose[at : at + len(texts_)]):
                if (own := known.get(t, known.get(-1))) is not None:
                    here = [i for i in range(len(texts_)) if whose[at + i] == t]
                    for i, x in zip(here, own.tops([texts_[i] for i in here]), strict=True):
                        out[at + i] = x
        return {"doc_id": c["doc_id"], "x": pa.array(out, pa.list_(pa.float64()))}

    rows = texts(docs).withColumn("part", F.lit(-1).cast("long") if part is None else part)
    return map_batches(rows, one, "doc_id long, x array<double>")


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", held=None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; held: a column that is true for rows not to be learned from."""
    held = held_out(3, 1) if held is None else held
    machines = learn(docs, labels, label, held)
    told = sample(texts(docs), labels, label, held, SAMPLE)
    known = values(told, machines, fold()).join(F.broadcast(sample(texts(docs).select("doc_id"), labels, label, held, SAMPLE)), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").toPandas()
    x = np.array(known["x"].tolist()).reshape(len(known), TOP + 1)
    *weights, offset = calibrate(x, known["y"].to_numpy()).tolist()
    rows = values(docs, machines)
    total = reduce(lambda a, k: a + F.col("x")[k] * weights[k], range(TOP + 1), F.lit(offset))
    score = 1 / (1 + F.exp(-total))
    return rows.select("doc_id", held.alias("held_out"), score.alias("score"), (score >= threshold).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
