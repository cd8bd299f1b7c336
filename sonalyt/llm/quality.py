"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text are binned; cyclic rounds of boosting fit one shallow tree after another, each on a single feature, and
add its leaves to that feature's lookup table. Pairs of features that explain most of what is left then get tables of
their own in the same way. A score is the sum of one entry of each table, looked up for whole batches, through a sigmoid.

The model is fitted on the driver from the features, not the texts, of at most SAMPLE labelled rows (the first by a hash of doc_id). Texts are read
once: the features of all documents are materialised, which training and scoring share.

Nulls: a null or empty text has features of zero and is scored by them. Rows with a null label aren't learned from. Repeated
rows are learned from once and scored each. Ties: a doc_id with several labels has the largest; equal gains go to the first cut. Very long texts
are measured whole, some million bytes at a time. Without labelled rows, or with one class alone, the score is the smoothed share of label 1.
Empty table: empty result. Other columns aren't read; keep_good() returns them as they are.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, map_batches, pieces, table, texts

SAMPLE = 20_000
THRESHOLD = 0.3
ROUNDS, RATE, BINS, PAIR_BINS, PAIRS, LEAF, SHRINK = 120, 0.15, 48, 12, 8, 20, 2.0

BYTES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "exclaim": b"!?", "bar": b"|", "symbol": b"#%&*$@^~+=<>{}[]\\/_", "stop": b".", "pause": b",;:",
    "quote": b"\"'()-`", "high": bytes(range(128, 256)), "space": b" \t\r\x0b\x0c", "line": b"\n",
}
_GROUPS = np.zeros((256, len(BYTES)))
for _j, _b in enumerate(BYTES.values()):
    _GROUPS[np.frombuffer(_b, np.uint8), _j] = 1
NAMES = ("bytes", "words", "mean_word", "longest_word", "distinct_words", "top_word", "repeats", "short_words", "distinct_lines", "words_a_line", "words_a_stop", "capitals", *BYTES)


def features(parts: list[str]) -> np.ndarray:
    """A row of NAMES for each text."""
    counts = np.zeros((len(parts), 256))
    rows = np.zeros((len(parts), 12))
    for i, text in enumerate(parts):
        raw = text.encode("utf-8", "surrogatepass")
        if not raw:
            continue
        counts[i] = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        words = raw.split()
        n = len(words)
        if not n:
            rows[i, 0] = np.log1p(len(raw))
            continue
        seen = Counter(words)
        lines = raw.split(b"\n")
        sizes = np.fromiter(map(len, words), np.int64, n)
        rows[i] = (
            np.log1p(len(raw)), np.log1p(n), sizes.mean(), np.log1p(sizes.max()), len(seen) / n, max(seen.values()) / n, sum(map(eq, words, words[1:])) / n, (sizes <= 3).mean(),
            len(set(lines)) / len(lines), np.log1p(n / len(lines)), np.log1p(n / (1 + raw.count(b"."))), 0.0,
        )
    groups = counts @ _GROUPS
    size = np.maximum(counts.sum(axis=1), 1)
    rows[:, 11] = groups[:, 0] / np.maximum(groups[:, 0] + groups[:, 1], 1)
    return np.hstack([rows, groups / size[:, None]])


class Additive:
    """The lookup tables: one for each feature, one for each chosen pair."""

    def __init__(self, base: float):
        self.base, self.edges, self.tables, self.pairs, self.pair_edges, self.pair_tables = base, [], [], [], [], []

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (edges, add) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += add[np.searchsorted(edges, x[:, j], side="right")]
        for (i, j), add in zip(self.pairs, self.pair_tables, strict=True):
            total += add[np.searchsorted(self.pair_edges[i], x[:, i], side="right"), np.searchsorted(self.pair_edges[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _gain(g, h):
    return g * g / (h + SHRINK)


def _split(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[int, float]:
    """The cut of a run of bins with the largest gain, and that gain; -1 if none leaves LEAF rows on both sides."""
    if len(g) < 2:
        return -1, 0.0
    cg, ch, cn = np.cumsum(g), np.cumsum(h), np.cumsum(n)
    gain = _gain(cg[:-1], ch[:-1]) + _gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1]) - _gain(cg[-1], ch[-1])
    gain[(cn[:-1] < LEAF) | (cn[-1] - cn[:-1] < LEAF)] = -1
    k = int(np.argmax(gain))
    return (k + 1, float(gain[k])) if gain[k] > 1e-9 else (-1, 0.0)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int = 2) -> np.ndarray:
    """The leaves' values over the bins of a shallow tree."""
    cut_at = _split(g, h, n)[0] if depth else -1
    if cut_at < 0:
        return np.full(len(g), g.sum() / (h.sum() + SHRINK))
    return np.concatenate([_tree(g[:cut_at], h[:cut_at], n[:cut_at], depth - 1), _tree(g[cut_at:], h[cut_at:], n[cut_at:], depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One cut of either axis, the first where it gains most, the second within each half."""
    best = max(((*_split(g.sum(1 - a), h.sum(1 - a), n.sum(1 - a)), a) for a in (0, 1)), key=lambda x: x[1])
    k, _, axis = best
    if k < 0:
        return np.zeros_like(g)
    out = np.empty_like(g)
    for part in (slice(None, k), slice(k, None)):
        at = (part, slice(None)) if axis == 0 else (slice(None), part)
        line = _tree(g[at].sum(axis), h[at].sum(axis), n[at].sum(axis), 1)
        out[at] = line[None, :] if axis == 0 else line[:, None]
    return out


def train(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = RATE, pairs: int = PAIRS) -> Additive:
    share = (y.sum() + 1) / (len(y) + 2)
    model = Additive(float(np.log(share / (1 - share))))
    if len(y) == 0 or y.min() == y.max():
        return model
    d = x.shape[1]
    model.edges = [_edges(x[:, j], BINS) for j in range(d)]
    binned = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    size = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(k) for k in size]
    rows = [np.bincount(b, minlength=k) for b, k in zip(binned, size, strict=True)]
    f = np.full(len(y), model.base)

    def slopes():
        p = 1 / (1 + np.exp(-f))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(d):
            if size[j] > 1:
                g, h = slopes()
                step = rate * _tree(np.bincount(binned[j], g, size[j]), np.bincount(binned[j], h, size[j]), rows[j])
                model.tables[j] += step
                f += step[binned[j]]
    model.pair_edges = [_edges(x[:, j], PAIR_BINS) for j in range(d)]
    coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.pair_edges)]
    wide = [len(e) + 1 for e in model.pair_edges]

    def grid(i, j, *what):
        return [np.bincount(coarse[i] * wide[j] + coarse[j], w, wide[i] * wide[j]).reshape(wide[i], wide[j]) for w in what]

    g, h = slopes()
    one = np.ones(len(y))
    gains = []
    for i in range(d):
        for j in range(i):
            if wide[i] > 1 and wide[j] > 1:
                a, b, n = grid(i, j, g, h, one)
                gains.append((float((_pair_tree(a, b, n) * a).sum()), i, j))
    model.pairs = [(i, j) for _, i, j in sorted(gains, reverse=True)[:pairs]]
    model.pair_tables = [np.zeros((wide[i], wide[j])) for i, j in model.pairs]
    places = [(coarse[i], coarse[j], grid(i, j, one)[0]) for i, j in model.pairs]
    for _ in range(rounds // 2):
        for k, (a, b, n) in enumerate(places):
            g, h = slopes()
            i, j = model.pairs[k]
            step = rate * _pair_tree(*grid(i, j, g, h), n)
            model.pair_tables[k] += step
            f += step[a, b]
    return model


def featured(docs: DataFrame) -> DataFrame:
    def one(c):
        x = np.concatenate([features(part) for _, part in pieces(c["text"])])
        return {"doc_id": c["doc_id"], "x": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))}

    return map_batches(texts(docs), one, "doc_id long, x array<double>")


def held_out(modulus: int, remainder: int):
    """True where crc32 of doc_id as text leaves this remainder; a null doc_id is never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(True))


def sample(rows: DataFrame, labels: DataFrame, label: str, held, most: int) -> DataFrame:
    """rows with their label y, at most `most` of them, those held out left aside."""
    marks = labels.where(F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("double").alias("y"))
    marks = marks.where(~held).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # the limit bounds the broadcast
    return rows.join(F.broadcast(marks), "doc_id").dropDuplicates(["doc_id"])


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality", held=None, threshold: float = THRESHOLD, most: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; held: a column that is true for rows not to be learned from."""
    held = held_out(5, 0) if held is None else held
    rows = cut(featured(docs))
    learned = sample(rows, labels, label, held, most).orderBy("doc_id").toPandas()
    model = train(np.array(learned["x"].tolist()).reshape(len(learned), len(NAMES)), learned["y"].to_numpy())

    def one(c):
        x = np.asarray(c["x"].flatten()).reshape(len(c["doc_id"]), len(NAMES))
        return {"doc_id": c["doc_id"], "score": model.score(x)}

    scored = map_batches(rows, one, "doc_id long, score double")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of docs that the classifier doesn't reject."""
    key = fresh(docs, "good_doc")
    good = quality(docs, labels, **how).where("predicted = 1").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(good, F.col("doc_id").cast("long").eqNullSafe(F.col(key)), "left_semi")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
