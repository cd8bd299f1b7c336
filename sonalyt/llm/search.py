"""Ranked lexical search: items against all documents by norm buckets (LEMP).

Terms are runs of letters, digits and all characters beyond ASCII; A-Z are lower-cased. A document is a vector of impacts over the items' terms,
each times the square root of the term's weight, an item the vector of those roots; their inner product is the score. Document vectors are dealt out by
length, longest first, and stored. The longest SEEDS or so give each item a threshold: the score of its last hit so far. After that

* a bucket whose longest vector, times the item's length, is below the threshold holds no hit (Cauchy-Schwarz); the shortest length that any
  item can use is a filter on the stored vectors, so Parquet leaves out whole groups of rows;
* within a bucket an item's coordinates are taken in the order of the most they add there, until the rest can't reach the threshold. A document
  survives if what those gave it and a bound on the others do: the sum of their largest values in the bucket, or by Cauchy-Schwarz on what is left of both vectors;
* survivors are scored again over all the item's terms in integers; only these scores count.

Every bound is rounded up, a tie with the threshold survives, so no hit is lost. A task keeps each item's best `top` so far and returns no more.
Items go in blocks of about BLOCK terms, so what is broadcast has a size whatever their number (an item's own terms stay together).

Nulls: a null text has no terms; documents without doc_id count in the statistics and aren't ranked; items without item_id aren't searched. Rows of one
item_id are one item. Ties in score go to the smaller doc_id. Repeated documents are ranked row by row. An item without terms, or whose terms no
document holds, has no hits; empty tables give no rows. Very long texts are taken whole. Other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, stored, table
from .wordbytes import lowered, words

TOP, SEEDS, BLOCK, BUCKET = 50, 16_384, 200_000, 4096
SLACK = 1 + 1e-9
SEPARATORS = lowered([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])


def _terms_of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column(0).to_pylist()
        for at, w in words(b.column(1), SEPARATORS):
            found = {(int(r), w.low[s:e].tobytes()) for r, s, e in zip(w.row, w.begin, w.end, strict=True)}
            yield pa.RecordBatch.from_arrays([pa.array([ids[at + r] for r, _ in found], pa.int64()), pa.array([t.decode() for _, t in found], pa.string())], ["item_id", "term"])


class Vocabulary:
    """Terms with numbers, looked up by hash and told from others by their bytes."""

    def __init__(self, terms: list[str]):
        column = pa.array(terms, pa.large_string())
        self.known = {t.encode(): k for k, t in enumerate(terms)}
        hashes = np.concatenate([w.hash for _, w in words(column, SEPARATORS)] or [np.zeros(0, np.uint64)])
        self.hash, self.number = np.unique(hashes, return_index=True)
        self.begin = np.append(0, np.cumsum([len(t.encode()) for t in terms])).astype(np.int64)
        self.bytes = np.frombuffer("".join(terms).encode(), np.uint8)

    def numbers(self, w) -> tuple[np.ndarray, np.ndarray]:
        """Which words of w are terms, and their numbers."""
        if not len(self.hash) or not len(w.hash):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hash, w.hash), len(self.hash) - 1)
        place = np.flatnonzero(self.hash[at] == w.hash)
        number = self.number[at[place]]
        begin, size = w.begin[place], w.end[place] - w.begin[place]
        bad = size != self.begin[number + 1] - self.begin[number]
        ok = np.flatnonzero(~bad)
        for s in range(0, len(ok), 1 << 16):
            part = ok[s : s + (1 << 16)]
            many = size[part]
            start = np.cumsum(many) - many
            step = np.arange(many.sum()) - np.repeat(start, many)
            differs = w.low[np.repeat(begin[part], many) + step] != self.bytes[np.repeat(self.begin[number[part]], many) + step]
            bad[part] = np.add.reduceat(differs, start) > 0 if len(part) else False
        for k in np.flatnonzero(bad):  # two words of one hash
            number[k] = self.known.get(w.low[begin[k] : begin[k] + size[k]].tobytes(), -1)
        return place[number >= 0], number[number >= 0]


def _counted(vocabulary):
    """doc_id, its number of terms with repeats, and of the terms in the vocabulary the numbers and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        size = max(len(known.known), 1)
        for b in batches:
            for at, w in words(b.column(1), SEPARATORS):
                place, number = known.numbers(w)
                key, many = np.unique(w.row[place] * size + number, return_counts=True)
                off = np.searchsorted(key // size, np.arange(w.texts + 1)).astype(np.int32)
                n = np.bincount(w.row, minlength=w.texts)
                lists = [pa.ListArray.from_arrays(pa.array(off), pa.array(v.astype(np.int32))) for v in (key % size, many)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, w.texts), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "ids", "tfs"])

    return run


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and values."""
    off = column.offsets.to_numpy()
    return (off - off[0]).astype(np.int64), column.values.slice(off[0], off[-1] - off[0]).to_numpy()


def _vectors(weights, N: int, L: int):
    """Impacts of terms whose weight isn't 0, and the vector's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for b in batches:
            off, ids = _lists(b.column(2))
            tf = _lists(b.column(3))[1].astype(np.int64)
            row = np.repeat(np.arange(b.num_rows), np.diff(off))
            m = 50 + 50 * b.column(1).to_numpy() * N // L
            impact = 1_000_000_000 * tf // (1000 * tf + 20 * m[row])
            keep = w[ids] > 0
            row, ids, impact = row[keep], ids[keep], impact[keep]
            norm = np.sqrt(np.bincount(row, w[ids] * impact.astype(float) ** 2, minlength=b.num_rows))
            off = np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(off), pa.array(v)) for v in (ids.astype(np.int32), impact)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(norm), *lists], ["doc_id", "norm", "ids", "impacts"])

    return run


@dataclass
class Queries:
    """items: ids; begin: where each one's terms begin; terms: their numbers; weights: by number; least: scores below which an item needs no hit; top: hits wanted."""

    items: np.ndarray
    begin: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    least: np.ndarray
    top: int

    def lengths(self) -> np.ndarray:
        return np.sqrt(np.add.reduceat(self.weights[self.terms].astype(float), self.begin[:-1]))


class Bucket:
    """Document vectors of about one length, by document and by term."""

    def __init__(self, doc: np.ndarray, norm: np.ndarray, off: np.ndarray, ids: np.ndarray, impacts: np.ndarray, weights: np.ndarray):
        self.doc, self.norm, self.off, self.ids, self.impacts = doc, norm, off, ids, impacts
        row = np.repeat(np.arange(len(doc)), np.diff(off))
        order = np.argsort(ids, kind="stable")
        self.row, self.value = row[order], weights[ids[order]] * impacts[order]
        self.weighted = impacts[order]  # of one coordinate, without its weight
        self.begin = np.searchsorted(ids[order], np.arange(len(weights) + 1))
        self.most = np.zeros(len(weights))
        held = np.flatnonzero(np.diff(self.begin))
        if len(held):
            self.most[held] = np.maximum.reduceat(self.value, self.begin[held])

    def survivors(self, terms: np.ndarray, weights: np.ndarray, least: float) -> np.ndarray:
        """Documents that may score `least` or more for the terms."""
        most = self.most[terms]
        terms = terms[np.argsort(-most, kind="stable")]
        rest = np.append(np.cumsum(np.sort(most))[::-1], 0.0)  # after the first k coordinates the others add so much at most
        focus = max(1, int(np.searchsorted(-rest * SLACK, -least, side="right"))) if least > 0 else len(terms)
        focus = min(focus, len(terms))
        span = [slice(self.begin[t], self.begin[t + 1]) for t in terms[:focus]]
        row = np.concatenate([self.row[s] for s in span])
        got = np.bincount(row, np.concatenate([self.value[s] for s in span]), minlength=len(self.doc))
        if focus == len(terms):
            return np.flatnonzero((got >= least) & (got > 0))
        near = np.flatnonzero((got > 0) & (got + rest[focus] * SLACK >= least))
        square = np.bincount(row, np.concatenate([self.value[s] * self.weighted[s].astype(float) for s in span]), minlength=len(self.doc))
        left = np.sqrt(np.maximum(self.norm[near] ** 2 * SLACK - square[near], 0) * weights[terms[focus:]].sum())
        return near[(got[near] + left * SLACK + 1) >= least]

    def scores(self, rows: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Exact scores of some documents; weight: of each term, 0 outside the item."""
        many = self.off[rows + 1] - self.off[rows]
        start = np.cumsum(many) - many
        at = np.arange(many.sum()) - np.repeat(start - self.off[rows], many)
        return np.add.reduceat(weight[self.ids[at]] * self.impacts[at], start)


def _search(queries):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Queries = queries.value
        length, least, mine = q.lengths(), q.least.astype(float), np.zeros(len(q.weights), np.int64)
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q.items)
        for b in batches:
            norm, doc = b.column(1).to_numpy(), b.column(0).to_numpy()
            (off, ids), (_, impacts) = _lists(b.column(2)), _lists(b.column(3))
            order = np.argsort(-norm, kind="stable")
            for s in range(0, len(order), BUCKET):
                rows = order[s : s + BUCKET]
                alive = length * norm[rows[0]] * SLACK + 1 >= least
                if not alive.any():
                    break  # what follows is shorter still
                many = off[rows + 1] - off[rows]
                at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - off[rows], many)
                bucket = Bucket(doc[rows], norm[rows], np.append(0, np.cumsum(many)), ids[at], impacts[at], q.weights)
                most = np.add.reduceat(bucket.most[q.terms], q.begin[:-1])
                for k in np.flatnonzero(alive & (most * SLACK >= least) & (most > 0)):
                    terms = q.terms[q.begin[k] : q.begin[k + 1]]
                    near = bucket.survivors(terms, q.weights, least[k])
                    if not len(near):
                        continue
                    mine[terms] = q.weights[terms]
                    score = np.append(best[k][0], bucket.scores(near, mine))
                    mine[terms] = 0
                    docs = np.append(best[k][1], bucket.doc[near])
                    top = np.lexsort((docs, -score))[: q.top]
                    top = top[score[top] > 0]
                    best[k] = score[top], docs[top]
                    if len(top) == q.top:
                        least[k] = max(least[k], score[top[-1]])
        many = [len(s) for s, _ in best]
        if sum(many):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q.items, many)), pa.array(np.concatenate([d for _, d in best])), pa.array(np.concatenate([s for s, _ in best]))], ["item_id", "doc_id", "score"])

    return run


def _block(docs: DataFrame, pairs: DataFrame, top: int) -> DataFrame | None:
    """The hits of one block of items: pairs of item_id and term."""
    spark = docs.sparkSession
    rows = pairs.sort("item_id", "term").collect()
    terms = sorted({r.term for r in rows})
    counted = stored(docs.mapInArrow(_counted(spark.sparkContext.broadcast(Vocabulary(terms))), "doc_id long, n long, ids array<int>, tfs array<int>").where("n > 0"))
    N, L = counted.agg(F.count("*"), F.sum("n")).first()
    if not N:
        return None
    weights = np.zeros(len(terms), np.int64)
    for number, df in counted.select(F.explode("ids").alias("id")).groupBy("id").count().collect():
        weights[number] = math.floor(1000 * math.log((2 * N + 2) / (2 * df + 1)))
    number = {t: k for k, t in enumerate(terms)}
    useful = [(r.item_id, number[r.term]) for r in rows if weights[number[r.term]]]
    if not useful:
        return None
    vectors = counted.where("doc_id is not null").mapInArrow(_vectors(spark.sparkContext.broadcast(weights), N, L), "doc_id long, norm double, ids array<int>, impacts array<long>").where("norm > 0")
    vectors = stored(vectors.withColumn("salt", F.xxhash64("doc_id")).repartitionByRange(F.desc("norm"), "salt").sortWithinPartitions(F.desc("norm")).drop("salt"))
    items, begin = np.unique(np.array([i for i, _ in useful]), return_index=True)
    queries = Queries(items, np.append(begin, len(useful)), np.array([t for _, t in useful]), weights, np.zeros(len(items), np.int64), top)
    hit = "item_id long, doc_id long, score long"
    ranked = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)

    cutoff = vectors.agg(F.percentile_approx("norm", F.lit(max(0.0, 1 - SEEDS / N)), F.lit(1000))).first()[0]
    if cutoff is None:
        return None
    first = cut(best(vectors.where(F.col("norm") >= cutoff).mapInArrow(_search(spark.sparkContext.broadcast(queries)), hit)))
    for item, least in first.where(F.col("rank") == top).select("item_id", "score").collect():
        queries.least[np.searchsorted(items, item)] = least
    shortest = float((queries.least / queries.lengths()).min()) / SLACK - 1
    rest = vectors.where((F.col("norm") < cutoff) & (F.col("norm") >= shortest)).mapInArrow(_search(spark.sparkContext.broadcast(queries)), hit)
    return best(first.select("item_id", "doc_id", "score").union(rest)).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` best documents (doc_id, text) of each item (item_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")
    pairs = cut(items.mapInArrow(_terms_of_items, "item_id long, term string").distinct())
    blocks = max(1, math.ceil(2 * pairs.count() / block))
    out = None
    for k in range(blocks):
        part = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        found = None if part.isEmpty() else _block(docs, part, top)
        if found is not None:
            out = found if out is None else out.union(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
