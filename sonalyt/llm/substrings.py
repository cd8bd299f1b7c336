"""Substring dedup: suffix automata of reference shards, through which documents stream for matching statistics.

The reference is the corpus itself, which has no size bound, so its automata are not broadcast: reference and documents are
brought together by content. Every window of WINDOW words has one anchor, the least hash among its GRAM-word grams
(a minimiser), so equal windows meet at equal anchors. Anchors that occur in one document only end there. For the
others the documents give the stretches of words around them, and a shard's task builds, in order of doc_id, a suffix
automaton of an anchor's stretches; each document streams through the automaton of those before it, and maximal
matches of WINDOW or more words are removed. Words are compared as such, hashes only bring them together.

An anchor with more than HOT documents is dealt out: its windows travel one by one under their own hash, so a passage that very many documents
share, each within its own context, spreads over all tasks and an automaton's size stays bounded. Shards of either kind are matched alike, on words.

Nulls: a null text has no words. A row without doc_id is neither reference nor judged. Repeated rows of one doc_id are one
document and get the same result each. Ties: of equal grams of a window the leftmost is its anchor; of documents with a passage the smallest doc_id
keeps it. Very long texts are cut whole, some million bytes at a time. Empty table: empty result. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, pieces, table, texts

WINDOW, GRAM = 13, 6
HOT = 1000  # documents of an anchor above which its windows are dealt out one by one
_REMEMBERED = 400_000


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = Hashes()


class Stretches:
    """Stretches of consecutive windows with the same anchor, for the documents of a part: doc, anchor hash, first and last window."""

    def __init__(self, words: list[list[bytes]], window: int, gram: int):
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        n = int(ends[-1]) if len(ends) else 0
        self.begin = ends - sizes
        self.doc = self.anchor = self.first = self.last = np.zeros(0, np.int64)
        wide = window - gram + 1  # grams of a window
        if n < window:
            return
        x = np.fromiter(map(_HASHES.__getitem__, chain.from_iterable(words)), np.uint64, n)
        m = n - gram + 1
        h = x[:m].copy()
        for j in range(1, gram):
            h *= np.uint64(0x9E3779B97F4A7C15)
            h += x[j : j + m]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        at, span = np.arange(m), 1
        while span < wide:  # the place of the least, the leftmost of equals, among ever more grams
            step = min(span, wide - span)
            a, b = at[: len(at) - step], at[step:]
            at = np.where(h[a] <= h[b], a, b)
            span += step
        start = np.repeat(ends, sizes)[: n - window + 1] - window  # the last window of the word's document
        window_at = np.flatnonzero(np.arange(n - window + 1) <= start)
        if not len(window_at):
            return
        anchor_at = at[window_at]
        new = np.ones(len(window_at), bool)
        new[1:] = (anchor_at[1:] != anchor_at[:-1]) | (window_at[1:] != window_at[:-1] + 1)
        heads = np.flatnonzero(new)
        self.first = window_at[heads]
        self.last = window_at[np.append(heads[1:], len(window_at)) - 1]
        self.anchor = h[anchor_at[heads]].view(np.int64)
        self.doc = np.searchsorted(ends, self.first, side="right")


class Automaton:
    """Suffix automaton of several word sequences."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.size = [-1], [0]

    def add(self, words: list) -> None:
        nxt, link, size = self.next, self.link, self.size
        last = 0
        for w in words:
            q = nxt[last].get(w)
            if q is not None and size[q] == size[last] + 1:
                last = q
                continue
            if q is None:
                new, p = len(nxt), last
                nxt.append({})
                link.append(0)
                size.append(size[last] + 1)
                while p >= 0 and w not in nxt[p]:
                    nxt[p][w] = new
                    p = link[p]
                if p < 0:
                    last = new
                    continue
                q = nxt[p][w]
            else:
                new, p = -1, last
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                twin = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                while p >= 0 and nxt[p].get(w) == q:
                    nxt[p][w] = twin
                    p = link[p]
                link[q] = twin
                if new >= 0:
                    link[new] = twin
                else:
                    new = twin
            last = new

    def matches(self, words: list, least: int) -> list[tuple[int, int]]:
        """Maximal spans covered by matches of at least `least` words."""
        nxt, link, size = self.next, self.link, self.size
        at, long, spans = 0, 0, []
        for i, w in enumerate(words, 1):
            while at and w not in nxt[at]:
                at = link[at]
                long = size[at]
            to = nxt[at].get(w)
            if to is None:
                at, long = 0, 0
                continue
            at, long = to, long + 1
            if long >= least:
                if spans and spans[-1][1] >= i - long:
                    spans[-1] = (min(spans[-1][0], i - long), i)
                else:
                    spans.append((i - long, i))
        return spans


def _anchors(window: int, gram: int):
    def one(c):
        doc, ids, hashes = c["doc_id"].to_numpy(zero_copy_only=False), [], []
        for at, part in pieces(c["text"]):
            s = Stretches([t.encode("utf-8", "surrogatepass").split() for t in part], window, gram)
            order = np.lexsort((s.anchor, s.doc))  # an anchor counts once for a document
            own, anchor = s.doc[order], s.anchor[order]
            new = np.ones(len(own), bool)
            new[1:] = (own[1:] != own[:-1]) | (anchor[1:] != anchor[:-1])
            ids.append(doc[at + own[new]])
            hashes.append(anchor[new])
        return {"anchor": np.concatenate(hashes), "doc_id": np.concatenate(ids).astype(np.int64)}

    return one


def _shared(hot: int):
    """Of rows sorted by anchor and doc_id: those whose anchor has several documents, and whether it has more than hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_a, held_d = np.zeros(0, np.int64), np.zeros(0, np.int64)
        flowing = False  # the held anchor is known as hot and its rows before have been returned

        def out(a, d, last):
            nonlocal held_a, held_d, flowing
            a, d = np.concatenate([held_a, a]), np.concatenate([held_d, d])
            if not len(a):
                return None
            new = np.ones(len(a), bool)
            new[1:] = a[1:] != a[:-1]
            fresh = new.copy()
            fresh[1:] |= d[1:] != d[:-1]
            a, d, new = a[fresh], d[fresh], new[fresh]
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, len(a)))
            many = size > hot
            keep = size > 1
            if flowing:
                many[0] = keep[0] = True
            n = len(a)
            if not last:
                end_hot = bool(many[-1])
                n = len(a) - 1 if end_hot else start[-1]  # of a hot anchor one row is enough to go on with
            row = np.repeat(keep, size)[:n]
            res = (a[:n][row], d[:n][row], np.repeat(many, size)[:n][row])
            if not last:
                held_a, held_d, flowing = a[n:], d[n:], end_hot
            return res

        for b in batches:
            if b.num_rows and (r := out(b.column(0).to_numpy(), b.column(1).to_numpy(), False)) and len(r[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in r], ["anchor", "doc_id", "hot"])
        if (r := out(held_a[:0], held_d[:0], True)) and len(r[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in r], ["anchor", "doc_id", "hot"])

    return run


def _cut(window: int, gram: int):
    """The stretches, or for hot anchors the windows, around the document's shared anchors; one that the document repeats is one row with its starts."""

    def one(c):
        doc, cold, hot = c["doc_id"].to_pylist(), c["cold"].to_pylist(), c["hot"].to_pylist()
        for at, part in pieces(c["text"]):
            out: dict[str, list] = {"key": [], "doc_id": [], "starts": [], "words": []}
            own = [i for i in range(at, at + len(part)) if cold[i] or hot[i]]
            words = [part[i - at].encode("utf-8", "surrogatepass").split() for i in own]
            s = Stretches(words, window, gram)
            bounds = np.searchsorted(s.doc, np.arange(len(own) + 1))
            for k, i in enumerate(own):
                here = slice(bounds[k], bounds[k + 1])
                anchor = s.anchor[here]
                w, base = words[k], int(s.begin[k])
                for shared, single in ((cold[i], False), (hot[i], True)):
                    if not shared or not len(anchor):
                        continue
                    held: dict[bytes, list[int]] = {}
                    keys: dict[bytes, int] = {}
                    for j in np.flatnonzero(np.isin(anchor, np.array(shared, np.int64))) + bounds[k]:
                        first, last = int(s.first[j]) - base, int(s.last[j]) - base
                        for b, e in [(x, x + window) for x in range(first, last + 1)] if single else [(first, last + window)]:
                            stretch = b" ".join(w[b:e])
                            starts = held.setdefault(stretch, [])
                            if not starts:
                                keys[stretch] = xxhash.xxh3_64_intdigest(stretch) if single else int(s.anchor[j]) & (1 << 64) - 1
                            starts.append(b)
                    for stretch, starts in held.items():
                        out["key"].append(keys[stretch])
                        out["doc_id"].append(doc[i])
                        out["starts"].append(starts)
                        out["words"].append(stretch)
            key = np.array(out["key"], np.uint64).view(np.int64)
            yield {"key": key, "doc_id": pa.array(out["doc_id"], pa.int64()), "starts": pa.array(out["starts"], pa.list_(pa.int32())), "words": pa.array(out["words"], pa.binary())}

    return one


def _match(window: int):
    """Of stretches sorted by key and doc_id: the spans that a smaller doc_id has too, word ends exclusive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = doc = None
        known: set[bytes] = set()  # stretches of smaller documents under this key
        own: dict[bytes, list[tuple[int, int]]] = {}  # this document's other stretches and their matches
        waiting: list[bytes] = []  # known, but not yet in the automaton
        automaton = None
        for b in batches:
            ids, begins, ends = [], [], []
            for k, d, starts, words in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if k != key:
                    key, doc, known, own, waiting, automaton = k, d, set(), {}, [], None
                elif d != doc:
                    doc = d
                    known.update(own)
                    waiting += own
                    own = {}
                if words in known:
                    spans = [(0, words.count(b" ") + 1)]
                elif words in own:
                    spans = own[words]
                else:
                    spans = []
                    if known:
                        automaton = automaton or Automaton()
                        for x in waiting:
                            automaton.add(x.split(b" "))
                        waiting = []
                        spans = automaton.matches(words.split(b" "), window)
                    own[words] = spans
                for x, y in spans:
                    end = -1
                    for start in starts:  # in order; spans that touch are one
                        if start + x > end:
                            ids.append(d)
                            begins.append(start + x)
                            ends.append(start + y)
                        else:
                            ends[-1] = start + y
                        end = start + y
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(begins, pa.int32()), pa.array(ends, pa.int32())], ["doc_id", "begin", "end"])

    return run


def repeated_spans(source: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id and its spans (word numbers, ends exclusive) that windows of a smaller doc_id cover; source as of texts()."""
    if not 1 <= gram <= window:
        raise ValueError("a gram has between one word and a window's")
    n = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    anchors = map_batches(source.where("doc_id is not null"), _anchors(window, gram), "anchor long, doc_id long")
    shared = anchors.repartition(n, "anchor").sortWithinPartitions("anchor", "doc_id").mapInArrow(_shared(hot), "anchor long, doc_id long, hot boolean")
    marks = shared.groupBy("doc_id").agg(F.collect_list(F.when(~F.col("hot"), F.col("anchor"))).alias("cold"), F.collect_list(F.when(F.col("hot"), F.col("anchor"))).alias("hot"))
    cut = map_batches(source.join(marks, "doc_id", "left"), _cut(window, gram), "key long, doc_id long, starts array<int>, words binary")
    spans = cut.repartition(n, "key").sortWithinPartitions("key", "doc_id").mapInArrow(_match(window), "doc_id long, begin int, end int")
    return spans.groupBy("doc_id").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))


def _kept(words: list[bytes], spans: list[dict] | None) -> list[bytes]:
    if not spans:
        return words
    gone = np.zeros(len(words) + 1, np.int32)
    np.add.at(gone, [s["begin"] for s in spans], 1)
    np.add.at(gone, [s["end"] for s in spans], -1)
    return [w for w, g in zip(words, np.cumsum(gone[:-1]).tolist(), strict=True) if not g]


def remove_repeats(docs: DataFrame, digest: bool = False, **how) -> DataFrame:
    """doc_id, n_words, n_removed and what is kept: its words joined by a space as text, or with digest their SHA-256."""
    source = texts(docs)

    def one(c):
        rows = []
        spans = c["spans"].to_pylist()
        for at, part in pieces(c["text"]):
            for i, text in enumerate(part, at):
                words = text.encode("utf-8", "surrogatepass").split()
                kept = _kept(words, spans[i])
                joined = b" ".join(kept)
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest() if digest else joined.decode("utf-8", "surrogatepass")))
        return {"doc_id": c["doc_id"]} | {k: [r[i] for r in rows] for i, k in enumerate(("n_words", "n_removed", "kept_sha256" if digest else "text"))}

    return map_batches(source.join(repeated_spans(source, **how), "doc_id", "left"), one, f"doc_id long, n_words long, n_removed long, {'kept_sha256' if digest else 'text'} string")


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), digest=True)
