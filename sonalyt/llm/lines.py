"""Line dedup by pairwise alignment.

Long lines are hashed: of at least WORDS words by any white space, or with a run of 5 x WORDS characters, or of 2 x WORDS characters of
scripts without spaces. Shorter and blank lines are hashed with all lines from the long line before them, and again with all up to the long
line after them, so they go as members of a common block that holds a long line, never alone. In a text without long lines
each line is hashed with the whole text, so only copies lose them. A hash stands for a line in what follows. A line that several documents hold pairs each later document with the line's first holder (the
smallest doc_id), so a line in n documents makes n-1 pairs, not all of them, and no cap on a line's documents is
needed. The few lines that do not align with their first holder's are then held against their other earlier holders, on all lines of
the pair, until one aligns or none is left: no line stays that aligning all overlapping pairs would delete. For a pair, the positions of the lines shared this way meet in one
task, which aligns them as patience diff does: lines that either document holds once, as far as they stand in the same order
(longest increasing sequence), then again between those, then repeated lines in order. Aligned lines are deleted
from the later document, by both position and text.

Nulls: a null text has no lines. A row without doc_id is neither paired nor judged. Repeated rows of one doc_id are one document.
Equal doc_ids never pair, so lines repeated within one document stay. Ties: of alignments of equal length the one that ends on the smallest places.
Very long texts are split whole, some million bytes at a time. Empty table: empty result. Other columns stay as they are, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache, reduce
from math import isqrt
from operator import or_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, map_batches, pieces, table, texts

WORDS = 4
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")  # Thai, Lao, Burmese, Khmer, kana, Han
STEP = 8  # holders that a line left over is held against in the first round; each round takes as many times more


def _long(line: str, words: int) -> bool:
    """At least so many words by any white space, a run of five times as many characters, or twice as many of scripts without spaces."""
    parts = line.split(None, words)
    if len(parts) >= words:
        return True
    return bool(line) and (max(map(len, parts)) >= 5 * words or (not line.isascii() and len(_UNSPACED.findall(line)) >= 2 * words))


def _hash(line: str, before: int | None = None, way: bytes = b"") -> int:
    data = line.encode("utf-8", "surrogatepass")
    return xxhash.xxh3_64_intdigest(data if before is None else way + before.to_bytes(8, "little") + data)


def _around(lines: list[str], anchors: list[int | None], ks: range, way: bytes, held: dict[int, list[int]]) -> None:
    """Shorter lines by the anchor before them in the direction of ks and all lines from there."""
    run, blank = None, 0
    for k in ks:
        if anchors[k] is not None:
            run, blank = anchors[k], 0
        elif run is not None:
            if lines[k]:
                run, blank = _hash(lines[k], run, way), 0
                held.setdefault(run, []).append(k)
            else:
                blank += 1  # blank lines do not part a block
                held.setdefault(_hash(f"\n{blank}", run, way), []).append(k)


def _held(text: str, words: int) -> dict[int, list[int]]:
    """Hashes that stand for the lines of a text, with their places."""
    lines = [line.strip() for line in text.split("\n")]
    held: dict[int, list[int]] = {}
    anchors = [_hash(line) if _long(line, words) else None for line in lines]
    some = [k for k, x in enumerate(anchors) if x is not None]
    if not some:
        if any(lines):
            whole = _hash("\n".join(lines), 0, b"w")
            for k in range(len(lines)):
                held[_hash(str(k), whole, b"w")] = [k]
        return held
    for k in some:
        held.setdefault(anchors[k], []).append(k)
    if len(some) < len(lines):
        _around(lines, anchors, range(len(lines)), b"f", held)
        _around(lines, anchors, range(len(lines) - 1, -1, -1), b"b", held)
        for places in held.values():
            places.sort()
    return held


def _lines(words: int):
    def one(c):
        out: dict[str, list] = {"line": [], "doc_id": [], "at": []}
        doc = c["doc_id"].to_pylist()
        for at, part in pieces(c["text"]):
            for i, text in enumerate(part, at):
                for line, places in _held(text, words).items():
                    out["line"].append(line)
                    out["doc_id"].append(doc[i])
                    out["at"].append(places)
        return {"line": np.array(out["line"], np.uint64).view(np.int64), "doc_id": pa.array(out["doc_id"], pa.int64()), "at": pa.array(out["at"], pa.list_(pa.int32()))}

    return one


def _increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    back = []
    for i, v in enumerate(values):
        p = bisect_left(tops, v)
        back.append(piles[p - 1] if p else -1)
        if p == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[p], piles[p] = v, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def _repeated(lines: list[tuple[list[int], list[int]]]) -> list[tuple[int, int]]:
    """A longest run of pairs in order between lines of which none stands once on both sides; of several the one that ends on the smallest places.

    A row of the table of run lengths is the bits of one integer (a bit is 0 where the length grows), so no pair of places is listed. Every so manyth row is
    kept and the rows between two of those are worked out again on the way back: memory grows with the places of one document times the root of the other's."""
    xs, ys = sorted({x for a, _ in lines for x in a}), sorted({y for _, b in lines for y in b})
    place = {x: k for k, x in enumerate(xs)}
    said: dict[int, list[int]] = {}
    for k, (_, b) in enumerate(lines):
        for y in b:
            said.setdefault(y, []).append(k)
    full, every = (1 << len(xs)) - 1, isqrt(len(ys)) + 1

    @lru_cache(max(16, (1 << 26) // (len(xs) + 8)))
    def mask(k: int) -> int:
        bits = bytearray(len(xs) // 8 + 1)
        for x in lines[k][0]:
            bits[place[x] >> 3] |= 1 << (place[x] & 7)
        return int.from_bytes(bits, "little")

    def rows(first: int, row: int) -> list[int]:
        """The rows after line `first` of the later document and the lines that follow it up to the next one kept."""
        out = []
        for y in ys[first : first + every]:
            hit = reduce(or_, map(mask, said[y]))
            row = (row + (row & hit) | row & ~hit) & full
            out.append(row)
        return out

    kept = [full]
    for first in range(0, len(ys), every):
        kept.append(rows(first, kept[-1])[-1])
    out, i, j, first, block = [], len(xs), len(ys), len(ys), []

    def row(j: int) -> int:
        nonlocal first, block
        if not j:
            return full
        if not first <= j - 1 < first + len(block):
            first = (j - 1) // every * every
            block = rows(first, kept[first // every])
        return block[j - 1 - first]

    while j:
        grown = ~row(j) & ((1 << i) - 1)
        if not grown:
            break
        i = grown.bit_length()
        low, length = (1 << i) - 1, grown.bit_count()
        while (~row(j - 1) & low).bit_count() == length:
            j -= 1
        i, j = i - 1, j - 1
        out.append((xs[i], ys[j]))
    return out[::-1]


def align(lines: list[tuple[list[int], list[int]]]) -> list[tuple[int, int]]:
    """Pairs of aligned places; lines: for each shared line its places in the earlier and in the later document, in order."""
    out: list[tuple[int, int]] = []
    work = [lines]
    while work:
        here = work.pop()
        once = sorted({(b[0], -a[0]) for a, b in here if len(a) == len(b) == 1})  # a place that two hashes stand for is taken once
        fixed = [(once[i][0], -once[i][1]) for i in _increasing([-a for _, a in once])]
        if not fixed:
            out += _repeated(here)
            continue
        out += [(a, b) for b, a in fixed]
        edges = [a for _, a in fixed], [b for b, _ in fixed]
        gaps: dict[int, list[tuple[list[int], list[int]]]] = {}
        for both in here:
            if len(both[0]) > 1 or len(both[1]) > 1:  # what else is left stands between the fixed lines, gap by gap
                own: dict[int, tuple[list[int], list[int]]] = {}
                for side in (0, 1):
                    for x in both[side]:
                        gap = bisect_left(edges[side], x)
                        if gap == len(edges[side]) or edges[side][gap] != x:
                            own.setdefault(gap, ([], []))[side].append(x)
                for gap, (a, b) in own.items():
                    if a and b:
                        gaps.setdefault(gap, []).append((a, b))
        work += gaps.values()
    return out


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by first and doc_id: one document's shared lines with one earlier document at a time.

    Rows without a line hold the places that align, rows with a line its places that don't."""
    key, lines, names = None, [], []

    def judged():
        if lines:
            gone = {y for _, y in align(lines)}
            yield key[1], None, sorted(gone)
            for name, (_, places) in zip(names, lines, strict=True):
                left = [y for y in places if y not in gone]
                if left:
                    yield key[1], name, left

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.list_(pa.int32())), strict=True)], ["doc_id", "line", "places"])

    for b in batches:
        rows = []
        for line, first, doc, a, y in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if (first, doc) != key:
                rows += judged()
                key, lines, names = (first, doc), [], []
            lines.append((a, y))
            names.append(line)
        if rows:
            yield batch(rows)
    rows = list(judged())
    if rows:
        yield batch(rows)


def _aligned(shared: DataFrame) -> DataFrame:
    """shared: line, first, doc_id, first_at, at."""
    n = int(shared.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = shared.select("line", "first", "doc_id", "first_at", "at").repartition(n, "first", "doc_id").sortWithinPartitions("first", "doc_id")
    return cut(rows.mapInArrow(_pairs, "doc_id long, line long, places array<int>"))


def _without(left: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of left (doc_id, line, place) whose place is not among those that aligned."""
    own = found.where("line is null").join(left.select("doc_id").distinct(), "doc_id", "left_semi")
    return left.join(own.select("doc_id", F.explode("places").alias("place")), ["doc_id", "place"], "left_anti").select("doc_id", "line", "place")


def _others(shared: DataFrame, left: DataFrame) -> list[DataFrame]:
    """(doc_id, places) of lines left over that align with another earlier holder than the first.

    A line left over is held against every earlier holder until it aligns, STEP times as many in each round, over all lines
    that the two documents share. Documents with the same shared lines in the same order align in full and alike, so the
    smallest doc_id among them stands for all. A holder whose own line is gone counts too: of A B C, C A B and B C A the
    last one's A aligns only with the second one's, which the first one's took.
    """
    holders = shared.join(left.select("line").distinct(), "line").select("line", "doc_id")
    order = shared.join(holders.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "line", F.explode("at").alias("place"))
    order = order.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("o")).select("doc_id", F.xxhash64(F.transform("o", lambda x: x.line)).alias("o"))
    order = cut(order.join(order.groupBy("o").agg(F.min("doc_id").alias("same")), "o").select("doc_id", "same"))
    gone = [left.join(order.where("same < doc_id"), "doc_id").groupBy("doc_id").agg(F.collect_set("place").alias("places"))]
    left = cut(left.join(order.where("same = doc_id"), "doc_id").select("doc_id", "line", "place"))
    tries = cut(holders.join(order.where("same = doc_id"), "doc_id").select("line", F.col("doc_id").alias("first")))
    rank = F.pmod(F.xxhash64("line", "first"), F.col("n"))  # about as many holders for each rank, without sorting those of a hot line
    tries = cut(tries.join(tries.groupBy("line").agg(F.count("*").alias("n")), "line").select("line", "first", rank.alias("rank")))
    low, high = 0, STEP
    while True:
        ahead = left.join(tries, "line").where(f"first < doc_id and rank >= {low}")
        if ahead.isEmpty():
            return gone
        pairs = ahead.where(f"rank < {high}").select("first", "doc_id").distinct()
        later = pairs.join(shared.select("doc_id", "line", "at"), "doc_id")
        found = _aligned(later.join(shared.select(F.col("doc_id").alias("first"), "line", F.col("at").alias("first_at")), ["first", "line"]))
        gone.append(found.where("line is null").select("doc_id", "places"))
        left = cut(_without(left, found))
        low, high = high, high * STEP


def aligned_lines(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and the numbers of its lines that align with an earlier document's, for documents that have any."""
    held = map_batches(texts(docs).where("doc_id is not null"), _lines(words), "line long, doc_id long, at array<int>")
    firsts = held.groupBy("line").agg(F.min(F.struct("doc_id", "at")).alias("f"), F.max("doc_id").alias("last")).where("f.doc_id < last")
    firsts = cut(firsts.select("line", F.col("f.doc_id").alias("first"), F.col("f.at").alias("first_at")))
    shared = cut(held.join(firsts, "line").select("line", "doc_id", "at", "first", "first_at"))
    found = _aligned(shared.where("first < doc_id"))
    gone = [found.where("line is null").select("doc_id", "places")]
    left = cut(_without(found.where("line is not null").select("doc_id", "line", F.explode("places").alias("place")), found))
    if not left.isEmpty():
        gone += _others(shared, left)
    return reduce(DataFrame.union, gone).groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("gone"))


def _kept(gone: list[int] | None, text: str) -> str:
    if not gone:
        return text
    drop = set(gone)
    return "\n".join(line for i, line in enumerate(text.split("\n")) if i not in drop)


def remove_lines(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """docs without the aligned lines; a document whose every line with a letter or digit is gone is dropped, as earlier documents hold all of it."""

    @F.pandas_udf("string")
    def kept(text, gone):
        return text.combine(gone, lambda t, g: t if t is None else _kept(None if g is None else g.tolist(), t))

    key, gone, left = (fresh(docs, x) for x in ("aligned_doc", "aligned_gone", "aligned_left"))
    both = docs.join(aligned_lines(docs, words).select(F.col("doc_id").alias(key), F.col("gone").alias(gone)), F.col("doc_id").cast("long") == F.col(key), "left")
    whole = F.col(gone).isNull()
    with_text = both.withColumn(left, F.when(whole, F.col("text")).otherwise(kept("text", gone))).where(whole | F.col(left).rlike(r"[\p{L}\p{N}]"))
    columns = {"text": F.col(left)} | ({"n_chars": F.when(whole, F.col("n_chars")).otherwise(F.length(left).cast(docs.schema["n_chars"].dataType))} if "n_chars" in docs.columns else {})
    return with_text.select(*[columns[x].alias(x) if x in columns else F.col(x) for x in docs.columns])


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 of every document."""
    docs = texts(table(spark, sf_dir, "documents"))

    def one(c):
        rows = []
        gone = c["gone"].to_pylist()
        for at, part in pieces(c["text"]):
            for i, text in enumerate(part, at):
                rows.append((text.count("\n") + 1 if text else 0, len(gone[i] or ()), hashlib.sha256(_kept(gone[i], text).encode("utf-8", "surrogatepass")).hexdigest()))
        return {"doc_id": c["doc_id"]} | {k: [r[i] for r in rows] for i, k in enumerate(("n_lines", "n_removed", "kept_sha256"))}

    return map_batches(docs.join(aligned_lines(docs), "doc_id", "left"), one, "doc_id long, n_lines long, n_removed long, kept_sha256 string")
