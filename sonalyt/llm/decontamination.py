"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

Words are runs of a-z (A-Z lower-cased), digits and all characters beyond ASCII. An item's windows are its runs of WINDOW words, or the whole item if it
is shorter. A window is a set of shingles (GRAM words, or the window if that is shorter), each at its place. Shingles are ordered by rarity: how often
all documents hold them. A window that shares at least `need` of its S shingles with a stretch of a document shares one of its S - need + 1 rarest
with it, so only those, its prefix, are joined. The length bound (a window's stretch must end within the document) and the positional bound (a
shingle at place p of the document and o of the window puts the stretch at p - o, which can't be negative) discard candidates; the others are verified
word by word over the stretch, which is as long as the window. With share = 1 all shingles must agree, so a stretch holds the window's very words.

Documents cross the network only where they hold a prefix shingle, with WINDOW words on both sides. What tells such shingles from others in a task is
a bitmap of fixed size (two bits for each shingle among 16 million): whatever the benchmark's size, its false positives cost rows in the join and never a result.
Neither side is broadcast by hint. Windows with one text are one window, whatever the number of their items.

Nulls: a null text has no words; a null doc_id is a document like any other; an item without item_id counts for hit words and not among n_items.
Rows of one item_id are one item with the windows of each. Ties in rarity go to the smaller hash. Repeated rows give repeated rows, rows that share a
doc_id but not the text are told apart. An empty benchmark hits nothing, no documents give no rows. Very long texts are taken whole. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, table
from .wordbytes import lowered, shingles, words

WINDOW, GRAM = 10, 5
BITS = 24  # of a place in the bitmap
SEPARATORS = lowered([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])


def _plain(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias(key), F.col("text").cast("string").alias("text"))


def _item_windows(window: int, gram: int):
    """For each window of an item: its words, and for each of its shingles the place and the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            for at, w in words(b.column(1), SEPARATORS):
                out: dict[str, list] = {k: [] for k in ("item_id", "said", "places", "hashes", "gram")}
                edges = np.searchsorted(w.row, np.arange(w.texts + 1))
                for i, (s, e) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True), at):
                    if s == e:
                        continue
                    size = min(window, e - s)
                    g = min(gram, size)
                    part = type(w)(w.low, w.begin[s:e], w.end[s:e], w.row[s:e], 1, w.hash[s:e])
                    hashes = shingles(part, g)[1].view(np.int64).tolist()
                    for q in range(e - s - size + 1):
                        out["item_id"].append(ids[i])
                        out["said"].append(part.said(q, q + size).decode())
                        out["places"].append(list(range(size - g + 1)))
                        out["hashes"].append(hashes[q : q + size - g + 1])
                        out["gram"].append(g)
                yield pa.RecordBatch.from_arrays([pa.array(out["item_id"], pa.int64()), pa.array(out["said"], pa.string()), pa.array(out["places"], pa.list_(pa.int32())), pa.array(out["hashes"], pa.list_(pa.int64())), pa.array(out["gram"], pa.int32())], list(out))

    return run


def _bits(h: Column) -> Column:
    """The two places of a hash in the bitmap."""
    return F.array(F.shiftrightunsigned(h, 64 - BITS), F.shiftrightunsigned(h, 16).bitwiseAND((1 << BITS) - 1))


def _bitmap(hashes: DataFrame) -> bytes:
    """The bitmap of a column `hash`: 2 to the BITS bits, at most 2 MB, whatever the number of rows."""
    place = hashes.select(F.explode(_bits(F.col("hash"))).alias("place"))
    parts = place.groupBy(F.shiftright("place", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("place").bitwiseAND(32767)).alias("bits"))
    whole = bytearray(1 << (BITS - 3))
    for part, bits in parts.collect():
        whole[part << 12 : (part + 1) << 12] = bits
    return bytes(whole)


def _marked(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the hashes the bitmap holds, as numbers of their places."""
    a = h >> np.uint64(64 - BITS)
    found = np.flatnonzero(bitmap[a >> np.uint64(3)] >> (a & np.uint64(7)).astype(np.uint8) & 1)
    b = h[found] >> np.uint64(16) & np.uint64((1 << BITS) - 1)
    return found[(bitmap[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8) & 1) > 0]


def _counts(bitmap, grams: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, np.uint8)
        for b in batches:
            for _, w in words(b.column(0), SEPARATORS):
                for g in grams:
                    h = shingles(w, g)[1]
                    h, n = np.unique(h[_marked(bits, h)], return_counts=True)
                    if len(h):
                        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["hash", "n"])

    return run


SEEN = "doc_id long, mark long, n_words long, hash long, place int, before int, said string"


def _seen(bitmap, grams: list[int], window: int):
    """A row for each document (hash null), and for each place where it may hold a prefix shingle, with the words around it."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
    names = [x.split()[0] for x in SEEN.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, np.uint8)
        for b in batches:
            ids, texts = b.column(0), b.column(1).cast(pa.large_string())
            for at, w in words(texts, SEPARATORS):
                marks = [xxhash.xxh3_64_intdigest(t.encode()) - (1 << 63) if t else 0 for t in texts.slice(at, w.texts).to_pylist()]
                doc = ids.slice(at, w.texts).to_pylist()
                edges = np.searchsorted(w.row, np.arange(w.texts + 1))
                many = np.diff(edges).tolist()
                rows = [(doc[i], marks[i], many[i], None, None, None, None) for i in range(w.texts)]
                for g in grams:
                    first, h = shingles(w, g)
                    for k in _marked(bits, h).tolist():
                        i, p = int(w.row[first[k]]), int(first[k])
                        s, e = max(int(edges[i]), p - window + 1), min(int(edges[i + 1]), p + window)
                        rows.append((doc[i], marks[i], many[i], int(h[k : k + 1].view(np.int64)[0]), p - int(edges[i]), p - s, w.said(s, e).decode()))
                        if len(rows) >= 50_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


class Found:
    """docs: doc_id, mark, n_words of every document; hits: doc_id, mark, begin, stop (word numbers, stop exclusive), window; items: window, item_id."""

    def __init__(self, docs: DataFrame, hits: DataFrame, items: DataFrame):
        self.docs, self.hits, self.items = docs, hits, items


def find(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, share: float = 1.0) -> Found:
    """All stretches of docs (doc_id, text) that hold a window of items (item_id, text): at least `share` of its shingles, each at its place."""
    if not (1 <= gram <= window and 0 < share <= 1):
        raise ValueError("a shingle has between one word and a window's, share is above 0 and at most 1")
    spark = docs.sparkSession
    docs = _plain(docs, "doc_id")
    each = cut(_plain(items, "item_id").mapInArrow(_item_windows(window, gram), "item_id long, said string, places array<int>, hashes array<long>, gram int"))
    own = cut(each.groupBy("said").agg(F.first("places").alias("places"), F.first("hashes").alias("hashes"), F.first("gram").alias("gram")).withColumn("window", F.unhex(F.sha2("said", 256))))
    grams = [r[0] for r in own.select("gram").distinct().sort("gram").collect()]
    held = own.select("window", F.explode(F.arrays_zip("places", "hashes")).alias("x")).select("window", F.col("x.places").alias("o"), F.col("x.hashes").alias("hash"))
    bitmap = spark.sparkContext.broadcast(_bitmap(held.select("hash").distinct()))
    counted = docs.select("text").mapInArrow(_counts(bitmap, grams), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    rare = held.join(counted, "hash", "left").groupBy("window").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "hash", "o"))).alias("order"))
    need = F.ceil(F.size("order") * F.lit(share) - 1e-9)
    prefix = rare.withColumn("need", need).select("window", "need", F.explode(F.slice("order", 1, F.size("order") - F.col("need").cast("int") + 1)).alias("x"))
    prefix = prefix.where("x.n > 0").select("window", "need", F.col("x.hash").alias("hash"), F.col("x.o").alias("o")).join(own.select("window", F.split("said", " ").alias("words"), F.size("hashes").alias("many"), "gram"), "window")
    prefix = cut(prefix)
    bitmap = spark.sparkContext.broadcast(_bitmap(prefix.select("hash").distinct()))
    seen = cut(docs.mapInArrow(_seen(bitmap, grams, window), SEEN))
    near = seen.where("hash is not null").select("doc_id", "mark", "hash", "place", "before", F.split("said", " ").alias("around")).join(prefix, "hash")
    near = near.where("before >= o and before - o + size(words) <= size(around)").withColumn("stretch", F.expr("slice(around, before - o + 1, size(words))"))
    same = near.where("size(filter(sequence(1, many), j -> slice(stretch, j, gram) = slice(words, j, gram))) >= need")
    hits = same.select("doc_id", "mark", (F.col("place") - F.col("o")).alias("begin"), (F.col("place") - F.col("o") + F.size("words")).alias("stop"), "window").distinct()
    owners = each.where("item_id is not null").select(F.unhex(F.sha2("said", 256)).alias("window"), "item_id").distinct()
    return Found(seen.where("hash is null").select("doc_id", "mark", "n_words"), cut(hits), owners)


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["mark"] == b["mark"])


def report(found: Found) -> DataFrame:
    """One row per document: doc_id, mark, n_words, n_hit, n_items, items_sha256, contaminated."""
    spans = found.hits.select("doc_id", "mark", "begin", "stop").distinct()
    earlier = "max(stop) over (partition by doc_id, mark order by begin, stop rows between unbounded preceding and 1 preceding)"
    hit = spans.withColumn("reached", F.expr(earlier)).groupBy("doc_id", "mark").agg(F.sum(F.greatest(F.lit(0), F.col("stop") - F.greatest("begin", F.coalesce("reached", F.lit(0))))).alias("n_hit"))
    named = found.hits.select("doc_id", "mark", "window").distinct().join(found.items, "window").select("doc_id", "mark", "item_id").distinct()
    named = named.groupBy("doc_id", "mark").agg(F.count("*").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort(F.collect_list(F.col("item_id").cast("string")))), 256).alias("items_sha256"))
    both = found.docs.join(hit, _same(found.docs, hit), "left").select(found.docs["*"], "n_hit")
    return both.join(named, _same(both, named), "left").select(
        both["doc_id"], both["mark"], "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def passages(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """doc_id, item_id, begin, stop: each stretch (word numbers, stop exclusive) with the item whose window it holds."""
    found = find(docs, items, **how)
    return found.hits.join(found.items, "window").select("doc_id", "item_id", "begin", "stop").distinct()


def decontaminated(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The rows of docs whose doc_id has no stretch that holds a window of items. Rows that share a doc_id go together, so do rows without one."""
    key = fresh(docs, "hit_doc")
    hit = find(docs, items, **how).hits.select(F.col("doc_id").alias(key)).distinct()
    return docs.join(hit, F.col("doc_id").cast("long").eqNullSafe(F.col(key)), "left_anti")


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))).drop("mark")
