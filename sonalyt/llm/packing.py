"""Best-fit packing of tokenised documents by minimum bin slack.

Bins are planned on the histogram of piece lengths, which has at most as many entries as a bin has places: for a bin, a subset-sum
dynamic program over the available lengths (bitsets) finds the fullest combination that fits beside the longest piece
left, and the combination is taken as often as the counts allow, which is what one bin after another would do. The pieces
themselves stay in Spark: each gets its rank among those of its length, counted in salted groups, and the plan turns a
rank into a sequence and an offset. A plan has a few thousand rows whatever the input, so it is broadcast.

Nulls: a null or empty text is one piece that holds the end mark alone. Repeated rows are packed each. Ties: pieces of one length are
alike and go in order of doc_id, piece, start within a salt; which of them shares a bin with which others is of no account. Very long texts are
tokenised whole. Empty table: empty result. Other columns aren't read.
"""

from __future__ import annotations

import base64
import struct
import zlib
from functools import cache

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import cut, map_batches, pieces, table, texts

LENGTH, END = 2048, 0
CHUNKS = 250_000  # chunks whose ids a worker remembers
VOCABULARY = "byte_bpe_50k"


@cache
def _tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


class Ids(dict):
    """The ids of a text as little-endian 32-bit integers, put together from those of its chunks.

    A chunk is what stands between single spaces, with the space before it. Its ids don't depend on its neighbours as the pre-tokeniser
    begins a piece at such a space, unless white space stands at the chunk's edge or the chunk is empty; a text with such a chunk,
    or with the special token's name, goes to the tokenizer whole. The rank file holds the same vocabulary and is the
    faster way to encode a chunk.
    """

    def __init__(self, path: str, ranks: str):
        super().__init__()
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.path = path

    def __missing__(self, chunk: str) -> bytes | None:
        if len(self) >= CHUNKS:
            self.clear()
        edge = not chunk or chunk[0].isspace() or chunk[-1].isspace()
        ids = None if edge else struct.pack(f"<{len(x := self.encode(' ' + chunk))}I", *x)
        self[chunk] = ids
        return ids

    def of(self, text: str) -> bytes:
        if not text:
            return b""
        if "<|" not in text:
            first, *rest = text.split(" ")
            if first and not first[-1].isspace():
                try:
                    x = self.encode(first)
                    return struct.pack(f"<{len(x)}I", *x) + b"".join(map(self.__getitem__, rest))
                except TypeError:  # a chunk that depends on its neighbours
                    pass
        x = _tokenizer(self.path).encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(x)}I", *x)


@cache
def _ids(path: str, ranks: str) -> Ids:
    return Ids(path, ranks)


def cut_up(docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: documents above length are cut so that all pieces but the first are full."""
    path, ranks = public_tokenizers.path(f"{vocabulary}.json"), public_tokenizers.path(f"{vocabulary}.tiktoken")
    end = struct.pack("<I", END)

    def one(c):
        ids, out = _ids(path, ranks), {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        doc = c["doc_id"].to_pylist()
        for at, part in pieces(c["text"]):
            for i, text in enumerate(part, at):
                raw = ids.of(text) + end
                n = len(raw) // 4
                stops = range((n - 1) % length + 1, n + 1, length)
                begin = 0
                for k, stop in enumerate(stops):
                    for name, v in (("doc_id", doc[i]), ("piece", k), ("start", begin), ("length", stop - begin), ("ids_crc32", zlib.crc32(raw[4 * begin : 4 * stop]))):
                        out[name].append(v)
                    begin = stop
        return out | {"piece": np.array(out["piece"], np.int32)}

    return map_batches(texts(docs), one, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(room: int, counts: dict[int, int]) -> list[int]:
    """Lengths, at most counts of each, whose sum is the largest that fits in room; longer ones are preferred."""
    lengths = [x for x in sorted(counts, reverse=True) if x <= room and counts[x] > 0]
    states, reach, limit = [], 1, (1 << (room + 1)) - 1
    for x in lengths:
        states.append(reach)
        for _ in range(min(counts[x], room // x)):
            more = (reach | reach << x) & limit
            if more == reach:
                break
            reach = more
        if reach >> room & 1:
            break
    left, taken = reach.bit_length() - 1, []
    for x, before in zip(reversed(lengths[: len(states)]), reversed(states), strict=True):
        while not before >> left & 1:
            taken.append(x)
            left -= x
    return taken


def plan(counts: dict[int, int], length: int = LENGTH) -> list[tuple[int, int, int, int, int, int]]:
    """(length, from rank, to rank, times in a bin, first bin, first offset) that place all pieces of the histogram."""
    left, used = dict(counts), dict.fromkeys(counts, 0)
    out, bins = [], 0
    while left:
        seed = max(left)
        rest = left | {seed: left[seed] - 1}
        combination = [seed, *fullest(length - seed, rest)]
        times: dict[int, int] = {}
        for x in combination:
            times[x] = times.get(x, 0) + 1
        often = min(left[x] // k for x, k in times.items())
        offset = 0
        for x, k in times.items():
            out.append((x, used[x], used[x] + k * often, k, bins, offset))
            offset += k * x
            used[x] += k * often
            left[x] -= k * often
            if not left[x]:
                del left[x]
        bins += often
    return out


def place(cut_pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """The pieces (as of cut_up(), materialised) with sequence_id and offset."""
    spark = cut_pieces.sparkSession
    groups = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = cut_pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    counted = salted.groupBy("length", "salt").count()
    before = counted.select("length", "salt", (F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before"))
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `length` rows
    bins = spark.createDataFrame(plan(histogram, length), "p_length long, lo long, hi long, times long, bin long, first long")
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start")) - 1
    ranked = salted.withColumn("rank", rank).join(before, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    at = F.col("rank") - F.col("lo")
    placed = ranked.join(F.broadcast(bins), (F.col("length") == F.col("p_length")) & F.col("rank").between(F.col("lo"), F.col("hi") - 1))
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("bin") + F.floor(at / F.col("times"))).alias("sequence_id"), (F.col("first") + F.pmod(at, F.col("times")) * F.col("length")).alias("offset")
    )


def pack(docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY) -> DataFrame:
    return place(cut(cut_up(docs, length, vocabulary)), length)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
