"""Merkle manifest of a table of documents, with proofs by octopus multiproofs.

Each row is a leaf: SHA-256 over its fields, each with its length. The leaves of a language form a binary tree by ascending doc_id, the languages'
subroots another one above them; a run of one node is hashed by itself. Digests are lowercase hex text wherever they are hashed.

Leaves are numbered by a range partitioning and each partition's counts, so no language is sorted in one task. A leaf partition is PART leaves in a
row, aligned, so what lies under its own root is derived from its leaves alone and never stored; only nodes from there up are, a few for each partition.
A partition works out the coordinates of the nodes that its leaves' proofs miss (siblings at each level that its known nodes don't give, in its language's tree
and in the tree of languages), each once; one join fetches them; the partition then derives the interiors that its leaves share and
expands the proof of each leaf.

Nulls: a null field counts as such in its leaf ("-"), a null language is a language of its own and comes first, a null doc_id comes first in its
language and is never tampered with. Ties and repeated rows: rows that share a doc_id are leaves of their own, ordered by leaf. Very long texts are hashed
whole. An empty table has no rows and no root. One row: its leaf is subroot and root. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, stored, table

PART = 12  # a leaf partition has 2 to the PART leaves
TOP = "*"  # the tree of languages; a language's tree has its name after a plus, that of null is empty
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: bytes) -> bytes:
    """H of hex digests, as hex."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def leaf(**changed: Column) -> Column:
    """H of a row's fields, as bytes."""
    said = [changed.get(c, F.col(c)).cast("string") for c in FIELDS]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in said]), 256))


def height(n: int) -> int:
    """Levels from n leaves up to their root."""
    return max(n - 1, 0).bit_length()


def climb(nodes: list[bytes], levels: int) -> list[list[bytes]]:
    """The nodes (hex) and so many levels above them."""
    out = [nodes]
    for _ in range(levels):
        nodes = [digest(*nodes[k : k + 2]) for k in range(0, len(nodes), 2)]
        out.append(nodes)
    return out


def missing(known: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Of a tree of n leaves: (level, place) of the nodes that the proofs of the known leaves need and that don't follow from those leaves."""
    out, level = [], 0
    while n > 1:
        sibling = known ^ 1
        out += [(level, int(x)) for x in np.setdiff1d(sibling[sibling < n], known)]
        known, n, level = np.unique(known >> 1), (n + 1) // 2, level + 1
    return out


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with their number in their tree (i, from 0) and its size (n); stored, so that the numbers stay. Rows alike in order take numbers at will."""
    tie = "numbered_tie"
    sorted_rows = rows.withColumn(tie, F.rand(7)).repartitionByRange("tree", *order, tie).sortWithinPartitions("tree", *order, tie).drop(tie)
    placed = stored(sorted_rows.withColumn("at", F.monotonically_increasing_id()).withColumn("run", F.shiftright("at", 33)))
    runs = placed.groupBy("tree", "run").agg(F.count("*").alias("many"), F.min("at").alias("first"))
    of = Window.partitionBy("tree")
    before = F.coalesce(F.sum("many").over(of.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("tree", "run", (before - F.col("first")).alias("shift"), F.sum("many").over(of).alias("n"))
    return placed.join(runs, ["tree", "run"]).withColumn("i", F.col("at") + F.col("shift")).drop("at", "run", "shift")


NODES = "tree string, level int, x long, n long, digest binary"


def _above(level: int, whole: bool):
    """For a group of nodes of one level: the nodes up to PART levels above them, or only the highest of those. n: a node's tree has so many at its level."""

    def fn(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows["x"].to_numpy())
        n, first, own = rows["n"][0].as_py(), int(rows["x"].to_numpy().min()), rows["digest"].to_pylist()
        levels = climb([own[k].hex().encode() for k in order], min(PART, height(n)))
        out = [(level + k, (first >> k) + x, -(-n // (1 << k)), bytes.fromhex(h.decode())) for k, hs in enumerate(levels) if k == len(levels) - 1 or (whole and k) for x, h in enumerate(hs)]
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
        cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
        return pa.Table.from_arrays([pa.array([rows["tree"][0].as_py()] * len(out), pa.string()), *cols], ["tree", "level", "x", "n", "digest"])

    return fn


def nodes(leaves: DataFrame, low: bool = False) -> DataFrame:
    """The stored nodes of trees whose leaves are (tree, i, n, digest): from the roots of leaf partitions, or with `low` from the leaves, up to the trees' roots."""
    part = leaves.select("tree", F.lit(0).alias("level"), F.col("i").alias("x"), "n", "digest")
    level = 0 if low else PART
    every = roots = cut(part if low else part.groupBy("tree", F.shiftright("x", PART).alias("part")).applyInArrow(_above(0, False), NODES))
    while not (below := roots.where(f"level = {level} and n > 1")).isEmpty():
        roots = cut(below.groupBy("tree", F.shiftright("x", PART).alias("part")).applyInArrow(_above(level, True), NODES))
        every, level = every.union(roots), level + PART
    return every


class Manifest:
    """leaves: tree, doc_id, leaf and what else was given, i, n; nodes: tree, level, x, n, digest. A tree's node with n = 1 is its root."""

    def __init__(self, leaves: DataFrame, nodes: DataFrame):
        self.leaves, self.nodes = leaves, nodes

    def root(self) -> str | None:
        """The digest of the whole table."""
        found = self.nodes.where((F.col("tree") == TOP) & (F.col("n") == 1)).select(F.lower(F.hex("digest"))).first()
        return found and found[0]


def manifest(docs: DataFrame, **more: Column) -> Manifest:
    """more: columns that the leaves carry along."""
    rows = docs.select(F.coalesce(F.concat(F.lit("+"), F.col("lang").cast("string")), F.lit("")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf().alias("leaf"), *[c.alias(k) for k, c in more.items()])
    leaves = cut(numbered(rows, ["doc_id", "leaf"]))
    own = nodes(leaves.select("tree", "i", "n", F.col("leaf").alias("digest")))
    subroots = own.where("n = 1").select(F.lit(TOP).alias("tree"), F.col("tree").alias("name"), "digest")
    top = nodes(numbered(subroots, ["name"]), low=True)
    return Manifest(leaves, own.unionByName(top))


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows: a leaf partition (tree, part, n), and the place and number of its tree among all trees. The coordinates that it asks for, roots included."""
    for b in batches:
        out = []
        for tree, part, n, g, trees in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
            held = np.arange(part << PART, min(n, (part + 1) << PART))
            own = [*missing(held, n), (height(n), 0)]
            above = [*missing(np.array([g]), trees), (height(trees), 0)]
            out += [(tree, part, tree, level, x) for level, x in own if level >= PART or level == height(n)] + [(tree, part, TOP, level, x) for level, x in above]
        if out:
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["of", "part", "tree", "level", "x"])


def _way(levels: int, first: int, n: int, at: int, known: dict[tuple[int, int], bytes]) -> list[tuple[bool, bytes | None]]:
    """From a node up: for each of `levels` levels whether the sibling is on the left, and the sibling if the run has one. n: nodes at level `first`."""
    out = []
    for level in range(first, first + levels):
        out.append((at & 1 == 1, known[level, at ^ 1] if at ^ 1 < n else None))
        at, n = at >> 1, (n + 1) // 2
    return out


def fold(node: bytes, way: list[tuple[bool, bytes | None]]) -> bytes:
    for left, sibling in way:
        node = digest(node) if sibling is None else digest(sibling, node) if left else digest(node, sibling)
    return node


PROVEN = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, siblings array<string>"


def _proven(siblings: bool):
    def fn(leaves: pa.Table, fetched: pa.Table) -> pa.Table:
        names = [x.split()[0] for x in PROVEN.split(", ")]
        if not leaves.num_rows:
            return pa.table({k: [] for k in names})
        order = np.argsort(leaves["i"].to_numpy())
        leaves = leaves.take(pa.array(order))
        n, first, g, trees = (leaves[c][0].as_py() for c in ("n", "i", "g", "trees"))
        known: tuple[dict, dict] = {}, {}
        for top, level, x, h in zip(*(fetched[c].to_pylist() for c in ("top", "level", "x", "digest")), strict=True):
            known[top][level, x] = h.hex().encode()
        own = [h.hex().encode() for h in leaves["leaf"].to_pylist()]
        inside = min(PART, height(n))
        levels = climb(own, inside)
        above = _way(height(n) - inside, inside, -(-n // (1 << inside)), first >> inside, known[0]) + _way(height(trees), 0, trees, g, known[1])
        shared = [s for _, s in above if s]
        honest = fold(levels[-1][0], above)  # what every leaf that is as it was gives, through the interiors they share
        subroot, root = known[0][height(n), 0], known[1][height(trees), 0]
        out: dict[str, list] = {k: [] for k in names}
        for k, (doc, h, other) in enumerate(zip(leaves["doc_id"].to_pylist(), own, leaves["other"].to_pylist(), strict=True)):
            below = [(k >> j & 1 == 1, levels[j][k >> j ^ 1] if k >> j ^ 1 < len(levels[j]) else None) for j in range(inside)]
            proof = [s for _, s in below if s] + shared
            folded = honest if other is None else fold(other.hex().encode(), below + above)
            row = (doc, h.decode(), subroot.decode(), root.decode(), digest(*proof).decode(), folded.decode(), folded == root, [s.decode() for s in proof] if siblings else None)
            for c, v in zip(names, row, strict=True):
                out[c].append(v)
        kinds = (pa.int64(), *[pa.string()] * 5, pa.bool_(), pa.list_(pa.string()))
        return pa.Table.from_arrays([pa.array(out[c], t) for c, t in zip(names, kinds, strict=True)], names)

    return fn


def proofs(made: Manifest, siblings: bool = True) -> DataFrame:
    """One row per leaf: its proof up to the root, and what the proof gives for the leaf found now (column `other` of the leaves; null: as it was)."""
    leaves = made.leaves.withColumn("part", F.shiftright("i", PART))
    places = numbered(made.nodes.where((F.col("n") == 1) & (F.col("tree") != TOP)).select(F.lit(TOP).alias("tree"), F.col("tree").alias("name")), ["name"])
    places = cut(places.select(F.col("name").alias("tree"), F.col("i").alias("g"), F.col("n").alias("trees")))
    asked = leaves.select("tree", "part", "n").distinct().join(places, "tree").select("tree", "part", "n", "g", "trees").mapInArrow(_asked, "of string, part long, tree string, level int, x long")
    fetched = asked.join(made.nodes, ["tree", "level", "x"]).select(F.col("of"), "part", (F.col("tree") == TOP).cast("int").alias("top"), "level", "x", "digest")
    both = leaves.join(places, "tree").select("tree", "part", "doc_id", "leaf", "other", "i", "n", "g", "trees").groupBy("tree", "part").cogroup(fetched.withColumnRenamed("of", "tree").groupBy("tree", "part"))
    return both.applyInArrow(_proven(siblings), PROVEN)


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof; where 7 divides the CRC-32 of its doc_id its n_chars is one more than what the manifest has."""
    tampered = F.when(F.crc32(F.col("doc_id").cast("long").cast("string")) % 7 == 0, F.when(F.col("n_chars").isNotNull(), leaf(n_chars=F.col("n_chars") + 1)))
    return proofs(manifest(table(spark, sf_dir, "documents"), other=tampered), siblings=False).drop("siblings")
