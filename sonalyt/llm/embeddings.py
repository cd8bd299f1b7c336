"""Embedding near-duplicates by hierarchical navigable small-world graphs, one for each shard of a label.

Equal vectors become one, with the number of its copies. A label's vectors are dealt into shards of about SHARD; each shard gets a graph (Malkov and
Yashunin, 2016): every layer links a vector to near ones that are not nearer to each other, a layer above holds one in
M of those below. Every shard's vectors search every shard of their label, a block of queries at a time. A query whose beam is filled with
hits is searched again with a beam twice as wide, until it isn't; an audit of AUDIT queries against all vectors of the shard, which asks for what
is near enough and for the nearest vector whatever its cosine, widens the beam for the block until RECALL is reached, and queries whose beam of WIDEST is still filled are compared with the shard in full.
What is found is verified by cosine in double precision.

A block returns each vector's number of links and a star of links, never its pairs, so a group of thousands of near copies costs rows in
proportion to its vectors. Searching every shard makes the searches of one label grow with the square of its shards: that is
the method; labels keep it small.

Nulls: vectors that are null, zero, or hold null or non-finite components, and rows without label link with nothing. Vectors of different
length never link. Repeated vec_ids are vectors of their own. Ties: a cosine of just the limit links; a component has its smallest vec_id.
Empty table: empty result. Other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, lowest, table

COSINE, SHARD = 0.93, 4096
M, BUILD, BEAM, AUDIT, RECALL = 12, 40, 32, 48, 0.99
_BLOCK = 256
WIDEST = 256  # a beam that is still filled with hits belongs to a dense group, which is compared in full


def _select(x: np.ndarray, own: np.ndarray, cand: np.ndarray, most: int) -> np.ndarray:
    """For each row of own, up to most of its candidates (-1: none), nearest first, that no chosen one is nearer to; then the nearest others."""
    out = np.full((len(own), most), -1, np.int64)
    for at in range(0, len(own), _BLOCK):
        c = cand[at : at + _BLOCK]
        real = c >= 0
        v = x[np.maximum(c, 0)]
        sim = np.where(real, np.einsum("bcd,bd->bc", v, x[own[at : at + _BLOCK]]), -9)
        order = np.argsort(-sim, axis=1, kind="stable")
        c, sim, v = np.take_along_axis(c, order, 1), np.take_along_axis(sim, order, 1), np.take_along_axis(v, order[..., None], 1)
        real = sim > -9
        mutual = v @ v.transpose(0, 2, 1)
        chosen = np.zeros_like(real)
        for k in range(c.shape[1]):
            shadowed = (np.where(chosen, mutual[:, k], -9) > sim[:, k, None]).any(axis=1)
            chosen[:, k] = real[:, k] & ~shadowed & (chosen.sum(axis=1) < most)
        rank = np.argsort(np.where(chosen, 0, np.where(real, 1, 2)), axis=1, kind="stable")[:, :most]
        out[at : at + _BLOCK, : rank.shape[1]] = np.where(np.take_along_axis(real, rank, 1), np.take_along_axis(c, rank, 1), -1)
    return out


def _walk(x: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids (-1: none) and similarities, best first, of each query's beam in one layer; entry: starting ids for each query."""
    n, b = len(x), len(queries)
    rows = np.arange(b)[:, None]
    seen = np.zeros((b, n + 1), bool)
    ids = np.full((b, beam), -1, np.int64)
    sim = np.full((b, beam), -9.0, np.float32)
    entry = entry[:, :beam]
    ids[:, : entry.shape[1]] = entry
    sim[:, : entry.shape[1]] = np.where(entry >= 0, np.einsum("bkd,bd->bk", x[np.maximum(entry, 0)], queries), -9)
    seen[rows, entry] = True
    done = ids < 0
    live = np.arange(b)
    while len(live):
        s, d = sim[live], done[live]
        take = np.argsort(np.where(d, 9.0, -s), axis=1, kind="stable")[:, :4]
        fresh = ~np.take_along_axis(d, take, 1)
        pick = np.where(fresh, np.take_along_axis(ids[live], take, 1), -1)
        np.put_along_axis(d, take, True, 1)
        near = np.where(pick[..., None] >= 0, links[pick], -1).reshape(len(live), -1)
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[seen[live[:, None], near]] = -1
        seen[live[:, None], near] = True
        seen[:, -1] = False
        got = np.where(near >= 0, np.einsum("bkd,bd->bk", x[np.maximum(near, 0)], queries[live]), -9).astype(np.float32)
        all_sim = np.hstack([s, got])
        best = np.argsort(-all_sim, axis=1, kind="stable")[:, :beam]
        ids[live] = np.take_along_axis(np.hstack([ids[live], near]), best, 1)
        sim[live] = np.take_along_axis(all_sim, best, 1)
        done[live] = np.take_along_axis(np.hstack([d, near < 0]), best, 1) | (sim[live] <= -9)
        live = live[~done[live].all(axis=1)]
    return ids, sim


class Graph:
    """Layers, the lowest first: ids of the members and their links (as places among the members)."""

    def __init__(self, x: np.ndarray, seed: int = 0):
        n = len(x)
        level = np.minimum(np.floor(-np.log(np.random.default_rng(seed).random(n)) / np.log(M)).astype(int), 6)
        self.members = [np.flatnonzero(level >= k) for k in range(int(level.max(initial=0)) + 1)]
        self.links: list[np.ndarray] = [self._layer(x[m], 2 * M if k == 0 else M) for k, m in enumerate(self.members)]

    @staticmethod
    def _layer(x: np.ndarray, most: int) -> np.ndarray:
        n = len(x)
        links = np.full((n, most), -1, np.int64)
        first = min(n, 64)
        at = 0
        while at < n:
            to = first if at == 0 else min(n, at + min(_BLOCK, at))
            own = np.arange(at, to)
            batch = x[at:to] @ x[at:to].T
            np.fill_diagonal(batch, -9)
            near = np.argsort(-batch, axis=1, kind="stable")[:, : min(BUILD, len(own) - 1)]
            cand = near + at
            if at:
                start = np.tile(np.linspace(0, at - 1, min(8, at)).astype(np.int64), (len(own), 1))
                old, _ = _walk(x[:at], links[:at], x[at:to], start, BUILD)
                cand = np.hstack([old, cand])
            if cand.shape[1]:
                links[at:to] = _select(x, own, cand, most)
                a, b = np.repeat(own, most), links[at:to].ravel()
                a, b = a[b >= 0], b[b >= 0]
                order = np.argsort(b, kind="stable")
                a, b = a[order], b[order]
                target, begin, count = np.unique(b, return_index=True, return_counts=True)
                wide = int(count.max()) if len(count) else 0
                if wide:
                    back = np.full((len(target), wide), -1, np.int64)
                    back[np.repeat(np.arange(len(target)), count), np.arange(len(b)) - np.repeat(begin, count)] = a
                    both = np.sort(np.hstack([links[target], back]), axis=1)
                    both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
                    for s in range(0, len(target), _BLOCK):
                        part = both[s : s + _BLOCK]
                        part = -np.sort(-part, axis=1)[:, : max(most, int((part >= 0).sum(axis=1).max()))]
                        links[target[s : s + _BLOCK]] = _select(x, target[s : s + _BLOCK], part, most)
            at = to
        return links

    def search(self, x: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        top = self.members[-1]
        entry = np.tile(top[np.linspace(0, len(top) - 1, min(4, len(top))).astype(np.int64)], (len(queries), 1))
        for k in range(len(self.members) - 1, -1, -1):
            m = self.members[k]
            place = np.where(entry >= 0, np.searchsorted(m, np.maximum(entry, 0)), -1)
            ids, sim = _walk(x[m], self.links[k], queries, place, beam if k == 0 else 8)
            entry = np.where(ids >= 0, m[np.maximum(ids, 0)], -1)
        return entry, sim

    def pack(self) -> bytes:
        parts = [np.array([len(self.members), *(len(m) for m in self.members), *(a.shape[1] for a in self.links)])]
        return np.concatenate([*parts, *self.members, *(a.ravel() for a in self.links)]).astype(np.int32).tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> Graph:
        g, x = cls.__new__(cls), np.frombuffer(data, np.int32).astype(np.int64)
        k = int(x[0])
        sizes, widths, at = x[1 : 1 + k], x[1 + k : 1 + 2 * k], 1 + 2 * k
        g.members, g.links = [], []
        for n in sizes:
            g.members.append(x[at : at + n])
            at += n
        for n, w in zip(sizes, widths, strict=True):
            g.links.append(x[at : at + n * w].reshape(n, w))
            at += n * w
        return g


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def hits(queries: np.ndarray, x: np.ndarray, graph: Graph, cosine: float) -> np.ndarray:
    """Boolean, a row for each query and a column for each of x: found by the graph and verified. Unit vectors in double precision."""
    q32, x32 = queries.astype(np.float32), x.astype(np.float32)
    n, edge = len(x), cosine - 1e-4
    found = np.zeros((len(queries), n), bool)
    audit = np.unique(np.linspace(0, len(queries) - 1, min(AUDIT, len(queries))).astype(int))
    cosines = queries[audit] @ x.T
    truth, nearest = cosines >= cosine, cosines.argmax(axis=1)
    reached = np.zeros(len(audit), bool)  # audited queries whose nearest vector the walk came to, whatever its cosine
    todo, beam = np.arange(len(queries)), min(BEAM, n)
    while len(todo):
        again = []
        for at in range(0, len(todo), _BLOCK):
            own = todo[at : at + _BLOCK]
            ids, sim = graph.search(x32, q32[own], beam)
            mine = np.isin(audit, own)
            reached[mine] |= (ids[np.searchsorted(own, audit[mine])] == nearest[mine, None]).any(axis=1)
            ok = sim >= edge
            a, b = np.nonzero(ok)
            i, j = own[a], ids[a, b]
            for s in range(0, len(i), 1 << 16):
                u, v = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
                exact = np.einsum("kd,kd->k", queries[u], x[v]) >= cosine
                found[u[exact], v[exact]] = True
            again.append(own[ok.all(axis=1)])
        full = np.concatenate(again)
        recall = ((found[audit] & truth).sum() + reached.sum()) / (truth.sum() + len(audit))
        if beam >= n or beam >= WIDEST:
            if recall < RECALL:  # parts of the graph that no beam reaches
                full = np.arange(len(queries))
            for at in range(0, len(full), _BLOCK):
                own = full[at : at + _BLOCK]
                found[own] = queries[own] @ x.T >= cosine
            break
        todo = full if recall >= RECALL else np.arange(len(queries))
        beam = min(2 * beam, n)
    return found


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("rep")
    x = unit(np.stack(pdf["embedding"].to_numpy()).astype(np.float64))
    g = Graph(x.astype(np.float32))
    return pd.DataFrame({
        "grp": [pdf["grp"].iloc[0]], "shard": [pdf["shard"].iloc[0]], "shards": [pdf["shards"].iloc[0]], "reps": [pdf["rep"].to_numpy(np.int64).tobytes()], "copies": [pdf["copies"].to_numpy(np.int64).tobytes()],
        "vectors": [x.tobytes()], "graph": [g.pack()],
    })


def _block(cosine: float):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("role")
        one, two = pdf.iloc[0], pdf.iloc[-1]
        reps = [np.frombuffer(r.reps, np.int64) for r in (one, two)]
        copies = [np.frombuffer(r.copies, np.int64) for r in (one, two)]
        x, y = (np.frombuffer(r.vectors, np.float64).reshape(len(i), -1) for r, i in zip((one, two), reps, strict=True))
        found = hits(x, y, Graph.unpack(two.graph), cosine)
        same = len(pdf) == 1
        if same:
            found |= found.T
            np.fill_diagonal(found, False)
            count, ids = [found @ copies[0]], [reps[0]]
        else:
            count, ids = [found @ copies[1], found.T @ copies[0]], reps
        nodes = reps[0] if same else np.concatenate(reps)
        label = np.arange(len(nodes))
        for at in range(0, len(found), 128):
            i, j = np.nonzero(found[at : at + 128])
            if len(i):
                a, b = label[i + at], label[j if same else j + len(x)]
                label = lowest(len(nodes), *np.divmod(np.unique(a * len(nodes) + b), len(nodes)))[label]
        linked = np.flatnonzero(label != np.arange(len(nodes)))
        return pd.DataFrame({
            "rep": np.concatenate([*ids, nodes[linked]]), "links": np.concatenate([*count, np.zeros(len(linked), np.int64)]), "other": pd.array([*[None] * sum(map(len, ids)), *nodes[label[linked]]], dtype="Int64")
        })

    return fn


def near_vectors(vectors: DataFrame, cosine: float = COSINE, shard: int = SHARD) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding, label)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    usable = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite & some, F.lit(False))
    grp = F.concat_ws(":", F.size("embedding").cast("string"), "label")
    own = rows.where(usable).withColumn("grp", grp)
    reps = cut(own.groupBy("grp", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    sizes = reps.groupBy("grp").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards"))
    dealt = reps.join(sizes, "grp").withColumn("shard", F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int"))
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # blocks are small in bytes and long in work, so they aren't left to be coalesced
    graphs = cut(dealt.repartition(n, "grp", "shard").groupBy("grp", "shard").applyInPandas(_build, "grp string, shard int, shards int, reps binary, copies binary, vectors binary, graph binary"))
    paired = graphs.withColumn("peer", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    paired = paired.withColumn("a", F.least("shard", "peer")).withColumn("b", F.greatest("shard", "peer")).withColumn("role", (F.col("shard") == F.col("b")).cast("int"))
    blocks = cut(paired.repartition(n, "grp", "a", "b").groupBy("grp", "a", "b").applyInPandas(_block(cosine), "rep long, links long, other long"))
    roots = components(blocks.where("other is not null").select(F.col("rep").alias("x"), F.col("other").alias("y")), "x", "y")
    counts = blocks.groupBy("rep").agg(F.sum("links").alias("links"))
    known = reps.join(counts, "rep").join(roots, F.col("rep") == F.col("node"), "left")
    known = known.select("grp", "embedding", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    linked = own.join(known, ["grp", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
