import numpy as np
import pytest

from sonalyt.llm import embeddings


def brute(rows, cosine=0.93):
    good = []
    for i, (_, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.append(i)
    label = {i: i for i in range(len(rows))}
    links = dict.fromkeys(range(len(rows)), 0)

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for n, i in enumerate(good):
        for j in good[n + 1 :]:
            a, b = np.array(rows[i][1], np.float32).astype(float), np.array(rows[j][1], np.float32).astype(float)
            if rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine:
                links[i] += 1
                links[j] += 1
                label[find(i)] = find(j)
    low = {}
    for i in range(len(rows)):
        low[find(i)] = min(low.get(find(i), rows[i][0]), rows[i][0])
    return sorted((rows[i][0], links[i], low[find(i)]) for i in range(len(rows)))


def made(n=500, cluster=120, seed=0):
    r = np.random.default_rng(seed)
    rows = []
    centres = r.normal(size=(12, 16))
    for i in range(n):
        v = r.normal(size=16) if i % 3 else centres[i % 12] + r.normal(size=16) * 0.12
        rows.append((i, v.astype(np.float32).tolist(), int(i % 2)))
    hot = r.normal(size=16)
    rows += [(n + i, (hot + r.normal(size=16) * 0.05).astype(np.float32).tolist(), 1) for i in range(cluster)]
    m = n + cluster
    rows += [(m, None, 1), (m + 1, [0.0] * 16, 1), (m + 2, [float("nan")] * 16, 1), (m + 3, [None] + [1.0] * 15, 1), (m + 4, rows[0][1], None), (m + 5, rows[0][1], rows[0][2]), (m + 6, rows[0][1], rows[0][2]), (m + 7, [1.0, 0.0], 1), (m + 8, [], 0), (m + 9, [float("inf")] * 16, 0)]
    return rows


@pytest.mark.parametrize("shard", [4096, 64])
def test_against_all_pairs(spark, shard):
    rows = made()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'x' as grp", "1 as shard", "2 as rep")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_vectors(df, shard=shard).collect())
    assert all(r.kept == (r.vec_id == r.component_id) for r in embeddings.near_vectors(df, shard=shard).collect())
    want = brute(rows)
    found, true = sum(x[1] for x in got), sum(x[1] for x in want)
    assert [x[0] for x in got] == [x[0] for x in want] and found <= true and found >= 0.99 * true
    if found == true:
        assert got == want


def test_recall_of_the_graph_alone():
    r = np.random.default_rng(1)
    x = embeddings.unit(r.normal(size=(1500, 24)))
    g = embeddings.Graph.unpack(embeddings.Graph(x.astype(np.float32)).pack())
    ids, _ = g.search(x.astype(np.float32), x[:200].astype(np.float32), 64)
    near = np.argsort(-(x[:200] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids, near, strict=True)]) > 0.9


def test_empty(spark):
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
