"""The queries that SQL can express, against it."""

import duckdb
import pytest

from sonalyt.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(registry.ORACLE_SQL[name]).df()
    got = registry.QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    assert sorted(map(str, got.itertuples(index=False, name=None))) == sorted(map(str, want.itertuples(index=False, name=None)))


def test_embeddings_with_links_against_sql(spark, tmp_path):
    """The given tables hold no pair that is near enough; this one holds chains, copies, near misses, and rows that can't be compared."""
    import numpy as np

    r = np.random.default_rng(5)
    rows = []

    def add(vector, label):
        rows.append((len(rows), label, None if vector is None else [None if x is None else float(x) for x in vector]))

    for label in (0, 1):
        base = r.normal(size=(60, 16))
        for v in base:
            add(v, label)
        for v in base[:25]:
            for share in (0.1, 0.3, 0.38, 0.42, 0.6):  # cosines on both sides of the limit
                add(v / np.linalg.norm(v) + share * r.normal(size=16) / 4, label)
        chain = r.normal(size=16)
        for _ in range(12):
            add(chain, label)
            chain = chain / np.linalg.norm(chain) + 0.3 * r.normal(size=16) / 4
        for _ in range(40):
            add(base[0] * 2, label)  # copies but for length
    for odd in (None, [0.0] * 16, [1.0] * 15 + [None], [float("nan")] * 16, [float("inf")] + [1.0] * 15):
        add(odd, 0)
    add(rows[0][2], None)
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = con.execute(registry.ORACLE_SQL["op4_embeddings"]).df()
    got = registry.QUERIES["op4_embeddings"](spark, str(tmp_path)).toPandas()[list(want.columns)]
    assert want["n_links"].sum() > 1000 and (want["n_links"] == 1).any()
    assert sorted(map(str, got.itertuples(index=False, name=None))) == sorted(map(str, want.itertuples(index=False, name=None)))
