"""Every registered query against its SQL on the small tables."""

import duckdb
import pandas as pd
import pytest

from sonalyt import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def cells(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if pd.isna(v):
            return "null"
        return f"{float(v):.5g}" if isinstance(v, float) or getattr(getattr(v, "dtype", None), "kind", "") == "f" else str(v)

    return sorted(tuple(map(cell, row)) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and cells(got) == cells(want)


def test_names():
    assert registry.FLAGSHIP in registry.QUERIES and set(registry.ORACLE_SQL) <= set(registry.QUERIES)
