"""What the operators share: reading tables, cutting lineage, streaming sorted runs, connected components."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that extra columns never clash with what an operator adds; a null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder, without lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> str:
    """The path of df as Parquet in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """Written as Parquet to the shared folder and read again."""
    return df.sparkSession.read.parquet(written(df))


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes what written() wrote."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever its letters' case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let_go() -> None:
    """Gives memory that a task has freed back to the system: a worker waits for its next task beside others that need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def map_batches(df: DataFrame, fn: Callable[[dict[str, pa.Array]], dict[str, object] | Iterator[dict[str, object]]], schema: str) -> DataFrame:
    """fn gets the columns of each Arrow batch and returns the columns of the output, in the order of the schema, or an iterator of such parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = fn(dict(zip(b.schema.names, b.columns, strict=True)))
                for part in [out] if isinstance(out, dict) else out:
                    yield pa.RecordBatch.from_pydict(part)
        let_go()

    return df.mapInArrow(run, schema)


def pieces(column: pa.Array, most: int = 4_000_000) -> Iterator[tuple[int, list[str]]]:
    """The strings of a column, some million bytes at a time, with the place of the first; this bounds what one step holds."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
        yield at, column.slice(at, to - at).to_pylist()
        at = to


def runs(keys: list[str], numbers: list[str], fn: Callable[[np.ndarray, dict[str, np.ndarray]], dict[str, np.ndarray] | None], over: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]] | None = None, most: int = 1 << 18):
    """For mapInArrow over rows sorted by keys (integers): fn gets starts of whole runs and the columns as numpy arrays.

    The rows of a run that a batch cuts wait for its end, so fn sees each run once and whole. With over, no more than about `most` rows wait:
    a run longer than that goes to over in parts instead. Only integer columns pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        n = 0
        flowing: dict[str, int] | None = None  # the key of a run that goes to over

        def given(out: dict[str, np.ndarray] | None):
            if out is not None and len(next(iter(out.values()))):
                yield pa.RecordBatch.from_pydict(out)

        def flush(cols: dict[str, np.ndarray]):
            size = len(cols[keys[0]])
            if size:
                new = np.ones(size, dtype=bool)
                new[1:] = np.logical_or.reduce([cols[k][1:] != cols[k][:-1] for k in keys])
                yield from given(fn(np.flatnonzero(new), cols))

        for b in batches:
            cols = {k: b.column(b.schema.names.index(k)).to_numpy(zero_copy_only=False) for k in [*keys, *numbers]}
            if flowing is not None and b.num_rows:
                same = np.logical_and.reduce([cols[k] == flowing[k] for k in keys])
                stop = len(same) if same.all() else int(np.argmin(same))
                if stop:
                    yield from given(over({k: v[:stop] for k, v in cols.items()}))
                    cols = {k: v[stop:] for k, v in cols.items()}
                if stop < len(same):
                    flowing = None
            if not len(cols[keys[0]]):
                continue
            held.append(cols)
            n += len(cols[keys[0]])
            if n < most:
                continue
            whole = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
            same = np.logical_and.reduce([whole[k] == whole[k][-1] for k in keys])
            first = 0 if same.all() else len(same) - int(np.argmin(same[::-1]))
            yield from flush({k: v[:first] for k, v in whole.items()})
            tail = {k: v[first:] for k, v in whole.items()}
            held, n = [tail], len(tail[keys[0]])
            if over is not None and n >= most:
                flowing = {k: tail[k][0] for k in keys}
                yield from given(over(tail))
                held, n = [], 0
        if held:
            yield from flush({k: np.concatenate([h[k] for h in held]) for k in held[0]})
        held.clear()
        let_go()

    return run


def lowest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 to n-1 and links a-b: the lowest node each one reaches."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 40) -> DataFrame:
    """(node, root) for each node of links: root is the smallest node reachable.

    Large-star and small-star steps in turn (Kiveris et al., 2014), with minima and joins instead of neighbour lists,
    so that no node's neighbours meet in one task unless Spark can split them. Each round is cut off in the shared folder.
    """
    low, high = F.least(a, b).alias("v"), F.greatest(a, b).alias("u")
    edges = cut(links.where(F.col(a) != F.col(b)).select(low, high).distinct())

    def mark(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = mark(edges)
    if not before[0]:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # under a key that Spark doesn't take for the grouping's own, so the join has a shuffle on both sides and adaptive execution can split a hub's rows
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).select(F.bitwise_not(F.bitwise_not("u")).alias("k"), "m")
        large = both.join(least, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = cut(small.where("u != v").distinct())
        now = mark(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
