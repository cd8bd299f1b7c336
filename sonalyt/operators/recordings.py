"""Recordings as binary columns of 16-bit mono samples: chunks of fixed length, and other sample rates chunk by chunk.

A chunk holds its offset in bytes and its bytes; the last one may be short. Filters need samples of the chunks beside a chunk: those come by a window over a recording's chunks, a few
hundred bytes each, so a recording is never in one task as a whole once it is cut. Null and empty recordings have no chunks; an odd last byte belongs to no sample and is left out.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.pcm import samples
from ..functions.resample import ratio, reach, resampled, to_pcm

TELEPHONE = 8000


def chunks(rows: DataFrame, pcm: str, rate: int, chunk_ms: int) -> DataFrame:
    """A row for each chunk_ms of each recording: the other columns with offset and chunk. Cut by Spark's own functions."""
    step = rate * chunk_ms // 1000 * 2
    if step < 2:
        raise ValueError("a chunk has at least one sample")
    size = F.octet_length(pcm)
    starts = F.when(size > 0, F.sequence(F.lit(0), size - 1, F.lit(step)))
    cut = F.transform(starts, lambda at: F.struct(at.cast("long").alias("offset"), F.substring(F.col(pcm), at + 1, F.lit(step)).alias("chunk")))
    others = [c for c in rows.columns if c != pcm]
    return rows.select(*others, F.explode(cut).alias("__c")).select(*others, "__c.*")


def rate_changed(cut: DataFrame, key: list[str], rate: int, new_rate: int) -> DataFrame:
    """Chunks (key, offset, chunk) of recordings at another rate: each chunk's own outputs, which in a row are those of the whole recording, ceil(samples x new / old) of them.

    Chunks of a recording have to be at least as long as the filter reaches, but for the last one."""
    up, down = ratio(rate, new_rate)
    margin = 2 * reach(up, down)
    of = Window.partitionBy(*key).orderBy("offset")
    before, after = F.lag(F.substring("chunk", -margin, margin)).over(of), F.lead(F.substring("chunk", 1, margin)).over(of)
    short = (F.octet_length("chunk") < margin) & F.lead("offset").over(of).isNotNull()
    beside = cut.withColumns({"__before": before, "__after": after, "__short": short})

    @F.pandas_udf(T.BinaryType())
    def run(chunk: pd.Series, left: pd.Series, right: pd.Series, offset: pd.Series, short: pd.Series) -> pd.Series:
        if short.any():
            raise ValueError(f"chunks have at least {margin} bytes for these rates")
        out = []
        for c, a, b, at in zip(chunk, left, right, offset, strict=True):
            own, a = samples(c), samples(a or b"")
            start = at // 2
            out.append(to_pcm(resampled(np.concatenate([a, own, samples(b or b"")]), start - len(a), start, start + len(own), up, down)))
        return pd.Series(out)

    told = beside.withColumn("chunk", run("chunk", "__before", "__after", "offset", "__short")).drop("__before", "__after", "__short")
    size = F.floor((F.floor(F.col("offset") / 2) * up + down - 1) / down)
    return told.withColumn("offset", (2 * size).cast("long"))


def telephone(cut: DataFrame, key: list[str], rate: int) -> DataFrame:
    """Recordings as a telephone line leaves them: to 8,000 samples a second and back."""
    return cut if rate == TELEPHONE else rate_changed(rate_changed(cut, key, rate, TELEPHONE), key, TELEPHONE, rate)


def pair_audio(first: str, second: str, rate: int, gap_s: float = 0.8) -> Column:
    """Two recordings in a row with silence between, null if either is."""
    silence = F.unhex(F.repeat(F.lit("0000"), F.lit(int(rate * gap_s))))
    return F.when(F.col(first).isNotNull() & F.col(second).isNotNull(), F.concat(F.col(first), silence, F.col(second)))


def with_score(files: DataFrame, content: str, score: Callable[[bytes], float | None], name: str = "score") -> DataFrame:
    """files with what a function of a recording's bytes says of it; it runs on Arrow batches beside the data. A null recording has no score."""

    @F.pandas_udf(T.DoubleType())
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else score(bytes(b)) for b in batch], dtype=float)

    return files.withColumn(name, run(content))
