"""Chunks of recordings and other sample rates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonalyt.functions import resample
from sonalyt.functions.pcm import samples
from sonalyt.operators import recordings


def tone(hz, rate, n):
    return np.sin(2 * np.pi * hz * np.arange(n) / rate)


def whole(x, rate, new):
    up, down = resample.ratio(rate, new)
    return resample.resampled(x, 0, 0, len(x), up, down)


@pytest.mark.parametrize("rate, new", [(16_000, 8_000), (8_000, 16_000), (44_100, 16_000), (48_000, 16_000)])
def test_tones(rate, new):
    limit = min(rate, new) / 2
    for share in (0.05, 0.4, 0.89):
        y = whole(tone(share * limit, rate, rate // 2), rate, new)
        middle = y[len(y) // 4 : -len(y) // 4]
        want = tone(share * limit, new, len(y))[len(y) // 4 : -len(y) // 4]
        assert len(y) == -(-(rate // 2) * new // rate) and np.abs(middle - want).max() < 0.01  # within 0.1 dB, in phase
    if new < rate:
        for share in (1.02, 1.3, 1.9):
            y = whole(tone(share * limit, rate, rate // 2), rate, new)
            assert np.sqrt((y[len(y) // 4 : -len(y) // 4] ** 2).mean()) < 0.707e-3  # below -60 dB


def test_chunks_and_rates_equal_the_whole(spark):
    r = np.random.default_rng(3)
    recs = [(i, resample.to_pcm(r.uniform(-0.5, 0.5, n)) + b"x" * (i == 2)) for i, n in enumerate((4000, 801, 1601, 1))] + [(7, b""), (8, None)]
    rows = spark.createDataFrame(recs, "id int, pcm binary").withColumn("other", F.lit("clash")).repartition(3)
    cut = recordings.chunks(rows, "pcm", 16_000, 50)
    got = {}
    for x in cut.orderBy("id", "offset").collect():
        got[x.id] = got.get(x.id, b"") + bytes(x.chunk)
        assert len(x.chunk) <= 1600 and x.offset % 1600 == 0 and x.other == "clash"
    assert got == {i: p for i, p in recs if p}
    for new in (8_000, 24_000):
        told = {}
        for x in recordings.rate_changed(cut, ["id"], 16_000, new).orderBy("id", "offset").collect():
            assert x.offset == len(told.get(x.id, b""))
            told[x.id] = told.get(x.id, b"") + bytes(x.chunk)
        assert told == {i: resample.to_pcm(whole(samples(p), 16_000, new)) for i, p in recs if p}


def test_telephone_keeps_length_and_low_tones(spark):
    x = 0.5 * tone(1000, 16_000, 16_000) + 0.3 * tone(6000, 16_000, 16_000)
    cut = recordings.chunks(spark.createDataFrame([(1, resample.to_pcm(x))], "id int, pcm binary"), "pcm", 16_000, 100)
    back = b"".join(bytes(r.chunk) for r in recordings.telephone(cut, ["id"], 16_000).orderBy("offset").collect())
    y = samples(back)
    assert len(y) == 16_000 and np.abs(y[2000:-2000] - 0.5 * tone(1000, 16_000, 16_000)[2000:-2000]).max() < 0.003


def test_short_chunks_are_refused(spark):
    cut = recordings.chunks(spark.createDataFrame([(1, b"ab" * 500)], "id int, pcm binary"), "pcm", 16_000, 1)
    with pytest.raises(Exception, match="at least"):
        recordings.rate_changed(cut, ["id"], 16_000, 8_000).collect()
