"""Audio samples in binary columns: frames, speech bounds, pauses, noise at a level."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRAME_MS, FLOOR, SHARE, PAUSE_S = 20, 1e-4, 0.02, 0.15
BOUNDS = T.StructType([T.StructField(n, t) for n, t in (("duration_s", T.DoubleType()), ("onset_s", T.DoubleType()), ("speech_end_s", T.DoubleType()), ("pauses", T.LongType()), ("paused_s", T.DoubleType()), ("longest_pause_s", T.DoubleType()))])


def samples(pcm: bytes) -> np.ndarray:
    """16-bit little-endian mono as floats in [-1, 1); an odd last byte is left out."""
    return np.frombuffer(pcm[: len(pcm) // 2 * 2], "<i2") / 32768.0


def levels(x: np.ndarray, rate: int, frame_ms: int = FRAME_MS) -> np.ndarray:
    """Root mean square of each frame, the last one possibly short."""
    n = max(1, rate * frame_ms // 1000)
    starts = np.arange(0, len(x), n)
    return np.sqrt(np.add.reduceat(x * x, starts) / np.minimum(n, len(x) - starts)) if len(x) else np.zeros(0)


def bounds(pcm: bytes, rate: int, frame_ms: int = FRAME_MS) -> tuple:
    """Duration, onset and end of speech, and the pauses between: a frame is voiced above SHARE of the loudest one."""
    x = samples(pcm)
    level = levels(x, rate, frame_ms)
    duration = len(x) / rate
    voiced = np.flatnonzero(level > max(SHARE * level.max(initial=0), FLOOR))
    if not len(voiced):
        return duration, None, duration, 0, 0.0, 0.0
    step = frame_ms / 1000
    gaps = (np.diff(voiced) - 1) * step
    gaps = gaps[gaps >= PAUSE_S - 1e-9]
    return duration, float(voiced[0] * step), float(min((voiced[-1] + 1) * step, duration)), len(gaps), float(gaps.sum()), float(gaps.max(initial=0))


def speech_bounds(rate: int):
    @F.pandas_udf(BOUNDS)
    def run(pcm: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([bounds(p, rate) if p is not None else (None,) * 6 for p in pcm], columns=BOUNDS.names)

    return run


def mix(speech: np.ndarray, noise: np.ndarray, level_db: float, rate: int) -> np.ndarray:
    """speech with noise, repeated to its length, at a ratio to the level of the voiced frames."""
    level = levels(speech, rate)
    active = level[level > max(SHARE * level.max(initial=0), FLOOR)]
    loud = np.sqrt((active**2).mean()) if len(active) else 0.0
    tiled = np.resize(noise, len(speech)) if len(noise) else np.zeros(len(speech))
    own = np.sqrt((tiled**2).mean()) if len(tiled) else 0.0
    return np.clip(speech + tiled * (loud / own * 10 ** (-level_db / 20) if own > 0 else 0.0), -1, 32767 / 32768)
