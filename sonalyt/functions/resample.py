"""Sample rates changed by a polyphase windowed-sinc filter.

For rates whose ratio is up/down in least terms, output k is the sum over inputs n of x[n] h(k down - n up), where h is a sinc under a Kaiser window at `up` times the
input's rate. It keeps what is below 0.9 of the lower of the two Nyquist limits within 0.01 dB and puts what is above that limit below -70 dB. Only the taps that meet an input
are multiplied, and any range of outputs can be worked out from the inputs within reach() of it.
"""

from __future__ import annotations

from functools import lru_cache
from math import ceil, gcd, pi

import numpy as np

PASS, STOP, DOWN_DB = 0.9, 1.0, 80.0


def ratio(rate: int, new_rate: int) -> tuple[int, int]:
    g = gcd(rate, new_rate)
    return new_rate // g, rate // g


@lru_cache(16)
def taps(up: int, down: int) -> np.ndarray:
    """The filter at `up` times the input's rate; an odd number of taps around the middle, their sum is `up`."""
    nyquist = 0.5 / max(up, down)
    half = ceil((DOWN_DB - 7.95) / (2.285 * 2 * pi * nyquist * (STOP - PASS)) / 2)
    n = np.arange(-half, half + 1)
    cut = nyquist * (PASS + STOP)  # twice the middle of the band between
    h = cut * np.sinc(cut * n) * np.kaiser(2 * half + 1, 0.1102 * (DOWN_DB - 8.7))
    return h * up / h.sum()


def reach(up: int, down: int) -> int:
    """Inputs on either side that an output depends on."""
    return len(taps(up, down)) // 2 // up + 1


def outputs(start: int, stop: int, up: int, down: int) -> tuple[int, int]:
    """The range of outputs that belong to inputs start to stop-1: ranges of inputs in a row give ranges of outputs in a row."""
    return -(-start * up // down), -(-stop * up // down)


def resampled(x: np.ndarray, first: int, start: int, stop: int, up: int, down: int, step: int = 4096) -> np.ndarray:
    """Outputs for inputs start to stop-1 of a recording; x holds its samples from number `first` on, and what isn't there is silence."""
    h = taps(up, down)
    half = len(h) // 2
    many = 2 * half // up + 1
    low, high = outputs(start, stop, up, down)
    padded = np.concatenate([h, np.zeros(up)])  # places beyond the filter read 0
    out = np.empty(high - low)
    for at in range(low, high, step):
        k = np.arange(at, min(at + step, high)) * down
        last = (k + half) // up
        n = last[:, None] - np.arange(many)
        tap = k[:, None] - n * up + half
        inside = (n >= first) & (n < first + len(x))
        values = np.where(inside, x[np.clip(n - first, 0, max(len(x) - 1, 0))], 0.0) if len(x) else np.zeros(n.shape)
        out[at - low : at - low + len(k)] = (values * padded[np.minimum(tap, len(h))]).sum(axis=1)
    return out


def to_pcm(x: np.ndarray) -> bytes:
    """Floats in [-1, 1) as 16-bit little-endian, nearest value, clipped."""
    return np.clip(np.floor(x * 32768 + 0.5), -32768, 32767).astype("<i2").tobytes()
