"""Content-defined chunking with a gear rolling hash, over numpy arrays of code points."""

from __future__ import annotations

import numpy as np

#: Characters that a gear hash covers, and hashes of which the least is a boundary.
GEAR, WINDOW = 32, 64
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Base of the chunk digests and its inverse modulo 2**64.
BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 1 << 64)


def points(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: each bit of the result depends on all of ``x``."""
    x = x.astype(np.uint64) + _ODD
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gear(codes: np.ndarray) -> np.ndarray:
    """The gear hash h = 2h + G(c) modulo 2**32 after each character, which covers the last 32; it
    is made by doubling the span five times."""
    h = mix(codes).astype(np.uint32)
    for k in range(5):
        step = 1 << k
        more = np.zeros_like(h)
        more[step:] = h[:-step] << np.uint32(step) if len(h) > step else 0
        h = h + more
    return h


def boundaries(codes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the last character of chunks: of any ``window`` hashes in a row the least one, of
    equals the last. They depend on the characters around them only, and lie at most ``window``
    apart, also in repetitive text."""
    n = len(codes)
    if n < GEAR + window - 1:
        return np.empty(0, np.int64)
    h = mix(gear(codes)[GEAR - 1 :]) >> np.uint64(32)
    m = len(h)
    key = (h << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(m, dtype=np.uint64))
    size = 1
    while size < window:
        step = min(size, window - size)
        key = np.minimum(key[:-step], key[step:])
        size += step
    return np.unique(np.uint64(0xFFFFFFFF) - (key & np.uint64(0xFFFFFFFF))).astype(np.int64) + GEAR - 1


class Digests:
    """Digests of any stretch of a text, from one pass."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        power = np.full(n + 1, BASE, np.uint64)
        back = np.full(n + 1, INVERSE, np.uint64)
        power[0] = back[0] = 1
        with np.errstate(over="ignore"):
            power, self.back = np.cumprod(power, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
            self.sums = np.zeros(n + 1, np.uint64)
            np.cumsum(mix(codes) * power[:-1], dtype=np.uint64, out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Digests of [begin, end) as signed 64-bit numbers."""
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[begin]) * self.back[begin] + (end - begin).astype(np.uint64)).view(np.int64)
