"""Numpy kernels over Arrow's text buffers: spans, words and their 64-bit hashes.

No Python object is made for a word.  A span's hash is a polynomial over 64-bit codes of its bytes
and its length, modulo 2**64, then mixed; two different spans share one with a chance of about
2**-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_UNBASE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, U), np.ones(1, U)]


def byte_codes(lower: bool = False, seed: int = 7) -> np.ndarray:
    """A fixed 64-bit code for each byte; with ``lower``, A-Z have the codes of a-z."""
    codes = np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, 256, U) * U(2) + U(1)
    if lower:
        codes[65:91] = codes[97:123]
    return codes


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers after which all bits depend on all."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _up_to(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _UNBASE)):
            p = np.full(max(n, 1 << 20), base, U)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, end to end, and where each begins (one more entry: the end)."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, where, data = texts.buffers()
    off = np.frombuffer(where, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


class Hasher:
    """Hashes of spans of one byte buffer."""

    def __init__(self, data: np.ndarray, codes: np.ndarray):
        self.unpower = _up_to(len(data) + 1)
        sums = np.empty(len(data) + 1, U)
        sums[0] = 0
        np.cumsum(codes[data] * self.unpower[0][: len(data)], out=sums[1:])
        self.sums = sums

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.unpower[1][start] + (end - start).astype(U))


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true bytes; none crosses from a text to the next."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:n]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | edge[1:n]
    return np.flatnonzero(begin), np.flatnonzero(stop) + 1


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive numbers of h; those across texts are there too, to be masked."""
    if len(h) < k:
        return np.zeros(0, U)
    g = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        g *= _BASE
        g += h[j : len(h) - k + 1 + j]
    return mix(g + U(k))


def owners(off: np.ndarray) -> np.ndarray:
    """For counts given as offsets, the index of the text of each element."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))
