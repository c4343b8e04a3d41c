"""Words and rolling hashes of whole batches of texts, as NumPy arrays over their UTF-8 bytes.

A word is a maximal run of other bytes than space and 0x09-0x0D. A word's hash is a polynomial over a
random table of its bytes, modulo 2**64, and mixed; a window's hash is the same over its words' hashes.
Both come from prefix sums, so their cost does not depend on lengths. ``seed`` gives independent hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text that are hashed at once; a longer text is hashed alone.
SLICE = 1 << 20
BREAK = np.zeros(256, bool)
BREAK[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of SplitMix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _numbers(seed: int, n: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=U) + U(1000 * seed)) * U(0x9E3779B97F4A7C15))


@lru_cache(4)
def _base(seed: int) -> tuple[int, int, np.ndarray]:
    base = int(_numbers(seed + 500, 1)[0]) | 1
    return base, pow(base, -1, 1 << 64), _numbers(seed, 256)


@lru_cache(8)
def _grown(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    """base**i for i < n, modulo 2**64."""
    return _grown(base, 1 << max(10, (n - 1).bit_length()))[:n]


def _spans(values: np.ndarray, base: int, inverse: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of values[i] * base**(i - start) over each span."""
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(base, len(values)), out=total[1:])
    return (total[ends] - total[starts]) * powers(inverse, len(values) + 1)[starts]


class Texts:
    """The words of some texts: start, end (byte places in ``raw``) and first (word place of each text, and the end)."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray) -> None:
        self.raw, self.offsets = raw, offsets
        inside = ~BREAK[raw]
        starts, ends = inside.copy(), np.zeros(len(raw) + 1, bool)
        starts[1:] &= ~inside[:-1]
        ends[1:] = inside
        ends[1:-1] &= ~inside[1:]
        edges = offsets[(offsets > 0) & (offsets < len(raw))]
        edges = edges[inside[edges]]
        starts[edges] = True
        edges = edges[inside[edges - 1]]
        ends[edges] = True
        self.start, self.end = np.nonzero(starts)[0], np.nonzero(ends)[0]
        self.first = np.searchsorted(self.start, offsets)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A hash for each word."""
        if not len(self.start):
            return np.empty(0, U)
        base, inverse, table = _base(seed)
        return mix(_spans(table[self.raw], base, inverse, self.start, self.end) + U(seed + 1))


def windows(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A hash for the n words from each word on; len(hashes) - n + 1 of them, also over the ends of texts."""
    if len(hashes) < n:
        return np.empty(0, U)
    base, inverse, _ = _base(seed + 50)
    at = np.arange(len(hashes) - n + 1)
    return mix(_spans(hashes, base, inverse, at, at + n) + U(n))


def slices(texts: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, Texts]]:
    """(first, end, words) over texts in order, about size bytes at a time; null is empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    texts = texts.cast(pa.large_string())
    if texts.offset:
        texts = pa.concat_arrays([texts])
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1) if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j, Texts(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j
