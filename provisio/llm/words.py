"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

A word is a run of bytes other than space and 0x09-0x0D.  These bytes never occur
inside a longer UTF-8 sequence, so words of bytes and words of characters agree.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at a time (one longer text is taken whole).
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_WEIGHT = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    out = []
    for b in (_BASE, pow(_BASE, -1, 2**64)):
        x = np.full(n + 1, b, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Texts:
    """Some texts: ``data`` their bytes, text ``i`` from ``at[i]`` to ``at[i + 1]``."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.at = data, at

    def __len__(self) -> int:
        return len(self.at) - 1

    def lower(self) -> "Texts":
        return Texts(_LOWER[self.data], self.at)

    def split(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words; ``first[i]``: number of the first word of text ``i``."""
        n = len(self.data)
        word = ~_SPACE[self.data]
        start, end = word.copy(), word.copy()
        start[1:] &= ~word[:-1]
        end[:-1] &= ~word[1:]
        inner = self.at[(self.at > 0) & (self.at < n)]
        start[inner] = word[inner]
        end[inner - 1] = word[inner - 1]
        start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
        return start, end, np.searchsorted(start, self.at)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of the spans; equal bytes have equal hashes, wherever they lie."""
        power, inverse = _powers(1 << max(16, int(len(self.data)).bit_length()))
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_WEIGHT[self.data] * power[: len(self.data)], out=total[1:])
        return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` hashes that start at each place (also across texts)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = (out + h[j : j + n]) * np.uint64(_BASE)
    return mix(out)


def inside(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places at which a run of ``size`` words starts and stays in one text, and runs per text."""
    n = np.maximum(np.diff(first) - size + 1, 0)
    at = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    return at, n


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """``batch`` in pieces of about ``most`` bytes of text each, and their texts; null is empty."""
    text = batch.column(batch.schema.get_field_index(column))
    text = pc.fill_null(text, "").cast(pa.large_string())
    at = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
    held = text.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(text):
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield batch.slice(i, j - i), Texts(data[at[i] : at[j]], at[i : j + 1] - at[i])
        i = j
    trim()


@lru_cache(maxsize=1)
def _malloc_trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: 0


def trim() -> None:
    """Gives back what the last batch needed: workers are kept, and several of them share an executor's memory."""
    pa.default_memory_pool().release_unused()
    _malloc_trim()(0)


def strings(part: pa.RecordBatch, column: str) -> list[str]:
    """A piece's texts as Python strings; null is empty."""
    return pc.fill_null(part.column(part.schema.get_field_index(column)), "").to_pylist()
