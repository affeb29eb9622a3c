"""Arrays of numbers as compressed bytes: what tasks send each other in large pieces."""

from __future__ import annotations

import numpy as np
import zstandard

_KINDS = ("u1", "u2", "u4", "u8", "f4", "f8")


def pack(a: np.ndarray, rising: bool = False) -> bytes:
    """Numbers of 0 or more, or floating ones; ``rising``: sorted, so that their steps are kept."""
    a = np.asarray(a)
    if a.dtype.kind == "f":
        kind = 4 if a.dtype.itemsize == 4 else 5
    else:
        a = a.astype(np.uint64)
        if rising and len(a):
            a = np.concatenate((a[:1], np.diff(a)))
        top = int(a.max()) if len(a) else 0
        kind = 0 if top < 1 << 8 else 1 if top < 1 << 16 else 2 if top < 1 << 32 else 3
    a = np.ascontiguousarray(a.astype(_KINDS[kind]))
    planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()
    return bytes([kind, rising]) + len(a).to_bytes(6, "little") + zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(blob: bytes) -> np.ndarray:
    """The numbers again: int64, uint64 where they were that large, or floating."""
    kind, rising, n = np.dtype(_KINDS[blob[0]]), blob[1], int.from_bytes(blob[2:8], "little")
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8:]), np.uint8)
    a = np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).view(kind).ravel() if n else np.zeros(0, kind)
    if kind.kind == "f":
        return a
    if rising:
        a = np.cumsum(a, dtype=np.uint64)
    return a.astype(np.int64 if not n or a.max() < 1 << 63 else np.uint64)
