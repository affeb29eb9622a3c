"""A counting quotient filter of 64-bit fingerprints, packed and immutable.

A fingerprint is cut into a segment (its first bits, the same for a whole filter), a quotient and
a remainder.  Quotients that occur are bits; the remainders of a quotient lie next to each other,
sorted, and a bit marks the last slot of each such run.  A count above one follows its remainder
as digits in further slots, which another bit marks.  Nothing is lost: ``items`` gives all
fingerprints and counts back, and filters are merged by their sorted remainders.
"""

from __future__ import annotations

import numpy as np


def counted(fingerprints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fingerprints in order, with the sums of their counts; runs that are sorted already are merged."""
    order = np.argsort(fingerprints, kind="stable")
    fingerprints, counts = fingerprints[order], counts[order]
    first = np.flatnonzero(np.append(True, fingerprints[1:] != fingerprints[:-1])) if len(order) else order
    return fingerprints[first], np.add.reduceat(counts, first) if len(order) else counts


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def pack(fingerprints: np.ndarray, counts: np.ndarray, segment_bits: int) -> bytes:
    """The filter of sorted, distinct fingerprints (uint64) of one segment, with counts of 1 or more."""
    n = len(fingerprints)
    quotient_bits = min(max(1, n.bit_length()), 56 - segment_bits)
    rest = 64 - segment_bits - quotient_bits
    inner = fingerprints & np.uint64((1 << (64 - segment_bits)) - 1)
    quotient, remainder = (inner >> np.uint64(rest)).astype(np.int64), inner & np.uint64((1 << rest) - 1)
    occupied = np.zeros(1 << quotient_bits, bool)
    occupied[quotient] = True
    # digits of count - 1, the lowest one first
    digits, more = [], counts.astype(np.uint64) - np.uint64(1)
    while (more > 0).any():
        digits.append(np.where(more > 0, more & np.uint64((1 << rest) - 1), 0).astype(np.uint64))
        more = more >> np.uint64(rest)
    left = counts.astype(np.uint64) - np.uint64(1)
    width = np.ones(n, np.int64)
    for k in range(len(digits)):
        width += (left >> np.uint64(rest * k)) > 0
    at = np.cumsum(width) - width
    slots, is_digit, ends = np.zeros(int(width.sum()), np.uint64), np.zeros(int(width.sum()), bool), np.zeros(int(width.sum()), bool)
    slots[at] = remainder
    for k, digit in enumerate(digits):
        has = width > k + 1
        slots[at[has] + k + 1] = digit[has]
        is_digit[at[has] + k + 1] = True
    last = np.append(quotient[1:] != quotient[:-1], True) if n else np.zeros(0, bool)
    ends[(at + width - 1)[last]] = True
    planes = slots.astype("<u8").view(np.uint8).reshape(len(slots), 8)[:, : (rest + 7) // 8]
    segment = int(fingerprints[0]) >> (64 - segment_bits) if n and segment_bits else 0
    head = bytes([segment_bits, quotient_bits]) + segment.to_bytes(8, "little") + len(slots).to_bytes(8, "little")
    return head + _bits(occupied) + _bits(ends) + _bits(is_digit) + planes.tobytes()


def items(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All fingerprints of a filter in order, and their counts."""
    segment_bits, quotient_bits, segment, n = blob[0], blob[1], int.from_bytes(blob[2:10], "little"), int.from_bytes(blob[10:18], "little")
    rest, at, found = 64 - segment_bits - quotient_bits, 18, []
    for size in (1 << quotient_bits, n, n):
        found.append(np.unpackbits(np.frombuffer(blob, np.uint8, (size + 7) // 8, at), count=size).astype(bool))
        at += (size + 7) // 8
    occupied, ends, is_digit = found
    wide = np.zeros((n, 8), np.uint8)
    wide[:, : (rest + 7) // 8] = np.frombuffer(blob, np.uint8, offset=at).reshape(n, (rest + 7) // 8)
    slots = wide.view("<u8").ravel().astype(np.uint64)
    run = np.cumsum(ends) - ends
    own = np.flatnonzero(~is_digit)
    quotient = np.flatnonzero(occupied)[run[own]].astype(np.uint64)
    counts = np.ones(len(own), np.int64)
    more = np.flatnonzero(is_digit)
    item = np.cumsum(~is_digit)[more] - 1
    np.add.at(counts, item, (slots[more] << (np.uint64(rest) * (more - own[item] - 1).astype(np.uint64))).astype(np.int64))
    high = np.uint64(segment << (64 - segment_bits)) if segment_bits else np.uint64(0)
    return high | (quotient << np.uint64(rest)) | slots[own], counts


def cut(fingerprints: np.ndarray, segment_bits: int) -> list[tuple[int, bytes]]:
    """The filters of some fingerprints (uint64, in any order, repeated or not): a filter for each segment that occurs."""
    own, counts = counted(fingerprints, np.ones(len(fingerprints), np.int64))
    segment = (own >> np.uint64(64 - segment_bits)).astype(np.int64)
    first = np.flatnonzero(np.append(True, segment[1:] != segment[:-1])) if len(own) else segment
    return [(int(segment[low]), pack(own[low:high], counts[low:high], segment_bits)) for low, high in zip(first, np.append(first[1:], len(own)), strict=False)]


def merged(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The items of several filters together."""
    found = [items(b) for b in blobs]
    return counted(np.concatenate([f for f, _ in found]), np.concatenate([c for _, c in found]))
