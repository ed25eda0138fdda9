"""Counting quotient filters of word-id n-grams, without loss.

An n-gram of ids of ``bits`` bits is packed into limbs of at most 64 bits, and the
limbs are permuted invertibly, so that the first one is spread evenly. Its top bits
are the *slot* (the shard of the filter in a merge), the next ones the *quotient*,
and all the rest is the *remainder*, which is stored in full: a key is read back
from its place and its remainder, and counts are exact.

A filter is a byte string: the lengths of the quotients' runs in unary (a one per
key, a zero per quotient), the remainders in whole bytes, the further limbs, and
one byte per count with the larger counts behind. Keys are sorted, so filters of
shards are merged by a stable sort of sorted runs.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
_HEAD = "<qq"  # keys, bits of a quotient
#: Counts from here on stand behind the one-byte counts.
LARGE = 255


@dataclass(frozen=True)
class Shape:
    """How n ids of ``bits`` bits lie in limbs, and the bits of a slot."""

    n: int
    bits: int
    slot_bits: int

    @property
    def per_limb(self) -> int:
        return min(self.n, 64 // self.bits)

    @property
    def limbs(self) -> int:
        return -(-self.n // self.per_limb)

    @property
    def width(self) -> int:
        """Bits of a limb."""
        return self.per_limb * self.bits

    @property
    def slots(self) -> int:
        """Bits of a slot, at most those of the limb."""
        return min(self.slot_bits, self.width)


def _mask(width: int) -> np.uint64:
    return np.uint64((1 << width) - 1)


def pack(columns: list[np.ndarray], shape: Shape) -> np.ndarray:
    """(limbs, keys) from one array of ids per place of the n-gram."""
    out = np.zeros((shape.limbs, len(columns[0])), np.uint64)
    for i, ids in enumerate(columns):
        limb = out[i // shape.per_limb]
        limb <<= np.uint64(shape.bits) if i % shape.per_limb else np.uint64(0)
        limb |= ids.astype(np.uint64)
    return out


def unpack(limbs: np.ndarray, shape: Shape) -> np.ndarray:
    """(keys, n) ids of packed limbs."""
    out = np.zeros((limbs.shape[1], shape.n), np.int64)
    for i in range(shape.n):
        last = min((i // shape.per_limb + 1) * shape.per_limb, shape.n) - 1
        moved = limbs[i // shape.per_limb] >> np.uint64((last - i) * shape.bits)
        out[:, i] = (moved & _mask(shape.bits)).astype(np.int64)
    return out


def _mixed(limb: np.ndarray, width: int) -> np.ndarray:
    spread = limb * _SPREAD
    return (spread ^ (spread >> np.uint64(31))) & _mask(width)


def permute(limbs: np.ndarray, shape: Shape) -> np.ndarray:
    """The limbs after a permutation of their values; limbs are changed in place."""
    width, half = shape.width, np.uint64((shape.width + 1) // 2)
    for odd in _ODD:
        for i in range(shape.limbs - 1, -1, -1):
            if shape.limbs > 1:
                limbs[i] ^= _mixed(limbs[(i + 1) % shape.limbs], width)
            limbs[i] *= np.uint64(odd)
            limbs[i] &= _mask(width)
            limbs[i] ^= limbs[i] >> half
    return limbs


def unpermute(limbs: np.ndarray, shape: Shape) -> np.ndarray:
    """The inverse of :func:`permute`, in place."""
    width, half = shape.width, np.uint64((shape.width + 1) // 2)
    for odd in reversed(_ODD):
        inverse = np.uint64(pow(odd, -1, 1 << 64))
        for i in range(shape.limbs):
            limbs[i] ^= limbs[i] >> half  # its own inverse from half the width on
            limbs[i] *= inverse
            limbs[i] &= _mask(width)
            if shape.limbs > 1:
                limbs[i] ^= _mixed(limbs[(i + 1) % shape.limbs], width)
    return limbs


def counted(limbs: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sum of their counts (or their number)."""
    if not limbs.shape[1]:
        return limbs, np.zeros(0, np.int64)
    if len(limbs) == 1 and counts is None:
        keys, times = np.unique(limbs[0], return_counts=True)
        return keys[None, :], times.astype(np.int64)
    order = np.argsort(limbs[0], kind="stable")
    ordered = limbs[:, order]
    same_first = ordered[0, 1:] == ordered[0, :-1]
    same = (ordered[:, 1:] == ordered[:, :-1]).all(axis=0)
    if (same_first & ~same).any():  # keys that share their first limb
        order = np.lexsort(limbs[::-1])
        ordered = limbs[:, order]
        same = (ordered[:, 1:] == ordered[:, :-1]).all(axis=0)
    starts = np.concatenate([[0], np.flatnonzero(~same) + 1])
    if counts is None:
        times = np.diff(np.append(starts, len(order)))
    else:
        times = np.add.reduceat(counts[order], starts)
    return ordered[:, starts], times.astype(np.int64)


def slot_of(limbs: np.ndarray, shape: Shape) -> np.ndarray:
    """Slot of each permuted key."""
    if not shape.slots:
        return np.zeros(limbs.shape[1], np.int64)
    return (limbs[0] >> np.uint64(shape.width - shape.slots)).astype(np.int64)


def write(limbs: np.ndarray, counts: np.ndarray, shape: Shape) -> bytes:
    """The filter of sorted distinct keys of one slot."""
    n = limbs.shape[1]
    rest = shape.width - shape.slots
    q = min(rest, max(0, int(n - 1).bit_length()))
    low = limbs[0] & _mask(rest)
    quotient = (low >> np.uint64(rest - q)).astype(np.int64) if q else np.zeros(n, np.int64)
    runs = np.zeros(n + (1 << q), np.uint8)
    runs[np.arange(n) + quotient] = 1
    left = -(-(rest - q) // 8)
    remainder = (low & _mask(rest - q)).astype("<u8")
    packed = remainder.view(np.uint8).reshape(n, 8)[:, :left]
    small = np.minimum(counts, LARGE).astype(np.uint8)
    return b"".join(
        [
            struct.pack(_HEAD, n, q),
            np.packbits(runs).tobytes(),
            packed.tobytes(),
            limbs[1:].astype("<u8").tobytes(),
            small.tobytes(),
            counts[counts >= LARGE].astype("<i8").tobytes(),
        ]
    )


def read(blob: bytes, slot: int, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and counts of a filter."""
    n, q = struct.unpack_from(_HEAD, blob)
    data, at = np.frombuffer(blob, np.uint8), struct.calcsize(_HEAD)
    rest = shape.width - shape.slots

    def take(size: int) -> np.ndarray:
        nonlocal at
        at += size
        return data[at - size : at]

    bits = n + (1 << q)
    runs = np.unpackbits(take(-(-bits // 8)), count=bits)
    quotient = (np.flatnonzero(runs) - np.arange(n)).astype(np.uint64)
    left = -(-(rest - q) // 8)
    whole = np.zeros((n, 8), np.uint8)
    whole[:, :left] = take(n * left).reshape(n, left)
    limbs = np.zeros((shape.limbs, n), np.uint64)
    limbs[0] = whole.view("<u8").ravel()
    if q:
        limbs[0] |= quotient << np.uint64(rest - q)
    if shape.slots:
        limbs[0] |= np.uint64(slot << rest)
    limbs[1:] = take(8 * n * (shape.limbs - 1)).copy().view("<u8").reshape(shape.limbs - 1, n)
    counts = take(n).astype(np.int64)
    counts[counts == LARGE] = take(8 * int((counts == LARGE).sum())).copy().view("<i8")
    return limbs, counts


def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One filter's sorted keys and counts from those of several."""
    return counted(np.concatenate([k for k, _ in parts], axis=1), np.concatenate([c for _, c in parts]))
