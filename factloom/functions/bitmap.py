"""Compressed bitmaps over blocks of 65,536 ordinals.

A block is kept as the smaller of two forms: the sorted 16-bit members, or
8,192 bytes of bits. The first byte tells which.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 16
_SPARSE, _DENSE = b"\x00", b"\x01"


def pack(members: np.ndarray) -> bytes:
    """Sorted distinct members, each under BLOCK."""
    if len(members) * 2 <= BLOCK // 8:
        return _SPARSE + members.astype("<u2").tobytes()
    return _DENSE + np.packbits(bits_of(members), bitorder="little").tobytes()


def bits_of(members: np.ndarray) -> np.ndarray:
    bits = np.zeros(BLOCK, dtype=bool)
    bits[members] = True
    return bits


def unpack(block: bytes | None) -> np.ndarray:
    """The members, sorted; a missing block is empty."""
    if not block:
        return np.zeros(0, dtype=np.int64)
    body = np.frombuffer(block, dtype=np.uint8, offset=1)
    if block[:1] == _SPARSE:
        return body.view("<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(body, bitorder="little"))


def _pairwise(a: bytes | None, b: bytes | None, dense_op, sparse_op) -> np.ndarray:
    if a and b and a[:1] == b[:1] == _DENSE:
        x, y = (np.frombuffer(v, dtype=np.uint64, offset=1) for v in (a, b))
        return np.flatnonzero(np.unpackbits(dense_op(x, y).view(np.uint8), bitorder="little"))
    return sparse_op(unpack(a), unpack(b))


def and_not(a: bytes | None, b: bytes | None) -> np.ndarray:
    """Members of a that b lacks."""
    return _pairwise(a, b, lambda x, y: x & ~y, lambda x, y: np.setdiff1d(x, y, assume_unique=True))


def both(a: bytes | None, b: bytes | None) -> np.ndarray:
    return _pairwise(a, b, lambda x, y: x & y, lambda x, y: np.intersect1d(x, y, assume_unique=True))


def rank(block: bytes, members: np.ndarray) -> np.ndarray:
    """Places of `members` among the members of the block."""
    return np.searchsorted(unpack(block), members)
