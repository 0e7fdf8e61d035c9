"""Rabin-Karp hashes of all windows of many texts at once.

Texts are laid end to end as code points; prefix sums of a polynomial give the
hash of any stretch by one subtraction and one product. There are two kinds:

* `prefix_sums` and `hashes` count modulo 2^64, which is fast, but texts made for
  it (such as the Thue-Morse word and its complement) collide whatever the base.
  They only choose candidates.
* `prime_sums` and `prime_hashes` count modulo the prime 2^61 - 1. Two different
  texts of n characters agree for at most n of all bases, so with two bases that
  no text knows of, they decide.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
#: Texts are processed in blocks of about so many code points; a longer text is a block of its own.
BLOCK_CHARS = 1 << 20


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, from 0 to n - 1 at least."""
    size = 1 << max(20, (n - 1).bit_length())
    return _powers(size)


PRIME = (1 << 61) - 1
PRIME_BASES = [int.from_bytes(hashlib.sha256(b"window base %d" % k).digest()[:8], "big") % PRIME for k in (1, 2)]


def mulmod(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """a * b modulo PRIME, for numbers below it."""
    b = np.asarray(b, np.uint64)
    low, half = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
    a1, a0, b1, b0 = a >> np.uint64(31), a & low, b >> np.uint64(31), b & low
    mid = a1 * b0 + a0 * b1
    return reduced(((a1 * b1) << np.uint64(1)) + (mid >> np.uint64(30)) + ((mid & half) << np.uint64(31)) + a0 * b0)


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME; 2^61 is 1 there."""
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(61))
    return np.where(x >= np.uint64(PRIME), x - np.uint64(PRIME), x)


@lru_cache(maxsize=4)
def _prime_powers(base: int, bits: int) -> np.ndarray:
    out, step = np.ones(1, np.uint64), base
    for _ in range(bits):
        out = np.concatenate([out, mulmod(out, step)])
        step = step * step % PRIME
    return out


def prime_sums(values: np.ndarray, base: int) -> np.ndarray:
    """The sums that `prime_hashes` needs, one more than values (below 2^32)."""
    n = len(values)
    terms = mulmod(values.astype(np.uint64) + np.uint64(1), _prime_powers(base, max(20, n.bit_length()))[:n])
    high, low = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
    np.cumsum(terms >> np.uint64(31), out=high[1:])
    np.cumsum(terms & np.uint64((1 << 31) - 1), out=low[1:])
    return reduced(mulmod(reduced(high), 1 << 31) + reduced(low))


def prime_hashes(sums: np.ndarray, start: np.ndarray, length: int, base: int) -> np.ndarray:
    """Hashes of the stretches of one length from each start, below PRIME."""
    inverse = _prime_powers(pow(base, -1, PRIME), max(20, len(sums).bit_length()))
    return mulmod(reduced(sums[start + length] + np.uint64(PRIME) - sums[start]), inverse[start])


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits, so that smaller or larger means nothing."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """values: code points or word ids. The sums that `hashes` needs, one more than values."""
    v = (values.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    v ^= v >> np.uint64(32)
    out = np.zeros(len(v) + 1, np.uint64)
    np.cumsum(v * powers(len(v) + 1)[0][: len(v)], out=out[1:])
    return out


def hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the stretches [start, end)."""
    return (sums[end] - sums[start]) * powers(len(sums))[1][start]


def window_hashes(sums: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k values, by start."""
    n = len(sums) - k
    if n <= 0:
        return np.zeros(0, np.uint64)
    return (sums[k:] - sums[:n]) * powers(len(sums))[1][:n]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w successive values, by running minima of blocks of w from both sides."""
    n = len(x) - w + 1
    if n <= 0:
        return np.zeros(0, x.dtype)
    blocks = -(-len(x) // w)
    padded = np.full(blocks * w, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    square = padded.reshape(blocks, w)
    before = np.minimum.accumulate(square, axis=1).reshape(-1)
    after = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(after[:n], before[w - 1 : w - 1 + n])


def blocks(ids, texts, limit: int = BLOCK_CHARS):
    """Yields (ids, starts, code points) of texts laid end to end; starts has one more entry than ids. Null texts are left out."""
    held, held_ids, size = [], [], 0
    for i, t in zip(ids, texts):
        if t is None:
            continue
        held.append(code_points(t))
        held_ids.append(i)
        size += len(held[-1])
        if size >= limit:
            yield np.array(held_ids), np.r_[0, np.cumsum([len(x) for x in held])], np.concatenate(held)
            held, held_ids, size = [], [], 0
    if held:
        yield np.array(held_ids), np.r_[0, np.cumsum([len(x) for x in held])], np.concatenate(held)
