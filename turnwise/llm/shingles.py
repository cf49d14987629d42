"""Word shingles as 64-bit hashes and their MinHash signatures, in numpy.

Word hashes come from prefix polynomial hashes modulo 2^64 (B odd, so that the
hash of any range is a difference times an inverse power) and are then mixed,
all vectorised over the bytes of many documents.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE = np.uint64(0x9E6C63D0876A9A47)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@lru_cache(maxsize=2)
def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd ``base`` and of its inverse modulo 2^64, at least ``n``."""
    inv = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inv):
        p = np.ones(n, np.uint64)
        if n > 1:
            p[1:] = np.uint64(b)
            np.multiply.accumulate(p, out=p)
        out.append(p)
    return out[0], out[1]


def prefix_hash(data: np.ndarray, base: int = int(_BASE)) -> tuple[np.ndarray, np.ndarray]:
    """(prefix sums of byte * base^i, inverse powers)."""
    size = 1 << max(12, int(len(data)).bit_length())
    up, down = powers(base, size)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return total, down


def range_hash(total: np.ndarray, down: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (total[end] - total[start]) * down[start]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(data: np.ndarray, off: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, first word of each document and the total, first and last byte of each word)."""
    low = LOWER[data]
    on = ~space[low]
    before = np.empty(len(on) + 1, bool)
    before[0], before[1:] = False, on
    edge = np.zeros(len(on) + 1, bool)
    edge[off] = True  # words never cross documents
    start = np.flatnonzero(on & (~before[:-1] | edge[:-1]))
    after = np.empty(len(on), bool)
    after[:-1], after[-1:] = ~on[1:], True
    end = np.flatnonzero(on & (after | edge[1:])) + 1
    total, down = prefix_hash(low)
    return mix(range_hash(total, down, start, end)), np.searchsorted(start, off), start, end


def sets(data: np.ndarray, off: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingles of ``size`` words of each document.

    A document of fewer words, but not none, has its whole sequence as one.
    """
    h, first, _, _ = words(data, off)
    gram = np.zeros(len(h), np.uint64)
    for k in range(size):
        n = max(0, len(h) - k)
        gram[:n] = gram[:n] * np.uint64(0xD6E8FEB86659FD93) + h[k : k + n]
    gram = mix(gram + np.uint64(size))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            s = np.sort(gram[a : b - size + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            x = np.array([b - a], np.uint64)
            for k in range(a, b):
                x = x * np.uint64(0xA0761D6478BD642F) + h[k]
            out.append(mix(x))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


@lru_cache(maxsize=4)
def permutations(k: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(0, 1 << 32, k, dtype=np.uint32) | np.uint32(1), r.integers(0, 1 << 32, k, dtype=np.uint32)


def signature(shingles: np.ndarray, k: int) -> np.ndarray:
    """``k`` minima of affine permutations of the upper halves of the hashes."""
    a, b = permutations(k)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(k, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 512):
        np.minimum(out, (x[i : i + 512, None] * a + b).min(axis=0), out=out)
    return out
