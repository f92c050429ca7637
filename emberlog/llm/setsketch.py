"""SetSketch registers of shingle sets, and the likelihood of a similarity given two sketches.

Register i holds K = floor(1 - log_b(min h_i)) cut to 0 .. 65535, where h_i spreads the
elements exponentially: minima on an exponentially spaced scale. Sketches merge by the
maximum, and two registers are equal with about the probability of the Jaccard similarity.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

REGISTERS = 128
ROWS = 4
BASE = 1.001
RATE = 20.0
TOP = 65535
BLOCK = 4096

_rng = np.random.Generator(np.random.Philox(20240229))
_SEEDS = _rng.integers(0, 2**64, REGISTERS, dtype=np.uint64)
_FACTORS = _rng.integers(0, 2**64, REGISTERS, dtype=np.uint64) | np.uint64(1)
_STEPS = _rng.integers(0, 2**64, 16, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _STEPS[0]
    x = (x ^ (x >> np.uint64(29))) * _STEPS[1]
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``size`` words; of all words if there are fewer.

    Words are split at ASCII white space, A-Z lower-cased: just what bytes.lower and bytes.split do.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    run = min(size, len(h))
    n = len(h) - run + 1
    x = np.full(n, np.uint64(run))
    for k in range(run):
        x = mix(x + h[k:k + n])
    return np.unique(x)


def registers(shingles: np.ndarray) -> np.ndarray:
    """uint16 registers of a set; all 0 for the empty set."""
    if not len(shingles):
        return np.zeros(REGISTERS, dtype=np.uint16)
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for lo in range(0, len(shingles), BLOCK):
        x = shingles[lo:lo + BLOCK, None] ^ _SEEDS
        x *= _FACTORS
        np.minimum(least, x.min(axis=0), out=least)
    u = (least.astype(np.float64) + 0.5) / 2.0**64
    k = np.floor(1.0 - np.log(-np.log1p(-u) / RATE) / np.log(BASE))
    return np.clip(k, 0, TOP).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def band_keys(regs: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band of ``rows`` registers (the band's number is part of it)."""
    bands = regs.astype(np.uint64).reshape(-1, rows)
    x = mix(np.arange(len(bands), dtype=np.uint64) + np.uint64(1))
    for k in range(rows):
        x = mix(x + bands[:, k])
    return x.view(np.int64)


def set_digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that name the set."""
    d = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def _unequal(x: np.ndarray) -> np.ndarray:
    """Probability that one register exceeds the other when its own part of the union has share x."""
    return -np.log1p(-np.clip(x, 0.0, 1.0) * (BASE - 1) / BASE) / np.log(BASE)


def log_likelihood(j: np.ndarray, n1, n2, more, less, equal) -> np.ndarray:
    """Of similarity j, given both set sizes and how many registers are larger, smaller, equal."""
    u, v = n1 / (n1 + n2), n2 / (n1 + n2)
    up, down = _unequal(u - v * j), _unequal(v - u * j)

    def term(count, p):
        return np.where(count > 0, count * np.log(np.maximum(p, 1e-300)), 0.0)

    return term(more, up) + term(less, down) + term(equal, 1 - up - down)


def most_likely(n1, n2, more, less, equal, steps: int = 40) -> np.ndarray:
    """The similarity of largest likelihood (concave in j), by golden section."""
    n1, n2 = np.asarray(n1, dtype=np.float64), np.asarray(n2, dtype=np.float64)
    lo, hi = np.zeros(n1.shape), np.minimum(n1, n2) / np.maximum(n1, n2)
    g = (np.sqrt(5) - 1) / 2
    for _ in range(steps):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        left = log_likelihood(a, n1, n2, more, less, equal) >= log_likelihood(b, n1, n2, more, less, equal)
        lo, hi = np.where(left, lo, a), np.where(left, b, hi)
    return (lo + hi) / 2


def may_reach(threshold: float, n1: np.ndarray, n2: np.ndarray, regs1: np.ndarray, regs2: np.ndarray,
              margin: float = 25.0) -> np.ndarray:
    """False where a similarity of ``threshold`` is less likely than the best one by a factor over e**margin."""
    n1, n2 = n1.astype(np.float64), n2.astype(np.float64)
    more, less = (regs1 > regs2).sum(axis=1), (regs1 < regs2).sum(axis=1)
    equal = regs1.shape[1] - more - less
    best = most_likely(n1, n2, more, less, equal)
    at = np.minimum(threshold, np.minimum(n1, n2) / np.maximum(n1, n2))
    gap = log_likelihood(best, n1, n2, more, less, equal) - log_likelihood(at, n1, n2, more, less, equal)
    return (best >= threshold) | (gap <= margin)
