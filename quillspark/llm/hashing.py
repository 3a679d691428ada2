"""64-bit hashes of all words of a batch of texts, in numpy, without a loop over words."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_TABLE = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
#: Powers kept by a process (16 MB); a longer text has its own, for as long as it is hashed.
KEPT_POWERS = 1 << 20
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX1
    h = (h ^ (h >> np.uint64(27))) * MIX2
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64, for i < n at least."""
    if len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    made = []
    for b in (BASE, np.uint64(pow(int(BASE), -1, 1 << 64))):
        p = np.full(max(n, KEPT_POWERS), b, np.uint64)
        p[0] = 1
        made.append(np.cumprod(p))
    if n <= KEPT_POWERS:
        _powers[:] = made
    return made[0], made[1]


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of the first word of each text and the end), words lower-cased (A-Z) in their order."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    gap = _GAP[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    power, inverse = _power(len(data))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[_LOWER[data]] * power[: len(data)])])
    h = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    first = np.concatenate([[0], np.cumsum(sizes + 1)])
    return h, np.searchsorted(starts, first)


def shingles(h: np.ndarray, first: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles; of fewer words, one of the whole sequence."""
    out: list[np.ndarray] = []
    if len(h) >= n:
        g = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            g = g * BASE + h[k : len(h) - n + 1 + k]
        g = mix(g)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(g[a : b - n + 1]))
        elif b > a:
            s = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for x in h[a:b]:
                    s = s * BASE + x
            out.append(mix(np.array([s])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
