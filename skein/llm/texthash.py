"""Words of many texts at once, as numpy arrays of hashes."""

from __future__ import annotations

import numpy as np

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes hashed at once.
PART = 1 << 21
_RNG = np.random.default_rng(20240229)
_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWER = np.cumprod(np.concatenate([[np.uint64(1)], np.full((1 << 16) - 1, _M1)]), dtype=np.uint64)
_HIGH = np.cumprod(np.concatenate([[np.uint64(1)], np.full((1 << 14) - 1, 1, dtype=np.uint64) * _POWER[-1:] * _M1]), dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M2
    h = (h ^ (h >> np.uint64(29))) * _M1
    return h ^ (h >> np.uint64(32))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (a run without ASCII white space, A-Z lower-cased), and where each text's words begin (and all end)."""
    size = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    b = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    starts, hashes, at = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    while at < len(b):
        end = at + PART
        while end < len(b) and not _SPACE[b[end - 1]]:  # to the end of the word
            rest = np.flatnonzero(_SPACE[b[end : end + PART]])
            end += int(rest[0]) + 1 if len(rest) else PART
        start, h = _hashed(b[at:end])
        starts.append(start + at)
        hashes.append(h)
        at = end
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), np.concatenate([[0], np.cumsum(size)]))


def _hashed(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of some bytes."""
    space = _SPACE[b]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    start = edge[::2]
    if not len(start):
        return start, np.zeros(0, np.uint64)
    length = np.append(edge[1::2], len(b))[: len(start)] - start
    offset = np.arange(len(b)) - np.concatenate([np.zeros(start[0], np.int64), np.repeat(start, np.diff(np.append(start, len(b))))])
    value = _VALUE[_LOWER[b]]
    value[space] = 0
    if int(length.max()) < len(_POWER):
        value *= _POWER[np.minimum(offset, len(_POWER) - 1)]
    else:
        value *= _POWER[offset & 0xFFFF] * _HIGH[(offset >> 16) & 0x3FFF]
    return start, mixed(np.add.reduceat(value, start) + length.astype(np.uint64))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive entries."""
    if len(words) < n:
        return words[:0]
    h = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        h = mixed(h * _M1 + words[k : len(words) - n + 1 + k] + np.uint64(k))
    return h


def shingle_sets(texts: list[bytes], n: int = 5) -> list[np.ndarray]:
    """For each text, the sorted distinct hashes of its n-word shingles; of a shorter text the whole sequence is one; without words empty."""
    words, begins = word_hashes(texts)
    grams = ngram_hashes(words, n)
    out = []
    for a, z in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        if z - a >= n:
            out.append(np.unique(grams[a : z - n + 1]))
        elif z > a:
            out.append(mixed(ngram_hashes(words[a:z], z - a) + np.uint64(z - a)))
        else:
            out.append(grams[:0])
    return out
