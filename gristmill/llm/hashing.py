"""Hashes of words and shingles of many texts at once, without a Python object for each word.

A word's hash is the sum of a random 64-bit number of each byte times a power of an odd multiplier by its place, mixed;
a shingle's is the same over its words' hashes. All arithmetic is modulo 2^64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 18
_random = np.random.default_rng(0x5EED)
_BYTE = _random.integers(0, 1 << 64, 256, np.uint64)
_BYTE[[9, 10, 11, 12, 13, 32]] = 0
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLACES = 4096
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C13)
_POWER = np.cumprod(np.full(_PLACES, _MULTIPLIER, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z in lower case, and where each text's words begin (one more for the end)."""
    joined = np.frombuffer(b"\n".join(texts).lower(), np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    edges = np.concatenate(([0], np.cumsum(lengths)))
    space = _SPACE[joined]
    first = ~space
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    body = joined[starts[0] :]
    place = np.arange(len(body)) - np.repeat(starts - starts[0], np.diff(np.append(starts, len(joined))))
    sums = np.add.reduceat(_BYTE[body] * _POWER[place & (_PLACES - 1)], starts - starts[0])
    return mix(sums), np.searchsorted(starts, edges)


def _windows(h: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = mix(out * _MULTIPLIER + h[i : len(h) - k + 1 + i])
    return out


def chunks(texts: list[bytes], most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of texts of about `most` bytes."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def shingle_sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """For each text its distinct k-word shingles, hashed and sorted: the whole sequence where it is shorter, none without words."""
    for i, j in chunks(texts):
        h, at = word_hashes(texts[i:j])
        windows = _windows(h, k) if len(h) >= k else np.empty(0, np.uint64)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if b - a >= k:
                yield np.unique(windows[a : b - k + 1])
            else:
                yield _windows(h[a:b], b - a) if b > a else np.empty(0, np.uint64)
