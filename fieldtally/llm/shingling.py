"""Hashes of word shingles, for many texts at a time."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

WORDS = 5
#: Texts are hashed together up to so many bytes; a longer text alone.
BATCH_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BYTES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_STEP, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A well-known 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(size, _STEP, np.uint64)
    down = np.full(size, _BACK, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n (at least) of the step and of its inverse modulo 2**64."""
    return _powers(1 << max(20, int(n + 1).bit_length()))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text and the end), A-Z in lower case."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    begins = np.concatenate([[0], np.cumsum(lengths)])
    data = _LOWER[data]
    inside = np.concatenate([[False], ~_SPACE[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    first, end = edges[::2], edges[1::2]
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=sums[1:])
    hashes = mix((sums[end] - sums[first]) * down[first] + (end - first).astype(np.uint64))
    return hashes, np.searchsorted(first, begins)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """For each text, the sorted distinct hashes of its shingles: WORDS words, or all of a shorter text; empty without words."""
    words, at = word_hashes(texts)
    counts = np.diff(at)

    def combined(starts: np.ndarray, n: int) -> np.ndarray:
        h = np.full(len(starts), n, np.uint64)
        for k in range(n):
            h = mix(h * np.uint64(0x100000001B3) + words[starts + k])
        return h

    full = combined(np.arange(max(0, len(words) - WORDS + 1)), WORDS)
    out = []
    for i, n in enumerate(counts):
        if n >= WORDS:
            out.append(np.unique(full[at[i] : at[i + 1] - WORDS + 1]))
        else:
            out.append(combined(at[i : i + 1], int(n)) if n else np.empty(0, np.uint64))
    return out


def grouped(texts: list[bytes]):
    """Lists of texts of about BATCH_BYTES together."""
    group, size = [], 0
    for t in texts:
        if group and size + len(t) > BATCH_BYTES:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group
