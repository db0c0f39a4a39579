"""Distinct word shingles of whole texts as 64-bit hashes, many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5
_BASE = 0x100000001B3
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> list[np.ndarray]:
    """The powers of the base and of its inverse, at least ``n`` of them; kept by the worker."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 21)
        _POWERS[:] = [np.cumprod(np.full(size, b, dtype=np.uint64)) for b in (_BASE, _INVERSE)]
    return _POWERS


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """For each text its distinct shingles' hashes, sorted: runs of five words, A-Z in lower case.

    A text with one to four words has one shingle, all of them; one without words has none.
    """
    raws = [(x or "").encode("utf-8", "replace") for x in texts]
    begins = np.cumsum([0] + [len(r) + 1 for r in raws])
    data = _LOWER[np.frombuffer(b" ".join([*raws, b""]), dtype=np.uint8)]
    blank = _BLANK[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if len(data) and not blank[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[::2], edge[1::2]
    up, down = _powers(len(data) + 1)
    # a word's hash: its bytes as a polynomial, brought down to the power of its first byte
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    words = mixed((sums[ends] - sums[starts]) * down[starts])
    first = np.searchsorted(starts, begins)
    if len(words) >= WORDS:
        n = len(words) - WORDS + 1
        runs = words[:n] * _PLACES[0]
        for k in range(1, WORDS):
            runs += words[k : k + n] * _PLACES[k]
        runs = mixed(runs)
    for a, b in zip(first.tolist(), first[1:].tolist(), strict=False):
        if b - a >= WORDS:
            h = np.sort(runs[a : b - WORDS + 1])
            yield h[np.concatenate([[True], h[1:] != h[:-1]])]
        elif b > a:
            yield mixed((words[a:b] * _PLACES[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a))
        else:
            yield np.zeros(0, dtype=np.uint64)


def sliced(texts: list, most: int = 2_000_000) -> Iterator[slice]:
    """Slices of about ``most`` characters."""
    at = size = 0
    for i, x in enumerate(texts):
        size += len(x or "")
        if size >= most:
            yield slice(at, i + 1)
            at, size = i + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted sets share."""
    if not len(a) or not len(b):
        return 0
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    return int((a[at] == b).sum())
