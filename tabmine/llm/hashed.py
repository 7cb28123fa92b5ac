"""Hashed word and character n-gram features of texts, vectorised over whole texts in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_B = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(64, _B, dtype=np.uint64), dtype=np.uint64)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


def grams(c: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all windows of n code points."""
    if len(c) < n:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        h = c[: len(c) - n + 1] + np.uint64(n)
        for k in range(1, n):
            h = h * _B + c[k : len(c) - n + 1 + k]
        return h * _B


def words_at(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words between white space, in order, and where each begins."""
    space = (c == 32) | ((c >= 9) & (c <= 13))
    inside = np.flatnonzero(~space)
    if not len(inside):
        return np.zeros(0, dtype=np.uint64), inside
    first = np.concatenate([[True], np.diff(inside) > 1])
    starts = np.flatnonzero(first)
    place = np.arange(len(inside)) - np.repeat(starts, np.diff(np.append(starts, len(inside))))
    with np.errstate(over="ignore"):
        weight = _POWERS[place & 63]
        if place.max() > 63:  # every place has a weight of its own
            weight = weight * (2 * (place >> 6) + 1).astype(np.uint64)
        return np.add.reduceat((c[inside] + np.uint64(7)) * weight, starts), inside[starts]


def words(c: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words between white space, in order."""
    return words_at(c)[0]


def words_of(texts: list[str], most: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the words of many texts and the number of the text each is in, some ``most`` characters at a time."""
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) <= most):
            size += len(texts[last]) + 1
            last += 1
        some = texts[first:last]
        h, at = words_at(codes(" ".join(some)))
        begin = np.cumsum([0, *[len(t) + 1 for t in some[:-1]]])
        yield h, np.searchsorted(begin, at, "right") - 1 + first
        first = last


def pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of pairs of hashes."""
    with np.errstate(over="ignore"):
        h = (a ^ (a >> np.uint64(29))) * _B + b
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def buckets(h: np.ndarray, bits: int) -> np.ndarray:
    """High bits of mixed hashes as bucket numbers."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * _B
    return (h >> np.uint64(64 - bits)).astype(np.int64)
