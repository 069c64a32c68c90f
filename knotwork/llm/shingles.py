"""Sets of word shingles as sorted 64-bit hashes, without a Python step per word."""

from __future__ import annotations

import numpy as np

WORDS = 5
_B = 0x9E3779B97F4A7C15
_INVERSE = pow(_B, -1, 1 << 64)
_PIECE = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_cache: list[np.ndarray] = []


def power_tables(n: int) -> list[np.ndarray]:
    """Powers of an odd factor and of its inverse, for sums that give the hash of any stretch of bytes."""
    if not _cache or len(_cache[0]) < n:
        _cache[:] = [_powers(_B, max(n, 1 << 16)), _powers(_INVERSE, max(n, 1 << 16))]
    return _cache


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash of each word (bytes without ASCII white space between such), in order."""
    found = []
    at = 0
    while at < len(raw):
        end = min(len(raw), at + _PIECE)
        if end < len(raw):  # pieces end at white space; a longer word is a piece of its own
            cut = max(raw.rfind(s, at, end) for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            end = cut + 1 if cut >= at else min([len(raw), *(x for x in (raw.find(s, end) for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if x >= 0)])
        part = np.frombuffer(raw, np.uint8, end - at, at)
        blank = _SPACE[part]
        edge = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
        first, last = np.flatnonzero(edge < 0), np.flatnonzero(edge > 0)
        if len(first):
            power, inverse = power_tables(len(part))
            with np.errstate(over="ignore"):
                sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)])))
                found.append(mixed((sums[last] - sums[first]) * inverse[first] + (last - first).astype(np.uint64)))
        at = end
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles; a text of fewer words is one shingle, one without words none."""
    w = word_hashes((text or "").encode("utf-8", "surrogatepass"))
    if not len(w):
        return w
    n = min(words, len(w))
    with np.errstate(over="ignore"):
        h = np.full(len(w) - n + 1, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(_B) + w[k : len(w) - n + 1 + k]
        return np.unique(mixed(h))
