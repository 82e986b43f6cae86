"""Word shingles as 64-bit hashes, in numpy over the bytes of many texts at once."""

from __future__ import annotations

import numpy as np

#: Bytes of text that are hashed at once; a longer text is hashed alone.
BLOCK = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_IN = np.array([c >= 0x80 or 0x30 <= c <= 0x39 or 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A for c in range(256)])
_powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(1 << 16, _P)]))
_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_inverse = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(1 << 16, _INV)]))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grow(n: int) -> None:
    global _powers, _inverse
    if n > len(_powers):
        _powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, _P)]))
        _inverse = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, _INV)]))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of a text in UTF-8: runs of ASCII letters (A-Z as a-z), digits and non-ASCII bytes."""
    b = np.frombuffer(raw, np.uint8)
    inside = _IN[b]
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return start, np.empty(0, np.uint64)
    _grow(len(b))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((_LOW[b].astype(np.uint64) + np.uint64(1)) * _powers[: len(b)])])
    h = (sums[end] - sums[start]) * _inverse[start]
    return start, mix(h ^ mix((end - start).astype(np.uint64)))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` words; fewer words, but not none, are one shingle."""
    n = len(words)
    if n == 0:
        return words
    size = min(width, n)
    h = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        h = mix(h + words[k : n - size + 1 + k] + np.uint64(k + 1))
    return h


def shingle_sets(texts: list[str | None], width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    part: list[bytes] = []
    size = 0

    def flush() -> None:
        start, words = word_hashes(b"\n".join(part))
        cuts = np.searchsorted(start, np.cumsum([len(x) + 1 for x in part]))
        a = 0
        for b in cuts.tolist():
            out.append(np.unique(shingle_hashes(words[a:b], width)))
            a = b

    for text in texts:
        raw = (text or "").encode()
        if part and size + len(raw) > BLOCK:
            flush()
            part, size = [], 0
        part.append(raw)
        size += len(raw) + 1
    if part:
        flush()
    return out


def coefficients(n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def signature(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """MinHash signatures, one row a set; sets are not empty. Values are the upper halves of 64-bit products. Sets are
    taken some at a time, so that what is at work stays in the processor's cache."""
    out = np.empty((len(sets), len(a)), np.uint32)
    lo = 0
    while lo < len(sets):
        hi, size = lo + 1, len(sets[lo])
        while hi < len(sets) and size + len(sets[hi]) <= 1 << 16:
            size += len(sets[hi])
            hi += 1
        flat = np.concatenate(sets[lo:hi])
        starts = np.cumsum([0, *map(len, sets[lo : hi - 1])])
        for j in range(len(a)):
            out[lo:hi, j] = np.minimum.reduceat(((flat * a[j] + b[j]) >> np.uint64(32)).astype(np.uint32), starts)
        lo = hi
    return out
