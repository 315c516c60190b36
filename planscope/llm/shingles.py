"""Sets of word shingles as sorted arrays of 64-bit hashes, for whole texts, vectorised over a batch.

Words are runs other than space, tab, newline, vertical tab, form feed and carriage return, after A-Z are
lower-cased. A text with fewer words than a shingle has its whole word sequence as the one shingle; a text
without words has the empty set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_U = np.uint64
#: A byte's contribution to its word's hash; 0 for the bytes that separate words.
_SEPARATORS = np.array([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[_SEPARATORS] = True
_P = 0xD1342543DE82EF95
_INVERSE = pow(_P, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, dtype=np.uint64)
    step = base
    while len(out) < n:
        out = np.concatenate([out, out * _U(step)])
        step = step * step % (1 << 64)
    return out[:n]


def word_hashes(raw: bytes, separators: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of ``raw``; ``separators`` says which bytes end a word."""
    data = np.frombuffer(raw, dtype=np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    space = separators[data]
    edge = np.diff(np.concatenate(([True], space, [True])).view(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.zeros(0, np.uint64), start
    # prefix sums of byte values times powers; a word's hash is its difference, shifted back to its start.
    # Powers run per stretch of 64 KB, so that the tables stay small whatever the length of the text.
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[_LOWER[data]] * _POWER[np.arange(len(data)) & _MASK])))
    back = _BACK[start & _MASK]
    value = (sums[end] - sums[start]) * back
    wraps = (start & ~_MASK) != ((end - 1) & ~_MASK)
    for i in np.flatnonzero(wraps):  # words across a stretch's end, and words longer than a stretch
        value[i] = (_BYTE[_LOWER[data[start[i] : end[i]]]] * _powers(_P, int(end[i] - start[i]))).sum()
    return mix(value + _U(0x632BE59BD9B4E019) * (end - start).astype(np.uint64)), start


_MASK = (1 << 16) - 1
_POWER, _BACK = _powers(_P, 1 << 16), _powers(_INVERSE, 1 << 16)


def batches(texts: list[str | None], size: int = 1_000_000) -> Iterator[tuple[int, int]]:
    lo = 0
    while lo < len(texts):
        hi, n = lo, 0
        while hi < len(texts) and (hi == lo or n < size):
            n += len(texts[hi] or "")
            hi += 1
        yield lo, hi
        lo = hi


def shingle_sets(texts: list[str | None], words: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct shingle hashes."""
    for lo, hi in batches(texts):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts[lo:hi]]
        offset = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw])))
        h, start = word_hashes(b"\n".join(raw))
        cut = np.searchsorted(start, offset)
        # a shingle's hash from its words' hashes in order
        if len(h) >= words:
            s = h[: len(h) - words + 1].copy()
            for j in range(1, words):
                s = mix(s * _U(3) + h[j : len(h) - words + 1 + j])
        else:
            s = h[:0]
        for k in range(hi - lo):
            a, b = cut[k], cut[k + 1]
            if b - a >= words:
                yield np.unique(s[a : b - words + 1])
            elif b > a:
                v = np.array([b - a], dtype=np.uint64)
                for i in range(a, b):
                    v = mix(v * _U(5) + h[i : i + 1])
                yield v
            else:
                yield np.zeros(0, np.uint64)


def set_signature(s: np.ndarray) -> int:
    """A signed 64-bit hash of the whole set."""
    if not len(s):
        return 0
    v = mix(np.bitwise_xor.reduce(mix(s + _U(7)), keepdims=True) + mix(s).sum(keepdims=True) * _U(0x9E3779B97F4A7C15) + _U(len(s)))
    return int(v.view(np.int64)[0])
