"""Character n-gram features shared by the text classifiers.

The n-grams of a lower-cased text are hashed to 2**BITS buckets with a polynomial hash over code points. A
model keeps a table from bucket to feature number (-1: none) of fixed size, so what is sent to the executors
does not grow with the corpus. Texts are taken whole, in chunks bounded by characters and by documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BITS = 22
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def chunks(texts: list[str], chars: int = 500_000, docs: int = 256) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about so many characters, one text at least."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and hi - lo < docs and (hi == lo or size + len(texts[hi]) <= chars):
            size += len(texts[hi])
            hi += 1
        yield lo, hi
        lo = hi


def buckets(texts: list[str], sizes: tuple[int, ...], spaces: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size: document numbers and buckets of all n-grams (a space is added at both ends)."""
    low = [" " + t.lower() + " " for t in texts]
    length = np.fromiter(map(len, low), dtype=np.int64, count=len(low))
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    doc = np.repeat(np.arange(len(low), dtype=np.int32), length)
    h = codes.copy()
    for n in range(1, max(sizes) + 1):
        if n > 1:
            h = h[: len(codes) - n + 1] * _BASE + codes[n - 1 :]
        if n in sizes and len(h):
            own = doc[: len(h)]
            mixed = ((h ^ (h >> np.uint64(29)) ^ np.uint64(n)) * _MIX) >> np.uint64(64 - BITS)
            inside = own == doc[n - 1 :]
            yield own[inside], mixed[inside].astype(np.int64)


def presence(texts: list[str], slots: np.ndarray, features: int, sizes: tuple[int, ...]) -> np.ndarray:
    """0/1 matrix (float32) of documents by features."""
    out = np.zeros(len(texts) * features, dtype=np.float32)
    for doc, bucket in buckets(texts, sizes):
        feature = slots[bucket]
        hit = feature >= 0
        out[doc[hit].astype(np.int64) * features + feature[hit]] = 1.0
    return out.reshape(len(texts), features)


def presence_matrix(texts: list[str], slots: np.ndarray, features: int, sizes: tuple[int, ...]) -> np.ndarray:
    """``presence`` of all texts, filled in place."""
    out = np.empty((len(texts), features), dtype=np.float32)
    for lo, hi in chunks(texts):
        out[lo:hi] = presence(texts[lo:hi], slots, features, sizes)
    return out


def document_counts(texts: list[str], groups: np.ndarray, n_groups: int, sizes: tuple[int, ...]) -> np.ndarray:
    """In how many documents of each group a bucket occurs: array (n_groups, 2**BITS)."""
    out = np.zeros((n_groups, 1 << BITS), dtype=np.int32)
    for lo, hi in chunks(texts):
        for doc, bucket in buckets(texts[lo:hi], sizes):
            pairs = np.unique((doc.astype(np.int64) << BITS) | bucket)
            group, bucket = groups[lo:hi][pairs >> BITS], pairs & ((1 << BITS) - 1)
            for k in range(n_groups):
                out[k] += np.bincount(bucket[group == k], minlength=1 << BITS).astype(np.int32)
    return out


def slot_table(chosen: np.ndarray) -> np.ndarray:
    slots = np.full(1 << BITS, -1, dtype=np.int16)
    slots[chosen] = np.arange(len(chosen), dtype=np.int16)
    return slots


def logistic(x: np.ndarray, y: np.ndarray, *, l2: float, steps: int = 300, rate: float = 0.05, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Linear logistic fits of the columns of ``y`` (0/1) on ``x`` by full-batch Adam; returns weights and biases."""
    y = y.reshape(len(y), -1).astype(np.float32)
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    rows = np.ones((len(y), 1), np.float32) if weight is None else weight.reshape(-1, 1).astype(np.float32)
    rows = rows / rows.sum()
    for t in range(1, steps + 1):
        err = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y) * rows
        g, gb = x.T @ err + l2 * w, err.sum(0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a, c = 1 - 0.9**t, 1 - 0.999**t
        w -= rate * (m / a) / (np.sqrt(v / c) + 1e-8)
        b -= rate * (mb / a) / (np.sqrt(vb / c) + 1e-8)
    return w, b
