"""Hashed byte n-grams of whole texts, vectorised over a batch."""

from __future__ import annotations

import numpy as np

MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


def joined(texts: list[bytes], pad: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts with spaces between, and for each byte the number of its text."""
    sizes = np.fromiter((len(t) + pad for t in texts), dtype=np.int64, count=len(texts))
    data = np.frombuffer((b" " * pad).join(texts) + b" " * pad, dtype=np.uint8)
    return data, np.repeat(np.arange(len(texts), dtype=np.int32), sizes)


def gram_counts(data: np.ndarray, owner: np.ndarray, n_owners: int, bins: int, orders: tuple[int, ...] = (1, 2, 3)) -> np.ndarray:
    """n_owners x bins counts of hashed byte n-grams; an n-gram belongs to the owner of its first byte and stays within it."""
    total = np.zeros(n_owners * bins, dtype=np.float32)
    wide = data.astype(np.uint32)
    base = owner * bins
    for n in orders:
        if len(data) < n:
            continue
        last = len(data) - n + 1
        h = np.full(last, n, dtype=np.uint32)
        for j in range(n):
            h = (h ^ wide[j : last + j]) * MULTIPLIERS[j]
            h ^= h >> np.uint32(15)
        at = base[:last] + (h % np.uint32(bins))
        whole = owner[:last] == owner[n - 1 :]
        total += np.bincount(at[whole], minlength=n_owners * bins).astype(np.float32)
    return total.reshape(n_owners, bins)


def pieces_of(sizes: np.ndarray, most: int) -> list[slice]:
    """Consecutive slices of a batch with about `most` bytes each."""
    ends = np.cumsum(sizes)
    cuts = np.searchsorted(ends, np.arange(most, ends[-1] + most, most)) + 1 if len(ends) and ends[-1] else np.array([len(ends)])
    edges = np.unique(np.concatenate([[0], np.minimum(cuts, len(ends)), [len(ends)]]))
    return [slice(int(a), int(b)) for a, b in zip(edges, edges[1:], strict=False)]
