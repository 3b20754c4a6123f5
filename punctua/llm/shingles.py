"""Sets of hashed word shingles of whole texts, vectorised over a batch."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from punctua.llm.grams import pieces_of

WIDTH = 5
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SPACES = [9, 10, 11, 12, 13, 32]
#: A random odd value for each byte; white space counts nothing.
BYTE_VALUE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
BYTE_VALUE[SPACES] = 0
STEP, FOLD = 0x9E3779B97F4A7C15, np.uint64(0xD1342543DE82EF95)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finish that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of STEP and of its inverse (modulo 2 ** 64) up to n."""
    both = []
    for base in (STEP, pow(STEP, -1, 1 << 64)):
        steps = np.full(n, base, dtype=np.uint64)
        steps[0] = 1
        both.append(np.cumprod(steps))
    return both[0], both[1]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and the number of words before each text. Words are runs of anything but ASCII white space, A-Z lower-cased.

    A word's hash is a polynomial in its bytes: summed with the powers of their places in the batch, then divided by that of its start."""
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    data = np.frombuffer(b" ".join(texts).translate(LOWER) + b" ", dtype=np.uint8)
    values = BYTE_VALUE[data]
    inside = values != 0
    starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    if inside[0]:
        starts = np.concatenate([[0], starts])
    up, down = powers(1 << max(20, int(len(data) - 1).bit_length()))
    edges = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
    if not len(starts):
        return np.empty(0, np.uint64), edges
    return mixed(np.add.reduceat(values * up[: len(data)], starts) * down[starts]), edges


def shingle_sets(texts: list, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of each text's shingles of `width` words (of its whole sequence if it has fewer words, none without words), one text after the other, and the edges between texts."""
    words, edges = word_hashes([(t or "").encode("utf-8", "surrogatepass") for t in texts])
    counts = np.diff(edges)
    rolled = np.zeros(len(words), dtype=np.uint64)
    whole = max(0, len(words) - width + 1)
    for j in range(width):
        rolled[:whole] = rolled[:whole] * FOLD + words[j : j + whole]
    rolled = mixed(rolled)
    keep = np.zeros(len(words), dtype=bool)
    for i in np.flatnonzero(counts):
        a, b = edges[i], edges[i + 1]
        if b - a >= width:
            part = rolled[a : b - width + 1]
            part.sort()
            keep[a] = True
            np.not_equal(part[1:], part[:-1], out=keep[a + 1 : b - width + 1])
        else:
            h = int(b - a)
            for w in words[a:b]:
                h = (h * int(FOLD) + int(w)) & 0xFFFFFFFFFFFFFFFF
            rolled[a], keep[a] = mixed(np.array([h ^ 0x5BF03635], dtype=np.uint64))[0], True
    before = np.concatenate([[0], np.cumsum(keep)])
    return rolled[keep], before[edges]


def in_slices(texts: np.ndarray, most: int = 500_000, width: int = WIDTH) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Slices of a batch of texts with bounded bytes, their shingle sets and edges."""
    if len(texts):
        for part in pieces_of(np.array([len(t or "") + 64 for t in texts]), most):
            yield part, *shingle_sets(list(texts[part]), width)


def set_keys(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set, as a signed long (0 for an empty one)."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(values ^ np.uint64(0xA0761D6478BD642F)), dtype=np.uint64)])
    return (total[edges[1:]] - total[edges[:-1]]).view(np.int64)


def ordered(values: np.ndarray) -> np.ndarray:
    """Hashes as signed longs in the same order."""
    return (values ^ np.uint64(1 << 63)).view(np.int64)
