"""Operator 12 against brute force, and its estimator against the truth."""

import random

import numpy as np
from pyspark.sql import functions as F

from punctua.llm import minhash
from tests.llm.test_operators import LOWER, WORD


def sets_of(texts, width=4):
    found = []
    for text in texts:
        words = WORD.findall((text or "").translate(LOWER))
        found.append({tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} - {()})
    return found


def brute(rows):
    sets = sets_of([t for _, t in rows])
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * len(a | sets[j]):
                root[top(i)] = top(j)
    names = {}
    for i, (doc_id, _) in enumerate(rows):
        best = names.get(top(i))
        names[top(i)] = doc_id if best is None else best if doc_id is None else min(best, doc_id)
    return [(doc_id, len(sets[i]), names[top(i)] if sets[i] else doc_id, doc_id == (names[top(i)] if sets[i] else doc_id)) for i, (doc_id, _) in enumerate(rows)]


def corpus():
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for i in range(60):
        rows.append((i, " ".join(word() for _ in range(rng.randint(1, 90)))))
    base = [word() for _ in range(120)]
    for k in range(50):  # a chain and a cloud of near copies around one text, many of them just under the threshold to each other
        edited = list(base)
        for _ in range(rng.randint(0, 9)):
            edited[rng.randrange(120)] = word()
        rows.append((1000 + k, " ".join(edited)))
        base = edited if k % 10 == 9 else base
    for k in range(1, 9):  # cut tails, at the threshold exactly for k = 4 (20 of 16)
        rows.append((2000 + k, " ".join(f"w{i}" for i in range(23 - k))))
    rows += [(3000, None), (3001, ""), (3002, " \n"), (3003, "one two"), (3004, "ONE  two"), (3005, "one"), (3006, "x " * 30_000), (3007, "X " * 9), (3008, "é😀 ü a b c d"), (3009, "é😀 ü a b c d")]
    rows += [(None, rows[3][1]), (None, "alone among nulls a b c d"), (None, "alone among nulls a b c d"), (9007199254740993, rows[70][1] + " end"), (5, "another text of the same id"), (5, rows[5][1]), (5, rows[5][1])]
    return rows


KEY = lambda r: tuple((x is not None, x) for x in r)


def test_near_duplicates(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("n", "node", "key", "sketch", "size", "component", "sig")}).repartition(5)
    got = sorted((tuple(r) for r in minhash.near_duplicates(docs).collect()), key=KEY)
    expected = brute(rows)
    assert got == sorted(((i, n, c, (i == c)) for i, n, c, _ in expected), key=KEY)


def test_large_group(spark):
    """A group of near copies that holds most rows, and copies of one text."""
    rng, base = random.Random(2), [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(f"v{rng.randrange(12)}" if rng.random() < 0.02 else w for w in base)) for i in range(150)] + [(500 + i, "one text with very many copies") for i in range(200)]
    got = sorted(tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect())
    assert got == sorted(brute(rows))


def test_empty(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_estimates():
    rng = np.random.default_rng(1)
    errors = []
    for shared, a_only, b_only in [(900, 50, 50), (400, 100, 0), (80, 300, 10), (0, 200, 400), (500, 0, 0)] * 8:
        pool = rng.integers(0, 1 << 63, shared + a_only + b_only, dtype=np.uint64) * np.uint64(2)
        a, b = pool[: shared + a_only], np.concatenate([pool[:shared], pool[shared + a_only :]])
        x, y = minhash.sketches(np.concatenate([a, b]), np.array([0, len(a)])).astype(int)
        union = minhash.sketches(pool, np.array([0]))[0]
        assert (np.maximum(x, y) == union).all()  # sketches merge
        n = np.array([float(len(a))]), np.array([float(len(b))])
        counts = np.array([(x > y).sum()]), np.array([(x < y).sum()])
        best = minhash.estimated(*n, *counts)[0]
        grid = np.linspace(0, min(len(a) / len(b), len(b) / len(a)), 500)
        likelihoods = [minhash.log_likelihood(np.array([g]), *n, *counts)[0] for g in grid]
        assert minhash.log_likelihood(np.array([best]), *n, *counts)[0] >= max(likelihoods) - 1e-4
        errors.append(best - shared / len(pool))
    assert abs(np.mean(errors)) < 0.02 and np.abs(errors).max() < 0.15
