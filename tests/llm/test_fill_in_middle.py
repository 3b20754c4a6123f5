"""Operator 11 against a plain version by regular expressions."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from punctua.llm import fill_in_middle as fim


def plain(doc_id, text, rate=100, late=50):
    text = text or ""
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted([h[0] % (n + 1), h[1] % (n + 1)])
    p, m, s = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    if h[3] % 100 < late:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts(rng):
    signs = ["a", "\n", "é", "😀", "<", "P", ">", "漢", "<P", "<P>", "<M>", "S>"]
    return ["".join(rng.choice(signs[: rng.choice([4, 8, 12])]) for _ in range(rng.choice([0, 1, 7, 400]))) for _ in range(rng.randint(1, 30))]


@pytest.mark.parametrize("block, steps", [(5, 3), (64, 16), (1 << 20, 256)])
def test_blocks_and_lanes(monkeypatch, block, steps):
    """However the bytes are cut into blocks and lanes."""
    monkeypatch.setattr(fim, "BLOCK", block)
    monkeypatch.setattr(fim, "STEPS", steps)
    rng = random.Random(block)
    for _ in range(25):
        found = texts(rng)
        draws = [[int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[8 * j : 8 * j + 8], 16) for j in range(4)] for i in range(len(found))]
        got = fim.transformed([t.encode() for t in found], np.array(draws), 100, 50)
        assert [(*r[:4], r[4].decode()) for r in got] == [plain(i, t) for i, t in enumerate(found)]


def test_automaton_forgets():
    """Any two states meet after MEMORY bytes, whatever these are."""
    table = fim.automaton()
    classes = [ord("a"), ord("\n"), ord("<"), ord("P"), ord(">"), 0x80, 0xC3, 0xE2, 0xF0, fim.END]
    for a in classes:
        for b in classes:
            for c in classes:
                ends = set()
                for state in range(7):
                    for byte in (a, b, c):
                        state = int(table[state * 256 + byte]) & 7
                    ends.add(state)
                assert len(ends) == 1


def test_documents(spark):
    rng = random.Random(3)
    rows = [(i, t) for i, t in enumerate(texts(rng) + texts(rng) + texts(rng))]
    rows += [(None, "no id\nat all"), (None, None), (9007199254740993, "a\nb\nc\n"), (9007199254740993, "other\ntext"), (5, None), (6, ""), (7, "\n" * 5000), (8, "one line " * 200_000), (8, "é\n" * 300_000), (7, "\n" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("x")).withColumn("fim", F.lit(1)).withColumn("form", F.lit(None).cast("string")).repartition(3)
    out = fim.fill_in_middle(docs)
    assert out.columns == docs.columns
    key = lambda r: tuple((x is not None, x) for x in r)
    got = sorted(((r["doc_id"], r["text"], *r["fim"]) for r in out.collect()), key=key)
    assert got == sorted(((i, t, *plain(i, t)) for i, t in rows), key=key)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    digests = sorted((tuple(r) for r in fim.transform_documents(docs).collect()), key=key)
    assert digests == sorted(((i, *plain(i, t)[:4], sha(plain(i, t)[4]), sha(t)) for i, t in rows), key=key)
    some = fim.fill_in_middle(docs, rate=30, suffix_first=0).collect()
    assert all(tuple(r["fim"]) == plain(r["doc_id"], r["text"], 30, 0) for r in some)


def test_empty(spark):
    assert fim.transform_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
