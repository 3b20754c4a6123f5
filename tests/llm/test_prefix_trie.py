"""Operator 13 against a plain trie."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from punctua.llm import prefix_trie
from tests.llm.test_operators import WORD

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append(((turn is not None, turn or 0), hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    whole = {}
    for c, ts in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - (c % 20 if c >= 0 else -(-c % 20))
        whole[c] = own.get(base, [])[:h] + ts[h:]
    members = defaultdict(list)
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    leaves, saved, children = defaultdict(int), defaultdict(int), defaultdict(int)
    for k in members:
        if k:
            children[k[:-1]] += 1
    for k, cs in members.items():
        words = len(WORD.findall(k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += children[k] == 0
            saved[k[:d]] += (len(cs) - 1) * words
    out = []
    for k, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(whole[c]) == len(k))
        out.append((min(cs), len(k), min(members[k[:-1]]) if k else None, len(cs), children[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0], r[1]))


def corpus(seed):
    rng, rows = random.Random(seed), []
    say = lambda: rng.choice(["hello there", "yes", "no", "", None, "a b c", "ünï cödé", " \t "])
    for c in range(-25, 130):
        if rng.random() < 0.85:
            rows += [(c, t if rng.random() < 0.9 else rng.choice([None, 1]), rng.choice(["user", "assistant", None]), say()) for t in range(rng.randint(1, 6))]
    for c in range(400, 440):  # each goes one turn further than the one before: a long row of chains
        rows += [(c * 20, t, "user", f"step {t}") for t in range(c - 399)]
    rows += [(c, t, "user", "the same words") for c in range(900, 960) for t in range(4)]  # one conversation many times
    rows += [(2000, t % 7, "user", f"turn {t % 11}") for t in range(150)]  # a long one with ties
    rows += [(2001, None, "user", "again and again")] * 80  # repeated rows
    rows += [(None, 1, "user", "nobody's"), (3000, 5, None, None), (9007199254740993, 1, "user", "a large id")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, chunk", [(1, 1024), (2, 3)])
def test_trie(spark, monkeypatch, seed, chunk):
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    monkeypatch.setattr(prefix_trie, "ID_BITS", 10 if chunk > 3 else 1)
    rows = corpus(seed)
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("depth", "k", "digest", "words", "piece", "n", "base", "h")}).repartition(3)
    got = sorted((tuple(r) for r in prefix_trie.conversation_trie(frame).collect()), key=lambda r: (r[0], r[1]))
    assert got == plain(rows)


def test_empty(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    lone = spark.createDataFrame([(7, 1, "user", "x")], SCHEMA)
    assert [tuple(r) for r in prefix_trie.conversation_trie(lone).collect()] == plain([(7, 1, "user", "x")])
