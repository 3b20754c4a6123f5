"""Operators 2, 6 and 7 against plain versions: loops over passages, languages and documents."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from punctua.llm import language, mixing, quality
from tests.llm.test_operators import prose

MASK = 0xFFFFFFFF


def gram_bin(data, n, bins):
    """The bin of one n-gram, by integers."""
    h = n
    for byte, factor in zip(data, (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D), strict=False):
        h = (h ^ byte) * factor & MASK
        h ^= h >> 15
    return h % bins


def plain_passage(piece):
    shares = [0.0] * quality.N_CLASSES
    for byte in piece:
        shares[int(quality.CLASS[byte])] += 1
    grams = [0.0] * quality.BINS
    for n in (2, 3):
        for i in range(len(piece) - n + 1):
            grams[gram_bin(piece[i : i + n], n, quality.BINS)] += 1
    length = len(piece)
    roots = [math.sqrt(g / max(2 * length, 1)) for g in grams]
    return [math.sqrt(s / max(length, 1)) for s in shares] + roots + [sum(g > 0 for g in grams) / quality.BINS, length / quality.PASSAGE]


def plain_score(model, text):
    data = (text or "").encode("utf-8", "replace")
    pieces = [data[i : i + quality.PASSAGE] for i in range(0, len(data), quality.PASSAGE)] or [b""]
    p, states, weights = model.p, [], []
    for piece in pieces:
        x = [(v - m) * s for v, m, s in zip(plain_passage(piece), model.mean, model.scale, strict=True)]
        h = [math.tanh(sum(x[i] * float(p["W"][i, j]) for i in range(len(x))) + float(p["b"][j])) for j in range(quality.HIDDEN)]
        gate = [math.tanh(sum(h[i] * float(p["V"][i, j]) for i in range(len(h)))) / (1 + math.exp(-sum(h[i] * float(p["U"][i, j]) for i in range(len(h))))) for j in range(quality.GATE)]
        states.append(h)
        weights.append(sum(g * float(w) for g, w in zip(gate, p["w"], strict=True)))
    total = sum(math.exp(e - max(weights)) for e in weights)
    attention = [math.exp(e - max(weights)) / total for e in weights]
    z = [sum(a * h[j] for a, h in zip(attention, states, strict=True)) for j in range(quality.HIDDEN)]
    return 1 / (1 + math.exp(-(sum(v * float(c) for v, c in zip(z, p["c"], strict=True)) + float(p["d"][0]))))


def test_quality_by_loops(spark):
    rng = random.Random(4)
    texts = [prose(rng, rng.randint(1, 400), ("en", "de", "fr")[i % 3]) for i in range(40)] + ["", None, "é" * 700, "!?" * 256, "a"]
    texts[:20] = [" ".join(w.upper() + "!!" for w in t.split()) for t in texts[:20]]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    labels = spark.createDataFrame([(i, int(i >= 20), 0) for i in range(40)], "doc_id long, quality int, toxic int")
    held_out = F.coalesce(language.crc_mod(5) == 0, F.lit(False))
    model = quality.learn(docs, labels, held_out)
    got = {r["doc_id"]: r["score"] for r in quality.score_documents(docs, labels).collect()}
    for i, text in enumerate(texts):
        assert abs(got[i] - plain_score(model, text)) < 1e-3, i


def plain_language(model, text):
    """The language whose codeword costs least, and how likely it is, bit by bit."""
    data = (" " + " ".join((text or "").lower().split())).encode("utf-8", "replace") + b" "
    kept = bytes(b for b in data if language.NOISE[b] == 0)
    counts = [0.0] * language.BINS
    for n in (1, 2, 3):
        for i in range(len(kept) - n + 1):
            counts[gram_bin(kept[i : i + n], n, language.BINS)] += 1
    x = np.sqrt(np.array(counts) / max(sum(counts), 1))
    margins = [float(x @ model.weights[:, b] + model.bias[b]) for b in range(model.code.shape[1])]
    losses = [sum(model.trust[b] * math.log1p(math.exp(-m * model.code[k, b])) for b, m in enumerate(margins)) for k in range(len(model.languages))]
    likely = [math.exp(min(losses) - v) for v in losses]
    best = min(range(len(losses)), key=losses.__getitem__)
    rest = sorted(likely)[-2] if len(likely) > 1 else 0
    return model.languages[best], likely[best] / sum(likely), rest >= language.AMBIGUITY * max(likely)


def test_language_by_losses(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randint(1, 80), ("en", "de", "fr")[i % 3]), ("en", "de", "fr")[i % 3]) for i in range(90)]
    rows += [(100, "the der que", "en"), (101, "x", "de"), (102, "12 !!", "en"), (103, None, "fr"), (104, "ÉCOLE " * 40, "fr")]
    docs = spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    model = language.learn(docs, F.coalesce(language.crc_mod(4) == 2, F.lit(False)))
    for r in language.identify_documents(docs).collect():
        text = dict((i, t) for i, t, _ in rows)[r["doc_id"]]
        if not language.has_letter(text):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        name, score, unsure = plain_language(model, text)
        assert r["lang_pred"] == name and abs(r["score"] - score) < 1e-3 and (r["ambiguous"] == unsure or abs(score - 2 / 3) < 1e-3)


def plain_rates(sizes, target, most):
    """The tilt that meets the target, by halving, and the rates min(most, exp(tilt * size / mean))."""
    mean = sum(sizes) / len(sizes)
    rate = lambda tilt, s: min(most, math.exp(min(700.0, tilt * s / mean)))
    low, high = -745.0, 745.0
    for _ in range(400):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(s * rate(mid, s) for s in sizes) < target else (low, mid)
    return {s: rate((low + high) / 2, s) for s in sizes}


def test_rates_are_exponential_tilts(spark):
    rng = random.Random(9)
    rows = [(i, "abcdef"[min(5, int(rng.expovariate(0.7)))], rng.choice([0, 1, 2, 5, 40, 300])) for i in range(500)] + [(1000 + i, None, 7) for i in range(40)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long").repartition(4)).collect()
    by_source, tilted = {}, 0
    for r in out:
        by_source.setdefault(r["source"], []).append(r)
    for found in by_source.values():
        sizes, target, total = [r["size"] for r in found], found[0]["target"], found[0]["source_size"]
        if total == 0 or target >= 2 * total * (1 - 1e-9):
            assert total == 0 or all(r["rate"] == 2 for r in found)
            continue
        want = plain_rates(sizes, target, 2.0)
        assert all(abs(r["rate"] - want[r["size"]]) < 1e-4 * max(1, want[r["size"]]) for r in found)
        # no other rates of this mean that meet the target are closer to 1 in relative entropy
        assert abs(sum(r["size"] * r["rate"] for r in found) - target) < 1e-4 * target
        assert all(math.floor(r["rate"]) <= r["copies"] <= math.ceil(r["rate"] + 1e-9) for r in found)
        tilted += 1
    assert tilted >= 3
