"""Ids that no double holds beside null ids, very long runs of white space, and texts full of notices."""

import time

import numpy as np
from pyspark.sql import functions as F

from punctua.llm import language, licenses, packing, quality, topk

LARGE = 9007199254740993
ROWS = [(None, "released under the mit license and more words"), (LARGE, "the quick brown fox is here"), (1, "der Hund und die Katze"), (LARGE + 2, "le chat et le chien"), (2, None)]


def docs(spark):
    return spark.createDataFrame([(i, t, "en" if k % 2 else "de", "s", 0) for k, (i, t) in enumerate(ROWS)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)


def test_ids_stay(spark):
    ids = sorted((i for i, _ in ROWS), key=str)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (LARGE, 1, 0)], "doc_id long, quality int, toxic int")
    for found in (licenses.scan_documents(docs(spark)), packing.pack_documents(docs(spark)), language.identify_documents(docs(spark)), quality.score_documents(docs(spark), labels)):
        assert sorted({r["doc_id"] for r in found.collect()}, key=str) == ids
    kept = {r["doc_id"] for r in language.accepted(docs(spark)).collect()}
    assert kept <= set(ids)
    vectors = spark.createDataFrame([(None, [9.0, 9.0]), (LARGE, [1.0, 2.0]), (100, [1.0, 1.0]), (LARGE + 2, [3.0, 3.0])], "vec_id long, embedding array<double>").coalesce(1)
    assert [(r["query_id"], r["vec_id"]) for r in topk.search(vectors).orderBy("rank").collect()] == [(100, LARGE + 2), (100, LARGE)]


def test_long_runs(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    exact, texts = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), ["a" + " " * 1_000_000 + "b", "a" + " \n" * 60_000 + "b", "x" * 100_000]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = packing.pack_documents(frame).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("tokens")).collect()
    assert {r["doc_id"]: (r["n"], r["tokens"]) for r in got} == {i: (n, n) for i, n in ((i, len(exact.encode(t, add_special_tokens=False).ids) + 1) for i, t in enumerate(texts))}
    encode = packing.Encoder()
    assert all(np.array_equal(encode(t), exact.encode(t, add_special_tokens=False).ids) for t in texts[1:])


def test_many_notices_cost_their_length():
    licenses.scanned("released under the mit license")  # builds the automaton
    for notice in ("relesed under the mit license. ", "released under the mit license. ", "license license mit license "):
        seconds = []
        for n in (4_000, 16_000):
            began = time.process_time()
            found = licenses.scanned(notice * n)
            seconds.append(time.process_time() - began)
            assert found[1] == n and (notice.startswith("license") or found[7].count(",") == n - 1)
        assert seconds[1] < 8 * seconds[0] + 0.5


def test_spans_are_those_of_each_notice_alone():
    parts = ["released under the mit license", "some words between", "relesed undr the bsd license", "licensed under cc by 4 0", "released under the new license", "released under the gpl licence"]
    want, at = [], 0
    for part in parts * 40:
        found = licenses.scanned(part)[7]
        want += [f"{label}:{int(a) + at}:{int(z) + at}" for label, a, z in (s.split(":") for s in found.split(",") if s)]
        at += len(part.split())
    assert licenses.scanned(" ".join(parts * 40))[7].split(",") == want
