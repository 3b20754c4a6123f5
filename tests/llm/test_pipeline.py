"""The corpus pipeline: every stage by what it must keep, drop or change."""

import random
import re
from collections import Counter, defaultdict

import pytest
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import SCHEMA, links, plain_secrets, prose


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng, rows = random.Random(9), []
    for i in range(120):
        rows.append((i, prose(rng, rng.randint(40, 90), ("en", "de", "fr")[i % 3]), ("en", "de", "fr")[i % 3], f"s{i % 4}", 0))
    rows += [(200 + k, rows[k][1] + " more", rows[k][2], "s0", 0) for k in range(20)]
    rows += [(300, "1234 5678 !!", "en", "s1", 0), (301, None, "en", "s1", 0), (302, rows[3][1] + ' token = "abcdef1234567890"', "en", "s1", 0)]
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.lit(0))).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return str(folder), rows


def test_stages(spark, corpus, tmp_path):
    folder, rows = corpus
    docs, names = spark.read.parquet(f"{folder}/documents.parquet"), [name for name, _ in corpus_pipeline.STAGES]
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
        if name != names[-1]:
            assert docs.columns == columns
    assert {r["doc_id"] for r in kept["language"]} == {r[0] for r in rows} - {300, 301}
    texts = [(r["doc_id"], r["text"]) for r in kept["language"]]
    _, roots = links([t for _, t in texts])
    least = defaultdict(lambda: 10**9)
    for (i, _), root in zip(texts, roots, strict=True):
        least[root] = min(least[root], i)
    assert sorted(r["doc_id"] for r in kept["near_duplicates"]) == sorted(least.values())
    assert [r["doc_id"] for r in sorted(kept["secrets"])] == [r["doc_id"] for r in sorted(kept["near_duplicates"])]
    before = {r["doc_id"]: r["text"] for r in kept["near_duplicates"]}
    for r in kept["secrets"]:
        assert not plain_secrets(r["text"]) and r["n_chars"] == len(r["text"])
        assert r["text"] == before[r["doc_id"]] or plain_secrets(before[r["doc_id"]])
    copies = Counter(r["doc_id"] for r in kept["mixing"])
    assert set(copies) <= {r["doc_id"] for r in kept["secrets"]} and max(copies.values()) <= 2
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in kept["secrets"])
    mixed = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in kept["mixing"])
    assert mixed == pytest.approx(1.5 * words, rel=0.1)
    tokens = defaultdict(int)
    for p in kept["packing"]:
        tokens[p["doc_id"]] += p["length"]
    assert set(tokens) == set(copies) and all(n % copies[i] == 0 for i, n in tokens.items())


def test_run(spark, corpus):
    assert corpus_pipeline.run(spark, corpus[0]).count() > 0


def test_workers_give_memory_back(spark):
    """What a partition took is not kept by the worker for the stages after it; the partitions' rows stay."""
    from punctua.session import shipped, trimmed

    shipped(spark)

    def resident() -> int:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    def run(batches):
        for batch in batches:
            held = [bytes(1000) for _ in range(200_000)]
            kept = bytes(1000)  # lies above what is freed, so that the heap cannot shrink from its end alone
            del held
            yield batch
        del kept

    def after(function):
        def whole(batches):
            before = resident()
            n = sum(batch.num_rows for batch in function(batches))
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([resident() - before])], ["n", "more"])

        return whole

    got = spark.range(10, numPartitions=1).mapInArrow(after(trimmed(run)), "n long, more long").first()
    assert got["n"] == 10 and got["more"] < 100_000_000
