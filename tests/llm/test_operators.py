"""Each operator against a plain version on a small corpus with nulls, empty and long texts, ties, repeated rows, clashing columns; and on empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from punctua.llm import common, fingerprints, language, licenses, mixing, near_duplicates, packing, quality, secrets, sharding, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def prose(rng, n, lang):
    stems = {"en": "the of and tion ing her wh th er on at es", "de": "der ung sch ein ich ver heit ge be ü ß en", "fr": "eau oux é è que ment ou ai tion re le des"}[lang].split()
    words = ["".join(rng.choice(stems) for _ in range(rng.randint(1, 3))) for _ in range(n)]
    lines = [" ".join(words[i : i + 12]) for i in range(0, n, 12)]
    return ".\n".join(lines)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    found = []
    for i in range(160):
        lang = ("en", "de", "fr")[i % 3]
        text = prose(rng, rng.randint(3, 120), lang)
        if i % 7 == 0:
            text = " ".join(w.upper() + "!!" for w in text.split())
        found.append([i * 3 + 1, text, lang, f"s{i % 5}" if i % 11 else None, len(text)])
    base = found[8][1]
    for k in range(12):  # near copies
        words = base.split()
        for _ in range(k % 3):
            words[rng.randrange(len(words))] = f"edit{k}"
        found.append([1000 + k, " ".join(words), "fr", "s1", 0])
    for k in range(6):  # copies
        found.append([2000 + k, found[20][1], "fr", "s2", 0])
    extra = [None, "", " \n\t ", "12 34 !!", "one two", "ONE two", "one two three", 'token = "abcdef123456" and PASSWORD:hunter2x api_key=abc secret=token: zzzzzzzz', "AKIA" + "Z9" * 8 + " aa " + "0f" * 12 + " AKIAshort AKIA", "é😀 token=" + "q" * 8 + " ü", "MIT  License; the Apache\nlicense mit license general public-license", "Released undr the MIT Licence.", "long " * 4000, "<|endoftext|> x"]
    for k, text in enumerate(extra):
        found.append([3000 + k, text, "en", "s3" if k % 2 else "", 0])
    found.append([3002, " \n\t ", "en", "s3", 0])  # repeated rows
    found.append(found[5])
    return [tuple(r) for r in found]


@pytest.fixture(scope="module")
def docs(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    clash = {c: F.lit("x") for c in ("size", "score", "key", "rules", "node", "n", "kind", "secrets", "rank", "label", "count", "row", "range", "predicted", "copies")}
    return frame.withColumns(clash).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(frame):
    found = defaultdict(list)
    for r in frame.collect():
        found[r["doc_id"]].append(r.asDict())
    return found


def test_sharding(docs, rows, empty):
    out = sharding.shard_documents(docs).collect()
    assert len(out) == len(rows)
    counts = Counter(r["shard"] for r in out)
    assert set(counts) <= set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(counts[s]))
    texts = {r[0]: r[1] or "" for r in rows}
    assert all(r["size"] == len(texts[r["doc_id"]].encode()) + 8 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in out)
    share = defaultdict(Counter)
    for r in out:
        share[r["source"]][r["shard"]] += 1
    for source, held in share.items():
        n = sum(held.values())
        assert all(abs(held[s] - n / 24) < 2 for s in range(24)), source
    assert sharding.shard_documents(empty).collect() == []


def test_sharding_repeats(docs):
    one, two = (sorted(map(tuple, sharding.shard_documents(docs.repartition(n)).select("doc_id", "shard", "slot").collect()), key=str) for n in (2, 5))
    assert one == two


def links(texts):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    return sets, [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("frequent, broadcast, long, large", [(8, 500_000, 32, 1000), (1, 0, 2, 20)])
def test_near_duplicates(docs, rows, empty, frequent, broadcast, long, large, monkeypatch):
    monkeypatch.setattr(near_duplicates, "FREQUENT", frequent)
    monkeypatch.setattr(near_duplicates, "LONG_LIST", long)
    monkeypatch.setattr(near_duplicates, "LARGE", large)
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)
    sets, roots = links([r[1] for r in rows])
    least = {}
    for r, root in zip(rows, roots, strict=True):
        least[root] = min(least.get(root, r[0]), r[0])
    want = sorted((r[0], len(s), least[root] if s else r[0]) for r, s, root in zip(rows, sets, roots, strict=True))
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates.near_duplicates(docs).collect())
    assert got == want
    kept = near_duplicates.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted({c for _, _, c in want})
    assert near_duplicates.near_duplicates(empty).collect() == []


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(2)
    for size in (0, 1, 30, 300, 5000):
        for changed in (0, 1, 25, 400):
            common_part, more = (rng.integers(0, 1 << 64, k, dtype=np.uint64) for k in (size, changed))
            x, y = np.unique(common_part), np.unique(np.concatenate([common_part, more]))
            apart = int(np.bitwise_count((near_duplicates.parities(x) ^ near_duplicates.parities(y)).view(np.uint64)).sum())
            assert apart <= len(y) - len(x) and (len(y) - len(x) - apart) % 2 == 0
            assert changed or apart == 0
    assert apart > 200  # and it tells sets apart


@pytest.mark.parametrize("long", [32, 2, 1 << 40])
def test_shared_passage(spark, long, monkeypatch):
    """Many documents hold one passage and little else: most do not link, some do; the index must neither miss nor invent links."""
    monkeypatch.setattr(near_duplicates, "LONG_LIST", long)
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(70)]
    texts = []
    for k in range(90):
        own = [f"d{k}w{i}" for i in range(rng.randint(0, 24))]
        words = passage + own
        for _ in range(k % 4):
            words[rng.randrange(len(words))] = f"x{k}"
        texts.append(" ".join(words))
    sets, roots = links(texts)
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    least = {}
    for i, root in enumerate(roots):
        least[root] = min(least.get(root, i), i)
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicates(frame).collect()}
    assert got == {i: least[root] for i, root in enumerate(roots)}


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_deduplication_by_row(spark, broadcast, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)
    a, b, c = (" ".join(f"{name}{i}" for i in range(60)) for name in "abc")
    near = b + " more"
    held = [(5, a), (5, near), (3, b), (None, c), (None, near), (None, c + " more"), (None, "alone"), (None, "alone"), (7, None), (None, None)]
    kept = near_duplicates.deduplicated(spark.createDataFrame(held, "doc_id long, text string")).collect()
    got = Counter((r["doc_id"], r["text"]) for r in kept)
    assert sum(got[None, t] for t in (c, c + " more")) == 1
    del got[None, c], got[None, c + " more"]
    assert got == Counter([(5, a), (3, b), (None, "alone"), (7, None), (None, None)])


def test_mixed_documents_of_null_ids(spark):
    held = spark.createDataFrame([(None, f"w{i} " * (1 + i % 9), f"s{i % 2}") for i in range(400)], "doc_id long, text string, source string")
    out = mixing.mixed_documents(held).groupBy("source").agg(F.sum(mixing.words_of(F.col("text"))).alias("got"))
    goals = mixing.mix_documents(held).groupBy("source").agg(F.first("target").alias("target"))
    rows = out.join(goals, "source").collect()
    assert len(rows) == 2 and all(abs(r["got"] - r["target"]) <= 9 for r in rows)


def plain_secrets(text):
    found = []
    for i, rule in enumerate(secrets.RULES):
        pattern = re.compile(rule.pattern, re.ASCII)
        for m in pattern.finditer(text):
            if len(m[rule.group]) >= rule.least:
                found.append((m.start(), i, m.end(), rule.kind))
    return sorted(found)


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_secrets(docs, rows, empty, broadcast, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)
    out = by_id(secrets.scan_documents(docs))
    for doc_id, text, *_ in rows:
        found = plain_secrets(text or "")
        base = ",".join(f"{k}:{a}:{b}" for a, i, b, k in found if i < 3)
        for got in out[doc_id]:
            assert got["spans"] == ",".join(f"{k}:{a}:{b}" for a, _, b, k in found)
            assert got["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
            assert (got["n_assign"], got["n_access"], got["n_hex"]) == tuple(sum(k == kind for *_, k in found) for kind in ("assign", "access", "hex"))
    assert sum(map(len, out.values())) == len(rows)
    assert secrets.scan_documents(empty).collect() == []


def test_secret_queries():
    queries = {r.kind: secrets.query_of(r) for r in secrets.RULES}
    assert queries["hex"] is None and queries["access"] == ("and", ("aki", "kia"))
    assert ("and", ("api", "key")) in queries["assign"][1]


def test_many_secrets(spark):
    text = "token=abcdefgh;é" * 3000
    out = secrets.scan_documents(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert out["n_assign"] == 3000 and out["spans"].split(",")[-1] == f"assign:{2999 * 16}:{2999 * 16 + 14}"


def test_secrets_of_null_ids(spark):
    texts = ["password = hunter2secret", "AKIA" + "A1B2" * 5, "-----BEGIN RSA PRIVATE KEY-----", "nothing here", None]
    held = spark.createDataFrame([(k, t) for t in texts for k in (None, None, 3)], "doc_id long, text string")
    out = secrets.find_secrets(held).collect()
    assert len(out) == 3 * len(texts)
    assert all([(s["start"], s["order"], s["end"], s["kind"]) for s in r["secrets"]] == plain_secrets(r["text"] or "") for r in out)
    assert {r["text"] for r in secrets.redact(held).collect()} == {"[assign]", "[access]", "[pem]", "nothing here", None}


def test_redaction(docs, rows):
    out = secrets.redact(docs)
    assert out.columns == docs.columns
    for r in out.select("doc_id", "text").collect():
        assert r["text"] is None or not [x for x in plain_secrets(r["text"])]
    assert out.where("doc_id = 3009").first()["text"] == "é😀 [assign] ü"


def plain_pieces(text):
    return set(re.findall(r"[^\n]{1,256}", text))


def test_fingerprints(docs, rows, empty):
    order = sorted(rows, key=lambda r: r[0])
    out = by_id(fingerprints.fingerprint_documents(docs))
    assert sum(map(len, out.values())) == len(rows)
    prints = defaultdict(set)
    for i, (doc_id, text, *_) in enumerate(order):
        text = text or ""
        after = order[(i + 1) % len(order)][1] or ""
        if sum(r[0] == doc_id for r in rows) > 1:
            continue
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        got = out[doc_id][0]
        assert got["n_chars"] == len(text) and got["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        prints[text].add(got["fingerprint"])
        for name, other in (("near_edited", edited), ("near_next", after)):
            a, b = plain_pieces(text), plain_pieces(other)
            assert got[name] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
    assert all(len(p) == 1 for p in prints.values()) and len({next(iter(p)) for p in prints.values()}) >= len(prints) - 2
    assert fingerprints.fingerprint_documents(empty).collect() == []
    one = fingerprints.fingerprint_documents(docs.where("doc_id = 4")).first()
    assert one["near_next"] == 1.0


def test_peeling(spark):
    """Sketches of very different and of equal sets give back exactly the digests that differ."""
    rng = random.Random(1)
    cases = [([rng.getrandbits(62) for _ in range(a)], [rng.getrandbits(62) for _ in range(b)], [rng.getrandbits(62) for _ in range(c)]) for a, b, c in ((0, 0, 5), (3, 2, 40), (200, 300, 10), (0, 700, 0))]
    frame = spark.createDataFrame([(i, c + a, c + b) for i, (a, b, c) in enumerate(cases)], "pair long, a array<long>, b array<long>")
    got = defaultdict(set)
    rows = fingerprints.differences(frame.withColumn("cells", F.lit(1000).cast("long")).withColumn("seed", F.lit(3)), ["pair"])
    for r in rows.collect():
        got[r["pair"]].add((r["side"], r["digest"]))
    for i, (a, b, _) in enumerate(cases):
        assert got[i] == {(1, x) for x in a} | {(-1, x) for x in b}
    near = {r["pair"]: r["near"] for r in fingerprints.likeness(frame, ["pair"]).collect()}
    assert near == {i: pytest.approx(len(c) / (len(a) + len(b) + len(c)) if a + b + c else 1.0) for i, (a, b, c) in enumerate(cases)}


def test_mixing(docs, rows, empty):
    out = mixing.mix_documents(docs).collect()
    assert len(out) == len(rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = dict(zip(order, [5, 2, 1] * 9, strict=False))
    capped = set()
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in capped)
        free = sum(weight[s] for s in order if s not in capped)
        goal = {s: 2 * sizes[s] if s in capped else left * weight[s] / free for s in order}
        over = {s for s in order if goal[s] > 2 * sizes[s]}
        if not over:
            break
        capped |= over
    taken, biggest = defaultdict(int), defaultdict(int)
    for r in out:
        assert r["target"] == pytest.approx(goal[r["source"]]) and 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
        taken[r["source"]] += r["taken"]
        biggest[r["source"]] = max(biggest[r["source"]], r["size"])
    assert all(abs(taken[s] - goal[s]) <= biggest[s] + 1e-6 * goal[s] for s in order)
    again = mixing.mix_documents(docs.repartition(5)).select("doc_id", "taken").collect()
    assert sorted(map(tuple, again)) == sorted((r["doc_id"], r["taken"]) for r in out)
    assert mixing.mix_documents(empty).collect() == []
    rows_out = mixing.mixed_documents(docs)
    assert rows_out.columns == docs.columns
    copies = Counter(r["doc_id"] for r in rows_out.select("doc_id").collect())
    once = {r["doc_id"]: r["copies"] for r in out if sum(x[0] == r["doc_id"] for x in rows) == 1}
    assert all(copies[i] == n for i, n in once.items())


def test_language(docs, rows, empty):
    out = by_id(language.identify_documents(docs))
    right = total = 0
    for doc_id, text, lang, *_ in rows:
        for got in out[doc_id]:
            assert got["held_out"] == (zlib.crc32(str(doc_id).encode()) % 4 == 2) and 0 <= got["score"] <= 1
            if text is None or not any(map(str.isalpha, text)):
                assert got["lang_pred"] == "und"
            else:
                assert got["lang_pred"] in {"en", "de", "fr"}
                if got["held_out"] and len(text) > 150 and doc_id < 1000:
                    right, total = right + (got["lang_pred"] == lang), total + 1
    assert right / total > 0.9
    assert language.identify_documents(empty).collect() == []
    kept = language.accepted(docs)
    assert kept.columns == docs.columns and kept.where("doc_id IN (3000, 3001, 3002, 3003)").count() == 0


def test_codewords():
    for n in (2, 3, 4, 7, 12, 40):
        code = language.codewords(n)
        apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(apart) >= (2 ** (n - 2) if n <= 7 else 10)


def test_codewords_of_every_number():
    for n in range(1, 41):
        code = language.codewords(n)
        assert code.shape[0] == n and set(np.unique(code)) <= {-1, 1}
        assert len({tuple(row) for row in code}) == n
    eight = language.codewords(8)
    assert eight.shape == (8, 127) and min((eight[i] != eight[j]).sum() for i in range(8) for j in range(i)) == 64


def test_quality(spark, docs, rows, empty):
    marks = [(r[0], int(not (r[1] or "").endswith("!!")), 0) for r in rows if r[0] < 1000]
    labels = spark.createDataFrame(marks + [(None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    out = by_id(quality.score_documents(docs, labels))
    assert sum(map(len, out.values())) == len(rows)
    held = [(out[i][0], q) for i, q, _ in marks if out[i][0]["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) for r, _ in held)
    assert np.mean([r["predicted"] == q for r, q in held]) > 0.9
    assert quality.score_documents(empty, labels).collect() == []
    assert {r["score"] for r in quality.score_documents(docs, labels.limit(0)).collect()} == {0.5}


def test_sample_is_bounded_in_bytes():
    rows = np.arange(1000).reshape(500, 2)
    assert len(quality.spread(rows)) == quality.SAMPLE_PASSAGES and quality.spread(rows)[[0, -1]].tolist() == [[0, 1], [998, 999]]
    assert quality.spread(rows[:64]).shape == (64, 2)


def test_rows_that_may_have_a_partner(spark):
    keys = [k * 7919 for k in range(3000)] + [-5, -(1 << 62)]
    found = spark.createDataFrame([(k,) for k in keys], "k long")
    rows = spark.createDataFrame([(k,) for k in [*keys[::3], -5, -(1 << 62), *range(1, 40_000, 2), None]], "h long")
    out = common.flagged(rows, F.col("h"), found, F.col("k"), len(keys), "maybe").collect()
    assert len(out) == rows.count()
    assert all(r["maybe"] for r in out if r["h"] in set(keys))
    assert sum(r["maybe"] for r in out if r["h"] not in set(keys)) < 0.15 * len(out)


def test_no_local_folder_on_a_cluster():
    class Context:
        master = "spark://somewhere:7077"
        getConf = lambda self: {}
        getCheckpointDir = lambda self: None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session())


def test_attention_gradients():
    rng = np.random.default_rng(0)
    model = quality.AttentionModel()
    x, owner, labels = rng.standard_normal((9, quality.WIDTH)), np.array([0, 0, 0, 1, 1, 2, 2, 2, 2]), np.array([1.0, 0.0, 1.0])
    model.p = {k: v.astype(float) for k, v in model.p.items()}
    loss = lambda: -np.mean([np.log(y if t else 1 - y) for y, t in zip(model.forward(x, owner)["y"], labels, strict=True)])
    grads = model.gradients(x, model.forward(x, owner), labels)
    for k, g in grads.items():
        at = tuple(rng.integers(n) for n in model.p[k].shape)
        model.p[k][at] += 1e-6
        up = loss()
        model.p[k][at] -= 2e-6
        assert (up - loss()) / 2e-6 == pytest.approx(g[at], abs=1e-6)
        model.p[k][at] += 1e-6


def test_top_k(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, (rng.standard_normal(16) / 4).tolist()) for i in range(1200)]
    vectors += [(2000 + i, vectors[7][1]) for i in range(300)]  # many equal vectors
    vectors += [(5000, None), (5001, [float("nan")] * 16), (5002, [None] + [0.1] * 15), (5003, [float("inf")] * 16), (None, [0.1] * 16), (5004, [0.0] * 16)]
    vectors += [(300, vectors[300][1]), (400, vectors[5][1]), (500, [9.0] * 16), (6000, [-3.0] * 16)]  # repeated rows, repeated ids, negative ones
    vectors += [(7000, []), (7001, []), (7100, []), (8000, [1.0] * 5), (8001, [2.0] * 5), (9000, [60000.0] * 16)]  # empty, of other length, large
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    usable = [(i, np.floor(1024 * np.array(v)).astype(int)) for i, v in vectors if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = []
    for at, (q, x) in enumerate(usable):
        if q % 100 == 0:
            scored = [(-int(x @ y), i) for other, (i, y) in enumerate(usable) if other != at and len(x) == len(y)]
            want += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:10])]
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.search(frame).collect()]
    assert sorted(got) == sorted(want)
    assert topk.search(frame.limit(0)).collect() == []


def test_top_k_in_blocks(spark, monkeypatch):
    for name, n in (("BLOCK_ROWS", 90), ("QUERY_ROWS", 3), ("SLICE_ROWS", 2)):
        monkeypatch.setattr(topk, name, n)
    rng = np.random.default_rng(6)
    x = rng.integers(-900, 900, (700, 8))
    frame = spark.createDataFrame([(i, (v / 1024).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.search(frame).collect())
    want = [(q, rank + 1, i, -s) for q in range(0, 700, 100) for rank, (s, i) in enumerate(sorted((-int(x[q] @ x[i]), i) for i in range(700) if i != q)[:10])]
    assert got == want


def test_adjacent_licenses():
    exact, edited = "released under the mit license", "relesed undr the mit license"
    label = licenses.fuzzy(exact)[0][2]
    for parts in ([edited, exact], [exact, edited], [edited, edited, exact, edited]):
        got = [(a, b) for a, b, found, _ in licenses.fuzzy(" ".join(parts)) if found == label]
        starts = [len(" ".join(parts[:i])) + (i > 0) for i in range(len(parts))]
        assert got == [(a, a + len(p)) for a, p in zip(starts, parts, strict=True)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_labels(words):
    """Each notice against every window of words around its naming words."""
    found = set()
    for n in licenses.parsed():
        name = n.name.split()
        size = len(n.text.split())
        for at in range(len(words) - len(name) + 1):
            if words[at : at + len(name)] != name:
                continue
            for i in range(max(0, at - size - 3), at + 1):
                left = " ".join(words[i:at]) + " " * (i < at) if name else ""
                d = distance(n.before, left) if name else 0
                if d > n.edits:
                    continue
                for j in range(at + len(name), min(len(words), at + size + 4) + 1):
                    right = " " * (j > at + len(name)) + " ".join(words[at + len(name) : j]) if name else " ".join(words[at:j])
                    if d + distance(n.after if name else n.before, right) <= n.edits:
                        found.add(n.label)
                if not name:
                    break
    return found


@pytest.mark.parametrize("text, want", [("Released under the BSD license", "bsd"), ("released under the gpl license", "gpl"), ("Released under the ISC license", "isc"), ("Released under the new license", ""),
    ("Licensed under CC BY-SA 4.0", "cc-by-sa"), ("licensed under cc by nd 4.0", "cc-by-nd"), ("Licensed under CC BY 4.0", "cc-by"), ("licenced under cc by-nc 4.0", "cc-by-nc"), ("released under the summit license", ""),
    ("This work is licensed under the GNU Lesser General Public License version 3", "gpl,lgpl"), ("relesed under the mit licence", "mit")])
def test_license_labels(text, want):
    assert licenses.scanned(text)[5] == want


def test_licenses_by_brute_force():
    rng, letters = random.Random(8), "abcdefghijklmnopqrstuvwxyz 0"
    for _ in range(150):
        notice = rng.choice(licenses.parsed())
        chars = list(notice.text)
        for _ in range(rng.randint(0, notice.edits + 2)):
            at = rng.randrange(len(chars))
            chars[at : at + rng.randint(0, 1)] = rng.choice(["", rng.choice(letters), rng.choice(letters)])
        words = [w for w in ("some words " + "".join(chars) + " and more").split(" ") if w]
        hits = {label for _, _, label, _ in licenses.fuzzy(" ".join(words))}
        assert hits == plain_labels(words), words


def test_licenses(docs, rows, empty):
    out = by_id(licenses.scan_documents(docs))
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for doc_id, text, *_ in rows:
        words = word.findall((text or "").translate(LOWER))
        places, labels = [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            at = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        for got in out[doc_id]:
            assert (got["n_words"], got["n_base"], got["base_labels"]) == (len(words), len(places), ",".join(sorted(labels)))
            assert (got["first_word"], got["last_word"]) == ((min(places), max(places)) if places else (None, None))
            assert labels <= set(got["labels"].split(",")) and 0 <= got["score"] <= 1
    assert out[3011][0]["labels"] == "mit" and out[3011][0]["n_base"] == 0 and 0.8 < out[3011][0]["score"] < 1
    assert licenses.scan_documents(empty).collect() == []


def test_packing(docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = packing.pack_documents(docs).collect()
    windows = defaultdict(list)
    for p in pieces:
        windows[p["sequence_id"]].append(p)
    for held in windows.values():
        held.sort(key=lambda p: p["offset"])
        at = 0
        for p in held:
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024
    assert sum(sum(p["length"] for p in held) < 1024 for held in windows.values()) <= 3  # one a partition
    parts = defaultdict(list)
    for p in pieces:
        parts[p["doc_id"]].append(p)
    for doc_id, text, *_ in rows:
        copies = sum(r[0] == doc_id for r in rows)
        ids = np.array(exact.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        assert sum(p["length"] for p in parts[doc_id]) == copies * len(ids) and all(p["doc_tokens"] == len(ids) for p in parts[doc_id])
        assert all(zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] for p in parts[doc_id])
    assert packing.pack_documents(empty).collect() == []


def test_sum_of_squares():
    """Each placement makes the sum of squared counts least, by trying all levels."""
    rng = random.Random(2)
    state, counts = packing.SumOfSquares(20), [0] * 21
    for _ in range(400):
        size = rng.randint(1, 19)
        costs = {}
        for level in range(20 - size + 1):
            if level == 0 or counts[level]:
                after = list(counts)
                if level:
                    after[level] -= 1
                if level + size < 20:
                    after[level + size] += 1
                costs[level] = sum(c * c for c in after)
        before = sum(c * c for c in counts)
        state.place(("x", 0, [0] * size, size), size)
        counts = [int(c) for c in state.counts]
        assert sum(c * c for c in counts) == min(costs.values()), before
