"""Operator 7, language ID: error-correcting output codes."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctua.llm.common import unit
from punctua.llm.grams import gram_counts, joined, pieces_of
from punctua.session import freed, shipped, trimmed

BINS = 4096
#: Bytes of a slice of a batch that is encoded at a time; a document counts 20,000 besides its text for its row of counts.
SLICE = 500_000
#: Bound of the training sample: documents of one language.
SAMPLE_PER_LANGUAGE = 400
#: Bound of the training sample: languages, the most frequent ones.
MOST_LANGUAGES = 200
#: Bound of the training sample: documents (of 8 KB each as features); languages take turns.
MOST_SAMPLE = 10_000
UNDETERMINED = "und"
#: A prediction is ambiguous when the second language is at least so likely against the first.
AMBIGUITY = 0.5
SCHEMA = "lang_pred string, score double, ambiguous boolean"


def text_bytes(text: str | None) -> bytes:
    """Lower-cased letters, everything else as single spaces: only what words look like counts."""
    return " ".join((text or "").lower().split()).encode("utf-8", "replace")


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def features(texts: list) -> np.ndarray:
    """Square roots of hashed 1- to 3-gram shares (rows of length 1), of whole texts."""
    data, owner = joined([b" " + text_bytes(t) for t in texts])
    keep = NOISE[data] == 0
    counts = gram_counts(data[keep], owner[keep], len(texts), BINS)
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))


#: Bytes that tell no language: ASCII other than letters and space.
NOISE = np.array([b < 128 and not (97 <= b <= 122 or 65 <= b <= 90 or b == 32) for b in range(256)], dtype=np.uint8)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n codewords of bits -1, 1. Up to 8 languages: the exhaustive code (at 8 fewer balanced splits exist than are wanted); beyond that, random distinct splits, 15 bits for each doubling."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 8:
        splits = [(0, *rest) for rest in itertools.product((0, 1), repeat=n - 1)][1:]
        return 2.0 * np.array(splits).T - 1
    rng, columns = np.random.default_rng(seed), {}
    while len(columns) < 15 * math.ceil(math.log2(n)):
        bits = rng.permutation(np.arange(n) % 2) * 2 - 1
        columns[tuple(bits * bits[0])] = bits
    return np.array(list(columns.values()), dtype=float).T


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Loss-weighted decoding: the codeword with the least sum of logistic losses, each bit weighted by its trust."""
        margins = x @ self.weights + self.bias
        losses = (np.logaddexp(0, -margins[:, None, :] * self.code[None]) * self.trust).sum(axis=2)
        likely = np.exp(-(losses - losses.min(axis=1, keepdims=True)))
        likely /= likely.sum(axis=1, keepdims=True)
        best = likely.argmax(axis=1)
        order = np.sort(likely, axis=1)
        second = order[:, -2] if likely.shape[1] > 1 else np.zeros(len(x))
        return best, order[:, -1], second >= AMBIGUITY * order[:, -1]


def trained(x: np.ndarray, languages: np.ndarray, rounds: int = 250, rate: float = 4.0, ridge: float = 1e-4) -> Model:
    """One logistic classifier per bit of the code, by accelerated gradient steps; classes count alike."""
    names = sorted(set(languages))
    code = codewords(len(names))
    index = np.array([names.index(v) for v in languages])
    bits = code[index]
    share = (1 / np.bincount(index, minlength=len(names)))[index] / len(names)
    w, b = np.zeros((x.shape[1], code.shape[1]), dtype=np.float32), np.zeros(code.shape[1], dtype=np.float32)
    vw, vb = w.copy(), b.copy()
    for _ in range(rounds):
        ahead_w, ahead_b = w + 0.9 * vw, b + 0.9 * vb
        z = x @ ahead_w + ahead_b
        g = (-bits * share[:, None] / (1 + np.exp(np.clip(bits * z, -30, 30)))).astype(np.float32)
        vw = 0.9 * vw - rate * (x.T @ g + ridge * ahead_w)
        vb = 0.9 * vb - rate * g.sum(axis=0)
        w, b = w + vw, b + vb
    right = ((np.sign(x @ w + b) == bits) * share[:, None]).sum(axis=0)
    trust = np.clip(2 * right - 1, 1e-3, 1)
    return Model(names, code, w, b, trust / trust.sum() * len(trust))


def sample(docs: DataFrame, eligible: Column, label: str, per_label: int, most_labels: int, most: int) -> DataFrame:
    """At most per_label documents of each of the most_labels most frequent labels, the first in the order of a digest of their id.

    The bound of the sample is `most`, which labels share by turns; ids are chosen first, without their texts."""
    slim = docs.where(eligible & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).alias("__label"))
    common = slim.groupBy("__label").count().orderBy(F.desc("count"), "__label").limit(most_labels)
    digest = F.md5(F.concat(F.lit("sample "), F.col("doc_id").cast("string")))
    # a label's first digests lie under a small bound: only some times the wanted rows of each label are dealt out
    slim = slim.join(F.broadcast(common), "__label").where(unit(digest) * F.col("count") < 4 * per_label).dropDuplicates(["doc_id"])
    first = slim.withColumn("__at", F.row_number().over(Window.partitionBy("__label").orderBy(digest, "doc_id"))).where(F.col("__at") <= per_label)
    first = first.orderBy("__at", "__label").limit(most)
    return docs.join(F.broadcast(first.select("doc_id", "__label")), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", "__label")


def crc_mod(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def learn(docs: DataFrame, held_out: Column) -> Model | None:
    """The model of a bounded sample of rows that are not held out; None without any. Features are computed by the executors."""
    shipped(docs.sparkSession)
    chosen = sample(docs.select("doc_id", "text", "lang"), ~held_out, "lang", SAMPLE_PER_LANGUAGE, MOST_LANGUAGES, MOST_SAMPLE)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            usable = batch[[has_letter(t) for t in batch["text"]]]
            if len(usable):
                values = usable["text"].to_numpy()
                x = np.concatenate([features(list(values[part])).astype(np.float16) for part in pieces_of(np.array([len(v) + 20_000 for v in values]), SLICE)])
                yield pd.DataFrame({"doc_id": usable["doc_id"].to_numpy(), "label": usable["__label"].to_numpy(), "x": [v.tobytes() for v in x]})

    rows = chosen.mapInPandas(trimmed(encode), "doc_id long, label string, x binary").toPandas().sort_values("doc_id")
    if rows.empty:
        return None
    return trained(np.stack([np.frombuffer(v, dtype=np.float16) for v in rows["x"]]).astype(np.float32), rows["label"].to_numpy())


def predicted(model: Model | None, texts: pd.Series) -> pd.DataFrame:
    """lang_pred, score, ambiguous of a batch, in slices of bounded size."""
    letters = np.array([has_letter(t) for t in texts], dtype=bool)
    out = pd.DataFrame({"lang_pred": [UNDETERMINED] * len(texts), "score": 0.0, "ambiguous": False})
    where = np.flatnonzero(letters)
    if model is None or not len(where):
        return out
    values = texts.to_numpy()[where]
    names = np.array(model.languages, dtype=object)
    for part in pieces_of(np.array([len(v) + 20_000 for v in values]), SLICE):
        best, score, unsure = model.predict(features(list(values[part])))
        out.loc[where[part], "lang_pred"] = names[best]
        out.loc[where[part], "score"] = score
        out.loc[where[part], "ambiguous"] = unsure
    freed()
    return out


def identify(docs: DataFrame, held_out: Column | None = None) -> DataFrame:
    """docs with lang_pred, score (the likelihood of the prediction) and ambiguous, in the place of columns of these names.

    Learns from docs.lang where not held out. `und` with score 0: null texts, texts without a letter, or nothing to learn from.
    Every row is predicted from its whole text alone, so repeated rows agree; an empty table stays empty.
    """
    held_out = F.coalesce(held_out if held_out is not None else crc_mod(4) == 2, F.lit(False))
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, held_out))
    out_names = [c.split()[0] for c in SCHEMA.split(", ")]
    kept = [c for c in docs.columns if c not in out_names]

    @F.pandas_udf(SCHEMA)
    def predict(texts: pd.Series) -> pd.DataFrame:
        return predicted(model.value, texts)

    return docs.select(*kept, predict(F.col("text")).alias("__p")).select(*kept, "__p.*")


def accepted(docs: DataFrame) -> DataFrame:
    """docs without those of no determined or of an ambiguous language; columns stay."""
    held_out = F.coalesce(crc_mod(4) == 2, F.lit(False))
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, held_out))

    @F.pandas_udf(SCHEMA)
    def predict(texts: pd.Series) -> pd.DataFrame:
        return predicted(model.value, texts)

    judged = docs.withColumn("__p", predict(F.col("text")))
    return judged.where((F.col("__p.lang_pred") != UNDETERMINED) & ~F.col("__p.ambiguous")).select(*docs.columns)


def identify_documents(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, ambiguous."""
    held_out = F.coalesce(crc_mod(4) == 2, F.lit(False))
    slim = docs.select("doc_id", "text", "lang", held_out.alias("held_out"))
    return identify(slim, F.col("held_out")).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
