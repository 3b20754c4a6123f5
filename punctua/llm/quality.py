"""Operator 2, quality classifier: attention-based multiple-instance learning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctua.llm.grams import gram_counts, pieces_of
from punctua.llm.language import crc_mod
from punctua.session import shipped

#: Bytes of a passage; a text is cut into passages from its start to its end.
PASSAGE = 512
BINS = 128
#: Bound of the training sample: labelled documents.
SAMPLE = 5000
#: Bound of the training sample: passages of one document, spread evenly over it. Scores always read all passages.
SAMPLE_PASSAGES = 64
THRESHOLD = 0.3
#: Bytes of a slice of a batch that is encoded at a time.
SLICE = 1_000_000
HIDDEN, GATE = 24, 16
#: Classes of bytes whose shares a passage is described by: lower, upper, digit, space, newline, beyond ASCII, then each sign.
SIGNS = b".,;:!?'\"()[]{}<>|*#$%&@+-=/_~^`\\"
CLASS = np.full(256, 6, dtype=np.int64)
CLASS[97:123], CLASS[65:91], CLASS[48:58], CLASS[32], CLASS[10], CLASS[128:] = 0, 1, 2, 3, 4, 5
for _i, _c in enumerate(SIGNS):
    CLASS[_c] = 7 + _i
N_CLASSES = 7 + len(SIGNS)
WIDTH = N_CLASSES + BINS + 2


def passages(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of whole texts, and the number of each passage's text. An empty or null text is one empty passage."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    counts = np.array([max(1, -(-len(r) // PASSAGE)) for r in raw])
    owner = np.repeat(np.arange(len(raw)), counts)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    sizes = np.array([len(r) for r in raw])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    doc = np.repeat(np.arange(len(raw)), sizes)
    passage = first[doc] + (np.arange(len(data)) - starts[doc]) // PASSAGE
    n = len(owner)
    shares = np.bincount(passage * N_CLASSES + CLASS[data], minlength=n * N_CLASSES).reshape(n, N_CLASSES).astype(np.float32)
    length = shares.sum(axis=1, keepdims=True)
    grams = np.sqrt(gram_counts(data, passage, n, BINS, (2, 3)) / np.maximum(2 * length, 1))
    spread = (grams**2 > 0).mean(axis=1, keepdims=True)
    return np.hstack([np.sqrt(shares / np.maximum(length, 1)), grams, spread, length / PASSAGE]).astype(np.float32), owner


class AttentionModel:
    """h = tanh(x W + b); attention softmax(w (tanh(h V) * sigmoid(h U))) over a text's passages; score sigmoid(c (attended h) + d)."""

    def __init__(self, seed: int = 2):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.mean, self.scale = np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32)
        self.p = {"W": draw(WIDTH, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "w": draw(GATE), "c": draw(HIDDEN), "d": np.zeros(1, np.float32)}

    def forward(self, x: np.ndarray, owner: np.ndarray) -> dict:
        p = self.p
        h = np.tanh(((x - self.mean) * self.scale) @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        e = np.exp(e - np.maximum.reduceat(e, starts)[np.searchsorted(starts, np.arange(len(e)), side="right") - 1])
        which = np.searchsorted(starts, np.arange(len(e)), side="right") - 1
        a = e / np.add.reduceat(e, starts)[which]
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return {"h": h, "t": t, "s": s, "a": a, "z": z, "starts": starts, "which": which, "y": 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))}

    def gradients(self, x: np.ndarray, f: dict, labels: np.ndarray) -> dict:
        p, g = self.p, {}
        dy = (f["y"] - labels) / len(labels)
        g["c"], g["d"] = f["z"].T @ dy, np.array([dy.sum()])
        dz = dy[:, None] * p["c"]
        dz_p = dz[f["which"]]
        da = (dz_p * f["h"]).sum(axis=1)
        de = f["a"] * (da - np.add.reduceat(f["a"] * da, f["starts"])[f["which"]])
        dh = f["a"][:, None] * dz_p
        g["w"] = (f["t"] * f["s"]).T @ de
        dt = de[:, None] * p["w"] * f["s"] * (1 - f["t"] ** 2)
        ds = de[:, None] * p["w"] * f["t"] * f["s"] * (1 - f["s"])
        g["V"], g["U"] = f["h"].T @ dt, f["h"].T @ ds
        dh += dt @ p["V"].T + ds @ p["U"].T
        dpre = dh * (1 - f["h"] ** 2)
        g["W"], g["b"] = ((x - self.mean) * self.scale).T @ dpre, dpre.sum(axis=0)
        return g

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = 30, rate: float = 0.004, batch: int = 64, seed: int = 3) -> AttentionModel:
        """Adam on the logistic loss of whole documents; the labels are of documents, never of passages."""
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(axis=0), 1 / (every.std(axis=0) + 0.01)
        rng, m, v, step = np.random.default_rng(seed), {}, {}, 0
        for epoch in range(epochs):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), batch):
                ids = order[at : at + batch]
                x = np.concatenate([bags[i] for i in ids])
                owner = np.repeat(np.arange(len(ids)), [len(bags[i]) for i in ids])
                grads, step = self.gradients(x, self.forward(x, owner), labels[ids]), step + 1
                pace = rate * (1 - epoch / epochs) + 1e-5
                for k, g in grads.items():
                    g = g + 1e-4 * self.p[k]
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                    v[k] = 0.999 * v.get(k, 0) + 0.001 * g * g
                    self.p[k] = (self.p[k] - pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def spread(passages: np.ndarray, most: int = SAMPLE_PASSAGES) -> np.ndarray:
    """At most `most` rows, from the first to the last in even steps."""
    return passages if len(passages) <= most else passages[np.linspace(0, len(passages) - 1, most).astype(np.int64)]


def learn(docs: DataFrame, labels: DataFrame, held_out: Column) -> AttentionModel | None:
    """The model of a bounded sample of labelled documents that are not held out; None without any. Passages are encoded by the executors.

    The driver holds SAMPLE documents of SAMPLE_PASSAGES passages at most, however long the texts are."""
    shipped(docs.sparkSession)
    marks = labels.where(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    # a document with several marks has their least
    marks = marks.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ids = marks.where(~held_out & F.col("doc_id").isNotNull())
    digest = F.md5(F.concat(F.lit("sample "), F.col("doc_id").cast("string")))
    chosen = ids.orderBy(digest, "doc_id").limit(SAMPLE)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values, cuts = batch["text"].to_numpy(), []
            for part in pieces_of(np.array([len(v or "") + 600 for v in values]), SLICE) if len(batch) else []:
                x, owner = passages(list(values[part]))
                cuts += [spread(c) for c in np.split(x.astype(np.float16), np.flatnonzero(np.diff(owner)) + 1)]
            yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy(), "label": batch["quality"].to_numpy(), "x": [c.tobytes() for c in cuts]})

    got = rows.mapInPandas(encode, "doc_id long, label int, x binary").toPandas().sort_values("doc_id")
    if got.empty:
        return None
    bags = [np.frombuffer(v, dtype=np.float16).reshape(-1, WIDTH).astype(np.float32) for v in got["x"]]
    return AttentionModel().fit(bags, got["label"].to_numpy(dtype=np.float32))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score (likelihood of label 1), predicted (score >= 0.3).

    Learns only from labelled documents that are not held out, and scores every whole text by its passages alone; label, lang,
    source and id are no inputs. Empty and null texts are one empty passage. Without any label all scores are 0.5.
    """
    held_out = F.coalesce(crc_mod(5) == 0, F.lit(False))
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, held_out))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = np.full(len(texts), 0.5)
        values = texts.to_numpy()
        for part in pieces_of(np.array([len(v or "") + 600 for v in values]), SLICE) if model.value is not None and len(values) else []:
            x, owner = passages(list(values[part]))
            out[part] = model.value.forward(x, owner)["y"]
        return pd.Series(out)

    rows = docs.select(F.col("doc_id"), held_out.alias("held_out"), score(F.col("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
