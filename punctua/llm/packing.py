"""Operator 10, packing: sum-of-squares online packing into windows of fixed length."""

from __future__ import annotations

import base64
import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctua.session import shipped, trimmed

WINDOW = 1024
END_ID = 0
VOCABULARY = "byte_bpe_50k"
SPECIAL = "<|endoftext|>"
#: The faster encoder's pattern goes back over runs of white space and fails on very long ones; texts with a run of so many characters are left to the tokenizers library.
LONG_RUN = 100_000
SPACES = re.compile(r"\s+")
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Ids of texts as the tokenizers library gives them for the vocabulary.

    Its rank file holds the same merges and a faster encoder reads it (equal ids are tested); texts with a special token's string,
    which the two treat differently, and those with a very long run of white space go to the tokenizers library itself.
    """

    def __init__(self, vocabulary: str = VOCABULARY):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.path, self.exact = public_tokenizers.path(f"{vocabulary}.json"), None

    def __call__(self, text: str | None) -> np.ndarray:
        text = text or ""
        long_run = len(text) >= LONG_RUN and any(m.end() - m.start() >= LONG_RUN for m in SPACES.finditer(text))
        if SPECIAL not in text and not long_run:
            return np.array(self.fast.encode_ordinary(text), dtype="<u4")
        if self.exact is None:
            from tokenizers import Tokenizer

            self.exact = Tokenizer.from_file(self.path)
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype="<u4")


@functools.cache
def encoder(vocabulary: str) -> Encoder:
    """One encoder in a worker: its next partitions take the same."""
    return Encoder(vocabulary)


class SumOfSquares:
    """Open windows by fill level. A piece goes to the level at which the sum of squared counts of open windows becomes least."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.counts = np.zeros(window + 1, dtype=np.int64)  # open windows at each level; 0 and window stay 0
        self.open: list[list[list]] = [[] for _ in range(window + 1)]

    def place(self, piece: tuple, length: int) -> list | None:
        """Puts the piece into a window; that window's pieces if it is full now."""
        w = self.window
        if length == w:
            return [piece]
        levels = np.arange(0, w - length + 1)
        usable = self.counts[: w - length + 1] > 0
        usable[0] = True
        # moving a window from level l to l + length changes the sum by 2 (count[l + length] - count[l]) + 2, where levels 0 and w count nothing
        change = 2 * (self.counts[length:] - self.counts[: w - length + 1]) + 2
        change[0] -= 1
        change[-1] -= 1
        level = int(levels[usable][np.argmin(change[usable])])
        pieces = self.open[level].pop() if level else []
        self.counts[level] -= level > 0
        pieces.append(piece)
        if level + length == w:
            return pieces
        self.open[level + length].append(pieces)
        self.counts[level + length] += 1
        return None

    def rest(self) -> list[list]:
        """The open windows, fullest first."""
        return [pieces for level in range(self.window, 0, -1) for pieces in self.open[level]]


def closed(windows: list[list], window: int) -> list[list]:
    """Fills the gaps of the fuller open windows with cuts from the emptiest ones, so that one at most stays open."""
    windows, gaps = list(windows), [window - sum(len(p[2]) for p in pieces) for pieces in windows]
    i, j = 0, len(windows) - 1
    while i < j:
        if gaps[i] == 0:
            i += 1
            continue
        doc, start, ids, total = windows[j].pop()
        take = min(gaps[i], len(ids))
        windows[i].append((doc, start, ids[:take], total))
        gaps[i] -= take
        if take < len(ids):
            windows[j].append((doc, start + take, ids[take:], total))
        gaps[j] += take
        j -= not windows[j]
    return windows[: j + 1]


def packed(batches: Iterator[pa.RecordBatch], window: int = WINDOW, vocabulary: str = VOCABULARY) -> Iterator[pa.RecordBatch]:
    """The pieces of one partition's documents. Full windows leave at once; only open ones are kept."""
    encode, state = encoder(vocabulary), SumOfSquares(window)
    sequence = TaskContext.get().partitionId() << 40
    out: list[tuple] = []

    def emit(pieces: list) -> None:
        nonlocal sequence
        offset = 0
        for doc, start, ids, total in pieces:
            out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence, offset))
            offset += len(ids)
        sequence += 1

    def frame() -> pa.RecordBatch:
        names = [c.split()[0] for c in PIECE_SCHEMA.split(", ")]
        done = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)
        out.clear()
        return done

    for batch in batches:
        for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
            text = text.as_py()
            ids = np.append(encode(text), np.array([END_ID], dtype="<u4"))
            for start in range(0, len(ids), window):
                piece = (doc, start, ids[start : start + window], len(ids))
                if full := state.place(piece, len(piece[2])):
                    emit(full)
            if len(out) >= 50_000:
                yield frame()
    for pieces in closed(state.rest(), window):
        emit(pieces)
    if out:
        yield frame()


def pack_documents(docs: DataFrame, window: int = WINDOW, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each input partition packs its own documents in its own order in one pass, without a shuffle: whole windows of long documents
    close at once, remainders are placed by sum of squares, and when the partition ends the open windows are closed by cutting
    (documents may be cut freely), so that a partition leaves one short window at most. Sequence ids hold the partition's number in
    their upper bits. Null text is empty: one piece, the end id alone. Repeated rows are packed each; an empty table gives no row.
    """
    shipped(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(trimmed(lambda batches: packed(batches, window, vocabulary)), PIECE_SCHEMA)
