"""Operator 11, fill-in-middle transformation: cuts found by a table-driven byte automaton."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctua.llm.grams import pieces_of
from punctua.session import shipped

#: The sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Percent of documents that are transformed, and of these, percent with the suffix first.
RATE, SUFFIX_FIRST = 100, 50
#: A byte that no text holds; it stands after each text.
END = 0xFF
#: States: at the start of a line; within a line; after "<"; after "<" and a sentinel's letter; with 1, 2 or 3 continuation bytes to come.
FRESH, INSIDE, OPEN, NAMED, MORE_1, MORE_2, MORE_3 = range(7)
#: What a transition counts: a character, an end of a line, an end of a sentinel. They stand above the state's bits.
CHAR, LINE, SENTINEL = 8, 16, 32
#: After so many bytes the state no longer depends on what was before them.
MEMORY = 3
#: Bytes scanned at a time, and steps of each lane of a scan.
BLOCK, STEPS = 1 << 20, 256


@lru_cache(1)
def automaton() -> np.ndarray:
    """For each state and byte (state * 256 + byte): the next state and what the transition counts."""
    table = np.zeros((7, 256), dtype=np.uint8)
    for state in range(7):
        row = table[state]
        row[:0x80] = INSIDE | CHAR
        row[0x80:0xC0] = state - 1 if state > MORE_1 else INSIDE
        row[0xC0:0xE0], row[0xE0:0xF0], row[0xF0:END] = MORE_1 | CHAR, MORE_2 | CHAR, MORE_3 | CHAR
        row[ord("<")] = OPEN | CHAR
        row[ord("\n")] = FRESH | CHAR | LINE
        row[END] = FRESH | (LINE if state != FRESH else 0)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        table[OPEN, mark[1]] = NAMED | CHAR
    table[NAMED, ord(">")] = INSIDE | CHAR | SENTINEL
    return table.reshape(-1)


def transitions(data: np.ndarray, start: int, stop: int) -> np.ndarray:
    """What the transitions of data[start:stop] count, given that a text ended before data.

    The bytes are dealt to lanes that step together. A lane starts MEMORY bytes early, in any state: what it says is right from its first own byte on."""
    table, n = automaton(), stop - start
    lanes = -(-n // STEPS)
    own = np.full(MEMORY + lanes * STEPS, END, dtype=np.uint8)
    before = min(start, MEMORY)
    own[MEMORY - before : MEMORY + n] = data[start - before : stop]
    view = np.lib.stride_tricks.as_strided(own, (MEMORY + STEPS, lanes), (1, STEPS))
    found = np.empty((STEPS, lanes), dtype=np.uint8)
    state = np.zeros(lanes, dtype=np.uint8)
    for i in range(MEMORY + STEPS):
        said = table[(state & np.uint8(7)).astype(np.uint16) << np.uint16(8) | view[i]]
        if i >= MEMORY:
            found[i - MEMORY] = said
        state = said
    return found.T.reshape(-1)[:n]


class Counted:
    """The counted transitions of texts one after the other: totals by text, and before each block of bytes."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"\xff".join(texts) + b"\xff", dtype=np.uint8)
        self.stops = np.cumsum([len(t) + 1 for t in texts])
        self.starts = np.concatenate([[0], self.stops[:-1]])
        self.ends, before = np.zeros((len(texts) + 1, 3), dtype=np.int64), [np.zeros(3, dtype=np.int64)]
        for a in range(0, len(self.data), BLOCK):
            said = transitions(self.data, a, min(a + BLOCK, len(self.data)))
            so_far = np.stack([np.cumsum((said & kind) != 0) for kind in (CHAR, LINE, SENTINEL)], axis=1) + before[-1]
            first, last = np.searchsorted(self.stops, [a + 1, a + len(said) + 1])
            self.ends[first + 1 : last + 1] = so_far[self.stops[first:last] - a - 1]
            before.append(so_far[-1])
        self.before = np.array(before)
        self.chars, self.lines, self.sentinels = np.diff(self.ends, axis=0).T

    def cuts(self, text: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The byte and the character of each of the given texts after so many of its lines. Only blocks that hold a cut are scanned again."""
        at, chars = self.starts[text].copy(), np.zeros(len(text), dtype=np.int64)
        before = self.before
        goal = self.ends[text, 1] + lines
        block = np.searchsorted(before[:, 1], goal) - 1
        for k in np.unique(block[lines > 0]):
            here = np.flatnonzero((block == k) & (lines > 0))
            said = transitions(self.data, k * BLOCK, min((k + 1) * BLOCK, len(self.data)))
            spot = np.flatnonzero(said & LINE)[goal[here] - before[k, 1] - 1]
            at[here] = np.minimum(k * BLOCK + spot + 1, self.stops[text[here]] - 1)
            chars[here] = before[k, 0] + np.cumsum((said & CHAR) != 0)[spot] - self.ends[text[here], 0]
        return at, chars


def transformed(texts: list[bytes], h: np.ndarray, rate: int, suffix_first: int) -> Iterator[tuple]:
    """lines, form, characters of prefix and middle (None if plain) and the output of each text; h: four numbers a text."""
    counted = Counted(texts)
    n = counted.lines
    picks = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    plain = (n == 0) | (counted.sentinels > 0) | (h[:, 2] % 100 >= rate)
    cut = np.flatnonzero(~plain)
    (first, first_char), (second, second_char) = (counted.cuts(cut, picks[cut, j]) for j in (0, 1))
    place = iter(zip((first - counted.starts[cut]).tolist(), (second - counted.starts[cut]).tolist(), first_char.tolist(), (second_char - first_char).tolist(), (h[cut, 3] % 100 < suffix_first).tolist(), strict=True))
    for text, lines, as_is in zip(texts, n.tolist(), plain.tolist(), strict=True):
        if as_is:
            yield lines, "plain", None, None, text
            continue
        a, b, chars, middle, late = next(place)
        if late:
            yield lines, "spm", chars, middle, SUFFIX + text[b:] + PREFIX + text[:a] + MIDDLE + text[a:b]
        else:
            yield lines, "psm", chars, middle, PREFIX + text[:a] + SUFFIX + text[b:] + MIDDLE + text[a:b]


FIELDS = "n: bigint, form: string, prefix_chars: bigint, middle_chars: bigint, output: string"


def fill_in_middle(docs: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """docs with a struct `fim` (n, form, prefix_chars, middle_chars, output), which replaces a column of that name; all other columns pass unread.

    A text is cut before two of its n lines (or its end), drawn by its doc_id, and its parts are set behind sentinels in the order of
    the form: psm or spm. Empty and null texts, texts that hold a sentinel, and all but `rate` percent of the rest stay plain. Rows of
    one doc_id are cut by the same draws, each by its own lines; a null doc_id draws as an empty one. A worker holds a batch of
    texts and their outputs; beyond that, memory is bounded by blocks, also within a long text.
    """
    shipped(docs.sparkSession)

    @F.arrow_udf(f"struct<{FIELDS}>")
    def cut(text: pa.Array, h1: pa.Array, h2: pa.Array, h3: pa.Array, h4: pa.Array) -> pa.Array:
        rows, h = [], np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in (h1, h2, h3, h4)], axis=1)
        texts = text.cast(pa.binary()).fill_null(b"").to_pylist()
        for part in pieces_of(np.array([len(t) + 1 for t in texts]), 4 * BLOCK) if texts else []:
            rows.extend(transformed(texts[part], h[part], rate, suffix_first))
        n, form, prefix, middle, output = zip(*rows, strict=True) if rows else ((),) * 5
        columns = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).view(pa.string())]
        return pa.StructArray.from_arrays(columns, ["n", "form", "prefix_chars", "middle_chars", "output"])

    digest = F.sha2(F.concat(F.lit("7:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    return docs.withColumn("fim", cut("text", *draws))


def restored(form, output):
    """The text from which fill_in_middle() made the output. A column; exact, as no transformed text holds a sentinel."""
    parts = F.split(output, "<[PSM]>")
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def transform_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and digests of the output and of the text rebuilt from it. One row per row of docs."""
    fim = fill_in_middle(docs.select("doc_id", "text"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    rebuilt = restored(F.col("fim.form"), F.col("fim.output"))
    return fim.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", sha(F.col("fim.output")).alias("output_sha256"), sha(rebuilt).alias("restored_sha256"))
