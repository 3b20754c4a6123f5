"""Operator 9, license scans: fuzzy search for short notices."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctua.session import shipped

#: The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Short notices, as words after lower-casing, and the labels the search adds. Words in braces name the license and must stand unchanged.
NOTICES = {
    "released under the {mit} license": "mit",
    "released under the {bsd} license": "bsd",
    "released under the {isc} license": "isc",
    "released under the {gpl} license": "gpl",
    "released under the {apache} license": "apache",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under the {apache} license version 2 0": "apache",
    "this work is licensed under the {gnu general public} license version 3": "gpl",
    "this work is licensed under the {gnu lesser general public} license version 3": "lgpl",
    "this work is licensed under the {gnu affero general public} license version 3": "agpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "licensed under {cc by 4} 0": "cc-by",
    "licensed under {cc by nc 4} 0": "cc-by-nc",
    "licensed under {cc by nd 4} 0": "cc-by-nd",
    "licensed under {cc by sa 4} 0": "cc-by-sa",
    "licensed under {cc by nc nd 4} 0": "cc-by-nc-nd",
    "licensed under {cc by nc sa 4} 0": "cc-by-nc-sa",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "subject to the terms of the {mozilla public} license v 2 0": "mpl",
}
#: Edits allowed: one for so many characters of a notice.
CHARS_AN_EDIT = 10
#: Other bytes than digits, lower-case letters and those of characters beyond ASCII part words; A-Z become a-z.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"


def words_of(text: str) -> list[str]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).decode("utf-8", "surrogatepass").split(" ")


@dataclass(frozen=True)
class Notice:
    """A notice in parts: what stands before its naming words, these (empty if it has none), and what stands after."""

    before: str
    name: str
    after: str
    label: str

    @property
    def text(self) -> str:
        return self.before + self.name + self.after

    @property
    def edits(self) -> int:
        return len(self.text) // CHARS_AN_EDIT

    def pattern(self):
        """Bounded errors around the naming words, which are whole words, as is the match."""
        import regex

        near = lambda part: f"(?:{regex.escape(part, literal_spaces=True)}){{e<={self.edits}}}" if part else ""
        name = f"(?<![^ ]){regex.escape(self.name, literal_spaces=True)}(?![^ ])" if self.name else ""
        return regex.compile(f"(?<![^ ]){near(self.before)}{name}{near(self.after)}(?![^ ])", regex.BESTMATCH)


def parsed() -> list[Notice]:
    found = []
    for text, label in NOTICES.items():
        before, _, rest = text.partition("{")
        name, _, after = rest.partition("}")
        found.append(Notice(before, name, after, label))
    return found


@lru_cache(1)
def searcher():
    """The seeds' automaton, the notices and their fuzzy patterns. A notice with k edits at most, cut into k + 1 parts, holds one part unchanged."""
    import ahocorasick

    notices, seeds = parsed(), {}
    for i, notice in enumerate(notices):
        k, text = notice.edits, notice.text
        cuts = [round(j * len(text) / (k + 1)) for j in range(k + 2)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            seeds.setdefault(text[a:b], []).append((i, a))
    automaton = ahocorasick.Automaton()
    for seed, where in seeds.items():
        automaton.add_word(seed, (len(seed), where))
    automaton.make_automaton()
    return automaton, notices, [n.pattern() for n in notices]


def best_of_places(found: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """Of notices of different labels on one place the likeliest; none where the likeliest are of different labels. Hits in order of start; a sweep keeps those that still overlap."""
    beaten, open_ = set(), []
    for n, hit in enumerate(found):
        open_ = [m for m in open_ if found[m][1] > hit[0]]
        for m in open_:
            other = found[m]
            if other[2] != hit[2]:
                beaten |= {n} if other[3] >= hit[3] else set()
                beaten |= {m} if hit[3] >= other[3] else set()
        open_.append(n)
    return [hit for n, hit in enumerate(found) if n not in beaten]


def apart(hits: set[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """Hits of one notice that do not overlap: of those that do, the likeliest, then the first."""
    kept, group, reach = [], [], -1
    for hit in [*sorted(hits), None]:
        if hit is None or hit[0] >= reach:
            chosen: list[tuple[int, int, float]] = []
            for h in sorted(group, key=lambda h: (-h[2], h[0], -h[1])):
                if all(h[1] <= c[0] or c[1] <= h[0] for c in chosen):
                    chosen.append(h)
            kept += chosen
            group = []
        if hit:
            group.append(hit)
            reach = max(reach, hit[1])
    return kept


def windows_of(starts: set[int], reach: int, size: int) -> Iterator[tuple[int, int]]:
    """Places where a notice may start, told by its seeds, in groups of near ones: the first and last of each. No group spans more than the notice."""
    first = last = None
    for at in sorted(starts):
        if first is not None and (at - last > reach or at - first > size):
            yield first, last
            first = None
        first, last = at if first is None else first, at
    if first is not None:
        yield first, last


def fuzzy(norm: str) -> list[tuple[int, int, str, float]]:
    """Notices in words joined by single spaces: start, end, label, likeness (1 less the edits' share). Windows around seeds that hold the naming words are searched; their length is bounded, so that a text's cost grows with its length."""
    automaton, notices, patterns = searcher()
    padded = f" {norm} "
    possible = [f" {n.name} " in padded if n.name else True for n in notices]
    starts: dict[int, set[int]] = {}
    for end, (length, where) in automaton.iter(norm):
        for i, at in where:
            if possible[i]:
                starts.setdefault(i, set()).add(end + 1 - length - at)
    found = []
    for i, places in starts.items():
        notice, pattern = notices[i], patterns[i]
        k, size, hits = notice.edits, len(notice.text), set()
        for first, last in windows_of(places, k, size):
            low, high = max(0, first - k), last + size + k
            # a match is of whole words, so it ends at the window's last space at the latest
            stop = len(norm) if high >= len(norm) else norm.rfind(" ", low, high + 1)
            # padded is norm shifted by one, so that a name at the end of a window has its space
            if stop <= low or (notice.name and padded.find(f" {notice.name} ", low, stop + 2) < 0):
                continue
            # the best match of a part comes first, so what lies before it is searched again where it can hold a notice
            parts = [(low, stop)]
            while parts:
                low, stop = parts.pop()
                for m in pattern.finditer(norm, low, stop):
                    if sum(m.fuzzy_counts) <= k:
                        hits.add((m.start(), m.end(), 1 - sum(m.fuzzy_counts) / size))
                    if m.start() - low >= size - k:
                        parts.append((low, m.start()))
                    low = m.end()
        found += [(a, z, notice.label, like) for a, z, like in apart(hits)]
    return best_of_places(sorted(set(found)))


def scanned(text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, spans of one text. Spans are label:first word:last word."""
    words = [w for w in words_of(text or "") if w]
    if not words:
        return 0, 0, None, None, "", "", 0.0, ""
    norm = " ".join(words)
    places, base = [], set()
    if "license" in norm:
        padded = f" {norm} "
        for phrase, label in BASE.items():
            at = padded.find(f" {phrase} ")
            while at >= 0:
                places.append(at)
                base.add(label)
                at = padded.find(f" {phrase} ", at + 1)
    spans, labels, score = [], set(base), 1.0 if places else 0.0
    at = words_before = 0
    for start, end, label, like in fuzzy(norm):
        labels.add(label)
        score = max(score, like)
        words_before += norm.count(" ", at, start)
        at = start
        spans.append(f"{label}:{words_before}:{words_before + norm.count(' ', start, end)}")
    first = norm.count(" ", 0, min(places)) if places else None
    last = norm.count(" ", 0, max(places)) if places else None
    return len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, ",".join(spans)


KINDS = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}
FIELDS = {name: KINDS[kind] for name, kind in (c.split() for c in SCHEMA.split(", "))}


def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids pass as they are."""
    for batch in batches:
        rows = [scanned(t) for t in batch["text"].to_pylist()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * (len(FIELDS) - 1)
        arrays = [pa.array(c, kind) for c, kind in zip(columns, list(FIELDS.values())[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *arrays], list(FIELDS))


def scan_documents(docs: DataFrame) -> DataFrame:
    """One row per row of docs: n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Base places are where a phrase's words stand consecutively. The fuzzy search adds notices with at most one edit in ten
    characters, within whole words, with their spans in words; the words that name the license stand unchanged, and of notices of
    different labels on one place only the likeliest counts (none of equally likely ones). score is 1 with a base place, else the best notice's likeness, else
    0. Null and empty texts have no word. One pass over the scan, no shuffle.
    """
    shipped(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan_batches, SCHEMA)
