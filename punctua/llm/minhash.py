"""Operator 12, MinHash near-dedup: SetSketch registers, banded; pairs are estimated by joint likelihood, then verified."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctua.llm.common import counted, dropped, joined, written
from punctua.llm.near_duplicates import components, labelled, linked_pairs, once, parities
from punctua.llm.shingles import in_slices, ordered
from punctua.session import shipped

#: Words of a shingle.
WIDTH = 4
#: Two sets link when SIMILAR percent of their union is shared.
SIMILAR = 80
#: Registers of a sketch, and of a band. Two sets that share 80 % miss each other in all 40 bands once in 10 ** 9 times.
REGISTERS, BAND = 160, 4
#: The base of the registers' exponential spacing, the rate of the hashes, and the largest register value less one.
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 2
#: A pair is given up when the registers are e ** UNLIKELY times as likely at another similarity, a lower one, as at 80 %.
UNLIKELY = 20.0
RNG = np.random.default_rng(12)
FACTORS, TERMS = RNG.integers(1, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1), RNG.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)


def sketches(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The registers (one row a set) of non-empty sets of hashes that begin at starts.

    Each register hashes every element anew to an exponential variable, keeps the least, and stores its place on a scale of powers of
    BASE, cut off at both ends. Sketches of two sets merge to that of their union by the larger register."""
    least = np.empty((len(starts), REGISTERS), dtype=np.float64)
    for j in range(REGISTERS):
        least[:, j] = np.minimum.reduceat(values * FACTORS[j] + TERMS[j], starts)
    x = -np.log1p(-(least + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / np.log(BASE)), 0, TOP + 1).astype("<u2")


def chance(x: np.ndarray) -> np.ndarray:
    """The probability that a register of one set exceeds that of the other, of which x of their elements, by rate, are alone in it."""
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def log_likelihood(similarity: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, more: np.ndarray, less: np.ndarray) -> np.ndarray:
    """Of sets of n_a and n_b elements with so many registers greater in a and in b, jointly, if they have this similarity."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    p, q = chance(u - v * similarity), chance(v - u * similarity)
    log = lambda y: np.log(np.maximum(y, 1e-300))
    return more * log(p) + less * log(q) + (REGISTERS - more - less) * log(1 - p - q)


def estimated(n_a: np.ndarray, n_b: np.ndarray, more: np.ndarray, less: np.ndarray) -> np.ndarray:
    """The similarity of greatest likelihood, which has one peak: by a ternary search."""
    low, high = np.zeros(len(n_a)), np.minimum(n_a / n_b, n_b / n_a)
    for _ in range(40):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        up = log_likelihood(a, n_a, n_b, more, less) < log_likelihood(b, n_a, n_b, more, less)
        low, high = np.where(up, a, low), np.where(up, high, b)
    return (low + high) / 2


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the row's id and text), n, node (a key of the set; null without words), sketch and parity (where the partition had the set not before)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            texts = batch["text"].to_numpy(zero_copy_only=False)
            for part, values, edges in in_slices(texts, width=WIDTH):
                n, (kept, keys) = np.diff(edges), once(values, edges, seen)
                sketch, parity = [None] * len(n), [None] * len(n)
                if len(kept):
                    fresh = np.zeros(len(n), dtype=bool)
                    fresh[kept] = True
                    own = values[np.repeat(fresh, n)]
                    ends = np.cumsum(n[kept])
                    for i, row, a, b in zip(kept, sketches(own, ends - n[kept]), ends - n[kept], ends, strict=True):
                        sketch[i], parity[i] = row.tobytes(), parities(own[a:b])
                columns = [batch["doc_id"][part], batch["key"][part], pa.array(n), pa.array(keys, mask=n == 0), pa.array(sketch, pa.binary()), pa.array(parity, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "n", "node", "sketch", "parity"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), "text")
    return rows.mapInArrow(run, "doc_id long, key long, n long, node long, sketch binary, parity array<long>")


def row_key() -> Column:
    return F.xxhash64("text", F.col("doc_id").cast("long"))


def sets_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, shingles: the whole sets of the rows that nodes' keys name. Copies under other ids do not take part, so a text with many copies is read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, values, edges in in_slices(batch["text"].to_numpy(zero_copy_only=False), width=WIDTH):
                kept, keys = once(values, edges, seen)
                if len(kept):
                    rows = pa.array([ordered(values[edges[i] : edges[i + 1]]) for i in kept], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(keys[kept]), rows], ["node", "shingles"])

    texts = docs.select(row_key().alias("key"), "text").join(nodes.select("key"), "key", "left_semi")
    return texts.select("text").mapInArrow(run, "node long, shingles array<long>")


def alike(n: Column, m: Column) -> Column:
    return F.least(n, m) * 100 >= SIMILAR * F.greatest(n, m)


def differing(parity: str, other: str, n: Column, m: Column) -> Column:
    """By their parities the sets may differ in few enough shingles."""
    apart = reduce(Column.__add__, [F.bit_count(F.col(parity)[i].bitwiseXOR(F.col(other)[i])) for i in range(16)])
    return apart * (100 + SIMILAR) <= (100 - SIMILAR) * (n + m)


def likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that may link: by their sizes, by parities, and by the joint likelihood of their registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), dtype="<u2").reshape(-1, REGISTERS) for c in ("x", "y"))
            n, m = (batch[c].to_numpy().astype(np.float64) for c in ("n", "m"))
            more, less = (x > y).sum(axis=1), (x < y).sum(axis=1)
            best = estimated(n, m, more, less)
            goal = np.full(len(n), SIMILAR / 100)
            lost = log_likelihood(best, n, m, more, less) - log_likelihood(goal, n, m, more, less)
            yield batch.select(["a", "b"]).filter(pa.array((best >= goal) | (lost <= UNLIKELY)))

    side = lambda k, *to: nodes.select(F.col("node").alias(k), *(F.col(c).alias(t) for c, t in zip(("n", "sketch", "parity"), to, strict=True)))
    rows = pairs.join(side("a", "n", "x", "p"), "a").join(side("b", "m", "y", "q"), "b")
    rows = rows.where(alike(F.col("n"), F.col("m")) & differing("p", "q", F.col("n"), F.col("m")))
    return rows.select("a", "b", "n", "m", "x", "y").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable by links), kept (whether that is its own id).

    Two documents link when 80 % of the union of their sets of four-word shingles is shared. Equal sets are one node; nodes with
    equal registers in a band are a list. Lists are not expanded into pairs: first each list's nodes meet its most met node, then the
    most met node outside that one's component, and then only nodes outside the largest component of a list meet all of it that is in
    another. Pairs that may link by the joint likelihood of their registers are verified on whole sets. Documents without words link
    with nothing. Rows with equal ids are judged by their own texts; null ids never name a component unless all of its ids are null.
    """
    shipped(docs.sparkSession)
    table, n_rows = counted(sketched(docs), "sketched")
    fresh = table.where(F.col("sketch").isNotNull())
    bands = fresh.select("node", "n", F.explode(F.array(*(F.xxhash64(F.lit(i), F.substring("sketch", 2 * BAND * i + 1, 2 * BAND)) for i in range(REGISTERS // BAND)))).alias("sig"))
    lists = bands.groupBy("sig").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count(F.lit(1)).alias("size"))
    lists, _ = counted(lists.where("least <> most").select("sig", "size"), "lists")
    # a list holds a node once in each partition at most, one in 40 rows in all; adaptive execution splits a list that is large even so
    found, n_found = counted(bands.join(lists, "sig"), "found")
    # a node that many others meet is the nearest to the common text of a group
    met = found.groupBy("node").agg(F.sum("size").alias("met"))
    nodes = fresh.groupBy("node").agg(F.min(F.struct("key", "n", "sketch", "parity")).alias("one")).select("node", "one.*")
    nodes = written(nodes.join(met, "node"), "nodes")
    found = found.select("sig", "node", "n").distinct().join(nodes.select("node", "met"), "node")
    postings = written(found, "postings")
    sets = written(sets_of(docs, nodes), "sets")
    links, held = [], [0]

    def verified(pairs: DataFrame) -> tuple[DataFrame, int]:
        """All links so far and those among the pairs (a, b), and their number."""
        pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        near, n = counted(likely(pairs, nodes), "likely")
        fresh, n = counted(linked_pairs(near, sets).distinct(), "links", n)
        links.append(fresh)
        held[0] += n
        dropped(near)
        return reduce(DataFrame.union, links), held[0]

    def hubs(rows: DataFrame) -> DataFrame:
        """Pairs of each list's most met node with the others."""
        best = rows.groupBy("sig").agg(F.max(F.struct("met", "node", "n")).alias("hub"), F.count(F.lit(1)).alias("size"))
        pairs = joined(rows, best, "sig", "size", n_found)
        return pairs.where(alike(F.col("n"), F.col("hub.n"))).select(F.col("hub.node").alias("a"), F.col("node").alias("b"))

    def grouped(rows: DataFrame, groups: DataFrame) -> DataFrame:
        """Rows of the lists whose nodes are of several components, with the component of the node and that of most of the list's nodes."""
        rows = rows.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
        sizes = rows.groupBy("sig", "component").count().groupBy("sig").agg(F.max_by("component", F.struct("count", "component")).alias("main"), F.count(F.lit(1)).alias("groups"), F.sum("count").alias("size"))
        return joined(rows, sizes.where("groups > 1").drop("groups"), "sig", "size", n_found)

    known, n = verified(hubs(postings))
    apart = written(grouped(postings, labelled(known, n)), "apart")
    outside = apart.where("component <> main")
    best = outside.groupBy("sig").agg(F.max(F.struct("met", "node", "n", "component")).alias("hub"), F.count(F.lit(1)).alias("size"))
    second = joined(apart, best, "sig", "size", n_found).where(alike(F.col("n"), F.col("hub.n")) & (F.col("component") != F.col("hub.component")))
    known, n = verified(second.select(F.col("hub.node").alias("a"), F.col("node").alias("b")))
    rest = written(grouped(postings, components(known, n)).join(nodes.select("node", "parity"), "node"), "rest")
    other = rest.select("sig", *(F.col(c).alias(f"b_{c}") for c in ("node", "n", "component", "parity")))
    pairs = rest.where("component <> main").join(other, "sig").where(F.col("component") != F.col("b_component"))
    pairs = pairs.where((F.col("b_component") == F.col("main")) | (F.col("node") < F.col("b_node")))
    pairs = pairs.where(alike(F.col("n"), F.col("b_n")) & differing("parity", "b_parity", F.col("n"), F.col("b_n")))
    known, n = verified(pairs.select(F.col("node").alias("a"), F.col("b_node").alias("b")))
    groups = components(known, n)
    own = table.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"))
    own = written(own.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")), "own")
    names = own.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("size"))
    named = joined(own, names, "component", "size", n_rows).select("node", "component_id", "rows")
    members = joined(table.select("doc_id", "n", "node").where("node IS NOT NULL"), written(named, "named"), "node", "rows", n_rows)
    bare = table.where(F.col("node").isNull()).select("doc_id", "n", "node", F.col("doc_id").alias("component_id"))
    dropped(postings, sets, nodes, apart, rest)
    return members.unionByName(bare).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))

