"""Operator 8, exact top-k search: a bit-sliced index."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from punctua.session import shipped

#: Vectors of one index block, queries that are dealt to it together, and those that meet it at a time.
BLOCK_ROWS = 8192
QUERY_ROWS = 8192
SLICE_ROWS = 512
#: Bits dropped from components and from weights in the slices; what is dropped widens the boundary that is resolved exactly.
DROP_COMPONENT, DROP_WEIGHT = 3, 0
SCALE = 1024


class BitSlices:
    """Bitmaps of the bits of each component of a block's vectors, less the component's least value."""

    def __init__(self, x: np.ndarray, drop: int = DROP_COMPONENT):
        self.x, self.drop = x, drop
        self.low, self.high = x.min(axis=0), x.max(axis=0)
        self.words = -(-len(x) // 64)
        self.slices = []
        for d in range(x.shape[1]):
            u = (x[:, d] - self.low[d]) >> drop
            bits = max(1, int((self.high[d] - self.low[d]) >> drop).bit_length())
            self.slices.append(np.stack([self.bitmap((u >> b) & 1) for b in range(bits)]))
        self.real = self.bitmap(np.ones(len(x), dtype=np.int64))

    def bitmap(self, bits: np.ndarray) -> np.ndarray:
        padded = np.zeros(self.words * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        return np.packbits(padded, bitorder="little").view(np.uint64)

    def sums(self, q: np.ndarray, drop: int = DROP_WEIGHT) -> tuple[list[np.ndarray], np.ndarray]:
        """For queries q: slices (queries x words each, least significant first) of the sum of weighted components, and how far the
        true inner product (less a constant of the query) may lie above it. Components with a negative weight count from above."""
        negative = q < 0
        weight = np.abs(q)
        kept = weight >> drop
        top = np.array([(1 << len(s)) - 1 for s in self.slices], dtype=np.int64)  # complement within the slices
        total: list[np.ndarray] = []
        zeros = np.zeros((len(q), self.words), dtype=np.uint64)
        for d, slices in enumerate(self.slices):
            flip = np.where(negative[:, d], ~np.uint64(0), np.uint64(0))[:, None]
            addends = [s[None, :] ^ flip for s in slices]
            for c in range(int(kept[:, d].max()).bit_length()):
                mask = np.where((kept[:, d] >> c) & 1 == 1, ~np.uint64(0), np.uint64(0))[:, None]
                carry, at = None, c
                for a in addends:
                    while len(total) <= at:
                        total.append(zeros)
                    a = a & mask
                    s = total[at]
                    half = s ^ a
                    if carry is None:
                        total[at], carry = half, s & a
                    else:
                        total[at], carry = half ^ carry, (s & a) | (half & carry)
                    at += 1
                while carry.any():
                    if len(total) <= at:
                        total.append(zeros)
                    total[at], carry = total[at] ^ carry, total[at] & carry
                    at += 1
        # a true addend lies in [0, most]; its slices hold (v >> drop) or the complement of it
        low_bits = (1 << self.drop) - 1
        most = (top << self.drop) + low_bits
        error = ((weight - (kept << drop)) * most + (kept << drop) * low_bits).sum(axis=1)
        return total, error

    def nearest(self, q: np.ndarray, k: int, drop: int = DROP_WEIGHT) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the rows that may be among the k best, found from the most significant slice downward, and their exact scores."""
        total, error = self.sums(q, drop)
        need = np.full(len(q), min(k, len(self.x)))
        sure, tied = np.zeros((len(q), self.words), np.uint64), np.tile(self.real, (len(q), 1))
        kth = np.zeros(len(q), dtype=np.int64)  # the k-th greatest slice sum
        for b in range(len(total) - 1, -1, -1):
            ones = tied & total[b]
            enough = np.bitwise_count(sure | ones).sum(axis=1) >= need
            kth += enough.astype(np.int64) << b
            sure = np.where(enough[:, None], sure, sure | ones)
            tied = np.where(enough[:, None], ones, tied & ~total[b])
        # the boundary: sums from which the true score may still reach the k-th best
        floor = np.maximum(kth - -(-error // (1 << (self.drop + drop))), 0)
        above, equal = np.zeros_like(sure), np.tile(self.real, (len(q), 1))
        for b in range(len(total) - 1, -1, -1):
            bit = (floor >> b) & 1 == 1
            above = np.where(bit[:, None], above, above | (equal & total[b]))
            equal = np.where(bit[:, None], equal & total[b], equal & ~total[b])
        chosen = above | equal
        out = []
        for i in range(len(q)):
            rows = np.flatnonzero(np.unpackbits(chosen[i].view(np.uint8), bitorder="little")[: len(self.x)])
            out.append((rows, self.x[rows] @ q[i]))
        return out


FOUND = "query_id long, twin long, copies int, vec_id long, score long"


def block_top(rows: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best of one block for each query of one query block. A row of `rows` is a distinct vector with its least ids. The index of the block is built once."""
    out = []
    if len(rows) and len(queries):
        x = np.stack(rows["x"].to_numpy()).astype(np.int64)
        index = BitSlices(x)
        ids = [np.asarray(v, dtype=np.int64) for v in rows["ids"]]
        every = np.stack(queries["x"].to_numpy()).astype(np.int64)
        for low in range(0, len(queries), SLICE_ROWS):
            part, q = queries.iloc[low : low + SLICE_ROWS], every[low : low + SLICE_ROWS]
            for own, query, twin, copies, (near, scores) in zip(q, part["query_id"], part["twin"], part["copies"], index.nearest(q, k + 1), strict=True):
                found = np.concatenate([ids[r] for r in near])
                score = np.repeat(scores, [len(ids[r]) for r in near])
                keep = np.ones(len(found), dtype=bool)
                at = 0
                for r in near:  # the query's own row goes, once; another row of its id stays
                    if (x[r] == own).all():
                        keep[at + np.flatnonzero(ids[r] == query)[:1]] = False
                    at += len(ids[r])
                found, score = found[keep], score[keep]
                best = np.lexsort((found, -score))[:k]
                out.append(pd.DataFrame({"query_id": query, "twin": twin, "copies": copies, "vec_id": found[best], "score": score[best]}))
    empty = pd.DataFrame({c.split()[0]: [] for c in FOUND.split(", ")}, dtype="int64")
    return pd.concat([empty, *out]).astype("int64")


def search(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """query_id, rank, vec_id, score: the k greatest integer inner products of each query, ties to the smaller vec_id.

    Components become floor(1024 x). Queries are the rows whose vec_id is divisible by `every`; candidates are all other rows, also
    those of the same id, so a repeated row answers as often as it stands there. Rows without id, null vectors and vectors with a null
    or non-finite component take no part. Vectors meet those of their own length only; empty ones score 0 with each other.
    |floor(1024 x)| must be under 2 ** 26, and scores must fit into a long. Equal vectors are indexed once with their k + 1 least ids,
    which loses no result. Blocks of the index meet blocks of queries; each pair of blocks answers k rows a query, of which a window
    takes the best.
    """
    shipped(vectors.sparkSession)
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    v = v.where(F.col("vec_id").isNotNull() & F.col("e").isNotNull()).where(F.forall("e", finite))
    v = v.select("vec_id", F.transform("e", lambda c: F.floor(c * SCALE).cast("long")).alias("x"))
    first = F.row_number().over(Window.partitionBy("x").orderBy("vec_id"))
    distinct = v.withColumn("__n", first).where(F.col("__n") <= k + 1).groupBy("x").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    n = v.count()
    blocks, query_blocks = max(1, -(-n // BLOCK_ROWS)), max(1, -(-n // (every * QUERY_ROWS)))
    width, salt = F.size("x").alias("width"), F.xxhash64("x")
    rows = distinct.select("x", "ids", width, F.pmod(salt, F.lit(blocks)).alias("block"))
    rows = rows.withColumn("query_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))))
    # queries of one id are told apart by their vectors
    asked = v.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id"), "x").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    queries = asked.select("query_id", "x", salt.alias("twin"), "copies", width, F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).alias("query_block"))
    queries = queries.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    keys = ["width", "block", "query_block"]
    met = rows.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(lambda a, b: block_top(a, b, k), FOUND)
    # a repeated id may be a candidate in several blocks, with several vectors
    best = F.row_number().over(Window.partitionBy("query_id", "twin").orderBy(F.desc("score"), "vec_id"))
    ranked = met.withColumn("rank", best.cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score", F.explode(F.array_repeat("twin", F.col("copies")))).drop("col")
