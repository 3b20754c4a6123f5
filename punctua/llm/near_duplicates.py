"""Operator 3, n-gram Jaccard join: token-combination prefixes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from punctua.llm import common
from punctua.llm.common import counted, dropped, hinted, looked_up, released, written
from punctua.llm.shingles import in_slices, mixed, ordered, set_keys
from punctua.session import shipped, trimmed

#: Two sets link when SIMILAR percent of their union is shared.
SIMILAR = 80
#: A shingle is frequent when more prefixes hold it.
FREQUENT = 8
#: Sets of fewer shingles index single frequent shingles, larger ones pairs.
PAIRS_FROM = 64
#: Bits of a broadcast bitmap: for each key, and at most (32 MB).
BITS_A_KEY, MOST_BITS = 16, 1 << 28
#: How far beyond its prefix a set's shingles are counted when frequent ones are sought.
REGION = 1.25
#: Rounds in which sets with many frequent shingles are counted whole.
ROUNDS = 4
#: Nodes from which on a list is long: its pairs are told from those of other long lists before they leave the join.
LONG_LIST = 32
#: Long lists, the least, that a node brings along to tell which of the lists in common with another counts.
LISTS_KNOWN = 8
#: A component is large if more than one in LARGE of the rows belong to it.
LARGE = 1000
#: 64-bit words of the parity sketch of a set.
SKETCH = 16
#: Sets that a task remembers, so that it does not repeat them.
MOST_SEEN = 1_000_000

#: Bands of set sizes: sets that may link lie in one band or in neighbouring ones.
EDGES = [1]
while EDGES[-1] < 1 << 40:
    EDGES.append(-(-EDGES[-1] * 100 // SIMILAR) if -(-EDGES[-1] * 100 // SIMILAR) > EDGES[-1] else EDGES[-1] + 1)
BANDS = np.array(EDGES)


def need_of(n: int) -> int:
    """One more than the shingles of a set of n that a linked set may lack."""
    return n * (100 - SIMILAR) // 100 + 1


class Bitmap:
    """Which keys are marked; keys share a bit now and then, which costs work and never a result. Its size is bounded."""

    def __init__(self, bits: int = 64, words: np.ndarray | None = None):
        self.bits, self.words = bits, words if words is not None else np.zeros(8, dtype=np.uint8)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        at = keys.astype(np.uint64) & np.uint64(self.bits - 1)
        return (self.words[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


class Marks:
    """Bitmaps as broadcasts of one run; they are taken back when all that reads them is written."""

    def __init__(self, spark: SparkSession):
        self.context, self.held = spark.sparkContext, []

    def of(self, df: DataFrame, n: int, *columns: str) -> Broadcast:
        """A bitmap of the longs in the columns of df, at most n keys, built by the executors in pieces of 4 KB."""
        bits = 1 << 15
        while bits < min(n * BITS_A_KEY, MOST_BITS):
            bits *= 2
        keys = reduce(DataFrame.union, [df.select(F.col(c).alias("key")) for c in columns])
        at = F.col("key").bitwiseAND(F.lit(bits - 1))
        parts = keys.groupBy(F.shiftright(at, 15).alias("part")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit((1 << 15) - 1))).alias("map"))
        words = np.zeros(bits // 8, dtype=np.uint8)
        for part, piece in parts.coalesce(8).collect():  # 8192 pieces at most
            words[part * 4096 : (part + 1) * 4096] = np.frombuffer(piece, dtype=np.uint8)
        self.held.append(self.context.broadcast(Bitmap(bits, words)))
        return self.held[-1]

    def taken_back(self) -> None:
        for shared in self.held:
            shared.destroy()
        self.held.clear()


def signatures(s: np.ndarray, frequent: Bitmap) -> tuple[np.ndarray, int, int]:
    """What a set is indexed under, such that any two linked sets share one; how many of these are rare shingles; how many frequent shingles the set has.

    Shingles stand in one global order: rare ones by hash, then frequent ones by hash. With enough rare ones the prefix is those
    alone, each a signature. Otherwise it is extended over frequent shingles, which count only as members of pairs: they are dealt
    into classes, and a class of c shingles in the prefix survives c - 1 losses before no pair of it is left. The number of classes
    follows the band of set sizes, so a set indexes its pairs for its own band and for the one below.
    """
    need = need_of(len(s))
    often = frequent.holds(s)
    rare = s[~often]
    if len(rare) >= need:
        return rare[:need], need, int(often.sum())
    left, held = need - len(rare), s[often]
    band = int(np.searchsorted(BANDS, len(s), side="right")) - 1
    found = [rare]
    for scheme in {band, max(0, band - 1)}:
        tag = np.uint64((scheme + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        if BANDS[scheme] < PAIRS_FROM:
            found.append(mixed(held[:left] ^ tag))
            continue
        classes = mixed(held) % np.uint64(max(1, BANDS[scheme] // 8))
        order = np.argsort(classes, kind="stable")
        again = np.ones(len(held), dtype=np.int64)  # not the first of its class in the order of the prefix
        again[order[np.concatenate([[True], classes[order][1:] != classes[order][:-1]])]] = 0
        stop = int(np.searchsorted(np.cumsum(again), left)) + 1
        taken, of = held[:stop], classes[:stop]
        order = np.argsort(of, kind="stable")
        taken, of = taken[order], of[order]
        for gap in range(1, len(taken)):
            same = of[gap:] == of[:-gap]
            if not same.any():
                break
            found.append(mixed((taken[:-gap][same] * np.uint64(3) + mixed(taken[gap:][same])) ^ tag))
    return np.concatenate(found), len(rare), len(held)


def parities(s: np.ndarray) -> np.ndarray:
    """A sketch of a set: for each of its bits, whether the number of shingles that fall on it is odd. Bits in which two sketches differ are never more than the shingles in which the sets differ."""
    odd = np.bincount((s & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def once(values: np.ndarray, edges: np.ndarray, seen: set[int]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers and keys of a slice's sets that are not empty and were not seen in this partition before."""
    keys, kept = set_keys(values, edges), []
    for i in np.flatnonzero(np.diff(edges)):
        if int(keys[i]) not in seen:
            kept.append(i)
            if len(seen) < MOST_SEEN:
                seen.add(int(keys[i]))
    return np.array(kept, dtype=np.int64), keys


def distinct_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Shingles, edges, the numbers of the sets not seen in this partition before, and all keys, slice by slice."""
    seen: set[int] = set()
    for batch in batches:
        for _, values, edges in in_slices(batch["text"].to_numpy(zero_copy_only=False)):
            kept, keys = once(values, edges, seen)
            if len(kept):
                yield values, edges, kept, keys


def region_of(n: np.ndarray) -> np.ndarray:
    """How many shingles, the first by hash, are counted of sets of n."""
    return np.minimum(n, ((n * (100 - SIMILAR) // 100 + 1) * REGION).astype(np.int64))


def described(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the text), n, node (a key of the set; null without words), region (the first shingles by hash, prefix and beyond, as ascending longs; none where the partition had the set before)."""
    schema = "doc_id long, digest long, n long, node long, region array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            texts, ids, digests = batch["text"].to_numpy(zero_copy_only=False), batch["doc_id"], batch["digest"]
            for part, values, edges in in_slices(texts):
                n, (kept, keys) = np.diff(edges), once(values, edges, seen)
                take = np.zeros(len(n), dtype=np.int64)
                take[kept] = region_of(n[kept])
                spot = np.arange(len(values)) - np.repeat(edges[:-1], n)
                region = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(take)]).astype(np.int32), pa.array(ordered(values[spot < np.repeat(take, n)])))
                yield pa.RecordBatch.from_arrays([ids[part], digests[part], pa.array(n), pa.array(keys, mask=n == 0), region], ["doc_id", "digest", "n", "node", "region"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), "text").mapInArrow(trimmed(run), schema)


def short_sets(table: DataFrame, frequent: Broadcast) -> DataFrame:
    """node: sets whose region holds too few rare shingles, so that their prefix reaches beyond it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            region, n = batch["region"], batch["n"].to_numpy()
            edges = region.offsets.to_numpy()
            before = np.concatenate([[0], np.cumsum(~frequent.value.holds(region.values.to_numpy()))])
            rare, held = before[edges[1:]] - before[edges[:-1]], np.diff(edges)
            short = (rare < n * (100 - SIMILAR) // 100 + 1) & (held < n) & (held > 0)
            yield batch.select(["node"]).filter(pa.array(short))

    return table.select("node", "n", "region").mapInArrow(trimmed(run), "node long")


def crowded_shingles(docs: DataFrame, frequent: Broadcast) -> DataFrame:
    """s: all shingles of the sets that short_sets() finds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for values, edges, kept, _ in distinct_sets(batches):
            before = np.concatenate([[0], np.cumsum(~frequent.value.holds(values))])
            n = np.diff(edges)[kept]
            take, start = region_of(n), edges[kept]
            short = kept[(before[start + take] - before[start] < n * (100 - SIMILAR) // 100 + 1) & (take < n)]
            if len(short):
                yield pa.RecordBatch.from_arrays([pa.array(ordered(np.concatenate([values[edges[i] : edges[i + 1]] for i in short])))], ["s"])

    return docs.select("text").mapInArrow(trimmed(run), "s long")


def frequent_shingles(docs: DataFrame, table: DataFrame, marks: Marks) -> Broadcast:
    """A bitmap of the shingles that more than FREQUENT sets may be indexed under, counted over all sets.

    Prefixes lie in the counted regions, but for sets that hold many frequent shingles. Those sets are counted whole, which may find
    more frequent shingles and so more such sets, until there are none (or ROUNDS are over: lists may then be longer, never wrong)."""
    many = lambda df: df.groupBy("s").count().where(F.col("count") > FREQUENT).select("s")
    often, n = counted(many(table.select(F.explode("region").alias("s"))), "frequent")
    frequent, known = marks.of(often, n, "s"), 0
    for _ in range(ROUNDS):
        short = short_sets(table, frequent).count()
        if short <= known:
            break
        known, before = short, often
        often, n = counted(often.union(many(crowded_shingles(docs, frequent))).distinct(), "frequent")
        dropped(before)
        frequent = marks.of(often, n, "s")
    dropped(often)
    return frequent


def signatures_of(docs: DataFrame, frequent: Broadcast) -> DataFrame:
    """sig, node: the signatures of each distinct set, once in each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for values, edges, kept, keys in distinct_sets(batches):
            found = [signatures(values[edges[i] : edges[i + 1]], frequent.value)[0] for i in kept]
            yield pa.RecordBatch.from_arrays([pa.array(ordered(np.concatenate(found))), pa.array(np.repeat(keys[kept], [len(x) for x in found]))], ["sig", "node"])

    return docs.select("text").mapInArrow(trimmed(run), "sig long, node long")


def postings_of(docs: DataFrame, frequent: Broadcast, repeated: Broadcast) -> DataFrame:
    """node, n, low, sketch, postings (array of sig, most): sets with a signature that the bitmap `repeated` holds.

    low: the least hashes, of which sets that link have one in common. sketch: parities() of the set. most: what the set can share
    with one that it meets under this signature alone. Sets that index frequent shingles index all their rare ones too; two of them that share no rare one have only
    frequent ones in common."""
    kind = pa.struct([("sig", pa.int64()), ("most", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for values, edges, kept, keys in distinct_sets(batches):
            rows = []
            for i in kept:
                s = values[edges[i] : edges[i + 1]]
                sigs, rare, often = signatures(s, frequent.value)
                held = np.flatnonzero(repeated.value.holds(sigs))
                if len(held):
                    rows.append((keys[i], len(s), ordered(s[: need_of(len(s))]), parities(s), ordered(sigs[held]), np.where(held < rare, len(s), often)))
            if rows:
                node, n, low, sketch, sigs, most = zip(*rows, strict=True)
                ends = np.cumsum([0, *map(len, sigs)]).astype(np.int32)
                postings = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(most))], fields=list(kind)))
                low, sketch = pa.array(low, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(n), low, sketch, postings], ["node", "n", "low", "sketch", "postings"])

    return docs.select("text").mapInArrow(trimmed(run), "node long, n long, low array<long>, sketch array<long>, postings array<struct<sig: long, most: long>>")


def sets_of(docs: DataFrame, nodes: Broadcast) -> DataFrame:
    """node, shingles: the whole sets of the nodes that a bitmap holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for values, edges, kept, keys in distinct_sets(batches):
            kept = kept[nodes.value.holds(keys[kept])]
            if len(kept):
                rows = pa.array([ordered(values[edges[i] : edges[i + 1]]) for i in kept], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(keys[kept]), rows], ["node", "shingles"])

    return docs.select("text").mapInArrow(trimmed(run), "node long, shingles array<long>").dropDuplicates(["node"])


def labelled(links: DataFrame, n: int) -> DataFrame:
    """node, component: the least node at most two of the n links (a, b) away, itself included. So nodes of one label are connected.

    Few labels are broadcast. Of many, a node with more than a thousandth of the links may stand at one end of a third of them. There are 2,000 such nodes at most, so
    their labels are broadcast, and only the other nodes' links are dealt out by node."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    first = both.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("l"), F.count(F.lit(1)).alias("degree")).select("b", F.least("b", "l").alias("l"), "degree")
    if 2 * n <= common.BROADCAST_ROWS:
        near = both.join(F.broadcast(first), "b")
        return near.groupBy(F.col("a").alias("node")).agg(F.min("l").alias("component"))
    hub = F.col("degree") * 1000 > n
    hubs = F.broadcast(first.where(hub).select("b", "l"))
    near = both.join(hubs, "b").union(both.join(hubs, "b", "left_anti").join(first.where(~hub).select("b", "l"), "b").select("b", "a", "l"))
    return near.groupBy(F.col("a").alias("node")).agg(F.min("l").alias("component"))


def components(links: DataFrame, n: int) -> DataFrame:
    """node, component: a node of each component by n links (a, b), for all nodes that have links. What has one label is contracted until no link is left."""
    labels = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    first = True
    while n:
        step = hinted(*counted(labelled(links, n), "labels", 2 * n))
        at = lambda k: step.select(F.col("node").alias(k), F.col("component").alias(f"{k}_group"))  # noqa: E731,B023
        joined = links.join(at("a"), "a").join(at("b"), "b").where("a_group <> b_group")
        joined = joined.select(F.least("a_group", "b_group").alias("a"), F.greatest("a_group", "b_group").alias("b")).distinct()
        links, n = counted(joined, "edges", n)
        if first:
            labels, first = step, False
        else:
            up = step.select(F.col("node").alias("component"), F.col("component").alias("top"))
            labels = written(labels.join(up, "component", "left").select("node", F.coalesce("top", "component").alias("component")), "labels")
    return labels


def likely(pairs: DataFrame, lows: DataFrame) -> DataFrame:
    """The pairs (a, b) that may still link by the least hashes of both sets: what these share, and at most all of the rest of the smaller rest."""
    side = lambda k, v: lows.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("low").alias(v))
    rows = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    rows = rows.where(F.least("n_a", "n_b") * 100 >= SIMILAR * F.greatest("n_a", "n_b"))
    # up to the lesser of the last hashes both sets are known whole
    upto = F.least(F.element_at("x", -1), F.element_at("y", -1))
    known = lambda v: F.size(F.filter(v, lambda h: h <= upto))
    most = F.size(F.array_intersect("x", "y")) + F.least(F.col("n_a") - known("x"), F.col("n_b") - known("y"))
    return rows.where(most * (100 + SIMILAR) >= SIMILAR * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def linked_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(left, "a").join(right, "b").where(both * 100 >= SIMILAR * (F.size("x") + F.size("y") - both)).select("a", "b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, its own included).

    Two documents link when 80 % of the union of their sets of five-word shingles is shared. Equal sets are one node. Lists of the
    index are not expanded into pairs: first each list's nodes are compared with one hub, then with a hub drawn for each list, and
    only nodes outside the largest component of a list are compared with all of it, so a large group of copies costs its size and not
    its square, while no link between components is missed. Pairs are first held against sketches and the least hashes of both sets, then verified on whole sets.
    Documents without words link with nothing. Rows with equal ids are judged by their own texts; null ids never name a component
    unless all of its ids are null.
    """
    return grouped(docs).select("doc_id", "n_shingles", "component_id")


def grouped(docs: DataFrame) -> DataFrame:
    """near_duplicates with digest (of the row's text) and first: whether the row's id and text are the least of its component, null ids last."""
    shipped(docs.sparkSession)
    marks = Marks(docs.sparkSession)
    table, n_rows = counted(described(docs), "sets")
    frequent = frequent_shingles(docs, table, marks)
    repeated = signatures_of(docs, frequent).groupBy("sig").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("sig")
    repeated, n_lists = counted(repeated, "repeated")
    held_sets = written(postings_of(docs, frequent, marks.of(repeated, n_lists, "sig")), "found")
    lows = written(held_sets.select("node", "n", "low", "sketch").dropDuplicates(["node"]), "lows")
    found = held_sets.select("node", "n", F.inline("postings"))
    # the hub of a list is a node with the fewest rare shingles, which in a group of copies is the nearest to their common text
    bits = F.lit((1 << 40) - 1)
    central = (F.col("n") - F.col("most")) * (1 << 40)
    orders = {"hub": central + F.col("node").bitwiseAND(bits), "other": central + F.col("node").bitwiseXOR(F.col("sig")).bitwiseAND(bits)}
    chosen = [F.min_by(c, o).alias(f"{h}_{c}") for h, o in orders.items() for c in ("node", "n", "most")]
    lists = found.groupBy("sig").agg(F.min("node").alias("__a"), F.max("node").alias("__z"), F.min("n").alias("least"), *chosen)
    lists = lists.where("__a <> __z").drop("__a", "__z")
    postings = written(found.distinct().join(lists, "sig"), "postings")
    dropped(repeated, held_sets)
    released(docs.sparkSession)
    links, held = [], [0]

    def verified(pairs: DataFrame) -> tuple[DataFrame, int]:
        """All links so far and those among the pairs (a, b), and their number."""
        pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        near, n = counted(likely(pairs, lows), "likely")
        fresh, n = counted(linked_pairs(near, sets_of(docs, marks.of(near, 2 * n, "a", "b"))), "links", n)
        links.append(fresh)
        held[0] += n
        dropped(near)
        released(docs.sparkSession)
        return reduce(DataFrame.union, links), held[0]

    def placed(rows: DataFrame, groups: DataFrame, *columns: str) -> DataFrame:
        """rows with the component of each of the columns' nodes; a node without links is its own."""
        for c in columns:
            known = groups.select(F.col("node").alias(c), F.col("component").alias(f"{c}_group"))
            rows = rows.join(known, c, "left").withColumn(f"{c}_group", F.coalesce(f"{c}_group", c))
        return rows

    def may(n: str, most: str, m: str, also: str) -> Column:
        """Sizes and what the two sets can share at most allow a link."""
        a, b = F.col(n), F.col(m)
        return (F.least(a, b) * 100 >= SIMILAR * F.greatest(a, b)) & (F.least(most, also) * (100 + SIMILAR) >= SIMILAR * (a + b))

    def met(rows: DataFrame, hub: str) -> DataFrame:
        """Each row's node beside the list's hub."""
        return rows.where(may("n", "most", f"{hub}_n", f"{hub}_most")).select(F.col(f"{hub}_node").alias("a"), F.col("node").alias("b"))

    # first round: the same hub for all lists of a group; second: a hub drawn for each list, for nodes that are still apart from it
    known, n = verified(met(postings, "hub"))
    groups = hinted(*counted(labelled(known, n), "labels", 2 * n))
    known, n = verified(met(placed(postings, groups, "node", "other_node").where("node_group <> other_node_group"), "other"))
    groups = hinted(*counted(labelled(known, n), "labels", 2 * n))
    # last round: within each list the pairs of nodes that are still in different components, but for those with the hub
    alone = F.greatest("least", F.ceil(F.col("n") * SIMILAR / 100))
    hopeful = postings.where(F.col("most") * (100 + SIMILAR) >= SIMILAR * (F.col("n") + alone)).where("node <> hub_node")
    rows = placed(hopeful.select("sig", "node", "n", "most"), groups, "node")
    # of two nodes that are apart, one at least is outside the largest component of the list
    sizes = rows.groupBy("sig", "node_group").count().groupBy("sig").agg(F.max_by("node_group", F.struct("count", "node_group")).alias("main"), F.sum("count").alias("size"), F.count(F.lit(1)).alias("groups"))
    rows = written(rows.join(sizes.where("groups > 1").drop("groups"), "sig"), "apart")

    def meetings(rows: DataFrame, *more: str) -> DataFrame:
        """Pairs of nodes of one list in different components: those outside the largest one with all."""
        other = rows.select("sig", F.col("node").alias("b"), F.col("n").alias("m"), F.col("most").alias("also"), F.col("node_group").alias("b_group"), *(F.col(c).alias(f"b_{c}") for c in more))
        met = rows.where("node_group <> main").join(other, "sig")
        met = met.where((F.col("node_group") != F.col("b_group")) & ((F.col("b_group") == F.col("main")) | (F.col("node") < F.col("b"))) & may("n", "most", "m", "also"))
        if more:  # by their sketches the sets may differ in few enough shingles
            apart = reduce(Column.__add__, [F.bit_count(F.col("sketch")[i].bitwiseXOR(F.col("b_sketch")[i])) for i in range(SKETCH)])
            met = met.where(apart * (100 + SIMILAR) <= (100 - SIMILAR) * (F.col("n") + F.col("m")))
            # of a pair's common long lists (of one kind, rare or frequent, as the bounds differ) the least counts, if both know it
            both = F.array_intersect("sigs", "b_sigs")
            met = met.where((F.size(both) == 0) | (F.array_min(both) == F.col("sig")))
        return met.select(F.col("node").alias("a"), "b")

    long = rows.where(F.col("size") >= LONG_LIST)
    of_node = long.groupBy("node", "most").agg(F.slice(F.array_sort(F.collect_list("sig")), 1, LISTS_KNOWN).alias("sigs"))
    of_node = of_node.join(lows.select("node", "sketch"), "node")
    known, n = verified(meetings(rows.where(F.col("size") < LONG_LIST)).union(meetings(long.join(of_node, ["node", "most"]), "sigs", "sketch")))
    groups = hinted(components(known, n), 2 * n)
    marks.taken_back()
    dropped(postings, lows, rows)
    members = placed(table.where(F.col("node").isNotNull()).select("doc_id", "digest", "n", "node"), groups, "node")
    row = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "digest")
    names = members.groupBy("node_group").agg(F.min("doc_id").alias("component_id"), F.min(row).alias("least"), F.count(F.lit(1)).alias("size"))
    # there are fewer than LARGE such components: they are broadcast, and their rows are not dealt out by component
    hot = F.col("size") * LARGE > n_rows
    large = F.broadcast(names.where(hot))
    named = members.join(large, "node_group").unionByName(members.join(large, "node_group", "left_anti").join(names.where(~hot), "node_group"))
    named = named.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "digest", row.eqNullSafe(F.col("least")).alias("first"))
    bare = table.where(F.col("node").isNull())
    return named.unionByName(bare.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "digest", F.lit(True).alias("first")))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one document of each component, the one of the smallest id, of the least digest among equal ids; columns stay.

    Rows are told apart by id and text, so rows with equal or null ids stay or go by their own texts. Repeated rows (equal id and text)
    become one."""
    found = written(grouped(docs).select(F.col("doc_id").alias("__id"), F.col("digest").alias("__of"), "first"), "components")
    away, n_away = counted(found.where(~F.col("first")).select("__id", "__of").distinct(), "away")
    repeated, n_repeated = counted(found.groupBy("__id", "__of").count().where("count > 1").select("__id", "__of", F.lit(True).alias("__again")), "repeated")
    rows = docs.withColumn("__digest", F.xxhash64("text"))
    same = lambda keys: F.col("doc_id").eqNullSafe(keys["__id"]) & (F.col("__digest") == keys["__of"])
    kept = looked_up(rows, F.col("__digest"), away, away["__of"], n_away, same(away), "left_anti")
    if n_repeated:
        again = looked_up(kept, F.col("__digest"), repeated, repeated["__of"], n_repeated, same(repeated), "left")
        once = again.where("__again").dropDuplicates(["doc_id", "text"])
        kept = again.where("__again IS NULL").unionByName(once)
    return kept.select(*docs.columns)
