"""Operator 13, conversation prefix trie: first owned depths by binary search against prefix-digest minima; owned chains are the tree."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctua.llm.common import WORD, counted, dropped, joined, written
from punctua.session import shipped

#: Depths of a conversation that meet in one task.
CHUNK = 1024
#: Conversations whose ids differ below these bits are joined to one string at a time.
ID_BITS = 10
#: Conversations of one group begin with turns of the group's first one.
GROUP = 20


def ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, k (from 0), digest, words: the turns in order, without texts; turns of one number by digest. Rows without conv_id take no part.

    The rows are dealt by ranges of (conv_id, turn, digest, a number of the row), so that neither a long conversation nor a repeated
    turn is one key; a place is that within a piece, after the sizes of the pieces before."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "turns")
    dealt = written(rows.repartitionByRange("conv_id", "turn", "digest", "row").withColumn("piece", F.spark_partition_id()).drop("row"), "dealt")
    pieces = dealt.groupBy("conv_id", "piece").agg(F.count(F.lit(1)).alias("n"))
    start = F.sum("n").over(Window.partitionBy("conv_id").orderBy("piece")) - F.col("n")
    own = F.row_number().over(Window.partitionBy("conv_id", "piece").orderBy("turn", "digest")) - 1
    placed = dealt.join(pieces.withColumn("start", start), ["conv_id", "piece"])
    turns = written(placed.select("conv_id", (F.col("start") + own).alias("k"), "digest", "words"), "ordered")
    dropped(rows, dealt)
    return turns


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv_id, length of each conversation, and conv_id, pos, digest, words of its turns: the first h of its group's first conversation, then its own after its first h."""
    turns = ordered(conversations)
    lengths = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    bases = lengths.select(F.col("conv_id").alias("base"), F.col("own").alias("had"))
    convs = lengths.withColumns({"h": h, "base": base}).join(bases, "base", "left")
    lent = F.least("h", F.coalesce("had", F.lit(0)))
    convs = written(convs.select("conv_id", "base", "h", lent.alias("lent"), (lent + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")), "conversations")
    heads = turns.where("k < 3").select(F.col("conv_id").alias("base"), F.col("k").alias("pos"), "digest", "words")
    heads = convs.join(heads, "base").where("pos < h").select("conv_id", "pos", "digest", "words")
    # the shift is the same for all turns of a conversation; a long one's turns are not dealt by it
    pieces = convs.select("conv_id", "h", "lent", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length + h) div {CHUNK}"))).alias("chunk"))
    tails = turns.withColumn("chunk", F.expr(f"k div {CHUNK}")).join(pieces, ["conv_id", "chunk"]).where("k >= h")
    tails = tails.select("conv_id", (F.col("k") - F.col("h") + F.col("lent")).alias("pos"), "digest", "words")
    return convs.select("conv_id", "length"), written(heads.unionByName(tails), "rebuilt")


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, x, y, words: the 128-bit digest of the first `depth` turns, and the words of the last of these.

    A digest is the exclusive or of hashes of each turn with its place, so it is taken within chunks, then over chunks."""
    rows = turns.withColumn("chunk", F.expr(f"pos div {CHUNK}")).withColumns({"x": F.xxhash64("pos", "digest"), "y": F.xxhash64("digest", "pos")})
    so_far = Window.partitionBy("conv_id", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = rows.groupBy("conv_id", "chunk").agg(*(F.bit_xor(c).alias(c) for c in "xy"))
    chunks = chunks.select("conv_id", "chunk", *(F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(f"{c}_before") for c in "xy"))
    rows = rows.withColumns({c: F.bit_xor(c).over(so_far) for c in "xy"}).join(chunks, ["conv_id", "chunk"])
    return rows.select("conv_id", (F.col("pos") + 1).alias("depth"), *(F.col(c).bitwiseXOR(F.col(f"{c}_before")).alias(c) for c in "xy"), "words")


def owned_from(convs: DataFrame, every: DataFrame, minima: DataFrame, n_every: int) -> DataFrame:
    """conv_id, length, first (the least depth at which the conversation is the least with its prefix; length + 1 if there is none), up (the owner one turn above; null above the root).

    Who owns a prefix owns its own longer ones, so each conversation halves its range of depths in each round, all of them in one join."""
    state = convs.select("conv_id", "length", F.lit(-1).cast("long").alias("low"), (F.col("length") + 1).alias("high"), F.lit(None).cast("long").alias("up"))
    state, n_open = counted(state, "search")
    done = state.where("high - low <= 1")
    while n_open:
        asked = state.where("high - low > 1").withColumn("depth", F.expr("(low + high) div 2"))
        probes = written(asked.join(every.select("conv_id", "depth", "x", "y"), ["conv_id", "depth"]), "probes")
        said = joined(probes, minima.select("depth", "x", "y", "owner", "n"), ["depth", "x", "y"], "n", n_every)
        owned = F.col("owner") == F.col("conv_id")
        pick = lambda yes, no: F.when(owned, F.col(yes)).otherwise(F.col(no))
        step = written(said.select("conv_id", "length", pick("low", "depth").alias("low"), pick("depth", "high").alias("high"), pick("up", "owner").alias("up")), "search")
        done = done.unionByName(step.where("high - low <= 1"))
        state, n_open = step, step.where("high - low > 1").count()
        dropped(probes)
    return written(done.select("conv_id", "length", F.col("high").alias("first"), "up"), "chains")


def subtree_totals(chains: DataFrame) -> DataFrame:
    """conv_id, leaves, saved of the chains (conv_id, up, leaves, saved), each with all chains below it.

    Each round adds the sums of the chains twice as far below as the round before, so that a row of nested chains takes a number of rounds by the logarithm of its height."""
    below, n = counted(chains.withColumnRenamed("up", "jump"), "totals")
    while not below.where("jump IS NOT NULL").isEmpty():
        under = below.where("jump IS NOT NULL").groupBy(F.col("jump").alias("conv_id")).agg(F.sum("leaves").alias("more"), F.sum("saved").alias("else"), F.count(F.lit(1)).alias("n"))
        all_of = below.join(under, "conv_id", "left").withColumns({"leaves": F.col("leaves") + F.coalesce("more", F.lit(0)), "saved": F.col("saved") + F.coalesce("else", F.lit(0))})
        all_of = written(all_of.drop("more", "else"), "totals")
        tops = all_of.where("n IS NOT NULL").select(F.col("conv_id").alias("jump"), F.col("jump").alias("next"), "n")
        rows = all_of.drop("n")
        stepped = joined(rows.where("jump IS NOT NULL"), tops, "jump", "n", n).select("conv_id", "leaves", "saved", F.col("next").alias("jump"))
        old, below = below, written(stepped.unionByName(rows.where("jump IS NULL").select("conv_id", "leaves", "saved", "jump")), "totals")
        dropped(old, all_of)
    return below.drop("jump")


def hashed(ends: DataFrame) -> DataFrame:
    """conv_id, depth, ends_sha256: the SHA-256 of the comma-joined ids (member) of each node, ascending.

    Ids are joined in ranges of 2 ** ID_BITS first; the ranges' strings of a node then pass one after the other through the hash, so no list of ids is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            found = []
            for node, ids in zip(zip(batch["conv_id"].to_pylist(), batch["depth"].to_pylist(), strict=True), batch["ids"].to_pylist(), strict=True):
                if node == at:
                    state.update(b"," + ids.encode())
                    continue
                if at:
                    found.append((*at, state.hexdigest()))
                at, state = node, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(("conv_id", "depth", "ends_sha256"), r, strict=True)) for r in found], SCHEMA)
        if at:
            yield pa.RecordBatch.from_pylist([{"conv_id": at[0], "depth": at[1], "ends_sha256": state.hexdigest()}], SCHEMA)

    joint = F.array_join(F.transform(F.array_sort(F.collect_list("member")), lambda i: i.cast("string")), ",")
    parts = ends.groupBy("conv_id", "depth", F.shiftright("member", ID_BITS).alias("part")).agg(joint.alias("ids"))
    parts = parts.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "part").select("conv_id", "depth", "ids")
    return parts.mapInArrow(run, "conv_id long, depth long, ends_sha256 string")


SCHEMA = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])


def sums_below(nodes: DataFrame, *columns: str) -> DataFrame:
    """nodes with each column summed over the chain's node and all deeper ones."""
    rows = nodes.withColumn("chunk", F.expr(f"depth div {CHUNK}"))
    deeper = Window.partitionBy("conv_id", "chunk").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    beyond = Window.partitionBy("conv_id").orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    chunks = rows.groupBy("conv_id", "chunk").agg(*(F.sum(c).alias(c) for c in columns))
    chunks = chunks.select("conv_id", "chunk", *(F.coalesce(F.sum(c).over(beyond), F.lit(0)).alias(f"{c}_beyond") for c in columns))
    rows = rows.withColumns({c: F.sum(c).over(deeper) for c in columns}).join(chunks, ["conv_id", "chunk"])
    return rows.withColumns({c: F.col(c) + F.col(f"{c}_beyond") for c in columns})


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """The trie of the conversations' turns: one row per distinct prefix, named by its least conversation (conv_id) and its depth.

    convs: conv_id (unique), length. turns: conv_id, pos (0 to length - 1), digest (equal for equal turns), words. Returns also parent_conv_id (null at
    the root), n_convs, n_children, n_leaves and saved_tokens of the subtree, and ends_sha256 of the conversations that end there. A
    conversation owns the prefixes of which it is the least member; these are one chain, from its first owned depth to its end, that
    hangs from another chain. Without conversations there is no node.
    """
    shipped(convs.sparkSession)
    root = convs.select("conv_id", *(F.lit(0).cast("long").alias(c) for c in ("depth", "x", "y", "words")))
    every, n_every = counted(prefixes(turns).unionByName(root), "prefixes")
    minima = written(every.groupBy("depth", "x", "y").agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n"), F.max("words").alias("words")), "minima")
    found = owned_from(convs, every, minima, n_every)
    chains = found.where("first <= length")
    own = minima.select(F.col("owner").alias("conv_id"), "depth", F.col("n").alias("n_convs"), ((F.col("n") - 1) * F.col("words")).alias("saved"))
    hung = chains.where("up IS NOT NULL").groupBy(F.col("up").alias("conv_id"), (F.col("first") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("hung"))
    last = chains.select("conv_id", F.col("length").alias("depth"), F.lit(True).alias("last")).join(hung, ["conv_id", "depth"], "left")
    last = written(last.select("conv_id", "depth", "last", F.coalesce("hung", F.lit(0)).alias("hung")), "last")
    each = chains.join(own.groupBy("conv_id").agg(F.sum("saved").alias("saved")), "conv_id").join(last.select("conv_id", F.when(F.col("hung") == 0, 1).otherwise(0).cast("long").alias("leaves")), "conv_id")
    totals = subtree_totals(each.select("conv_id", "up", "leaves", "saved"))
    below = chains.where("up IS NOT NULL").join(totals, "conv_id").groupBy(F.col("up").alias("conv_id"), (F.col("first") - 1).alias("depth"))
    below = below.agg(F.count(F.lit(1)).alias("hung"), F.sum("leaves").alias("leaves_hung"), F.sum("saved").alias("saved_hung"))
    tops = chains.select("conv_id", F.col("first").alias("depth"), F.col("up").alias("over"), F.lit(True).alias("top"))
    nodes = own.join(tops, ["conv_id", "depth"], "left").join(last.drop("hung"), ["conv_id", "depth"], "left").join(below, ["conv_id", "depth"], "left")
    none = F.lit(0).cast("long")
    hangs = F.coalesce("hung", none)
    nodes = nodes.select(
        "conv_id", "depth", F.when(F.col("top"), F.col("over")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        (hangs + F.when(F.col("last"), 0).otherwise(1)).alias("n_children"),
        (F.coalesce("leaves_hung", none) + F.when(F.col("last") & (hangs == 0), 1).otherwise(0)).alias("n_leaves"),
        (F.col("saved") + F.coalesce("saved_hung", none)).alias("saved_tokens"),
    )
    ends = found.select(F.when(F.col("first") <= F.col("length"), F.col("conv_id")).otherwise(F.col("up")).alias("conv_id"), F.col("length").alias("depth"), F.col("conv_id").alias("member"))
    nodes = sums_below(written(nodes, "nodes"), "n_leaves", "saved_tokens").join(hashed(ends), ["conv_id", "depth"], "left")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations. Null role or text is empty, a null turn comes first, rows without conv_id take no part."""
    return prefix_trie(*rebuilt(conversations))
