"""Operator 6, mixing sources to target weights: entropy balancing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctua.llm.common import WORD, never_null, ranked, small, unit, written

#: Weights of the sources in their order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: The mix's words as a share of all words.
SHARE = 1.5
#: Most copies of a document.
MOST = 2.0
TOLERANCE = 1e-7
BUCKET_ROWS = 64
#: Sources whose multipliers one task updates.
SOURCES_A_TASK = 20_000


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes (source_key, source_size; a row per source) with each source's target.

    Capped sources stand first in the order of size / weight, so one ordered pass finds the level at which no target is over
    `most` times its source's size. One row per source meets in a task here; sources are far fewer than documents.
    """
    by_name = Window.orderBy(F.col("source_key") == "-", "source_key")
    s = sizes.withColumn("__w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    cap = F.col("source_size") * F.lit(most)
    upto = Window.orderBy(cap / F.col("__w"), "source_key").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    s = s.withColumn("__budget", F.sum("source_size").over(everything) * F.lit(share))
    s = s.withColumn("__left", F.col("__budget") - F.coalesce(F.sum(cap).over(upto), F.lit(0.0)))
    s = s.withColumn("__rest", F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(upto), F.lit(0.0)))
    s = s.withColumn("__capped", F.col("__left") * F.col("__w") >= cap * F.col("__rest"))
    free = F.when(~F.col("__capped"), F.col("__w"))
    left = F.max("__budget").over(everything) - F.coalesce(F.sum(F.when(F.col("__capped"), cap)).over(everything), F.lit(0.0))
    return s.select("source_key", "source_size", F.when(F.col("__capped"), cap).otherwise(left * F.col("__w") / F.sum(free).over(everything)).alias("target"))


def tilted(cells: DataFrame, goals: DataFrame, most: float = MOST, rounds: int = 60) -> DataFrame:
    """goals with `tilt`: the multiplier of each source's token constraint.

    Among all rates r in [0, most] that meet a source's tokens, entropy balancing picks those closest to the even rate 1 in relative
    entropy: r = min(most, exp(tilt * size / mean size)). tilt solves the convex dual by Newton's method; every round sums the
    gradient and curvature of all cells (source, size, n) in one distributed aggregation. A bracket guards each step.
    """
    state = goals.withColumn("__mean", F.greatest(F.col("source_size") / F.greatest(F.col("n"), F.lit(1)), F.lit(1e-9)))
    done = (F.col("source_size") == 0) | (F.col("target") >= F.col("source_size") * most * (1 - 1e-12))
    state = state.withColumn("tilt", F.lit(0.0)).withColumn("__low", F.lit(-745.0)).withColumn("__high", F.lit(745.0)).withColumn("__done", done)
    parts = -(-(goals.count() or 1) // SOURCES_A_TASK)
    state = written(state.coalesce(parts), "mix-state")
    for _ in range(rounds):
        if state.where(~F.col("__done")).isEmpty():
            break
        x = F.col("size") / F.col("__mean")
        rate = F.exp(F.col("tilt") * x)
        free = rate < most
        sums = (
            cells.join(state.where(~F.col("__done")).select("source_key", "tilt", "__mean"), "source_key")
            .groupBy("source_key")
            .agg(F.sum(F.col("n") * F.col("size") * F.least(rate, F.lit(most))).alias("__got"), F.sum(F.when(free, F.col("n") * F.col("size") * x * rate).otherwise(0.0)).alias("__slope"))
        )
        gap = F.col("__got") - F.col("target")
        state = state.join(sums, "source_key", "left")
        state = state.withColumn("__low", F.when(gap < 0, F.col("tilt")).otherwise(F.col("__low"))).withColumn("__high", F.when(gap > 0, F.col("tilt")).otherwise(F.col("__high")))
        step = F.col("tilt") - gap / F.when(F.col("__slope") > 0, F.col("__slope"))
        inside = (step > F.col("__low")) & (step < F.col("__high"))
        now_done = F.col("__done") | (F.abs(gap) <= TOLERANCE * F.col("target")) | (F.col("__high") - F.col("__low") < 1e-12)
        moved = F.when(inside, step).otherwise((F.greatest(F.col("__low"), F.col("tilt") - 8) + F.least(F.col("__high"), F.col("tilt") + 8)) / 2)
        state = state.withColumn("tilt", F.when(now_done, F.col("tilt")).otherwise(moved)).withColumn("__done", now_done).drop("__got", "__slope")
        state = written(state.coalesce(parts), "mix-state")
    full = (F.col("source_size") > 0) & (F.col("target") >= F.col("source_size") * most * (1 - 1e-12))
    return state.withColumn("full", full)


def mix(rows: DataFrame, seed: str = "mix", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """rows (needs doc_id, source, size; further columns stay) with source_size, target, rate and copies (0 to most).

    Rates are rounded along each source in the order of size: copies are the steps of floor(cumulated rate + offset). So a source's
    taken words miss its target by at most the size of one document. Null sources are one source, the last; empty tables stay empty;
    rows of equal id get their own copies. Depends on the data and the seed only, so reruns agree.
    """
    rows = rows.withColumn("source_key", never_null(F.col("source")))
    cells = written(rows.groupBy("source_key", "size").agg(F.count(F.lit(1)).alias("n")), "mix-cells")
    n = cells.agg(F.sum("n")).first()[0] or 0
    sizes = cells.groupBy("source_key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n"))
    goals = targets(sizes, weights, share, most).join(sizes.select("source_key", "n"), "source_key")
    state = tilted(cells, goals, most).select("source_key", "source_size", "target", "tilt", "__mean", "full")
    rate = F.when(F.col("full"), F.lit(most)).otherwise(F.least(F.lit(most), F.exp(F.col("tilt") * F.col("size") / F.col("__mean"))))
    cells = cells.join(state, "source_key").withColumn("rate", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(rate))
    # the cumulated rate before each cell, by a prefix sum within chunks of sizes and then over chunks
    chunk = F.floor(F.sqrt(F.col("size").cast("double"))).cast("long")
    cells = cells.withColumn("__chunk", chunk).withColumn("__mass", F.col("rate") * F.col("n"))
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    tops = cells.groupBy("source_key", "__chunk").agg(F.sum("__mass").alias("__m"))
    tops = tops.select("source_key", "__chunk", before(Window.partitionBy("source_key").orderBy("__chunk"), "__m").alias("__top"))
    cells = cells.withColumn("__in", before(Window.partitionBy("source_key", "__chunk").orderBy("size"), "__mass"))
    cells = cells.join(tops, ["source_key", "__chunk"]).select("source_key", "size", "n", "rate", "source_size", "target", (F.col("__in") + F.col("__top")).alias("__sofar"))
    cells = written(cells, "mix-rates")
    # ranks of a cell's documents in the order of a seeded digest
    digest = F.md5(F.concat_ws("|", F.lit(seed), never_null(F.col("doc_id"))))
    rows = rows.withColumn("__digest", digest).join(cells, ["source_key", "size"])
    # written, so that the join may split a hot cell: what follows deals the rows out by finer keys
    rows = written(rows.withColumn("__b", F.floor(unit(F.col("__digest")) * F.ceil(F.col("n") / BUCKET_ROWS))), "mix-rows")
    rows = ranked(rows, ["source_key", "size"], "__b", [F.col("__digest")], "__rank", max(1, math.isqrt(n // BUCKET_ROWS)))
    offset = unit(F.md5(F.concat_ws("|", F.lit(f"{seed} offset"), F.col("source_key"))))
    at = lambda k: F.floor(F.col("__sofar") + F.col("rate") * (F.col("__rank") + k) + offset)
    copies = F.greatest(F.lit(0), F.least(F.lit(int(most)), at(1) - at(0)))
    return rows.withColumn("copies", copies.cast("long")).drop("source_key", "n", "__sofar", "__digest", "__b", "__rank")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """docs with each row as often as the mix takes it; columns stay. Rows are told apart by id, source and text; rows equal in all three share the most copies of them."""
    digest = F.xxhash64("text")
    chosen = mix(written(docs.select("doc_id", "source", words_of(F.col("text")).alias("size"), digest.alias("__of")), "mix-input"))
    copies = small(chosen.groupBy(F.col("doc_id").alias("__id"), F.col("source").alias("__from"), "__of").agg(F.max("copies").alias("__copies")), "mix-copies")
    same = docs["doc_id"].eqNullSafe(copies["__id"]) & docs["source"].eqNullSafe(copies["__from"]) & (digest == copies["__of"])
    taken = docs.join(copies, same).where("__copies > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*docs.columns)


def words_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def mix_documents(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (copies * size), copies, source. Null text has size 0."""
    slim = written(docs.select("doc_id", "source", words_of(F.col("text")).alias("size")), "mix-input")
    out = mix(slim)
    return out.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source")
