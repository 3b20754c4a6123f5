"""Operator 5, document fingerprints: invertible Bloom lookup sketches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctua.llm.common import written

#: A paragraph is a line; longer lines are cut into paragraphs of so many characters.
PARAGRAPH = 256
#: Cells of one of the three tables of the base sketch.
TABLE = 16
TABLES = 3
#: Passes of peeling over the tables before a sketch counts as stuck.
PASSES = 4
#: Sketches of a pair, each larger than the last, before its sets are compared outright.
ATTEMPTS = 6
#: Rows of a range of ids, the documents that meet in a task; ranges at the first level.
RANGE_ROWS, MOST_RANGES = 256, 4096
#: Paragraph digests of a peeling task.
DIGESTS_A_TASK = 500_000


def paragraphs(text: Column) -> Column:
    """The distinct digests of a text's paragraphs, ascending."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(rf"[^\n]{{1,{PARAGRAPH}}}"), F.lit(0)), lambda p: F.xxhash64(p))))


def check_of(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit("check")).bitwiseAND(F.lit(0xFFFFFFFF))


def cell_of(digest: Column, table: int, cells: Column, seed: Column) -> Column:
    """The digest's cell in one of the tables."""
    return F.lit(table) * cells + F.pmod(F.xxhash64(digest, F.lit(table), seed), cells)


def fingerprint(digests: Column) -> Column:
    """The base sketch as text: for each cell count, sum and check sum (sums by exclusive or) in hexadecimal; empty cells are empty."""
    cells, seed = F.lit(TABLE).cast("long"), F.lit(0)
    entries = F.transform(digests, lambda x: F.struct(x.alias("x"), check_of(x).alias("k"), *(cell_of(x, t, cells, seed).alias(f"c{t}") for t in range(TABLES))))
    nothing = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("k"))

    def cell(table: int):
        def said(i: Column, s: Column) -> Column:
            mine = F.filter(s, lambda e: e[f"c{table}"] == F.lit(table * TABLE) + i)
            total = F.aggregate(mine, nothing, lambda a, e: F.struct((a["n"] + 1).alias("n"), a["x"].bitwiseXOR(e["x"]).alias("x"), a["k"].bitwiseXOR(e["k"]).alias("k")))
            spelled = lambda a: F.when(a["n"] == 0, F.lit("")).otherwise(F.concat_ws(":", F.lower(F.hex(a["n"])), F.lower(F.hex(a["x"])), F.lower(F.hex(a["k"]))))
            return F.element_at(F.transform(F.array(total), spelled), 1)

        return said

    # the entries are bound once, as the element of a one-row array
    def spelled(s: Column) -> Column:
        def row(table: int):
            at = cell(table)
            return F.transform(F.sequence(F.lit(0), F.lit(TABLE - 1)), lambda i: at(i, s))

        return F.array_join(F.concat(*(row(t) for t in range(TABLES))), ".")

    return F.concat(F.lit(f"{TABLES}x{TABLE}|"), F.element_at(F.transform(F.array(entries), spelled), 1))


def in_ranges(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) with range: a long that ascends with (doc_id, digest of the text), null ids first; a range holds a few hundred rows.

    Equal-width bins of ids, at most MOST_RANGES, are split further by their counts, so clustered ids spread too."""
    low, high, n = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    low, high = low or 0, high or 0
    bins = max(1, min(MOST_RANGES, n // RANGE_ROWS))
    spot = (F.col("doc_id").cast("double") - F.lit(float(low))) / F.lit(float(high) - float(low) + 1) * bins
    own = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.least(F.floor(spot), F.lit(bins - 1)))
    inside = F.when(F.col("doc_id").isNull(), F.shiftrightunsigned(F.col("__h") - F.lit(-(1 << 63)), 1) / F.lit(float(1 << 63))).otherwise(spot - F.floor(spot))
    docs = docs.withColumn("__bin", own.cast("long"))
    counts = written(docs.groupBy("__bin").agg(F.count(F.lit(1)).alias("__n")), "bins")
    docs = docs.join(F.broadcast(counts), "__bin")  # MOST_RANGES + 1 rows at most
    parts = F.ceil(F.col("__n") / RANGE_ROWS)
    sub = F.least(F.floor(inside * parts), parts - 1)
    return docs.withColumn("range", F.shiftleft(F.col("__bin"), 32) + F.greatest(sub, F.lit(0))).drop("__bin", "__n")


def with_next(docs: DataFrame, carried: list[str]) -> DataFrame:
    """docs (doc_id, text, carried) with range, row (together a key), and next_<c> of the next document by doc_id for text and the carried columns.

    Ties of an id are ordered by a digest of the text. The first row of each range is also sent to the range before (that of all to
    the last), so that a window within ranges sees each row's successor; the texts are shuffled once.
    """
    docs = in_ranges(docs.withColumn("__h", F.xxhash64("text")))
    firsts = docs.groupBy("range").agg(F.min(F.struct("doc_id", "__h")).alias("f")).withColumn("bin", F.shiftright("range", 32))
    firsts = written(firsts, "ranges")
    ends = firsts.groupBy("bin").agg(F.max("range").alias("end"))
    around = Window.orderBy("bin")  # MOST_RANGES + 1 rows at most
    ends = ends.withColumn("before", F.coalesce(F.lag("end").over(around), F.max("end").over(Window.partitionBy(F.lit(0)))))
    before = F.lag("range").over(Window.partitionBy("bin").orderBy("range"))
    sent = firsts.withColumn("in_bin", before).join(ends.select("bin", "before"), "bin")
    sent = written(sent.select(F.col("f.doc_id").alias("__id"), F.col("f.__h").alias("__hash"), F.coalesce("in_bin", "before").alias("__to")), "ranges")
    docs = docs.join(sent, docs["doc_id"].eqNullSafe(sent["__id"]) & (docs["__h"] == sent["__hash"]), "left").drop("__id", "__hash")
    here = F.struct(F.col("range").alias("range"), F.lit(0).alias("sent"))
    both = F.array(here, F.struct(F.col("__to").alias("range"), F.lit(1).alias("sent")))
    docs = docs.withColumn("__at", F.explode(F.when(F.col("__to").isNull(), F.array(here)).otherwise(both)))
    docs = docs.withColumn("range", F.col("__at.range")).withColumn("__sent", F.col("__at.sent")).drop("__at", "__to")
    order = Window.partitionBy("range").orderBy("__sent", "doc_id", "__h")
    docs = docs.withColumn("row", F.row_number().over(order))
    for c in ("text", *carried):
        docs = docs.withColumn(f"next_{c}", F.lead(c).over(order))
    return docs.where("__sent = 0").drop("__sent", "__h")


def differences(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, side (1: of a only, -1: of b only), digest: what the digest sets a and b of each pair do not share, from their sketches.

    Needs keys (not named cell, n, x, k or found), a, b (arrays of longs), cells (of one table) and seed. Cells of a less cells of b: what both hold cancels. Peeling
    goes over the tables in turn: a cell of count 1 or -1 whose check fits holds one digest, which then leaves its other cells. A
    digest stands in one cell of a table, so no pass recovers it twice. A pair that is not empty after PASSES keeps rows with a null
    side. All passes keep the partitioning by keys, so nothing is shuffled after the first exchange.
    """
    by = [*keys, "cells", "seed"]
    value = lambda x, n, t: F.struct(cell_of(x, t, F.col("cells"), F.col("seed")).alias("cell"), F.lit(n).cast("long").alias("n"), x.alias("x"), check_of(x).alias("k"))
    each = lambda c, n: F.flatten(F.transform(c, lambda x: F.array(*(value(x, n, t) for t in range(TABLES)))))
    rows = pairs.select(*by, F.explode(F.concat(each(F.col("a"), 1), each(F.col("b"), -1))).alias("e")).select(*by, "e.cell", "e.n", "e.x", "e.k", F.lit(0).cast("long").alias("found"))

    def summed(rows: DataFrame) -> DataFrame:
        """One row a cell; found rows (cell -1) stay apart by their digest; empty cells go."""
        totals = rows.groupBy(*by, "cell", "found").agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("k").alias("k"))
        return totals.where("n <> 0 or x <> 0 or k <> 0")

    rows = summed(rows)
    for table in [t for _ in range(PASSES) for t in range(TABLES)]:
        mine = F.floor(F.col("cell") / F.col("cells")) == table
        pure = (F.col("cell") >= 0) & mine & (F.abs("n") == 1) & (F.col("k") == check_of(F.col("x")))
        entry = lambda cell, n, found: F.struct(cell.alias("cell"), n.alias("n"), F.col("x"), F.col("k"), found.alias("found"))
        zero = F.lit(0).cast("long")
        leave = [entry(cell_of(F.col("x"), t, F.col("cells"), F.col("seed")), -F.col("n"), zero) for t in range(TABLES) if t != table]
        peeled = F.array(*leave, entry(F.lit(-1).cast("long"), F.col("n"), F.col("x")))
        same = F.array(entry(F.col("cell"), F.col("n"), F.col("found")))
        rows = summed(rows.select(*by, F.explode(F.when(pure, peeled).otherwise(same)).alias("e")).select(*by, "e.*"))
    found = F.col("cell") == -1
    return rows.select(*keys, F.when(found, F.col("n").cast("int")).alias("side"), F.when(found, F.col("x")).alias("digest"))


def likeness(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, near: of each pair's digest sets the share of the union that both hold, from the recovered difference; 1 for two empty sets.

    The first sketch is the fingerprint's. Pairs on which it is stuck are sketched again, larger by the sets' sizes and then doubling,
    with fresh cells; what ATTEMPTS sketches leave is compared outright.
    """
    sizes = [F.size("a").alias("n_a"), F.size("b").alias("n_b")]
    pairs = pairs.withColumn("cells", F.lit(TABLE).cast("long")).withColumn("seed", F.lit(0))
    done = []
    for attempt in range(ATTEMPTS + 1):
        n = pairs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("a") + F.size("b")), F.lit(0))).first()
        if not n[0]:
            break
        if attempt == ATTEMPTS:
            shared = F.size(F.array_intersect("a", "b"))
            done.append(pairs.select(*keys, *sizes, (F.size("a") + F.size("b") - 2 * shared).cast("long").alias("d")))
            break
        spread = pairs.repartition(max(1, -(-n[1] // DIGESTS_A_TASK)), *keys)
        got = differences(spread, keys).groupBy(*keys).agg(F.count("side").alias("d"), F.count_if(F.col("side").isNull()).alias("stuck"))
        # sets without any difference leave no row
        merged = written(pairs.join(got, keys, "left").withColumn("d", F.coalesce("d", F.lit(0).cast("long"))), "peeled")
        done.append(merged.where(F.coalesce("stuck", F.lit(0)) == 0).select(*keys, *sizes, "d"))
        larger = F.ceil((F.size("a") + F.size("b")) * (1.5 * 2**attempt / TABLES)) + TABLE
        pairs = merged.where("stuck > 0").select(*keys, "a", "b", larger.cast("long").alias("cells"), F.lit(attempt + 1).alias("seed"))
    if not done:
        return pairs.select(*keys, F.lit(1.0).alias("near"))
    every = reduce(DataFrame.union, done)
    union = F.col("n_a") + F.col("n_b") + F.col("d")
    return every.select(*keys, F.when(union == 0, F.lit(1.0)).otherwise((F.col("n_a") + F.col("n_b") - F.col("d")) / union).alias("near"))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text's second half comes from the next document by doc_id (after the last: the first; of one document: itself). Null
    text is empty; rows of equal id follow each other by a digest of their texts; null ids come first; an empty table stays empty.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = with_next(rows.withColumn("own", paragraphs(F.col("text"))), ["own"])
    n_chars = F.length("text")
    half = F.floor(n_chars / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n_chars - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("range", "row", "doc_id", n_chars.cast("long").alias("n_chars"), edited.alias("edited"), "own", F.col("next_own").alias("next"))
    rows = written(rows.select("range", "row", "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), "own", paragraphs(F.col("edited")).alias("changed"), "next"), "versions")
    pair = F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("changed").alias("b")), F.struct(F.lit(1).alias("which"), F.col("next").alias("b"))))
    pairs = rows.select("range", "row", F.col("own").alias("a"), pair.alias("p")).select("range", "row", "p.which", "a", "p.b")
    near = likeness(pairs, ["range", "row", "which"])
    both = near.groupBy("range", "row").agg(F.max(F.when(F.col("which") == 0, F.col("near"))).alias("near_edited"), F.max(F.when(F.col("which") == 1, F.col("near"))).alias("near_next"))
    out = rows.join(both, ["range", "row"])
    return out.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("changed")).alias("edited_fingerprint"), "near_edited", "near_next")
