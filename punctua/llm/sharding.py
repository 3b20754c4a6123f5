"""Operator 1, sharding: proportional stratified interleaving."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctua.llm.common import never_null, ranked, unit, written

N_SHARDS = 24
#: Rows of one rank bucket, the most that must meet in a task.
BUCKET_ROWS = 64
SALTS = 64


def interleave(rows: DataFrame, id_col: str, source_col: str, n_shards: int, seed: str = "interleave", ties: tuple[str, ...] = ()) -> DataFrame:
    """rows with `shard` (0 to n_shards - 1) and `slot` (gapless from 0 in each shard).

    Rows are shuffled by a seeded digest of their id and ranked within their source; the fractional rank (rank + offset) / size, with
    an offset in [0, 1) drawn from the source, orders all rows; equal cuts of that order are the shards. So row counts differ by at
    most one, and each shard holds each source in the proportion of the whole, within one row or so.

    Null sources are one stratum; null ids share a digest; equal ids are ordered by `ties`; an empty table gives an empty table.
    rows may hold further columns, which stay.
    """
    n = rows.count()
    digest = F.md5(F.concat_ws("|", F.lit(seed), never_null(F.col(id_col))))
    rows = rows.withColumn("__source", never_null(F.col(source_col))).withColumn("__digest", digest)
    # sources' sizes, a row for each salt, so that a hot source meets its size in many tasks where the table is too large to broadcast
    sizes = written(rows.groupBy("__source").agg(F.count(F.lit(1)).alias("__size")), "shard-sizes")
    sizes = sizes.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    order = [F.col("__digest"), *(F.col(c) for c in ties)]
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64("__digest"), F.lit(SALTS)).cast("int")).join(sizes, ["__source", "__salt"]).drop("__salt").withColumn("__b1", F.floor(unit(F.col("__digest")) * F.ceil(F.col("__size") / BUCKET_ROWS)))
    chunk = max(1, math.isqrt(n // BUCKET_ROWS))
    rows = ranked(rows, ["__source"], "__b1", order, "__rank", chunk)
    offset = unit(F.md5(F.concat_ws("|", F.lit(f"{seed} offset"), F.col("__source"))))
    buckets = max(1, -(-n // BUCKET_ROWS))
    rows = rows.withColumn("__frac", (F.col("__rank") + offset) / F.col("__size"))
    rows = written(rows.withColumn("__b2", F.least(F.floor(F.col("__frac") * buckets), F.lit(buckets - 1))), "interleave")
    rows = ranked(rows, [], "__b2", [F.col("__frac"), F.col("__source"), *order], "__at", chunk)
    shard = F.expr(f"__at * {n_shards} div {max(n, 1)}")
    rows = rows.withColumn("shard", shard.cast("int"))
    rows = rows.withColumn("slot", F.col("__at") - F.expr(f"(shard * {n}L + {n_shards - 1}) div {n_shards}"))
    return rows.drop("__source", "__digest", "__size", "__b1", "__rank", "__frac", "__b2", "__at")


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law (`rows`), shard, slot, grown_shard (null under this law), source.

    Texts are reduced to their size and checksum in the scan and never shuffled. Null text counts as empty (size 8, checksum 0).
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", "source", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = interleave(written(slim, "shard-input"), "doc_id", "source", n_shards, ties=("size", "text_crc32"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
