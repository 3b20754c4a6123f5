"""Snapshots as JSON: one payload a key, content hashes, a gate before publication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of published values and of changes between snapshots.
MOST_DELAY_MIN, MIX_ERROR, FILE_DROP, EMPTY_SHARE, ID_DRIFT = 90, 0.01, 0.30, 0.50, 0.05


def payloads(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One JSON list a key, its rows in order, with a hash of the content. A key's rows are a page, bounded by its grain."""
    values = [c for c in rows.columns if c not in key]
    ordered = F.sort_array(F.collect_list(F.struct(*order, *(c for c in values if c not in order))))
    found = rows.groupBy(*key).agg(F.to_json(ordered).alias("payload"), F.count(F.lit(1)).alias("row_count"))
    return found.withColumn("content_hash", F.sha2("payload", 256)).withColumn("byte_count", F.octet_length("payload"))


def changed(found: DataFrame, published: DataFrame, key: Sequence[str]) -> DataFrame:
    """Payloads whose content is not published yet."""
    return found.join(published.select(*key, "content_hash"), [*key, "content_hash"], "left_anti")


def pages(rows: DataFrame, key: Sequence[str], order: Sequence[Column], most_bytes: int) -> DataFrame:
    """rows with the page each falls on: pages of a key hold consecutive rows of most_bytes at most (a larger row has its own).

    A page begins where the bytes before a row pass a multiple of most_bytes less the largest row, so the last row still fits."""
    all_of, upto = Window.partitionBy(*key), Window.partitionBy(*key).orderBy(*order)
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    large = F.col("byte_count") > most_bytes
    none = lambda c: F.coalesce(c, F.lit(0))
    step = F.greatest(F.lit(1), most_bytes - none(F.max(F.when(~large, F.col("byte_count"))).over(all_of)))
    rows = rows.withColumns({"__alone": 2 * none(F.count_if(large).over(before)) + large.cast("int"), "__block": F.floor(none(F.sum(F.when(~large, F.col("byte_count"))).over(before)) / step)})
    rank = F.dense_rank().over(Window.partitionBy(*key).orderBy("__alone", "__block"))
    return rows.withColumn("page", (rank - 1).cast("int")).drop("__alone", "__block")


def generations(found: DataFrame, published: DataFrame, key: Sequence[str]) -> DataFrame:
    """Payloads (key, content_hash) with generation_id, which stays until the content changes, previous_generation_id (null of a new key) and state: new, changed, kept, or gone of a key that was published and is no more.

    published: key, content_hash. An id is made of the content, so a page that returns to an older content has its older id again."""
    name = lambda c: F.substring(c, 1, 16)
    rows = found.select(*key, "content_hash").join(published.select(*key, F.col("content_hash").alias("__old")), list(key), "full")
    state = F.when(F.col("content_hash").isNull(), "gone").when(F.col("__old").isNull(), "new").when(F.col("content_hash") == F.col("__old"), "kept").otherwise("changed")
    return rows.select(*key, name(F.col("content_hash")).alias("generation_id"), name(F.col("__old")).alias("previous_generation_id"), state.alias("state"))


def gate(rates: DataFrame, previous_files: int, files: int, previous_ids: DataFrame, id_col: str) -> DataFrame:
    """check, failures: what forbids publication. rates: id_col, avg_delay_min, otp_pct, severe_pct, known_obs and shares that sum to 1 where given."""
    bad = rates.agg(
        F.count_if(F.abs("avg_delay_min") > MOST_DELAY_MIN).alias("delay_bounds"), F.count_if(~F.col("otp_pct").between(0, 100)).alias("otp_bounds"), F.count_if((F.col("known_obs") == 0) & F.col("otp_pct").isNotNull()).alias("rate_without_evidence"),
        (F.count_if(F.coalesce("known_obs", F.lit(0)) == 0) > EMPTY_SHARE * F.count(F.lit(1))).cast("long").alias("empty_share"), F.lit(int(files < (1 - FILE_DROP) * previous_files)).cast("long").alias("file_drop"),
    )
    now = rates.select(id_col).distinct()
    gone = previous_ids.select(id_col).distinct().join(now, id_col, "left_anti").agg(F.count(F.lit(1)).alias("gone")).withColumn("k", F.lit(1))
    had = previous_ids.select(id_col).distinct().agg(F.count(F.lit(1)).alias("had")).withColumn("k", F.lit(1))
    drift = gone.join(had, "k").select((F.col("gone") > ID_DRIFT * F.col("had")).cast("long").alias("failures")).select(F.lit("id_drift").alias("check"), "failures")
    return bad.unpivot([], [c for c in bad.columns], "check", "failures").union(drift)


def mix_errors(rows: DataFrame, shares: Sequence[str]) -> DataFrame:
    """Rows whose shares (0 to 100) do not sum to all of them."""
    whole = sum((F.col(c) for c in shares[1:]), F.col(shares[0]))
    return rows.where(F.abs(whole - 100.0) > 100 * MIX_ERROR)
