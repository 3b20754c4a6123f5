"""Closed-day builds on partitioned Parquet: missing periods, idempotent writes, rebuilds, retention, versioned captures."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from punctua.plans.commits import committed, ledger_of, newest, visible

DAY = "provider_local_date"


def missing_days(fact: DataFrame, built: DataFrame, kind: str, first: Column, today: Column) -> DataFrame:
    """Closed days (before today, from `first` on) with facts that no watermark row of the kind covers; the open day is never built.

    built: provider_id, kind, period_start."""
    days = fact.select("provider_id", F.col("snapshot_local_date").alias("period_start")).where((F.col("period_start") >= first) & (F.col("period_start") < today)).distinct()
    return days.join(built.where(F.col("kind") == kind).select("provider_id", "period_start"), ["provider_id", "period_start"], "left_anti")


def written_days(rows: DataFrame, path: str) -> None:
    """Rows into a table partitioned by day; the days at hand are replaced whole, others stay, so a repeated build changes nothing."""
    rows.withColumn("day", F.col(DAY)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


LEDGER = "provider_id string, kind string, period_start date, build string, committed_at timestamp"
PERIOD = ("provider_id", "period_start")


def watermarks_of(spark: SparkSession, watermarks: str, kind: str) -> DataFrame:
    """The built days of one rollup."""
    return ledger_of(spark, watermarks, LEDGER).where(F.col("kind") == kind)


def built_rows(spark: SparkSession, path: str, watermarks: str, kind: str) -> DataFrame:
    """A rollup's rows: of each day those of the build that its newest watermark names."""
    entries = watermarks_of(spark, watermarks, kind).withColumn("day", F.col("period_start"))
    return visible(spark, path, entries, ["provider_id", "day"]).drop("day")


def commit_days(rows: DataFrame, days: DataFrame, path: str, watermarks: str, kind: str) -> None:
    """Rows and watermarks of days (provider_id, period_start) in one commit."""
    entries = days.select("provider_id", F.lit(kind).alias("kind"), "period_start")
    committed(rows.withColumn("day", F.col(DAY)), path, entries, watermarks, by=["day"])


def build_days(spark: SparkSession, fact: DataFrame, path: str, watermarks: str, kind: str, build: Callable[[DataFrame], DataFrame], first: Column, today: Column, after: DataFrame | None = None) -> list:
    """Builds the missing closed days of one rollup in one job (facts are pruned to those days); gives the days. Data and watermark are one commit, so a failure neither repeats nor loses a day.

    after: provider_id, period_start of days that what the rollup reads has; other days wait."""
    missing = missing_days(fact, watermarks_of(spark, watermarks, kind), kind, first, today)
    if after is not None:
        missing = missing.join(after.select(*PERIOD), list(PERIOD), "left_semi")
    todo = missing.collect()  # a row a provider and day
    if todo:
        days = spark.createDataFrame(todo, "provider_id string, period_start date")
        near = fact.join(F.broadcast(days.withColumnRenamed("period_start", "snapshot_local_date")), ["provider_id", "snapshot_local_date"], "left_semi")
        commit_days(build(near), days, path, watermarks, kind)
    return sorted(r["period_start"] for r in todo)


@dataclass(frozen=True)
class Rollup:
    """A rollup of closed days. after: kinds it reads, whose days are built first; build takes the facts of the days, and the rows of those kinds in their order."""

    kind: str
    build: Callable[..., DataFrame]
    after: tuple[str, ...] = ()


def build_all(spark: SparkSession, fact: DataFrame, root: str, kinds: Sequence[Rollup], first: Column, today: Column) -> dict[str, list]:
    """Builds the missing closed days of all rollups, each after those that it reads, under root/<kind> with the watermarks of all in root/watermarks; gives the days by kind.

    A day of a rollup is built only where all that it reads have that day. Each kind commits by itself, so an interrupted run goes on where it stopped."""
    by_name, done = {k.kind: k for k in kinds}, {}
    for name in TopologicalSorter({k.kind: k.after for k in kinds}).static_order():
        rollup, marks = by_name[name], f"{root}/watermarks"
        ready = None
        for other in rollup.after:
            has = newest(watermarks_of(spark, marks, other), list(PERIOD)).select(*PERIOD)
            ready = has if ready is None else ready.join(has, list(PERIOD), "left_semi")

        def build(facts: DataFrame, rollup: Rollup = rollup, marks: str = marks) -> DataFrame:
            return rollup.build(facts, *(built_rows(spark, f"{root}/{k}", marks, k) for k in rollup.after))

        done[name] = build_days(spark, fact, f"{root}/{name}", marks, name, build, first, today, ready)
    return done


def rebuild_days(spark: SparkSession, fact: DataFrame, path: str, watermarks: str, kind: str, build: Callable[[DataFrame], DataFrame], first: Column, last: Column, before: int = 0, after: int = 0) -> None:
    """Builds a window of days anew from facts, with so many days of facts around it where a rollup needs them; late facts enter here. The old builds count until the commit, and dropped_builds() removes them."""
    near = fact.where(F.col("snapshot_local_date").between(F.date_sub(first, before), F.date_add(last, after)))
    days = fact.where(F.col("snapshot_local_date").between(first, last)).select("provider_id", F.col("snapshot_local_date").alias("period_start")).distinct()
    commit_days(build(near).where(F.col(DAY).between(first, last)), days, path, watermarks, kind)


def retained(rows: DataFrame, day: str, today: Column, days: int) -> DataFrame:
    """Rows of the last `days` dates."""
    return rows.where(F.col(day) >= F.date_sub(today, days))


def dropped_partitions(spark: SparkSession, path: str, today: Column, days: int) -> int:
    """Removes day partitions older than `days` from a table; gives their number."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    limit = spark.range(1).select(F.date_sub(today, days).cast("string")).first()[0]
    old = [s.getPath() for s in system.listStatus(folder) if s.getPath().getName().startswith("day=") and s.getPath().getName()[4:] < limit]
    for p in old:
        system.delete(p, True)
    return len(old)


def captured(ledger: DataFrame, captures: DataFrame) -> DataFrame:
    """The edition ledger after captures (provider_id, dataset_kind, checksum, captured_at_utc): an unchanged checksum touches last_seen, a new one closes the current edition and opens another."""
    key = ["provider_id", "dataset_kind"]
    newest = captures.groupBy(*key).agg(F.max_by("checksum", "captured_at_utc").alias("new_sum"), F.max("captured_at_utc").alias("seen_at"))
    rows = ledger.join(newest, key, "left")
    same = F.col("is_current") & (F.col("checksum") == F.col("new_sum"))
    changed = F.col("is_current") & F.col("new_sum").isNotNull() & (F.col("checksum") != F.col("new_sum"))
    kept = rows.select(*key, "dataset_version_id", "checksum", (F.col("is_current") & ~F.coalesce(changed, F.lit(False))).alias("is_current"), "loaded_at_utc", F.when(same, F.greatest("last_seen_utc", "seen_at")).otherwise(F.col("last_seen_utc")).alias("last_seen_utc"))
    current = ledger.where("is_current").select(*key, F.col("checksum").alias("had"))
    last = ledger.groupBy(*key).agg(F.max("dataset_version_id").alias("last_id"))
    fresh = newest.join(current, key, "left").join(last, key, "left").where(F.col("had").isNull() | (F.col("had") != F.col("new_sum")))
    opened = fresh.select(*key, (F.coalesce("last_id", F.lit(0)) + 1).alias("dataset_version_id"), F.col("new_sum").alias("checksum"), F.lit(True).alias("is_current"), F.col("seen_at").alias("loaded_at_utc"), F.col("seen_at").alias("last_seen_utc"))
    return kept.unionByName(opened)
