"""Histories of closed dates: several daily metrics of an entity side by side, of which some may be pooled over a range and some hold for their day alone."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctua.functions import kernel as K

DATE = "provider_local_date"
#: Fixed value: days that histories are kept.
RETAINED_DAYS = 730


@dataclass(frozen=True)
class Metric:
    """Rows of key and date with additive values, and values of the day alone, which are never pooled. Rows of one key and date are summed; a day's values stand in one row."""

    name: str
    rows: DataFrame
    additive: tuple[str, ...] = ()
    daily_only: tuple[str, ...] = ()


def retained(rows: DataFrame, today: Column, days: int = RETAINED_DAYS) -> DataFrame:
    """Closed dates of the last so many days: today is open and older partitions are not read."""
    return rows.where((F.col(DATE) >= F.date_sub(today, days)) & (F.col(DATE) < today))


def daily(metric: Metric, key: Sequence[str], today: Column, days: int) -> DataFrame:
    rows = retained(metric.rows, today, days).where(F.col(key[-1]).isNotNull() & (F.col(key[-1]) != ""))
    return rows.groupBy(*key, DATE).agg(*(F.sum(v).alias(v) for v in metric.additive), *(F.max(v).alias(v) for v in metric.daily_only), F.lit(True).alias(f"has_{metric.name}"))


def range_history(metrics: Sequence[Metric], key: Sequence[str], today: Column, days: int = RETAINED_DAYS) -> DataFrame:
    """One row a key and retained date on which any metric has data, with its month, the unit of publication; has_<metric> tells absence from zero."""
    rows = reduce(lambda a, b: a.join(b, [*key, DATE], "full"), (daily(m, key, today, days) for m in metrics))
    flags = {f"has_{m.name}": F.coalesce(f"has_{m.name}", F.lit(False)) for m in metrics}
    return rows.withColumns(flags).withColumn("month", F.date_format(DATE, "yyyy-MM"))


def metric_coverage(metrics: Sequence[Metric], history: DataFrame, key: Sequence[str]) -> DataFrame:
    """key, metric, mode (additive or daily_only), first and last date with data, number of such dates. Metrics without a date have no row."""
    said = F.array_compact(F.array(*(F.when(F.col(f"has_{m.name}"), F.struct(F.lit(m.name).alias("metric"), F.lit("additive" if m.additive else "daily_only").alias("mode"))) for m in metrics)))
    rows = history.select(*key, DATE, F.explode(said).alias("m"))
    return rows.groupBy(*key, "m.metric", "m.mode").agg(F.min(DATE).alias("first_date"), F.max(DATE).alias("last_date"), F.count(F.lit(1)).alias("day_count"))


def pooled(metrics: Sequence[Metric], history: DataFrame, key: Sequence[str], first: Column, last: Column) -> DataFrame:
    """A range as one row a key: additive values summed, and values of the day alone where the range is that day, else null: a mean of medians is no median."""
    rows = history.where(F.col(DATE).between(first, last))
    one_day = first == last
    sums = [F.sum(v).alias(v) for m in metrics for v in m.additive]
    alone = [F.when(one_day, F.max(v)).alias(v) for m in metrics for v in m.daily_only]
    return rows.groupBy(*key).agg(F.count_distinct(DATE).alias("day_count"), *sums, *alone)


def stop_metrics(stop_spine: DataFrame, percentiles: DataFrame, occupancy: DataFrame) -> list[Metric]:
    """The metrics of a stop: delays, their percentiles of the day, and occupancy bands."""
    bands = tuple(c for c in occupancy.columns if c.endswith("_count") and c != "observation_count")
    return [
        Metric("delay", stop_spine, ("observation_count", "severe_delay_count", "sum_delay_seconds")),
        Metric("delay_percentiles", percentiles, daily_only=("p50_delay_seconds", "p90_delay_seconds")),
        Metric("occupancy", occupancy.withColumnRenamed("observation_count", "occupancy_count"), ("occupancy_count", *bands)),
    ]


def rated(pooled_rows: DataFrame) -> DataFrame:
    """Pooled delays with their severe share and mean in minutes."""
    n, bad = F.col("observation_count"), F.col("severe_delay_count")
    return pooled_rows.withColumns({"severe_pct": K.severe_pct(n, bad), "avg_delay_min": K.minutes(K.ratio(F.col("sum_delay_seconds"), n))})
