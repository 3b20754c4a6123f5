"""What clients compute from published histories: range pooling, significance of changes, search, date resolution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctua.constants import RATE_FLOOR, WILSON_Z
from punctua.functions import kernel as K
from punctua.operators.reads import DATE, pooled_stops, project, rated

#: Letters that fold to others without a mark.
PLAIN = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def range_pool(spine: DataFrame, first: Column, last: Column, key: Sequence[str]) -> DataFrame:
    """Exact pooling of a span of dates: rates from pooled sums, and whether all, some or none of the days have data."""
    rows = spine.where(F.col(DATE).between(first, last))
    days = rows.groupBy(*key).agg(F.count_distinct(DATE).alias("day_count"))
    wanted = F.date_diff(last, first) + 1
    every = spine.select(*key).distinct()
    out = every.join(rated(project(rows, list(key))), list(key), "left").join(days, list(key), "left")
    n = F.coalesce("day_count", F.lit(0))
    return out.withColumn("day_count", n).withColumn("state", F.when(n == 0, "no_data").when(n < wanted, "partial").otherwise("complete"))


def rate_change(windows: DataFrame) -> DataFrame:
    """windows (otp_pct, known_obs, on_time and prior_ twins) with the change in points and whether it is significant: both windows of enough observations, |z| at least 1.96."""
    z = K.two_proportion_z(F.col("on_time"), F.col("known_obs"), F.col("prior_on_time"), F.col("prior_known_obs"), RATE_FLOOR)
    change = F.col("otp_pct") - F.col("prior_otp_pct")
    return windows.withColumn("delta", change).withColumn("significant", F.coalesce((F.abs(z) >= WILSON_Z) & (change != 0), F.lit(False)))


#: Observations that each of two windows needs for a significant change of a mean.
MEAN_FLOOR = 7


def mean_change(windows: DataFrame, digits: int = 1) -> DataFrame:
    """windows (value, n, cov and prior_value, prior_n) with the change of a mean and whether it is significant. The variation gives the spread of both windows, around the average of their means."""
    v, n, w, m = (F.col(c).cast("double") for c in ("value", "n", "prior_value", "prior_n"))
    spread = (F.abs(v) + F.abs(w)) / 2.0 * F.col("cov") * F.sqrt(1.0 / n + 1.0 / m)
    change = K.half_away(v - w, digits)
    clear = (F.col("cov") > 0) & (n >= MEAN_FLOOR) & (m >= MEAN_FLOOR) & (spread > 0) & (F.abs(v - w) >= WILSON_Z * spread) & (change != 0)
    return windows.withColumn("delta", change).withColumn("significant", F.coalesce(clear, F.lit(False)))


def stop_range(stop_spine: DataFrame, first: Column, last: Column) -> DataFrame:
    """Stops pooled over a span of dates; rates are withheld below the floor."""
    pooled = pooled_stops(stop_spine.where(F.col(DATE).between(first, last)), ["provider_id", "stop_id"])
    return pooled.withColumn("withheld", F.col("obs") < RATE_FLOOR).withColumn("otp_proxy_pct", F.when(F.col("obs") >= RATE_FLOOR, F.col("otp_proxy_pct")))


def folded(text: Column) -> Column:
    """Lower case without marks, separators as single spaces."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), *PLAIN)
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[-_/.,'’]+", " "), r"\s+", " "))


def search_tier(text: Column, query: str) -> Column:
    """0 equal, 1 starts with, 2 holds the query, 3 holds each of its words; NULL otherwise."""
    h, q = folded(text), folded(F.lit(query))
    words = F.forall(F.split(q, " "), lambda t: F.contains(h, t))
    return F.when((q == "") | (h == ""), None).when(h == q, 0).when(F.startswith(h, q), 1).when(F.contains(h, q), 2).when(words, 3)


def resolved_dates(available: DataFrame, asked: DataFrame, key: Sequence[str]) -> DataFrame:
    """For each asked date the nearest available one (the earlier of two), the one before, the one after, and whether a correction was needed.

    available holds few dates a key; asked: key, asked_date."""
    rows = asked.join(available, list(key), "left")
    d, a = F.col(DATE), F.col("asked_date")
    found = rows.groupBy(*key, "asked_date").agg(
        F.min_by(d, F.struct(F.abs(F.date_diff(d, a)), d)).alias("nearest"), F.max(F.when(d <= a, d)).alias("previous"), F.min(F.when(d >= a, d)).alias("next")
    )
    return found.withColumn("corrected", F.coalesce(F.col("nearest") != a, F.lit(True)))
