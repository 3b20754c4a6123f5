"""Daily and hourly rollups of facts: pure functions from facts to additive tables, grouped by provider.

Facts arrive partitioned by snapshot_date_key; a closed day is a filter on it, and the grouping columns always hold the day, so
every shuffle carries partial sums only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctua.constants import BANDS, CANCELED, DELAY_EDGES, GAP_EDGES, MOST_GAP_MINUTES, UNKNOWN_STOP, UNROUTED
from punctua.functions import kernel as K



def local_day() -> Column:
    return F.col("snapshot_local_date").alias("provider_local_date")


def delay() -> Column:
    return F.col("delay_seconds")


def routed() -> Column:
    return F.coalesce(F.col("route_id"), F.lit(UNROUTED)).alias("route_id")


def trip_delay_summary_5m(fact: DataFrame) -> DataFrame:
    """Route x five minutes."""
    d = delay()
    capped = F.when(K.in_clamp(d), d)
    return fact.groupBy("provider_id", K.bucket_5m(F.col("captured_at_utc")).alias("period_start_utc"), routed()).agg(
        F.count_distinct("trip_id").alias("trip_count"),
        F.count(F.lit(1)).alias("observation_count"),
        F.count(d).alias("delay_observation_count"),
        K.count_if(K.on_time(d)).alias("on_time_observation_count"),
        K.ratio(F.sum(d), F.count(d)).alias("avg_delay_seconds"),
        K.ratio(F.sum(capped), F.count(capped)).alias("avg_delay_seconds_capped"),
        F.max(d).alias("max_delay_seconds"),
        F.max(capped).alias("max_delay_seconds_capped"),
        F.min(d).alias("min_delay_seconds"),
        F.count_distinct(F.when(d > 0, F.col("trip_id"))).alias("delayed_trip_count"),
        K.count_if(~K.in_clamp(d)).alias("outlier_count"),
        K.count_if(K.severe(d)).alias("severe_delay_observation_count"),
    )


def delay_percentiles_daily(fact: DataFrame, entity: str, name: str) -> DataFrame:
    """Exact median and ninth decile of in-clamp delays of an entity and day."""
    d = delay()
    rows = fact.where(F.col(entity).isNotNull() & K.in_clamp(d))
    return rows.groupBy("provider_id", local_day(), F.col(entity).alias(name)).agg(
        K.half_away(F.percentile(d, 0.5), 2).alias("p50_delay_seconds"),
        K.half_away(F.percentile(d, 0.9), 2).alias("p90_delay_seconds"),
        F.count(F.lit(1)).alias("delay_observation_count"),
    )


def route_cancellation_daily(fact: DataFrame, scheduled: DataFrame) -> DataFrame:
    """Route x service day: trip-days once each, captured on the day or the next; scheduled universe joined in full.

    scheduled: provider_id, provider_local_date, route_id, scheduled_trip_count. Unknown schedule gives NULL, a dark route a row."""
    seen = fact.where("route_id IS NOT NULL AND trip_id IS NOT NULL AND start_date IS NOT NULL")
    seen = seen.where(F.col("snapshot_local_date").between(F.col("start_date"), F.date_add("start_date", 1)))
    canceled = F.max((F.coalesce("trip_schedule_relationship", F.lit(0)) == CANCELED).cast("int"))
    trip_days = seen.groupBy("provider_id", "route_id", "trip_id", F.col("start_date").alias("provider_local_date")).agg(canceled.alias("was_canceled"))
    observed = trip_days.groupBy("provider_id", "provider_local_date", "route_id").agg(F.count(F.lit(1)).alias("total"), F.sum("was_canceled").alias("gone"))
    rows = observed.join(scheduled, ["provider_id", "provider_local_date", "route_id"], "full")
    total, gone = F.coalesce("total", F.lit(0)), F.coalesce("gone", F.lit(0))
    silent = F.when(F.col("scheduled_trip_count").isNotNull(), F.greatest(F.col("scheduled_trip_count") - total, F.lit(0)))
    return rows.select(
        "provider_id", "provider_local_date", "route_id", total.alias("total_trip_days"), gone.alias("canceled_trip_days"),
        K.half_away(K.ratio(100.0 * F.col("gone").cast("double"), F.col("total")), 2).alias("cancellation_rate_pct"),
        F.col("scheduled_trip_count").alias("scheduled_trip_days"), (total - gone).alias("delivered_trip_days"), silent.alias("silent_trip_days"),
    )


def occupancy_bands(fact: DataFrame, entity: Sequence[Column]) -> DataFrame:
    """Observations with a known band, by entity: five counts that sum to their number."""
    rows = fact.withColumn("__band", K.band(F.col("occupancy_status"))).where(F.col("__band").isNotNull())
    return rows.groupBy("provider_id", local_day(), *entity).agg(F.count(F.lit(1)).alias("observation_count"), *(K.count_if(F.col("__band") == b).alias(f"{b}_count") for b in BANDS))


def route_occupancy_band_daily(fact: DataFrame) -> DataFrame:
    return occupancy_bands(fact, [routed()])


def route_occupancy_band_hourly(fact: DataFrame) -> DataFrame:
    return occupancy_bands(fact, [routed(), F.col("local_hour").alias("hour_of_day_local")])


def stop_occupancy_band_daily(fact: DataFrame) -> DataFrame:
    return occupancy_bands(fact.where("delay_stop_id IS NOT NULL"), [F.col("delay_stop_id").alias("stop_id")])


def route_delay_by_crowding_daily(fact: DataFrame) -> DataFrame:
    """In-clamp delays by route and the band seen with each."""
    d = delay()
    rows = fact.withColumn("band", K.band(F.col("occupancy_status"))).where(F.col("band").isNotNull() & F.col("route_id").isNotNull() & K.in_clamp(d))
    return rows.groupBy("provider_id", local_day(), "route_id", "band").agg(F.count(F.lit(1)).alias("delay_observation_count"), F.sum(d).alias("sum_delay_seconds"), K.half_away(F.percentile(d, 0.5), 2).alias("p50_delay_seconds"))


def route_service_span_daily(fact: DataFrame) -> DataFrame:
    """Route x service day (built on the day after): first and last trip start, and the delays first and last seen of those trips."""
    rows = fact.where("route_id IS NOT NULL AND trip_id IS NOT NULL AND start_date IS NOT NULL")
    rows = rows.where(F.col("snapshot_local_date").between(F.col("start_date"), F.date_add("start_date", 1)))
    order = F.struct("captured_at_utc", "entity_index")
    starts = rows.groupBy("provider_id", "route_id", "trip_id", F.col("start_date").alias("provider_local_date")).agg(
        F.min("captured_at_utc").alias("start"), F.min_by("delay_seconds", order).alias("first_seen"), F.max_by("delay_seconds", order).alias("last_seen")
    )
    route_day = ["provider_id", "provider_local_date", "route_id"]
    w = Window.partitionBy(*route_day)
    last_first = F.col("first_seen").asc_nulls_last()
    starts = starts.withColumn("__a", F.row_number().over(w.orderBy("start", last_first))).withColumn("__z", F.row_number().over(w.orderBy(F.desc("start"), last_first)))
    span = F.timestamp_diff("MICROSECOND", F.min("start"), F.max("start"))
    return starts.groupBy(*route_day).agg(
        F.min("start").alias("first_trip_start_utc"),
        F.max("start").alias("last_trip_start_utc"),
        K.half_away(span / 60_000_000.0, 0).cast("int").alias("service_span_min"),
        F.max(F.when(F.col("__a") == 1, F.col("first_seen"))).alias("first_trip_delay_seconds"),
        F.max(F.when(F.col("__z") == 1, F.col("last_seen"))).alias("last_trip_delay_seconds"),
        F.count(F.lit(1)).alias("trip_count"),
    )


def route_skipped_stop_daily(fact: DataFrame) -> DataFrame:
    all_updates, skipped = F.sum("stop_time_update_count"), F.sum("skipped_stop_count")
    return fact.where("route_id IS NOT NULL").groupBy("provider_id", local_day(), "route_id").agg(
        all_updates.alias("stop_time_update_count"), skipped.alias("skipped_stop_count"), K.half_away(K.ratio(100.0 * skipped.cast("double"), all_updates), 2).alias("skipped_stop_rate_pct")
    )


def route_delay_spine(fact: DataFrame) -> DataFrame:
    """Route x local hour x direction. Delayed trips are the sum over five-minute bins of the distinct late trips, so two levels of grouping."""
    d = delay()
    grain = ["provider_id", "route_id", "provider_local_date", "hour_of_day_local", "direction_id"]
    rows = fact.where("route_id IS NOT NULL").select(
        "provider_id", "route_id", local_day(), F.col("local_hour").alias("hour_of_day_local"), F.coalesce("direction_id", F.lit(0)).alias("direction_id"),
        K.bucket_5m(F.col("captured_at_utc")).alias("bucket"), "trip_id", "delay_seconds",
    )
    inside = K.in_clamp(d)
    hist = K.bins(d, DELAY_EDGES, len(DELAY_EDGES), inside)
    fine = rows.groupBy(*grain, "bucket").agg(
        F.count(F.lit(1)).alias("obs"), F.count(d).alias("known"), K.count_if(K.on_time(d)).alias("good"), K.count_if(K.severe(d)).alias("bad"), F.sum(F.when(inside, d)).alias("sum"),
        *(h.alias(f"b{i}") for i, h in enumerate(hist)), F.count_distinct(F.when(d > 0, F.col("trip_id"))).alias("late"),
    )
    return fine.groupBy(*grain).agg(
        F.sum("obs").alias("observation_count"),
        F.sum("known").alias("delay_observation_count"),
        F.when(F.sum("known") > 0, F.sum("good")).alias("on_time_observation_count"),
        F.sum("bad").alias("severe_delay_count"),
        F.coalesce(F.sum("sum"), F.lit(0)).alias("sum_delay_seconds"),
        F.array(*(F.sum(f"b{i}") for i in range(len(DELAY_EDGES)))).alias("delay_histogram"),
        F.sum("late").alias("delayed_trip_count"),
    )


def delay_sums() -> list[Column]:
    d = delay()
    return [F.count(F.lit(1)).alias("observation_count"), K.count_if(K.severe(d)).alias("severe_delay_count"), F.coalesce(F.sum(d), F.lit(0)).alias("sum_delay_seconds")]


def stop_delay_spine(fact: DataFrame) -> DataFrame:
    rows = fact.where(F.col("delay_stop_id").isNotNull() & K.in_clamp(delay()))
    return rows.groupBy("provider_id", F.col("delay_stop_id").alias("stop_id"), routed(), local_day()).agg(*delay_sums())


def stop_delay_shift_daily(fact: DataFrame) -> DataFrame:
    rows = fact.where(F.col("delay_stop_id").isNotNull() & K.in_clamp(delay()))
    return rows.groupBy("provider_id", F.col("delay_stop_id").alias("stop_id"), routed(), local_day(), K.shift(F.col("local_hour")).alias("shift")).agg(*delay_sums())


def by_entity(rows: DataFrame) -> DataFrame:
    """Each row once for its trip and once for its vehicle: one scan in place of a union of two."""
    both = F.array(F.struct(F.lit("trip").alias("kind"), F.col("trip_id").alias("id")), F.struct(F.lit("vehicle").alias("kind"), F.col("vehicle_id").alias("id")))
    return rows.withColumn("__e", F.explode(both)).withColumn("entity_kind", F.col("__e.kind")).withColumn("entity_id", F.col("__e.id")).where("entity_id IS NOT NULL").drop("__e")


def repeat_offender_daily_spine(fact: DataFrame) -> DataFrame:
    rows = by_entity(fact.where(F.col("route_id").isNotNull() & K.in_clamp(delay())).select("provider_id", "route_id", "trip_id", "vehicle_id", "snapshot_local_date", "delay_seconds"))
    return rows.groupBy("provider_id", "entity_kind", "entity_id", "route_id", local_day()).agg(*delay_sums())


def trip_starts(fact: DataFrame, extra: Sequence[Column] = (), weekdays: bool = True) -> DataFrame:
    """First in-clamp observation of each trip and service day, with its shift."""
    rows = fact.where(F.col("route_id").isNotNull() & F.col("trip_id").isNotNull() & K.in_clamp(delay()))
    service = F.coalesce("start_date", "snapshot_local_date")
    rows = rows.withColumn("service_date", service).withColumn("direction_id", F.coalesce("direction_id", F.lit(0)))
    rows = rows.where(K.iso_day(F.col("service_date")) <= 5) if weekdays else rows
    starts = rows.groupBy("provider_id", "route_id", "direction_id", "service_date", "trip_id", *extra).agg(F.min(F.struct("captured_at_utc", "local_hour")).alias("s"))
    return starts.withColumn("start", F.col("s.captured_at_utc")).withColumn("shift", K.shift(F.col("s.local_hour"))).drop("s")


def gaps(starts: DataFrame, group: Sequence[str]) -> DataFrame:
    """Minutes between consecutive starts of a group, those above 0 and below four hours."""
    w = Window.partitionBy(*group).orderBy("start")
    rows = starts.withColumn("gap_min", F.timestamp_diff("MICROSECOND", F.lag("start").over(w), F.col("start")) / 60_000_000.0)
    return rows.where((F.col("gap_min") > 0) & (F.col("gap_min") < MOST_GAP_MINUTES))


def route_headway_shift_daily(fact: DataFrame) -> DataFrame:
    """Route x direction x shift of weekdays: gap count, sums, those under half the day's median, trips, histogram."""
    grain = ["provider_id", "route_id", "provider_local_date", "direction_id", "shift"]
    starts = trip_starts(fact.where(K.iso_day(F.col("snapshot_local_date")) <= 5), [local_day()])
    found = gaps(starts, [*grain, "service_date"])
    medians = found.groupBy(*grain).agg(F.percentile("gap_min", 0.5).alias("median"))
    trip_counts = starts.groupBy(*grain).agg(F.count(F.lit(1)).alias("trip_count"))
    g = F.col("gap_min")
    rows = found.join(medians, grain).groupBy(*grain).agg(
        F.count(F.lit(1)).alias("gap_count"), F.sum(g).alias("sum_gap_min"), F.sum(g * g).alias("sum_gap_sq_min"), K.count_if(g < 0.5 * F.col("median")).alias("bunched_gap_count"),
        F.array(*K.bins(g, GAP_EDGES, len(GAP_EDGES) - 1, F.lit(True))).alias("gap_histogram"),
    )
    return rows.join(trip_counts, grain)


def route_delay_hourly(summary_5m: DataFrame) -> DataFrame:
    """Hours of the five-minute summary; on_time is NULL if that of any bin is."""
    inside = F.col("delay_observation_count") - F.col("outlier_count")
    weighted = F.sum(F.col("avg_delay_seconds_capped") * inside)
    return summary_5m.groupBy("provider_id", F.date_trunc("HOUR", "period_start_utc").cast("timestamp_ntz").alias("period_start_utc"), "route_id").agg(
        F.sum("trip_count").alias("trip_count"), F.sum("observation_count").alias("observation_count"), F.sum("delay_observation_count").alias("delay_observation_count"),
        F.sum("severe_delay_observation_count").alias("severe_delay_count"),
        F.when(F.count(F.lit(1)) == F.count("on_time_observation_count"), F.sum("on_time_observation_count")).alias("on_time_observation_count"),
        K.half_away(K.ratio(weighted, F.sum(inside)), 2).alias("avg_delay_seconds"), F.max("max_delay_seconds_capped").alias("max_delay_seconds"), F.sum("delayed_trip_count").alias("delayed_trip_count"),
    )


def stop_delay_hourly(fact: DataFrame) -> DataFrame:
    d = delay()
    rows = fact.where(F.col("delay_stop_id").isNotNull() & K.in_clamp(d))
    average = K.half_away(K.ratio(F.sum(d), F.count(d)), 2)
    return rows.groupBy("provider_id", F.date_trunc("HOUR", "captured_at_utc").cast("timestamp_ntz").alias("period_start_utc"), F.col("delay_stop_id").alias("stop_id"), routed()).agg(
        F.count(F.lit(1)).alias("observation_count"), average.alias("avg_arrival_delay_seconds"), average.alias("avg_departure_delay_seconds"), K.count_if(K.severe(d)).alias("severe_delay_count")
    )


def repeated_problem_route_stop(route_spine: DataFrame, stop_spine: DataFrame) -> DataFrame:
    """Weeks of routes and stops with severe delays or a pooled average above five minutes."""
    week = F.date_trunc("WEEK", F.col("provider_local_date")).cast("date").alias("period_start_local")
    part = lambda rows, kind, entity, n: rows.groupBy("provider_id", F.lit(kind).alias("entity_kind"), entity.alias("entity_id"), "route_id", week).agg(
        F.sum("severe_delay_count").alias("issue_count"), K.half_away(K.ratio(F.sum("sum_delay_seconds"), F.sum(n)), 2).alias("avg_delay_seconds")
    )
    routes = part(route_spine, "route", F.col("route_id"), K.total(F.col("delay_histogram")))
    stops = part(stop_spine, "stop", F.coalesce("stop_id", F.lit(UNKNOWN_STOP)), F.col("observation_count"))
    n, average = F.col("issue_count"), F.coalesce("avg_delay_seconds", F.lit(0.0))
    label = F.when((n >= 10) | (average > 600), "critical").when((n > 0) | (average > 300), "high").otherwise("watch")
    return routes.unionByName(stops).where((n > 0) | (average > 300)).withColumn("period_grain", F.lit("week")).withColumn("severity_label", label)


def citizen_accountability_daily(route_spine: DataFrame, stop_hourly: DataFrame, alert_days: DataFrame) -> DataFrame:
    """Days known to any of the three sources; a source that does not know a day gives NULL for its affected count, and no score without delays.

    stop_hourly holds provider_local_date; alert_days: provider_id, provider_local_date, content_hash."""
    key = ["provider_id", "provider_local_date"]
    inside = F.sum(K.total(F.col("delay_histogram")))
    hours = route_spine.groupBy(*key, "route_id", "hour_of_day_local").agg(
        F.sum("severe_delay_count").alias("bad"), F.sum("delayed_trip_count").alias("late"), K.half_away(K.ratio(F.sum("sum_delay_seconds"), inside), 2).alias("average")
    )
    hit = F.when((F.col("average") > 300) | (F.col("bad") > 0), F.col("route_id"))
    routes = hours.groupBy(*key).agg(F.count_distinct(hit).alias("affected_route_count"), F.sum("late").alias("delayed_trip_count"), F.sum("bad").alias("severe_delay_count"))
    average = F.coalesce("avg_arrival_delay_seconds", "avg_departure_delay_seconds")
    stops = stop_hourly.groupBy(*key).agg(F.count_distinct(F.when((average > 300) | (F.col("severe_delay_count") > 0), F.col("stop_id"))).alias("affected_stop_count"))
    told = alert_days.groupBy(*key).agg(F.count_distinct("content_hash").alias("alert_count"))
    days = routes.select(*key).union(stops.select(*key)).union(told.select(*key)).distinct()
    rows = days.join(routes.withColumn("__r", F.lit(1)), key, "left").join(stops.withColumn("__s", F.lit(1)), key, "left").join(told, key, "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    score = n("affected_route_count") * 2 + n("affected_stop_count") + n("delayed_trip_count") + n("severe_delay_count") * 3 + n("alert_count") * 2
    score = F.when(F.col("__r").isNotNull() | F.col("__s").isNotNull(), F.least(score.cast("double"), F.lit(9999.9999)))
    return rows.select(*key, "affected_route_count", "affected_stop_count", *(n(c).alias(c) for c in ("delayed_trip_count", "severe_delay_count", "alert_count")), score.alias("rider_impact_score"))


def recent(fact: DataFrame, now: Column | None, days: int = 14) -> DataFrame:
    """Facts captured within the retention window before now; all of them without a now."""
    return fact if now is None else fact.where(F.col("captured_at_utc") >= F.timestamp_add("DAY", F.lit(-days), now))


def route_headway_by_shift(fact: DataFrame, now: Column | None = None) -> DataFrame:
    """Weekday headways of each route's busiest direction over 14 days: median, count, variation, gaps under half the median."""
    starts = trip_starts(recent(fact, now))
    rank = F.row_number().over(Window.partitionBy("provider_id", "route_id").orderBy(F.desc("n"), "direction_id"))
    busiest = starts.groupBy("provider_id", "route_id", "direction_id").agg(F.count(F.lit(1)).alias("n")).withColumn("__k", rank).where("__k = 1").select("provider_id", "route_id", "direction_id")
    found = gaps(starts.join(busiest, ["provider_id", "route_id", "direction_id"]), ["provider_id", "route_id", "direction_id", "service_date", "shift"])
    grain, g = ["provider_id", "route_id", "shift"], F.col("gap_min")
    stats = found.groupBy(*grain).agg(F.percentile(g, 0.5).alias("median"), F.count(F.lit(1)).alias("sample_count"), F.sum(g).alias("s"), F.sum(g * g).alias("q"))
    near = found.join(stats.select(*grain, "median"), grain).groupBy(*grain).agg(K.count_if(g < 0.5 * F.col("median")).alias("bunched_count"))
    cov = K.pooled_cov(F.col("sample_count"), F.col("s"), F.col("q"))
    return stats.join(near, grain, "left").select(*grain, K.half_away(F.col("median"), 1).alias("observed_headway_min"), "sample_count", cov.alias("headway_cov"), F.coalesce("bunched_count", F.lit(0)).alias("bunched_count"))


def route_headway_by_direction_shift(fact: DataFrame, now: Column | None = None) -> DataFrame:
    """Headways of each direction by kind of day over 14 days."""
    starts = trip_starts(recent(fact, now), weekdays=False).withColumn("service_day_kind", K.day_type(F.col("service_date")))
    found = gaps(starts, ["provider_id", "route_id", "direction_id", "service_day_kind", "service_date", "shift"])
    return found.groupBy("provider_id", "route_id", "direction_id", "shift", "service_day_kind").agg(K.half_away(F.percentile("gap_min", 0.5), 1).alias("observed_headway_min"), F.count(F.lit(1)).alias("sample_count"))


def offender_label(recurrence: Column, average: Column) -> Column:
    return F.when((recurrence >= 10) | (average > 600), "critical").when(recurrence >= 5, "high").otherwise("watch")


def repeat_offender(fact: DataFrame, now: Column | None = None) -> DataFrame:
    """Trips and vehicles with a severe delay on three local days or more of the last 14."""
    d = delay()
    rows = by_entity(recent(fact, now).where(F.col("route_id").isNotNull() & K.in_clamp(d)).select("provider_id", "route_id", "trip_id", "vehicle_id", "snapshot_local_date", "delay_seconds"))
    found = rows.groupBy("provider_id", "entity_kind", "entity_id", "route_id").agg(
        F.count_distinct(F.when(d > 300, F.col("snapshot_local_date"))).alias("recurrence_days"), K.half_away(K.ratio(F.sum(d), F.count(d)), 1).alias("avg_delay_seconds")
    )
    return found.where("recurrence_days >= 3").withColumn("severity_label", offender_label(F.col("recurrence_days"), F.col("avg_delay_seconds")))
