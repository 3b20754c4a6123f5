"""Timetable services, dimensions and the facts that join live updates with the timetable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
NEAR_SECONDS = 600
#: The tolerances that a chunk of the nearest-vehicle pass is long.
CHUNK = 6


def service_dates(calendar: DataFrame, calendar_dates: DataFrame) -> DataFrame:
    """provider_id, service_id, service_date: weekly services within their range, less removals, plus additions (which need no calendar)."""
    key = ["provider_id", "service_id", "service_date"]
    days = calendar.withColumn("service_date", F.explode(F.sequence("start_date", "end_date", F.expr("INTERVAL 1 DAY"))))
    weekly = days.where(F.get(F.array(*WEEKDAYS), F.weekday("service_date"))).select(*key)
    kept = weekly.join(calendar_dates.where("exception_type = 2"), key, "left_anti")
    return kept.union(calendar_dates.where("exception_type = 1").select(*key)).distinct()


def scheduled_universe(trips: DataFrame, running: DataFrame) -> DataFrame:
    """Distinct trips of each route and date."""
    rows = trips.join(running, ["provider_id", "service_id"])
    return rows.groupBy("provider_id", F.col("service_date").alias("provider_local_date"), "route_id").agg(F.count_distinct("trip_id").alias("scheduled_trip_count"))


def service_seconds(clock: Column) -> Column:
    """Seconds of a service time HH:MM:SS, whose hours may pass 24."""
    part = F.split(clock, ":")
    return (F.get(part, F.lit(0)).cast("int") * 3600 + F.get(part, F.lit(1)).cast("int") * 60 + F.get(part, F.lit(2)).cast("int")).cast("int")


def dim_date(calendar: DataFrame, calendar_dates: DataFrame) -> DataFrame:
    """A row for each provider and date between the earliest and latest date of either table, with calendar attributes and exception flags."""
    bounds = calendar.select("provider_id", F.col("start_date").alias("a"), F.col("end_date").alias("z")).union(calendar_dates.select("provider_id", "service_date", "service_date"))
    days = bounds.groupBy("provider_id").agg(F.min("a").alias("a"), F.max("z").alias("z")).select("provider_id", F.explode(F.sequence("a", "z", F.expr("INTERVAL 1 DAY"))).alias("date"))
    flags = calendar_dates.groupBy("provider_id", F.col("service_date").alias("date")).agg(F.bool_or(F.col("exception_type") == 1).alias("has_added"), F.bool_or(F.col("exception_type") == 2).alias("has_removed"))
    d = F.col("date")
    rows = days.join(flags, ["provider_id", "date"], "left")
    return rows.select(
        "provider_id", F.date_format(d, "yyyyMMdd").cast("int").alias("date_key"), "date", F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.month(d).alias("month"), F.weekofyear(d).alias("iso_week"),
        (F.weekday(d) + 1).alias("iso_day"), (F.weekday(d) >= 5).alias("is_weekend"), F.coalesce("has_added", F.lit(False)).alias("has_added"), F.coalesce("has_removed", F.lit(False)).alias("has_removed"),
    )


def history_closed_and_opened(history: DataFrame, current: DataFrame, key: list[str], values: list[str], as_of: Column) -> DataFrame:
    """Validity rows after an edition: open rows that no current row equals are closed, current rows without an open equal are opened."""
    same = [*key, *values]
    now = current.select(*same).distinct()
    equal = [history[c].eqNullSafe(now[c]) for c in same]
    is_open = history["valid_to"].isNull()
    gone = history.where(is_open).join(now, equal, "left_anti").withColumn("valid_to", as_of)
    kept = history.where(~is_open).unionByName(history.where(is_open).join(now, equal, "left_semi"))
    opened_before = kept.where("valid_to IS NULL")
    fresh = now.join(opened_before, [now[c].eqNullSafe(opened_before[c]) for c in same], "left_anti")
    return kept.unionByName(gone).unionByName(fresh.withColumn("valid_from", as_of).withColumn("valid_to", F.lit(None).cast(history.schema["valid_to"].dataType)).select(*history.columns))


def schedule_summary(trips: DataFrame, stop_times: DataFrame, calendar: DataFrame) -> DataFrame:
    """Route x day type: a service counts for each day type it runs on; first and last departure, span in whole minutes, trips, stops."""
    kinds = {"weekday": "monday OR tuesday OR wednesday OR thursday OR friday", "saturday": "saturday", "sunday": "sunday"}
    kind = F.explode(F.array_compact(F.array(*(F.when(F.expr(c), F.lit(k)) for k, c in kinds.items()))))
    services = calendar.select("provider_id", "service_id", kind.alias("day_type"))
    departures = stop_times.withColumn("secs", service_seconds(F.col("departure_time")))
    rows = trips.join(services, ["provider_id", "service_id"]).join(departures.select("provider_id", "trip_id", "stop_id", "secs"), ["provider_id", "trip_id"])
    return rows.groupBy("provider_id", "route_id", "day_type").agg(
        F.min("secs").alias("first_departure_secs"), F.max("secs").alias("last_departure_secs"), F.expr("(max(secs) - min(secs)) div 60").alias("span_minutes"),
        F.count_distinct("trip_id").alias("trip_count"), F.count_distinct("stop_id").alias("stop_count"),
    )


def service_instant(day: Column, seconds: Column, time_zone: str) -> Column:
    """The UTC instant of a service time: counted from noon less twelve hours, so days on which clocks change are right."""
    noon = F.timestamp_add("HOUR", F.lit(12), day.cast("timestamp_ntz"))
    origin = F.timestamp_add("HOUR", F.lit(-12), F.convert_timezone(F.lit(time_zone), F.lit("UTC"), noon))
    return F.timestamp_add("SECOND", seconds, origin)


def next_stop_delays(updates: DataFrame, stop_times: DataFrame, time_zone: str) -> DataFrame:
    """updates (provider_id, rt_feed_snapshot_id, entity_index, stop_time_update_index, trip_id, start_date, stop_sequence, arrival_utc, departure_utc, feed_timestamp_utc) with the one candidate stop of each entity and its delay.

    Candidates need a start date, a predicted and a scheduled time. First future ones, then the nearest, then the lower sequence."""
    planned = stop_times.select("provider_id", "trip_id", "stop_sequence", "stop_id", service_seconds(F.coalesce("arrival_time", "departure_time")).alias("secs"))
    predicted = F.coalesce("arrival_utc", "departure_utc")
    rows = updates.where(F.col("start_date").isNotNull() & predicted.isNotNull()).join(planned, ["provider_id", "trip_id", "stop_sequence"])
    rows = rows.withColumn("predicted", predicted).withColumn("delay_seconds", F.timestamp_diff("SECOND", service_instant(F.col("start_date"), F.col("secs"), time_zone), predicted).cast("int"))
    away = F.timestamp_diff("SECOND", F.col("feed_timestamp_utc"), F.col("predicted"))
    order = Window.partitionBy("provider_id", "rt_feed_snapshot_id", "entity_index").orderBy((away < 0).cast("int"), F.abs(away), F.col("stop_sequence").asc_nulls_last(), "stop_time_update_index")
    return rows.withColumn("__k", F.row_number().over(order)).where("__k = 1").drop("__k", "secs")


def nearest_vehicle(trip_facts: DataFrame, vehicles: DataFrame, seconds: int = NEAR_SECONDS, at: str = "captured_at_utc") -> DataFrame:
    """Each trip fact with the vehicle position nearest in time within the tolerance, on the same trip and (where known) route, and its occupancy (where the positions have one); facts without one stay. at: the column of time of both tables.

    An as-of join in one pass without pairs: facts and positions of a trip and route are sorted together within a chunk of time, and each fact
    takes the last position before it and the first after it. Positions near the edge of a chunk are copied to the next one, and each once more
    for facts without a route. Distances count in whole seconds; of equally near positions the newer snapshot counts, then the lower entity,
    so a position carries those that lie in the second before and in the second after it, one for each instant."""
    second = 1_000_000
    micros = F.timestamp_diff("MICROSECOND", F.lit("2000-01-01 00:00:00").cast("timestamp_ntz"), F.col(at))
    chunk = lambda t: F.floor(t / (CHUNK * seconds * second)).cast("long")
    occupancy = F.col("occupancy_status") if "occupancy_status" in vehicles.columns else F.lit(None).cast("int")
    cars = vehicles.where(F.col("vehicle_id").isNotNull() & F.col("trip_id").isNotNull() & F.col("provider_id").isNotNull() & F.col(at).isNotNull())
    cars = cars.select(
        "provider_id", "trip_id", micros.alias("__t"), F.explode(F.array_distinct(F.array("route_id", F.lit(None)))).alias("__route"), (-F.col("realtime_snapshot_id")).alias("__snapshot"), F.col("entity_index").alias("__entity"),
        F.struct("vehicle_id", occupancy.alias("occupancy")).alias("__car"), F.lit(None).cast(trip_facts.select(F.struct("*")).schema[0].dataType).alias("__fact"),
    )
    reach = (seconds + 1) * second
    cars = cars.withColumn("__chunk", F.explode(F.sequence(chunk(F.col("__t") - reach), chunk(F.col("__t") + reach))))
    facts = trip_facts.select("provider_id", "trip_id", micros.alias("__t"), F.col("route_id").alias("__route"), F.struct("*").alias("__fact"), chunk(micros).alias("__chunk"))
    part = Window.partitionBy("provider_id", "trip_id", "__route", "__chunk")
    # at one instant positions come before facts, and the one that counts is the last position
    ordered = part.orderBy("__t", F.col("__car").isNull(), F.desc("__snapshot"), F.desc("__entity"))
    following = F.struct(F.lead("__t").over(ordered).alias("t"), F.lead(F.col("__car").isNull()).over(ordered).alias("fact"))
    rows = cars.unionByName(facts, allowMissingColumns=True).withColumn("__next", following)
    rows = rows.where(F.col("__fact").isNotNull() | F.col("__next.fact").isNull() | F.col("__next.fact") | (F.col("__next.t") != F.col("__t"))).drop("__next")
    one = F.when(F.col("__car").isNotNull(), F.struct("__t", "__snapshot", "__entity", "__car"))
    around = lambda low, high: F.when(F.col("__car").isNotNull(), F.collect_list(one).over(part.orderBy("__t").rangeBetween(low, high)))
    rows = rows.withColumns({"__before": around(1 - second, 0), "__after": around(0, second - 1)})
    rows = rows.withColumns({
        "__before": F.last("__before", ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "__after": F.expr("lead(__after) IGNORE NULLS OVER (PARTITION BY provider_id, trip_id, __route, __chunk ORDER BY __t, __car IS NULL, __snapshot DESC, __entity DESC)"),
    }).where("__fact IS NOT NULL")
    apart = lambda p: F.floor(F.abs(p["__t"] - F.col("__t")) / second)
    near = F.transform(F.concat(*(F.coalesce(c, F.array()) for c in ("__before", "__after"))), lambda p: F.struct(apart(p).alias("apart"), p["__snapshot"].alias("snapshot"), p["__entity"].alias("entity"), p["__car"].alias("car")))
    best = F.array_min(F.filter(near, lambda p: p["apart"] <= seconds))
    return rows.withColumn("__best", best).select("__fact.*", F.col("__best.car.vehicle_id").alias("near_vehicle_id"), F.col("__best.car.occupancy").alias("near_occupancy_status"), F.col("__best.apart").cast("long").alias("near_vehicle_seconds"))


def trip_delay_fact(updates: DataFrame, stop_updates: DataFrame, stop_times: DataFrame, vehicles: DataFrame, time_zone: str) -> DataFrame:
    """The trip-delay fact: a row for each trip update entity, with its stop counts, the delay at its next stop and the nearest vehicle.

    updates: provider_id, realtime_snapshot_id, entity_index, entity_id, feed_timestamp_utc, captured_at_utc, trip_id, route_id, direction_id, start_date, schedule_relationship.
    stop_updates: provider_id, realtime_snapshot_id, entity_index, stop_time_update_index, stop_sequence, stop_id, arrival_utc, departure_utc, schedule_relationship (1: skipped).
    Counts and the next stop come from one aggregation, so a feed's stop updates are shuffled by entity once; an entity without stop
    updates counts 0, one without a start date, a prediction or a planned stop has no delay. Snapshots are those of the input: pass
    one snapshot to refresh it, a day to rebuild the day."""
    key = ["provider_id", "realtime_snapshot_id", "entity_index"]
    clock = F.coalesce(*(c for c in ("arrival_time", "departure_time") if c in stop_times.columns))
    planned = stop_times.where(clock.isNotNull()).select("provider_id", "trip_id", "stop_sequence", F.col("stop_id").alias("planned_stop_id"), service_seconds(clock).alias("secs"))
    rows = stop_updates.join(updates.select(*key, "trip_id", "start_date", "feed_timestamp_utc"), key).join(planned, ["provider_id", "trip_id", "stop_sequence"], "left")
    predicted = F.coalesce("arrival_utc", "departure_utc")
    late = F.timestamp_diff("SECOND", service_instant(F.col("start_date"), F.col("secs"), time_zone), predicted).cast("int")
    away = F.timestamp_diff("SECOND", F.col("feed_timestamp_utc"), predicted)
    order = F.struct((away < 0).cast("int"), F.abs(away), "stop_sequence", "stop_time_update_index")
    stop = F.struct(late.alias("delay_seconds"), F.coalesce("stop_id", "planned_stop_id").alias("delay_stop_id"), F.col("stop_sequence").alias("delay_stop_sequence"))
    counts = rows.groupBy(*key).agg(
        F.count(F.lit(1)).cast("int").alias("updates"), F.count_if(F.col("schedule_relationship") == 1).cast("int").alias("skipped"),
        F.min_by(stop, F.when(late.isNotNull() & away.isNotNull(), order)).alias("next"),
    )
    local = F.convert_timezone(F.lit("UTC"), F.lit(time_zone), F.col("feed_timestamp_utc"))
    found = nearest_vehicle(updates, vehicles, at="feed_timestamp_utc").join(counts, key, "left")
    return found.select(
        *key, F.date_format(local, "yyyyMMdd").cast("int").alias("snapshot_date_key"), F.to_date(local).alias("snapshot_local_date"), "feed_timestamp_utc", "captured_at_utc", "entity_id", "trip_id", "route_id",
        "direction_id", "start_date", F.col("near_vehicle_id").alias("vehicle_id"), F.col("near_occupancy_status").alias("occupancy_status"), F.col("schedule_relationship").alias("trip_schedule_relationship"),
        "next.delay_seconds", F.coalesce("updates", F.lit(0)).alias("stop_time_update_count"), F.coalesce("skipped", F.lit(0)).alias("skipped_stop_count"), "next.delay_stop_id", "next.delay_stop_sequence",
    )


def latest(rows: DataFrame) -> DataFrame:
    """Rows of each provider's newest snapshot."""
    newest = rows.groupBy("provider_id").agg(F.max("realtime_snapshot_id").alias("realtime_snapshot_id"))
    return rows.join(newest, ["provider_id", "realtime_snapshot_id"], "left_semi")


def representative_dates(universe: DataFrame, last: Column, days: int = 42) -> DataFrame:
    """The busiest weekday and weekend date of the days up to `last`; ties go to the earlier date."""
    kind = F.when(F.weekday("provider_local_date") < 5, "weekday").otherwise("weekend")
    rows = universe.where(F.col("provider_local_date").between(F.date_sub(last, days), last))
    totals = rows.groupBy("provider_id", "provider_local_date", kind.alias("day_type")).agg(F.sum("scheduled_trip_count").alias("trips"))
    best = totals.groupBy("provider_id", "day_type").agg(F.max_by(F.struct("provider_local_date", "trips"), F.struct("trips", -F.unix_date("provider_local_date"))).alias("b"))
    return best.select("provider_id", "day_type", F.col("b.provider_local_date").alias("service_date"), F.col("b.trips").alias("trip_count"))
