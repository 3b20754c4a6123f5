"""Live views on the newest snapshot, and the aggregates that live clients draw."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctua.constants import BANDS
from punctua.functions import kernel as K

#: Bounds of the live delay bins, in minutes.
LIVE_BINS = [-5, -2, 0, 2, 5, 10, 15]
#: Fixed value: the route type of metros.
METRO = 1


def vehicle_map(vehicles: DataFrame, box: tuple[float, float, float, float] | None) -> DataFrame:
    """Positions inside the globe and the provider's box (west, south, east, north); without a box all on the globe."""
    lon, lat = F.col("longitude"), F.col("latitude")
    rows = vehicles.where(lon.between(-180, 180) & lat.between(-90, 90))
    return rows if box is None else rows.where(lon.between(box[0], box[2]) & lat.between(box[1], box[3]))


def position_quality(lon: Column, lat: Column, box: tuple[float, float, float, float] | None) -> Column:
    missing, globe = lon.isNull() | lat.isNull(), lon.between(-180, 180) & lat.between(-90, 90)
    quality = F.when(missing, "missing").when(~globe, "invalid_wgs84")
    if box is None:
        return quality.otherwise("valid_wgs84")
    return quality.when(lon.between(box[0], box[2]) & lat.between(box[1], box[3]), "valid_provider_bbox").otherwise("outside_provider_bbox")


def trip_delays(newest: DataFrame, today: Column) -> DataFrame:
    """Trip x route x direction of a newest snapshot, of trips that started today or yesterday: average and greatest in-clamp delay, and the stop times observed."""
    rows = newest.where(K.in_clamp(F.col("delay_seconds")) & (F.col("start_date") >= F.date_sub(today, 1)))
    average = K.half_away(K.ratio(F.sum("delay_seconds"), F.count("delay_seconds")), 2)
    seen = F.coalesce(F.sum("stop_time_update_count"), F.count(F.lit(1))).cast("int")
    return rows.groupBy("provider_id", F.col("realtime_snapshot_id").alias("rt_feed_snapshot_id"), "trip_id", "route_id", "direction_id").agg(
        F.max("captured_at_utc").alias("captured_at_utc"), seen.alias("stop_time_observation_count"), average.alias("avg_delay_seconds"), F.max("delay_seconds").alias("max_delay_seconds")
    )


#: The labels of the bands, in both languages.
LABELS = {"unknown": "Inconnu / Unknown", "early": "En avance / Early", "on_time": "À l'heure / On time", "late": "En retard / Late", "severe": "Critique / Severe"}


def vehicle_map_with_status(positions: DataFrame, delays: DataFrame) -> DataFrame:
    """Vehicles with their trip's delay, band and label; a trip of several routes or directions gives a row for each."""
    rows = positions.join(delays.select("provider_id", "trip_id", "avg_delay_seconds", "max_delay_seconds"), ["provider_id", "trip_id"], "left")
    labels = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    return rows.withColumn("delay_band", K.delay_band(F.col("avg_delay_seconds"))).withColumn("status_band", labels[F.col("delay_band")])


def route_lines(shapes: DataFrame) -> DataFrame:
    """Each shape's points in order, and as GeoJSON. shapes: provider_id, shape_id, sequence, lon, lat."""
    points = F.transform(F.sort_array(F.collect_list(F.struct("sequence", "lon", "lat"))), lambda p: F.array(p["lon"], p["lat"]))
    lines = shapes.groupBy("provider_id", "shape_id").agg(points.alias("points"))
    return lines.withColumn("geojson", F.to_json(F.struct(F.lit("LineString").alias("type"), F.col("points").alias("coordinates"))))


def next_departures(updates: DataFrame) -> DataFrame:
    """Departures of each stop in the provider's newest snapshot, at or after the newest feed's time (now_utc), ranked; updates with stop_id, departure_utc, arrival_utc, feed_timestamp_utc."""
    at = F.coalesce("departure_utc", "arrival_utc")
    newest = updates.groupBy("provider_id").agg(F.max("rt_feed_snapshot_id").alias("rt_feed_snapshot_id"), F.max("feed_timestamp_utc").alias("now_utc"))
    rows = updates.join(F.broadcast(newest), ["provider_id", "rt_feed_snapshot_id"]).withColumn("predicted_utc", at).where(F.col("predicted_utc") >= F.col("now_utc"))
    return rows.withColumn("departure_rank", F.row_number().over(Window.partitionBy("provider_id", "stop_id").orderBy("predicted_utc", "trip_id", "stop_sequence")))


def departures_board(ranked: DataFrame, delays: DataFrame, cap: int = 2) -> DataFrame:
    """At most cap departures of each stop and route, with the trip's mean delay in whole minutes; rows without a stop go."""
    w = Window.partitionBy("provider_id", "stop_id", "route_id").orderBy("predicted_utc", "trip_id", "stop_sequence")
    mean = delays.groupBy("provider_id", "trip_id").agg(F.avg("avg_delay_seconds").alias("mean"))
    rows = ranked.where("stop_id IS NOT NULL").withColumn("k", F.row_number().over(w)).where(F.col("k") <= cap)
    return rows.join(mean, ["provider_id", "trip_id"], "left").withColumn("delay_min", whole_minutes(F.col("mean"))).drop("mean")


def whole_minutes(seconds: Column) -> Column:
    return K.half_away(seconds / 60.0, 0).cast("int")


def vehicle_rows(status: DataFrame) -> DataFrame:
    """The live vehicles as clients read them."""
    place = lambda c: K.half_away(F.col(c), 5).alias(c[:3])
    return status.select(
        "provider_id", F.col("vehicle_id").alias("id"), F.col("route_id").alias("route"), F.col("trip_id").alias("trip"), place("latitude"), place("longitude"), F.col("bearing").cast("int").alias("bearing"),
        K.half_away(F.col("speed") * 3.6, 0).cast("int").alias("speed_kmh"), F.col("delay_band").alias("status"), K.band(F.col("occupancy_status")).alias("occupancy"), F.col("stop_id").alias("next_stop"), F.col("captured_at_utc").alias("updated_utc"),
        F.col("position_timestamp_utc").alias("reported_utc"), whole_minutes(F.col("avg_delay_seconds")).alias("delay_min"),
    )


def trip_rows(delays: DataFrame, departures: DataFrame, minutes: int = 60) -> DataFrame:
    """The live trips: status, delay and the stops of the next minutes in order of time. A trip with departures alone is of unknown status; of several delay rows of a trip the last by route and direction counts."""
    last = delays.groupBy("provider_id", "trip_id").agg(F.max_by(F.struct("route_id", "avg_delay_seconds"), F.struct("route_id", "direction_id")).alias("d"), F.lit(True).alias("known"))
    soon = departures.where(F.col("predicted_utc") < F.timestamp_add("MINUTE", F.lit(minutes), F.col("now_utc")))
    stops = soon.groupBy("provider_id", "trip_id").agg(F.min_by("route_id", F.struct("predicted_utc", "stop_sequence")).alias("route"), F.sort_array(F.collect_list(F.struct("predicted_utc", "stop_sequence", "stop_id"))).alias("stops"))
    rows = last.join(stops, ["provider_id", "trip_id"], "full")
    return rows.select(
        "provider_id", "trip_id", F.when(F.col("known"), F.col("d.route_id")).otherwise(F.col("route")).alias("route"), F.when(F.col("known"), K.delay_band(F.col("d.avg_delay_seconds"))).otherwise("unknown").alias("status"),
        whole_minutes(F.col("d.avg_delay_seconds")).alias("delay_min"), F.transform(F.coalesce("stops", F.array().cast("array<struct<predicted_utc timestamp_ntz, stop_sequence int, stop_id string>>")), lambda s: F.struct(s["stop_id"].alias("stop"), s["predicted_utc"].alias("eta_utc"))).alias("stops"),
    )


#: Severities of a feed, in upper case, as clients show them; any other is watched.
SHOWN = {"CRITICAL": "critical", "SEVERE": "critical", "HIGH": "high", "WARNING": "high", "MAJOR": "high"}


def alert_rows(current: DataFrame) -> DataFrame:
    """The live alerts. An alert without an id gets one from its content, so that a client can follow it; texts that are JSON by mistake count as none."""
    basis = F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in ("description", "severity", "cause", "effect")))
    made = F.concat("provider_id", F.lit("-alert-"), F.substring(F.sha1(basis.cast("binary")), 1, 12))
    trimmed = lambda c: F.nullif(F.trim(c), F.lit(""))
    raw = lambda c: (F.startswith(c, F.lit("{'")) & F.contains(c, F.lit("'language'")) & F.contains(c, F.lit("'text'"))) | (F.startswith(c, F.lit('{"')) & F.contains(c, F.lit('"language"')) & F.contains(c, F.lit('"text"')))
    sane = lambda c: F.when(~raw(trimmed(F.col(c))), trimmed(F.col(c))).alias(c)
    shown = F.create_map(*(F.lit(x) for pair in SHOWN.items() for x in pair))
    split = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return current.select(
        "provider_id", F.coalesce(F.nullif("alert_id", F.lit("")), made).alias("id"), F.coalesce(shown[F.upper(F.trim("severity"))], F.lit("watch")).alias("severity"), F.coalesce("header", F.lit("")).alias("header_text"), "description",
        *(sane(c) for c in ("header_en", "description_en", "url_en")), split("route_ids").alias("routes"), split("stop_ids").alias("stops"), F.col("active_start").alias("start_utc"), F.col("active_end").alias("end_utc"), "cause", "effect", F.col("severity").alias("severity_level"), "url", "active_periods",
    )


def non_responding(trips: DataFrame, stop_times: DataFrame, running: DataFrame, routes: DataFrame, live_trips: DataFrame, today: Column, minute: Column) -> DataFrame:
    """Route: trips that the timetable has on the road at this local minute, today's or yesterday's past midnight, without a live vehicle. Metros have no live feed and do not count.

    running: provider_id, service_id, service_date; stop_times with `secs`; routes: provider_id, route_id, route_type; live_trips: the newest snapshot's positions."""
    day = F.date_diff(today, F.col("service_date"))
    near = running.where(day.between(0, 1)).select("provider_id", "service_id", (day * 1440).alias("shift_min"))
    spans = stop_times.groupBy("provider_id", "trip_id").agg(F.floor(F.min("secs") / 60).alias("first_min"), F.floor(F.max("secs") / 60).alias("last_min"))
    tracked = routes.where(F.coalesce("route_type", F.lit(3)) != METRO).select("provider_id", "route_id")
    rows = trips.join(tracked, ["provider_id", "route_id"], "left_semi").join(near, ["provider_id", "service_id"]).join(spans, ["provider_id", "trip_id"]).where((minute + F.col("shift_min")).between(F.col("first_min"), F.col("last_min")))
    silent = rows.join(live_trips.select("provider_id", "trip_id").distinct(), ["provider_id", "trip_id"], "left_anti")
    return silent.groupBy("provider_id", "route_id").agg(F.count_distinct("trip_id").alias("non_responding_count"), F.array_join(F.sort_array(F.collect_set("trip_id")), ",").alias("trip_ids"))


def live_network(status: DataFrame, delays: DataFrame, silent: DataFrame, freshness: DataFrame) -> DataFrame:
    """One row a provider: vehicles by band, on-time share (on time and late of the known), shares of reported occupancy, percentiles and bins of the trips' delays, trips that do not respond, and the feeds' greatest age.

    What has no evidence is null, never 0. Shares and percentiles are whole numbers, halves to even; bins take delays in whole minutes."""
    key, n = "provider_id", F.count(F.lit(1))
    band, code = F.col("delay_band"), K.band(F.col("occupancy_status"))
    known, told = K.count_if(band != "unknown"), F.count(code)
    pct = lambda a, b: F.bround(K.ratio(100.0 * a.cast("double"), b), 0).cast("int")
    cars = status.groupBy(key).agg(
        n.alias("vehicles_in_service"), *(K.count_if(band == b).alias(f"{b}_count") for b in LABELS), pct(K.count_if(band.isin("on_time", "late")), known).alias("on_time_pct"), pct(known, n).alias("coverage_pct"),
        *(K.ratio(K.count_if(code == b), told).alias(f"{b}_share") for b in BANDS),
    )
    m = F.col("avg_delay_seconds") / 60.0
    minute = F.bround(m, 0)
    edges = [None, *LIVE_BINS, None]
    inside = lambda low, high: (F.lit(True) if low is None else minute >= low) & (F.lit(True) if high is None else minute < high)
    bins = [K.count_if(inside(low, high)).alias(f"bin{i}") for i, (low, high) in enumerate(zip(edges, edges[1:], strict=False))]
    late = delays.where("avg_delay_seconds IS NOT NULL").groupBy(key).agg(*(F.bround(F.percentile(m, q), 0).cast("int").alias(f"delay_p{int(100 * q)}_min") for q in (0.5, 0.9)), *bins)
    routes = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("non_responding_count")).alias("n"), "route_id"))), lambda r: F.concat(r["route_id"], F.lit(":"), (-r["n"]).cast("string")))
    gone = silent.groupBy(key).agg(F.sum("non_responding_count").alias("non_responding"), F.array_join(routes, ",").alias("non_responding_by_route"))
    age = freshness.groupBy(key).agg(F.max("age_seconds").alias("feed_freshness_s"))
    rows = cars.join(late, key, "full").join(gone, key, "full").join(age, key, "full")
    return rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("vehicles_in_service", "non_responding", *(f"{b}_count" for b in LABELS))})


def client_aggregate(vehicles: DataFrame) -> DataFrame:
    """What a live client shows: on time of those with a status (unlike live_network), percentiles of absolute delays, shares of reported occupancy."""
    d = F.col("avg_delay_seconds")
    band, reported = F.col("delay_band"), F.count(K.band(F.col("occupancy_status")))
    shares = [K.half_away(K.ratio(K.count_if(K.band(F.col("occupancy_status")) == b), reported), 4).alias(f"{b}_share") for b in BANDS]
    late = F.abs(d) / 60.0
    return vehicles.groupBy("provider_id").agg(
        F.count(F.lit(1)).alias("vehicle_count"), K.otp_pct(K.count_if(band == "on_time"), K.count_if(band != "unknown")).alias("on_time_pct"), K.count_if(band == "unknown").alias("non_responding"),
        K.half_away(F.percentile(late, 0.5), 1).alias("delay_p50_min"), K.half_away(F.percentile(late, 0.9), 1).alias("delay_p90_min"), *shares,
    )


def feed_freshness(runs: DataFrame, now: Column, skip: Sequence[str] = ("silver_load",)) -> DataFrame:
    """The newest run of each feed (loads aside) and its age in seconds."""
    rows = runs.where(~F.col("run_kind").isin(*skip))
    newest = rows.groupBy("provider_id", "endpoint_key").agg(F.max_by(F.struct("status", "finished_at_utc"), F.struct("finished_at_utc", "run_id")).alias("r"))
    return newest.select("provider_id", "endpoint_key", F.col("r.status").alias("status"), F.col("r.finished_at_utc").alias("finished_at_utc"), F.timestamp_diff("SECOND", F.col("r.finished_at_utc"), now).alias("age_seconds"))


def feed_health(freshness: DataFrame, feeds: DataFrame, least: int = 900) -> DataFrame:
    """Feeds older than the greater of a quarter of an hour and three refresh intervals are stale; feeds never seen are missing."""
    limit = F.greatest(F.lit(least), 3 * F.col("refresh_seconds"))
    rows = feeds.join(freshness, ["provider_id", "endpoint_key"], "left")
    state = F.when(F.col("age_seconds").isNull(), "missing").when(F.col("age_seconds") > limit, "stale").otherwise("fresh")
    return rows.select("provider_id", "endpoint_key", "age_seconds", limit.alias("threshold_seconds"), state.alias("state"))


def source_lineage(versions: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Each dataset version with the endpoint that it came from; versions of unknown endpoints go. Endpoints are few and given by hand."""
    return versions.join(endpoints.select("feed_endpoint_id", "endpoint_key"), "feed_endpoint_id").drop("feed_endpoint_id")


def kpis(vehicles: DataFrame, delays: DataFrame, now: Column, stale_seconds: int = 90, n: int = 5, key: Sequence[str] = ("provider_id",)) -> DataFrame:
    """Vehicle count, busiest routes and mean delay of the newest snapshots, if fresh; a stale source gives NULL for its measures. now may name `at` and `late_at`, the sources' newest captures.

    With the snapshot in the key: what each snapshot showed."""
    key = list(key)
    cars = vehicles.groupBy(*key).agg(F.max("captured_at_utc").alias("at"), F.count_distinct("vehicle_id").alias("n"))
    routes = vehicles.where("route_id IS NOT NULL").groupBy(*key, "route_id").agg(F.count_distinct("vehicle_id").alias("n"))
    best = routes.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("n"), "route_id"))).where(F.col("k") <= n)
    tops = best.groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "route_id", "n"))), lambda x: F.concat_ws(":", x["route_id"], x["n"].cast("string"))), ",").alias("tops"))
    late = delays.groupBy(*key).agg(F.max("captured_at_utc").alias("late_at"), K.half_away(K.ratio(F.sum("delay_seconds"), F.count("delay_seconds")), 1).alias("mean"))
    fresh = lambda at: F.timestamp_diff("SECOND", F.col(at), now) <= stale_seconds
    rows = cars.join(tops, key, "left").join(late, key, "full")
    return rows.select(*key, F.when(fresh("at"), F.col("n")).alias("vehicle_count"), F.when(fresh("at"), F.col("tops")).alias("top_routes"), F.when(fresh("late_at"), F.col("mean")).alias("mean_delay_seconds"))
