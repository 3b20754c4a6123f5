"""Rules of windows, ladders and pages on cases worked by hand."""

import datetime as dt

from pyspark.sql import functions as F

from punctua.operators import alerts, client, live, reads, rollups
from punctua.plans import publish


def spine(spark, column, rows):
    """rows: entity, observations, severe, seconds."""
    frame = spark.createDataFrame([("P1", e, dt.date(2024, 1, 9), n, n, s, t) for e, n, s, t in rows], f"provider_id string, {column} string, provider_local_date date, delay_observation_count long, observation_count long, severe_delay_count long, sum_delay_seconds long")
    return frame


def test_ladders(spark):
    routes = spine(spark, "route_id", [(f"R{i:02}", 100, i, 6000) for i in range(60)] + [("few", 29, 20, 0), ("nil", 10, 1, 0)])
    stops = spine(spark, "stop_id", [(f"S{i:02}", 100, 50, 6000 * i) for i in range(3)] + [("rare", 2, 2, 0)])
    got = reads.hotspots_by_grain(routes, stops).where("window_grain = 'day'").collect()
    ladder = {k: [r["entity_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["entity_kind"] == k and not r["is_tray"]] for k in ("route", "stop")}
    assert ladder["route"] == [f"R{i:02}" for i in range(59, 9, -1)]  # 50 of 60, whatever the stops
    assert ladder["stop"] == ["S02", "S01", "S00"]  # equal bounds: the greater delay first
    tray = [r["entity_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["is_tray"]]
    assert tray == ["rare", "few", "nil"]  # by severe share, not count


def test_offender_tray_holds_sixty(spark):
    days = [(f"T{i:03}", dt.date(2024, 1, 9 - k)) for i in range(70) for k in range(2)]
    rows = spark.createDataFrame([("P1", "trip", t, "R1", d, 1, 400, 1) for t, d in days], "provider_id string, entity_kind string, entity_id string, route_id string, provider_local_date date, severe_delay_count long, sum_delay_seconds long, observation_count long")
    got = reads.offenders_by_grain(rows).where("window_grain = 'week'").collect()
    assert len(got) == 60 and all(r["is_tray"] for r in got)


def test_pages_within_their_ceiling(spark):
    sizes = [60, 60, 60, 20, 20, 20, 150, 10, 100, 5]
    rows = spark.createDataFrame([("m", i, n) for i, n in enumerate(sizes)], "month string, id int, byte_count int")
    pages = {}
    for r in publish.pages(rows, ["month"], [F.col("id")], 100).orderBy("id").collect():
        pages.setdefault(r["page"], []).append(r["byte_count"])
    assert [n for p in sorted(pages) for n in pages[p]] == sizes and sorted(pages) == list(range(len(pages)))
    assert all(sum(p) <= 100 or len(p) == 1 for p in pages.values())


def test_rolling_windows(spark):
    rows = [("P1", f"T{k}", None, "R1", dt.date(2024, 1, day), dt.datetime(2024, 1, day, 12), 400) for k, days in ((1, (3, 4, 5)), (2, (20, 21, 22)), (3, (16, 17, 18))) for day in days]
    fact = spark.createDataFrame(rows, "provider_id string, trip_id string, vehicle_id string, route_id string, snapshot_local_date date, captured_at_utc timestamp_ntz, delay_seconds int")
    now = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    assert {r["entity_id"] for r in rollups.repeat_offender(fact, now).collect()} == {"T2"}
    assert {r["entity_id"] for r in rollups.repeat_offender(fact).collect()} == {"T1", "T2", "T3"}


def test_departures_of_the_newest_snapshot(spark):
    at = lambda m: dt.datetime(2024, 1, 1, 12, m)
    rows = [("P1", 1, "S1", "R1", "T1", 1, at(5), at(6)), ("P1", 2, "S1", "R1", "T2", 1, at(9), None), ("P1", 2, "S1", "R1", "T3", 1, None, at(7)), ("P2", 1, "S1", "R1", "T4", 1, at(5), None)]
    updates = spark.createDataFrame(rows, "provider_id string, rt_feed_snapshot_id long, stop_id string, route_id string, trip_id string, stop_sequence int, arrival_utc timestamp_ntz, departure_utc timestamp_ntz")
    got = live.next_departures(updates.withColumn("feed_timestamp_utc", F.lit("2024-01-01 12:00:00").cast("timestamp_ntz"))).collect()
    assert {(r["trip_id"], r["departure_rank"]) for r in got} == {("T3", 1), ("T2", 2), ("T4", 1)}


def test_mean_change(spark):
    """Worked by hand: spread is the average of both means by the variation; seven observations on each side."""
    rows = [(10.0, 50, 0.2, 8.0, 50), (8.0, 50, 0.2, 10.0, 50), (10.0, 6, 0.2, 8.0, 50), (10.0, 50, None, 8.0, 50), (10.0, 50, 0.2, None, None), (8.0, 8, 1.0, 7.0, 8)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, value double, n long, cov double, prior_value double, prior_n long")
    got = [(r["delta"], r["significant"]) for r in client.mean_change(frame).orderBy("i").collect()]
    assert got == [(2.0, True), (-2.0, True), (2.0, False), (2.0, False), (None, False), (1.0, False)]


def test_log_breakdown(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    rows = [("P1", "c", None, "high", t(0), t(1)), ("P1", " c ", "", "odd", t(0), t(2)), ("P1", None, "e", None, t(0), None)]
    frame = spark.createDataFrame(rows, "provider_id string, cause string, effect string, severity string, active_start timestamp_ntz, active_end timestamp_ntz")
    got = {(r["kind"], r["key"]): (r["alert_count"], r["median_minutes"]) for r in alerts.log_breakdown(frame).collect()}
    assert got == {("cause", "c"): (2, 90.0), ("cause", "unknown"): (1, None), ("effect", "unknown"): (2, 90.0), ("effect", "e"): (1, None), ("severity", "high"): (1, 60.0), ("severity", "watch"): (2, 120.0)}


def test_receipts(spark):
    """The worst route and stop are those of the greatest average delay, whatever their counts; trips of unscheduled routes count in no state."""
    d = dt.date(2024, 1, 1)
    day = lambda rows, schema: spark.createDataFrame([("P1", d, *r) for r in rows], f"provider_id string, provider_local_date date, {schema}")
    spine = day([("R1", 10, 10, 8, 9, 600, [0] * 10 + [10] + [0] * 10)], "route_id string, observation_count long, delay_observation_count long, on_time_observation_count long, severe_delay_count long, sum_delay_seconds long, delay_histogram array<long>")
    routes = day([("R1", 90, 10, 100.0), ("R2", 4, 3, 300.0), ("R3", 4, 1, 300.0), ("__unrouted__", 1, 1, 900.0)], "route_id string, delay_observation_count long, on_time_observation_count long, avg_delay_seconds double")
    stops = day([("S1", 120.0), ("S0", None), ("__unknown_stop__", 999.0)], "stop_id string, avg_delay_seconds double")
    trips = day([("R1", 8, 1, 9, 7, 1), ("R2", 0, 0, 4, 0, 4), ("R9", 5, 5, None, 0, None)], "route_id string, total_trip_days long, canceled_trip_days long, scheduled_trip_days long, delivered_trip_days long, silent_trip_days long")
    got = reads.receipts(day([(1.0,)], "rider_impact_score double"), spine, routes, stops, trips).first()
    assert (got["worst_route_id"], got["otp_pct"], got["worst_route_otp_delta"], got["worst_stop_id"], got["worst_stop_delay_min"]) == ("R2", 80.0, -5.0, "S1", 2.0)
    assert [got[c] for c in ("scheduled_trip_days", "delivered_trip_days", "cancelled_trip_days", "silent_trip_days", "not_reported_route_count", "completeness_pct")] == [13, 7, 1, 5, 1, 53.85]


def test_hotspots_against_the_network_of_their_week(spark):
    """Routes against routes and stops against stops, both of the target week; without a week the newest period counts and has no rates."""
    monday = dt.date(2024, 1, 8)
    routes = [("P1", "R1", monday, 50, 100), ("P1", "R2", monday, 90, 100), ("P1", "R3", monday, None, 40), ("P1", "R1", dt.date(2024, 1, 1), 100, 100)]
    spine = spark.createDataFrame(routes, "provider_id string, route_id string, provider_local_date date, on_time_observation_count long, delay_observation_count long")
    stops = [("P1", "S1", "R1", monday, 100, 40), ("P1", "S1", "R2", monday, 100, 0), ("P1", "S2", "R2", monday, 100, 10), ("P1", "S1", "R1", dt.date(2024, 1, 1), 100, 100)]
    stop_spine = spark.createDataFrame(stops, "provider_id string, stop_id string, route_id string, provider_local_date date, observation_count long, severe_delay_count long")
    schema = "provider_id string, entity_kind string, entity_id string, route_id string, period_start_local date, period_grain string, issue_count long"
    weekly = [("P1", "route", "R1", "R1", monday, "week", 9), ("P1", "stop", "S1", "R1", monday, "week", 40), ("P1", "route", "R3", "R3", monday, "week", 1), ("P1", "route", "__unrouted__", "__unrouted__", monday, "week", 99), ("P1", "route", "R2", "R2", dt.date(2024, 1, 1), "week", 500), ("P1", "route", "R2", "R2", dt.date(2024, 2, 1), "month", 500)]
    got = [(r["rank"], r["entity_id"], r["otp_pct"], r["network_otp_pct"], r["otp_delta_points"]) for r in reads.hotspots(spark.createDataFrame(weekly, schema), spine, stop_spine).orderBy("rank").collect()]
    assert got == [(1, "S1", 80.0, 83.0, -3.0), (2, "R1", 50.0, 70.0, -20.0), (3, "R3", None, 70.0, None)]
    monthly = [("P1", "route", "R1", "R1", dt.date(2024, 2, 1), "month", 9), ("P1", "route", "R2", "R2", dt.date(2024, 1, 1), "month", 5)]
    got = [(r["entity_id"], r["otp_pct"], r["otp_delta_points"]) for r in reads.hotspots(spark.createDataFrame(monthly, schema), spine, stop_spine).collect()]
    assert got == [("R1", None, None)]
