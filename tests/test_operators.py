"""Golden cases of facts, rollups and reads on hand-built rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from punctua.operators import alerts, client, facts, live, reads, rollups
from punctua.sources import driver_tables as T

DAY = dt.date(2024, 1, 10)


@pytest.fixture
def fact(spark):
    def make(rows):
        base = {"captured_at_utc": dt.datetime(2024, 1, 10, 15, 0), "snapshot_local_date": DAY, "local_hour": 10, "route_id": "R1", "trip_id": "T1", "vehicle_id": "V1", "direction_id": 0, "delay_stop_id": "S1", "occupancy_status": None,
                "trip_schedule_relationship": None, "start_date": DAY, "delay_seconds": None, "stop_time_update_count": 1, "skipped_stop_count": 0, "entity_index": 0, "realtime_snapshot_id": 1, "provider_id": "P1"}
        schema = """captured_at_utc timestamp_ntz, snapshot_local_date date, local_hour int, route_id string, trip_id string, vehicle_id string, direction_id int, delay_stop_id string, occupancy_status int,
          trip_schedule_relationship int, start_date date, delay_seconds int, stop_time_update_count int, skipped_stop_count int, entity_index int, realtime_snapshot_id long, provider_id string"""
        return spark.createDataFrame([tuple((base | r).values()) for r in rows], schema)

    return make


def test_on_time_band(fact):
    rows = fact([{"delay_seconds": d} for d in (-120, -60, 0, 299, 300, 400, None)])
    got = rollups.route_delay_spine(rows).first()
    assert (got["on_time_observation_count"], got["delay_observation_count"], got["observation_count"], got["severe_delay_count"]) == (3, 6, 7, 1)
    none = rollups.route_delay_spine(fact([{}])).first()
    assert none["on_time_observation_count"] is None and none["severe_delay_count"] == 0 and sum(none["delay_histogram"]) == 0


def test_ghosts_count_for_rates_only(fact):
    got = rollups.route_delay_spine(fact([{"delay_seconds": 5000}, {"delay_seconds": 3600}, {"delay_seconds": 10}])).first()
    assert (got["delay_observation_count"], got["sum_delay_seconds"], sum(got["delay_histogram"]), got["delay_histogram"][20], got["severe_delay_count"]) == (3, 3610, 2, 1, 1)


def test_late_trips_are_counted_by_five_minutes(fact):
    at = lambda m: dt.datetime(2024, 1, 10, 15, m)
    got = rollups.route_delay_spine(fact([{"delay_seconds": 9, "captured_at_utc": at(m)} for m in (0, 4, 5, 11)])).first()
    assert got["delayed_trip_count"] == 3


def test_cancellation(spark, fact):
    rows = fact([{"trip_id": t, "trip_schedule_relationship": r} for t, r in (("a", None), ("b", 3), ("b", 3), ("b", 0), ("c", 3), ("d", 0))])
    empty = spark.createDataFrame([], "provider_id string, provider_local_date date, route_id string, scheduled_trip_count long")
    got = rollups.route_cancellation_daily(rows, empty).first()
    assert (got["total_trip_days"], got["canceled_trip_days"], got["cancellation_rate_pct"], got["silent_trip_days"]) == (4, 2, 50.0, None)
    planned = spark.createDataFrame([("P1", DAY, "R1", 9), ("P1", DAY, "R2", 3)], empty.schema)
    both = {r["route_id"]: r for r in rollups.route_cancellation_daily(rows, planned).collect()}
    assert both["R1"]["silent_trip_days"] == 5 and (both["R2"]["total_trip_days"], both["R2"]["cancellation_rate_pct"], both["R2"]["silent_trip_days"]) == (0, None, 3)


def test_occupancy(fact):
    codes = [1, 1, 2, 3, 4, 5, 7]
    got = rollups.route_occupancy_band_daily(fact([{"occupancy_status": c} for c in codes])).first()
    assert [got[c] for c in ("observation_count", "empty_count", "many_seats_count", "few_seats_count", "standing_count", "full_count")] == [6, 0, 2, 1, 2, 1]


def test_headway(fact):
    at = [dt.datetime(2024, 1, 10, 15, m) for m in (0, 2, 12, 22)]
    rows = fact([{"trip_id": f"T{i}", "captured_at_utc": t, "delay_seconds": 5} for i, t in enumerate(at)])
    got = rollups.route_headway_by_shift(rows).first()
    assert (got["sample_count"], got["observed_headway_min"], got["bunched_count"]) == (3, 10.0, 1) and 0.60 <= got["headway_cov"] <= 0.66
    spine = rollups.route_headway_shift_daily(rows).first()
    assert (spine["gap_count"], spine["trip_count"], spine["bunched_gap_count"], spine["sum_gap_min"]) == (3, 4, 1, 22.0)


@pytest.mark.parametrize("day, clock, actual", [
    ("2024-01-15", "08:00:00", "2024-01-15 13:00:00"), ("2024-07-15", "08:00:00", "2024-07-15 12:00:00"), ("2024-03-10", "05:00:00", "2024-03-10 09:00:00"), ("2024-03-10", "01:00:00", "2024-03-10 05:00:00"),
    ("2024-11-03", "05:00:00", "2024-11-03 10:00:00"), ("2024-11-02", "25:30:00", "2024-11-03 05:30:00"), ("2024-01-15", "24:10:00", "2024-01-16 05:10:00")])
def test_service_time_across_clock_changes(spark, day, clock, actual):
    got = spark.range(1).select(facts.service_instant(F.lit(day).cast("date"), facts.service_seconds(F.lit(clock)), T.TIME_ZONE).alias("x")).first()["x"]
    assert str(got) == actual


def test_service_dates_without_calendar(spark):
    empty = T.calendar(spark).limit(0)
    got = facts.service_dates(empty, T.calendar_dates(spark)).collect()
    assert [(r["service_id"], str(r["service_date"])) for r in got] == [("WE", "2024-01-15")]


def test_history_closes_before_it_opens(spark):
    schema = "route_id string, name string, valid_from timestamp_ntz, valid_to timestamp_ntz"
    t0, now = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)
    old = spark.createDataFrame([("A", "one", t0, None), ("B", None, t0, None), ("C", "x", t0, None)], schema)
    new = spark.createDataFrame([("A", "two"), ("B", None), ("D", "new")], "route_id string, name string")
    got = sorted(map(tuple, facts.history_closed_and_opened(old, new, ["route_id"], ["name"], F.lit(now).cast("timestamp_ntz")).collect()), key=str)
    assert got == sorted([("A", "one", t0, now), ("A", "two", now, None), ("B", None, t0, None), ("C", "x", t0, now), ("D", "new", now, None)], key=str)


def test_nearest_vehicle(spark, fact):
    at = lambda s: dt.datetime(2024, 1, 10, 15) + dt.timedelta(seconds=s)
    rows = fact([{"captured_at_utc": at(0), "realtime_snapshot_id": 5}, {"captured_at_utc": at(0), "realtime_snapshot_id": 6, "trip_id": "T2"}])
    cars = spark.createDataFrame([("P1", "T1", "R1", "far", at(601), 1, 0), ("P1", "T1", "R1", "old", at(-300), 1, 0), ("P1", "T1", "R1", "new", at(300), 9, 0), ("P1", "T1", "R9", "other", at(1), 1, 0), ("P1", "T2", "R1", "late", at(601), 1, 0)],
      "provider_id string, trip_id string, route_id string, vehicle_id string, captured_at_utc timestamp_ntz, realtime_snapshot_id long, entity_index int")
    got = {r["trip_id"]: (r["near_vehicle_id"], r["near_vehicle_seconds"]) for r in facts.nearest_vehicle(rows, cars).collect()}
    assert got == {"T1": ("new", 300), "T2": (None, None)}


def test_nearest_vehicle_by_a_plain_loop(spark, fact):
    """Busy instants, parts of seconds, edges of chunks and tolerances, unknown routes; each fact and position is read once, without pairs."""
    pick, at = random.Random(3), lambda s: dt.datetime(2024, 1, 10, 15) + dt.timedelta(seconds=s)
    moments = [-0.5, 600.4, 0, 0.25, 0.75, 1, 1.5, 599, 600, 600.999999, 1200, 3599.9, 3600, 3600.2, 4200, 4201]
    route = lambda: pick.choice(["R1", "R2", None])
    rows = [{"captured_at_utc": at(pick.choice(moments)), "realtime_snapshot_id": i, "trip_id": pick.choice(["T1", "T2", "T3", None]), "route_id": route()} for i in range(150)]
    rows.append({"captured_at_utc": at(-0.5), "realtime_snapshot_id": 150, "trip_id": "T4"})
    cars = [("P1", pick.choice(["T1", "T2", None]), route(), pick.choice([f"V{i}", f"V{i}", None]), at(pick.choice(moments[2:12])), pick.randrange(9), i, i % 6) for i in range(60)]
    cars.append(("P1", "T4", "R1", "edge", at(600.4), 1, 0, 2))  # 600.9 seconds count as 600
    frame = spark.createDataFrame(cars, "provider_id string, trip_id string, route_id string, vehicle_id string, captured_at_utc timestamp_ntz, realtime_snapshot_id long, entity_index int, occupancy_status int")

    def best(r):
        seconds = lambda c: abs(c[4] - r["captured_at_utc"]) // dt.timedelta(seconds=1)
        near = [c for c in cars if c[3] and c[1] and c[1] == r["trip_id"] and r.get("route_id", "R1") in (None, c[2]) and seconds(c) <= 600]
        return min(((seconds(c), -c[5], c[6], c[3], c[7]) for c in near), default=None)

    found = facts.nearest_vehicle(fact(rows), frame)
    got = {r["realtime_snapshot_id"]: (r["near_vehicle_id"], r["near_occupancy_status"], r["near_vehicle_seconds"]) for r in found.collect()}
    assert got == {r["realtime_snapshot_id"]: (b[3], b[4], b[0]) if (b := best(r)) else (None, None, None) for r in rows}
    assert got[150] == ("edge", 2, 600) and "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_windows_and_gaps(spark):
    rows = spark.createDataFrame([("P1", dt.date(2024, 1, d), 1) for d in (1, 2, 5, 9, 10)], "provider_id string, provider_local_date date, n long")
    dealt = reads.in_windows(rows, ["provider_id"]).groupBy("window_grain", "period").agg(F.sum("n").alias("n")).collect()
    assert {(r["window_grain"], r["period"]): r["n"] for r in dealt} == {("day", "current"): 1, ("day", "prior"): 1, ("week", "current"): 3, ("week", "prior"): 2, ("month", "current"): 5}
    gaps = reads.coverage_gaps(rows, ["provider_id"]).first()
    assert [(str(g["gap_start"]), str(g["gap_end"])) for g in gaps["gaps"]] == [("2024-01-03", "2024-01-04"), ("2024-01-06", "2024-01-08")]


def test_hourly_parity(spark):
    fact = T.fact(spark, "/root/testdata/sf0.001")
    daily = rollups.route_occupancy_band_daily(fact).orderBy("route_id", "provider_local_date").collect()
    hourly = rollups.route_occupancy_band_hourly(fact).drop("hour_of_day_local").groupBy("provider_id", "provider_local_date", "route_id").sum().orderBy("route_id", "provider_local_date").collect()
    assert [tuple(r)[3:] for r in daily] == [tuple(r)[3:] for r in hourly]
    stop = rollups.stop_delay_spine(fact).agg(F.sum("observation_count")).first()[0]
    assert stop == rollups.stop_delay_shift_daily(fact).agg(F.sum("observation_count")).first()[0]


def test_search(spark):
    names = ["Berri-UQAM", "Station Berri-UQÀM", "Place-d’Armes", "Fleury / Berri", None]
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    tiers = lambda q: [r[0] for r in rows.select(client.search_tier(F.col("name"), q)).collect()]
    assert tiers("berri uqam") == [0, 2, None, None, None] and tiers("PLACE d'armes")[2] == 0 and tiers("berri fleury") == [None, None, None, 3, None] and tiers("") == [None] * 5


def test_alert_versions(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    rows = [("P1", "A", "h1", t(1)), ("P1", "A", "h1", t(2)), ("P1", "A", "h2", t(3)), ("P1", "B", "x", t(1))]
    got = alerts.versions(spark.createDataFrame(rows, "provider_id string, alert_id string, header string, captured_at_utc timestamp_ntz")).orderBy("alert_id", "first_seen").collect()
    assert [(r["alert_id"], r["first_seen"].day, r["last_seen"].day, r["valid_to"] and r["valid_to"].day) for r in got] == [("A", 1, 2, 3), ("A", 3, 3, None), ("B", 1, 1, None)]


def test_live_bands_differ(spark, fact):
    """The network file counts late vehicles as on time, a live client does not."""
    rows = fact([{"delay_seconds": d} for d in (-70, 0, 100, 400, None)])
    from punctua.functions import kernel as K

    status = rows.select("provider_id", F.col("delay_seconds").cast("double").alias("avg_delay_seconds"), "occupancy_status").withColumn("delay_band", K.delay_band(F.col("avg_delay_seconds")))
    silent, ages = spark.createDataFrame([], "provider_id string, route_id string, non_responding_count long"), spark.createDataFrame([], "provider_id string, age_seconds long")
    assert live.live_network(status, status, silent, ages).first()["on_time_pct"] == 50
    cars = rows.select("provider_id", F.col("delay_seconds").cast("double").alias("avg_delay_seconds"), "occupancy_status").withColumn("delay_band", F.expr("'x'"))
    assert live.client_aggregate(cars.withColumn("delay_band", K.delay_band(F.col("avg_delay_seconds")))).first()["on_time_pct"] == 25.0
