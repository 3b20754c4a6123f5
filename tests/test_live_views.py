"""Live views read the newest snapshot: what an older one shows does not count."""

import datetime as dt
import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from punctua.operators import facts, live
from punctua.plans import live_queries as Q
from tests.test_operators import fact  # noqa: F401
from tests.test_queries import FOLDER, plain

OLD, NEW = dt.datetime(2024, 1, 10, 8), dt.datetime(2024, 1, 10, 15)
VEHICLE = "provider_id string, realtime_snapshot_id long, entity_index int, captured_at_utc timestamp_ntz, vehicle_id string, trip_id string, route_id string, latitude double, longitude double, occupancy_status int"


def positions(spark):
    rows = [("P1", 1, 0, OLD, "V1", "T1", "R1", 45.0, -73.0, 1), ("P1", 1, 1, OLD, "V2", "T2", "R1", 45.0, -73.0, 1), ("P1", 2, 0, NEW, "V1", "T1", "R1", 45.0, -73.0, 0), ("P2", 1, 0, OLD, "W", "T9", "R1", 45.0, -73.0, 3)]
    return facts.latest(spark.createDataFrame(rows, VEHICLE))


def delays(fact):
    rows = fact([{"trip_id": "T1", "realtime_snapshot_id": 1, "delay_seconds": 900, "captured_at_utc": OLD}, {"trip_id": "T1", "realtime_snapshot_id": 2, "delay_seconds": 100, "captured_at_utc": NEW, "route_id": "R7"}, {"trip_id": "T3", "realtime_snapshot_id": 2, "delay_seconds": 4000, "captured_at_utc": NEW}])
    return live.trip_delays(facts.latest(rows), F.lit("2024-01-10").cast("date"))


def test_newest_snapshot(spark, fact):
    late = delays(fact).collect()
    assert [(r["trip_id"], r["rt_feed_snapshot_id"], r["avg_delay_seconds"], r["captured_at_utc"]) for r in late] == [("T1", 2, 100.0, NEW)]
    status = live.vehicle_map_with_status(live.vehicle_map(positions(spark), None), delays(fact))
    # joined by trip, though the position and the delay name different routes
    assert {(r["vehicle_id"], r["delay_band"], r["status_band"]) for r in status.collect()} == {("V1", "late", "En retard / Late"), ("W", "unknown", "Inconnu / Unknown")}
    counts = {r["provider_id"]: (r["vehicle_count"], r["top_routes"]) for r in live.kpis(positions(spark), facts.latest(fact([{"captured_at_utc": NEW}])), F.lit(NEW).cast("timestamp_ntz")).collect()}
    assert counts == {"P1": (1, "R1:1"), "P2": (None, None)}  # P2's newest is stale
    assert {(r["provider_id"], r["vehicle_count"]) for r in live.client_aggregate(status).collect()} == {("P1", 1), ("P2", 1)}


def test_maps_and_kpis_of_every_snapshot(spark):
    """Rows of an old snapshot count for that snapshot, and for it alone."""
    count = spark.read.parquet(f"{FOLDER}/events.parquet").selectExpr("event_id DIV 10 AS s").distinct().count()
    assert Q.QUERIES["t126_kpis"](spark, FOLDER).count() == count
    assert Q.QUERIES["t61_vehicle_map"](spark, FOLDER).select("realtime_snapshot_id").distinct().count() > count / 4
    rows = [("P1", 1, 0, OLD, "V1", "T1", "R1", 45.0, -73.0, 1), ("P1", 1, 1, OLD, "V2", "T2", "R1", 45.0, -73.0, 1), ("P1", 2, 0, NEW, "V1", "T1", "R2", 45.0, -73.0, 0)]
    cars = spark.createDataFrame(rows, VEHICLE)
    late = cars.select("provider_id", "realtime_snapshot_id", "captured_at_utc", (F.col("realtime_snapshot_id") * 10).alias("delay_seconds"))
    got = live.kpis(cars, late, F.greatest("at", "late_at"), key=("provider_id", "realtime_snapshot_id")).collect()
    assert sorted(map(tuple, got)) == [("P1", 1, 2, "R1:2", 10.0), ("P1", 2, 1, "R2:1", 20.0)]


def test_non_responding(spark):
    """A trip that only an old snapshot shows does not respond; a metro never counts."""
    schema = "provider_id string, trip_id string, route_id string, service_id string"
    trips = spark.createDataFrame([("P1", "T1", "R1", "A"), ("P1", "T2", "R1", "A"), ("P1", "M1", "M", "A"), ("P1", "T5", "R2", "A"), ("P1", "T6", "R2", "B")], schema)
    times = spark.createDataFrame([("P1", t, s) for t in ("T1", "T2", "M1", "T6") for s in (15 * 3600, 16 * 3600)] + [("P1", "T5", 40 * 3600 - 60), ("P1", "T5", 40 * 3600)], "provider_id string, trip_id string, secs int")
    running = spark.createDataFrame([("P1", "A", dt.date(2024, 1, 10)), ("P1", "A", dt.date(2024, 1, 9))], "provider_id string, service_id string, service_date date")
    routes = spark.createDataFrame([("P1", "R1", 3), ("P1", "R2", None), ("P1", "M", 1)], "provider_id string, route_id string, route_type int")
    got = live.non_responding(trips, times, running, routes, positions(spark), F.lit("2024-01-10").cast("date"), F.lit(15 * 60 + 30)).collect()
    assert [(r["route_id"], r["non_responding_count"], r["trip_ids"]) for r in got] == [("R1", 1, "T2")]
    later = live.non_responding(trips, times, running, routes, positions(spark), F.lit("2024-01-10").cast("date"), F.lit(16 * 60)).collect()
    assert sorted((r["route_id"], r["trip_ids"]) for r in later) == [("R1", "T2"), ("R2", "T5")]


def test_live_files(spark, fact):
    schema = "provider_id string, rt_feed_snapshot_id long, trip_id string, route_id string, stop_id string, stop_sequence int, arrival_utc timestamp_ntz, departure_utc timestamp_ntz, feed_timestamp_utc timestamp_ntz"
    at = lambda m: NEW + dt.timedelta(minutes=m)
    rows = [("P1", 2, "T1", "R7", "S2", 2, at(9), at(10), NEW), ("P1", 2, "T1", "R7", "S1", 1, at(5), None, NEW), ("P1", 2, "T1", "R7", "S9", 9, at(70), None, NEW), ("P1", 2, "T8", "R8", "S1", 1, None, at(3), NEW), ("P1", 2, "T8", "R8", None, 2, None, at(4), NEW), ("P1", 2, "T8", "R8", "S3", 0, at(-4), None, NEW),
      ("P1", 1, "T7", "R7", "S1", 1, at(4), None, OLD), *(("P1", 2, f"X{i}", "R7", "S1", 1, at(20 + i), None, NEW) for i in range(3))]
    due = live.next_departures(spark.createDataFrame(rows, schema))
    trips = {r["trip_id"]: (r["route"], r["status"], r["delay_min"], [(s["stop"], s["eta_utc"]) for s in r["stops"]]) for r in live.trip_rows(delays(fact), due).collect()}
    assert trips["T1"] == ("R7", "late", 2, [("S1", at(5)), ("S2", at(10))]) and trips["T8"] == ("R8", "unknown", None, [("S1", at(3)), (None, at(4))])
    assert set(trips) == {"T1", "T8", "X0", "X1", "X2"}
    board = {(r["stop_id"], r["trip_id"]): (r["k"], r["delay_min"]) for r in live.departures_board(due, delays(fact)).collect()}
    assert board == {("S1", "T1"): (1, 2), ("S1", "X0"): (2, None), ("S2", "T1"): (1, 2), ("S9", "T1"): (1, 2), ("S1", "T8"): (1, None)}


def test_network(spark, fact):
    empty = spark.createDataFrame([], "provider_id string, route_id string, non_responding_count long")
    none = spark.createDataFrame([], "provider_id string, age_seconds long")
    status = live.vehicle_map_with_status(live.vehicle_map(positions(spark), None), delays(fact))
    got = {r["provider_id"]: r for r in live.live_network(status, delays(fact), empty, none).collect()}
    one, two = got["P1"], got["P2"]
    assert (one["vehicles_in_service"], one["on_time_pct"], one["coverage_pct"], one["delay_p50_min"], one["bin4"], one["empty_share"], one["non_responding"], one["feed_freshness_s"]) == (1, 100, 100, 2, 1, 1.0, 0, None)
    assert (two["on_time_pct"], two["coverage_pct"], two["delay_p50_min"], two["bin0"], two["standing_share"]) == (None, 0, None, None, 1.0)
    silent = spark.createDataFrame([("P1", "R2", 1), ("P1", "R1", 3), ("P1", "R3", 3)], "provider_id string, route_id string, non_responding_count long")
    assert {r["provider_id"]: (r["non_responding"], r["non_responding_by_route"]) for r in live.live_network(status, delays(fact), silent, none).collect()} == {"P1": (7, "R1:3,R3:3,R2:1"), "P2": (0, None)}


def test_alert_rows(spark):
    schema = "provider_id string, alert_id string, header string, description string, severity string, cause string, effect string, route_ids string, stop_ids string, active_start timestamp_ntz, active_end timestamp_ntz, header_en string, description_en string, url string, url_en string, active_periods string"
    rows = [("P1", None, None, "d", "Warning ", None, "e", "R1, R2", None, NEW, None, '{"language": "en", "text": "x"}', " ok ", None, "", None), ("P1", "a", "h", None, "odd", None, None, None, "S1", None, None, None, None, "u", None, None)]
    got = {r["severity"]: r for r in live.alert_rows(spark.createDataFrame(rows, schema)).collect()}
    one = got["high"]
    assert (one["header_text"], one["header_en"], one["description_en"], one["routes"], one["stops"], one["url_en"], one["severity_level"]) == ("", None, "ok", ["R1", "R2"], [], None, "Warning ")
    assert one["id"] == "P1-alert-" + hashlib.sha1(b"d|Warning ||e").hexdigest()[:12] and got["watch"]["id"] == "a"


@pytest.mark.parametrize(("column", "value"), [("event_id", "event_id + 599000"), ("ts", "CASE WHEN event_id >= 990 THEN ts - INTERVAL 9 DAY ELSE ts END")])
def test_network_without_vehicles_or_delays(spark, tmp_path, column, value):
    """A newest snapshot without a vehicle on the map gives no row; one without delays counts none in each bin."""
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW source AS SELECT * FROM '{FOLDER}/events.parquet'")
    connection.execute(f"COPY (SELECT * REPLACE ({value} AS {column}) FROM source) TO '{tmp_path}/events.parquet'")
    connection.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    cursor = connection.execute(Q.ORACLE_SQL["t118_live_network"])
    names = [c[0] for c in cursor.description]
    want = [{n: plain(v) for n, v in zip(names, r, strict=True)} for r in cursor.fetchall()]
    got = [{n: plain(r[n]) for n in names} for r in Q.QUERIES["t118_live_network"](spark, str(tmp_path)).collect()]
    assert got == want
