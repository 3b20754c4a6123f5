"""Sources, incremental builds, publication and streams on built files."""

import datetime as dt
import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from punctua.operators import rollups
from punctua.plans import incremental, publish
from punctua.sources import alert_json, gtfs, realtime, shapefile
from punctua.sources import driver_tables as T
from punctua.streaming import live as streaming

FOLDER = "/root/testdata/sf0.001"
MEMBERS = {
    "routes.txt": "route_id,route_type,route_short_name\nR1,3,\n", "trips.txt": "route_id,service_id,trip_id\nR1,WD,T1\n", "stops.txt": 'stop_id,stop_name,stop_lat,stop_lon\nS1,"A, B",45.5,x\n',
    "stop_times.txt": "trip_id,stop_id,stop_sequence,departure_time\nT1,S1,1,25:10:00\n", "calendar_dates.txt": "service_id,date,exception_type\nWD,20240110,1\n", "extra.txt": "a,b\n1,2\n",
}


def archive(path, members):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in members.items():
            z.writestr(f"feed/{name}", text)
    return str(path)


def test_archive(spark, tmp_path):
    got = gtfs.read_archive(spark, archive(tmp_path / "a.zip", MEMBERS), "P1")
    assert got.members["routes"].select("route_type", "route_short_name", "agency_id").first() == (3, None, "P1")
    assert got.members["stops"].select("stop_name", "stop_lat", "stop_lon").first() == ("A, B", 45.5, None)
    assert got.members["calendar_dates"].first()["service_date"] == dt.date(2024, 1, 10)
    assert json.loads(got.unknown["extra"].first()["row"]) == {"a": "1", "b": "2"}


def test_archive_contract(spark, tmp_path):
    with pytest.raises(ValueError, match="lacks"):
        gtfs.read_archive(spark, archive(tmp_path / "b.zip", {k: v for k, v in MEMBERS.items() if k != "trips.txt"}), "P1")
    with pytest.raises(ValueError, match="calendar"):
        gtfs.read_archive(spark, archive(tmp_path / "c.zip", {k: v for k, v in MEMBERS.items() if k != "calendar_dates.txt"}), "P1")
    broken = archive(tmp_path / "d.zip", MEMBERS | {"shapes.txt": "shape_id\nx\n"})
    with pytest.raises(ValueError, match="shapes"):
        gtfs.read_archive(spark, broken, "P1")
    assert gtfs.read_archive(spark, broken, "P1", strict=False).warnings
    with pytest.raises(ValueError, match="two members"):
        gtfs.read_archive(spark, archive(tmp_path / "e.zip", MEMBERS | {"sub/Routes.txt": "x"}), "P1")


def test_archive_records(spark, tmp_path):
    """Quoted line breaks and separators stay in their field; short, long and blank records, an empty member and a header with spaces are defined."""
    stops = '\ufeffstop_id, stop_name,stop_lat,stop_id\r\nS1,"two\nlines ""q""",45.5,again\r\n\r\nS2,a\u2028b\r\nS3,c,1.0,x,beyond\r\n'
    got = gtfs.read_archive(spark, archive(tmp_path / "f.zip", MEMBERS | {"stops.txt": stops, "shapes.txt": ""}), "P1", strict=False)
    assert got.members["stops"].columns == ["provider_id", "stop_id", "stop_name", "stop_lat"]
    assert sorted(map(tuple, got.members["stops"].collect())) == [("P1", "S1", 'two\nlines "q"', 45.5), ("P1", "S2", "a\u2028b", None), ("P1", "S3", "c", 1.0)]
    assert "shapes" not in got.members and len(got.warnings) == 1


def varint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def field(n, value):
    if isinstance(value, int):
        return varint(n << 3) + varint(value)
    if isinstance(value, float):
        return varint(n << 3 | 5) + struct.pack("<f", value)
    return varint(n << 3 | 2) + varint(len(value)) + value


def test_realtime(spark):
    trip = field(1, b"T1") + field(5, b"R1") + field(3, b"20240110")
    stop = field(1, 4) + field(4, b"S1") + field(2, field(2, 1704900000)) + field(5, 1)
    update = field(1, b"e1") + field(3, field(1, trip) + field(2, stop) + field(4, 1704899999))
    vehicle = field(1, b"e2") + field(4, field(1, field(1, b"T2")) + field(2, field(1, 45.5) + field(2, -73.5)) + field(8, field(1, b"V9")) + field(9, 0))
    captures = spark.createDataFrame([("P1", 7, bytearray(field(2, update) + field(2, vehicle)))], "provider_id string, rt_feed_snapshot_id long, content binary")
    rows = {r["entity_id"]: r for r in realtime.decoded(captures).collect()}
    assert rows["e1"]["trip_id"] == "T1" and rows["e1"]["direction_id"] is None and rows["e1"]["timestamp"] == 1704899999
    assert rows["e2"]["vehicle_id"] == "V9" and rows["e2"]["latitude"] == 45.5 and rows["e2"]["occupancy_status"] == 0 and rows["e2"]["bearing"] is None
    u = realtime.stop_time_updates(realtime.decoded(captures)).first()
    assert (u["stop_sequence"], u["schedule_relationship"], str(u["arrival_utc"]), u["departure_utc"], u["start_date"]) == (4, 1, "2024-01-10 15:20:00", None, dt.date(2024, 1, 10))


def test_realtime_alerts(spark):
    """Alerts of a feed message come out as those of a JSON snapshot: names or numbers, all translations, periods and selectors."""
    words = lambda *pairs: b"".join(field(1, field(1, t) + (field(2, language) if language else b"")) for t, language in pairs)
    alert = field(1, field(1, 1704900000)) + field(1, b"") + field(1, field(2, 1704990000)) + field(5, field(2, b"R1") + field(5, b"S1")) + field(5, b"") + field(5, field(4, field(1, b"T1")) + field(3, 3))
    alert += field(6, 4) + field(7, 99) + field(14, 3) + field(10, words((b"Allo", b"fr"), (b"Hi", b"en"))) + field(11, words((b"plain", b""), (b"", b"fr")))
    message = field(1, field(1, b"2.0") + field(3, 1704899999)) + field(2, field(1, b"a1") + field(5, alert)) + field(2, field(1, b"t") + field(3, field(4, 1)))
    payload = json.loads(realtime.alert_payload(message))
    assert (payload["gtfsRealtimeVersion"], payload["timestamp"]) == ("2.0", 1704899999)
    assert payload["alerts"] == [{
        "id": "a1", "header": [{"text": "Allo", "language": "fr"}, {"text": "Hi", "language": "en"}], "description": [{"text": "plain"}], "cause": "STRIKE", "effect": "99", "severity": "WARNING",
        "activePeriod": [{"start": 1704900000}, {"end": 1704990000}], "informedEntities": [{"routeId": "R1", "stopId": "S1"}, {"tripId": "T1", "routeType": 3}],
    }]
    schema = "provider_id string, rt_feed_snapshot_id long, captured_at_utc timestamp_ntz, content binary"
    captures = spark.createDataFrame([("P1", 1, dt.datetime(2024, 1, 10), bytearray(message)), ("P1", 2, dt.datetime(2024, 1, 10), bytearray(b"")), ("P1", 3, None, None)], schema)
    rows = alert_json.alerts(realtime.alert_snapshots(captures)).collect()
    got = sorted([(r["i3_alert_snapshot_id"], r["alert_id"], r["header"], r["header_en"], r["description"], r["cause"], r["route_id"], r["stop_id"], r["trip_id"], len(r["active_periods"])) for r in rows], key=str)
    assert got == [(1, "a1", "Allo", "Hi", "plain", "STRIKE", "R1", "S1", None, 2), (1, "a1", "Allo", "Hi", "plain", "STRIKE", None, None, "T1", 2)]


def test_line_match(spark):
    features = spark.createDataFrame([("f1", {"shape_id": "H1", "route_id": "R1"}), ("f2", {"shape_id": "?", "route_id": "R1"}), ("f3", {"route_id": " "}), ("f4", {})], "feature_id string, attributes map<string,string>").withColumn("points", F.array())
    trips = spark.createDataFrame([("H1",), ("H1",), (None,)], "shape_id string")
    routes = spark.createDataFrame([("R1",), ("R2",)], "route_id string")
    assert sorted(tuple(r)[:3] for r in shapefile.matched_lines(features, trips, routes).collect()) == [("f1", "H1", "shape_id"), ("f2", "R1", "route_id")]


def test_alert_json(spark):
    payload = {"messages": [{"id": "a1", "header_texts": [{"language": "en", "text": "Hi"}, {"language": "fr", "text": "Allo"}], "active_periods": [{"start": "1704900000", "end": None}], "informed_entities": [{"route_id": "R1"}, {"stopId": "S2"}]}, {"alertId": "a2", "title": "plain"}]}
    frame = spark.createDataFrame([(1, "P1", dt.datetime(2024, 1, 1), json.dumps(payload))], "i3_alert_snapshot_id long, provider_id string, captured_at_utc timestamp_ntz, payload string")
    rows = [(r["alert_id"], r["header"], r["header_en"], r["route_id"], r["stop_id"], r["active_start"] and str(r["active_start"])) for r in alert_json.alerts(frame).collect()]
    assert sorted(rows, key=str) == sorted([("a1", "Allo", "Hi", "R1", None, "2024-01-10 15:20:00"), ("a1", "Allo", "Hi", None, "S2", "2024-01-10 15:20:00"), ("a2", "plain", None, None, None, None)], key=str)


def test_shapefile(spark, tmp_path):
    point = struct.pack(">ii", 1, 10) + struct.pack("<i2d", 1, -73.5, 45.5)
    shp = b"\0" * 100 + point * 2
    dbf = bytearray(32) + b"stop_code\0\0" + b"C" + b"\0" * 4 + bytes([4]) + b"\0" * 15 + b"\r"
    dbf[4:12] = struct.pack("<IHH", 2, len(dbf), 5)
    dbf = bytes(dbf) + b" 17  " + b" 99  "
    with zipfile.ZipFile(tmp_path / "s.zip", "w") as z:
        for end, data in (("shp", shp), ("dbf", dbf), ("prj", b'GEOGCS["GCS_WGS_1984"]')):
            z.writestr(f"stops.{end}", data)
    features = shapefile.read_features(spark, str(tmp_path / "s.zip"))
    assert [r["epsg"] for r in features.collect()] == [4326, 4326]
    stops = spark.createDataFrame([("S1", "17")], "stop_id string, stop_code string")
    assert [(r["stop_id"], r["matched_by"], r["points"][0]["lat"]) for r in shapefile.matched_stops(features, stops).collect()] == [("S1", "stop_code", 45.5)]


def test_editions(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    ledger = spark.createDataFrame([("P1", "static", 1, "aa", True, t(1), t(1)), ("P2", "static", 4, "zz", True, t(1), t(1))], "provider_id string, dataset_kind string, dataset_version_id long, checksum string, is_current boolean, loaded_at_utc timestamp_ntz, last_seen_utc timestamp_ntz")
    captures = spark.createDataFrame([("P1", "static", "bb", t(2)), ("P2", "static", "zz", t(3)), ("P3", "static", "n", t(2))], "provider_id string, dataset_kind string, checksum string, captured_at_utc timestamp_ntz")
    got = {(r["provider_id"], r["dataset_version_id"]): (r["checksum"], r["is_current"], r["last_seen_utc"].day) for r in incremental.captured(ledger, captures).collect()}
    assert got == {("P1", 1): ("aa", False, 1), ("P1", 2): ("bb", True, 2), ("P2", 4): ("zz", True, 3), ("P3", 1): ("n", True, 2)}


def test_publication(spark):
    rows = spark.createDataFrame([("R1", 2, 90.0), ("R1", 1, 95.0), ("R2", 1, None)], "route_id string, n int, otp_pct double")
    found = publish.payloads(rows, ["route_id"], ["n"])
    one = found.where("route_id = 'R1'").first()
    assert [x["n"] for x in json.loads(one["payload"])] == [1, 2]
    assert [r["route_id"] for r in publish.changed(found, found.where("route_id = 'R1'"), ["route_id"]).collect()] == ["R2"]
    rates = spark.createDataFrame([("R1", 120.0, 50.0, 10), ("R2", 1.0, 101.0, 0)], "route_id string, avg_delay_min double, otp_pct double, known_obs long")
    gate = {r["check"]: r["failures"] for r in publish.gate(rates, 100, 60, spark.createDataFrame([("R1",), ("R9",)], "route_id string"), "route_id").collect()}
    assert gate == {"delay_bounds": 1, "otp_bounds": 1, "rate_without_evidence": 1, "empty_share": 0, "file_drop": 1, "id_drift": 1}
    paged = publish.pages(spark.createDataFrame([("k", i, 40) for i in range(5)], "k string, i int, byte_count int"), ["k"], [F.col("i")], 100)
    rows = [(r["page"], r["byte_count"]) for r in paged.orderBy("i").collect()]
    pages = [p for p, _ in rows]
    assert len(rows) == 5 and pages == sorted(pages) and sorted(set(pages)) == list(range(pages[-1] + 1))
    assert all(sum(b for p, b in rows if p == page) <= 100 for page in pages)


def test_stream(spark, tmp_path):
    fact = T.fact(spark, FOLDER).where("snapshot_local_date < DATE '2024-01-04'")
    fact.union(fact.limit(20)).coalesce(2).write.parquet(f"{tmp_path}/facts")  # repeated rows
    streaming.run_summary(spark, f"{tmp_path}/facts", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out")
    want = rollups.trip_delay_summary_5m(fact)
    last = got.agg(F.max("period_start_utc")).first()[0]
    columns = ["route_id", "trip_count", "observation_count", "delay_observation_count", "on_time_observation_count", "delayed_trip_count"]
    final = want.where(F.col("period_start_utc") <= F.lit(last).cast("timestamp_ntz"))
    assert sorted(map(tuple, got.select(F.col("period_start_utc").cast("string"), *columns).collect())) == sorted(map(tuple, final.select(F.col("period_start_utc").cast("string"), *columns).collect()))
    seen = []
    streaming.run_batches(spark, f"{tmp_path}/facts", f"{tmp_path}/check2", lambda rows, _: seen.append(rows.count())).awaitTermination(120)
    assert sum(seen) == fact.count()
