"""Live feeds: protobuf messages to rows, with absent fields as NULL."""

from __future__ import annotations

import json
import struct
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from punctua.plans.commits import committed, ledger_of, visible
from punctua.session import shipped, stored

#: Field numbers of the public feed format.
ENTITY, HEADER = 2, 1
TRIP_UPDATE, VEHICLE = 3, 4
UNDECODABLE = "undecodable"
SCHEMA = """entity_index int, entity_id string, kind string, is_deleted boolean, trip_id string, route_id string, direction_id int, start_date string, schedule_relationship int, vehicle_id string,
  stop_time_updates array<struct<stop_sequence int, stop_id string, arrival long, departure long, schedule_relationship int>>, latitude float, longitude float, bearing float, speed float, occupancy_status int, timestamp long"""


def fields(data: bytes) -> dict[int, list]:
    """A message's values by field number: integers, 4- and 8-byte values and byte strings."""
    found, at = defaultdict(list), 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            found[tag >> 3].append(varint())
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            found[tag >> 3].append(data[at : at + size])
            at += size
        elif kind == 2:
            size = varint()
            found[tag >> 3].append(data[at : at + size])
            at += size
        else:
            raise ValueError(f"wire type {kind}")
    return found


def entities(data: bytes) -> Iterator[tuple]:
    """The rows of one feed message."""
    one = lambda m, n: m[n][-1] if m.get(n) else None
    text = lambda m, n: one(m, n).decode() if one(m, n) is not None else None
    sub = lambda m, n: fields(one(m, n)) if one(m, n) is not None else {}
    real = lambda m, n: struct.unpack("<f", one(m, n))[0] if one(m, n) is not None else None
    signed = lambda v: v - (1 << 64) if v is not None and v >> 63 else v
    for i, raw in enumerate(fields(data).get(ENTITY, [])):
        e = fields(raw)
        update, vehicle = sub(e, TRIP_UPDATE), sub(e, VEHICLE)
        body = update or vehicle
        trip, place = sub(body, 1), sub(vehicle, 2)
        car = sub(update, 3) if update else sub(vehicle, 8)
        stops = [(one(s, 1), text(s, 4), signed(one(sub(s, 2), 2)), signed(one(sub(s, 3), 2)), one(s, 5)) for s in map(fields, update.get(2, []))] if update else None
        deleted = one(e, 2)
        yield (
            i, text(e, 1), "trip_update" if update else "vehicle" if vehicle else "other", None if deleted is None else bool(deleted), text(trip, 1), text(trip, 5), one(trip, 6), text(trip, 3), one(trip, 4), text(car, 1),
            stops, *(real(place, n) for n in (1, 2, 3, 5)), one(vehicle, 9), one(update, 4) if update else one(vehicle, 5),
        )


def decoded(captures: DataFrame, strict: bool = True) -> DataFrame:
    """captures (provider_id, rt_feed_snapshot_id, content) as one row an entity. Messages are parsed in Arrow batches on the executors.

    A message that cannot be parsed ends the job; if not strict, it gives one row of kind `undecodable`."""
    names = ["entity_index", "entity_id", "kind", "is_deleted", "trip_id", "route_id", "direction_id", "start_date", "schedule_relationship", "vehicle_id", "stop_time_updates", "latitude", "longitude", "bearing", "speed", "occupancy_status", "timestamp"]

    shipped(captures.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for provider, snapshot, content in zip(batch["provider_id"], batch["rt_feed_snapshot_id"], batch["content"], strict=True):
                try:
                    rows = list(entities(bytes(content)))
                except (IndexError, ValueError, TypeError, struct.error):
                    if strict:
                        raise
                    rows = [(0, None, UNDECODABLE, *[None] * (len(names) - 3))]
                if rows:
                    out = pd.DataFrame(rows, columns=names, dtype=object)
                    out.insert(0, "provider_id", provider)
                    out.insert(1, "rt_feed_snapshot_id", snapshot)
                    yield out

    return captures.select("provider_id", "rt_feed_snapshot_id", "content").mapInPandas(run, f"provider_id string, rt_feed_snapshot_id long, {SCHEMA}")


#: Field numbers of an alert and of its parts, and the names of its numbered values.
ALERT, PERIODS, SELECTORS = 5, 1, 5
TEXTS = {"header": 10, "description": 11, "url": 8}
SELECTOR = {"agencyId": 1, "routeId": 2, "stopId": 5}
NAMES = {
    "cause": (6, "UNKNOWN_CAUSE OTHER_CAUSE TECHNICAL_PROBLEM STRIKE DEMONSTRATION ACCIDENT HOLIDAY WEATHER MAINTENANCE CONSTRUCTION POLICE_ACTIVITY MEDICAL_EMERGENCY"),
    "effect": (7, "NO_SERVICE REDUCED_SERVICE SIGNIFICANT_DELAYS DETOUR ADDITIONAL_SERVICE MODIFIED_SERVICE OTHER_EFFECT UNKNOWN_EFFECT STOP_MOVED NO_EFFECT ACCESSIBILITY_ISSUE"),
    "severity": (14, "UNKNOWN_SEVERITY INFO WARNING SEVERE"),
}


def alert_payload(data: bytes) -> str | None:
    """A feed message's alerts as the JSON that alert snapshots hold; None without an alert. Absent fields are left out, numbers without a name stay numbers."""
    text = lambda m, n: m[n][-1].decode("utf-8", "replace") if m.get(n) else ""
    message, found = fields(data), []
    for raw in message.get(ENTITY, []):
        entity = fields(raw)
        if not entity.get(ALERT):
            continue
        alert = fields(entity[ALERT][-1])
        row: dict = {"id": text(entity, 1) or None}
        for name, n in TEXTS.items():
            if alert.get(n):
                each = [(text(t, 1), text(t, 2)) for t in map(fields, fields(alert[n][-1]).get(1, []))]
                row[name] = [{"text": t} | ({"language": language} if language else {}) for t, language in each if t]
        for name, (n, names) in NAMES.items():
            if alert.get(n):
                value, known = alert[n][-1], dict(enumerate(names.split(), 1))
                row[name] = known.get(value, str(value))
        periods = [{k: p[n][-1] for k, n in (("start", 1), ("end", 2)) if p.get(n)} for p in map(fields, alert.get(PERIODS, []))]
        if any(periods):
            row["activePeriod"] = [p for p in periods if p]
        row["informedEntities"] = []
        for s in map(fields, alert.get(SELECTORS, [])):
            selector: dict = {k: text(s, n) for k, n in SELECTOR.items() if text(s, n)}
            trip = fields(s[4][-1]) if s.get(4) else {}
            selector |= {"tripId": text(trip, 1)} if text(trip, 1) else {}
            selector |= {"routeType": s[3][-1]} if s.get(3) else {}
            if selector:
                row["informedEntities"].append(selector)
        found.append(row)
    header = fields(message[HEADER][-1]) if message.get(HEADER) else {}
    stamp = header[3][-1] if header.get(3) else None
    return json.dumps({"gtfsRealtimeVersion": text(header, 1) or None, "timestamp": stamp, "alerts": found}) if found else None


def alert_snapshots(captures: DataFrame) -> DataFrame:
    """captures (provider_id, rt_feed_snapshot_id, captured_at_utc, content) whose messages hold alerts, as snapshots for alert_json.alerts()."""
    shipped(captures.sparkSession)

    @F.pandas_udf("string")
    def payload(content: pd.Series) -> pd.Series:
        return content.map(lambda c: None if c is None else alert_payload(bytes(c)))

    rows = captures.select(F.col("rt_feed_snapshot_id").alias("i3_alert_snapshot_id"), "provider_id", "captured_at_utc", payload("content").alias("payload"))
    return rows.where("payload IS NOT NULL")


def stop_time_updates(rows: DataFrame) -> DataFrame:
    """One row a stop time update, with predicted instants."""
    instant = lambda c: F.timestamp_add("SECOND", F.col(c), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    each = rows.where("kind = 'trip_update'").select("provider_id", "rt_feed_snapshot_id", "entity_index", "trip_id", "route_id", F.to_date("start_date", "yyyyMMdd").alias("start_date"), F.posexplode("stop_time_updates").alias("stop_time_update_index", "u"))
    each = each.select("*", "u.stop_sequence", "u.stop_id", "u.arrival", "u.departure", "u.schedule_relationship").drop("u")
    return each.withColumns({"arrival_utc": instant("arrival"), "departure_utc": instant("departure")}).drop("arrival", "departure")


#: The ledger of loaded captures.
LOADED = "provider_id string, rt_feed_snapshot_id long, captured_at_utc timestamp_ntz, build string, committed_at timestamp"
CAPTURE = ("provider_id", "rt_feed_snapshot_id")


def replayed(captures: DataFrame, loaded: DataFrame, first: Column, until: Column) -> DataFrame:
    """Succeeded captures of [first, until) that no loaded snapshot covers."""
    rows = captures.where((F.col("status") == "succeeded") & (F.col("captured_at_utc") >= first) & (F.col("captured_at_utc") < until))
    return rows.join(loaded.select(*CAPTURE).distinct(), list(CAPTURE), "left_anti")


def replay(spark: SparkSession, captures: DataFrame, path: str, ledger: str, first: Column, until: Column) -> dict:
    """Loads the captures (provider_id, rt_feed_snapshot_id, captured_at_utc, status, content) of a window that are not loaded yet; gives the numbers of loaded and broken captures by day.

    Days are loaded in order, each in one commit of its entities and its ledger entries, so a second run changes nothing and a run that was stopped goes on at the day
    at which it stopped. A capture that cannot be parsed is left out of the ledger: it is tried again by the next run, and holds up no other."""
    todo = replayed(captures, ledger_of(spark, ledger, LOADED), first, until).withColumn("day", F.to_date("captured_at_utc"))
    done = {}
    for day in sorted(r["day"] for r in todo.select("day").distinct().collect()):
        part = todo.where(F.col("day") == F.lit(day))
        rows = stored(decoded(part, strict=False), "replay")
        broken = rows.where(F.col("kind") == UNDECODABLE).select(*CAPTURE)
        entries = part.select(*CAPTURE, "captured_at_utc").join(broken, list(CAPTURE), "left_anti")
        committed(rows.where(F.col("kind") != UNDECODABLE).withColumn("day", F.lit(day)), path, entries, ledger, by=["day"])
        done[day] = (entries.count(), broken.count())
    return done


def replayed_rows(spark: SparkSession, path: str, ledger: str) -> DataFrame:
    """The entities of all loaded captures, each once."""
    return visible(spark, path, ledger_of(spark, ledger, LOADED), CAPTURE).drop("day")
