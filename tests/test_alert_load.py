"""Alert snapshots: reading JSON, loading with redirects against a plain loop over snapshots, and languages told by marks."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from punctua.operators import alert_load, alerts
from punctua.plans import alert_queries as Q
from punctua.session import stored
from punctua.sources import alert_json
from punctua.sources import driver_tables as T
from tests.test_queries import FOLDER

SCHEMA = "i3_alert_snapshot_id long, provider_id string, captured_at_utc timestamp_ntz, payload string"
DAY = dt.datetime(2024, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_names_and_texts(spark):
    payload = {"messages": [
        {"id": "a1", "header_texts": [{"language": "en", "text": "Hi"}, {"language": "fr-CA", "text": " Allo "}], "active_periods": [{"start": "1704900000"}, {"startTime": "2024-01-02T03:04:05Z", "end": "2024-01-02T03:04:05-05:00"}], "informed_entities": [{"route": "R1", "area": "A"}, {"stopId": "S2", "trip": 5}, "odd"]},
        {"alertId": 7, "title": "[plain] x", "header_texts": "later name", "priority": "high", "routes": ["R1", "R2"], "stops": ["S1", "S2"], "activePeriod": {"start": 17}, "active_periods": [{"start": 18}]},
        {"header": {"en": "E", "fr": "F"}, "description": {"language": "en", "text": "only"}, "url": {"en": {"text": "u-en"}, "fr": "u-fr"}, "routeIds": ["R9"]},
        "odd", {"id": None, "alert_id": "late", "summary": ["", "b"], "stop_ids": ["S3"], "publishedAt": "1704067200", "updated_at": "2024-01-01 00:00:05"},
    ]}
    got = {r["alert_index"]: r for r in alert_json.normalized(frame(spark, [(1, "P1", DAY, json.dumps(payload)), (2, "P1", DAY, "no json"), (3, "P1", DAY, None), (4, "P1", DAY, '{"alerts": 5}')])).collect()}
    assert sorted(got) == [0, 1, 2, 4]
    one, two, three, four = (got[i] for i in (0, 1, 2, 4))
    entity = lambda r: [tuple(e) for e in r["entities"]]
    assert (one["header"], one["header_en"], entity(one)) == ("Allo", "Hi", [("R1", None, None, "A"), (None, "S2", "5", None)])
    assert [tuple(p) for p in one["active_periods"]] == [(dt.datetime(2024, 1, 10, 15, 20), None), (dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 2, 8, 4, 5))]
    # the first name that is there counts, a bare string is of no language, and routes with stops give the first route with each stop
    assert (two["alert_id"], two["header"], two["header_en"], two["severity"], entity(two)) == ("7", "[plain] x", None, "high", [("R1", "S1", None, None), ("R1", "S2", None, None)])
    assert two["active_start"] == dt.datetime(1970, 1, 1, 0, 0, 17) and len(two["active_periods"]) == 1
    assert (three["header"], three["header_en"], three["description"], three["description_en"], three["url"], three["url_en"], entity(three)) == ("F", "E", "only", None, "u-fr", "u-en", [("R9", None, None, None)])
    assert (four["alert_id"], four["header"], entity(four), four["published"], four["updated"]) == (None, "b", [(None, "S3", None, None)], DAY, DAY + dt.timedelta(seconds=5))


def test_languages(spark):
    at = lambda h: DAY + dt.timedelta(hours=h)
    fr, en = {"language": "fr", "text": "x"}, {"language": "EN_us", "text": "y"}
    rows = [
        (1, "P1", at(6), json.dumps([{"id": "a", "header": [fr]}, {"header": [fr], "cause": "c"}, {"header": "bare"}, {"header": {"en": "z", "fr-CA": "w"}}, {"id": "a", "header": [fr, en]}])),
        (2, "P1", at(7), json.dumps([{"header": [fr, en], "cause": "c", "header_text_en": "y"}, {"header": [en]}, {"header": [{"language": "en", "text": "other"}]}, {"description": {"language": "fr", "value": "v"}, "header": "h"}])),
        (3, "P1", at(4), json.dumps([{"id": "a", "header": [en]}])), (4, "P2", at(30), "[]"), (5, "P1", at(8), json.dumps([{"id": "a", "header": [{"language": "fr", "text": " "}]}])),
    ]
    got = alert_json.language_observations(frame(spark, rows), "America/Toronto").collect()
    by_id = {(str(r["observation_date"]), r["alert_logical_id"]): (r["has_fr"], r["has_en"], r["undetermined"]) for r in got}
    assert by_id[("2024-01-01", "id:a")] == (False, False, True) and by_id[("2023-12-31", "id:a")] == (False, True, False)
    marks = sorted(v for (day, i), v in by_id.items() if i.startswith("content:") and day == "2024-01-01")
    # English that came along later is the same alert; two alerts of English alone are two
    assert marks == sorted([(True, True, False), (False, False, True), (True, True, False), (False, True, False), (False, True, False), (True, False, False)])
    days = {(r["provider_id"], str(r["observation_date"])): r["alert_count"] for r in alert_json.feed_observations(frame(spark, rows), "America/Toronto").collect()}
    assert days == {("P1", "2024-01-01"): 1, ("P1", "2023-12-31"): 1, ("P2", "2024-01-02"): 0}


class Plain:
    """One snapshot after the other, as a table with a unique open row a content would do it."""

    def __init__(self):
        self.rows, self.entities, self.periods = [], {}, {}

    def load(self, snapshot, at, alerts):
        seen = {}
        for index, a in enumerate(alerts):
            content = (a["id"], a["header"], tuple(a["periods"]))
            if content in seen:
                continue
            row = next((r for r in self.rows if r["content"] == content and r["valid_to"] is None), None)
            if row:
                row["last_seen"] = at
                row["en"], row["url"] = a["en"] or row["en"], a["url"] or row["url"]
            else:
                row = {"key": (snapshot, index), "content": content, "en": a["en"], "url": a["url"], "first_seen": at, "last_seen": at, "valid_to": None}
                self.rows.append(row)
            seen[content] = row
            for i, e in enumerate(a["entities"]):
                self.entities.setdefault((*row["key"], i), e)
            for i, p in enumerate(a["periods"]):
                self.periods.setdefault((*row["key"], i), p)
        if alerts:
            for r in self.rows:
                if r["valid_to"] is None and r["content"] not in seen:
                    r["valid_to"] = at


def snapshots(seed):
    rng, found = random.Random(seed), []
    for s in range(60):
        at = DAY + dt.timedelta(hours=9 * s + rng.randrange(5))
        alerts = []
        for _ in range(rng.choice([0, 1, 3, 5]) if s % 7 else 0):
            k = rng.randrange(4)
            alerts.append({"id": f"a{k}" if k else None, "header": f"h{k}", "en": rng.choice([None, f"e{rng.randrange(9)}"]), "url": rng.choice([None, f"u{rng.randrange(9)}"]), "periods": [100 + k] * rng.choice([1, 1, 2]), "entities": [f"R{rng.randrange(9)}" for _ in range(rng.randrange(4))]})
        found.append((s + 1, at, alerts))
    return found


@pytest.mark.parametrize("seed, stretch, cuts", [(1, 4, [0, 60]), (2, 1024, [0, 21, 44, 60])])
def test_load(spark, monkeypatch, seed, stretch, cuts):
    """In one batch, and in several with a repeated one."""
    monkeypatch.setattr(alert_load, "STRETCH", stretch)
    plain, rows = Plain(), []
    for s, at, alerts in snapshots(seed):
        plain.load(s, at, alerts)
        told = [{"id": a["id"], "header": [{"language": "fr", "text": a["header"]}, *([{"language": "en", "text": a["en"]}] if a["en"] else [])], "url": a["url"], "activePeriod": [{"start": p} for p in a["periods"]], "informedEntities": [{"routeId": e} for e in a["entities"]]} for a in alerts]
        rows.append((s, "P1", at, json.dumps({"alerts": told})))
    whole = frame(spark, rows + [(s, "P2", at, p) for s, _, at, p in rows[:5]]).repartition(4)
    normal = stored(alert_json.normalized(whole), "test-alerts")

    def state_of(state):
        own = lambda df: df.where("provider_id = 'P1'").collect()
        alerts = sorted(((r["i3_alert_snapshot_id"], r["alert_index"]), r["alert_id"], r["header"], r["header_en"], r["url"], r["first_seen"], r["last_seen"], r["valid_to"]) for r in own(state.alerts))
        entities = {(r["i3_alert_snapshot_id"], r["alert_index"], r["entity_index"]): r["route_id"] for r in own(state.entities)}
        periods = {(r["i3_alert_snapshot_id"], r["alert_index"], r["period_index"]): int((r["start"] - dt.datetime(1970, 1, 1)).total_seconds()) for r in own(state.periods)}
        return alerts, entities, periods

    want = sorted((r["key"], r["content"][0], r["content"][1], r["en"], r["url"], r["first_seen"], r["last_seen"], r["valid_to"]) for r in plain.rows), plain.entities, plain.periods
    assert len({r[1:3] for r in want[0]}) < len(want[0])  # contents come back after they vanished
    state = None
    for a, b in zip(cuts, cuts[1:], strict=False):
        some = lambda df, a=a, b=b: df.where((F.col("i3_alert_snapshot_id") > a) & (F.col("i3_alert_snapshot_id") <= b))
        state = alert_load.loaded(some(normal), some(whole).drop("payload"), state)
        state = alert_load.Loaded(*(stored(part, "test-state") for part in state))
    assert state_of(state) == want
    if len(cuts) > 2:
        assert state_of(alert_load.loaded(some(normal), some(whole).drop("payload"), state)) == want


def test_nothing_that_grows_is_sent_to_the_driver(spark, monkeypatch):
    """Tables of alerts, entities and periods meet by merges, however small they are packed."""
    state = Q.load(spark, FOLDER, Q.BATCHES[:1])
    monkeypatch.setattr(Q, "load", lambda *_: state)
    later = alert_load.loaded(stored(alert_json.normalized(T.alert_snapshots(spark, FOLDER)), "test-again"), T.alert_snapshots(spark, FOLDER).drop("payload"), state)
    for rows in (Q.loaded_rows(spark, FOLDER), alerts.identified(state), alert_load.current(state, F.lit(DAY)), later.entities, later.periods):
        assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()


def test_current(spark):
    key = "provider_id string, i3_alert_snapshot_id long, alert_index int"
    texts = ", ".join(f"{c} string" for c in ("content_hash", "alert_id", "header", "description", "severity", "cause", "effect", "header_en", "description_en", "url", "url_en"))
    times = ", ".join(f"{c} timestamp_ntz" for c in ("active_start", "active_end", "published", "updated", "captured_at_utc", "first_seen", "last_seen", "valid_to"))
    t = lambda h: DAY + dt.timedelta(hours=h)
    row = lambda s, i, description, last, start=None, end=None, closed=None: ("P1", s, i, "h", None, f"head{s}", description, None, None, None, None, None, None, None, start, end, None, None, t(0), t(0), last, closed)
    rows = [row(1, 0, "same", t(5)), row(2, 0, "same", t(3)), row(3, 0, "same", t(9), closed=t(9)), row(4, 0, "ended", t(5), end=t(1)), row(4, 1, "later", t(5), start=t(50)), row(4, 2, "bare", t(5), start=t(1), end=t(9))]
    alerts = spark.createDataFrame(rows, ", ".join((key, texts, times)))
    entities = spark.createDataFrame([("P1", 1, 0, 0, "R2", None, None, None), ("P1", 1, 0, 1, "R1", "S1", None, None), ("P1", 2, 0, 0, "R9", None, None, None)], f"{key}, entity_index int, route_id string, stop_id string, trip_id string, area_id string")
    periods = spark.createDataFrame([("P1", 1, 0, 1, t(4), None), ("P1", 1, 0, 0, t(1), t(2))], f"{key}, period_index int, start timestamp_ntz, end timestamp_ntz")
    got = {r["description"]: r for r in alert_load.current(alert_load.Loaded(alerts, entities, periods), F.lit(t(6)).cast("timestamp_ntz")).collect()}
    assert set(got) == {"same", "bare"}
    one = got["same"]
    assert (one["header"], one["route_ids"], one["stop_ids"], one["route_count"], one["entity_count"]) == ("head1", "R1, R2", "S1", 2, 2)
    assert json.loads(one["active_periods"]) == [{"start_utc": "2024-01-01 01:00:00", "end_utc": "2024-01-01 02:00:00"}, {"start_utc": "2024-01-01 04:00:00"}]
    assert (got["bare"]["route_ids"], got["bare"]["entity_count"], got["bare"]["active_periods"]) == (None, 0, None)
