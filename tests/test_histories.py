"""Histories, identities and page generations by hand."""

import datetime as dt
import hashlib

from pyspark.sql import functions as F

from punctua.operators import alert_load, alerts, histories
from punctua.plans import publish

DAY = dt.date(2024, 1, 10)


def day(n):
    return DAY + dt.timedelta(days=n)


def test_stop_history(spark):
    delay = spark.createDataFrame([("S1", day(0), 10, 1, 600), ("S1", day(0), 10, 0, 0), ("S1", day(1), 5, 5, 3000), ("S1", day(-40), 9, 9, 9), ("S1", day(2), 7, 0, 0), ("", day(0), 1, 1, 1), (None, day(0), 1, 1, 1)], "stop_id string, provider_local_date date, observation_count long, severe_delay_count long, sum_delay_seconds long")
    median = spark.createDataFrame([("S1", day(0), 60.0, 90.0), ("S2", day(1), 5.0, 6.0)], "stop_id string, provider_local_date date, p50_delay_seconds double, p90_delay_seconds double")
    bands = spark.createDataFrame([("S1", day(0), 4, 0)], "stop_id string, provider_local_date date, observation_count long, empty_count long")
    metrics = histories.stop_metrics(*(r.withColumn("provider_id", F.lit("P1")) for r in (delay, median, bands)))
    key, today = ["provider_id", "stop_id"], F.lit(day(2))
    found = histories.range_history(metrics, key, today, 30)
    rows = {(r["stop_id"], r["provider_local_date"]): r for r in found.collect()}
    assert set(rows) == {("S1", day(0)), ("S1", day(1)), ("S2", day(1))}  # the open day and those before the limit are out
    one, two = rows["S1", day(0)], rows["S1", day(1)]
    assert (one["observation_count"], one["p50_delay_seconds"], one["empty_count"], one["has_occupancy"], one["month"]) == (20, 60.0, 0, True, "2024-01")
    assert (two["p50_delay_seconds"], two["empty_count"], two["has_occupancy"], two["has_delay"]) == (None, None, False, True)
    cover = {(r["stop_id"], r["metric"]): (r["mode"], r["first_date"], r["last_date"], r["day_count"]) for r in histories.metric_coverage(metrics, found, key).collect()}
    assert cover == {("S1", "delay"): ("additive", day(0), day(1), 2), ("S1", "delay_percentiles"): ("daily_only", day(0), day(0), 1), ("S1", "occupancy"): ("additive", day(0), day(0), 1), ("S2", "delay_percentiles"): ("daily_only", day(1), day(1), 1)}
    pool = lambda a, b: {r["stop_id"]: r for r in histories.rated(histories.pooled(metrics, found, key, F.lit(a), F.lit(b))).collect()}
    both, alone = pool(day(0), day(1))["S1"], pool(day(0), day(0))["S1"]
    assert (both["day_count"], both["observation_count"], both["severe_pct"], both["avg_delay_min"], both["p50_delay_seconds"]) == (2, 25, 24.0, 2.4, None)
    assert (alone["p50_delay_seconds"], alone["p90_delay_seconds"], alone["observation_count"]) == (60.0, 90.0, 20)


def test_identities(spark):
    t = lambda h: dt.datetime(2024, 1, 10, h)
    texts = "provider_id string, i3_alert_snapshot_id long, alert_index int, header string, severity string, description string, header_en string, cause string, effect string, url string, active_start timestamp_ntz, active_end timestamp_ntz"
    rows = [("P1", 1, 0, "h", "low", None, None, None, None, None, t(1), t(3)), ("P1", 9, 0, "h", "sev", None, "e", None, None, "u", t(1), t(3)), ("P1", 2, 0, None, None, None, None, None, None, None, t(5), t(4)), ("P1", 3, 0, "x", None, None, None, None, None, None, None, None)]
    periods = [("P1", 1, 0, 0, t(1), t(3)), ("P1", 1, 0, 1, t(6), t(7)), ("P1", 9, 0, 1, t(6), t(8)), ("P1", 1, 0, 2, t(9), None), ("P1", 2, 0, 0, t(5), t(4))]
    state = alert_load.Loaded(spark.createDataFrame(rows, texts), None, spark.createDataFrame(periods, "provider_id string, i3_alert_snapshot_id long, alert_index int, period_index int, start timestamp_ntz, end timestamp_ntz"))
    got = {r["header"]: r for r in alerts.identified(state).collect()}
    assert len(got) == 3
    one = got["h"]
    basis = "h|sev|2024-01-10 01:00:00+00:00|2024-01-10 03:00:00+00:00"
    assert (one["id"], one["duration_min"], one["header_en"], one["url"]) == ("P1-alert-" + hashlib.sha1(basis.encode()).hexdigest()[:12], 120, "e", "u")
    assert one["active_periods"] == "0:2024-01-10 01:00:00/2024-01-10 03:00:00,1:2024-01-10 06:00:00/2024-01-10 08:00:00,2:2024-01-10 09:00:00/"
    assert (got[None]["duration_min"], got["x"]["duration_min"], got["x"]["active_periods"]) == (None, None, "")


def test_generations(spark):
    frame = lambda **found: spark.createDataFrame([(k, 0, v * 8) for k, v in found.items()], "k string, page int, content_hash string")
    got = {r["k"]: tuple(r)[2:] for r in publish.generations(frame(a="aaaa", b="bbbb", c="cccc"), frame(a="aaaa", b="xxxx", d="dddd"), ["k", "page"]).collect()}
    assert got == {"a": ("a" * 16, "a" * 16, "kept"), "b": ("b" * 16, "x" * 16, "changed"), "c": ("c" * 16, None, "new"), "d": (None, "d" * 16, "gone")}
