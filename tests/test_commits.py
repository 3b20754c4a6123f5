"""Publication, day builds and replay: what a failure between two writes leaves, and what a second run changes."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from punctua.operators import rollups
from punctua.plans import commits, incremental, snapshot_sink
from punctua.sources import driver_tables as T
from punctua.sources import realtime
from tests.test_sources import field

FOLDER = "/root/testdata/sf0.001"


def day(text):
    return F.lit(text).cast("date")


def payloads(spark, **found):
    return spark.createDataFrame([(k, v) for k, v in found.items()], "rel_key string, payload string")


def seen(spark, root, generation=None):
    return {r["rel_key"]: r["payload"] for r in snapshot_sink.read(spark, root, generation).collect()}


def files(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(f"{root}/objects") for f in names if f.endswith(".txt")}


def test_publication(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/public"
    assert seen(spark, root) == {}
    one = snapshot_sink.publish(payloads(spark, a='{"x": 1}', b="[]", c="[]", d="é\nline\n"), root, "t1")
    assert (one["files"], one["written"], one["previous"]) == (4, 3, None)
    assert seen(spark, root) == {"a": '{"x": 1}', "b": "[]", "c": "[]", "d": "é\nline\n"}
    first = files(root)
    again = snapshot_sink.publish(payloads(spark, d="é\nline\n", c="[]", b="[]", a='{"x": 1}'), root, "t2")
    assert again["unchanged"] and again["generation"] == one["generation"] and files(root) == first
    # a failure after the payloads and before the pointer: the old snapshot stays whole
    with monkeypatch.context() as m:
        m.setattr(snapshot_sink, "move_pointer", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            snapshot_sink.publish(payloads(spark, a='{"x": 2}', b="[]"), root, "t3")
    assert seen(spark, root)["a"] == '{"x": 1}' and len(files(root)) == 4
    two = snapshot_sink.publish(payloads(spark, a='{"x": 2}', b="[]"), root, "t4")
    assert (two["written"], two["previous"]) == (1, one["generation"])
    assert seen(spark, root) == {"a": '{"x": 2}', "b": "[]"} and seen(spark, root, one["generation"])["a"] == '{"x": 1}'
    assert {f: t for f, t in files(root).items() if f in first} == first  # what is unchanged was not written again
    with pytest.raises(snapshot_sink.Conflict):
        snapshot_sink.move_pointer(spark, root, {"generation": "x"}, {"generation": "someone else's"})
    assert seen(spark, root) == {"a": '{"x": 2}', "b": "[]"}
    with pytest.raises(ValueError):
        snapshot_sink.publish(payloads(spark, a="1").union(payloads(spark, a="2")), root, "t5")
    assert snapshot_sink.collected(spark, root, []) == 2 and seen(spark, root) == {"a": '{"x": 2}', "b": "[]"}
    assert [n for n in os.listdir(root) if n.startswith("current")] == ["current.json"]


def test_closed_days(spark, tmp_path, monkeypatch):
    fact, table, marks = T.fact(spark, FOLDER), f"{tmp_path}/spine", f"{tmp_path}/marks"
    first, today = day("2024-01-05"), day("2024-01-10")
    build = lambda: incremental.build_days(spark, fact, table, marks, "stop_spine", rollups.stop_delay_spine, first, today)
    rows = lambda: sorted(map(str, incremental.built_rows(spark, table, marks, "stop_spine").collect()))
    assert [d.day for d in build()] == [5, 6, 7, 8, 9]
    one = rows()
    assert one and build() == []
    incremental.rebuild_days(spark, fact, table, marks, "stop_spine", rollups.stop_delay_spine, day("2024-01-06"), day("2024-01-07"))
    assert rows() == one
    # a rebuild that fails between data and watermark leaves what was there
    real = commits.committed

    def failing(data, path, *_, **more):
        real(data, path, data.select("provider_id").limit(0), f"{tmp_path}/elsewhere", **more)
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(incremental, "committed", failing)
        with pytest.raises(OSError):
            incremental.rebuild_days(spark, fact.where("snapshot_local_date = DATE '2024-02-01'"), table, marks, "stop_spine", rollups.stop_delay_spine, first, today)
    assert rows() == one
    entries = incremental.watermarks_of(spark, marks, "stop_spine").withColumnRenamed("period_start", "day")
    assert commits.dropped_builds(spark, table, entries, ["provider_id", "day"], ["day"]) == 2 and rows() == one
    assert incremental.dropped_partitions(spark, table, day("2024-01-10"), 2) == 3
    assert sorted({r[0].day for r in incremental.built_rows(spark, table, marks, "stop_spine").select("provider_local_date").collect()}) == [8, 9]


def test_failure_before_the_watermark(spark, tmp_path, monkeypatch):
    """Neither repeats nor loses a day: the days are built again, and count once."""
    fact, table, marks = T.fact(spark, FOLDER), f"{tmp_path}/spine", f"{tmp_path}/marks"
    build = lambda: incremental.build_days(spark, fact, table, marks, "k", rollups.stop_delay_spine, day("2024-01-05"), day("2024-01-08"))
    with monkeypatch.context() as m:
        m.setattr(incremental, "committed", lambda data, path, *_, by: (data.withColumn("build", F.lit("dead")).write.mode("append").partitionBy(*by, "build").parquet(path), 1 / 0))
        with pytest.raises(ZeroDivisionError):
            build()
    assert [d.day for d in build()] == [5, 6, 7]
    got = incremental.built_rows(spark, table, marks, "k")
    want = rollups.stop_delay_spine(fact.where("snapshot_local_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-07'"))
    assert sorted(map(str, got.select(*sorted(got.columns)).collect())) == sorted(map(str, want.select(*sorted(want.columns)).collect()))


def test_rollups_in_order(spark, tmp_path):
    """A rollup that reads another is built after it, and only for days that the other has."""
    fact, order = T.fact(spark, FOLDER), []

    def universe(rows):
        order.append("universe")
        return rows.where("route_id IS NOT NULL").groupBy("provider_id", "route_id", F.col("snapshot_local_date").alias("provider_local_date")).agg(F.count_distinct("trip_id").alias("scheduled_trip_count"))

    def cancellation(rows, scheduled):
        order.append("cancellation")
        return rollups.route_cancellation_daily(rows.where("start_date = snapshot_local_date"), scheduled)

    kinds = [incremental.Rollup("cancellation", cancellation, ("universe",)), incremental.Rollup("universe", universe)]
    done = incremental.build_all(spark, fact, str(tmp_path), kinds, day("2024-01-05"), day("2024-01-08"))
    assert order == ["universe", "cancellation"] and {k: [d.day for d in v] for k, v in done.items()} == {"universe": [5, 6, 7], "cancellation": [5, 6, 7]}
    assert incremental.build_all(spark, fact, str(tmp_path), kinds, day("2024-01-05"), day("2024-01-08")) == {"universe": [], "cancellation": []}
    lone = [incremental.Rollup("other", cancellation, ("missing",)), incremental.Rollup("missing", lambda rows: universe(rows))]
    incremental.build_days(spark, fact, f"{tmp_path}/missing", f"{tmp_path}/watermarks", "missing", universe, day("2024-01-06"), day("2024-01-07"))
    later = incremental.build_days(spark, fact, f"{tmp_path}/other", f"{tmp_path}/watermarks", "other", lambda rows: universe(rows), day("2024-01-05"), day("2024-01-08"), incremental.watermarks_of(spark, f"{tmp_path}/watermarks", "missing"))
    assert [d.day for d in later] == [6] and len(lone) == 2


def test_replay(spark, tmp_path, monkeypatch):
    path, ledger = f"{tmp_path}/entities", f"{tmp_path}/ledger"
    at = lambda d, h: dt.datetime(2024, 1, d, h)
    message = lambda *trips: b"".join(field(2, field(1, t) + field(3, field(1, field(1, t)))) for t in trips)
    rows = [("P1", 1, at(1, 5), "succeeded", message(b"T1", b"T2")), ("P1", 2, at(1, 9), "succeeded", message(b"T3")), ("P1", 3, at(2, 1), "succeeded", b"\x12\xff\xff"), ("P1", 4, at(2, 2), "succeeded", b""), ("P1", 5, at(2, 3), "failed", message(b"T9")),
      ("P1", 6, at(3, 1), "succeeded", message(b"T4")), ("P1", 7, at(9, 1), "succeeded", message(b"T5")), ("P1", 8, at(2, 4), "succeeded", message(b"T6"))]
    schema = "provider_id string, rt_feed_snapshot_id long, captured_at_utc timestamp_ntz, status string, content binary"
    captures = spark.createDataFrame([(*r[:4], bytearray(r[4])) for r in rows], schema)
    window = [F.lit(t).cast("timestamp_ntz") for t in (at(1, 0), at(4, 0))]
    trips = lambda: sorted((r["rt_feed_snapshot_id"], r["trip_id"]) for r in realtime.replayed_rows(spark, path, ledger).collect())
    real, calls = commits.committed, []

    def failing(*a, **k):
        calls.append(1)
        if len(calls) == 2:
            real(a[0], a[1], a[2].limit(0), f"{tmp_path}/elsewhere", **k)  # the data lies there, the ledger's entry is lost
            raise OSError("lost")
        return real(*a, **k)

    with monkeypatch.context() as m:
        m.setattr(realtime, "committed", failing)
        with pytest.raises(OSError):
            realtime.replay(spark, captures, path, ledger, *window)
    assert trips() == [(1, "T1"), (1, "T2"), (2, "T3")]
    assert {d.day: n for d, n in realtime.replay(spark, captures, path, ledger, *window).items()} == {2: (2, 1), 3: (1, 0)}
    whole = [(1, "T1"), (1, "T2"), (2, "T3"), (6, "T4"), (8, "T6")]
    assert trips() == whole
    assert {d.day: n for d, n in realtime.replay(spark, captures, path, ledger, *window).items()} == {2: (0, 1)} and trips() == whole
    mended = captures.withColumn("content", F.when(F.col("rt_feed_snapshot_id") == 3, F.lit(bytearray(message(b"T7")))).otherwise(F.col("content")))
    assert {d.day: n for d, n in realtime.replay(spark, mended, path, ledger, *window).items()} == {2: (1, 0)} and (3, "T7") in trips()
    with pytest.raises(Exception, match="IndexError"):
        realtime.decoded(captures).collect()
