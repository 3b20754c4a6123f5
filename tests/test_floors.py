"""The registered rankings and scores leave out what has fewer than 30 observations, on facts with enough of them."""

import pytest
from pyspark.sql import functions as F

from punctua.constants import RATE_FLOOR
from punctua.plans import read_queries as R
from punctua.sources import driver_tables as T


FACT = T.fact


@pytest.fixture
def seen(spark):
    """Observations of one hour: 18 stops with 60 observations and 10 with 20, of which all are late."""
    rows = [(s, i) for s in range(18) for i in range(60)] + [(100 + s, i) for s in range(10) for i in range(20)]
    return spark.createDataFrame(rows, "s int, i int")


def fact(spark, rows):
    base = FACT(spark, "/root/testdata/sf0.001").where("route_id IS NOT NULL").limit(1).drop("delay_stop_id", "delay_seconds", "route_id")
    few = F.col("s") >= 100
    late = few | (F.col("i") < F.col("s"))
    return rows.crossJoin(base).withColumn("delay_stop_id", F.concat(F.lit("S"), "s")).withColumn("delay_seconds", F.when(late, 900).otherwise(0)).withColumn("route_id", F.when(few, "R2").otherwise("R1"))


def test_weak_stops(spark, seen, monkeypatch):
    monkeypatch.setattr(T, "fact", lambda spark, d: fact(spark, seen).withColumn("route_id", F.lit("R1")))
    got = R.QUERIES["t93_weak_stops"](spark, "").where("window_grain = 'month'").orderBy("rank").collect()
    assert [r["stop_id"] for r in got] == [f"S{s}" for s in range(17, 2, -1)]
    assert min(r["obs"] for r in got) >= RATE_FLOOR


def test_habits_windowed(spark, seen, monkeypatch):
    monkeypatch.setattr(T, "fact", lambda spark, d: fact(spark, seen.where("s in (1, 100)")))
    got = {r["route_id"]: (r["known_obs"], r["score"], r["share"]) for r in R.QUERIES["t84_habits_windowed"](spark, "").collect()}
    assert got["R1"][0] == 60 and got["R1"][1] > 0 and got["R1"][2] == 1.0
    assert got["R2"] == (20, None, None)
