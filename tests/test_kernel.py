"""Golden numbers of the metric kernel."""

import pytest
from pyspark.sql import functions as F

from punctua.constants import DELAY_EDGES, GAP_EDGES
from punctua.functions import kernel as K


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def hist(n, **counts):
    return F.array(*(F.lit(counts.get(f"b{i}", 0)).cast("long") for i in range(n)))


@pytest.mark.parametrize("x, digits, want", [(2.5, 0, 3), (-2.5, 0, -3), (0.625, 2, 0.63), (7.45, 1, 7.5), (0.25, 1, 0.3)])
def test_half_away(spark, x, digits, want):
    assert value(spark, K.half_away(F.lit(x), digits)) == want


@pytest.mark.parametrize("bins, q, want", [({"b20": 5}, 0.5, 60.0), ({"b0": 5}, 0.5, -32.5), ({"b7": 1, "b8": 1}, 0.5, 0.5), ({"b7": 1, "b8": 1}, 0.9, 0.9), ({"b10": 6, "b11": 4}, 0.5, 1.9), ({"b10": 6, "b11": 4}, 0.9, 2.4), ({}, 0.5, None)])
def test_delay_percentile(spark, bins, q, want):
    assert value(spark, K.delay_percentile_minutes(hist(21, **bins), q, DELAY_EDGES)) == want


@pytest.mark.parametrize("bins, q, want", [({"b19": 5}, 0.5, 210), ({"b19": 5}, 0.9, 234), ({"b0": 5}, 0.5, 0.25), ({"b7": 1, "b8": 1}, 0.5, 8.0), ({"b7": 1, "b8": 1}, 0.9, 9.6)])
def test_gap_percentile(spark, bins, q, want):
    assert value(spark, K.histogram_percentile(hist(20, **bins), q, GAP_EDGES)) == pytest.approx(want)


def test_rates(spark):
    low, high = K.wilson(F.lit(50), F.lit(100))
    assert (value(spark, low), value(spark, high)) == (40.4, 59.6)
    assert value(spark, K.wilson(F.lit(None).cast("int"), F.lit(5))[0]) is None and value(spark, K.wilson(F.lit(1), F.lit(0))[0]) is None
    assert value(spark, K.otp_pct(F.lit(825), F.lit(1000))) == 83 and value(spark, K.otp_pct(F.lit(0), F.lit(0))) is None
    assert value(spark, K.minutes(F.lit(15.0))) == 0.3
    assert value(spark, K.severe_pct(F.lit(200), F.lit(None).cast("int"))) == 0.0


def test_waits(spark):
    wait = lambda s, q, p: value(spark, K.excess_wait(F.lit(s), F.lit(q), F.lit(p).cast("double")))
    assert [wait(10.0, 100.0, 8), wait(10.0, 100.0, 12), wait(0.0, 0.0, 8), wait(10.0, 100.0, None)] == [1.0, 0.0, None, None]
    bunched = lambda h, m: value(spark, K.bunched_pct(h, GAP_EDGES, F.lit(m).cast("double")))
    assert bunched(hist(20, b7=4), 7) == 0.0 and bunched(hist(20, b7=4), None) is None and bunched(hist(20), 7) is None
    assert bunched(hist(20, b7=4), 14) == 50.0
    assert 0.60 <= value(spark, K.pooled_cov(F.lit(3), F.lit(22.0), F.lit(204.0))) <= 0.66
    assert value(spark, K.pooled_cov(F.lit(1), F.lit(2.0), F.lit(4.0))) is None


def test_buckets(spark):
    shifts = [value(spark, K.shift(F.lit(h))) for h in (5, 6, 8, 9, 14, 15, 18, 19, 22, 23)]
    assert shifts == ["night", "am_peak", "am_peak", "midday", "midday", "pm_peak", "pm_peak", "evening", "evening", "night"]
    assert value(spark, K.day_type(F.lit("2024-01-06").cast("date"))) == "weekend" and value(spark, K.iso_day(F.lit("2024-01-01").cast("date"))) == 1
    assert value(spark, K.problem_score(F.lit(5000), F.lit(None).cast("double"))) == 9999.9999
    assert [value(spark, K.delay_band(F.lit(s).cast("double"))) for s in (-61, -60, 59, 60, 299, 300, None)] == ["early", "on_time", "on_time", "late", "late", "severe", "unknown"]
    assert str(value(spark, K.bucket_5m(F.lit("1999-12-31 23:59:59").cast("timestamp_ntz")))) == "1999-12-31 23:55:00"
