"""Queries of stop histories (T113) and alert identities (T108); and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctua.operators import alerts as A
from punctua.operators import histories, rollups
from punctua.plans import alert_queries as Q
from punctua.plans import read_queries as R
from punctua.plans import sql as S
from punctua.sources import driver_tables as T

#: The open day, and the days that are kept before it.
TODAY, DAYS = "2024-01-29", 21
KEY = ["provider_id", "stop_id"]


def metrics(spark: SparkSession, d: str) -> list[histories.Metric]:
    fact = T.fact(spark, d)
    return histories.stop_metrics(R.stops(spark, d), rollups.delay_percentiles_daily(fact, "delay_stop_id", "stop_id"), rollups.stop_occupancy_band_daily(fact))


def history(spark: SparkSession, d: str) -> DataFrame:
    return histories.range_history(metrics(spark, d), KEY, F.lit(TODAY).cast("date"), DAYS)


def pooled(spark: SparkSession, d: str, first: str, last: str) -> DataFrame:
    return histories.rated(histories.pooled(metrics(spark, d), history(spark, d), KEY, F.lit(first).cast("date"), F.lit(last).cast("date")))


def identities(spark: SparkSession, d: str) -> DataFrame:
    found = A.identified(Q.load(spark, d, Q.BATCHES[:1]))
    return found.drop("description", "url")


QUERIES = {
    "t113_stop_history": history,
    "t113_stop_coverage": lambda spark, d: histories.metric_coverage(metrics(spark, d), history(spark, d), KEY),
    "t113_stop_week": lambda spark, d: pooled(spark, d, "2024-01-15", "2024-01-21"),
    "t113_stop_day": lambda spark, d: pooled(spark, d, "2024-01-18", "2024-01-18"),
    "t108_alert_identities": identities,
}

BANDS = ("empty", "many_seats", "few_seats", "standing", "full")
STOP_DAYS = f"""kept AS (SELECT *, {S.BAND} AS band FROM fact WHERE delay_stop_id IS NOT NULL AND snapshot_local_date >= DATE '{TODAY}' - {DAYS} AND snapshot_local_date < DATE '{TODAY}'),
  delay_days AS (SELECT provider_id, delay_stop_id AS stop_id, snapshot_local_date AS provider_local_date, count(*) AS observation_count, {S.SEVERE} AS severe_delay_count, sum(delay_seconds)::BIGINT AS sum_delay_seconds,
    {S.half("quantile_cont(delay_seconds, 0.5)", 2)} AS p50_delay_seconds, {S.half("quantile_cont(delay_seconds, 0.9)", 2)} AS p90_delay_seconds FROM kept WHERE {S.CLAMP} GROUP BY ALL),
  band_days AS (SELECT provider_id, delay_stop_id AS stop_id, snapshot_local_date AS provider_local_date, count(*) AS occupancy_count, {", ".join(f"count(*) FILTER (band = '{b}') AS {b}_count" for b in BANDS)} FROM kept WHERE band IS NOT NULL GROUP BY ALL),
  history AS (SELECT *, observation_count IS NOT NULL AS has_delay, observation_count IS NOT NULL AS has_delay_percentiles, occupancy_count IS NOT NULL AS has_occupancy, strftime(provider_local_date, '%Y-%m') AS month FROM delay_days FULL JOIN band_days USING (provider_id, stop_id, provider_local_date))"""


def pooled_sql(first: str, last: str) -> str:
    sums = ", ".join(f"sum({c})::BIGINT AS {c}" for c in ("observation_count", "severe_delay_count", "sum_delay_seconds", "occupancy_count", *(f"{b}_count" for b in BANDS)))
    alone = ", ".join((f"max({c})" if first == last else "NULL::DOUBLE") + f" AS {c}" for c in ("p50_delay_seconds", "p90_delay_seconds"))
    return S.query(S.FACT, STOP_DAYS, f"p AS (SELECT provider_id, stop_id, count(DISTINCT provider_local_date) AS day_count, {sums}, {alone} FROM history WHERE provider_local_date BETWEEN DATE '{first}' AND DATE '{last}' GROUP BY ALL)",
      select=f"SELECT *, {S.half(S.ratio('100.0::DOUBLE * coalesce(severe_delay_count, 0)', 'observation_count'), 1)} AS severe_pct, {S.half(f'({S.ratio('sum_delay_seconds', 'observation_count')}) / 60.0::DOUBLE', 1)} AS avg_delay_min FROM p")


ORACLE_SQL = {
    "t113_stop_history": S.query(S.FACT, STOP_DAYS, select="SELECT * FROM history"),
    "t113_stop_coverage": S.query(S.FACT, STOP_DAYS, """said AS (SELECT provider_id, stop_id, provider_local_date, 'delay' AS metric, 'additive' AS mode FROM history WHERE has_delay UNION ALL SELECT provider_id, stop_id, provider_local_date, 'delay_percentiles', 'daily_only' FROM history WHERE has_delay_percentiles
      UNION ALL SELECT provider_id, stop_id, provider_local_date, 'occupancy', 'additive' FROM history WHERE has_occupancy)""", select="SELECT provider_id, stop_id, metric, mode, min(provider_local_date) AS first_date, max(provider_local_date) AS last_date, count(*) AS day_count FROM said GROUP BY ALL"),
    "t113_stop_week": pooled_sql("2024-01-15", "2024-01-21"),
    "t113_stop_day": pooled_sql("2024-01-18", "2024-01-18"),
    "t108_alert_identities": "WITH RECURSIVE " + ",".join((Q.TOLD, Q.LOAD)) + f""",
    rows AS (SELECT e.*, header, severity, cause, effect, a, z, more {Q.ROW}),
    told_once AS (SELECT header, a, z, max(severity) AS severity, max(cause) AS cause, max(effect) AS effect, max(header_en) AS header_en, arg_max(more, (s0, j0)) FILTER (more IS NOT NULL) AS more FROM rows GROUP BY ALL),
    spelled AS (SELECT *, strftime(make_timestamp(a * 1000000), '%Y-%m-%d %H:%M:%S') AS sa, strftime(make_timestamp(z * 1000000), '%Y-%m-%d %H:%M:%S') AS sz, strftime(make_timestamp(more * 1000000), '%Y-%m-%d %H:%M:%S') AS sm FROM told_once)
    SELECT 'P1' AS provider_id, 'P1-alert-' || substr(sha1(concat_ws('|', header, severity, sa || '+00:00', CASE WHEN sz IS NULL THEN '' ELSE sz || '+00:00' END)), 1, 12) AS id, header, header_en, severity, cause, effect, make_timestamp(a * 1000000) AS active_start, make_timestamp(z * 1000000) AS active_end,
      CASE WHEN z >= a THEN round((z - a) / 60.0)::INT END AS duration_min, coalesce('0:' || sa || '/' || coalesce(sz, ''), '') || CASE WHEN sm IS NULL THEN '' ELSE ',1:' || sm || '/' END AS active_periods FROM spelled""",
}
