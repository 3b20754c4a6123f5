"""Queries of the rollups (T30 to T51) on the driver's tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctua.constants import BANDS
from punctua.operators import facts, rollups
from punctua.plans import sql as S
from punctua.sources import driver_tables as T


def flat(df: DataFrame, column: str, prefix: str, n: int) -> DataFrame:
    """A histogram as single columns."""
    return df.select(*(c for c in df.columns if c != column), *(F.get(column, F.lit(i)).alias(f"{prefix}{i}") for i in range(n)))


def scheduled(spark: SparkSession) -> DataFrame:
    running = facts.service_dates(T.calendar(spark), T.calendar_dates(spark))
    return facts.scheduled_universe(T.trips(spark), running)


def accountability(spark: SparkSession, d: str) -> DataFrame:
    fact = T.fact(spark, d)
    hourly = rollups.stop_delay_hourly(fact).withColumn("provider_local_date", F.to_date(T.local(F.col("period_start_utc"))))
    told = T.alerts(spark, d)
    told = told.select("provider_id", F.to_date(T.local(F.col("captured_at_utc"))).alias("provider_local_date"), F.md5(F.concat_ws("|", "header", "description")).alias("content_hash"))
    return rollups.citizen_accountability_daily(rollups.route_delay_spine(fact), hourly, told)


#: The clock of the rolling windows.
NOW = "2024-01-31 00:00:00"
RECENT = f"recent AS (SELECT * FROM fact WHERE captured_at_utc >= TIMESTAMP '{NOW}' - INTERVAL 14 DAY)"


def on_recent(build):
    return lambda spark, d: build(T.fact(spark, d), F.lit(NOW).cast("timestamp_ntz"))


def of_recent(cte: str) -> str:
    return cte.replace("FROM fact", "FROM recent")


def on_fact(build):
    return lambda spark, d: build(T.fact(spark, d))


QUERIES = {
    "t30_trip_delay_summary_5m": on_fact(rollups.trip_delay_summary_5m),
    "t31_route_delay_percentile_daily": on_fact(lambda f: rollups.delay_percentiles_daily(f, "route_id", "route_id")),
    "t32_stop_delay_percentile_daily": on_fact(lambda f: rollups.delay_percentiles_daily(f, "delay_stop_id", "stop_id")),
    "t33_route_cancellation_daily": lambda spark, d: rollups.route_cancellation_daily(T.fact(spark, d), scheduled(spark)),
    "t34_route_occupancy_band_daily": on_fact(rollups.route_occupancy_band_daily),
    "t35_route_occupancy_band_hourly": on_fact(rollups.route_occupancy_band_hourly),
    "t36_stop_occupancy_band_daily": on_fact(rollups.stop_occupancy_band_daily),
    "t37_route_delay_by_crowding_daily": on_fact(rollups.route_delay_by_crowding_daily),
    "t38_route_service_span_daily": on_fact(rollups.route_service_span_daily),
    "t39_route_skipped_stop_daily": on_fact(rollups.route_skipped_stop_daily),
    "t40_route_delay_spine": on_fact(lambda f: flat(rollups.route_delay_spine(f), "delay_histogram", "h", 21)),
    "t41_stop_delay_spine": on_fact(rollups.stop_delay_spine),
    "t42_stop_delay_shift_daily": on_fact(rollups.stop_delay_shift_daily),
    "t43_repeat_offender_daily_spine": on_fact(rollups.repeat_offender_daily_spine),
    "t44_route_headway_shift_daily": on_fact(lambda f: flat(rounded(rollups.route_headway_shift_daily(f)), "gap_histogram", "g", 20)),
    "t45_route_delay_hourly": on_fact(lambda f: rollups.route_delay_hourly(rollups.trip_delay_summary_5m(f))),
    "t46_stop_delay_hourly": on_fact(rollups.stop_delay_hourly),
    "t47_repeated_problem_route_stop": on_fact(lambda f: rollups.repeated_problem_route_stop(rollups.route_delay_spine(f), rollups.stop_delay_spine(f))),
    "t48_citizen_accountability_daily": accountability,
    "t49_route_headway_by_shift": on_recent(rollups.route_headway_by_shift),
    "t50_route_headway_by_direction_shift": on_recent(rollups.route_headway_by_direction_shift),
    "t51_repeat_offender": on_recent(rollups.repeat_offender),
}


def rounded(df: DataFrame) -> DataFrame:
    """Sums of fractions in a fixed number of decimals, as their last bits follow the order of the sum."""
    return df.withColumns({c: F.round(c, 4) for c in ("sum_gap_min", "sum_gap_sq_min")})


def _percentiles(entity: str, name: str) -> str:
    return S.query(S.FACT, select=f"""SELECT provider_id, snapshot_local_date AS provider_local_date, {entity} AS {name}, {S.half("quantile_cont(delay_seconds, 0.5)", 2)} AS p50_delay_seconds,
      {S.half("quantile_cont(delay_seconds, 0.9)", 2)} AS p90_delay_seconds, count(*) AS delay_observation_count FROM fact WHERE {entity} IS NOT NULL AND {S.CLAMP} GROUP BY ALL""")  # fmt: skip


def _bands(entity: str, where: str = "true") -> str:
    counts = ", ".join(f"count(*) FILTER (band = '{b}') AS {b}_count" for b in BANDS)
    return S.query(S.FACT, select=f"SELECT provider_id, snapshot_local_date AS provider_local_date, {entity}, count(*) AS observation_count, {counts} FROM (SELECT *, {S.BAND} AS band FROM fact) WHERE band IS NOT NULL AND {where} GROUP BY ALL")


ROUTED = "coalesce(route_id, '__unrouted__') AS route_id"
ROUTE_WEEK = f"""problems AS (
  SELECT provider_id, 'route' AS entity_kind, route_id AS entity_id, route_id, date_trunc('week', provider_local_date)::DATE AS period_start_local, sum(severe_delay_count)::BIGINT AS issue_count,
    {S.half(S.ratio("sum(sum_delay_seconds)", f"sum({S.INSIDE})"), 2)} AS avg_delay_seconds FROM route_spine GROUP BY ALL
  UNION ALL
  SELECT provider_id, 'stop', stop_id, route_id, date_trunc('week', provider_local_date)::DATE, sum(severe_delay_count)::BIGINT, {S.half(S.ratio("sum(sum_delay_seconds)", "sum(observation_count)"), 2)} FROM stop_spine GROUP BY ALL
)"""
BUSIEST = """busiest AS (SELECT provider_id, route_id, direction_id FROM starts WHERE isodow(service_date) <= 5 GROUP BY provider_id, route_id, direction_id QUALIFY row_number() OVER (PARTITION BY provider_id, route_id ORDER BY count(*) DESC, direction_id) = 1),
chosen AS (SELECT starts.* FROM starts JOIN busiest USING (provider_id, route_id, direction_id) WHERE isodow(service_date) <= 5)"""

ORACLE_SQL = {
    "t30_trip_delay_summary_5m": S.query(S.FACT, S.SUMMARY_5M, select="SELECT * FROM summary_5m"),
    "t31_route_delay_percentile_daily": _percentiles("route_id", "route_id"),
    "t32_stop_delay_percentile_daily": _percentiles("delay_stop_id", "stop_id"),
    "t33_route_cancellation_daily": S.query(S.FACT, S.SCHEDULE, """
      trip_days AS (SELECT provider_id, route_id, trip_id, start_date AS provider_local_date, max(CASE WHEN trip_schedule_relationship = 3 THEN 1 ELSE 0 END) AS gone FROM fact
        WHERE route_id IS NOT NULL AND snapshot_local_date BETWEEN start_date AND start_date + 1 GROUP BY ALL),
      seen AS (SELECT provider_id, provider_local_date, route_id, count(*) AS total, sum(gone)::BIGINT AS gone FROM trip_days GROUP BY ALL)""",
      select=f"""SELECT provider_id, provider_local_date, route_id, coalesce(total, 0) AS total_trip_days, coalesce(gone, 0) AS canceled_trip_days, {S.half(S.ratio("100.0 * gone", "total"), 2)} AS cancellation_rate_pct,
        scheduled_trip_count AS scheduled_trip_days, coalesce(total, 0) - coalesce(gone, 0) AS delivered_trip_days, CASE WHEN scheduled_trip_count IS NOT NULL THEN greatest(scheduled_trip_count - coalesce(total, 0), 0) END AS silent_trip_days
        FROM seen FULL JOIN scheduled USING (provider_id, provider_local_date, route_id)"""),
    "t34_route_occupancy_band_daily": _bands(ROUTED),
    "t35_route_occupancy_band_hourly": _bands(f"{ROUTED}, local_hour AS hour_of_day_local"),
    "t36_stop_occupancy_band_daily": _bands("delay_stop_id AS stop_id", "delay_stop_id IS NOT NULL"),
    "t37_route_delay_by_crowding_daily": S.query(S.FACT, select=f"""SELECT provider_id, snapshot_local_date AS provider_local_date, route_id, band, count(*) AS delay_observation_count, sum(delay_seconds)::BIGINT AS sum_delay_seconds,
      {S.half("quantile_cont(delay_seconds, 0.5)", 2)} AS p50_delay_seconds FROM (SELECT *, {S.BAND} AS band FROM fact) WHERE band IS NOT NULL AND route_id IS NOT NULL AND {S.CLAMP} GROUP BY ALL"""),
    "t38_route_service_span_daily": S.query(S.FACT, """
      obs AS (SELECT *, row_number() OVER (PARTITION BY route_id, trip_id, start_date ORDER BY captured_at_utc, entity_index) AS a, row_number() OVER (PARTITION BY route_id, trip_id, start_date ORDER BY captured_at_utc DESC, entity_index DESC) AS z
        FROM fact WHERE route_id IS NOT NULL AND snapshot_local_date BETWEEN start_date AND start_date + 1),
      begun AS (SELECT provider_id, start_date AS provider_local_date, route_id, trip_id, min(captured_at_utc) AS start, max(delay_seconds) FILTER (a = 1) AS f, max(delay_seconds) FILTER (z = 1) AS l FROM obs GROUP BY ALL),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY provider_local_date, route_id ORDER BY start, f NULLS LAST) AS x, row_number() OVER (PARTITION BY provider_local_date, route_id ORDER BY start DESC, f NULLS LAST) AS y FROM begun)""",
      select=f"""SELECT provider_id, provider_local_date, route_id, min(start) AS first_trip_start_utc, max(start) AS last_trip_start_utc, {S.half("(epoch_us(max(start)) - epoch_us(min(start)))::DOUBLE / 60000000.0", 0)}::INT AS service_span_min,
        max(f) FILTER (x = 1) AS first_trip_delay_seconds, max(l) FILTER (y = 1) AS last_trip_delay_seconds, count(*) AS trip_count FROM ranked GROUP BY ALL"""),
    "t39_route_skipped_stop_daily": S.query(S.FACT, select=f"""SELECT provider_id, snapshot_local_date AS provider_local_date, route_id, sum(stop_time_update_count)::BIGINT AS stop_time_update_count, sum(skipped_stop_count)::BIGINT AS skipped_stop_count,
      {S.half(S.ratio("100.0 * sum(skipped_stop_count)", "sum(stop_time_update_count)"), 2)} AS skipped_stop_rate_pct FROM fact WHERE route_id IS NOT NULL GROUP BY ALL"""),
    "t40_route_delay_spine": S.query(S.FACT, S.ROUTE_SPINE, select="SELECT * FROM route_spine"),
    "t41_stop_delay_spine": S.query(S.FACT, S.STOP_SPINE, select="SELECT provider_id, stop_id, route_id, provider_local_date, sum(observation_count)::BIGINT AS observation_count, sum(severe_delay_count)::BIGINT AS severe_delay_count, sum(sum_delay_seconds)::BIGINT AS sum_delay_seconds FROM stop_spine GROUP BY ALL"),
    "t42_stop_delay_shift_daily": S.query(S.FACT, S.STOP_SPINE, select="SELECT * FROM stop_spine"),
    "t43_repeat_offender_daily_spine": S.query(S.FACT, S.OFFENDER_SPINE, select="SELECT * FROM offender_spine"),
    "t44_route_headway_shift_daily": S.query(S.FACT, S.HEADWAY_SPINE, select="SELECT * REPLACE (round(sum_gap_min, 4) AS sum_gap_min, round(sum_gap_sq_min, 4) AS sum_gap_sq_min) FROM headway_spine"),
    "t45_route_delay_hourly": S.query(S.FACT, S.SUMMARY_5M, select=f"""SELECT provider_id, date_trunc('hour', period_start_utc)::TIMESTAMP AS period_start_utc, route_id, sum(trip_count)::BIGINT AS trip_count, sum(observation_count)::BIGINT AS observation_count,
      sum(delay_observation_count)::BIGINT AS delay_observation_count, sum(severe_delay_observation_count)::BIGINT AS severe_delay_count, CASE WHEN count(*) = count(on_time_observation_count) THEN sum(on_time_observation_count)::BIGINT END AS on_time_observation_count,
      {S.half(S.ratio("sum(avg_delay_seconds_capped * (delay_observation_count - outlier_count))", "sum(delay_observation_count - outlier_count)"), 2)} AS avg_delay_seconds, max(max_delay_seconds_capped) AS max_delay_seconds, sum(delayed_trip_count)::BIGINT AS delayed_trip_count
      FROM summary_5m GROUP BY ALL"""),
    "t46_stop_delay_hourly": S.query(S.FACT, S.STOP_HOURLY, select="SELECT * FROM stop_hourly"),
    "t47_repeated_problem_route_stop": S.query(S.FACT, S.ROUTE_SPINE, S.STOP_SPINE, ROUTE_WEEK, select="""SELECT *, 'week' AS period_grain, CASE WHEN issue_count >= 10 OR coalesce(avg_delay_seconds, 0) > 600 THEN 'critical' WHEN issue_count > 0 OR coalesce(avg_delay_seconds, 0) > 300 THEN 'high' ELSE 'watch' END AS severity_label
      FROM problems WHERE issue_count > 0 OR avg_delay_seconds > 300"""),
    "t48_citizen_accountability_daily": S.query(S.FACT, S.ROUTE_SPINE, S.STOP_HOURLY, S.ALERTS, f"""
      hours AS (SELECT provider_id, provider_local_date, route_id, hour_of_day_local, sum(severe_delay_count) AS bad, sum(delayed_trip_count) AS late, {S.half(S.ratio("sum(sum_delay_seconds)", f"sum({S.INSIDE})"), 2)} AS average FROM route_spine GROUP BY ALL),
      r AS (SELECT provider_id, provider_local_date, count(DISTINCT route_id) FILTER (average > 300 OR bad > 0) AS affected_route_count, sum(late)::BIGINT AS late, sum(bad)::BIGINT AS bad FROM hours GROUP BY ALL),
      s AS (SELECT provider_id, (period_start_utc - INTERVAL 5 HOUR)::DATE AS provider_local_date, count(DISTINCT stop_id) FILTER (avg_arrival_delay_seconds > 300 OR severe_delay_count > 0) AS affected_stop_count FROM stop_hourly GROUP BY ALL),
      a AS (SELECT provider_id, (captured_at_utc - INTERVAL 5 HOUR)::DATE AS provider_local_date, count(DISTINCT header || '|' || description) AS n FROM alerts GROUP BY ALL),
      days AS (SELECT provider_id, provider_local_date FROM r UNION SELECT provider_id, provider_local_date FROM s UNION SELECT provider_id, provider_local_date FROM a)""",
      select="""SELECT provider_id, provider_local_date, affected_route_count, affected_stop_count, coalesce(late, 0) AS delayed_trip_count, coalesce(bad, 0) AS severe_delay_count, coalesce(n, 0) AS alert_count,
        CASE WHEN r.late IS NOT NULL OR s.affected_stop_count IS NOT NULL THEN least((2 * coalesce(affected_route_count, 0) + coalesce(affected_stop_count, 0) + coalesce(late, 0) + 3 * coalesce(bad, 0) + 2 * coalesce(n, 0))::DOUBLE, 9999.9999) END AS rider_impact_score
        FROM days LEFT JOIN r USING (provider_id, provider_local_date) LEFT JOIN s USING (provider_id, provider_local_date) LEFT JOIN a USING (provider_id, provider_local_date)"""),
    "t49_route_headway_by_shift": S.query(S.FACT, RECENT, of_recent(S.WHOLE_STARTS), BUSIEST, S.gaps("provider_id, route_id, direction_id, service_date, shift", "chosen"), "m AS (SELECT provider_id, route_id, shift, quantile_cont(g, 0.5) AS median FROM gaps GROUP BY ALL)",
      select=f"""SELECT provider_id, route_id, shift, {S.half("any_value(median)", 1)} AS observed_headway_min, count(*) AS sample_count,
        CASE WHEN count(*) >= 2 AND sum(g) > 0 THEN {S.half("sqrt(greatest((sum(g * g) - sum(g) * sum(g) / count(*)) / (count(*) - 1), 0)) / (sum(g) / count(*))", 4)} END AS headway_cov, count(*) FILTER (g < 0.5 * median) AS bunched_count
        FROM gaps JOIN m USING (provider_id, route_id, shift) GROUP BY provider_id, route_id, shift"""),
    "t50_route_headway_by_direction_shift": S.query(S.FACT, RECENT, of_recent(S.WHOLE_STARTS), f"kinds AS (SELECT *, {S.daytype('service_date')} AS service_day_kind FROM starts)", S.gaps("provider_id, route_id, direction_id, service_day_kind, service_date, shift", "kinds"),
      select=f"SELECT provider_id, route_id, direction_id, shift, service_day_kind, {S.half('quantile_cont(g, 0.5)', 1)} AS observed_headway_min, count(*) AS sample_count FROM gaps GROUP BY ALL"),
    "t51_repeat_offender": S.query(S.FACT, RECENT, of_recent(S.OFFENDER_SPINE), f"""found AS (SELECT provider_id, entity_kind, entity_id, route_id, count(DISTINCT provider_local_date) FILTER (delay_seconds > 300) AS recurrence_days, {S.half(S.ratio("sum(delay_seconds)", "count(*)"), 1)} AS avg_delay_seconds FROM entities GROUP BY ALL)""",
      select="SELECT *, CASE WHEN recurrence_days >= 10 OR avg_delay_seconds > 600 THEN 'critical' WHEN recurrence_days >= 5 THEN 'high' ELSE 'watch' END AS severity_label FROM found WHERE recurrence_days >= 3"),
}
