"""Queries of facts, views, alerts and client reductions (T20 to T29, T60 to T73, T104 to T133) on the driver's tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctua.functions import kernel as K
from punctua.operators import alerts as A
from punctua.operators import client, facts, live, reads, rollups
from punctua.plans import read_queries as R
from punctua.plans import rollup_queries as P
from punctua.plans import sql as S
from punctua.plans.rollup_queries import scheduled
from punctua.sources import driver_tables as T

BOX = (-74.0, 45.2, -73.2, 46.8)


def running(spark: SparkSession) -> DataFrame:
    return facts.service_dates(T.calendar(spark), T.calendar_dates(spark))


def timed(spark: SparkSession) -> DataFrame:
    return T.stop_times(spark).withColumn("secs", facts.service_seconds(F.col("departure_time")))


def updates(spark: SparkSession, d: str) -> DataFrame:
    """A predicted passage of a timetable stop for each event."""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "ts")
    k = F.col("event_id")
    name = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    at = F.timestamp_add("MINUTE", (k % 150 - 20).cast("int"), F.date_trunc("SECOND", F.col("ts")).cast("timestamp_ntz"))
    return e.select(
        F.lit("P1").alias("provider_id"), F.floor(k / 10).alias("rt_feed_snapshot_id"), (k % 10 - k % 2).cast("int").alias("entity_index"), (k % 2).cast("int").alias("stop_time_update_index"), name("T", k % 60).alias("trip_id"),
        name("R", k % 12).alias("route_id"), F.when(k % 7 != 0, F.to_date(F.col("ts"))).alias("start_date"), (k % 8 + 1).cast("int").alias("stop_sequence"), name("S", k % 60).alias("stop_id"),
        F.when(k % 3 != 0, at).alias("arrival_utc"), F.when(k % 5 != 0, F.timestamp_add("SECOND", F.lit(20), at)).alias("departure_utc"), F.date_trunc("SECOND", F.col("ts")).cast("timestamp_ntz").alias("feed_timestamp_utc"),
    )


def fact_delays(spark: SparkSession, d: str) -> DataFrame:
    times = T.stop_times(spark).withColumn("arrival_time", F.col("departure_time")).drop("stop_id").withColumn("stop_id", F.lit(None).cast("string"))
    found = facts.next_stop_delays(updates(spark, d).drop("stop_id"), times, T.TIME_ZONE)
    return found.select("provider_id", "rt_feed_snapshot_id", "entity_index", "trip_id", "stop_sequence", "predicted", "delay_seconds")


def trip_delay_fact(spark: SparkSession, d: str) -> DataFrame:
    positions_at = T.vehicles(spark, d).withColumn("feed_timestamp_utc", F.date_trunc("SECOND", F.col("captured_at_utc")).cast("timestamp_ntz"))
    return facts.trip_delay_fact(T.trip_updates(spark, d), T.stop_updates(spark, d), T.stop_times(spark), positions_at, T.TIME_ZONE)


def near(spark: SparkSession, d: str) -> DataFrame:
    found = facts.nearest_vehicle(T.fact(spark, d), T.vehicles(spark, d))
    return found.select("provider_id", "realtime_snapshot_id", "entity_index", "trip_id", "near_vehicle_id", "near_vehicle_seconds")


def shapes(spark: SparkSession, d: str) -> DataFrame:
    rows = T.stop_times(spark).join(T.trips(spark).where("direction_id = 0"), ["provider_id", "trip_id"])
    k = F.substring("stop_id", 2, 5).cast("int")
    found = rows.select("provider_id", F.concat("route_id", F.lit("-"), "trip_id").alias("shape_id"), F.col("stop_sequence").alias("sequence"), (-74.0 + k / 64.0).alias("lon"), (45.0 + k / 32.0).alias("lat"))
    lines = live.route_lines(found)
    return lines.select("provider_id", "shape_id", F.size("points").cast("long").alias("point_count"), F.get(F.get("points", F.lit(0)), F.lit(0)).alias("first_lon"), F.get(F.get("points", F.lit(7)), F.lit(1)).alias("last_lat"))


def hourly(spark: SparkSession, d: str) -> DataFrame:
    h = rollups.route_delay_hourly(rollups.trip_delay_summary_5m(T.fact(spark, d)))
    return h.withColumn("provider_local_date", F.to_date(T.local(F.col("period_start_utc"))))


def route_daily(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("delay_observation_count")
    weight = F.sum(F.round(F.col("avg_delay_seconds") * n, 4))
    known = F.when(F.count(F.lit(1)) == F.count("on_time_observation_count"), F.sum("on_time_observation_count"))
    rows = hourly(spark, d).groupBy("provider_id", "provider_local_date", "route_id").agg(
        F.sum("observation_count").alias("observation_count"), F.sum(n).alias("delay_observation_count"), known.alias("on_time_observation_count"), F.sum("severe_delay_count").alias("severe_delay_count"),
        K.half_away(K.ratio(F.round(weight, 2), F.sum(F.when(F.col("avg_delay_seconds").isNotNull(), n))), 1).alias("avg_delay_seconds"),
    )
    return rows


def stop_daily(spark: SparkSession, d: str) -> DataFrame:
    n, a = F.col("observation_count"), F.col("avg_arrival_delay_seconds")
    h = rollups.stop_delay_hourly(T.fact(spark, d)).withColumn("provider_local_date", F.to_date(T.local(F.col("period_start_utc"))))
    return h.groupBy("provider_id", "provider_local_date", "stop_id").agg(F.sum(n).alias("observation_count"), K.half_away(K.ratio(F.round(F.sum(F.round(a * n, 4)), 2), F.sum(n)), 1).alias("avg_delay_seconds"), F.max(a).alias("max_avg_delay_seconds"), F.sum("severe_delay_count").alias("severe_delay_count"))


def runs(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(
        F.lit("P1").alias("provider_id"), "event_id", F.concat(F.lit("feed"), (F.col("event_id") / 10 % 4).cast("int").cast("string")).alias("endpoint_key"), F.when(F.col("event_id") % 3 == 0, "silver_load").otherwise("capture").alias("run_kind"),
        F.when(F.col("event_id") % 70 == 0, "failed").otherwise("succeeded").alias("status"), F.date_trunc("SECOND", F.col("ts")).cast("timestamp_ntz").alias("finished_at_utc"), F.col("event_id").alias("run_id"),
    )


def freshness(spark: SparkSession, d: str) -> DataFrame:
    return live.feed_freshness(runs(spark, d), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))


def health(spark: SparkSession, d: str) -> DataFrame:
    feeds = spark.range(5).select(F.lit("P1").alias("provider_id"), F.concat(F.lit("feed"), F.col("id").cast("string")).alias("endpoint_key"), (F.col("id") * 20000 + 30).cast("int").alias("refresh_seconds"))
    return live.feed_health(freshness(spark, d), feeds)


def accountability_day(spark: SparkSession, d: str) -> DataFrame:
    out = reads.receipts(P.accountability(spark, d), R.spine(spark, d), route_daily(spark, d), stop_daily(spark, d), R.cancellations(spark, d))
    return out.select(
        "provider_id", "provider_local_date", "rider_impact_score", "otp_pct", "avg_delay_min", "severe_pct", "worst_route_id", "worst_route_otp_delta", "worst_stop_id", "worst_stop_delay_min",
        "scheduled_trip_days", "delivered_trip_days", "cancelled_trip_days", "silent_trip_days", "not_reported_route_count", "completeness_pct",
    )


def last_reliability(spark: SparkSession, d: str) -> DataFrame:
    """The newest 30 days of each route's published reliability."""
    rows = reads.last_days(route_daily(spark, d), ["provider_id", "route_id"])
    n = F.col("delay_observation_count")
    return rows.select("provider_id", "route_id", "provider_local_date", n.alias("known_obs"), K.otp_pct(F.col("on_time_observation_count"), n).alias("otp_pct"), K.minutes(F.col("avg_delay_seconds")).alias("avg_delay_min"), K.severe_pct(n, F.col("severe_delay_count")).alias("severe_pct"))


def gap_change(spark: SparkSession, d: str) -> DataFrame:
    """The change of each route's mean observed gap from the window before to the current one."""
    key = ["provider_id", "route_id", "window_grain"]
    rows = reads.in_windows(rollups.route_headway_shift_daily(T.fact(spark, d)), ["provider_id", "route_id"])
    sums = rows.groupBy(*key, "period").agg(F.sum("gap_count").alias("n"), F.round(F.sum("sum_gap_min"), 4).alias("s"), F.round(F.sum("sum_gap_sq_min"), 4).alias("q"))
    means = sums.withColumn("value", K.half_away(K.ratio(F.col("s"), F.col("n")), 1)).withColumn("cov", K.pooled_cov(F.col("n"), F.col("s"), F.col("q")))
    before = means.where("period = 'prior'").select(*key, F.col("n").alias("prior_n"), F.col("value").alias("prior_value"))
    both = means.where("period = 'current'").select(*key, "n", "value", "cov").join(before, key, "left")
    return client.mean_change(both).select(*key, "value", "prior_value", "delta", "significant")


def alert_history(spark: SparkSession, d: str) -> DataFrame:
    rows = T.alerts(spark, d)
    return A.history_reporting(rows.drop("route_id", "stop_id"), rows.where("route_id IS NOT NULL OR stop_id IS NOT NULL"), T.TIME_ZONE)


def merged(spark: SparkSession, d: str) -> DataFrame:
    a = T.alerts(spark, d)
    cut = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return A.archive_merged(A.archive_entries(a.where(F.col("captured_at_utc") < cut)), A.archive_entries(a.where(F.col("captured_at_utc") >= cut)))


def asked(spark: SparkSession) -> DataFrame:
    return spark.range(60).select(F.lit("P1").alias("provider_id"), F.concat(F.lit("S"), F.col("id").cast("string")).alias("stop_id"), F.date_add(F.lit("2023-12-27").cast("date"), (F.col("id") % 43).cast("int")).alias("asked_date"))


def ladders_as_of(spark: SparkSession, d: str) -> DataFrame:
    entity = lambda kind, c: R.names(spark).select("provider_id", F.lit(kind).alias("entity_kind"), F.concat(F.lit(c), F.substring("route_id", 2, 9)).alias("entity_id"), "name", "valid_from", "valid_to")
    return reads.hotspots_as_of(R.spine(spark, d), rollups.stop_delay_shift_daily(T.fact(spark, d)), entity("route", "R").unionByName(entity("stop", "S")), T.TIME_ZONE)


QUERIES = {
    "t111_hotspot_ladders": ladders_as_of,
    "t21_dim_date": lambda spark, d: facts.dim_date(T.calendar(spark), T.calendar_dates(spark)),
    "t23_schedule_summary": lambda spark, d: facts.schedule_summary(T.trips(spark), T.stop_times(spark), T.calendar(spark)),
    "t25_next_stop_delay": fact_delays,
    "t25_trip_delay_fact": trip_delay_fact,
    "t25c_nearest_vehicle": near,
    "t26_latest_snapshot": lambda spark, d: facts.latest(T.fact(spark, d)).select("provider_id", "realtime_snapshot_id", "entity_index", "trip_id", "delay_seconds"),
    "t27_service_dates": lambda spark, d: running(spark),
    "t28_scheduled_universe": lambda spark, d: scheduled(spark),
    "t29_representative_dates": lambda spark, d: facts.representative_dates(scheduled(spark), F.lit("2024-02-15").cast("date")),
    "t07_position_quality": lambda spark, d: T.vehicles(spark, d).groupBy("provider_id", live.position_quality(F.col("longitude"), F.col("latitude"), BOX).alias("quality")).agg(F.count(F.lit(1)).alias("n")),
    "t64_route_lines": shapes,
    "t69_alert_history_reporting": alert_history,
    "t95_last_30_reliability": last_reliability,
    "t95_last_30_service_span": lambda spark, d: reads.last_days(rollups.route_service_span_daily(T.fact(spark, d)), ["provider_id", "route_id"]),
    "t98_stop_occupancy": lambda spark, d: reads.occupancy_window(rollups.stop_occupancy_band_daily(T.fact(spark, d)), R.today(), "total", "stop_id"),
    "t128_gap_change": gap_change,
    "t132_alert_breakdown": lambda spark, d: A.log_breakdown(T.alerts(spark, d)),
    "t70_feed_freshness": freshness,
    "t72_public_route_reliability_daily": route_daily,
    "t73_public_stop_delay_daily": stop_daily,
    "t101_receipts": accountability_day,
    "t108_alert_history": lambda spark, d: A.history(T.alerts(spark, d), F.lit("2024-01-10").cast("date"), F.lit("2024-01-25").cast("date"), T.TIME_ZONE),
    "t108_alert_breakdown": lambda spark, d: A.breakdown(A.history(T.alerts(spark, d), F.lit("2024-01-10").cast("date"), F.lit("2024-01-25").cast("date"), T.TIME_ZONE)),
    "t109_archive_entries": lambda spark, d: A.archive_entries(T.alerts(spark, d)).drop("digest"),
    "t109_archive_merged": merged,
    "t123_alert_versions": lambda spark, d: A.versions(T.alerts(spark, d)),
    "t124_feed_health": health,
    "t127_range_pool": lambda spark, d: client.range_pool(R.spine(spark, d), F.lit("2024-01-05").cast("date"), F.lit("2024-01-18").cast("date"), ["provider_id", "route_id"]),
    "t128_rate_change": lambda spark, d: client.rate_change(reads.windowed_folds(R.spine(spark, d))).select("provider_id", "route_id", "window_grain", "delta", "significant"),
    "t129_stop_range": lambda spark, d: client.stop_range(R.stops(spark, d), F.lit("2024-01-05").cast("date"), F.lit("2024-01-18").cast("date")),
    "t131_search": lambda spark, d: searched(spark, d),
    "t133_resolved_dates": lambda spark, d: client.resolved_dates(R.stops(spark, d).select("provider_id", "stop_id", "provider_local_date").distinct(), asked(spark), ["provider_id", "stop_id"]),
}


def searched(spark: SparkSession, d: str) -> DataFrame:
    parts = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name")
    return parts.select("p_partkey", "p_name", client.search_tier(F.col("p_name"), "part 1").cast("int").alias("tier")).where("tier IS NOT NULL")


UPDATES = """updates AS (SELECT 'P1' AS provider_id, event_id // 10 AS rt_feed_snapshot_id, (event_id % 10 - event_id % 2)::INT AS entity_index, (event_id % 2)::INT AS idx, 'T' || (event_id % 60) AS trip_id, 'R' || (event_id % 12) AS route_id,
    CASE WHEN event_id % 7 <> 0 THEN ts::DATE END AS start_date, (event_id % 8 + 1)::INT AS stop_sequence, 'S' || (event_id % 60) AS stop_id, CASE WHEN event_id % 3 <> 0 THEN t + to_minutes(event_id % 150 - 20) END AS arrival_utc,
    CASE WHEN event_id % 5 <> 0 THEN t + to_minutes(event_id % 150 - 20) + INTERVAL 20 SECOND END AS departure_utc, t AS feed_timestamp_utc
  FROM (SELECT *, date_trunc('second', ts)::TIMESTAMP AS t FROM events))"""
HOURLY = f"""hours AS (SELECT provider_id, date_trunc('hour', period_start_utc)::TIMESTAMP AS p, route_id, sum(observation_count) AS o, sum(delay_observation_count) AS n, sum(on_time_observation_count) AS good, sum(severe_delay_observation_count) AS bad,
    {S.half(S.ratio("sum(avg_delay_seconds_capped * (delay_observation_count - outlier_count))", "sum(delay_observation_count - outlier_count)"), 2)} AS a FROM summary_5m GROUP BY ALL)"""
FRESH = """runs AS (SELECT event_id, 'feed' || (event_id // 10 % 4) AS endpoint_key, event_id % 3 = 0 AS load, CASE WHEN event_id % 70 = 0 THEN 'failed' ELSE 'succeeded' END AS status, date_trunc('second', ts)::TIMESTAMP AS ended FROM events),
  fresh AS (SELECT 'P1' AS provider_id, endpoint_key, status, ended AS finished_at_utc, epoch(TIMESTAMP '2024-02-01' - ended)::BIGINT AS age_seconds FROM runs WHERE NOT load QUALIFY row_number() OVER (PARTITION BY endpoint_key ORDER BY ended DESC, event_id DESC) = 1)"""
HASH = "md5(concat_ws(chr(31), coalesce(alert_id, ''), coalesce(header, ''), coalesce(description, ''), coalesce(severity, ''), coalesce(cause, ''), coalesce(effect, ''), coalesce((epoch_us(active_start) // 1000000)::VARCHAR, ''), coalesce((epoch_us(active_end) // 1000000)::VARCHAR, ''), '', ''))"
HISTORY = """told AS (SELECT provider_id, header, active_start, active_end, max(description) AS description, max(severity) AS severity, max(cause) AS cause, max(effect) AS effect,
    coalesce(string_agg(DISTINCT route_id, ',' ORDER BY route_id), '') AS routes, coalesce(string_agg(DISTINCT stop_id, ',' ORDER BY stop_id), '') AS stops
    FROM alerts WHERE (captured_at_utc - INTERVAL 5 HOUR)::DATE BETWEEN DATE '2024-01-10' AND DATE '2024-01-25' GROUP BY provider_id, header, active_start, active_end),
  history AS (SELECT *, row_number() OVER (ORDER BY active_start DESC NULLS LAST, header, active_end NULLS FIRST)::INT AS rank, count(*) OVER () AS total_in_window FROM told QUALIFY rank <= 500)"""


def entries(name: str, where: str) -> str:
    newest = ", ".join(f"arg_max({c}, (captured_at_utc, alert_row)) FILTER ({c} IS NOT NULL) AS {c}" for c in ("header", "description", "severity", "cause", "effect"))
    period = "concat_ws('/', strftime(active_start, '%Y-%m-%d %H:%M:%S'), strftime(active_end, '%Y-%m-%d %H:%M:%S'))"
    return f"""{name} AS (SELECT provider_id, alert_id AS stable_id, {newest}, min(captured_at_utc) AS first_seen, max(captured_at_utc) AS last_seen, coalesce(string_agg(DISTINCT route_id, ',' ORDER BY route_id), '') AS routes,
      string_agg(DISTINCT {period}, ',' ORDER BY {period}) AS periods, strftime(min(captured_at_utc), '%Y-%m') AS archive_month FROM alerts WHERE {where} GROUP BY provider_id, alert_id)"""


def pick(c: str) -> str:
    return f"CASE WHEN coalesce(b.last_seen >= a.last_seen, true) THEN coalesce(b.{c}, a.{c}) ELSE coalesce(a.{c}, b.{c}) END AS {c}"


def united(c: str) -> str:
    return f"array_to_string(list_sort(list_distinct(list_filter(list_concat(string_split(coalesce(a.{c}, ''), ','), string_split(coalesce(b.{c}, ''), ',')), lambda x: x <> ''))), ',') AS {c}"


POOL = "sum(observation_count)::BIGINT AS obs, sum(severe_delay_count)::BIGINT AS severe, sum(sum_delay_seconds)::BIGINT AS total"

ROUTE_DAILY = S.query(S.FACT, S.SUMMARY_5M, HOURLY, select=f"""SELECT provider_id, (p - INTERVAL 5 HOUR)::DATE AS provider_local_date, route_id, sum(o)::BIGINT AS observation_count, sum(n)::BIGINT AS delay_observation_count, CASE WHEN count(*) = count(good) THEN sum(good)::BIGINT END AS on_time_observation_count,
      sum(bad)::BIGINT AS severe_delay_count, {S.half(S.ratio("round(sum(round(a * n, 4)), 2)", "sum(n) FILTER (a IS NOT NULL)"), 1)} AS avg_delay_seconds FROM hours GROUP BY ALL""")
STOP_DAILY = S.query(S.FACT, S.STOP_HOURLY, select=f"""SELECT provider_id, (period_start_utc - INTERVAL 5 HOUR)::DATE AS provider_local_date, stop_id, sum(observation_count)::BIGINT AS observation_count,
      {S.half(S.ratio("round(sum(round(avg_arrival_delay_seconds * observation_count, 4)), 2)", "sum(observation_count)"), 1)} AS avg_delay_seconds, max(avg_arrival_delay_seconds) AS max_avg_delay_seconds, sum(severe_delay_count)::BIGINT AS severe_delay_count FROM stop_hourly GROUP BY ALL""")
WORST = f"""sr AS (SELECT provider_local_date, route_id AS worst_route_id, {S.half(S.ratio("100.0::DOUBLE * on_time_observation_count", "delay_observation_count"), 0)} AS route_otp FROM ({ROUTE_DAILY}) WHERE avg_delay_seconds IS NOT NULL AND route_id <> '__unrouted__'
    QUALIFY row_number() OVER (PARTITION BY provider_local_date ORDER BY avg_delay_seconds DESC, route_id) = 1),
  ss AS (SELECT provider_local_date, stop_id AS worst_stop_id, {S.half("avg_delay_seconds / 60.0::DOUBLE", 1)} AS worst_stop_delay_min FROM ({STOP_DAILY}) WHERE avg_delay_seconds IS NOT NULL AND stop_id <> '__unknown_stop__'
    QUALIFY row_number() OVER (PARTITION BY provider_local_date ORDER BY avg_delay_seconds DESC, stop_id) = 1),
  sv AS (SELECT provider_local_date, sum(scheduled_trip_days)::BIGINT AS scheduled_trip_days, sum(delivered_trip_days)::BIGINT AS delivered_trip_days, sum(canceled_trip_days)::BIGINT AS cancelled_trip_days, sum(silent_trip_days)::BIGINT AS silent_trip_days,
    count(*) FILTER (total_trip_days = 0 AND scheduled_trip_days > 0) AS not_reported_route_count FROM cancel WHERE scheduled_trip_days IS NOT NULL GROUP BY ALL)"""
SPOTS = f"""w_route AS (SELECT * FROM (VALUES ('day', 1), ('week', 7), ('month', 30)) t(window_grain, days)),
  spots AS (
    SELECT provider_id, window_grain, 'route' AS entity_kind, route_id AS entity_id, sum(delay_observation_count)::BIGINT AS obs, sum(severe_delay_count)::BIGINT AS severe, sum(sum_delay_seconds)::BIGINT AS total
    FROM route_spine, w_route WHERE provider_local_date > (SELECT max(provider_local_date) FROM route_spine) - days GROUP BY ALL
    UNION ALL
    SELECT provider_id, window_grain, 'stop', stop_id, sum(observation_count)::BIGINT, sum(severe_delay_count)::BIGINT, sum(sum_delay_seconds)::BIGINT
    FROM stop_spine, w_route WHERE provider_local_date > (SELECT max(provider_local_date) FROM stop_spine) - days GROUP BY ALL
  )"""


def ladders_sql(scope: str) -> str:
    return f"""bounded AS (SELECT {scope}, entity_kind, entity_id, obs, severe, {S.half(S.ratio("100.0::DOUBLE * severe", "obs"), 1)} AS severe_pct, {S.half(f"({S.ratio('total', 'obs')}) / 60.0::DOUBLE", 1)} AS avg_delay_min,
      {S.wilson("obs - severe", "obs", False)} AS wilson_lo, coalesce(obs, 0) < 30 AS is_tray,
      {S.half(S.ratio("100.0::DOUBLE * (obs - severe)", "obs"), 0)} - (100 - {S.half(S.ratio("100.0::DOUBLE * sum(severe) OVER net", "sum(obs) OVER net"), 1)}) AS delta FROM spots WINDOW net AS (PARTITION BY {scope}, entity_kind)),
  ladders AS (
    SELECT * EXCLUDE (delta), round(delta, 1) AS otp_delta_points, row_number() OVER (PARTITION BY {scope}, entity_kind ORDER BY wilson_lo, coalesce(avg_delay_min, 0) DESC, entity_id)::INT AS rank FROM bounded WHERE NOT is_tray QUALIFY rank <= 50
    UNION ALL
    SELECT * EXCLUDE (delta), NULL::DOUBLE, row_number() OVER (PARTITION BY {scope} ORDER BY coalesce(severe_pct, 0) DESC, entity_id, entity_kind)::INT AS rank FROM bounded WHERE is_tray QUALIFY rank <= 60
  )"""


GRAINS = SPOTS + ", " + ladders_sql("provider_id, window_grain")
PEAK = "('am_peak', 'pm_peak')"
AS_OF = f"""w AS (SELECT * FROM (VALUES ('day', 1), ('week', 7), ('month', 30), ('shift', 7)) t(window_grain, days)),
  dates AS (SELECT provider_local_date AS d FROM route_spine UNION SELECT provider_local_date FROM stop_spine),
  every AS (SELECT provider_id, 'route' AS entity_kind, route_id AS entity_id, provider_local_date, {S.shift("hour_of_day_local")} AS shift, delay_observation_count AS n, severe_delay_count AS bad, sum_delay_seconds AS s FROM route_spine WHERE route_id <> '__unrouted__'
    UNION ALL SELECT provider_id, 'stop', stop_id, provider_local_date, shift, observation_count, severe_delay_count, sum_delay_seconds FROM stop_spine),
  spots AS (SELECT provider_id, d AS provider_local_date, window_grain, entity_kind, entity_id, sum(n)::BIGINT AS obs, sum(bad)::BIGINT AS severe, sum(s)::BIGINT AS total
    FROM every JOIN dates ON provider_local_date <= d JOIN w ON provider_local_date > d - days AND (window_grain <> 'shift' OR shift IN {PEAK}) GROUP BY ALL)"""
NAMED = """names AS (SELECT kind AS entity_kind, c || k AS entity_id, 'Line ' || k || v AS name, a, z FROM range(12) t(k), (VALUES ('a', TIMESTAMP '2023-12-01', TIMESTAMP '2024-01-10 05:00:00'), ('b', TIMESTAMP '2024-01-10 05:00:00', NULL)) u(v, a, z), (VALUES ('route', 'R'), ('stop', 'S')) e(kind, c) WHERE k <> 11 OR v = 'b'),
  held AS (SELECT l.entity_kind, l.entity_id, l.provider_local_date, arg_max(n.name, n.a) AS name FROM (SELECT DISTINCT entity_kind, entity_id, provider_local_date FROM ladders) l
    JOIN names n ON n.entity_kind = l.entity_kind AND n.entity_id = l.entity_id AND n.a < (l.provider_local_date + 1)::TIMESTAMP + INTERVAL 5 HOUR AND (n.z IS NULL OR n.z >= (l.provider_local_date + 1)::TIMESTAMP + INTERVAL 5 HOUR) GROUP BY ALL)"""

ORACLE_SQL = {
    "t111_hotspot_ladders": S.query(S.FACT, S.ROUTE_SPINE, S.STOP_SPINE, AS_OF, ladders_sql("provider_id, provider_local_date, window_grain"), NAMED, select="SELECT l.*, h.name FROM ladders l LEFT JOIN held h USING (entity_kind, entity_id, provider_local_date)"),
    "t101_receipts": S.query(S.FACT, S.ROUTE_SPINE, S.STOP_SPINE, S.STOP_HOURLY, S.ALERTS, S.SCHEDULE, R.CANCEL, WORST, f"""
      folded AS (SELECT provider_id, provider_local_date, {R.SUMS} FROM route_spine GROUP BY ALL), rates AS (SELECT provider_id, provider_local_date, {R.RATES} FROM folded),
      hit AS (SELECT provider_id, provider_local_date, count(DISTINCT route_id) FILTER (bad > 0 OR average > 300) AS r, sum(late) AS late, sum(bad) AS bad FROM (SELECT provider_id, provider_local_date, route_id, hour_of_day_local, sum(severe_delay_count) AS bad, sum(delayed_trip_count) AS late,
        {S.half(S.ratio("sum(sum_delay_seconds)", f"sum({S.INSIDE})"), 2)} AS average FROM route_spine GROUP BY ALL) GROUP BY ALL),
      sh AS (SELECT (period_start_utc - INTERVAL 5 HOUR)::DATE AS provider_local_date, count(DISTINCT stop_id) FILTER (avg_arrival_delay_seconds > 300 OR severe_delay_count > 0) AS s FROM stop_hourly GROUP BY ALL),
      al AS (SELECT (captured_at_utc - INTERVAL 5 HOUR)::DATE AS provider_local_date, count(DISTINCT header || '|' || description) AS n FROM alerts GROUP BY ALL),
      days AS (SELECT provider_local_date FROM hit UNION SELECT provider_local_date FROM sh UNION SELECT provider_local_date FROM al)""",
      select=f"""SELECT 'P1' AS provider_id, d.provider_local_date, CASE WHEN late IS NOT NULL OR s IS NOT NULL THEN least((2 * coalesce(r, 0) + coalesce(s, 0) + coalesce(late, 0) + 3 * coalesce(bad, 0) + 2 * coalesce(n, 0))::DOUBLE, 9999.9999) END AS rider_impact_score,
        otp_pct, avg_delay_min, severe_pct, worst_route_id, route_otp - otp_pct AS worst_route_otp_delta, worst_stop_id, worst_stop_delay_min, scheduled_trip_days, delivered_trip_days, cancelled_trip_days, silent_trip_days, not_reported_route_count,
        CASE WHEN scheduled_trip_days > 0 THEN least(100.0::DOUBLE, {S.half(S.ratio("100.0::DOUBLE * delivered_trip_days", "scheduled_trip_days"), 2)}) END AS completeness_pct
        FROM days d LEFT JOIN hit USING (provider_local_date) LEFT JOIN sh USING (provider_local_date) LEFT JOIN al USING (provider_local_date) LEFT JOIN rates USING (provider_local_date) LEFT JOIN sr USING (provider_local_date) LEFT JOIN ss USING (provider_local_date) LEFT JOIN sv USING (provider_local_date)"""),
    "t104_hotspots": S.query(S.FACT, S.ROUTE_SPINE, S.STOP_SPINE, P.ROUTE_WEEK, f"""
      kept AS (SELECT * FROM problems WHERE (issue_count > 0 OR avg_delay_seconds > 300)),
      newest AS (SELECT * FROM kept WHERE period_start_local = (SELECT max(period_start_local) FROM kept) AND entity_id NOT IN ('__unrouted__', '__unknown_stop__')),
      ranked AS (SELECT *, row_number() OVER (ORDER BY issue_count DESC, entity_kind, entity_id, route_id)::INT AS rank FROM newest QUALIFY rank <= 20),
      wr AS (SELECT * FROM route_spine WHERE date_trunc('week', provider_local_date)::DATE = (SELECT max(period_start_local) FROM kept)), ws AS (SELECT * FROM stop_spine WHERE date_trunc('week', provider_local_date)::DATE = (SELECT max(period_start_local) FROM kept)),
      r AS (SELECT 'route' AS entity_kind, route_id AS entity_id, {S.half(S.ratio("100.0::DOUBLE * sum(on_time_observation_count)", "sum(delay_observation_count)"), 0)} AS otp_pct FROM wr GROUP BY route_id
        UNION ALL SELECT 'stop', stop_id, {S.half(S.ratio("100.0::DOUBLE * (sum(observation_count) - sum(severe_delay_count))", "sum(observation_count)"), 0)} FROM ws GROUP BY stop_id),
      n AS (SELECT 'route' AS entity_kind, {S.half(S.ratio("100.0::DOUBLE * sum(on_time_observation_count)", "sum(delay_observation_count) FILTER (on_time_observation_count IS NOT NULL)"), 0)} AS network_otp_pct FROM wr
        UNION ALL SELECT 'stop', {S.half(S.ratio("100.0::DOUBLE * (sum(observation_count) - sum(severe_delay_count))", "sum(observation_count)"), 0)} FROM ws)""",
      select="""SELECT k.provider_id, entity_kind, k.entity_id, k.route_id, issue_count, CASE WHEN issue_count >= 10 OR coalesce(avg_delay_seconds, 0) > 600 THEN 'critical' WHEN issue_count > 0 OR coalesce(avg_delay_seconds, 0) > 300 THEN 'high' ELSE 'watch' END AS severity_label, rank, r.otp_pct, network_otp_pct,
        r.otp_pct - network_otp_pct AS otp_delta_points FROM ranked k LEFT JOIN r USING (entity_kind, entity_id) LEFT JOIN n USING (entity_kind)"""),
    "t105_hotspots_by_grain": S.query(S.FACT, S.ROUTE_SPINE, S.STOP_SPINE, GRAINS, select="SELECT * FROM ladders"),
    "t21_dim_date": S.query(S.SCHEDULE, select="""SELECT 'P1' AS provider_id, strftime(d, '%Y%m%d')::INT AS date_key, d AS date, year(d)::INT AS year, quarter(d)::INT AS quarter, month(d)::INT AS month, weekofyear(d)::INT AS iso_week, isodow(d)::INT AS iso_day,
      isodow(d) > 5 AS is_weekend, d = DATE '2024-01-15' AS has_added, d IN (DATE '2024-01-15', DATE '2024-01-20') AS has_removed FROM dates"""),
    "t23_schedule_summary": S.query(S.SCHEDULE, """kinds AS (SELECT * FROM (VALUES ('WD', 'weekday'), ('WE', 'saturday'), ('WE', 'sunday'), ('ALL', 'weekday'), ('ALL', 'saturday'), ('ALL', 'sunday')) t(service_id, day_type))""",
      select="""SELECT t.provider_id, t.route_id, k.day_type, min(secs) AS first_departure_secs, max(secs) AS last_departure_secs, ((max(secs) - min(secs)) // 60)::BIGINT AS span_minutes, count(DISTINCT t.trip_id) AS trip_count, count(DISTINCT stop_id) AS stop_count
        FROM trips t JOIN kinds k USING (service_id) JOIN stop_times s USING (trip_id) GROUP BY ALL"""),
    "t25_next_stop_delay": S.query(S.SCHEDULE, UPDATES, """c AS (SELECT u.*, coalesce(arrival_utc, departure_utc) AS predicted, s.secs FROM updates u JOIN stop_times s USING (trip_id, stop_sequence) WHERE start_date IS NOT NULL AND coalesce(arrival_utc, departure_utc) IS NOT NULL),
      d AS (SELECT *, epoch(predicted - (start_date::TIMESTAMP + INTERVAL 5 HOUR + to_seconds(secs)))::INT AS delay_seconds, epoch(predicted - feed_timestamp_utc) AS away FROM c)""",
      select="""SELECT provider_id, rt_feed_snapshot_id, entity_index, trip_id, stop_sequence, predicted, delay_seconds FROM d
        QUALIFY row_number() OVER (PARTITION BY rt_feed_snapshot_id, entity_index ORDER BY CASE WHEN away < 0 THEN 1 ELSE 0 END, abs(away), stop_sequence, idx) = 1"""),
    "t25_trip_delay_fact": S.query(S.SCHEDULE, S.VEHICLES, """e AS (SELECT event_id AS k, ts::TIMESTAMP AS captured_at_utc, date_trunc('second', ts)::TIMESTAMP AS t, CASE WHEN event_id % 47 <> 0 THEN 'T' || (event_id % 60) END AS trip_id,
        CASE WHEN event_id % 11 <> 0 THEN 'R' || (event_id % 12) END AS route_id, CASE WHEN event_id % 7 <> 0 THEN ts::DATE END AS start_date FROM events),
      u AS (SELECT k, i, trip_id, start_date, t, (k + i) % 9 + 1 AS stop_sequence, CASE WHEN (k + i) % 4 <> 0 THEN 'S' || ((k + i) % 60) END AS stop_id, (k + i) % 4 = 1 AS skipped, t + to_minutes(k % 150 - 20 + i * 7) AS due,
        CASE WHEN (k + i) % 3 <> 0 THEN due WHEN (k + i) % 6 <> 0 THEN due + INTERVAL 20 SECOND END AS predicted FROM e, range(4) r(i) WHERE i < k % 5),
      n AS (SELECT k, count(*)::INT AS updates, count(*) FILTER (skipped)::INT AS skips FROM u GROUP BY k),
      c AS (SELECT u.k, coalesce(u.stop_id, s.stop_id) AS stop_id, u.stop_sequence, epoch(predicted - (start_date::TIMESTAMP + INTERVAL 5 HOUR + to_seconds(secs)))::INT AS late FROM u JOIN stop_times s ON s.trip_id = u.trip_id AND s.stop_sequence = u.stop_sequence
        WHERE start_date IS NOT NULL AND predicted IS NOT NULL QUALIFY row_number() OVER (PARTITION BY u.k ORDER BY CASE WHEN predicted >= t THEN 0 ELSE 1 END, abs(epoch(predicted - t)), u.stop_sequence, i) = 1),
      w AS (SELECT *, date_trunc('second', captured_at_utc) AS vt FROM vehicles WHERE vehicle_id IS NOT NULL),
      v AS (SELECT e.k, w.vehicle_id, w.occupancy_status FROM e JOIN w ON w.trip_id = e.trip_id AND (e.route_id IS NULL OR w.route_id = e.route_id) AND w.vt BETWEEN e.t - INTERVAL 10 MINUTE AND e.t + INTERVAL 10 MINUTE
        QUALIFY row_number() OVER (PARTITION BY e.k ORDER BY abs(epoch(w.vt - e.t)), w.realtime_snapshot_id DESC, w.entity_index) = 1)""",
      select="""SELECT 'P1' AS provider_id, k // 10 AS realtime_snapshot_id, (k % 10)::INT AS entity_index, strftime(t - INTERVAL 5 HOUR, '%Y%m%d')::INT AS snapshot_date_key, (t - INTERVAL 5 HOUR)::DATE AS snapshot_local_date, t AS feed_timestamp_utc, captured_at_utc,
        'E' || k AS entity_id, trip_id, route_id, (k % 2)::INT AS direction_id, start_date, vehicle_id, occupancy_status, CASE WHEN k % 23 = 0 THEN 3 END AS trip_schedule_relationship, late AS delay_seconds, coalesce(updates, 0)::INT AS stop_time_update_count,
        coalesce(skips, 0)::INT AS skipped_stop_count, stop_id AS delay_stop_id, stop_sequence::INT AS delay_stop_sequence FROM e LEFT JOIN n USING (k) LEFT JOIN c USING (k) LEFT JOIN v USING (k)"""),
    "t25c_nearest_vehicle": S.query(S.FACT, S.VEHICLES, """n AS (SELECT f.realtime_snapshot_id, f.entity_index, v.vehicle_id, epoch_us(f.captured_at_utc) - epoch_us(v.captured_at_utc) AS us, v.realtime_snapshot_id AS vs, v.entity_index AS ve
        FROM fact f JOIN vehicles v ON f.trip_id = v.trip_id AND v.vehicle_id IS NOT NULL AND (f.route_id IS NULL OR f.route_id = v.route_id) AND v.captured_at_utc BETWEEN f.captured_at_utc - INTERVAL 601 SECOND AND f.captured_at_utc + INTERVAL 601 SECOND),
      b AS (SELECT *, abs(us) // 1000000 AS apart FROM n WHERE abs(us) // 1000000 <= 600 QUALIFY row_number() OVER (PARTITION BY realtime_snapshot_id, entity_index ORDER BY abs(us) // 1000000, vs DESC, ve) = 1)""",
      select="SELECT f.provider_id, f.realtime_snapshot_id, f.entity_index, f.trip_id, b.vehicle_id AS near_vehicle_id, b.apart AS near_vehicle_seconds FROM fact f LEFT JOIN b USING (realtime_snapshot_id, entity_index)"),
    "t26_latest_snapshot": S.query(S.FACT, select="SELECT provider_id, realtime_snapshot_id, entity_index, trip_id, delay_seconds FROM fact WHERE realtime_snapshot_id = (SELECT max(realtime_snapshot_id) FROM fact)"),
    "t27_service_dates": S.query(S.SCHEDULE, select="SELECT 'P1' AS provider_id, service_id, d AS service_date FROM running"),
    "t28_scheduled_universe": S.query(S.SCHEDULE, select="SELECT * FROM scheduled"),
    "t29_representative_dates": S.query(S.SCHEDULE, f"totals AS (SELECT provider_id, provider_local_date AS service_date, {S.daytype('provider_local_date')} AS day_type, sum(scheduled_trip_count)::BIGINT AS trip_count FROM scheduled WHERE provider_local_date BETWEEN DATE '2024-02-15' - 42 AND DATE '2024-02-15' GROUP BY ALL)",
      select="SELECT * FROM totals QUALIFY row_number() OVER (PARTITION BY day_type ORDER BY trip_count DESC, service_date) = 1"),
    "t07_position_quality": S.query(S.VEHICLES, select=f"""SELECT provider_id, CASE WHEN longitude IS NULL OR latitude IS NULL THEN 'missing' WHEN longitude NOT BETWEEN -180 AND 180 OR latitude NOT BETWEEN -90 AND 90 THEN 'invalid_wgs84'
      WHEN longitude BETWEEN {BOX[0]}::DOUBLE AND {BOX[2]}::DOUBLE AND latitude BETWEEN {BOX[1]}::DOUBLE AND {BOX[3]}::DOUBLE THEN 'valid_provider_bbox' ELSE 'outside_provider_bbox' END AS quality, count(*) AS n FROM vehicles GROUP BY ALL"""),
    "t64_route_lines": S.query(S.SCHEDULE, select="""SELECT t.provider_id, t.route_id || '-' || t.trip_id AS shape_id, count(*) AS point_count, arg_min(-74.0::DOUBLE + substr(stop_id, 2)::INT / 64.0::DOUBLE, stop_sequence) AS first_lon, arg_max(45.0::DOUBLE + substr(stop_id, 2)::INT / 32.0::DOUBLE, stop_sequence) AS last_lat
      FROM trips t JOIN stop_times s USING (trip_id) WHERE direction_id = 0 GROUP BY ALL"""),
    "t69_alert_history_reporting": S.query(S.ALERTS, "l AS (SELECT *, captured_at_utc - INTERVAL 5 HOUR AS t FROM alerts)", select="""SELECT provider_id, alert_row, alert_id, header, description, severity, cause, effect, route_id, stop_id, t::DATE AS provider_local_date,
      date_trunc('hour', t)::TIMESTAMP AS hour_bucket_local, date_trunc('week', t)::TIMESTAMP AS week_bucket_local, date_trunc('month', t)::TIMESTAMP AS month_bucket_local, date_trunc('year', t)::TIMESTAMP AS year_bucket_local,
      active_start, active_end, captured_at_utc, md5(coalesce(description, '') || coalesce(severity, '') || coalesce(cause, '') || coalesce(effect, '')) AS effective_content_hash FROM l"""),
    "t95_last_30_reliability": f"""SELECT provider_id, route_id, provider_local_date, delay_observation_count AS known_obs, {S.half(S.ratio("100.0::DOUBLE * on_time_observation_count", "delay_observation_count"), 0)} AS otp_pct, {S.half("avg_delay_seconds / 60.0::DOUBLE", 1)} AS avg_delay_min,
      {S.half(S.ratio("100.0::DOUBLE * severe_delay_count", "delay_observation_count"), 1)} AS severe_pct FROM ({ROUTE_DAILY}) QUALIFY row_number() OVER (PARTITION BY provider_id, route_id ORDER BY provider_local_date DESC) <= 30""",
    "t95_last_30_service_span": f"SELECT * FROM ({P.ORACLE_SQL['t38_route_service_span_daily']}) QUALIFY row_number() OVER (PARTITION BY provider_id, route_id ORDER BY provider_local_date DESC) <= 30",
    "t98_stop_occupancy": f"SELECT provider_id, stop_id, sum(observation_count)::BIGINT AS observation_count, {R.SHARES} FROM ({P.ORACLE_SQL['t36_stop_occupancy_band_daily']}) WHERE provider_local_date >= DATE '{R.TODAY}' - 30 GROUP BY ALL",
    "t128_gap_change": S.query(S.FACT, S.HEADWAY_SPINE, R.windows("headway_spine", "provider_id, route_id"), f"""g AS (SELECT provider_id, route_id, window_grain, period, sum(gap_count)::BIGINT AS n, round(sum(sum_gap_min), 4) AS s, round(sum(sum_gap_sq_min), 4) AS q FROM windowed GROUP BY ALL),
      m AS (SELECT *, {S.half("s / n", 1)} AS value, CASE WHEN n >= 2 AND s > 0 THEN {S.half("sqrt(greatest((q - s * s / n) / (n - 1), 0)) / (s / n)", 4)} END AS cov FROM g),
      b AS (SELECT c.*, p.n AS prior_n, p.value AS prior_value FROM m c LEFT JOIN m p ON p.period = 'prior' AND p.provider_id = c.provider_id AND p.route_id = c.route_id AND p.window_grain = c.window_grain WHERE c.period = 'current')""",
      select=f"""SELECT provider_id, route_id, window_grain, value, prior_value, {S.half("value - prior_value", 1)} AS delta, coalesce(cov > 0 AND n >= 7 AND prior_n >= 7 AND value + prior_value > 0 AND value <> prior_value
        AND abs(value - prior_value) >= 1.96 * (value + prior_value) / 2.0::DOUBLE * cov * sqrt(1.0::DOUBLE / n + 1.0::DOUBLE / prior_n), false) AS significant FROM b"""),
    "t132_alert_breakdown": S.query(S.ALERTS, "m AS (SELECT *, epoch(active_end - active_start)::DOUBLE / 60.0 AS minutes FROM alerts), k AS (SELECT 'cause' AS kind, coalesce(cause, 'unknown') AS key, * FROM m UNION ALL SELECT 'effect', coalesce(effect, 'unknown'), * FROM m UNION ALL SELECT 'severity', 'watch', * FROM m)",
      select="SELECT provider_id, kind, key, count(*) AS alert_count, quantile_cont(minutes, 0.5) AS median_minutes FROM k GROUP BY ALL"),
    "t70_feed_freshness": S.query(FRESH, select="SELECT * FROM fresh"),
    "t72_public_route_reliability_daily": ROUTE_DAILY,
    "t73_public_stop_delay_daily": STOP_DAILY,
    "t108_alert_history": S.query(S.ALERTS, HISTORY, select="SELECT * FROM history"),
    "t108_alert_breakdown": S.query(S.ALERTS, HISTORY, select=f"SELECT provider_id, cause, effect, count(*) AS alert_count, {S.half('quantile_cont(epoch(active_end - active_start)::DOUBLE / 60.0, 0.5)', 1)} AS median_minutes FROM history GROUP BY ALL"),
    "t109_archive_entries": S.query(S.ALERTS, entries("a", "true"), select="SELECT * FROM a"),
    "t109_archive_merged": S.query(S.ALERTS, entries("a", "captured_at_utc < TIMESTAMP '2024-01-15'"), entries("b", "captured_at_utc >= TIMESTAMP '2024-01-15'"),
      select=f"SELECT coalesce(a.provider_id, b.provider_id) AS provider_id, coalesce(a.stable_id, b.stable_id) AS stable_id, {', '.join(map(pick, ('header', 'description', 'severity', 'cause', 'effect')))}, coalesce(a.first_seen, b.first_seen) AS first_seen, greatest(a.last_seen, b.last_seen) AS last_seen, {united('routes')}, {united('periods')}, coalesce(a.archive_month, b.archive_month) AS archive_month FROM a FULL JOIN b ON a.stable_id = b.stable_id"),
    "t123_alert_versions": S.query(S.ALERTS, f"""h AS (SELECT DISTINCT provider_id, alert_id, {HASH} AS content_hash, captured_at_utc FROM alerts)""",
      select="""SELECT provider_id, alert_id, content_hash, min(captured_at_utc) AS first_seen, max(captured_at_utc) AS last_seen, (SELECT min(n.captured_at_utc) FROM h n WHERE n.alert_id = h.alert_id AND n.captured_at_utc > max(h.captured_at_utc)) AS valid_to FROM h GROUP BY provider_id, alert_id, content_hash"""),
    "t124_feed_health": S.query(FRESH, select="""SELECT 'P1' AS provider_id, 'feed' || k AS endpoint_key, age_seconds, greatest(900, 3 * (k * 20000 + 30))::INT AS threshold_seconds, CASE WHEN age_seconds IS NULL THEN 'missing' WHEN age_seconds > greatest(900, 3 * (k * 20000 + 30)) THEN 'stale' ELSE 'fresh' END AS state
      FROM range(5) t(k) LEFT JOIN fresh ON endpoint_key = 'feed' || k"""),
    "t127_range_pool": S.query(*R.SPINES, f"""span AS (SELECT * FROM route_spine WHERE provider_local_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-18'), folded AS (SELECT provider_id, route_id, count(DISTINCT provider_local_date) AS days, {R.SUMS} FROM span GROUP BY ALL),
      every AS (SELECT DISTINCT provider_id, route_id FROM route_spine)""",
      select=f"SELECT e.provider_id, e.route_id, {R.RATES}, coalesce(days, 0) AS day_count, CASE WHEN coalesce(days, 0) = 0 THEN 'no_data' WHEN days < 14 THEN 'partial' ELSE 'complete' END AS state FROM every e LEFT JOIN folded USING (provider_id, route_id)"),
    "t128_rate_change": S.query(*R.SPINES, R.windows("route_spine", "provider_id, route_id"), f"folded AS (SELECT provider_id, route_id, window_grain, period, {R.SUMS} FROM windowed GROUP BY ALL), rates AS (SELECT provider_id, route_id, window_grain, period, {R.RATES} FROM folded), "
      """pairs AS (SELECT n.provider_id, n.route_id, n.window_grain, n.otp_pct - b.otp_pct AS delta, n.on_time::DOUBLE AS k1, n.known_obs::DOUBLE AS n1, b.on_time::DOUBLE AS k2, b.known_obs::DOUBLE AS n2
        FROM (SELECT * FROM rates WHERE period = 'current') n LEFT JOIN (SELECT * FROM rates WHERE period = 'prior') b USING (provider_id, route_id, window_grain)),
      z AS (SELECT *, sqrt((k1 + k2) / (n1 + n2) * (1 - (k1 + k2) / (n1 + n2)) * (1 / n1 + 1 / n2)) AS se FROM pairs)""",
      select="SELECT provider_id, route_id, window_grain, delta, coalesce(n1 >= 30 AND n2 >= 30 AND se > 0 AND abs((k1 / n1 - k2 / n2) / nullif(se, 0)) >= 1.96::DOUBLE AND delta <> 0, false) AS significant FROM z"),
    "t129_stop_range": S.query(S.FACT, S.STOP_SPINE, f"folded AS (SELECT provider_id, stop_id, {POOL} FROM stop_spine WHERE provider_local_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-18' GROUP BY ALL), p AS (SELECT provider_id, stop_id, {R.POOLED} FROM folded)",
      select="SELECT * REPLACE (CASE WHEN obs >= 30 THEN otp_proxy_pct END AS otp_proxy_pct), obs < 30 AS withheld FROM p"),
    "t131_search": """WITH f AS (SELECT p_partkey, p_name, trim(regexp_replace(regexp_replace(lower(p_name), '[-_/.,''’]+', ' ', 'g'), '\\s+', ' ', 'g')) AS h FROM part),
      t AS (SELECT p_partkey, p_name, CASE WHEN h = 'part 1' THEN 0 WHEN starts_with(h, 'part 1') THEN 1 WHEN contains(h, 'part 1') THEN 2 WHEN contains(h, 'part') AND contains(h, '1') THEN 3 END::INT AS tier FROM f) SELECT * FROM t WHERE tier IS NOT NULL""",
    "t133_resolved_dates": S.query(S.FACT, S.STOP_SPINE, """a AS (SELECT DISTINCT stop_id, provider_local_date AS d FROM stop_spine), q AS (SELECT 'S' || k AS stop_id, DATE '2023-12-27' + (k % 43)::INT AS asked_date FROM range(60) t(k))""",
      select="""SELECT 'P1' AS provider_id, stop_id, asked_date, (SELECT d FROM a WHERE a.stop_id = q.stop_id ORDER BY abs(d - asked_date), d LIMIT 1) AS nearest, (SELECT max(d) FROM a WHERE a.stop_id = q.stop_id AND d <= asked_date) AS previous,
        (SELECT min(d) FROM a WHERE a.stop_id = q.stop_id AND d >= asked_date) AS next, coalesce((SELECT count(*) FROM a WHERE a.stop_id = q.stop_id AND d = asked_date) = 0, true) AS corrected FROM q"""),
}
