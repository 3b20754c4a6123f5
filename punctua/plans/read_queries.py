"""Queries of the read side (T80 to T116) on the driver's tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctua.constants import BANDS, DELAY_EDGES, GAP_EDGES, RATE_FLOOR
from punctua.operators import facts, reads, rollups
from punctua.plans import rollup_queries as P
from punctua.plans import sql as S
from punctua.plans.rollup_queries import scheduled
from punctua.sources import driver_tables as T

TODAY = "2024-01-31"


def spine(spark: SparkSession, d: str) -> DataFrame:
    return rollups.route_delay_spine(T.fact(spark, d))


def stops(spark: SparkSession, d: str) -> DataFrame:
    return rollups.stop_delay_spine(T.fact(spark, d))


def stop_shifts(spark: SparkSession, d: str) -> DataFrame:
    return rollups.stop_delay_shift_daily(T.fact(spark, d))


def offenders(spark: SparkSession, d: str) -> DataFrame:
    return rollups.repeat_offender_daily_spine(T.fact(spark, d))


def cancellations(spark: SparkSession, d: str) -> DataFrame:
    return rollups.route_cancellation_daily(T.fact(spark, d), scheduled(spark))


def planned(spark: SparkSession) -> DataFrame:
    running = facts.service_dates(T.calendar(spark), T.calendar_dates(spark)).where("service_date = DATE '2024-01-10'")
    times = T.stop_times(spark).withColumn("secs", facts.service_seconds(F.col("departure_time")))
    return reads.scheduled_headway(T.trips(spark), times, running)


def today() -> F.Column:
    return F.lit(TODAY).cast("date")


def flat_hist(df: DataFrame) -> DataFrame:
    return df.select(*(c for c in df.columns if c != "hist"), *(F.get("hist", F.lit(i)).alias(f"h{i}") for i in range(len(DELAY_EDGES))))


def problems(spark: SparkSession, d: str) -> DataFrame:
    return rollups.repeated_problem_route_stop(spine(spark, d), stops(spark, d))


def hotspots(spark: SparkSession, d: str) -> DataFrame:
    found = reads.hotspots(problems(spark, d), spine(spark, d), stops(spark, d))
    return found.select("provider_id", "entity_kind", "entity_id", "route_id", "issue_count", "severity_label", "rank", "otp_pct", "network_otp_pct", "otp_delta_points")


def names(spark: SparkSession) -> DataFrame:
    rows = [("P1", f"R{k}", f"Line {k}{v}", a, z) for k in range(12) for v, a, z in (("a", "2023-12-01 00:00:00", "2024-01-10 05:00:00"), ("b", "2024-01-10 05:00:00", None)) if k != 11 or v == "b"]
    h = spark.createDataFrame(rows, "provider_id string, route_id string, name string, a string, z string")
    return h.select("provider_id", "route_id", "name", F.col("a").cast("timestamp_ntz").alias("valid_from"), F.col("z").cast("timestamp_ntz").alias("valid_to"))


def gaps_flat(spark: SparkSession, d: str) -> DataFrame:
    found = reads.coverage_gaps(stops(spark, d), ["provider_id", "stop_id", "route_id"])
    return found.select("provider_id", "stop_id", "route_id", "first_date", "last_date", "day_count", F.size("gaps").cast("long").alias("gap_count"), F.get("gaps", F.lit(0))["gap_start"].alias("first_gap_start"), F.get("gaps", F.lit(0))["gap_end"].alias("first_gap_end"))


def on_spine(build):
    return lambda spark, d: build(spine(spark, d))


QUERIES = {
    "flagship": lambda spark, d: reads.route_folds(spine(spark, d), "shift"),
    "t80_projector": on_spine(lambda s: flat_hist(reads.project(s, ["provider_id", "route_id"]))),
    **{f"t81_route_by_{f}": on_spine(lambda s, f=f: reads.route_folds(s, f)) for f in reads.FOLDS},
    **{f"t82_network_by_{f}": on_spine(lambda s, f=f: reads.network_folds(s, f)) for f in ("shift", "day_type")},
    "t83_windowed_folds": on_spine(reads.windowed_folds),
    "t84_habits": on_spine(reads.habits),
    "t84_habits_windowed": on_spine(lambda s: reads.habits(reads.in_windows(s, ["provider_id", "route_id"]).where("window_grain = 'month' AND period = 'current'"), RATE_FLOOR)),
    "t92_windowed_headway": lambda spark, d: reads.windowed_headway(rollups.route_headway_shift_daily(T.fact(spark, d)), planned(spark)),
    "t93_weak_stops": lambda spark, d: reads.weak_stops(stops(spark, d)),
    "t94_weak_stops_scalar": lambda spark, d: reads.weak_stops_scalar(stops(spark, d)),
    "t95_last_30_cancellations": lambda spark, d: reads.last_days(reads.completeness(cancellations(spark, d)), ["provider_id", "route_id"]),
    "t95_last_30_skipped": lambda spark, d: reads.last_days(rollups.route_skipped_stop_daily(T.fact(spark, d)), ["provider_id", "route_id"]),
    **{f"t96_occupancy_{f}": lambda spark, d, f=f: reads.occupancy_window(rollups.route_occupancy_band_hourly(T.fact(spark, d)), today(), f) for f in ("total", "dow", "hour", "day")},
    "t97_crowding_delay": lambda spark, d: reads.crowding_delay(rollups.route_delay_by_crowding_daily(T.fact(spark, d)), today()),
    **{f"t98_stop_by_{f}": lambda spark, d, f=f: reads.stop_reliability(stop_shifts(spark, d), f) for f in ("week", "month", "route", "dow", "day", "grain")},
    "t98_stop_severe_matrix": lambda spark, d: reads.severe_matrix(T.fact(spark, d)),
    "t98_stop_latest_percentile": lambda spark, d: reads.newest(rollups.delay_percentiles_daily(T.fact(spark, d), "delay_stop_id", "stop_id"), ["provider_id", "stop_id"], "provider_local_date"),
    "t99_scheduled_headway": lambda spark, d: planned(spark),
    **{f"t100_network_trend_{g}": lambda spark, d, g=g: reads.network_trend(spine(spark, d), T.fact(spark, d), cancellations(spark, d), rollups.route_occupancy_band_daily(T.fact(spark, d)), today(), g) for g in ("day", "week", "month")},
    "t102_all_routes": on_spine(reads.all_routes),
    "t104_hotspots": hotspots,
    "t105_hotspots_by_grain": lambda spark, d: reads.hotspots_by_grain(spine(spark, d), stops(spark, d)),
    "t106_repeat_offenders": lambda spark, d: reads.top(rollups.repeat_offender(T.fact(spark, d), F.lit(P.NOW).cast("timestamp_ntz")), ["provider_id"], [F.desc("recurrence_days"), F.desc("avg_delay_seconds"), F.asc("entity_kind"), F.asc("entity_id"), F.asc("route_id")], 50),
    "t107_offenders_by_grain": lambda spark, d: reads.offenders_by_grain(offenders(spark, d)),
    "t111_hotspot_history": on_spine(reads.hotspot_history),
    "t112_offender_history": lambda spark, d: reads.offender_history(offenders(spark, d)),
    "t113_route_history": on_spine(lambda s: flat_hist(reads.month_partitions(s, ["provider_id", "route_id"]))),
    "t113_network_history": on_spine(lambda s: flat_hist(reads.month_partitions(s, ["provider_id"]))),
    "t114_coverage_gaps": gaps_flat,
    "t115_scope_digest": on_spine(lambda s: reads.scope_digest(s, ["provider_id", "route_id"], ["provider_local_date", "hour_of_day_local", "direction_id", "observation_count", "on_time_observation_count", "sum_delay_seconds"])),
    "t116_names_at": on_spine(lambda s: reads.names_at(s.groupBy("provider_id", "route_id", "provider_local_date").agg(F.sum("observation_count").alias("obs")), names(s.sparkSession), "route_id", T.TIME_ZONE)),
}

SPINES = (S.FACT, S.ROUTE_SPINE)
H = [f"h{i}" for i in range(21)]
SUMS = "sum(observation_count)::BIGINT AS obs, sum(delay_observation_count)::BIGINT AS known_obs, sum(on_time_observation_count)::BIGINT AS on_time, sum(severe_delay_count)::BIGINT AS severe, sum(sum_delay_seconds)::BIGINT AS total, " + ", ".join(f"sum({h})::BIGINT AS {h}" for h in H)
RATES = f"""obs, known_obs, on_time, severe, {S.half(S.ratio("100.0::DOUBLE * on_time", "known_obs"), 0)} AS otp_pct, {S.half(S.ratio("100.0::DOUBLE * severe", "known_obs"), 1)} AS severe_pct,
  {S.half(f"({S.ratio('total', ' + '.join(H))}) / 60.0::DOUBLE", 1)} AS avg_delay_min, {S.half(f"({S.percentile_of(H, DELAY_EDGES, 0.5)}) / 60.0::DOUBLE", 1)} AS p50_min,
  {S.half(f"({S.percentile_of(H, DELAY_EDGES, 0.9)}) / 60.0::DOUBLE", 1)} AS p90_min, {S.wilson("on_time", "known_obs", False)} AS wilson_lo, {S.wilson("on_time", "known_obs", True)} AS wilson_hi"""
DIMS = {"shift": S.shift("hour_of_day_local"), "day_type": S.daytype("provider_local_date"), "week": "date_trunc('week', provider_local_date)::DATE", "month": "date_trunc('month', provider_local_date)::DATE", "dow": "isodow(provider_local_date)::INT"}


def folded(key: str, dims: str, names_: str) -> str:
    return S.query(*SPINES, f"folded AS (SELECT {key}, {dims}, {SUMS} FROM route_spine GROUP BY ALL)", select=f"SELECT {key}, {names_}, {RATES} FROM folded")


CELLS = (("shift", DIMS["shift"], "NULL"), ("day_type", DIMS["day_type"], "NULL"), ("dow", DIMS["dow"], "NULL"), ("crosstab", DIMS["shift"], DIMS["day_type"]), ("habit", DIMS["dow"], "hour_of_day_local"))


def section(name: str, source: str, window: str, where: str, grain: str, second: str) -> str:
    """The rows of a section of all routes, of all days or of windows."""
    columns = "window_grain, period" if window == "w" else "NULL::VARCHAR AS window_grain, NULL::VARCHAR AS period"
    measures = ", ".join(("provider_id", "route_id", "observation_count", "delay_observation_count", "on_time_observation_count", "severe_delay_count", "sum_delay_seconds", *H))
    return f"SELECT '{name}' AS section, {columns}, ({grain})::VARCHAR AS grain, ({second})::VARCHAR AS grain_2, {measures} FROM {source} WHERE {where}"


def windows(source: str, key: str) -> str:
    return f"""anchors AS (SELECT {key}, max(provider_local_date) AS anchor FROM {source} GROUP BY {key}),
  grains AS (SELECT * FROM (VALUES ('day', 1), ('week', 7), ('month', 30)) t(window_grain, days)),
  windowed AS (
    SELECT s.*, g.window_grain, CASE WHEN provider_local_date > anchor - g.days THEN 'current' ELSE 'prior' END AS period
    FROM {source} s JOIN anchors USING ({key}) JOIN grains g ON provider_local_date > anchor - 2 * g.days AND provider_local_date <= anchor
  )"""


POOL = "sum(observation_count)::BIGINT AS obs, sum(severe_delay_count)::BIGINT AS severe, sum(sum_delay_seconds)::BIGINT AS total"
POOLED = f"obs, severe, {S.half('(' + S.ratio('total', 'obs') + ') / 60.0::DOUBLE', 1)} AS avg_delay_min, {S.half(S.ratio('100.0::DOUBLE * (obs - severe)', 'obs'), 0)} AS otp_proxy_pct, {S.wilson('obs - severe', 'obs', False)} AS wilson_lo"
SHARES = ", ".join(f"{S.half(S.ratio(f'100.0::DOUBLE * sum({b}_count)', 'sum(observation_count)'), 1)} AS {b}_pct" for b in BANDS)
HOURLY_BANDS = f"""hourly AS (SELECT provider_id, snapshot_local_date AS provider_local_date, coalesce(route_id, '__unrouted__') AS route_id, local_hour AS hour_of_day_local, count(*) AS observation_count,
  {", ".join(f"count(*) FILTER (band = '{b}') AS {b}_count" for b in BANDS)} FROM (SELECT *, {S.BAND} AS band FROM fact) WHERE band IS NOT NULL GROUP BY ALL)"""
CANCEL = f"""trip_days AS (SELECT provider_id, route_id, trip_id, start_date AS provider_local_date, max(CASE WHEN trip_schedule_relationship = 3 THEN 1 ELSE 0 END) AS gone FROM fact
    WHERE route_id IS NOT NULL AND snapshot_local_date BETWEEN start_date AND start_date + 1 GROUP BY ALL),
  seen AS (SELECT provider_id, provider_local_date, route_id, count(*) AS total, sum(gone)::BIGINT AS gone FROM trip_days GROUP BY ALL),
  cancel AS (SELECT provider_id, provider_local_date, route_id, coalesce(total, 0) AS total_trip_days, coalesce(gone, 0) AS canceled_trip_days, {S.half(S.ratio("100.0 * gone", "total"), 2)} AS cancellation_rate_pct, scheduled_trip_count AS scheduled_trip_days,
    coalesce(total, 0) - coalesce(gone, 0) AS delivered_trip_days, CASE WHEN scheduled_trip_count IS NOT NULL THEN greatest(scheduled_trip_count - coalesce(total, 0), 0) END AS silent_trip_days
    FROM seen FULL JOIN scheduled USING (provider_id, provider_local_date, route_id))"""
HEAD = [f"g{i}" for i in range(20)]
PLANNED = f"""first_stop AS (SELECT trip_id, secs FROM stop_times WHERE stop_sequence = 1),
  active AS (SELECT t.*, f.secs FROM trips t JOIN first_stop f USING (trip_id) JOIN running r ON r.service_id = t.service_id AND r.d = DATE '2024-01-10'),
  best_dir AS (SELECT route_id, direction_id FROM active GROUP BY route_id, direction_id QUALIFY row_number() OVER (PARTITION BY route_id ORDER BY count(*) DESC, direction_id) = 1),
  minutes AS (SELECT DISTINCT provider_id, route_id, {S.shift("(secs // 3600) % 24")} AS shift, CASE WHEN secs < 86400 AND secs // 3600 < 6 THEN secs // 60 + 1440 ELSE secs // 60 END AS m FROM active JOIN best_dir USING (route_id, direction_id)),
  planned AS (SELECT provider_id, route_id, shift, {S.half("quantile_cont(gap, 0.5)", 1)} AS scheduled_headway_min, count(gap) AS gap_count
    FROM (SELECT *, m - lag(m) OVER (PARTITION BY route_id, shift ORDER BY m) AS gap FROM minutes) WHERE gap IS NOT NULL GROUP BY ALL)"""
MEDIAN = S.percentile_of(HEAD, GAP_EDGES, 0.5)
BUNCHED = "100.0::DOUBLE * (" + " + ".join(f"{h}::DOUBLE * least(1.0::DOUBLE, greatest(0.0::DOUBLE, (0.5::DOUBLE * median - {GAP_EDGES[i]}) / {GAP_EDGES[i + 1] - GAP_EDGES[i]}))" for i, h in enumerate(HEAD)) + f") / ({' + '.join(HEAD)})"
OFFENDERS = f"""found AS (SELECT provider_id, entity_kind, entity_id, route_id, count(DISTINCT provider_local_date) FILTER (delay_seconds > 300) AS recurrence_days, {S.half(S.ratio("sum(delay_seconds)", "count(*)"), 1)} AS avg_delay_seconds FROM entities GROUP BY ALL),
  offenders AS (SELECT *, CASE WHEN recurrence_days >= 10 OR avg_delay_seconds > 600 THEN 'critical' WHEN recurrence_days >= 5 THEN 'high' ELSE 'watch' END AS severity_label FROM found WHERE recurrence_days >= 3)"""


def stop_fold(dim: str) -> str:
    return S.query(S.FACT, S.STOP_SPINE, f"folded AS (SELECT provider_id, stop_id, {dim} AS grain, {POOL} FROM stop_spine GROUP BY ALL)", select=f"SELECT provider_id, stop_id, grain, {POOLED} FROM folded")


def trend(unit: str) -> str:
    d = "provider_local_date" if unit == "day" else f"date_trunc('{unit}', provider_local_date)::DATE"
    by_day = unit == "day"
    return S.query(*SPINES, S.SCHEDULE, CANCEL, HOURLY_BANDS, f"""folded AS (SELECT provider_id, {d} AS d, {SUMS} FROM route_spine WHERE provider_local_date >= DATE '{TODAY}' - {90 if by_day else 371} GROUP BY ALL), rates AS (SELECT provider_id, d, {RATES} FROM folded),
      cars AS (SELECT provider_id, snapshot_local_date AS d, {S.half("quantile_cont(delay_seconds, 0.9) / 60.0::DOUBLE", 1)} AS fact_p90_min, count(DISTINCT vehicle_id) AS vehicle_count FROM fact WHERE {S.CLAMP} AND captured_at_utc >= TIMESTAMP '{TODAY}' - INTERVAL 14 DAY AND {str(by_day).lower()} GROUP BY ALL),
      c AS (SELECT provider_id, {d} AS d, {S.half(S.ratio("100.0::DOUBLE * sum(canceled_trip_days)", "sum(total_trip_days)"), 2)} AS cancellation_rate_pct,
        CASE WHEN sum(scheduled_trip_days) > 0 THEN least(100.0::DOUBLE, {S.half(S.ratio("100.0::DOUBLE * sum(delivered_trip_days) FILTER (scheduled_trip_days IS NOT NULL)", "sum(scheduled_trip_days)"), 2)}) END AS completeness_pct FROM cancel GROUP BY ALL),
      o AS (SELECT provider_id, {d} AS d, {SHARES} FROM hourly GROUP BY ALL)""",
      select="SELECT * FROM rates FULL JOIN c USING (provider_id, d) FULL JOIN o USING (provider_id, d) FULL JOIN cars USING (provider_id, d)")


VALUES = ("delay_observation_count", "severe_delay_count", "on_time_observation_count")
ROLLED = ", ".join(f"sum({v}) OVER (PARTITION BY provider_id, route_id ORDER BY provider_local_date RANGE BETWEEN INTERVAL {n - 1} DAY PRECEDING AND CURRENT ROW)::BIGINT AS {v}_{n}d" for v in VALUES for n in (1, 7, 30))
WEEK_TO_DATE = ", ".join(f"sum({v}) OVER (PARTITION BY provider_id, route_id, date_trunc('week', provider_local_date) ORDER BY provider_local_date)::BIGINT AS {v}_wtd" for v in VALUES)
BACK = "OVER (PARTITION BY provider_id, entity_kind, entity_id, route_id ORDER BY provider_local_date RANGE BETWEEN INTERVAL 13 DAY PRECEDING AND CURRENT ROW)"

ORACLE_SQL = {
    "flagship": folded("provider_id, route_id", f"{DIMS['shift']} AS grain", "grain"),
    "t80_projector": S.query(*SPINES, select=f"SELECT provider_id, route_id, {SUMS.replace('AS total', 'AS sum_delay_sec')} FROM route_spine GROUP BY ALL"),
    **{f"t81_route_by_{f}": folded("provider_id, route_id", f"{x} AS grain", "grain") for f, x in DIMS.items()},
    "t81_route_by_crosstab": folded("provider_id, route_id", f"{DIMS['shift']} AS shift, {DIMS['day_type']} AS day_type", "shift, day_type"),
    **{f"t82_network_by_{f}": folded("provider_id", f"{DIMS[f]} AS grain", "grain") for f in ("shift", "day_type")},
    "t83_windowed_folds": S.query(*SPINES, windows("route_spine", "provider_id, route_id"), f"folded AS (SELECT provider_id, route_id, window_grain, period, {SUMS} FROM windowed GROUP BY ALL), rates AS (SELECT provider_id, route_id, window_grain, period, {RATES} FROM folded)",
      select="""SELECT n.* EXCLUDE (period), b.otp_pct AS prior_otp_pct, b.known_obs AS prior_known_obs, b.on_time AS prior_on_time, n.otp_pct - b.otp_pct AS otp_delta_points
        FROM (SELECT * FROM rates WHERE period = 'current') n LEFT JOIN (SELECT * FROM rates WHERE period = 'prior') b USING (provider_id, route_id, window_grain)"""),
    **{name: S.query(*SPINES, *parts, f"""cells AS (SELECT provider_id, route_id, isodow(provider_local_date)::INT AS day_of_week_iso, hour_of_day_local, sum(delay_observation_count)::BIGINT AS known_obs,
        least({S.half(f"sum(severe_delay_count)::DOUBLE * 10.0 + greatest(coalesce({S.half(S.ratio('sum(sum_delay_seconds)', f'sum({S.INSIDE})'), 2)}, 0.0::DOUBLE), 0.0::DOUBLE) / 60.0::DOUBLE", 4)}, 9999.9999::DOUBLE) AS raw FROM {source} WHERE {where} GROUP BY ALL),
        scored AS (SELECT *, CASE WHEN known_obs >= {floor} THEN raw END AS score FROM cells)""",
        select=f"SELECT provider_id, route_id, day_of_week_iso, hour_of_day_local, known_obs, score, CASE WHEN max(score) OVER (PARTITION BY route_id) > 0 THEN {S.half('score / max(score) OVER (PARTITION BY route_id)', 4)} END AS share FROM scored")
       for name, parts, source, where, floor in (("t84_habits", [], "route_spine", "true", 0), ("t84_habits_windowed", [windows("route_spine", "provider_id, route_id")], "windowed", "window_grain = 'month' AND period = 'current'", 30))},
    "t92_windowed_headway": S.query(S.FACT, S.HEADWAY_SPINE, S.SCHEDULE, PLANNED, windows("headway_spine", "provider_id, route_id"), f"""
      w AS (SELECT * FROM windowed WHERE period = 'current'),
      best AS (SELECT provider_id, route_id, window_grain, direction_id FROM w GROUP BY provider_id, route_id, window_grain, direction_id QUALIFY row_number() OVER (PARTITION BY provider_id, route_id, window_grain ORDER BY sum(trip_count) DESC, direction_id) = 1),
      pooled AS (SELECT provider_id, route_id, window_grain, shift, sum(gap_count)::BIGINT AS n, round(sum(sum_gap_min), 4) AS s, round(sum(sum_gap_sq_min), 4) AS q, {", ".join(f"sum({h})::BIGINT AS {h}" for h in HEAD)} FROM w JOIN best USING (provider_id, route_id, window_grain, direction_id) GROUP BY ALL),
      m AS (SELECT *, {MEDIAN} AS median FROM pooled)""",
      select=f"""SELECT provider_id, route_id, window_grain, shift, n AS gap_count, {S.half("median", 1)} AS observed_headway_min, CASE WHEN n >= 2 AND s > 0 THEN {S.half("sqrt(greatest((q - s * s / n) / (n - 1), 0)) / (s / n)", 4)} END AS headway_cov,
        {S.half(BUNCHED, 1)} AS bunched_pct, CASE WHEN s > 0 AND scheduled_headway_min IS NOT NULL THEN {S.half("greatest(0.0::DOUBLE, q / (2.0::DOUBLE * s) - scheduled_headway_min / 2.0::DOUBLE)", 1)} END AS excess_wait_min
        FROM m LEFT JOIN planned USING (provider_id, route_id, shift)"""),
    "t93_weak_stops": S.query(S.FACT, S.STOP_SPINE, "rs AS (SELECT * FROM stop_spine WHERE route_id <> '__unrouted__')", windows("rs", "provider_id, route_id"),
      f"folded AS (SELECT provider_id, route_id, window_grain, stop_id, {POOL} FROM windowed WHERE period = 'current' GROUP BY ALL), p AS (SELECT provider_id, route_id, window_grain, stop_id, {POOLED} FROM folded WHERE obs >= 30)",
      select="SELECT *, row_number() OVER (PARTITION BY provider_id, route_id, window_grain ORDER BY wilson_lo, avg_delay_min DESC, stop_id)::INT AS rank FROM p QUALIFY rank <= 15"),
    "t94_weak_stops_scalar": S.query(S.FACT, S.STOP_SPINE, "rs AS (SELECT * FROM stop_spine WHERE route_id <> '__unrouted__')", windows("rs", "provider_id, route_id"),
      f"folded AS (SELECT provider_id, route_id, stop_id, {POOL} FROM windowed WHERE period = 'current' AND window_grain = 'month' GROUP BY ALL), p AS (SELECT provider_id, route_id, stop_id, {POOLED} FROM folded)",
      select="SELECT *, row_number() OVER (PARTITION BY provider_id, route_id ORDER BY avg_delay_min DESC, stop_id)::INT AS rank FROM p QUALIFY rank <= 15"),
    "t95_last_30_cancellations": S.query(S.FACT, S.SCHEDULE, CANCEL, select=f"""SELECT *, CASE WHEN scheduled_trip_days > 0 THEN least(100.0::DOUBLE, {S.half(S.ratio("100.0::DOUBLE * delivered_trip_days", "scheduled_trip_days"), 2)}) END AS completeness_pct
      FROM cancel QUALIFY row_number() OVER (PARTITION BY provider_id, route_id ORDER BY provider_local_date DESC) <= 30"""),
    "t95_last_30_skipped": S.query(S.FACT, f"""skipped AS (SELECT provider_id, snapshot_local_date AS provider_local_date, route_id, sum(stop_time_update_count)::BIGINT AS stop_time_update_count, sum(skipped_stop_count)::BIGINT AS skipped_stop_count,
      {S.half(S.ratio("100.0 * sum(skipped_stop_count)", "sum(stop_time_update_count)"), 2)} AS skipped_stop_rate_pct FROM fact WHERE route_id IS NOT NULL GROUP BY ALL)""",
      select="SELECT * FROM skipped QUALIFY row_number() OVER (PARTITION BY provider_id, route_id ORDER BY provider_local_date DESC) <= 30"),
    **{f"t96_occupancy_{f}": S.query(S.FACT, HOURLY_BANDS, select=f"SELECT provider_id, route_id{x}, sum(observation_count)::BIGINT AS observation_count, {SHARES} FROM hourly WHERE provider_local_date >= DATE '{TODAY}' - 30 GROUP BY ALL")
       for f, x in (("total", ""), ("dow", ", isodow(provider_local_date)::INT AS day_of_week_iso"), ("hour", ", hour_of_day_local"), ("day", ", provider_local_date"))},
    "t97_crowding_delay": S.query(S.FACT, f"""daily AS (SELECT provider_id, snapshot_local_date AS provider_local_date, route_id, band, count(*) AS n, sum(delay_seconds) AS s, {S.half("quantile_cont(delay_seconds, 0.5)", 2)} AS p FROM (SELECT *, {S.BAND} AS band FROM fact) WHERE band IS NOT NULL AND route_id IS NOT NULL AND {S.CLAMP} GROUP BY ALL)""",
      select=f"""SELECT provider_id, route_id, band, sum(n)::BIGINT AS observation_count, count(DISTINCT provider_local_date) AS day_count, {S.half("(" + S.ratio("sum(s)", "sum(n)") + ") / 60.0::DOUBLE", 1)} AS avg_delay_min,
        {S.half("(" + S.ratio("round(sum(p * n), 4)", "sum(n)") + ") / 60.0::DOUBLE", 1)} AS p50_min FROM daily WHERE provider_local_date >= DATE '{TODAY}' - 30 GROUP BY ALL"""),
    **{f"t98_stop_by_{f}": stop_fold(x) for f, x in (("week", DIMS["week"]), ("month", DIMS["month"]), ("route", "route_id"), ("dow", DIMS["dow"]))},
    "t98_stop_by_day": S.query(S.FACT, S.STOP_SPINE, f"folded AS (SELECT provider_id, stop_id, provider_local_date AS grain, {POOL} FROM stop_spine GROUP BY ALL)", select=f"SELECT provider_id, stop_id, grain, {POOLED} FROM folded QUALIFY row_number() OVER (PARTITION BY provider_id, stop_id ORDER BY grain DESC) <= 90"),
    "t98_stop_by_grain": S.query(S.FACT, S.STOP_SPINE, f"folded AS (SELECT provider_id, stop_id, 'shift' AS kind, shift AS grain, {POOL} FROM stop_spine GROUP BY ALL UNION ALL SELECT provider_id, stop_id, 'day_type', {DIMS['day_type']}, {POOL} FROM stop_spine GROUP BY ALL)", select=f"SELECT provider_id, stop_id, kind, grain, {POOLED} FROM folded"),
    "t98_stop_severe_matrix": S.query(S.FACT, select=f"SELECT provider_id, delay_stop_id AS stop_id, isodow(snapshot_local_date)::INT AS day_of_week_iso, local_hour AS hour_of_day_local, count(*) AS severe_count FROM fact WHERE delay_stop_id IS NOT NULL AND delay_seconds > 300 AND {S.CLAMP} GROUP BY ALL"),
    "t98_stop_latest_percentile": S.query(S.FACT, f"""p AS (SELECT provider_id, snapshot_local_date AS provider_local_date, delay_stop_id AS stop_id, {S.half("quantile_cont(delay_seconds, 0.5)", 2)} AS p50_delay_seconds, {S.half("quantile_cont(delay_seconds, 0.9)", 2)} AS p90_delay_seconds, count(*) AS delay_observation_count
      FROM fact WHERE delay_stop_id IS NOT NULL AND {S.CLAMP} GROUP BY ALL)""", select="SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY stop_id ORDER BY provider_local_date DESC) = 1"),
    "t99_scheduled_headway": S.query(S.SCHEDULE, PLANNED, select="SELECT * FROM planned"),
    **{f"t100_network_trend_{g}": trend(g) for g in ("day", "week", "month")},
    "t102_all_routes": S.query(*SPINES, windows("route_spine", "provider_id, route_id"), "sections AS (" + " UNION ALL ".join(
        [section(n, "route_spine", "NULL", "true", g, h) for n, g, h in (("week", DIMS["week"], "NULL"), ("month", DIMS["month"], "NULL"), *CELLS)] + [section(n, "windowed", "w", "true" if n in ("all", "shift", "day_type") else "period = 'current'", g, h) for n, g, h in (("all", "'all'", "NULL"), *CELLS)]) + ")",
      f"folded AS (SELECT provider_id, route_id, section, window_grain, period, grain, grain_2, {SUMS} FROM sections GROUP BY ALL)",
      select=f"SELECT provider_id, route_id, section, window_grain, period, grain, grain_2, {RATES}, CASE WHEN section = 'habit' THEN least(9999.9999::DOUBLE, {S.half('severe * 10.0::DOUBLE + greatest(coalesce(' + S.half(S.ratio('total', ' + '.join(H)), 2) + ', 0), 0) / 60.0::DOUBLE', 4)}) END AS problem_score FROM folded"),
    "t106_repeat_offenders": S.query(S.FACT, P.RECENT, P.of_recent(S.OFFENDER_SPINE), OFFENDERS, select="SELECT *, row_number() OVER (PARTITION BY provider_id ORDER BY recurrence_days DESC, avg_delay_seconds DESC, entity_kind, entity_id, route_id)::INT AS rank FROM offenders QUALIFY rank <= 50"),
    "t107_offenders_by_grain": S.query(S.FACT, S.OFFENDER_SPINE, windows("offender_spine", "provider_id"), f"""found AS (SELECT provider_id, window_grain, entity_kind, entity_id, route_id, count(DISTINCT provider_local_date) FILTER (severe_delay_count > 0) AS recurrence, count(DISTINCT provider_local_date) AS observed_days, sum(observation_count)::BIGINT AS obs,
      {S.half(S.ratio("sum(sum_delay_seconds)", "sum(observation_count)"), 1)} AS avg_delay_seconds FROM windowed WHERE period = 'current' AND window_grain <> 'day' GROUP BY ALL)""",
      select="SELECT *, recurrence < 3 AS is_tray, row_number() OVER (PARTITION BY provider_id, window_grain, recurrence < 3 ORDER BY recurrence DESC, avg_delay_seconds DESC, entity_kind, entity_id, route_id)::INT AS rank FROM found WHERE recurrence >= 2 QUALIFY rank <= CASE WHEN is_tray THEN 60 ELSE 50 END"),
    "t111_hotspot_history": S.query(*SPINES, "daily AS (SELECT provider_id, route_id, provider_local_date, " + ", ".join(f"sum({v}) AS {v}" for v in VALUES) + " FROM route_spine GROUP BY ALL)", select=f"SELECT provider_id, route_id, provider_local_date, {ROLLED}, {WEEK_TO_DATE} FROM daily"),
    "t112_offender_history": S.query(S.FACT, S.OFFENDER_SPINE, f"rolled AS (SELECT *, sum(CASE WHEN severe_delay_count > 0 THEN 1 ELSE 0 END) {BACK}::BIGINT AS bad, sum(sum_delay_seconds) {BACK} AS s, sum(observation_count) {BACK} AS n FROM offender_spine)",
      select=f"SELECT provider_id, entity_kind, entity_id, route_id, provider_local_date, bad AS recurrence_days, {S.half(S.ratio('s', 'n'), 1)} AS avg_delay_seconds FROM rolled WHERE bad >= 3"),
    **{f"t113_{n}_history": S.query(*SPINES, select=f"SELECT {k}, provider_local_date, strftime(provider_local_date, '%Y-%m') AS month, {SUMS.replace('AS total', 'AS sum_delay_sec')} FROM route_spine GROUP BY ALL") for n, k in (("route", "provider_id, route_id"), ("network", "provider_id"))},
    "t114_coverage_gaps": S.query(S.FACT, S.STOP_SPINE, """days AS (SELECT DISTINCT provider_id, stop_id, route_id, provider_local_date AS d FROM stop_spine),
      steps AS (SELECT *, lag(d) OVER (PARTITION BY provider_id, stop_id, route_id ORDER BY d) AS before FROM days)""",
      select="""SELECT provider_id, stop_id, route_id, min(d) AS first_date, max(d) AS last_date, count(*) AS day_count, count(*) FILTER (d - before > 1) AS gap_count,
        min(before + 1) FILTER (d - before > 1) AS first_gap_start, min(d - 1) FILTER (d - before > 1) AS first_gap_end FROM steps GROUP BY ALL"""),
    "t115_scope_digest": S.query(*SPINES, "framed AS (SELECT provider_id, route_id, strftime(provider_local_date, '%Y-%m') AS month, sha256(concat_ws(chr(31), " + ", ".join(f"CASE WHEN {c} IS NULL THEN 'n' ELSE 'v' || {c} END" for c in ("provider_local_date", "hour_of_day_local", "direction_id", "observation_count", "on_time_observation_count", "sum_delay_seconds")) + ")) AS d FROM route_spine)",
      select="SELECT provider_id, route_id, month, sha256(string_agg(d, chr(30) ORDER BY d)) AS digest, count(*) AS row_count FROM framed GROUP BY ALL"),
    "t116_names_at": S.query(*SPINES, """names AS (SELECT 'R' || k AS route_id, 'Line ' || k || v AS name, a, z FROM range(12) t(k), (VALUES ('a', TIMESTAMP '2023-12-01', TIMESTAMP '2024-01-10 05:00:00'), ('b', TIMESTAMP '2024-01-10 05:00:00', NULL)) u(v, a, z) WHERE k <> 11 OR v = 'b'),
      obs AS (SELECT provider_id, route_id, provider_local_date, sum(observation_count)::BIGINT AS obs FROM route_spine GROUP BY ALL),
      held AS (SELECT o.route_id, o.provider_local_date, arg_max(n.name, n.a) AS name FROM obs o JOIN names n ON n.route_id = o.route_id AND n.a < (o.provider_local_date + 1)::TIMESTAMP + INTERVAL 5 HOUR AND (n.z IS NULL OR n.z >= (o.provider_local_date + 1)::TIMESTAMP + INTERVAL 5 HOUR) GROUP BY ALL)""",
      select="SELECT o.*, h.name FROM obs o LEFT JOIN held h USING (route_id, provider_local_date)"),
}
