"""Building blocks of the SQL twins (DuckDB): the same derived tables and measures, written independently of the Spark plans."""

from __future__ import annotations

from punctua.constants import DELAY_EDGES, GAP_EDGES

# The tables' events lie in January, when the provider's clock is five hours behind UTC.
FACT = """
fact AS (
  SELECT *, CASE WHEN local_hour < 4 THEN snapshot_local_date - 1 ELSE snapshot_local_date END AS start_date
  FROM (
    SELECT 'P1' AS provider_id, event_id // 10 AS realtime_snapshot_id, (event_id % 10)::INT AS entity_index, ts::TIMESTAMP AS captured_at_utc,
      (ts - INTERVAL 5 HOUR)::DATE AS snapshot_local_date, strftime(ts - INTERVAL 5 HOUR, '%Y%m%d')::INT AS snapshot_date_key, extract(hour FROM ts - INTERVAL 5 HOUR)::INT AS local_hour,
      CASE WHEN event_id % 31 <> 0 THEN 'R' || (user_id % 12) END AS route_id, 'T' || (user_id % 60) AS trip_id,
      CASE WHEN event_id % 13 <> 0 THEN 'V' || (user_id % 40) END AS vehicle_id, CASE WHEN event_id % 29 <> 0 THEN event_id % 2 END::INT AS direction_id,
      CASE WHEN event_id % 19 <> 0 THEN 'S' || (event_id % 60) END AS delay_stop_id, (event_id % 8)::INT AS occupancy_status,
      CASE WHEN event_id % 23 = 0 THEN 3 END AS trip_schedule_relationship,
      CASE WHEN event_id % 17 <> 0 THEN (round(value * 100)::BIGINT * 7) % 4800 - 400 END::INT AS delay_seconds,
      (event_id % 20 + 1)::INT AS stop_time_update_count, least(event_id % 3, event_id % 20 + 1)::INT AS skipped_stop_count
    FROM events
  )
)"""

VEHICLES = """
vehicles AS (
  SELECT 'P1' AS provider_id, event_id // 10 AS realtime_snapshot_id, (event_id % 10)::INT AS entity_index, ts::TIMESTAMP AS captured_at_utc,
    CASE WHEN event_id % 37 <> 0 THEN 'V' || (user_id % 40) END AS vehicle_id, 'T' || (user_id % 60) AS trip_id, CASE WHEN event_id % 31 <> 0 THEN 'R' || (user_id % 12) END AS route_id,
    CASE WHEN event_id % 41 <> 0 THEN 45.0::DOUBLE + (event_id % 100) / 50.0::DOUBLE END AS latitude,
    CASE WHEN event_id % 43 = 0 THEN 190.0::DOUBLE ELSE -74.0::DOUBLE + (event_id % 90) / 60.0::DOUBLE END AS longitude, (event_id % 8)::INT AS occupancy_status,
    CASE WHEN event_id % 19 <> 0 THEN 'S' || (event_id % 60) END AS stop_id, CASE WHEN event_id % 5 <> 0 THEN (event_id * 7 % 360)::DOUBLE END AS bearing, CASE WHEN event_id % 6 <> 0 THEN (event_id % 23) / 2.0::DOUBLE END AS speed,
    CASE WHEN event_id % 9 <> 0 THEN date_trunc('second', ts)::TIMESTAMP - to_seconds(event_id % 30) END AS position_timestamp_utc
  FROM events
)"""

SCHEDULE = """
trips AS (
  SELECT 'P1' AS provider_id, 'T' || k AS trip_id, 'R' || CASE WHEN k < 60 THEN k % 12 ELSE 12 + k % 2 END AS route_id,
    ['WD', 'WE', 'ALL'][(k % 3 + 1)::INT] AS service_id, ((k // 12) % 2)::INT AS direction_id, 'H' || (k % 5) AS trip_headsign FROM range(72) t(k)
), stop_times AS (
  SELECT 'P1' AS provider_id, 'T' || k AS trip_id, n::INT AS stop_sequence, 'S' || ((k * 7 + n * 5) % 60) AS stop_id,
    (5 * 3600 + k * 840 + n * 185 + CASE WHEN k % 10 = 0 THEN 8 * 3600 ELSE 0 END)::INT AS secs FROM range(72) t(k), range(1, 9) u(n)
), dates AS (SELECT (DATE '2024-01-01' + d::INT) AS d FROM range(91) t(d)),
services AS (SELECT unnest(['WD', 'WE', 'ALL']) AS service_id),
running AS (
  SELECT service_id, d FROM services, dates
  WHERE CASE service_id WHEN 'WD' THEN isodow(d) <= 5 WHEN 'WE' THEN isodow(d) > 5 ELSE true END
    AND NOT (service_id = 'WD' AND d = DATE '2024-01-15') AND NOT (service_id = 'ALL' AND d = DATE '2024-01-20')
  UNION SELECT 'WE', DATE '2024-01-15'
), scheduled AS (
  SELECT t.provider_id, r.d AS provider_local_date, t.route_id, count(DISTINCT t.trip_id) AS scheduled_trip_count FROM trips t JOIN running r USING (service_id) GROUP BY ALL
)"""

ALERTS = """
alerts AS (
  SELECT 'P1' AS provider_id, k AS alert_row, 'A' || (user_id % 25) AS alert_id, 'Header ' || (k % 9) AS header, 'Text ' || (k % 7) AS description,
    CASE WHEN k % 5 <> 0 THEN 'sev' || (k % 3) END AS severity, 'cause' || (k % 4) AS cause, 'effect' || (k % 3) AS effect, date_trunc('day', ts)::TIMESTAMP AS active_start,
    CASE WHEN k % 4 <> 0 THEN date_trunc('day', ts)::TIMESTAMP + to_hours(k % 48 + 1) END AS active_end, ts::TIMESTAMP AS captured_at_utc,
    CASE WHEN k % 3 <> 0 THEN 'R' || (user_id % 12) END AS route_id, CASE WHEN k % 2 <> 0 THEN 'S' || (user_id % 60) END AS stop_id
  FROM (SELECT *, event_id AS k FROM events)
)"""


def half(x: str, digits: int) -> str:
    return f"round(({x})::DECIMAL(24,8), {digits})::DOUBLE"


def ratio(a: str, b: str) -> str:
    return f"({a})::DOUBLE / nullif(({b})::DOUBLE, 0)"


def shift(hour: str) -> str:
    return f"CASE WHEN {hour} BETWEEN 6 AND 8 THEN 'am_peak' WHEN {hour} BETWEEN 9 AND 14 THEN 'midday' WHEN {hour} BETWEEN 15 AND 18 THEN 'pm_peak' WHEN {hour} BETWEEN 19 AND 22 THEN 'evening' ELSE 'night' END"


def daytype(d: str) -> str:
    return f"CASE WHEN isodow({d}) <= 5 THEN 'weekday' ELSE 'weekend' END"


BAND = "CASE occupancy_status WHEN 0 THEN 'empty' WHEN 1 THEN 'many_seats' WHEN 2 THEN 'few_seats' WHEN 3 THEN 'standing' WHEN 4 THEN 'standing' WHEN 5 THEN 'full' END"
BIN_5M = "(TIMESTAMP '2000-01-01' + to_minutes(((epoch_us(captured_at_utc) - 946684800000000) // 300000000) * 5))"
CLAMP = "abs(delay_seconds) <= 3600"
SEVERE = "count(*) FILTER (delay_seconds > 300 AND abs(delay_seconds) <= 3600)"


def bins(x: str, edges: list, n: int, prefix: str = "h", where: str = "true") -> str:
    parts = []
    for i in range(n):
        low = "true" if i == 0 else f"{x} >= {edges[i]}"
        high = "true" if i == n - 1 else f"{x} < {edges[i + 1]}"
        parts.append(f"count(*) FILTER ({x} IS NOT NULL AND {low} AND {high} AND {where}) AS {prefix}{i}")
    return ", ".join(parts)


ROUTE_SPINE = f"""
fine AS (
  SELECT provider_id, route_id, snapshot_local_date AS provider_local_date, local_hour AS hour_of_day_local, coalesce(direction_id, 0) AS direction_id, {BIN_5M} AS bin,
    count(*) AS obs, count(delay_seconds) AS known, count(*) FILTER (delay_seconds >= -60 AND delay_seconds < 300) AS good, {SEVERE} AS bad,
    sum(delay_seconds) FILTER ({CLAMP}) AS total, {bins("delay_seconds", DELAY_EDGES, 21, "b", CLAMP)}, count(DISTINCT trip_id) FILTER (delay_seconds > 0) AS late
  FROM fact WHERE route_id IS NOT NULL GROUP BY ALL
), route_spine AS (
  SELECT provider_id, route_id, provider_local_date, hour_of_day_local, direction_id, sum(obs)::BIGINT AS observation_count, sum(known)::BIGINT AS delay_observation_count,
    CASE WHEN sum(known) > 0 THEN sum(good)::BIGINT END AS on_time_observation_count, sum(bad)::BIGINT AS severe_delay_count, coalesce(sum(total), 0)::BIGINT AS sum_delay_seconds,
    {", ".join(f"sum(b{i})::BIGINT AS h{i}" for i in range(21))}, sum(late)::BIGINT AS delayed_trip_count
  FROM fine GROUP BY ALL
)"""
INSIDE = " + ".join(f"h{i}" for i in range(21))

STOP_SPINE = f"""
stop_spine AS (
  SELECT provider_id, delay_stop_id AS stop_id, coalesce(route_id, '__unrouted__') AS route_id, snapshot_local_date AS provider_local_date, {shift("local_hour")} AS shift,
    count(*) AS observation_count, {SEVERE} AS severe_delay_count, sum(delay_seconds)::BIGINT AS sum_delay_seconds
  FROM fact WHERE delay_stop_id IS NOT NULL AND {CLAMP} GROUP BY ALL
)"""

OFFENDER_SPINE = f"""
entities AS (
  SELECT provider_id, route_id, snapshot_local_date AS provider_local_date, delay_seconds, 'trip' AS entity_kind, trip_id AS entity_id FROM fact WHERE route_id IS NOT NULL AND {CLAMP} AND trip_id IS NOT NULL
  UNION ALL SELECT provider_id, route_id, snapshot_local_date, delay_seconds, 'vehicle', vehicle_id FROM fact WHERE route_id IS NOT NULL AND {CLAMP} AND vehicle_id IS NOT NULL
), offender_spine AS (
  SELECT provider_id, entity_kind, entity_id, route_id, provider_local_date, count(*) AS observation_count, {SEVERE} AS severe_delay_count, sum(delay_seconds)::BIGINT AS sum_delay_seconds FROM entities GROUP BY ALL
)"""

STARTS = f"""
starts AS (
  SELECT *, {shift("hour_at")} AS shift FROM (
    SELECT provider_id, route_id, coalesce(direction_id, 0) AS direction_id, coalesce(start_date, snapshot_local_date) AS service_date, trip_id, snapshot_local_date AS provider_local_date,
      min(captured_at_utc) AS start, arg_min(local_hour, captured_at_utc) AS hour_at
    FROM fact WHERE route_id IS NOT NULL AND trip_id IS NOT NULL AND {CLAMP} GROUP BY ALL
  )
)"""
WHOLE_STARTS = STARTS.replace(", snapshot_local_date AS provider_local_date,", ",")


def gaps(group: str, source: str = "starts", where: str = "true") -> str:
    return f"""gaps AS (
  SELECT * FROM (SELECT *, (epoch_us(start) - epoch_us(lag(start) OVER (PARTITION BY {group} ORDER BY start)))::DOUBLE / 60000000.0 AS g FROM {source} WHERE {where}) WHERE g > 0 AND g < 240
)"""


HEADWAY_SPINE = f"""
{STARTS}, {gaps("provider_id, route_id, provider_local_date, direction_id, shift, service_date", where="isodow(service_date) <= 5 AND isodow(provider_local_date) <= 5")},
medians AS (SELECT provider_id, route_id, provider_local_date, direction_id, shift, quantile_cont(g, 0.5) AS median FROM gaps GROUP BY ALL),
counted AS (SELECT provider_id, route_id, provider_local_date, direction_id, shift, count(*) AS trip_count FROM starts WHERE isodow(service_date) <= 5 AND isodow(provider_local_date) <= 5 GROUP BY ALL),
headway_spine AS (
  SELECT provider_id, route_id, provider_local_date, direction_id, shift, count(*) AS gap_count, sum(g) AS sum_gap_min, sum(g * g) AS sum_gap_sq_min, count(*) FILTER (g < 0.5 * median) AS bunched_gap_count,
    {bins("g", GAP_EDGES, 20, "g")}, any_value(trip_count) AS trip_count
  FROM gaps JOIN medians USING (provider_id, route_id, provider_local_date, direction_id, shift) JOIN counted USING (provider_id, route_id, provider_local_date, direction_id, shift)
  GROUP BY provider_id, route_id, provider_local_date, direction_id, shift
)"""

SUMMARY_5M = f"""
summary_5m AS (
  SELECT provider_id, {BIN_5M} AS period_start_utc, coalesce(route_id, '__unrouted__') AS route_id, count(DISTINCT trip_id) AS trip_count, count(*) AS observation_count,
    count(delay_seconds) AS delay_observation_count, count(*) FILTER (delay_seconds >= -60 AND delay_seconds < 300) AS on_time_observation_count,
    {ratio("sum(delay_seconds)", "count(delay_seconds)")} AS avg_delay_seconds, {ratio(f"sum(delay_seconds) FILTER ({CLAMP})", f"count(delay_seconds) FILTER ({CLAMP})")} AS avg_delay_seconds_capped,
    max(delay_seconds) AS max_delay_seconds, max(delay_seconds) FILTER ({CLAMP}) AS max_delay_seconds_capped, min(delay_seconds) AS min_delay_seconds,
    count(DISTINCT trip_id) FILTER (delay_seconds > 0) AS delayed_trip_count, count(*) FILTER (abs(delay_seconds) > 3600) AS outlier_count, {SEVERE} AS severe_delay_observation_count
  FROM fact GROUP BY ALL
)"""

STOP_HOURLY = f"""
stop_hourly AS (
  SELECT provider_id, date_trunc('hour', captured_at_utc)::TIMESTAMP AS period_start_utc, delay_stop_id AS stop_id, coalesce(route_id, '__unrouted__') AS route_id, count(*) AS observation_count,
    {half(ratio("sum(delay_seconds)", "count(*)"), 2)} AS avg_arrival_delay_seconds, {half(ratio("sum(delay_seconds)", "count(*)"), 2)} AS avg_departure_delay_seconds, {SEVERE} AS severe_delay_count
  FROM fact WHERE delay_stop_id IS NOT NULL AND {CLAMP} GROUP BY ALL
)"""


def wilson(k: str, n: str, upper: bool) -> str:
    """One bound in percent; k is NULL or a count, n a count."""
    p, m = f"(least(greatest(({k})::DOUBLE, 0.0::DOUBLE), ({n})::DOUBLE) / nullif(({n})::DOUBLE, 0))", f"nullif(({n})::DOUBLE, 0)"
    z = "1.96::DOUBLE"
    middle = f"(({p} + {z} * {z} / (2.0::DOUBLE * {m})) / (1.0::DOUBLE + {z} * {z} / {m}))"
    margin = f"({z} * sqrt({p} * (1.0::DOUBLE - {p}) / {m} + {z} * {z} / (4.0::DOUBLE * {m} * {m})) / (1.0::DOUBLE + {z} * {z} / {m}))"
    bound = f"least(100.0::DOUBLE, ({middle} + {margin}) * 100.0)" if upper else f"greatest(0.0::DOUBLE, ({middle} - {margin}) * 100.0)"
    return f"CASE WHEN ({k}) IS NOT NULL AND ({n}) > 0 THEN {half(bound, 1)} END"


def percentile_of(hist: list[str], edges: list, q: float) -> str:
    """Interpolated quantile of histogram columns: the first bin at which the running count reaches the goal."""
    total = " + ".join(hist)
    before = []
    cases = []
    for i, h in enumerate(hist):
        so_far = " + ".join(before) or "0"
        value = f"{float(edges[i])}::DOUBLE" if i + 1 >= len(edges) else f"{float(edges[i])}::DOUBLE + {float(edges[i + 1] - edges[i])}::DOUBLE * (({q}::DOUBLE * ({total}) - ({so_far})) / {h}::DOUBLE)"
        cases.append(f"WHEN {h} > 0 AND ({so_far}) + {h} >= {q}::DOUBLE * ({total}) THEN {value}")
        before.append(h)
    return f"CASE WHEN ({total}) > 0 THEN CASE {' '.join(cases)} END END"


def query(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n" + select
