"""Queries of alert snapshots (T68, T122, T123): read as JSON, loaded in several batches; and their SQL twins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctua.operators import alert_load, alerts
from punctua.plans import sql as S
from punctua.session import stored
from punctua.sources import alert_json
from punctua.sources import driver_tables as T

#: Captures from which on a batch begins, and the clock of the current view.
BATCHES = ("2024-01-01 00:00:00", "2024-01-11 06:00:00", "2024-01-22 18:00:00")
NOW = "2024-01-16 12:00:00"
LAST = "2024-01-28"


def load(spark: SparkSession, d: str, batches: Sequence[str] = BATCHES) -> alert_load.Loaded:
    """The state after all batches; between batches it is a table."""
    snapshots = stored(T.alert_snapshots(spark, d), "alert-snapshots")
    state = None
    for first, until in zip(batches, (*batches[1:], "9999-01-01 00:00:00"), strict=True):
        rows = snapshots.where((F.col("captured_at_utc") >= F.lit(first).cast("timestamp_ntz")) & (F.col("captured_at_utc") < F.lit(until).cast("timestamp_ntz")))
        batch = stored(alert_json.normalized(rows), "alert-batch")
        state = alert_load.loaded(batch, rows.drop("payload"), state)
        state = alert_load.Loaded(*(stored(part, f"alert-{name}") for name, part in zip(state._fields, state, strict=True)))
    return state


def loaded_rows(spark: SparkSession, d: str) -> DataFrame:
    state = load(spark, d)
    key = list(alert_load.KEY)
    spelled = lambda c: F.coalesce(F.col(c), F.lit("-"))
    entities = state.entities.groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("entity_index", F.concat_ws("/", spelled("route_id"), spelled("stop_id")).alias("e")))), lambda x: x["e"]), ",").alias("entities"))
    periods = state.periods.groupBy(*key).agg(F.count(F.lit(1)).alias("period_count"))
    rows = state.alerts.join(entities.hint("merge"), key, "left").join(periods.hint("merge"), key, "left")
    return rows.select(*key, "content_hash", "alert_id", "header", "header_en", "url", "active_start", "active_end", "first_seen", "last_seen", "valid_to", "entities", "period_count")


def coverage(spark: SparkSession, d: str) -> DataFrame:
    snapshots = T.alert_snapshots(spark, d)
    days = alert_json.feed_observations(snapshots, T.TIME_ZONE).select("provider_id", "observation_date", F.lit(True).alias("observed"), F.lit(True).alias("supported"))
    return alerts.language_coverage(alert_json.language_observations(snapshots, T.TIME_ZONE), days, F.lit(LAST).cast("date"))


QUERIES = {
    "t68_current_alerts": lambda spark, d: alert_load.current(load(spark, d, BATCHES[:1]), F.lit(NOW).cast("timestamp_ntz")),
    "t122_language_coverage": coverage,
    "t123_alert_load": loaded_rows,
}

TOLD = """
captures AS (SELECT event_id // 10 AS s, date_trunc('second', max(ts))::TIMESTAMP AS seen FROM events GROUP BY ALL),
told AS (
  SELECT s, j, u, seen, 'Avis ' || (n % 5) AS header, 'Texte ' || (n % 7) AS description, 'sev' || (n % 3) AS severity, 'cause' || (slot % 4) AS cause, 'effect' || (n % 2) AS effect, CASE WHEN j <> 9 THEN 'A' || slot END AS alert_id,
    CASE WHEN u % 3 = 0 THEN 'Notice ' || (n % 5) || ' of ' || u END AS header_en, CASE WHEN u % 4 = 0 THEN 'https://example.org/' || u END AS url, 1704067200 + n * 600 AS a, CASE WHEN j % 4 <> 0 THEN 1704067200 + n * 600 + 3600 * (slot + 1) END AS z,
    CASE WHEN j % 5 = 0 THEN 1704067200 + n * 600 + 86400 END AS more, 'R' || (u % 12) AS route, 'S' || (u % 60) AS stop, n
  FROM (SELECT event_id // 10 AS s, event_id % 10 AS j, user_id AS u, CASE WHEN event_id % 10 = 8 THEN 7 ELSE event_id % 10 END AS slot, (event_id // 10) // (slot + 2) AS n FROM events) JOIN captures USING (s)
  WHERE s % 13 <> 5
)"""
#: One snapshot after the other: what is open after each, with the row that it continues.
LOAD = """
sights AS (
  SELECT dense_rank() OVER (ORDER BY seen, s) AS seq, *,
    md5(concat_ws(chr(31), coalesce(alert_id, ''), header, description, severity, cause, effect, a::VARCHAR, coalesce(z::VARCHAR, ''), '', '') || CASE WHEN more IS NULL THEN '' ELSE chr(31) || more || ':' END) AS h
  FROM told
), once AS (SELECT * FROM sights QUALIFY row_number() OVER (PARTITION BY seq, h ORDER BY j) = 1),
open AS (
  SELECT seq, h, s AS s0, j AS j0, seen AS first_seen, seen AS captured, seen AS last_seen, header_en, url FROM once WHERE seq = 1
  UNION ALL
  SELECT c.seq, c.h, coalesce(o.s0, c.s), coalesce(o.j0, c.j), coalesce(o.first_seen, c.seen), coalesce(o.captured, c.seen), c.seen, coalesce(c.header_en, o.header_en), coalesce(c.url, o.url)
  FROM (SELECT max(seq) AS seq FROM open) p JOIN once c ON c.seq = p.seq + 1 LEFT JOIN open o ON o.h = c.h
), final AS (SELECT * FROM open QUALIFY row_number() OVER (PARTITION BY s0, j0 ORDER BY seq DESC) = 1),
ended AS (SELECT f.*, (SELECT min(o.seen) FROM once o WHERE o.seq = f.seq + 1) AS valid_to FROM final f),
parts AS (
  SELECT o.s0, o.j0, i, arg_min(CASE WHEN c.j = 6 THEN route WHEN i = 0 THEN route END, o.seq) AS route_id, arg_min(CASE WHEN c.j = 6 THEN CASE WHEN i = 0 THEN stop ELSE 'S0' END WHEN i = 1 THEN stop END, o.seq) AS stop_id
  FROM open o JOIN once c USING (seq, h), (VALUES (0), (1)) t(i) WHERE i = 0 OR c.j = 6 OR u % 2 = 0 GROUP BY ALL
)"""
ROW = "FROM ended e JOIN told t ON t.s = e.s0 AND t.j = e.j0"
ORACLE_SQL = {
    "t123_alert_load": "WITH RECURSIVE " + ",".join((TOLD, LOAD)) + f"""
    SELECT 'P1' AS provider_id, s0 AS i3_alert_snapshot_id, j0::INT AS alert_index, e.h AS content_hash, alert_id, header, e.header_en, e.url, make_timestamp(a * 1000000) AS active_start, make_timestamp(z * 1000000) AS active_end, first_seen, last_seen, valid_to,
      (SELECT string_agg(coalesce(route_id, '-') || '/' || coalesce(stop_id, '-'), ',' ORDER BY i) FROM parts p WHERE p.s0 = e.s0 AND p.j0 = e.j0) AS entities, CASE WHEN more IS NULL THEN 1 ELSE 2 END AS period_count {ROW}""",
    "t68_current_alerts": "WITH RECURSIVE " + ",".join((TOLD, LOAD)) + f""",
    rows AS (SELECT *, e.header_en AS en, e.url AS link {ROW} WHERE valid_to IS NULL QUALIFY row_number() OVER (PARTITION BY description || severity || cause || effect ORDER BY last_seen DESC, s0 DESC, j0) = 1),
    named AS (SELECT s0, j0, string_agg(DISTINCT route_id, ', ' ORDER BY route_id) AS route_ids, string_agg(DISTINCT stop_id, ', ' ORDER BY stop_id) AS stop_ids, count(DISTINCT route_id) AS route_count, count(DISTINCT stop_id) AS stop_count, count(*) AS entity_count FROM parts GROUP BY ALL)
    SELECT 'P1' AS provider_id, alert_id, header, description, severity, cause, effect, route_ids, stop_ids, route_count, stop_count, entity_count, make_timestamp(a * 1000000) AS active_start, make_timestamp(z * 1000000) AS active_end, first_seen, last_seen, captured AS captured_at_utc, en AS header_en, NULL::VARCHAR AS description_en,
      link AS url, NULL::VARCHAR AS url_en, '[' || concat_ws(',', CASE WHEN z IS NULL THEN '{{"start_utc":"' || strftime(make_timestamp(a * 1000000), '%Y-%m-%d %H:%M:%S') || '"}}' ELSE '{{"start_utc":"' || strftime(make_timestamp(a * 1000000), '%Y-%m-%d %H:%M:%S') || '","end_utc":"' || strftime(make_timestamp(z * 1000000), '%Y-%m-%d %H:%M:%S') || '"}}' END,
        CASE WHEN more IS NOT NULL THEN '{{"start_utc":"' || strftime(make_timestamp(more * 1000000), '%Y-%m-%d %H:%M:%S') || '"}}' END) || ']' AS active_periods
    FROM rows JOIN named USING (s0, j0) WHERE make_timestamp(a * 1000000) <= TIMESTAMP '{NOW}' AND (z IS NULL OR make_timestamp(z * 1000000) >= TIMESTAMP '{NOW}')""",
    "t122_language_coverage": S.query(TOLD, """ids AS (
        SELECT (seen - INTERVAL 5 HOUR)::DATE AS d, u % 3 AS m, seen, s, j, coalesce(alert_id, concat_ws('|', header, u % 3 = 2, description, severity, effect, a, coalesce(url, '-'), route, CASE WHEN u % 2 = 0 THEN stop ELSE '-' END)) AS id FROM told
      ),
      o AS (SELECT d, id, arg_max(m, (seen, s, j)) AS m FROM ids GROUP BY ALL),
      w AS (SELECT * FROM (VALUES (7), (30)) t(window_days)),
      c AS (SELECT window_days, count(d) AS n, count(d) FILTER (m < 2) AS det, count(d) FILTER (m = 0) AS en, count(d) FILTER (m < 2) AS fr, count(d) FILTER (m = 2) AS und FROM w LEFT JOIN o ON d BETWEEN DATE '2024-01-28' - window_days + 1 AND DATE '2024-01-28' GROUP BY ALL),
      f AS (SELECT window_days, count(DISTINCT d) AS days FROM w LEFT JOIN (SELECT (seen - INTERVAL 5 HOUR)::DATE AS d FROM captures) ON d BETWEEN DATE '2024-01-28' - window_days + 1 AND DATE '2024-01-28' GROUP BY ALL)""",
      select=f"""SELECT 'P1' AS provider_id, window_days, CASE WHEN days = 0 THEN 'unavailable' WHEN n = 0 THEN 'no-alerts' ELSE 'available' END AS state, det AS denominator, n AS alert_observation_count, days AS feed_observation_days,
        {S.half(S.ratio("100.0::DOUBLE * en", "det"), 2)} AS explicit_en_pct, {S.half(S.ratio("100.0::DOUBLE * fr", "det"), 2)} AS explicit_fr_pct, {S.half(S.ratio("100.0::DOUBLE * und", "n"), 2)} AS undetermined_pct FROM c JOIN f USING (window_days)"""),
}
