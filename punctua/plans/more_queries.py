"""Queries of the remaining inventory: dimensions, observations at both ends of a stop, lineage, pages, static files, retention, the alert log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from punctua.functions import kernel as K
from punctua.operators import alerts as A
from punctua.operators import facts, live, reads, rollups
from punctua.plans import incremental, publish
from punctua.plans import read_queries as R
from punctua.plans import sql as S
from punctua.plans import view_queries as V
from punctua.sources import driver_tables as T


def dim_route(spark: SparkSession) -> DataFrame:
    """Routes of the current edition."""
    return T.trips(spark).groupBy("provider_id", "route_id").agg(F.count_distinct("trip_id").alias("trip_count"), F.min("trip_headsign").alias("first_headsign"))


def dim_stop(spark: SparkSession) -> DataFrame:
    return T.stop_times(spark).groupBy("provider_id", "stop_id").agg(F.count_distinct("trip_id").alias("trip_count"), F.min("stop_sequence").alias("first_sequence"))


def history(spark: SparkSession) -> DataFrame:
    """Route names after a second edition that renames every third route and drops one."""
    t0, t1 = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-01 00:00:00", "2024-02-01 00:00:00"))
    k = F.col("id")
    name = lambda suffix: F.concat(F.lit("Line "), k.cast("string"), suffix)
    old = spark.range(12).select(F.concat(F.lit("R"), k.cast("string")).alias("route_id"), F.when(k != 5, name(F.lit(""))).alias("name"), t0.alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))
    new = spark.range(1, 14).select(F.concat(F.lit("R"), k.cast("string")).alias("route_id"), F.when(k != 5, name(F.when(k % 3 == 0, " bis").otherwise(""))).alias("name"))
    return facts.history_closed_and_opened(old, new, ["route_id"], ["name"], t1)


def vehicle_fact(spark: SparkSession, d: str) -> DataFrame:
    """Vehicle positions with their local date and key."""
    v = T.vehicles(spark, d)
    day = F.to_date(T.local(F.col("captured_at_utc")))
    return v.select("provider_id", "realtime_snapshot_id", "entity_index", "vehicle_id", "route_id", day.alias("snapshot_local_date"), F.date_format(day, "yyyyMMdd").cast("int").alias("snapshot_date_key"), "occupancy_status")


def both_delays(spark: SparkSession, d: str) -> DataFrame:
    """Arrival and departure delay of each update with a start date."""
    planned = V.timed(spark).select("provider_id", "trip_id", "stop_sequence", "secs")
    rows = V.updates(spark, d).where("start_date IS NOT NULL").join(planned, ["provider_id", "trip_id", "stop_sequence"])
    due = facts.service_instant(F.col("start_date"), F.col("secs"), T.TIME_ZONE)
    late = lambda c: F.timestamp_diff("SECOND", due, F.col(c)).cast("int")
    return rows.select("provider_id", "rt_feed_snapshot_id", "entity_index", "stop_time_update_index", "stop_sequence", late("arrival_utc").alias("arrival_delay_seconds"), late("departure_utc").alias("departure_delay_seconds"))


def lineage(spark: SparkSession, d: str) -> DataFrame:
    """A dataset version for each loading run that succeeded; the newest of an endpoint is its current one."""
    runs = V.runs(spark, d).where("run_kind = 'silver_load' AND status = 'succeeded'")
    endpoint = F.substring("endpoint_key", 5, 5).cast("int")
    rows = runs.select(
        "provider_id", F.lit("static_schedule").alias("dataset_kind"), F.col("event_id").alias("dataset_version_id"), endpoint.alias("feed_endpoint_id"), F.concat_ws("/", F.lit("archive"), "endpoint_key", F.col("event_id").cast("string")).alias("storage_path"),
        F.md5(F.col("event_id").cast("string")).alias("checksum"), (F.col("event_id") * 37 % 100000).alias("byte_size"), F.col("finished_at_utc").alias("loaded_at_utc"),
    )
    newest = rows.groupBy("provider_id", "feed_endpoint_id").agg(F.max(F.struct("loaded_at_utc", "dataset_version_id"))["dataset_version_id"].alias("dataset_version_id"), F.lit(True).alias("is_current"))
    versions = rows.join(newest, ["provider_id", "feed_endpoint_id", "dataset_version_id"], "left").withColumn("is_current", F.coalesce("is_current", F.lit(False)))
    endpoints = spark.range(3).select(F.col("id").cast("int").alias("feed_endpoint_id"), F.concat(F.lit("feed"), F.col("id").cast("string")).alias("endpoint_key"))
    return live.source_lineage(versions, endpoints)


def static_routes(spark: SparkSession) -> DataFrame:
    """Each route and direction's main branch: the headsign of most trips (then by name), its stops in the order of its first trip."""
    trips = T.trips(spark)
    branches = trips.groupBy("provider_id", "route_id", "direction_id", "trip_headsign").agg(F.count(F.lit(1)).alias("trip_count"), F.min("trip_id").alias("trip_id"))
    w = Window.partitionBy("provider_id", "route_id", "direction_id").orderBy(F.desc("trip_count"), "trip_headsign")
    best = branches.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")
    stops = T.stop_times(spark).groupBy("provider_id", "trip_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("stop_sequence", "stop_id"))), lambda s: s["stop_id"]).alias("stops"))
    return best.join(stops, ["provider_id", "trip_id"]).select("provider_id", "route_id", "direction_id", "trip_headsign", "trip_count", F.array_join("stops", ",").alias("stop_ids"))


def sampled_times(spark: SparkSession, n: int = 12) -> DataFrame:
    """At most n departures a stop, evenly spread over its ordered departures, first and last kept."""
    w = Window.partitionBy("provider_id", "stop_id")
    rows = V.timed(spark).select("provider_id", "stop_id", "secs").distinct().withColumn("i", F.row_number().over(w.orderBy("secs")) - 1).withColumn("m", F.count(F.lit(1)).over(w))
    step = lambda i: F.floor(i * (n - 1) / F.greatest(F.col("m") - 1, F.lit(1)))
    return rows.where((F.col("m") <= n) | (F.col("i") == 0) | (step(F.col("i")) > step(F.col("i") - 1))).select("provider_id", "stop_id", "secs")


def alert_log(spark: SparkSession, d: str) -> DataFrame:
    """Alerts whose period meets a window, newest first, with their length in minutes."""
    a, z = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-12 00:00:00", "2024-01-15 00:00:00"))
    rows = T.alerts(spark, d).where((F.col("active_start") < z) & (F.col("active_end").isNull() | (F.col("active_end") > a)))
    rows = reads.numbered(rows, ["provider_id"], F.to_date("active_start"), [F.desc("active_start"), F.asc("alert_row")], "rank", descending=True)
    return rows.select("provider_id", "alert_row", "header", "active_start", (F.timestamp_diff("SECOND", F.col("active_start"), F.col("active_end")) / 60.0).alias("minutes"), "rank")


def archive_pages(spark: SparkSession, d: str) -> DataFrame:
    """Archive entries by month on pages of bounded bytes."""
    entries = A.archive_entries(T.alerts(spark, d)).select("archive_month", "stable_id", (F.octet_length("header") + F.octet_length("description")).alias("byte_count"))
    return publish.pages(entries, ["archive_month"], [F.col("stable_id")], 100)


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """Which capabilities each provider's fresh feeds support."""
    states = V.freshness(spark, d).groupBy("provider_id").agg(F.count_if(F.col("status") == "succeeded").alias("good_feeds"), F.max("finished_at_utc").alias("newest_utc"), F.count(F.lit(1)).alias("feeds"))
    return states.withColumn("live", F.col("good_feeds") > 0).withColumn("history", F.col("feeds") > 2)


def provenance(spark: SparkSession, d: str) -> DataFrame:
    """First and last date, rows and routes behind the published history."""
    return T.fact(spark, d).groupBy("provider_id").agg(F.min("snapshot_local_date").alias("first_date"), F.max("snapshot_local_date").alias("last_date"), F.count(F.lit(1)).alias("row_count"), F.array_join(F.sort_array(F.collect_set("route_id")), ",").alias("routes"))


def rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """Closed days without a watermark."""
    fact = T.fact(spark, d)
    built = fact.where("day(snapshot_local_date) % 4 = 0").select("provider_id", F.lit("x").alias("kind"), F.col("snapshot_local_date").alias("period_start")).distinct()
    return incremental.missing_days(fact, built, "x", F.lit("2024-01-03").cast("date"), F.lit("2024-01-28").cast("date"))


def providers(spark: SparkSession, d: str) -> DataFrame:
    """Providers with their bounds: one for each nation of the driver's tables."""
    n = spark.read.parquet(f"{d}/nation.parquet")
    k = F.col("n_nationkey")
    return n.select(F.concat(F.lit("P"), k.cast("string")).alias("provider_id"), F.col("n_name").alias("display_name"), F.when(k % 4 != 0, -74.0 + k / 8.0).alias("min_longitude"), F.when(k % 4 != 0, -73.0 + k / 8.0).alias("max_longitude"))


def dark_routes(spark: SparkSession, d: str, cap: int = 50) -> DataFrame:
    """Routes that the schedule has on a day but nothing was seen of, most trips first, with their number before the cap."""
    key = ["provider_id", "provider_local_date"]
    dark = R.cancellations(spark, d).where("total_trip_days = 0 AND scheduled_trip_days > 0").select(*key, "route_id", "scheduled_trip_days")
    totals = dark.groupBy(*key).agg(F.count(F.lit(1)).alias("dark_total"))
    return reads.top(dark, key, [F.desc("scheduled_trip_days"), F.asc("route_id")], cap).join(totals, key)


def route_ranks(spark: SparkSession, d: str) -> DataFrame:
    """The 30 routes of each window with the lowest bound of punctuality."""
    rows = reads.in_windows(R.spine(spark, d), ["provider_id"]).where("period = 'current'")
    rated = reads.rated(reads.project(rows, ["provider_id", "window_grain", "route_id"])).where("known_obs >= 30")
    return reads.top(rated, ["provider_id", "window_grain"], [F.asc("wilson_lo"), F.asc("route_id")], 30).select("provider_id", "window_grain", "route_id", "known_obs", "otp_pct", "wilson_lo", "rank")


def histogram_bins(spark: SparkSession, d: str) -> DataFrame:
    """A route's delay distribution as (low, high or NULL, count)."""
    edges = F.array(*(F.lit(e).cast("int") for e in R.DELAY_EDGES))
    total = reads.project(R.spine(spark, d), ["provider_id", "route_id"]).where(K.total(F.col("hist")) > 0)
    return total.select("provider_id", "route_id", F.posexplode("hist").alias("bin", "count")).select("provider_id", "route_id", F.get(edges, F.col("bin")).alias("lo_sec"), F.get(edges, F.col("bin") + 1).alias("hi_sec"), "count")


def offender_ladders(spark: SparkSession, d: str) -> DataFrame:
    """As of each date: severe days of each entity in the trailing week and month."""
    daily = R.offenders(spark, d).withColumn("bad_day", (F.col("severe_delay_count") > 0).cast("int"))
    key = ["provider_id", "entity_kind", "entity_id", "route_id"]
    week, month = (reads.rolling_sums(daily, key, ["bad_day"], n) for n in (7, 30))
    return week.join(month, [*key, "provider_local_date"])


QUERIES = {
    "t60_dim_provider": providers,
    "t86_histogram_bins": histogram_bins,
    "t101_shift_cuts": lambda spark, d: reads.rated(reads.project(R.spine(spark, d), ["provider_id", "provider_local_date", K.shift(F.col("hour_of_day_local")).alias("shift")])),
    "t101_dark_routes": dark_routes,
    "t103_route_ranks": route_ranks,
    "t112_offender_ladders": offender_ladders,
    "t20_dim_route": lambda spark, d: dim_route(spark),
    "t20_dim_stop": lambda spark, d: dim_stop(spark),
    "t22_dim_history": lambda spark, d: history(spark),
    "t24_vehicle_fact": vehicle_fact,
    "t52_missing_days": rebuilt,
    "t54_rebuilt_spans": lambda spark, d: rollups.route_service_span_daily(T.fact(spark, d).where("snapshot_local_date BETWEEN DATE '2024-01-09' AND DATE '2024-01-13'")).where("provider_local_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-12'").select("provider_id", "provider_local_date", "route_id", "trip_count", "first_trip_start_utc"),
    "t65_stop_time_delays": both_delays,
    "t71_source_lineage": lineage,
    "t85_histogram_percentiles": lambda spark, d: R.spine(spark, d).select("provider_id", "route_id", "provider_local_date", "hour_of_day_local", "direction_id", *(K.delay_percentile_minutes(F.col("delay_histogram"), q, R.DELAY_EDGES).alias(f"p{int(q * 100)}_min") for q in (0.1, 0.5, 0.9))),
    "t91_wilson": lambda spark, d: R.stops(spark, d).groupBy("provider_id", "stop_id").agg(F.sum("severe_delay_count").alias("bad"), F.sum("observation_count").alias("n")).select("provider_id", "stop_id", "bad", "n", *(c.alias(a) for c, a in zip(K.wilson(F.col("bad"), F.col("n")), ("low", "high"), strict=True))),
    "t110_archive_pages": archive_pages,
    "t119_manifest": manifest,
    "t120_static_routes": lambda spark, d: static_routes(spark),
    "t120_sampled_times": lambda spark, d: sampled_times(spark),
    "t121_provenance": provenance,
    "t125_retained_facts": lambda spark, d: incremental.retained(T.fact(spark, d), "snapshot_local_date", F.lit("2024-01-30").cast("date"), 14).groupBy("provider_id", "snapshot_local_date").agg(F.count(F.lit(1)).alias("n")),
    "t132_alert_log": alert_log,
}

ROLLING = "OVER (PARTITION BY entity_kind, entity_id, route_id ORDER BY provider_local_date RANGE BETWEEN INTERVAL {} DAY PRECEDING AND CURRENT ROW)::BIGINT"
ORACLE_SQL = {
    "t60_dim_provider": "SELECT 'P' || n_nationkey AS provider_id, n_name AS display_name, CASE WHEN n_nationkey % 4 <> 0 THEN -74.0::DOUBLE + n_nationkey / 8.0::DOUBLE END AS min_longitude, CASE WHEN n_nationkey % 4 <> 0 THEN -73.0::DOUBLE + n_nationkey / 8.0::DOUBLE END AS max_longitude FROM nation",
    "t86_histogram_bins": S.query(*R.SPINES, f"p AS (SELECT provider_id, route_id, {', '.join(f'sum({h})::BIGINT AS {h}' for h in R.H)} FROM route_spine GROUP BY ALL)",
      select=" UNION ALL ".join(f"SELECT provider_id, route_id, {R.DELAY_EDGES[i]} AS lo_sec, {R.DELAY_EDGES[i + 1] if i < 20 else 'NULL'}::INT AS hi_sec, h{i} AS count FROM p WHERE {' + '.join(R.H)} > 0" for i in range(21))),
    "t101_shift_cuts": R.folded("provider_id", f"provider_local_date, {R.DIMS['shift']} AS shift", "provider_local_date, shift"),
    "t101_dark_routes": S.query(S.FACT, S.SCHEDULE, R.CANCEL, "dark AS (SELECT provider_id, provider_local_date, route_id, scheduled_trip_days FROM cancel WHERE total_trip_days = 0 AND scheduled_trip_days > 0)",
      select="SELECT *, row_number() OVER (PARTITION BY provider_local_date ORDER BY scheduled_trip_days DESC, route_id)::INT AS rank, count(*) OVER (PARTITION BY provider_local_date) AS dark_total FROM dark QUALIFY rank <= 50"),
    "t103_route_ranks": S.query(*R.SPINES, R.windows("route_spine", "provider_id"), f"folded AS (SELECT provider_id, window_grain, route_id, {R.SUMS} FROM windowed WHERE period = 'current' GROUP BY ALL), rates AS (SELECT provider_id, window_grain, route_id, {R.RATES} FROM folded WHERE known_obs >= 30)",
      select="SELECT provider_id, window_grain, route_id, known_obs, otp_pct, wilson_lo, row_number() OVER (PARTITION BY window_grain ORDER BY wilson_lo, route_id)::INT AS rank FROM rates QUALIFY rank <= 30"),
    "t112_offender_ladders": S.query(S.FACT, S.OFFENDER_SPINE, "b AS (SELECT *, CASE WHEN severe_delay_count > 0 THEN 1 ELSE 0 END AS bad FROM offender_spine)",
      select=f"SELECT provider_id, entity_kind, entity_id, route_id, provider_local_date, sum(bad) {ROLLING.format(6)} AS bad_day_7d, sum(bad) {ROLLING.format(29)} AS bad_day_30d FROM b"),
    "t20_dim_route": S.query(S.SCHEDULE, select="SELECT provider_id, route_id, count(DISTINCT trip_id) AS trip_count, min(trip_headsign) AS first_headsign FROM trips GROUP BY ALL"),
    "t20_dim_stop": S.query(S.SCHEDULE, select="SELECT provider_id, stop_id, count(DISTINCT trip_id) AS trip_count, min(stop_sequence) AS first_sequence FROM stop_times GROUP BY ALL"),
    "t22_dim_history": """WITH o AS (SELECT k, CASE WHEN k <> 5 THEN 'Line ' || k END AS name FROM range(12) t(k)), n AS (SELECT k, CASE WHEN k <> 5 THEN 'Line ' || k || CASE WHEN k % 3 = 0 THEN ' bis' ELSE '' END END AS name FROM range(1, 14) t(k))
      SELECT 'R' || o.k AS route_id, o.name, TIMESTAMP '2024-01-01' AS valid_from, CASE WHEN NOT EXISTS (SELECT 1 FROM n WHERE n.k = o.k AND n.name IS NOT DISTINCT FROM o.name) THEN TIMESTAMP '2024-02-01' END AS valid_to FROM o
      UNION ALL SELECT 'R' || n.k, n.name, TIMESTAMP '2024-02-01', NULL FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE n.k = o.k AND n.name IS NOT DISTINCT FROM o.name)""",
    "t24_vehicle_fact": S.query(S.VEHICLES, select="SELECT provider_id, realtime_snapshot_id, entity_index, vehicle_id, route_id, (captured_at_utc - INTERVAL 5 HOUR)::DATE AS snapshot_local_date, strftime(captured_at_utc - INTERVAL 5 HOUR, '%Y%m%d')::INT AS snapshot_date_key, occupancy_status FROM vehicles"),
    "t52_missing_days": S.query(S.FACT, select="SELECT DISTINCT provider_id, snapshot_local_date AS period_start FROM fact WHERE snapshot_local_date >= DATE '2024-01-03' AND snapshot_local_date < DATE '2024-01-28' AND day(snapshot_local_date) % 4 <> 0"),
    "t54_rebuilt_spans": S.query(S.FACT, """b AS (SELECT provider_id, start_date AS provider_local_date, route_id, trip_id, min(captured_at_utc) AS start FROM fact WHERE route_id IS NOT NULL AND snapshot_local_date BETWEEN DATE '2024-01-09' AND DATE '2024-01-13' AND snapshot_local_date BETWEEN start_date AND start_date + 1 GROUP BY ALL)""",
      select="SELECT provider_id, provider_local_date, route_id, count(*) AS trip_count, min(start) AS first_trip_start_utc FROM b WHERE provider_local_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-12' GROUP BY ALL"),
    "t65_stop_time_delays": S.query(S.SCHEDULE, V.UPDATES, select="""SELECT u.provider_id, rt_feed_snapshot_id, entity_index, idx AS stop_time_update_index, u.stop_sequence, epoch(arrival_utc - (start_date::TIMESTAMP + INTERVAL 5 HOUR + to_seconds(secs)))::INT AS arrival_delay_seconds,
      epoch(departure_utc - (start_date::TIMESTAMP + INTERVAL 5 HOUR + to_seconds(secs)))::INT AS departure_delay_seconds FROM updates u JOIN stop_times s USING (trip_id, stop_sequence) WHERE start_date IS NOT NULL"""),
    "t71_source_lineage": S.query(V.FRESH, """v AS (SELECT event_id, endpoint_key, ended FROM runs WHERE load AND status = 'succeeded')""", select="""SELECT 'P1' AS provider_id, 'static_schedule' AS dataset_kind, event_id AS dataset_version_id,
      'archive/' || endpoint_key || '/' || event_id AS storage_path, md5(event_id::VARCHAR) AS checksum, event_id * 37 % 100000 AS byte_size, ended AS loaded_at_utc,
      row_number() OVER (PARTITION BY endpoint_key ORDER BY ended DESC, event_id DESC) = 1 AS is_current, endpoint_key FROM v QUALIFY endpoint_key IN ('feed0', 'feed1', 'feed2')"""),
    "t85_histogram_percentiles": S.query(*R.SPINES, select="SELECT provider_id, route_id, provider_local_date, hour_of_day_local, direction_id, " + ", ".join(f"{S.half(f'({S.percentile_of(R.H, R.DELAY_EDGES, q)}) / 60.0::DOUBLE', 1)} AS p{int(q * 100)}_min" for q in (0.1, 0.5, 0.9)) + " FROM route_spine"),
    "t91_wilson": S.query(S.FACT, S.STOP_SPINE, "s AS (SELECT provider_id, stop_id, sum(severe_delay_count)::BIGINT AS bad, sum(observation_count)::BIGINT AS n FROM stop_spine GROUP BY ALL)", select=f"SELECT *, {S.wilson('bad', 'n', False)} AS low, {S.wilson('bad', 'n', True)} AS high FROM s"),
    "t110_archive_pages": S.query(S.ALERTS, V.entries("e", "true"), """b AS (SELECT archive_month, stable_id, octet_length(encode(header)) + octet_length(encode(description)) AS byte_count FROM e),
      k AS (SELECT *, 2 * (count(*) FILTER (byte_count > 100) OVER w) + (byte_count > 100)::INT AS alone, coalesce(sum(byte_count) FILTER (byte_count <= 100) OVER w, 0) // greatest(1, 100 - coalesce(max(byte_count) FILTER (byte_count <= 100) OVER (PARTITION BY archive_month), 0)) AS block
        FROM b WINDOW w AS (PARTITION BY archive_month ORDER BY stable_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
      select="SELECT archive_month, stable_id, byte_count, (dense_rank() OVER (PARTITION BY archive_month ORDER BY alone, block) - 1)::INT AS page FROM k"),
    "t119_manifest": S.query(V.FRESH, select="SELECT provider_id, count(*) FILTER (status = 'succeeded') AS good_feeds, max(finished_at_utc) AS newest_utc, count(*) AS feeds, count(*) FILTER (status = 'succeeded') > 0 AS live, count(*) > 2 AS history FROM fresh GROUP BY ALL"),
    "t120_static_routes": S.query(S.SCHEDULE, """b AS (SELECT provider_id, route_id, direction_id, trip_headsign, count(*) AS trip_count, min(trip_id) AS trip_id FROM trips GROUP BY ALL), k AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY route_id, direction_id ORDER BY trip_count DESC, trip_headsign) = 1)""",
      select="SELECT k.provider_id, route_id, direction_id, trip_headsign, trip_count, string_agg(stop_id, ',' ORDER BY stop_sequence) AS stop_ids FROM k JOIN stop_times USING (trip_id) GROUP BY ALL"),
    "t120_sampled_times": S.query(S.SCHEDULE, """t AS (SELECT DISTINCT provider_id, stop_id, secs FROM stop_times), r AS (SELECT *, row_number() OVER (PARTITION BY stop_id ORDER BY secs) - 1 AS i, count(*) OVER (PARTITION BY stop_id) AS m FROM t)""",
      select="SELECT provider_id, stop_id, secs FROM r WHERE m <= 12 OR i = 0 OR i * 11 // greatest(m - 1, 1) > (i - 1) * 11 // greatest(m - 1, 1)"),
    "t121_provenance": S.query(S.FACT, select="SELECT provider_id, min(snapshot_local_date) AS first_date, max(snapshot_local_date) AS last_date, count(*) AS row_count, string_agg(DISTINCT route_id, ',' ORDER BY route_id) AS routes FROM fact GROUP BY ALL"),
    "t125_retained_facts": S.query(S.FACT, select="SELECT provider_id, snapshot_local_date, count(*) AS n FROM fact WHERE snapshot_local_date >= DATE '2024-01-30' - 14 GROUP BY ALL"),
    "t132_alert_log": S.query(S.ALERTS, select="""SELECT provider_id, alert_row, header, active_start, epoch(active_end - active_start)::DOUBLE / 60.0 AS minutes, row_number() OVER (ORDER BY active_start DESC, alert_row)::INT AS rank
      FROM alerts WHERE active_start < TIMESTAMP '2024-01-15' AND (active_end IS NULL OR active_end > TIMESTAMP '2024-01-12')"""),
}
