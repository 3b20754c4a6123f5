"""Facts, schedule and alerts derived from the driver's tables, so that every operator can run on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROVIDER, TIME_ZONE = "P1", "America/Toronto"


def local(ts) -> F.Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(TIME_ZONE), ts)


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trip delays at snapshot x entity grain; provider-local dates."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "value")
    mod = lambda n: F.col("event_id") % n
    name = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    cents = F.round(F.col("value") * 100).cast("long")
    e = e.withColumn("captured_at_utc", F.col("ts").cast("timestamp_ntz")).withColumn("local_ts", local(F.col("captured_at_utc")))
    day = F.to_date("local_ts")
    return e.select(
        F.lit(PROVIDER).alias("provider_id"),
        F.floor(F.col("event_id") / 10).alias("realtime_snapshot_id"),
        mod(10).cast("int").alias("entity_index"),
        "captured_at_utc",
        day.alias("snapshot_local_date"),
        F.date_format(day, "yyyyMMdd").cast("int").alias("snapshot_date_key"),
        F.hour("local_ts").alias("local_hour"),
        F.when(mod(31) != 0, name("R", F.col("user_id") % 12)).alias("route_id"),
        name("T", F.col("user_id") % 60).alias("trip_id"),
        F.when(mod(13) != 0, name("V", F.col("user_id") % 40)).alias("vehicle_id"),
        F.when(mod(29) != 0, mod(2)).cast("int").alias("direction_id"),
        F.when(mod(19) != 0, name("S", mod(60))).alias("delay_stop_id"),
        mod(8).cast("int").alias("occupancy_status"),
        F.when(mod(23) == 0, 3).alias("trip_schedule_relationship"),
        F.when(F.hour("local_ts") < 4, F.date_sub(day, 1)).otherwise(day).alias("start_date"),
        F.when(mod(17) != 0, (cents * 7) % 4800 - 400).cast("int").alias("delay_seconds"),
        (mod(20) + 1).cast("int").alias("stop_time_update_count"),
        F.least(mod(3), mod(20) + 1).cast("int").alias("skipped_stop_count"),
    )


def vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicle positions at snapshot x entity grain; some are out of range."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id")
    mod = lambda n: F.col("event_id") % n
    name = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    return e.select(
        F.lit(PROVIDER).alias("provider_id"),
        F.floor(F.col("event_id") / 10).alias("realtime_snapshot_id"),
        mod(10).cast("int").alias("entity_index"),
        F.col("ts").cast("timestamp_ntz").alias("captured_at_utc"),
        F.when(mod(37) != 0, name("V", F.col("user_id") % 40)).alias("vehicle_id"),
        name("T", F.col("user_id") % 60).alias("trip_id"),
        F.when(mod(31) != 0, name("R", F.col("user_id") % 12)).alias("route_id"),
        F.when(mod(41) != 0, 45.0 + mod(100) / 50.0).alias("latitude"),
        F.when(mod(43) == 0, 190.0).otherwise(-74.0 + mod(90) / 60.0).alias("longitude"),
        mod(8).cast("int").alias("occupancy_status"),
        F.when(mod(19) != 0, name("S", mod(60))).alias("stop_id"),
        F.when(mod(5) != 0, (F.col("event_id") * 7 % 360).cast("double")).alias("bearing"),
        F.when(mod(6) != 0, mod(23) / 2.0).alias("speed"),
        F.when(mod(9) != 0, F.timestamp_add("SECOND", -mod(30).cast("int"), F.date_trunc("SECOND", F.col("ts")).cast("timestamp_ntz"))).alias("position_timestamp_utc"),
    )


def trip_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trip update entity for each event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts")
    k = F.col("event_id")
    name = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    return e.select(
        F.lit(PROVIDER).alias("provider_id"), F.floor(k / 10).alias("realtime_snapshot_id"), (k % 10).cast("int").alias("entity_index"), name("E", k).alias("entity_id"), F.date_trunc("SECOND", F.col("ts")).cast("timestamp_ntz").alias("feed_timestamp_utc"),
        F.col("ts").cast("timestamp_ntz").alias("captured_at_utc"), F.when(k % 47 != 0, name("T", k % 60)).alias("trip_id"), F.when(k % 11 != 0, name("R", k % 12)).alias("route_id"), (k % 2).cast("int").alias("direction_id"),
        F.when(k % 7 != 0, F.to_date("ts")).alias("start_date"), F.when(k % 23 == 0, 3).alias("schedule_relationship"),
    )


def stop_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """None to four stop time updates of each event's entity; some of stops that the timetable lacks, some without times."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts")
    k, i = F.col("event_id"), F.col("i")
    rows = e.where(k % 5 > 0).withColumn("i", F.explode(F.sequence(F.lit(0), (k % 5).cast("int") - 1)))
    at = F.timestamp_add("MINUTE", (k % 150 - 20 + i * 7).cast("int"), F.date_trunc("SECOND", F.col("ts")).cast("timestamp_ntz"))
    return rows.select(
        F.lit(PROVIDER).alias("provider_id"), F.floor(k / 10).alias("realtime_snapshot_id"), (k % 10).cast("int").alias("entity_index"), i.alias("stop_time_update_index"), ((k + i) % 9 + 1).cast("int").alias("stop_sequence"),
        F.when((k + i) % 4 != 0, F.concat(F.lit("S"), ((k + i) % 60).cast("string"))).alias("stop_id"), F.when((k + i) % 3 != 0, at).alias("arrival_utc"),
        F.when((k + i) % 6 != 0, F.timestamp_add("SECOND", F.lit(20), at)).alias("departure_utc"), F.when((k + i) % 4 == 1, 1).alias("schedule_relationship"),
    )


def trips(spark: SparkSession) -> DataFrame:
    """A timetable edition of 72 trips; the last route never runs."""
    k = F.col("id")
    name = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    service = F.element_at(F.array(F.lit("WD"), F.lit("WE"), F.lit("ALL")), (k % 3 + 1).cast("int"))
    return spark.range(72).select(
        F.lit(PROVIDER).alias("provider_id"), name("T", k).alias("trip_id"), name("R", F.when(k < 60, k % 12).otherwise(12 + k % 2)).alias("route_id"),
        service.alias("service_id"), (F.floor(k / 12) % 2).cast("int").alias("direction_id"), name("H", k % 5).alias("trip_headsign"),
    )


def routes(spark: SparkSession) -> DataFrame:
    """The timetable's routes; one is a metro."""
    return trips(spark).select("provider_id", "route_id").distinct().withColumn("route_type", F.when(F.col("route_id") == "R5", 1).otherwise(3))


def stop_times(spark: SparkSession) -> DataFrame:
    """Eight stops a trip; times may pass 24 hours."""
    rows = spark.range(72).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(1), F.lit(8))).alias("stop_sequence"))
    late = F.when(F.col("k") % 10 == 0, 8 * 3600).otherwise(0)
    seconds = (5 * 3600 + F.col("k") * 840 + F.col("stop_sequence") * 185 + late).cast("int")
    clock = F.format_string("%02d:%02d:%02d", F.floor(seconds / 3600).cast("int"), (F.floor(seconds / 60) % 60).cast("int"), seconds % 60)
    return rows.select(
        F.lit(PROVIDER).alias("provider_id"), F.concat(F.lit("T"), F.col("k").cast("string")).alias("trip_id"), "stop_sequence",
        F.concat(F.lit("S"), ((F.col("k") * 7 + F.col("stop_sequence") * 5) % 60).cast("string")).alias("stop_id"), clock.alias("departure_time"),
    )


def calendar(spark: SparkSession) -> DataFrame:
    week, rest = [True] * 5 + [False] * 2, [False] * 5 + [True] * 2
    rows = [(PROVIDER, s, *d, "2024-01-01", "2024-03-31") for s, d in (("WD", week), ("WE", rest), ("ALL", [True] * 7))]
    days = ", ".join(f"{d} boolean" for d in ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"))
    return spark.createDataFrame(rows, f"provider_id string, service_id string, {days}, a string, b string").withColumns({"start_date": F.to_date("a"), "end_date": F.to_date("b")}).drop("a", "b")


def calendar_dates(spark: SparkSession) -> DataFrame:
    rows = [(PROVIDER, "WD", "2024-01-15", 2), (PROVIDER, "WE", "2024-01-15", 1), (PROVIDER, "ALL", "2024-01-20", 2)]
    return spark.createDataFrame(rows, "provider_id string, service_id string, d string, exception_type int").select("provider_id", "service_id", F.to_date("d").alias("service_date"), "exception_type")


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert x informed entity rows of alert snapshots, one for each event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id")
    k = F.col("event_id")
    name = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    start = F.date_trunc("DAY", F.col("ts")).cast("timestamp_ntz")
    return e.select(
        F.lit(PROVIDER).alias("provider_id"), k.alias("alert_row"), name("A", F.col("user_id") % 25).alias("alert_id"), name("Header ", k % 9).alias("header"), name("Text ", k % 7).alias("description"),
        F.when(k % 5 != 0, name("sev", k % 3)).alias("severity"), name("cause", k % 4).alias("cause"), name("effect", k % 3).alias("effect"),
        start.alias("active_start"), F.when(k % 4 != 0, F.timestamp_add("HOUR", (k % 48 + 1).cast("int"), start)).alias("active_end"),
        F.col("ts").cast("timestamp_ntz").alias("captured_at_utc"), F.when(k % 3 != 0, name("R", F.col("user_id") % 12)).alias("route_id"), F.when(k % 2 != 0, name("S", F.col("user_id") % 60)).alias("stop_id"),
    )


def alert_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert snapshots as JSON, ten events each, one in 13 without alerts. An event's place in its snapshot fixes how long its content stays; its user fixes which languages and links come along."""
    k, u, s, j = F.col("event_id"), F.col("user_id"), F.col("s"), F.col("j")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts", F.floor(k / 10).alias("s"), (k % 10).alias("j"))
    slot = F.when(j == 8, 7).otherwise(j)
    n = F.expr("CAST(s DIV (IF(j = 8, 7, j) + 2) AS BIGINT)")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    french = text('{"language": "fr-CA", "text": "Avis ', n % 5, '"}')
    header = F.when(u % 3 == 0, text("[", french, ', {"language": "en", "text": "Notice ', n % 5, " of ", u, '"}]')).when(u % 3 == 1, text("[", french, "]")).otherwise(text('"Avis ', n % 5, '"'))
    start = 1704067200 + n * 600
    first = text('{"start": ', start, F.when(j % 4 != 0, text(', "end": ', start + 3600 * (slot + 1))).otherwise(F.lit("")), "}")
    periods = F.when(j % 5 == 0, text("[", first, ', {"start": ', start + 86400, "}]")).otherwise(text("[", first, "]"))
    route, stop = text('"R', u % 12, '"'), text('"S', u % 60, '"')
    told = F.when(u % 2 == 0, text('[{"routeId": ', route, '}, {"stopId": ', stop, "}]")).otherwise(text('[{"routeId": ', route, "}]"))
    entities = F.when(j == 6, text('"routes": [', route, '], "stops": [', stop, ', "S0"]')).otherwise(text('"informedEntities": ', told))
    body = text(
        "{", F.when(j != 9, text('"id": "A', slot, '", ')).otherwise(F.lit("")), '"header_texts": ', header, ', "description": "Texte ', n % 7, '", "severity": "sev', n % 3, '", "cause": "cause', slot % 4, '", "effect": "effect', n % 2, '", ',
        F.when(u % 4 == 0, text('"url": "https://example.org/', u, '", ')).otherwise(F.lit("")), '"activePeriod": ', periods, ", ", entities, "}",
    )
    told = e.select("s", "ts", F.struct("j", F.when(s % 13 != 5, body).alias("a")).alias("r")).groupBy("s").agg(F.date_trunc("SECOND", F.max("ts")).cast("timestamp_ntz").alias("captured_at_utc"), F.sort_array(F.collect_list("r")).alias("r"))
    payload = text('{"alerts": [', F.array_join(F.filter(F.transform("r", lambda r: r["a"]), lambda a: a.isNotNull()), ", "), "]}")
    return told.select(s.alias("i3_alert_snapshot_id"), F.lit(PROVIDER).alias("provider_id"), "captured_at_utc", payload.alias("payload"))
