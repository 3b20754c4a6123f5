"""Service alerts: content identity, versions, current and past views, archive, language coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctua.functions import kernel as K

#: The fields of an alert's content identity, in their order; times count in whole seconds.
IDENTITY = ("alert_id", "header", "description", "severity", "cause", "effect", "active_start", "active_end", "published", "updated")
TIMES = {"active_start", "active_end", "published", "updated"}
ORIGIN = "1970-01-01 00:00:00"


def content_hash(columns: Sequence[str], more: Column | None = None) -> Column:
    """md5 of the identity fields that the table has (others count as empty), joined by the unit separator; `more` follows where it is not null."""

    def spelled(c: str) -> Column:
        if c not in columns:
            return F.lit("")
        value = F.timestamp_diff("SECOND", F.lit(ORIGIN).cast("timestamp_ntz"), F.col(c)) if c in TIMES else F.col(c)
        return F.coalesce(value.cast("string"), F.lit(""))

    return F.md5(F.concat_ws("\u001f", *map(spelled, IDENTITY), *([] if more is None else [more])))


def versions(alerts: DataFrame) -> DataFrame:
    """Alert x content: the first and last time each content was seen, and the end of its validity.

    A content is current while its alert's latest capture shows it; else it ends at the alert's next capture after its last sight."""
    rows = alerts.withColumn("content_hash", content_hash(alerts.columns)).select("provider_id", "alert_id", "content_hash", "captured_at_utc").distinct()
    seen = rows.groupBy("provider_id", "alert_id", "content_hash").agg(F.min("captured_at_utc").alias("first_seen"), F.max("captured_at_utc").alias("last_seen"))
    after = F.lead("captured_at_utc").over(Window.partitionBy("provider_id", "alert_id").orderBy("captured_at_utc"))
    moments = rows.select("provider_id", "alert_id", "captured_at_utc").distinct().withColumn("valid_to", after)
    return seen.join(moments.withColumnRenamed("captured_at_utc", "last_seen"), ["provider_id", "alert_id", "last_seen"])


def history(alerts: DataFrame, first: Column, last: Column, time_zone: str, n: int = 500) -> DataFrame:
    """Alerts of a span of local dates, one row for each header and active period: newest first, n at most, with the uncapped count."""
    day = F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(time_zone), F.col("captured_at_utc")))
    rows = alerts.where(day.between(first, last))
    found = rows.groupBy("provider_id", "header", "active_start", "active_end").agg(
        *(F.max(c).alias(c) for c in ("description", "severity", "cause", "effect")), F.array_join(F.sort_array(F.collect_set("route_id")), ",").alias("routes"), F.array_join(F.sort_array(F.collect_set("stop_id")), ",").alias("stops")
    )
    totals = found.groupBy("provider_id").agg(F.count(F.lit(1)).alias("total_in_window"))
    rank = F.row_number().over(Window.partitionBy("provider_id").orderBy(F.col("active_start").desc_nulls_last(), "header", F.col("active_end").asc_nulls_first()))
    return found.withColumn("rank", rank).where(F.col("rank") <= n).join(totals, "provider_id")


def identified(state) -> DataFrame:
    """Loaded alerts (alert_load.Loaded) by header and first period, with an id of their content, their duration in minutes (null of an end before the start) and all their periods: of each index that of the newest version."""
    group = ["provider_id", "header", "active_start", "active_end"]
    rows = state.alerts.groupBy(*group).agg(*(F.max(c).alias(c) for c in ("header_en", "description", "severity", "cause", "effect", "url")))
    spelled = lambda t: F.coalesce(F.concat(F.date_format(t, "yyyy-MM-dd HH:mm:ss"), F.lit("+00:00")), F.lit(""))
    basis = F.concat_ws("|", F.coalesce("header", F.lit("")), F.coalesce("severity", F.lit("")), spelled(F.col("active_start")), spelled(F.col("active_end")))
    made = F.concat("provider_id", F.lit("-alert-"), F.substring(F.sha1(basis.cast("binary")), 1, 12))
    seconds = F.timestamp_diff("SECOND", F.col("active_start"), F.col("active_end"))
    key = ["provider_id", "i3_alert_snapshot_id", "alert_index"]
    # a null is a value of the group, so groups meet by a digest
    same = F.md5(F.concat_ws("\u001f", *(F.coalesce(F.concat(F.lit("+"), F.col(c).cast("string")), F.lit("-")) for c in group)))
    periods = state.periods.join(state.alerts.select(*key, same.alias("__same")).hint("merge"), key)
    newest = periods.groupBy("__same", "period_index").agg(F.max_by(F.struct("start", "end"), F.struct("i3_alert_snapshot_id", "alert_index")).alias("p"))
    one = F.concat(F.col("period_index").cast("string"), F.lit(":"), F.concat_ws("/", *(F.coalesce(F.date_format(f"p.{c}", "yyyy-MM-dd HH:mm:ss"), F.lit("")) for c in ("start", "end"))))
    spans = newest.groupBy("__same").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("period_index", one.alias("s")))), lambda x: x["s"]), ",").alias("active_periods"))
    rows = rows.withColumn("__same", same).join(spans.hint("merge"), "__same", "left").drop("__same")
    return rows.withColumns({"id": made, "duration_min": F.when(seconds >= 0, F.round(seconds / 60.0).cast("int")), "active_periods": F.coalesce("active_periods", F.lit(""))})


def breakdown(found: DataFrame) -> DataFrame:
    """Cause x effect of alerts: count and median duration in minutes of those that ended."""
    minutes = F.timestamp_diff("SECOND", F.col("active_start"), F.col("active_end")) / 60.0
    return found.groupBy("provider_id", "cause", "effect").agg(F.count(F.lit(1)).alias("alert_count"), K.half_away(F.percentile(minutes, 0.5), 1).alias("median_minutes"))


#: Severities that clients show; any other counts as the last.
SEVERITIES = ("critical", "high", "watch")


def log_breakdown(found: DataFrame) -> DataFrame:
    """Alerts by cause, by effect and by severity: count and exact median duration in minutes of those that ended. Blank causes and effects are unknown."""
    minutes = F.timestamp_diff("SECOND", F.col("active_start"), F.col("active_end")) / 60.0
    named = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("unknown"))
    severity = F.when(F.col("severity").isin(*SEVERITIES), F.col("severity")).otherwise(SEVERITIES[-1])
    parts = F.array(*(F.struct(F.lit(kind).alias("kind"), value.alias("key")) for kind, value in (("cause", named("cause")), ("effect", named("effect")), ("severity", severity))))
    rows = found.select("provider_id", minutes.alias("minutes"), F.explode(parts).alias("p"))
    return rows.groupBy("provider_id", "p.kind", "p.key").agg(F.count(F.lit(1)).alias("alert_count"), F.percentile("minutes", 0.5).alias("median_minutes"))


def history_reporting(alerts: DataFrame, entities: DataFrame, time_zone: str) -> DataFrame:
    """Each alert row with each of its informed entities (NULLs without one), its local date and the hour, week, month and year it falls in, and the hash of its effective content.

    alerts and entities meet by provider_id and alert_row."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(time_zone), F.col("captured_at_utc"))
    buckets = (F.date_trunc(unit.upper(), local).cast("timestamp_ntz").alias(f"{unit}_bucket_local") for unit in ("hour", "week", "month", "year"))
    content = F.md5(F.concat(*(F.coalesce(c, F.lit("")) for c in ("description", "severity", "cause", "effect"))))
    rows = alerts.join(entities.select("provider_id", "alert_row", "route_id", "stop_id"), ["provider_id", "alert_row"], "left")
    return rows.select(
        "provider_id", "alert_row", "alert_id", "header", "description", "severity", "cause", "effect", "route_id", "stop_id", F.to_date(local).alias("provider_local_date"), *buckets, "active_start", "active_end", "captured_at_utc",
        content.alias("effective_content_hash"),
    )


def archive_entries(alerts: DataFrame) -> DataFrame:
    """One entry an alert: stable id, newest non-null value of each field, united routes and periods, first sight, month, digest."""
    stable = F.coalesce("alert_id", F.concat(F.lit("synthetic-"), F.substring(F.md5(F.concat_ws("\u001f", "header", "description")), 1, 12)))
    order = F.struct("captured_at_utc", "alert_row")
    newest = [F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in ("header", "description", "severity", "cause", "effect")]
    period = F.concat_ws("/", F.date_format("active_start", "yyyy-MM-dd HH:mm:ss"), F.date_format("active_end", "yyyy-MM-dd HH:mm:ss"))
    rows = alerts.withColumn("stable_id", stable).groupBy("provider_id", "stable_id").agg(
        *newest, F.min("captured_at_utc").alias("first_seen"), F.max("captured_at_utc").alias("last_seen"), F.array_join(F.sort_array(F.collect_set("route_id")), ",").alias("routes"), F.array_join(F.sort_array(F.collect_set(period)), ",").alias("periods")
    )
    rows = rows.withColumn("archive_month", F.date_format("first_seen", "yyyy-MM"))
    spelled = F.concat_ws("\u001f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("stable_id", "header", "description", "severity", "cause", "effect", "routes", "periods")))
    return rows.withColumn("digest", F.sha2(spelled, 256))


def archive_merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entries after a sync: first sight and month of an old entry stay; the source seen later wins where it knows a value, the other fills NULLs; lists unite."""
    key = ["provider_id", "stable_id"]
    a, b = old.alias("a"), new.alias("b")
    rows = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key], "full")
    later = F.col("b.last_seen") >= F.col("a.last_seen")
    pick = lambda c: F.when(F.coalesce(later, F.lit(True)), F.coalesce(f"b.{c}", f"a.{c}")).otherwise(F.coalesce(f"a.{c}", f"b.{c}")).alias(c)
    united = lambda c: F.array_join(F.array_sort(F.array_distinct(F.filter(F.concat(F.split(F.coalesce(f"a.{c}", F.lit("")), ","), F.split(F.coalesce(f"b.{c}", F.lit("")), ",")), lambda x: x != ""))), ",").alias(c)
    return rows.select(
        *(F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in key), *(pick(c) for c in ("header", "description", "severity", "cause", "effect")), F.coalesce("a.first_seen", "b.first_seen").alias("first_seen"),
        F.greatest("a.last_seen", "b.last_seen").alias("last_seen"), united("routes"), united("periods"), F.coalesce("a.archive_month", "b.archive_month").alias("archive_month"),
    )


def language_coverage(observations: DataFrame, feed_days: DataFrame, last: Column, windows: Sequence[int] = (7, 30)) -> DataFrame:
    """Provider x trailing window: state and shares of explicit English and French among determined alerts, undetermined among all.

    observations: provider_id, observation_date, has_en, has_fr, undetermined; feed_days: provider_id, observation_date; supported providers are those of `feed_days` flagged so."""
    spans = F.array(*map(F.lit, windows))
    dealt = lambda rows: rows.withColumn("window_days", F.explode(F.filter(spans, lambda n: F.date_diff(last, F.col("observation_date")).between(0, n - 1))))
    counts = dealt(observations).groupBy("provider_id", "window_days").agg(
        F.count(F.lit(1)).alias("alert_observation_count"), K.count_if(~F.col("undetermined")).alias("denominator"), K.count_if(F.col("has_en")).alias("en"), K.count_if(F.col("has_fr")).alias("fr"), K.count_if(F.col("undetermined")).alias("und")
    )
    days = dealt(feed_days.where("observed")).groupBy("provider_id", "window_days").agg(F.count(F.lit(1)).alias("feed_observation_days"))
    base = feed_days.groupBy("provider_id").agg(F.bool_or("supported").alias("supported")).withColumn("window_days", F.explode(spans))
    rows = base.join(counts, ["provider_id", "window_days"], "left").join(days, ["provider_id", "window_days"], "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    state = F.when(~F.col("supported"), "unsupported").when(n("feed_observation_days") == 0, "unavailable").when(n("alert_observation_count") == 0, "no-alerts").otherwise("available")
    pct = lambda a, b: F.when(F.col("state") == "available", K.half_away(K.ratio(100.0 * n(a), n(b)), 2))
    rows = rows.withColumn("state", state)
    return rows.select("provider_id", "window_days", "state", *(F.when(F.col("supported"), n(c)).otherwise(0).alias(c) for c in ("denominator", "alert_observation_count", "feed_observation_days")), pct("en", "denominator").alias("explicit_en_pct"), pct("fr", "denominator").alias("explicit_fr_pct"), pct("und", "alert_observation_count").alias("undetermined_pct"))
