"""The load of alert snapshots into versioned alerts: redirects to the surviving row, re-keyed parts, filled texts, closed ends."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctua.operators.alerts import ORIGIN, content_hash
from punctua.session import stored

KEY = ("provider_id", "i3_alert_snapshot_id", "alert_index")
#: Fields that the first sight of a content fixes, and those that later sights may fill or renew; the latter are no part of its identity.
FIXED = ("alert_id", "header", "description", "severity", "cause", "effect", "active_start", "active_end", "published", "updated", "captured_at_utc")
RENEWED = ("header_en", "description_en", "url", "url_en")
PARTS = ("route_id", "stop_id", "trip_id", "area_id")
#: Snapshots in a row within which runs of a content are found before they are put together.
STRETCH = 1024


class Loaded(NamedTuple):
    """alerts: KEY, content_hash, FIXED, RENEWED, first_seen, last_seen, valid_to (null while the feed shows it). entities: KEY, entity_index, PARTS. periods: KEY, period_index, start, end."""

    alerts: DataFrame
    entities: DataFrame
    periods: DataFrame


def hashed(rows: DataFrame) -> DataFrame:
    """Alerts (see alert_json.normalized) with content_hash: of the identity, and of all periods after the first if there are any."""
    seconds = lambda t: F.coalesce(F.timestamp_diff("SECOND", F.lit(ORIGIN).cast("timestamp_ntz"), t).cast("string"), F.lit(""))
    more = F.slice("active_periods", 2, F.greatest(F.size("active_periods") - 1, F.lit(0)))
    spelled = F.array_join(F.transform(more, lambda p: F.concat(seconds(p["start"]), F.lit(":"), seconds(p["end"]))), ",")
    return rows.withColumn("content_hash", content_hash(rows.columns, F.when(F.size("active_periods") > 1, spelled)))


def numbered(snapshots: DataFrame) -> DataFrame:
    """snapshots with seq, from 1 on by (captured_at_utc, id) for each provider, and next_at, the capture of the next: the place within the day after the snapshots of the days before, so that no task sorts them all."""
    day = snapshots.withColumn("__day", F.to_date("captured_at_utc"))
    by_day = Window.partitionBy("provider_id").orderBy("__day")
    days = day.groupBy("provider_id", "__day").agg(F.count(F.lit(1)).alias("n"), F.min("captured_at_utc").alias("first"))
    days = days.select("provider_id", "__day", (F.sum("n").over(by_day) - F.col("n")).alias("__before"), F.lead("first").over(by_day).alias("__after"))
    own = Window.partitionBy("provider_id", "__day").orderBy("captured_at_utc", "i3_alert_snapshot_id")
    rows = day.join(days, ["provider_id", "__day"]).withColumns({"seq": F.col("__before") + F.row_number().over(own), "next_at": F.coalesce(F.lead("captured_at_utc").over(own), "__after")})
    return rows.drop("__day", "__before", "__after")


def runs(sights: DataFrame) -> DataFrame:
    """One row for each run of consecutive snapshots (seq) that show a content: provider_id, content_hash, first, and of the first sight its key, FIXED and first_seen, of the last last_seen and next_at, of RENEWED the last known; entities and periods at each place as first seen.

    Runs are found within stretches of snapshots, and only those at the edge of a stretch are put together, so a content that is always shown is no hot key."""
    content, known = ["provider_id", "content_hash"], lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("seq", F.col(c).alias("v")))).alias(c)
    rows = sights.withColumn("stretch", F.expr(f"seq div {STRETCH}"))
    rows = rows.withColumn("__run", F.col("seq") - F.row_number().over(Window.partitionBy(*content, "stretch").orderBy("seq")))
    piece = [*content, "stretch", "__run"]
    earlier = Window.partitionBy(*piece).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    longer = lambda c: F.collect_list(F.when(F.col(f"__{c}"), F.struct("seq", F.col(c).alias("v")))).alias(c)
    rows = rows.withColumns({f"__{c}": size(c) > F.coalesce(F.max(size(c)).over(earlier), F.lit(0)) for c in ("entities", "active_periods")})
    head = F.struct(*KEY[1:], *FIXED, "first_seen")
    pieces = rows.groupBy(*piece).agg(
        F.min("seq").alias("first"), F.max("seq").alias("last"), F.min_by(head, "seq").alias("head"), F.max_by(F.struct("last_seen", "next_at"), "seq").alias("tail"), *(known(c) for c in RENEWED), longer("entities"), longer("active_periods"),
    )
    edge = (F.col("first") % STRETCH == 0) | (F.col("last") % STRETCH == STRETCH - 1)
    pieces = pieces.withColumn("lane", F.when(~edge, F.col("stretch")).otherwise(-1))
    lane = Window.partitionBy(*content, "lane").orderBy("first")
    starts = F.coalesce(F.lag("last").over(lane) != F.col("first") - 1, F.lit(True))
    pieces = pieces.withColumn("__start", F.when(starts, F.col("first"))).withColumn("__of", F.max("__start").over(lane))
    joined = lambda c: F.aggregate(F.sort_array(F.flatten(F.collect_list(c))), F.array().cast(sights.schema[c].dataType), lambda kept, x: F.when(F.size(x["v"]) > F.size(kept), F.concat(kept, F.slice(x["v"], F.size(kept) + 1, F.size(x["v"])))).otherwise(kept)).alias(c)
    found = pieces.groupBy(*content, "lane", "__of").agg(F.min_by("head", "first").alias("head"), F.max_by("tail", "first").alias("tail"), *(F.max(c).alias(c) for c in RENEWED), joined("entities"), joined("active_periods"))
    return found.select(*content, F.col("__of").alias("first"), "head.*", *(F.col(f"{c}.v").alias(c) for c in RENEWED), "tail.*", "entities", "active_periods")


def loaded(batch: DataFrame, snapshots: DataFrame, state: Loaded | None = None) -> Loaded:
    """The state after all snapshots of a batch, as if they were loaded one by one in order of capture.

    batch: alerts as alert_json.normalized() gives them; snapshots: provider_id, i3_alert_snapshot_id, captured_at_utc of every one, also those without alerts. Of
    alerts of one content in a snapshot the first stays. A content that an open row holds is redirected to that row, which takes texts that are known by then, and
    entities and periods at places it lacks. Open rows that a snapshot does not show end at its capture; a snapshot without alerts ends none. Snapshots that are not
    newer than those of the state are passed over, so a repeated load changes nothing. Joins that grow with the snapshots are merges: none is sent to the driver.
    """
    rows = hashed(batch)
    if state is not None:
        newest = state.alerts.groupBy("provider_id").agg(F.max(F.greatest("last_seen", F.coalesce("valid_to", "last_seen"))).alias("__newest"))
        fresh = snapshots.join(newest, "provider_id", "left").where(F.col("__newest").isNull() | (F.col("captured_at_utc") > F.col("__newest")))
        snapshots = fresh.select("provider_id", "i3_alert_snapshot_id", "captured_at_utc")
    id_of = ["provider_id", "i3_alert_snapshot_id"]
    order = numbered(snapshots.join(batch.select(*id_of).distinct().hint("merge"), id_of, "left_semi")).withColumn("seq", F.col("seq").cast("long"))
    once = F.row_number().over(Window.partitionBy(*id_of, "content_hash").orderBy("alert_index"))
    sights = rows.join(order.select(*id_of, "seq", "next_at").hint("merge"), id_of).withColumn("__k", once).where("__k = 1")
    columns = (*KEY, "content_hash", *FIXED, *RENEWED)
    new = sights.select(*columns, F.col("captured_at_utc").alias("first_seen"), F.col("captured_at_utc").alias("last_seen"), "seq", "next_at", "entities", "active_periods")
    if state is not None:
        begins = order.groupBy("provider_id").agg(F.min("captured_at_utc").alias("next_at"))
        held = state.alerts.where("valid_to IS NULL").select(*columns, "first_seen", "last_seen", F.lit(0).cast("long").alias("seq")).join(begins, "provider_id", "left")
        new = new.unionByName(held, allowMissingColumns=True)
    # read by each of the three tables
    found = stored(runs(new), "alert-runs")

    def parts(column: str, index: str, values: tuple[str, ...], old: DataFrame | None) -> DataFrame:
        each = found.select(*KEY, "first", F.posexplode(column).alias(index, "part")).select(*KEY, index, *(F.col(f"part.{v}").alias(v) for v in values), "first")
        if old is None:
            return each.drop("first")
        # only rows that were open before can have a place already
        lacking = each.where("first = 0").join(old.select(*KEY, index).hint("merge"), [*KEY, index], "left_anti")
        return old.unionByName(each.where("first > 0").unionByName(lacking).drop("first"))

    alerts = found.select(*KEY, "content_hash", *FIXED, *RENEWED, "first_seen", "last_seen", F.col("next_at").alias("valid_to"))
    if state is not None:
        alerts = alerts.unionByName(state.alerts.where("valid_to IS NOT NULL"))
    return Loaded(alerts, parts("entities", "entity_index", PARTS, state and state.entities), parts("active_periods", "period_index", ("start", "end"), state and state.periods))


def current(state: Loaded, now: Column) -> DataFrame:
    """Alerts in force: of open rows of equal description, severity, cause and effect the one seen last, with its own routes, stops and periods."""
    same = F.md5(F.concat(*(F.coalesce(c, F.lit("")) for c in ("description", "severity", "cause", "effect"))))
    rank = F.row_number().over(Window.partitionBy("provider_id", "same").orderBy(F.col("last_seen").desc_nulls_last(), F.desc("i3_alert_snapshot_id"), "alert_index"))
    picked = state.alerts.where("valid_to IS NULL").withColumn("same", same).withColumn("k", rank).where("k = 1")
    picked = picked.where((F.coalesce("active_start", "captured_at_utc") <= now) & (F.col("active_end").isNull() | (F.col("active_end") >= now)))
    names = lambda c: F.nullif(F.array_join(F.sort_array(F.collect_set(c)), ", "), F.lit(""))
    entities = state.entities.groupBy(*KEY).agg(
        names("route_id").alias("route_ids"), names("stop_id").alias("stop_ids"), F.count_distinct("route_id").alias("route_count"), F.count_distinct("stop_id").alias("stop_count"), F.count(F.lit(1)).alias("entity_count"),
    )
    spans = F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("period_index", "start", "end"))), lambda p: F.struct(F.date_format(p["start"], "yyyy-MM-dd HH:mm:ss").alias("start_utc"), F.date_format(p["end"], "yyyy-MM-dd HH:mm:ss").alias("end_utc"))))
    periods = state.periods.groupBy(*KEY).agg(spans.alias("active_periods"))
    rows = picked.join(entities.hint("merge"), list(KEY), "left").join(periods.hint("merge"), list(KEY), "left")
    return rows.select(
        "provider_id", "alert_id", "header", "description", "severity", "cause", "effect", "route_ids", "stop_ids", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("route_count", "stop_count", "entity_count")),
        "active_start", "active_end", "first_seen", "last_seen", "captured_at_utc", "header_en", "description_en", "url", "url_en", "active_periods",
    )
