"""Reads composed on the additive spines: folds, windows, ranks, trends and rolling histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctua.constants import BANDS, DELAY_EDGES, GAP_EDGES, RATE_FLOOR, UNKNOWN_STOP, UNROUTED, WINDOW_DAYS
from punctua.functions import kernel as K

DATE = "provider_local_date"


def project(spine: DataFrame, dims: Sequence[Column | str]) -> DataFrame:
    """The one projector: sums of a route spine's counts and of its histogram, by any dimensions."""
    return spine.groupBy(*dims).agg(
        F.sum("observation_count").alias("obs"), F.sum("delay_observation_count").alias("known_obs"), F.sum("on_time_observation_count").alias("on_time"), F.sum("severe_delay_count").alias("severe"),
        F.sum("sum_delay_seconds").alias("sum_delay_sec"), F.array(*(F.sum(F.get("delay_histogram", F.lit(i))) for i in range(len(DELAY_EDGES)))).alias("hist"),
    )


def rated(folded: DataFrame) -> DataFrame:
    """A projection's published rates: punctuality with bounds, severe share, pooled average and percentiles in minutes."""
    low, high = K.wilson(F.col("on_time"), F.col("known_obs"))
    dims = [c for c in folded.columns if c not in ("obs", "known_obs", "on_time", "severe", "sum_delay_sec", "hist")]
    return folded.select(
        *dims, "obs", "known_obs", "on_time", "severe", K.otp_pct(F.col("on_time"), F.col("known_obs")).alias("otp_pct"), K.severe_pct(F.col("known_obs"), F.col("severe")).alias("severe_pct"),
        K.minutes(K.ratio(F.col("sum_delay_sec"), K.total(F.col("hist")))).alias("avg_delay_min"), K.delay_percentile_minutes(F.col("hist"), 0.5, DELAY_EDGES).alias("p50_min"),
        K.delay_percentile_minutes(F.col("hist"), 0.9, DELAY_EDGES).alias("p90_min"), low.alias("wilson_lo"), high.alias("wilson_hi"),
    )


#: The folds of a route (and, without route_id, of the network).
FOLDS = {
    "shift": lambda: [K.shift(F.col("hour_of_day_local")).alias("grain")],
    "day_type": lambda: [K.day_type(F.col(DATE)).alias("grain")],
    "week": lambda: [F.date_trunc("WEEK", F.col(DATE)).cast("date").alias("grain")],
    "month": lambda: [F.date_trunc("MONTH", F.col(DATE)).cast("date").alias("grain")],
    "dow": lambda: [K.iso_day(F.col(DATE)).alias("grain")],
    "crosstab": lambda: [K.shift(F.col("hour_of_day_local")).alias("shift"), K.day_type(F.col(DATE)).alias("day_type")],
}


def route_folds(spine: DataFrame, fold: str) -> DataFrame:
    return rated(project(spine, ["provider_id", "route_id", *FOLDS[fold]()]))


def network_folds(spine: DataFrame, fold: str) -> DataFrame:
    return rated(project(spine, ["provider_id", *FOLDS[fold]()]))


def in_windows(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """rows within the trailing day, week and month windows of their key's newest date (`current`), and the windows before those (`prior`).

    Each row meets its key's anchor once and is then dealt into the windows that hold it."""
    anchors = rows.groupBy(*key).agg(F.max(DATE).alias("anchor"))
    rows = rows.join(anchors, list(key))
    age = F.date_diff(F.col("anchor"), F.col(DATE))
    parts = []
    for grain, days in WINDOW_DAYS.items():
        for k, period in enumerate(("current", "prior")):
            parts.append(F.when((age >= k * days) & (age < (k + 1) * days), F.struct(F.lit(grain).alias("window_grain"), F.lit(period).alias("period"))))
    return rows.withColumn("__w", F.explode(F.array_compact(F.array(*parts)))).select("*", "__w.window_grain", "__w.period").drop("__w", "anchor")


def windowed_folds(spine: DataFrame) -> DataFrame:
    """Route x window: current rates beside the prior window's punctuality and counts."""
    key = ["provider_id", "route_id"]
    both = rated(project(in_windows(spine, key), [*key, "window_grain", "period"]))
    now = both.where("period = 'current'").drop("period")
    before = both.where("period = 'prior'").select(*key, "window_grain", F.col("otp_pct").alias("prior_otp_pct"), F.col("known_obs").alias("prior_known_obs"), F.col("on_time").alias("prior_on_time"))
    out = now.join(before, [*key, "window_grain"], "left")
    return out.withColumn("otp_delta_points", F.col("otp_pct") - F.col("prior_otp_pct"))


def habits(spine: DataFrame, floor: int = 0) -> DataFrame:
    """Weekday x hour problem scores of each route, and their share of the route's greatest; cells under the floor have no score."""
    inside = F.sum(K.total(F.col("delay_histogram")))
    cells = spine.groupBy("provider_id", "route_id", K.iso_day(F.col(DATE)).alias("day_of_week_iso"), "hour_of_day_local").agg(
        F.sum("delay_observation_count").alias("known_obs"), K.problem_score(F.sum("severe_delay_count"), K.half_away(K.ratio(F.sum("sum_delay_seconds"), inside), 2)).alias("score")
    )
    cells = cells.withColumn("score", F.when(F.col("known_obs") >= floor, F.col("score")))
    top = F.max("score").over(Window.partitionBy("provider_id", "route_id"))
    return cells.withColumn("share", F.when(top > 0, K.half_away(F.col("score") / top, 4)))


def windowed_headway(headway: DataFrame, scheduled: DataFrame | None = None) -> DataFrame:
    """Route x window x shift of the window's busiest direction (most trips, then the lower): pooled median, variation, bunched share and excess wait."""
    rows = in_windows(headway, ["provider_id", "route_id"]).where("period = 'current'")
    key = ["provider_id", "route_id", "window_grain"]
    totals = rows.groupBy(*key, "direction_id").agg(F.sum("trip_count").alias("n"))
    best = totals.withColumn("__k", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("n"), "direction_id"))).where("__k = 1").select(*key, "direction_id")
    pooled = rows.join(best, [*key, "direction_id"]).groupBy(*key, "shift").agg(
        F.sum("gap_count").alias("n"), F.sum("sum_gap_min").alias("s"), F.sum("sum_gap_sq_min").alias("q"), F.array(*(F.sum(F.get("gap_histogram", F.lit(i))) for i in range(len(GAP_EDGES) - 1))).alias("hist")
    )
    median = K.histogram_percentile(F.col("hist"), 0.5, GAP_EDGES)
    out = pooled.withColumn("median", median)
    planned = F.lit(None).cast("double") if scheduled is None else F.col("scheduled_headway_min")
    out = out if scheduled is None else out.join(scheduled.select("provider_id", "route_id", "shift", "scheduled_headway_min"), ["provider_id", "route_id", "shift"], "left")
    return out.select(
        *key, "shift", F.col("n").alias("gap_count"), K.half_away(F.col("median"), 1).alias("observed_headway_min"), K.pooled_cov(F.col("n"), F.round("s", 4), F.round("q", 4)).alias("headway_cov"),
        K.half_away(K.bunched_pct(F.col("hist"), GAP_EDGES, F.col("median")), 1).alias("bunched_pct"), K.excess_wait(F.round("s", 4), F.round("q", 4), planned).alias("excess_wait_min"),
    )


def scheduled_headway(trips: DataFrame, stop_times: DataFrame, running: DataFrame) -> DataFrame:
    """Route x shift of the busiest direction: median gap between distinct minutes of departures from the first stop. Times past midnight count in their night.

    running: provider_id, service_id of one date; stop_times with departure seconds `secs`."""
    first = stop_times.groupBy("provider_id", "trip_id").agg(F.min_by("secs", "stop_sequence").alias("secs"))
    rows = trips.join(running, ["provider_id", "service_id"], "left_semi").join(first, ["provider_id", "trip_id"])
    key = ["provider_id", "route_id"]
    counts = rows.groupBy(*key, "direction_id").agg(F.count(F.lit(1)).alias("n"))
    best = counts.withColumn("__k", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("n"), "direction_id"))).where("__k = 1").select(*key, "direction_id")
    minute = F.floor(F.col("secs") / 60)
    hour = (F.floor(minute / 60) % 24).cast("int")
    rows = rows.join(best, [*key, "direction_id"]).select(*key, K.shift(hour).alias("shift"), F.when((minute < 24 * 60) & (hour < 6), minute + 1440).otherwise(minute).alias("m")).distinct()
    gap = rows.withColumn("gap", F.col("m") - F.lag("m").over(Window.partitionBy(*key, "shift").orderBy("m"))).where("gap IS NOT NULL")
    return gap.groupBy(*key, "shift").agg(K.half_away(F.percentile("gap", 0.5), 1).alias("scheduled_headway_min"), F.count(F.lit(1)).alias("gap_count"))


def pooled_stops(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Stop rows pooled: observations, severe, average in minutes, share not severe with its lower bound."""
    pooled = rows.groupBy(*key).agg(F.sum("observation_count").alias("obs"), F.sum("severe_delay_count").alias("severe"), F.sum("sum_delay_seconds").alias("total"))
    low, _ = K.wilson(F.col("obs") - F.col("severe"), F.col("obs"))
    return pooled.select(*key, "obs", "severe", K.minutes(K.ratio(F.col("total"), F.col("obs"))).alias("avg_delay_min"), K.proxy_otp_pct(F.col("obs"), F.col("severe")).alias("otp_proxy_pct"), low.alias("wilson_lo"))


def top(rows: DataFrame, key: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each key, with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= n)


def numbered(rows: DataFrame, key: Sequence[str], bucket: Column, order: Sequence[Column], name: str, descending: bool = False) -> DataFrame:
    """rows with their place (from 1) within a key: the place in their own bucket after the sizes of all before. Only a bucket's rows meet in one task, so bucket must ascend (or descend) with the order."""
    rows = rows.withColumn("__bucket", bucket)
    sizes = rows.groupBy(*key, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    first = Window.partitionBy(*key).orderBy(F.desc("__bucket") if descending else F.asc("__bucket"))
    sizes = sizes.select(*key, "__bucket", (F.sum("__n").over(first) - F.col("__n")).alias("__before"))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in (*key, "__bucket")]
    own = F.row_number().over(Window.partitionBy(*key, "__bucket").orderBy(*order))
    placed = rows.withColumn("__own", own).alias("r").join(sizes.alias("s"), same)
    return placed.select("r.*", (F.col("s.__before") + F.col("r.__own")).cast("int").alias(name)).drop("__bucket", "__own")


def weak_stops(stop_spine: DataFrame, n: int = 15, floor: int = RATE_FLOOR) -> DataFrame:
    """Route x window: the stops of enough observations with the lowest bound of not-severe shares."""
    rows = in_windows(stop_spine.where((F.col("route_id") != UNROUTED) & (F.col("stop_id") != UNKNOWN_STOP)), ["provider_id", "route_id"]).where("period = 'current'")
    key = ["provider_id", "route_id", "window_grain"]
    pooled = pooled_stops(rows, [*key, "stop_id"]).where(F.col("obs") >= floor)
    return top(pooled, key, [F.asc("wilson_lo"), F.desc("avg_delay_min"), F.asc("stop_id")], n)


def weak_stops_scalar(stop_spine: DataFrame, n: int = 15) -> DataFrame:
    """The month window's stops by average delay."""
    rows = in_windows(stop_spine.where(F.col("route_id") != UNROUTED), ["provider_id", "route_id"]).where("period = 'current' AND window_grain = 'month'")
    key = ["provider_id", "route_id"]
    return top(pooled_stops(rows, [*key, "stop_id"]), key, [F.desc("avg_delay_min"), F.asc("stop_id")], n)


def last_days(rows: DataFrame, key: Sequence[str], n: int = 30) -> DataFrame:
    """The newest n dates of each key."""
    return top(rows, key, [F.desc(DATE)], n).drop("rank")


def completeness(cancellations: DataFrame) -> DataFrame:
    """Delivered share of the schedule in percent with two decimals, at most 100, NULL without a schedule."""
    share = F.when(F.col("scheduled_trip_days") > 0, F.least(F.lit(100.0), K.half_away(K.ratio(100.0 * F.col("delivered_trip_days"), F.col("scheduled_trip_days")), 2)))
    return cancellations.withColumn("completeness_pct", share)


def band_shares(rows: DataFrame, key: Sequence[Column | str]) -> DataFrame:
    """Occupancy bands as shares of all observations."""
    sums = rows.groupBy(*key).agg(F.sum("observation_count").alias("observation_count"), *(F.sum(f"{b}_count").alias(f"{b}_count") for b in BANDS))
    names = [c for c in sums.columns if not c.endswith("_count")]
    return sums.select(*names, "observation_count", *(K.half_away(K.ratio(100.0 * F.col(f"{b}_count"), F.col("observation_count")), 1).alias(f"{b}_pct") for b in BANDS))


def occupancy_window(hourly: DataFrame, today: Column, fold: str, entity: str = "route_id") -> DataFrame:
    """Occupancy of routes (or another entity) of the trailing 30 days before and with `today`: total, by weekday, by hour or by day."""
    rows = hourly.where(F.col(DATE) >= F.date_sub(today, 30))
    dims = {"total": [], "dow": [K.iso_day(F.col(DATE)).alias("day_of_week_iso")], "hour": ["hour_of_day_local"], "day": [DATE]}[fold]
    return band_shares(rows, ["provider_id", entity, *dims])


def crowding_delay(crowding: DataFrame, today: Column) -> DataFrame:
    """Band x delay of the trailing 30 days: pooled average, and the mean of daily medians weighted by observations."""
    n = F.sum("delay_observation_count")
    rows = crowding.where(F.col(DATE) >= F.date_sub(today, 30)).groupBy("provider_id", "route_id", "band").agg(
        n.alias("observation_count"), F.count_distinct(DATE).alias("day_count"), F.sum("sum_delay_seconds").alias("s"), F.round(F.sum(F.col("p50_delay_seconds") * F.col("delay_observation_count")), 4).alias("w")
    )
    return rows.select("provider_id", "route_id", "band", "observation_count", "day_count", K.minutes(K.ratio(F.col("s"), F.col("observation_count"))).alias("avg_delay_min"), K.minutes(K.ratio(F.col("w"), F.col("observation_count"))).alias("p50_min"))


def stop_reliability(stop_shift: DataFrame, fold: str) -> DataFrame:
    """Stop folds: week, month, route, the last 90 days, weekday, and shift beside day type in one table."""
    key = ["provider_id", "stop_id"]
    if fold == "grain":
        kinds = F.array(F.struct(F.lit("shift").alias("kind"), F.col("shift").alias("grain")), F.struct(F.lit("day_type").alias("kind"), K.day_type(F.col(DATE)).alias("grain")))
        return pooled_stops(stop_shift.withColumn("__g", F.explode(kinds)).select("*", "__g.kind", "__g.grain"), [*key, "kind", "grain"])
    dims = {"week": F.date_trunc("WEEK", F.col(DATE)).cast("date"), "month": F.date_trunc("MONTH", F.col(DATE)).cast("date"), "route": F.col("route_id"), "dow": K.iso_day(F.col(DATE)), "day": F.col(DATE)}
    pooled = pooled_stops(stop_shift.withColumn("grain", dims[fold]), [*key, "grain"])
    return pooled if fold != "day" else top(pooled, key, [F.desc("grain")], 90).drop("rank")


def severe_matrix(fact: DataFrame) -> DataFrame:
    """Stop x weekday x hour counts of severe delays."""
    d = F.col("delay_seconds")
    rows = fact.where(F.col("delay_stop_id").isNotNull() & K.severe(d))
    return rows.groupBy("provider_id", F.col("delay_stop_id").alias("stop_id"), K.iso_day(F.col("snapshot_local_date")).alias("day_of_week_iso"), F.col("local_hour").alias("hour_of_day_local")).agg(F.count(F.lit(1)).alias("severe_count"))


def newest(rows: DataFrame, key: Sequence[str], by: str) -> DataFrame:
    """One row of each key, that of the newest date."""
    return top(rows, key, [F.desc(by)], 1).drop("rank")


#: Days of the spine that a trend by day, week or month shows, and days of facts behind a day's exact percentile and vehicles.
TREND_DAYS = {"day": 90, "week": 371, "month": 371}
FACT_DAYS = 14


def network_trend(spine: DataFrame, fact: DataFrame, cancellations: DataFrame, bands: DataFrame, today: Column, grain: str) -> DataFrame:
    """Network x date (or week, month), joined in full on the date: rates from the spine of the trailing days; cancellations, completeness and
    occupancy shares; by day also the exact 90th percentile of delays and the vehicles, from the facts that are kept (NULL by week and month).

    bands: route_occupancy_band_daily. Delays beyond the clamp enter neither percentile nor vehicles."""
    unit = {"day": lambda c: c, "week": lambda c: F.date_trunc("WEEK", c).cast("date"), "month": lambda c: F.date_trunc("MONTH", c).cast("date")}[grain]
    key, delay = ["provider_id", "d"], F.col("delay_seconds")
    rates = rated(project(spine.where(F.col(DATE) >= F.date_sub(today, TREND_DAYS[grain])), ["provider_id", unit(F.col(DATE)).alias("d")]))
    known = F.col("scheduled_trip_days").isNotNull()
    trips = cancellations.groupBy("provider_id", unit(F.col(DATE)).alias("d")).agg(
        F.sum("total_trip_days").alias("t"), F.sum("canceled_trip_days").alias("c"), F.sum("scheduled_trip_days").alias("scheduled_trip_days"), F.sum(F.when(known, F.col("delivered_trip_days"))).alias("delivered_trip_days")
    )
    trips = completeness(trips).select(*key, K.half_away(K.ratio(100.0 * F.col("c"), F.col("t")), 2).alias("cancellation_rate_pct"), "completeness_pct")
    shares = band_shares(bands, ["provider_id", unit(F.col(DATE)).alias("d")]).drop("observation_count")
    out = rates.join(trips, key, "full").join(shares, key, "full")
    if grain != "day":
        return out.withColumn("fact_p90_min", F.lit(None).cast("double")).withColumn("vehicle_count", F.lit(None).cast("long"))
    kept = fact.where((F.col("captured_at_utc") >= F.date_sub(today, FACT_DAYS).cast("timestamp_ntz")) & K.in_clamp(delay))
    seen = kept.groupBy("provider_id", F.col("snapshot_local_date").alias("d")).agg(K.minutes(F.percentile(delay, 0.9)).alias("fact_p90_min"), F.count_distinct("vehicle_id").alias("vehicle_count"))
    return out.join(seen, key, "full")


def receipts(accountability: DataFrame, spine: DataFrame, routes_daily: DataFrame, stops_daily: DataFrame, cancellations: DataFrame) -> DataFrame:
    """A row a day of the accountability table: network rates; the route and the stop with the greatest average delay (ties: the lower id),
    the route's punctuality against the network's; the scheduled trips and what became of them, with the number of routes that the
    schedule has but nothing was seen of. Trips of routes without a schedule count in none of these.

    routes_daily: provider_id, provider_local_date, route_id, delay_observation_count, on_time_observation_count, avg_delay_seconds; stops_daily: likewise by stop_id."""
    key = ["provider_id", DATE]
    day = rated(project(spine, key)).select(*key, "otp_pct", "avg_delay_min", "severe_pct")
    worst = lambda rows, c, other: top(rows.where(F.col("avg_delay_seconds").isNotNull() & (F.col(c) != other)), key, [F.desc("avg_delay_seconds"), F.asc(c)], 1)
    route = worst(routes_daily, "route_id", UNROUTED).select(*key, F.col("route_id").alias("worst_route_id"), K.otp_pct(F.col("on_time_observation_count"), F.col("delay_observation_count")).alias("__otp"))
    stop = worst(stops_daily, "stop_id", UNKNOWN_STOP).select(*key, F.col("stop_id").alias("worst_stop_id"), K.minutes(F.col("avg_delay_seconds")).alias("worst_stop_delay_min"))
    planned = cancellations.where("scheduled_trip_days IS NOT NULL")
    dark = (F.col("total_trip_days") == 0) & (F.col("scheduled_trip_days") > 0) & (F.col("route_id") != UNROUTED)
    states = planned.groupBy(*key).agg(
        F.sum("scheduled_trip_days").alias("scheduled_trip_days"), F.sum("delivered_trip_days").alias("delivered_trip_days"), F.sum("canceled_trip_days").alias("cancelled_trip_days"),
        F.sum("silent_trip_days").alias("silent_trip_days"), F.count_if(dark).alias("not_reported_route_count"),
    )
    out = accountability.join(day, key, "left").join(route, key, "left").join(stop, key, "left").join(completeness(states), key, "left")
    return out.withColumn("worst_route_otp_delta", F.col("__otp") - F.col("otp_pct")).drop("__otp")


def all_routes(spine: DataFrame) -> DataFrame:
    """Every section of every route in one pass over the spine: rates of all its days by week, month, shift, day type, weekday, shift x day
    type and weekday x hour, and the same of the trailing windows (shift and day type also of the windows before; all: the window whole).

    section, window_grain and period (NULL over all days), grain and grain_2 as text; habit cells (weekday x hour) have a problem score.
    A row is dealt into its sections by an explode; the partial sums before the shuffle bring it back to a row for each cell."""
    key = ["provider_id", "route_id"]
    age = F.date_diff(F.max(DATE).over(Window.partitionBy(*key)), F.col(DATE))
    spans = [F.when((age >= k * days) & (age < (k + 1) * days), F.struct(F.lit(grain).alias("window_grain"), F.lit(period).alias("period"))) for grain, days in WINDOW_DAYS.items() for k, period in enumerate(("current", "prior"))]
    grain = {fold: FOLDS[fold]()[0].cast("string") for fold in ("shift", "day_type", "week", "month", "dow")}
    cells = {"shift": (grain["shift"], None), "day_type": (grain["day_type"], None), "dow": (grain["dow"], None), "crosstab": (grain["shift"], grain["day_type"]), "habit": (grain["dow"], F.col("hour_of_day_local").cast("string"))}
    whole = {"week": (grain["week"], None), "month": (grain["month"], None)} | cells
    windowed = {"all": (F.lit("all"), None)} | cells

    def part(section: str, cell: tuple, window: Column | None) -> Column:
        in_window = lambda c: F.lit(None).cast("string") if window is None else window[c]
        second = F.lit(None).cast("string") if cell[1] is None else cell[1]
        row = F.struct(F.lit(section).alias("section"), in_window("window_grain").alias("window_grain"), in_window("period").alias("period"), cell[0].alias("grain"), second.alias("grain_2"))
        return row if window is None or section in ("all", "shift", "day_type") else F.when(window["period"] == "current", row)

    dealt = F.flatten(F.transform("__spans", lambda w: F.array(*(part(s, c, w) for s, c in windowed.items()))))
    rows = spine.withColumn("__spans", F.array_compact(F.array(*spans))).withColumn("__s", F.explode(F.array_compact(F.concat(F.array(*(part(s, c, None) for s, c in whole.items())), dealt))))
    found = project(rows.select("*", "__s.*"), [*key, "section", "window_grain", "period", "grain", "grain_2"])
    average = K.half_away(K.ratio(F.col("sum_delay_sec"), K.total(F.col("hist"))), 2)
    return rated(found.withColumn("problem_score", F.when(F.col("section") == "habit", K.problem_score(F.col("severe"), average))))


def hotspots(problems: DataFrame, spine: DataFrame, stop_spine: DataFrame, n: int = 20) -> DataFrame:
    """The worst routes and stops by issues of the newest week, or of the newest period of any grain where there is no week, each against the network of its kind in that week.

    Routes by their punctuality; stops, of which none is known, by their share without severe delay, network and all. Of another period than a week no rates are given."""
    newest = problems.groupBy("provider_id").agg(F.max(F.struct((F.col("period_grain") == "week").alias("is_week"), "period_start_local", "period_grain")).alias("t"))
    target = F.broadcast(newest.select("provider_id", "t.period_start_local", "t.period_grain"))
    rows = problems.where(~F.col("entity_id").isin(UNROUTED, UNKNOWN_STOP)).join(target, ["provider_id", "period_start_local", "period_grain"], "left_semi")
    ranked = top(rows, ["provider_id"], [F.desc("issue_count"), F.asc("entity_kind"), F.asc("entity_id"), F.asc("route_id")], n)

    def of_week(rows: DataFrame, kind: str, entity: str, good: Column, known: Column, network_known: Column) -> tuple[DataFrame, DataFrame]:
        weeks = rows.withColumn("period_start_local", F.date_trunc("WEEK", DATE).cast("date")).join(target, ["provider_id", "period_start_local"], "left_semi")
        sums = weeks.groupBy("provider_id", F.lit(kind).alias("entity_kind"), F.col(entity).alias("entity_id")).agg(F.sum(good).alias("good"), F.sum(known).alias("known"), F.sum(network_known).alias("of"))
        network = sums.groupBy("provider_id", "entity_kind").agg(K.otp_pct(F.sum("good"), F.sum("of")).alias("network_otp_pct"))
        return sums.select("provider_id", "entity_kind", "entity_id", K.otp_pct(F.col("good"), F.col("known")).alias("otp_pct")), network

    known = F.col("delay_observation_count")
    routes, network = of_week(spine, "route", "route_id", F.col("on_time_observation_count"), known, F.when(F.col("on_time_observation_count").isNotNull(), known))
    seen = F.col("observation_count")
    stops, stop_network = of_week(stop_spine, "stop", "stop_id", seen - F.col("severe_delay_count"), seen, seen)
    out = ranked.join(routes.unionByName(stops), ["provider_id", "entity_kind", "entity_id"], "left").join(F.broadcast(network.unionByName(stop_network)), ["provider_id", "entity_kind"], "left")
    return out.withColumn("otp_delta_points", F.bround((F.col("otp_pct") - F.col("network_otp_pct")).cast("decimal(10,2)"), 0).cast("double"))


def hotspots_by_grain(spine: DataFrame, stop_spine: DataFrame, n: int = 50, tray: int = 60) -> DataFrame:
    """Routes and stops of each window. Those of enough observations stand on a ladder of their kind by the lower bound of their share
    without severe delay, then by average delay; the others share a tray by their severe share. otp_delta_points: against the network of the kind."""
    def of_kind(rows: DataFrame, kind: str, entity: str, count: str) -> DataFrame:
        key = ["provider_id", "window_grain", F.lit(kind).alias("entity_kind"), F.col(entity).alias("entity_id")]
        return in_windows(rows, ["provider_id"]).where("period = 'current'").groupBy(*key).agg(F.sum(count).alias("obs"), F.sum("severe_delay_count").alias("severe"), F.sum("sum_delay_seconds").alias("total"))

    rows = of_kind(spine, "route", "route_id", "delay_observation_count").unionByName(of_kind(stop_spine.where(F.col("stop_id") != UNKNOWN_STOP), "stop", "stop_id", "observation_count"))
    return ladders(rows, ["provider_id", "window_grain"], n, tray)


def ladders(rows: DataFrame, scope: Sequence[str], n: int, tray: int) -> DataFrame:
    """scope, entity_kind, entity_id, obs, severe, total: the ranked entities of each scope, as hotspots_by_grain() says."""
    network = rows.groupBy(*scope, "entity_kind").agg(K.half_away(K.ratio(100.0 * F.sum("severe"), F.sum("obs")), 1).alias("__network"))
    low, _ = K.wilson(F.col("obs") - F.col("severe"), F.col("obs"))
    rows = rows.join(network, [*scope, "entity_kind"])
    delta = K.half_away(K.ratio(100.0 * (F.col("obs") - F.col("severe")), F.col("obs")), 0) - (100 - F.col("__network"))
    is_tray = F.coalesce(F.col("obs"), F.lit(0)) < RATE_FLOOR
    rows = rows.select(
        *scope, "entity_kind", "entity_id", "obs", "severe", K.half_away(K.ratio(100.0 * F.col("severe"), F.col("obs")), 1).alias("severe_pct"),
        K.half_away(K.ratio(F.col("total"), F.col("obs")) / 60.0, 1).alias("avg_delay_min"), low.alias("wilson_lo"), is_tray.alias("is_tray"), F.when(~is_tray, F.round(delta, 1)).alias("otp_delta_points"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    ladder = top(rows.where("NOT is_tray"), [*scope, "entity_kind"], [F.asc("wilson_lo"), zero("avg_delay_min").desc(), F.asc("entity_id")], n)
    return ladder.unionByName(top(rows.where("is_tray"), scope, [zero("severe_pct").desc(), F.asc("entity_id"), F.asc("entity_kind")], tray))


#: The shifts of the peak, and the days it looks back on.
PEAK, PEAK_DAYS = ("am_peak", "pm_peak"), 7


def hotspots_as_of(spine: DataFrame, stop_shift_spine: DataFrame, names: DataFrame, time_zone: str, n: int = 50, tray: int = 60) -> DataFrame:
    """The ladders and trays of routes and stops as they stood on each date with data: of the trailing day, week and month, and of the peak shifts of the trailing week (grain `shift`), with the name in force then.

    A daily row counts for every date whose window holds it, also where its entity is not seen on that date. names: provider_id, entity_kind, entity_id, name, valid_from, valid_to."""
    def daily(rows: DataFrame, kind: str, entity: str, count: str, peak: Column) -> DataFrame:
        sums = {"obs": count, "severe": "severe_delay_count", "total": "sum_delay_seconds"}
        found = rows.where(~F.col(entity).isin(UNROUTED, UNKNOWN_STOP)).groupBy("provider_id", F.lit(kind).alias("entity_kind"), F.col(entity).alias("entity_id"), DATE)
        return found.agg(*(F.sum(v).alias(a) for a, v in sums.items()), *(F.sum(F.when(peak, F.col(v))).alias(f"peak_{a}") for a, v in sums.items()), K.count_if(peak).alias("peak_rows"))

    routes = daily(spine, "route", "route_id", "delay_observation_count", K.shift(F.col("hour_of_day_local")).isin(*PEAK))
    rows = routes.unionByName(daily(stop_shift_spine, "stop", "stop_id", "observation_count", F.col("shift").isin(*PEAK)))
    dates = spine.select("provider_id", DATE).union(stop_shift_spine.select("provider_id", DATE)).distinct()
    part = lambda grain, days, prefix: F.struct(F.lit(grain).alias("window_grain"), F.lit(days).alias("days"), *(F.col(f"{prefix}{c}").alias(c) for c in ("obs", "severe", "total")))
    shift = F.when(F.col("peak_rows") > 0, part("shift", PEAK_DAYS, "peak_"))
    each = rows.select("provider_id", "entity_kind", "entity_id", DATE, F.explode(F.array_compact(F.array(*(part(g, d, "") for g, d in WINDOW_DAYS.items()), shift))).alias("g"))
    each = each.withColumn(DATE, F.explode(F.sequence(F.col(DATE), F.date_add(DATE, F.col("g.days") - 1)))).join(dates, ["provider_id", DATE], "left_semi")
    sums = each.groupBy("provider_id", DATE, F.col("g.window_grain").alias("window_grain"), "entity_kind", "entity_id").agg(*(F.sum(f"g.{c}").alias(c) for c in ("obs", "severe", "total")))
    return names_at(ladders(sums, ["provider_id", DATE, "window_grain"], n, tray), names, ["entity_kind", "entity_id"], time_zone)


def offenders_by_grain(offender_spine: DataFrame, n: int = 50, tray: int = 60) -> DataFrame:
    """Trips and vehicles of the week and month windows: distinct severe and observed days; under three severe days a tray, which needs two."""
    rows = in_windows(offender_spine, ["provider_id"]).where("period = 'current' AND window_grain <> 'day'")
    key = ["provider_id", "window_grain", "entity_kind", "entity_id", "route_id"]
    found = rows.groupBy(*key).agg(
        F.count_distinct(F.when(F.col("severe_delay_count") > 0, F.col(DATE))).alias("recurrence"), F.count_distinct(DATE).alias("observed_days"), F.sum("observation_count").alias("obs"),
        K.half_away(K.ratio(F.sum("sum_delay_seconds"), F.sum("observation_count")), 1).alias("avg_delay_seconds"),
    ).where("recurrence >= 2")
    found = found.withColumn("is_tray", F.col("recurrence") < 3)
    ranked = top(found, ["provider_id", "window_grain", "is_tray"], [F.desc("recurrence"), F.desc("avg_delay_seconds"), F.asc("entity_kind"), F.asc("entity_id"), F.asc("route_id")], max(n, tray))
    return ranked.where(F.col("rank") <= F.when(F.col("is_tray"), tray).otherwise(n))


def rolling_sums(rows: DataFrame, key: Sequence[str], values: Sequence[str], days: int) -> DataFrame:
    """For each key and date on which it is seen, sums over that date and the days - 1 before: a range frame on the day number."""
    w = Window.partitionBy(*key).orderBy("__n").rangeBetween(-(days - 1), 0)
    daily = rows.groupBy(*key, DATE).agg(*(F.sum(v).alias(v) for v in values)).withColumn("__n", F.unix_date(DATE))
    return daily.select(*key, DATE, *(F.sum(v).over(w).alias(f"{v}_{days}d") for v in values))


def hotspot_history(spine: DataFrame) -> DataFrame:
    """As of each closed date: rolling day, week and month totals of each route, and the ISO week to date."""
    key, values = ["provider_id", "route_id"], ["delay_observation_count", "severe_delay_count", "on_time_observation_count"]
    daily = spine.groupBy(*key, DATE).agg(*(F.sum(v).alias(v) for v in values)).withColumn("__n", F.unix_date(DATE))
    frame = lambda days: Window.partitionBy(*key).orderBy("__n").rangeBetween(-(days - 1), 0)
    week = Window.partitionBy(*key, F.date_trunc("WEEK", F.col(DATE))).orderBy("__n").rangeBetween(Window.unboundedPreceding, 0)
    sums = [F.sum(v).over(frame(days)).alias(f"{v}_{days}d") for v in values for days in WINDOW_DAYS.values()]
    return daily.select(*key, DATE, *sums, *(F.sum(v).over(week).alias(f"{v}_wtd") for v in values))


def offender_history(offender_spine: DataFrame, days: int = 14, least: int = 3) -> DataFrame:
    """As of each date on which an entity is seen: severe days and average of the trailing days; rows with enough severe days."""
    key = ["provider_id", "entity_kind", "entity_id", "route_id"]
    daily = offender_spine.withColumn("bad_day", (F.col("severe_delay_count") > 0).cast("int"))
    rolled = rolling_sums(daily, key, ["bad_day", "sum_delay_seconds", "observation_count"], days)
    rolled = rolled.where(F.col(f"bad_day_{days}d") >= least)
    return rolled.select(*key, DATE, F.col(f"bad_day_{days}d").alias("recurrence_days"), K.half_away(K.ratio(F.col(f"sum_delay_seconds_{days}d"), F.col(f"observation_count_{days}d")), 1).alias("avg_delay_seconds"))


def month_partitions(spine: DataFrame, key: Sequence[str]) -> DataFrame:
    """Additive daily measures with their month, the unit in which histories are published."""
    daily = project(spine, [*key, DATE])
    return daily.withColumn("month", F.date_format(DATE, "yyyy-MM"))


def coverage_gaps(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """First and last date of each key with data, and the missing intervals between (never before or after)."""
    days = rows.select(*key, DATE).distinct()
    w = Window.partitionBy(*key).orderBy(DATE)
    before = F.lag(DATE).over(w)
    days = days.withColumn("__from", F.when(F.date_diff(DATE, before) > 1, F.date_add(before, 1)))
    gap = F.when(F.col("__from").isNotNull(), F.struct(F.col("__from").alias("gap_start"), F.date_sub(DATE, 1).alias("gap_end")))
    return days.groupBy(*key).agg(F.min(DATE).alias("first_date"), F.max(DATE).alias("last_date"), F.count(F.lit(1)).alias("day_count"), F.sort_array(F.collect_list(gap)).alias("gaps"))


def scope_digest(rows: DataFrame, key: Sequence[str], values: Sequence[str]) -> DataFrame:
    """A digest of each key's rows: each row is digested with typed frames, the ordered list of digests again. Lists stay within a key and month."""
    framed = F.concat_ws("\u001f", *(F.when(F.col(v).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col(v).cast("string"))) for v in values))
    one = rows.withColumn("month", F.date_format(DATE, "yyyy-MM")).select(*key, "month", F.sha2(framed, 256).alias("__d"))
    return one.groupBy(*key, "month").agg(F.sha2(F.concat_ws("\u001e", F.sort_array(F.collect_list("__d"))), 256).alias("digest"), F.count(F.lit(1)).alias("row_count"))


def names_at(rows: DataFrame, history: DataFrame, key: str | Sequence[str], time_zone: str) -> DataFrame:
    """rows with the name in force just before the next local midnight of their date; the newest validity wins, without one NULL.

    history: provider_id, key, name, valid_from, valid_to (UTC)."""
    keys = ["provider_id", *([key] if isinstance(key, str) else key)]
    dates = rows.select(*keys, DATE).distinct()
    midnight = F.date_add(F.col(DATE), 1).cast("timestamp_ntz")
    close = F.convert_timezone(F.lit(time_zone), F.lit("UTC"), midnight)
    held = dates.join(history, keys).where((F.col("valid_from") < close) & (F.col("valid_to").isNull() | (F.col("valid_to") >= close)))
    best = held.groupBy(*keys, DATE).agg(F.max_by("name", "valid_from").alias("name"))
    return rows.join(best, [*keys, DATE], "left")
