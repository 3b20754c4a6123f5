"""Alert snapshots as JSON: lists under several names, fields under several names, languages by explicit marks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names under which feeds list alerts and give their fields. The first name that an alert has counts.
LISTS = ("alerts", "messages", "data", "items", "results")
FIELDS = {
    "alert_id": ("id", "alertId", "messageId"),
    "header": ("header", "title", "summary", "header_texts"),
    "description": ("description", "body", "message", "description_texts"),
    "severity": ("severity", "priority"),
    "cause": ("cause",),
    "effect": ("effect",),
    "url": ("url", "link"),
    "published": ("publishedAt", "published_at"),
    "updated": ("updatedAt", "updated_at"),
    "periods": ("activePeriod", "active_period", "activePeriods", "active_periods"),
    "entities": ("informedEntities", "informed_entities", "entities"),
    "routes": ("routes", "routeIds", "route_ids"),
    "stops": ("stops", "stopIds", "stop_ids"),
}
START, END = ("start", "startTime", "start_time"), ("end", "endTime", "end_time")
ENTITY = {
    "route_id": ("routeId", "route_id", "route", "route_short_name"),
    "stop_id": ("stopId", "stop_id", "stop", "stop_code"),
    "trip_id": ("tripId", "trip_id", "trip"),
    "area_id": ("areaId", "area_id", "area"),
}
#: Names that are no part of an alert's own identity where it has no id: they may be filled in later.
ENRICHMENT = ("alert_header_text_en", "description_text_en", "header_text_en", "description_en")
#: Our additions, asked last: names that other feeds use.
MORE = {"alert_id": ("alert_id",), "header": ("header_text",), "description": ("description_text",), "severity": ("severity_level",), "entities": ("informed_entity", "informedEntity")}
ENGLISH, FRENCH = ("en", "eng"), ("fr", "fra")
#: Fields that hold texts in several languages.
TEXTS = ("header", "description", "url")


def at(row: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(row, path, kind)


def first_of(row: Column, names: Sequence[str]) -> Column:
    """The value under the first of the names that the object has, be it null."""
    return F.coalesce(*(at(row, f"$.{n}") for n in names))


def is_a(value: Column, kind: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(value), F.lit(kind)), F.lit(False))


def plain(value: Column) -> Column:
    """A string without outer white space, null if blank; a number as it is spelled."""
    spelled = F.when(F.regexp_like(F.schema_of_variant(value), F.lit("^(STRING|BIGINT|D)")), at(value, "$", "string"))
    return F.nullif(F.regexp_replace(spelled, r"^\s+|\s+$", ""), F.lit(""))


def own_text(item: Column) -> Column:
    """plain(), or that of an object's text or value."""
    return F.coalesce(plain(item), plain(at(item, "$.text")), plain(at(item, "$.value")))


def primary(language: Column) -> Column:
    """The primary subtag of a language mark: fr of fr-CA or FR_ca."""
    return F.substring_index(F.replace(F.lower(F.trim(language)), F.lit("_"), F.lit("-")), "-", 1)


def listed(value: Column) -> Column:
    return F.coalesce(F.when(is_a(value, "ARRAY"), at(value, "$", "array<variant>")), F.array().cast("array<variant>"))


def texts_of(value: Column) -> Column:
    """All texts of a string, a number, an object or a list of these: where from (bare, mark: an object's text beside its language, or key: under a language's name), key, language, text."""
    items = F.when(is_a(value, "ARRAY"), at(value, "$", "array<variant>")).otherwise(F.array(value))
    entry = lambda by, key, language, text: F.struct(F.lit(by).alias("by"), key.cast("string").alias("key"), language.cast("string").alias("language"), text.alias("text"))
    none = F.lit(None)

    def of(item: Column) -> Column:
        mark = primary(at(item, "$.language", "string"))
        pairs = F.coalesce(F.map_entries(at(item, "$", "map<string,variant>")), F.map_entries(F.create_map().cast("map<string,variant>")))
        own = F.array(entry("bare", none, none, plain(item)), entry("mark", none, mark, F.coalesce(plain(at(item, "$.text")), plain(at(item, "$.value")))))
        pairs = F.filter(pairs, lambda p: ~p["key"].isin("language", "text", "value"))
        return F.concat(own, F.transform(pairs, lambda p: entry("key", p["key"], primary(p["key"]), own_text(p["value"]))))

    return F.filter(F.flatten(F.transform(items, of)), lambda t: t["text"].isNotNull())


def first_text(texts: Column, wanted: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(texts, wanted), F.lit(0))["text"]


def chosen(texts: Column) -> Column:
    """The text that counts: one that is marked as French before others, a key's only where there is no other."""
    own = lambda t: t["by"] != "key"
    return F.coalesce(first_text(texts, lambda t: own(t) & t["language"].isin(*FRENCH)), first_text(texts, own), first_text(texts, lambda t: t["key"] == "fr"), first_text(texts, lambda t: t["key"] == "en"))


def english(texts: Column, in_list: Column) -> Column:
    """The text that a list's item marks as English, or that an object has under en; null without either, also of a bare string."""
    return F.coalesce(first_text(texts, lambda t: in_list & (t["by"] == "mark") & t["language"].isin(*ENGLISH)), first_text(texts, lambda t: ~in_list & (t["key"] == "en")))


def explicit(texts: Column, codes: Sequence[str]) -> Column:
    """Whether a text is marked as of one of the languages: by an item, by the object itself, or by a key."""
    return F.exists(texts, lambda t: F.coalesce(t["language"].isin(*codes), F.lit(False)))


def instant(value: Column) -> Column:
    """Seconds since 1970 or an ISO time, with or without an offset, as a time in UTC."""
    word = plain(value)
    stamp = F.convert_timezone(F.current_timezone(), F.lit("UTC"), word.try_cast("timestamp").cast("timestamp_ntz"))
    return F.coalesce(F.timestamp_add("SECOND", word.try_cast("double").cast("long"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")), stamp)


def logical_id(alert: Column, alert_id: Column, texts: dict[str, Column]) -> Column:
    """The alert's id, or a digest of its content. English that is added to a text in another language leaves the digest as it is; where English is all, it counts.

    texts: texts_of() the fields that hold texts, by name."""
    other = {n: F.filter(t, lambda x: ~F.coalesce(x["language"].isin(*ENGLISH), F.lit(False))) for n, t in texts.items()}
    has_other = F.lit(False)
    for t in other.values():
        has_other = has_other | (F.size(t) > 0)
    names = [*FIELDS["header"], *FIELDS["description"]]
    rest = F.map_filter(at(alert, "$", "map<string,variant>"), lambda k, v: ~k.isin(*ENRICHMENT, *names))
    spelled = F.array_join(F.transform(F.array_sort(F.map_keys(rest)), lambda k: F.concat(k, F.lit("\u001f"), F.to_json(F.element_at(rest, k)))), "\u001e")
    kept = [F.when(has_other, F.to_json(other[n])).otherwise(F.to_json(t)) for n, t in texts.items()]
    digest = F.sha2(F.concat_ws("\u001d", spelled, *kept), 256)
    return F.coalesce(F.concat(F.lit("id:"), alert_id), F.concat(F.lit("content:"), digest))


def raw_alerts(snapshots: DataFrame) -> DataFrame:
    """snapshots (i3_alert_snapshot_id, provider_id, captured_at_utc, payload) as one row an alert object `a`, by its place in the payload's list. What is not JSON or no object gives no row."""
    whole = F.try_parse_json("payload")
    found = F.coalesce(F.when(is_a(whole, "ARRAY"), whole), *(F.when(is_a(at(whole, f"$.{n}"), "ARRAY"), at(whole, f"$.{n}")) for n in LISTS))
    rows = snapshots.select("i3_alert_snapshot_id", "provider_id", "captured_at_utc", found.alias("__list"))
    return rows.select("i3_alert_snapshot_id", "provider_id", "captured_at_utc", F.posexplode(listed(F.col("__list"))).alias("alert_index", "a")).where(is_a(F.col("a"), "OBJECT"))


def normalized(snapshots: DataFrame) -> DataFrame:
    """One row an alert: alert_index, its fields, texts (French or unmarked first) and English texts, published and updated times, active_periods (start, end; the first also as
    active_start, active_end) and entities (route_id, stop_id, trip_id, area_id; of lists of routes and stops if there are none)."""
    rows = raw_alerts(snapshots).withColumns({f"__{f}": first_of(F.col("a"), names + MORE.get(f, ())) for f, names in FIELDS.items()})
    v = lambda f: F.col(f"__{f}")
    rows = rows.withColumns({f"__{f}_texts": texts_of(v(f)) for f in TEXTS})
    as_list = lambda f: F.when(is_a(v(f), "OBJECT"), F.array(v(f))).otherwise(listed(v(f)))
    rows = rows.withColumns({f"__{f}_list": as_list(f) for f in ("periods", "routes", "stops", "entities")})
    periods = F.transform("__periods_list", lambda p: F.struct(instant(first_of(p, START)).alias("start"), instant(first_of(p, END)).alias("end")))
    entity = lambda **of: F.struct(*(of.get(c, F.lit(None)).cast("string").alias(c) for c in ENTITY))
    named = lambda e: entity(**{c: plain(first_of(e, names)) for c, names in ENTITY.items()})
    routes, stops = F.col("__routes_list"), F.col("__stops_list")
    of_stops = F.transform(stops, lambda i: entity(route_id=plain(F.get(routes, F.lit(0))), stop_id=plain(i)))
    derived = F.when((F.size(routes) > 0) & (F.size(stops) == 0), F.transform(routes, lambda i: entity(route_id=plain(i)))).otherwise(of_stops)
    entities = F.when(is_a(v("entities"), "ARRAY"), F.transform(F.filter("__entities_list", lambda e: is_a(e, "OBJECT")), named)).otherwise(derived)
    rows = rows.select(
        "i3_alert_snapshot_id", "provider_id", "captured_at_utc", "alert_index", *(own_text(v(c)).alias(c) for c in ("alert_id", "severity", "cause", "effect")), *(chosen(F.col(f"__{c}_texts")).alias(c) for c in TEXTS),
        *(english(F.col(f"__{c}_texts"), is_a(v(c), "ARRAY")).alias(f"{c}_en") for c in TEXTS), instant(v("published")).alias("published"), instant(v("updated")).alias("updated"), periods.alias("active_periods"), entities.alias("entities"),
    )
    first = lambda f: F.get("active_periods", F.lit(0))[f]
    return rows.withColumns({"active_start": first("start"), "active_end": first("end")})


def alerts(snapshots: DataFrame) -> DataFrame:
    """normalized(), one row an alert and informed entity; an alert without entities is one row without route and stop."""
    each = normalized(snapshots).withColumn("e", F.explode_outer("entities")).drop("entities")
    return each.select("*", "e.route_id", "e.stop_id", "e.trip_id").drop("e")


def language_observations(snapshots: DataFrame, time_zone: str) -> DataFrame:
    """provider_id, alert_logical_id, observation_date, has_fr, has_en, undetermined, observed_at_utc: what marks of language an alert's texts carry.

    One row an alert and local day, of the latest capture; within a capture the last of the list. Bare texts are undetermined."""
    names = ("header", "description")
    rows = raw_alerts(snapshots).withColumns({f"__{c}": first_of(F.col("a"), FIELDS[c]) for c in (*names, "alert_id")})
    rows = rows.withColumns({f"__{c}_texts": texts_of(F.col(f"__{c}")) for c in names})
    texts = {c: F.col(f"__{c}_texts") for c in names}
    has = lambda codes: explicit(texts["header"], codes) | explicit(texts["description"], codes)
    day = F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(time_zone), F.col("captured_at_utc")))
    rows = rows.select("provider_id", logical_id(F.col("a"), own_text(F.col("__alert_id")), texts).alias("alert_logical_id"), day.alias("observation_date"), has(FRENCH).alias("has_fr"), has(ENGLISH).alias("has_en"), "captured_at_utc", "i3_alert_snapshot_id", "alert_index")
    latest = F.max_by(F.struct("has_fr", "has_en", "captured_at_utc"), F.struct("captured_at_utc", "i3_alert_snapshot_id", "alert_index")).alias("o")
    found = rows.groupBy("provider_id", "alert_logical_id", "observation_date").agg(latest)
    return found.select("provider_id", "alert_logical_id", "observation_date", "o.has_fr", "o.has_en", (~F.col("o.has_fr") & ~F.col("o.has_en")).alias("undetermined"), F.col("o.captured_at_utc").alias("observed_at_utc"))


def feed_observations(snapshots: DataFrame, time_zone: str) -> DataFrame:
    """provider_id, observation_date, alert_count, observed_at_utc: the days on which a feed was seen, with the alerts of the day's latest capture (none counts too)."""
    day = F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(time_zone), F.col("captured_at_utc")))
    key = ["i3_alert_snapshot_id", "provider_id", "captured_at_utc"]
    counts = raw_alerts(snapshots).groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    rows = snapshots.select(*key).join(counts, key, "left").select("provider_id", day.alias("observation_date"), F.coalesce("n", F.lit(0)).alias("n"), "captured_at_utc", "i3_alert_snapshot_id")
    latest = F.max_by(F.struct("n", "captured_at_utc"), F.struct("captured_at_utc", "i3_alert_snapshot_id")).alias("o")
    return rows.groupBy("provider_id", "observation_date").agg(latest).select("provider_id", "observation_date", F.col("o.n").alias("alert_count"), F.col("o.captured_at_utc").alias("observed_at_utc"))
