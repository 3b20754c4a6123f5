"""Queries of publication (T15, T110): payloads of all tables' days, published twice; and their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctua.plans import publish, snapshot_sink
from punctua.plans import read_queries as R
from punctua.plans import sql as S
from punctua.session import shared_dir, stored

#: The first publication has the days before this one.
UNTIL = "2024-01-20"


def days(spark: SparkSession, d: str, until: str | None) -> DataFrame:
    rows = R.spine(spark, d).groupBy("provider_id", "route_id", F.col("provider_local_date").alias("d")).agg(F.sum("observation_count").alias("n"))
    return rows if until is None else rows.where(F.col("d") < F.lit(until).cast("date"))


def routes(rows: DataFrame) -> DataFrame:
    found = publish.payloads(rows.select("route_id", F.col("d").cast("string").alias("d"), "n"), ["route_id"], ["d"])
    return found.select(F.concat(F.lit("historic/routes/"), "route_id", F.lit(".json")).alias("rel_key"), "payload")


def published(spark: SparkSession, d: str) -> DataFrame:
    """What the second publication's snapshot holds, read back, and whether the first had that content."""
    root = f"{shared_dir(spark)}/published-{uuid.uuid4().hex}"
    rows = stored(days(spark, d, None), "published-days")
    first = snapshot_sink.publish(routes(rows.where(F.col("d") < F.lit(UNTIL).cast("date"))), root, UNTIL)
    snapshot_sink.publish(routes(rows), root, "end")
    old = snapshot_sink.manifest(spark, root, first["generation"]).select("rel_key", "content_hash", F.lit(True).alias("reused"))
    back = snapshot_sink.read(spark, root).withColumn("intact", F.sha2(F.col("payload").cast("binary"), 256) == F.col("content_hash"))
    return back.join(old, ["rel_key", "content_hash"], "left").select("rel_key", "content_hash", "byte_count", "intact", F.coalesce("reused", F.lit(False)).alias("reused"))


def week_pages(rows: DataFrame) -> DataFrame:
    """A page a route and week."""
    return publish.payloads(rows.select("route_id", F.date_trunc("WEEK", "d").cast("date").alias("week"), F.col("d").cast("string").alias("d"), "n"), ["route_id", "week"], ["d"])


QUERIES = {
    "t15_published_snapshot": published,
    "t110_page_generations": lambda spark, d: publish.generations(week_pages(days(spark, d, None)), week_pages(days(spark, d, UNTIL)), ["route_id", "week"]),
}

DAYS = "days AS (SELECT route_id, provider_local_date AS d, sum(observation_count)::BIGINT AS n FROM route_spine GROUP BY ALL)"
BODY = "'[' || string_agg('{\"d\":\"' || d || '\",\"n\":' || n || '}', ',' ORDER BY d) || ']'"
ORACLE_SQL = {
    "t15_published_snapshot": S.query(S.FACT, S.ROUTE_SPINE, DAYS, f"whole AS (SELECT route_id, {BODY} AS p FROM days GROUP BY ALL), part AS (SELECT route_id, {BODY} AS p FROM days WHERE d < DATE '{UNTIL}' GROUP BY ALL)",
      select="SELECT 'historic/routes/' || w.route_id || '.json' AS rel_key, sha256(w.p) AS content_hash, octet_length(encode(w.p))::BIGINT AS byte_count, true AS intact, coalesce(w.p = o.p, false) AS reused FROM whole w LEFT JOIN part o USING (route_id)"),
    "t110_page_generations": S.query(S.FACT, S.ROUTE_SPINE, DAYS, f"""weeks AS (SELECT *, date_trunc('week', d)::DATE AS week FROM days), now AS (SELECT route_id, week, sha256({BODY}) AS h FROM weeks GROUP BY ALL), old AS (SELECT route_id, week, sha256({BODY}) AS h FROM weeks WHERE d < DATE '{UNTIL}' GROUP BY ALL)""",
      select="SELECT route_id, week, substr(n.h, 1, 16) AS generation_id, substr(o.h, 1, 16) AS previous_generation_id, CASE WHEN n.h IS NULL THEN 'gone' WHEN o.h IS NULL THEN 'new' WHEN n.h = o.h THEN 'kept' ELSE 'changed' END AS state FROM now n FULL JOIN old o USING (route_id, week)"),
}
