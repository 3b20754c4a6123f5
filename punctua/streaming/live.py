"""The live path as Structured Streaming: five-minute windows with a watermark, closed days to the incremental build."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from punctua.constants import UNROUTED
from punctua.functions import kernel as K

LATE = "15 minutes"


def read_facts(spark: SparkSession, path: str, files_a_batch: int = 16) -> DataFrame:
    """New files of a fact folder as a stream; the schema is that of the files there are."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def unique_facts(facts: DataFrame, late: str = LATE) -> DataFrame:
    """Each (provider, snapshot, entity) once; state is kept for the watermark's span. Later rows go to the rebuild of their day."""
    timed = facts.withColumn("captured", F.col("captured_at_utc").cast("timestamp")).withWatermark("captured", late)
    return timed.dropDuplicatesWithinWatermark(["provider_id", "realtime_snapshot_id", "entity_index"])


def summary_5m(facts: DataFrame) -> DataFrame:
    """Route x five minutes, final once the watermark has passed. Distinct trips are counted exactly from the window's trip set."""
    d = F.col("delay_seconds")
    capped = F.when(K.in_clamp(d), d)
    window = F.window("captured", "5 minutes")
    return facts.groupBy("provider_id", window.alias("w"), F.coalesce("route_id", F.lit(UNROUTED)).alias("route_id")).agg(
        F.size(F.collect_set("trip_id")).cast("long").alias("trip_count"), F.count(F.lit(1)).alias("observation_count"), F.count(d).alias("delay_observation_count"), K.count_if(K.on_time(d)).alias("on_time_observation_count"),
        F.sum(capped).alias("sum_delay_seconds"), K.count_if(~K.in_clamp(d)).alias("outlier_count"), K.count_if(K.severe(d)).alias("severe_delay_observation_count"), F.size(F.collect_set(F.when(d > 0, F.col("trip_id")))).cast("long").alias("delayed_trip_count"),
    ).select("provider_id", F.col("w.start").alias("period_start_utc"), "route_id", *("trip_count", "observation_count", "delay_observation_count", "on_time_observation_count", "sum_delay_seconds", "outlier_count", "severe_delay_observation_count", "delayed_trip_count"))


def run_summary(spark: SparkSession, source: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Appends final windows to a Parquet folder until the source is read, with exactly-once files."""
    rows = summary_5m(unique_facts(read_facts(spark, source)))
    return rows.writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_batches(spark: SparkSession, source: str, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Each micro-batch of unique facts to a function, such as an append to the day's partition followed by the build of closed days."""
    return unique_facts(read_facts(spark, source)).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
