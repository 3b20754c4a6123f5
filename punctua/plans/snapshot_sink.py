"""Publication of snapshots: payloads under the hash of their content, a manifest for each generation, and a pointer that moves last."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Payloads of one folder: its name is the first byte of the hash.
SHARD = 2
MANIFEST = "rel_key string, content_hash string, byte_count long"


class Conflict(RuntimeError):
    """Another publication moved the pointer meanwhile."""


def hadoop(spark: SparkSession, path: str):
    """The path, and the file context that can rename over an existing file."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = jvm.Path(path)
    at = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at)
    return at, jvm.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration())


def pointer(spark: SparkSession, root: str) -> dict | None:
    """What root/current.json says; None before the first publication."""
    at, context = hadoop(spark, f"{root}/current.json")
    if not context.util().exists(at):
        return None
    stream = context.open(at)
    try:
        return json.loads(bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def move_pointer(spark: SparkSession, root: str, said: dict, before: dict | None) -> None:
    """Puts the pointer's file beside the old one and renames it over that, if the pointer still says what it said before."""
    at, context = hadoop(spark, f"{root}/current.json")
    fresh, _ = hadoop(spark, f"{root}/current-{uuid.uuid4().hex}.json")
    jvm = spark.sparkContext._jvm
    flags = jvm.java.util.EnumSet.of(jvm.org.apache.hadoop.fs.CreateFlag.CREATE)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.CreateOpts, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.CreateOpts.createParent()
    stream = context.create(fresh, flags, options)
    try:
        stream.write(bytearray(json.dumps(said, sort_keys=True).encode()))
    finally:
        stream.close()
    if pointer(spark, root) != before:
        context.delete(fresh, False)
        raise Conflict(f"{root}: the pointer has moved from {before}")
    rename = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    rename[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fresh, at, rename)


def manifest(spark: SparkSession, root: str, generation: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifests/{generation}")


def generation_of(entries: DataFrame) -> str:
    """A name that depends on keys and contents alone, whatever the order of the rows."""
    pair = F.struct("rel_key", "content_hash")
    said = entries.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(pair)).alias("a"), F.bit_xor(F.xxhash64(F.lit("generation"), pair)).alias("b"))
    row = said.select(F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c), F.lit(0)).cast("string") for c in "nab")), 256).alias("g")).first()
    return row["g"]


def publish(payloads: DataFrame, root: str, published_utc: str) -> dict:
    """Publishes rel_key (unique), payload as the snapshot of root; gives generation, files, written (payloads that were new) and unchanged.

    Payloads whose content the root holds are not written again. Executors write the others, each under the hash of its content in a path that never changes; then comes the
    manifest, and at last the pointer. A file is the payload and a line's end. Until the pointer has moved readers see the old snapshot whole, and a run that failed leaves files that the next one overwrites
    with equal ones. The same contents give the same generation, whose publication changes nothing.
    """
    spark, before = payloads.sparkSession, pointer(payloads.sparkSession, root)
    rows = payloads.select("rel_key", "payload", F.sha2(F.col("payload").cast("binary"), 256).alias("content_hash"), F.octet_length("payload").cast("long").alias("byte_count"))
    entries = rows.select("rel_key", "content_hash", "byte_count")
    if entries.groupBy("rel_key").count().where("count > 1").isEmpty() is False:
        raise ValueError("a key has several payloads")
    generation = generation_of(entries)
    if before and before["generation"] == generation:
        return before | {"written": 0, "unchanged": True}
    fresh = rows
    if before:
        fresh = rows.join(manifest(spark, root, before["generation"]).select("content_hash").distinct(), "content_hash", "left_anti")
    fresh = fresh.dropDuplicates(["content_hash"])
    written = fresh.count()
    if written:
        files = fresh.select(F.col("payload").alias("value"), F.substring("content_hash", 1, SHARD).alias("shard"), "content_hash")
        files.repartition("content_hash").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard", "content_hash").text(f"{root}/objects")
    entries.sort("rel_key").write.mode("overwrite").parquet(f"{root}/manifests/{generation}")
    said = {"generation": generation, "files": entries.count(), "published_utc": published_utc, "previous": before and before["generation"]}
    move_pointer(spark, root, said, before)
    return said | {"written": written, "unchanged": False}


def read(spark: SparkSession, root: str, generation: str | None = None) -> DataFrame:
    """rel_key, payload, content_hash, byte_count of the current generation, or of an older one that is still kept."""
    if generation is None:
        found = pointer(spark, root)
        if found is None:
            return spark.createDataFrame([], f"{MANIFEST}, payload string")
        generation = found["generation"]
    objects = spark.read.schema("value string, shard string, content_hash string").text(f"{root}/objects", wholetext=True)
    rows = manifest(spark, root, generation).withColumn("shard", F.substring("content_hash", 1, SHARD))
    return rows.join(objects, ["shard", "content_hash"]).select("rel_key", "content_hash", "byte_count", F.expr("left(value, length(value) - 1)").alias("payload"))


def collected(spark: SparkSession, root: str, kept: list[str]) -> int:
    """Removes payloads and manifests that none of the kept generations and not the current one name; gives the number of payloads. Not while a publication is at work."""
    kept = sorted({*kept, pointer(spark, root)["generation"]})
    named = manifest(spark, root, kept[0]).select("content_hash")
    for g in kept[1:]:
        named = named.union(manifest(spark, root, g).select("content_hash"))
    objects = spark.read.schema("value string, shard string, content_hash string").text(f"{root}/objects").select("shard", "content_hash").distinct()
    stale, n = objects.join(named, "content_hash", "left_anti"), 0
    for row in stale.toLocalIterator():
        at, context = hadoop(spark, f"{root}/objects/shard={row['shard']}/content_hash={row['content_hash']}")
        context.delete(at, True)
        n += 1
    folder, context = hadoop(spark, f"{root}/manifests")
    for status in context.util().listStatus(folder):
        if status.getPath().getName() not in kept:
            context.delete(status.getPath(), True)
    return n
