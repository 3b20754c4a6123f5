"""Writes that become visible at once: rows lie in the folder of their build, and a ledger names the build that counts for each period."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ledger_of(spark: SparkSession, ledger: str, schema: str) -> DataFrame:
    """The ledger's rows; none where it does not exist yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(schema).parquet(ledger) if there else spark.createDataFrame([], schema)


def newest(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Each key's entry of the last build."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("committed_at", "build")).alias("e")).select(*key, "e.*")


def committed(rows: DataFrame, path: str, entries: DataFrame, ledger: str, by: Sequence[str] = ()) -> str:
    """Writes rows under a new build, then appends the ledger's entries in one file. Before that append none of the rows count, after it all do.

    A run that fails in between leaves a folder that nothing names; the next run builds the same periods again. by: columns whose folders lie above the build's."""
    build = uuid.uuid4().hex
    rows.withColumn("build", F.lit(build)).write.mode("append").partitionBy(*by, "build").parquet(path)
    said = entries.withColumns({"build": F.lit(build), "committed_at": F.current_timestamp()})
    said.coalesce(1).write.mode("append").parquet(ledger)
    return build


def visible(spark: SparkSession, path: str, entries: DataFrame, key: Sequence[str]) -> DataFrame:
    """The rows whose build the newest entry of their key names. Builds are partitions, so those that do not count are not read."""
    counted = newest(entries, key).select(*key, "build")
    return spark.read.parquet(path).join(F.broadcast(counted), [*key, "build"], "left_semi").drop("build")


def dropped_builds(spark: SparkSession, path: str, entries: DataFrame, key: Sequence[str], by: Sequence[str] = ()) -> int:
    """Removes the folders of builds that no newest entry names; gives their number. by: as in committed(), columns of the entries. Not while a writer is at work."""
    folder = F.concat_ws("/", *(F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in (*by, "build")))
    kept = {r["f"] for r in newest(entries, key).select(folder.alias("f")).distinct().toLocalIterator()}
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    open_, gone = [(root, "")], 0
    while open_:
        at, above = open_.pop()
        for status in system.listStatus(at):
            name = status.getPath().getName()
            if name.startswith("build="):
                if above + name not in kept:
                    system.delete(status.getPath(), True)
                    gone += 1
            elif status.isDirectory() and "=" in name:
                open_.append((status.getPath(), f"{above}{name}/"))
    return gone
