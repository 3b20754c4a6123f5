"""Shared pieces: a place for written tables, exact distributed ranks, word counts."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of our own where that is unset in a local session."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="punctua-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives lost executors, and gives the optimizer true sizes."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a file of a table whose rows are known to be few.
ROWS_A_FILE = 100_000


def counted(df: DataFrame, name: str, most: int | None = None) -> tuple[DataFrame, int]:
    """written(), and the rows, counted while they are written. most: a bound of the rows if there is one, so that few rows lie in few files."""
    seen = Observation()
    if most is not None:
        df = df.coalesce(max(1, -(-most // ROWS_A_FILE)))
    table = written(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return table, seen.get["n"]


def dropped(*frames: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in frames:
        jvm = df.sparkSession.sparkContext._jvm
        for f in df.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(f).getParent()
            folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def released(spark: SparkSession) -> None:
    """Asks the driver to collect its garbage: Spark frees shuffle files, broadcasts and plans of finished steps only then, and a job of many rounds should not keep them all."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: A written table is broadcast up to this number of rows; beyond it the same join shuffles.
BROADCAST_ROWS = 500_000


def hinted(df: DataFrame, n: int) -> DataFrame:
    """A table of n rows of ids or the like, with a broadcast hint if they are within the bound."""
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def small(df: DataFrame, name: str) -> DataFrame:
    """A table of ids or the like, written, with a broadcast hint if its counted rows are within the bound."""
    return hinted(*counted(df, name))


#: Bits of a bitmap for each key, and at most (32 MB).
BITS_A_KEY, MOST_BITS = 16, 1 << 28


def flagged(rows: DataFrame, key: Column, found: DataFrame, found_key: Column, n: int, name: str) -> DataFrame:
    """rows with a boolean `name`: false where no row of found (n rows) has the same key. Keys share a bit now and then.

    The bitmap is built in pieces of 4 KB, which are broadcast: 8192 pieces at most, at any size."""
    bits = 1 << 15
    while bits < min(n * BITS_A_KEY, MOST_BITS):
        bits *= 2
    low = F.lit((1 << 15) - 1)
    at = found_key.bitwiseAND(F.lit(bits - 1))
    pieces = found.groupBy(F.shiftright(at, 15).alias("__part")).agg(F.bitmap_construct_agg(at.bitwiseAND(low)).alias("__map"))
    spot = key.bitwiseAND(F.lit(bits - 1))
    rows = rows.withColumn("__part", F.shiftright(spot, 15)).join(F.broadcast(pieces), "__part", "left")
    byte = F.conv(F.hex(F.substring("__map", (F.shiftright(spot.bitwiseAND(low), 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    bit = F.coalesce(F.getbit(byte, spot.bitwiseAND(F.lit(7))), F.lit(0))
    return rows.withColumn(name, F.col("__part").isNotNull() & (bit == 1)).drop("__part", "__map")


def looked_up(rows: DataFrame, key: Column, found: DataFrame, found_key: Column, n: int, same: Column, how: str) -> DataFrame:
    """rows.join(found, same, how) for how = left or left_anti, where equal rows have equal keys (longs).

    Few rows of found (n) are broadcast. Of many, a bitmap tells which rows may have a partner, and only those are shuffled."""
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(found), same, how)
    marked = flagged(rows, key, found, found_key, n, "__maybe")
    some = marked.where("__maybe").drop("__maybe").join(found, same, how)
    return some.unionByName(marked.where("NOT __maybe").drop("__maybe"), allowMissingColumns=True)


#: A key is hot if more than one in HOT of all rows have it, so there are fewer than HOT hot keys.
HOT = 10_000


def joined(rows: DataFrame, table: DataFrame, key: str | Sequence[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """rows.join(table, key, how) for how = inner or left, where table has each key once and says in `count` how many of the `total` rows have it.

    Hot keys of the table are fewer than HOT rows and broadcast; only rows of other keys are shuffled by key. rows is read twice."""
    hot = F.col(count) * HOT > total
    few, rest = F.broadcast(table.where(hot).drop(count)), table.where(~hot).drop(count)
    return rows.join(few, key).unionByName(rows.join(few, key, "left_anti").join(rest, key, how))


def never_null(c: Column) -> Column:
    """A string key that tells null from every value."""
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), c.cast("string")))


def unit(digest: Column) -> Column:
    """The first 32 bits of a hexadecimal digest as a double in [0, 1)."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def ranked(df: DataFrame, group: Sequence[str], bucket: str, order: Sequence[Column], name: str, chunk: int) -> DataFrame:
    """df with the exact rank (from 0) of each row within its group, in the order of bucket, then order.

    bucket (a long, never null) must ascend with the order and hold few rows. Only rows of one bucket meet in a task: the rest
    of a rank is a prefix sum over bucket counts, taken within chunks of buckets and then over chunks, so no group is ever gathered.
    """
    keys, part = list(group), f"__{name}_chunk"
    counts = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("__n")).withColumn(part, F.expr(f"{bucket} div {int(chunk)}"))
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = counts.withColumn("__in", before(Window.partitionBy(*keys, part).orderBy(bucket), "__n"))
    tops = counts.groupBy(*keys, part).agg(F.sum("__n").alias("__n"))
    tops = tops.select(*keys, part, before(Window.partitionBy(*keys).orderBy(part), "__n").alias("__top"))
    starts = inner.join(tops, [*keys, part]).select(*keys, bucket, (F.col("__in") + F.col("__top")).alias("__start"))
    own = F.row_number().over(Window.partitionBy(*keys, bucket).orderBy(*order))
    return df.join(starts, [*keys, bucket]).withColumn(name, F.col("__start") + own - 1).drop("__start")
