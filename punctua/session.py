"""A session with the settings the library relies on."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", **more: str) -> SparkSession:
    """UTC session time, adaptive execution with skew joins, no time zone of the host."""
    builder = SparkSession.builder.master(master).appName("punctua")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.ui.enabled": "false",
    }
    for key, value in (settings | more).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


SHIPPED: set[str] = set()


def shipped(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once in an application, so that Python tasks find it wherever they run."""
    application = spark.sparkContext.applicationId
    if application not in SHIPPED:
        SHIPPED.add(application)
        package = Path(__file__).resolve().parent
        target = Path(os.path.realpath(tempfile.mkdtemp(prefix="punctua-"))) / "punctua.zip"
        with zipfile.ZipFile(target, "w") as z:
            for source in sorted(package.rglob("*.py")):
                z.write(source, source.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(target))
    return spark


def freed() -> None:
    """Gives memory that a Python worker has freed back to the system: a worker lives on for the next stages, and the allocators keep what the largest batch took."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not the GNU library
        pass


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run for mapInArrow or mapInPandas, with freed() at the end of each partition."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            freed()

    return whole


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of our own where that is unset in a local session."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if context.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="punctua-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: later steps read it anew instead of computing it again, also after an executor is lost."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
