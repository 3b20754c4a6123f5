"""Timetable archives: members by name, header contract, typed rows."""

from __future__ import annotations

import csv
import io
import uuid
import zipfile
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import batched

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from punctua.session import shared_dir, shipped

#: Members that an archive must hold, one of two that it must hold, and the columns each member must have.
REQUIRED = ("routes", "trips", "stops", "stop_times")
EITHER = ("calendar", "calendar_dates")
COLUMNS = {
    "routes": ("route_id", "route_type"),
    "trips": ("route_id", "service_id", "trip_id"),
    "stops": ("stop_id", "stop_name"),
    "stop_times": ("trip_id", "stop_id", "stop_sequence"),
    "calendar": ("service_id", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "start_date", "end_date"),
    "calendar_dates": ("service_id", "date", "exception_type"),
    "agency": ("agency_name",),
    "shapes": ("shape_id", "shape_pt_lat", "shape_pt_lon", "shape_pt_sequence"),
    "directions": ("route_id", "direction_id"),
    "translations": ("table_name", "language", "translation"),
}
INTS = {"route_type", "direction_id", "stop_sequence", "location_type", "shape_pt_sequence", "exception_type", "pickup_type", "drop_off_type"}
DOUBLES = {"stop_lat", "stop_lon", "shape_pt_lat", "shape_pt_lon"}
DATES = {"start_date", "end_date", "date"}
FLAGS = {"monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"}


@dataclass
class Edition:
    """The typed members of an archive, members that no schema knows as JSON rows, and what was skipped."""

    members: dict[str, DataFrame] = field(default_factory=dict)
    unknown: dict[str, DataFrame] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)


#: Records of a member that leave a task at once.
RECORDS = 20_000


def records(archive: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """(member, number, fields) of each record: members by lower-cased base name without its ending, the header as number 0. Members are streamed; quoted fields may hold line breaks, blank lines are no records."""
    csv.field_size_limit(2**31 - 1)
    with zipfile.ZipFile(io.BytesIO(archive)) as z:
        for info in z.infolist():
            base = info.filename.rsplit("/", 1)[-1].lower()
            if base.endswith(".txt"):
                name = base.removesuffix(".txt")
                with z.open(info) as member:
                    rows = csv.reader(io.TextIOWrapper(member, "utf-8-sig", newline=""))
                    yield name, 0, [c.strip() for c in next(rows, [])]
                    yield from ((name, n, row) for n, row in enumerate(filter(None, rows), 1))


def unpacked(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives under a path as a table in the shared folder, a partition for each member. Unpacked by a task for each archive, so the driver sees no text."""
    shipped(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                for some in batched(records(bytes(content)), RECORDS):
                    yield pd.DataFrame(some, columns=["member", "n", "fields"])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "member string, n long, fields array<string>")
    target = f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    rows.write.option("maxRecordsPerFile", 2_000_000).partitionBy("member").parquet(target)
    return spark.read.schema(rows.schema).parquet(target)


def typed(name: str, raw: DataFrame, provider_id: str) -> DataFrame:
    """Columns in their types: blanks are NULL, dates YYYYMMDD, flags 0 or 1; service times stay text."""

    def cast(c: str) -> Column:
        value = F.nullif(F.trim(F.col(c)), F.lit(""))
        if c in INTS:
            return value.try_cast("int").alias(c)
        if c in DOUBLES:
            return value.try_cast("double").alias(c)
        if c in DATES:
            return F.to_date(F.try_to_timestamp(value, F.lit("yyyyMMdd"))).alias(c)
        if c in FLAGS:
            return F.when(value.isin("0", "1"), value == "1").alias(c)
        return value.alias(c)

    rows = raw.select(F.lit(provider_id).alias("provider_id"), *(cast(c) for c in raw.columns))
    if name == "calendar_dates":
        rows = rows.withColumnRenamed("date", "service_date")
    if name in ("agency", "routes"):
        rows = rows.withColumn("agency_id", F.coalesce("agency_id", F.lit(provider_id)) if "agency_id" in rows.columns else F.lit(provider_id))
    return rows


def read_archive(spark: SparkSession, path: str, provider_id: str, strict: bool = True) -> Edition:
    """The edition in a zip that Spark's readers can open. The driver sees the members' headers alone.

    strict: missing columns of any member fail; otherwise only those of required members do, others are skipped with a warning, and an archive without calendars passes.
    A name twice in the archive is an error. A record's missing fields are NULL, those beyond the header go; of two columns of one name the first counts."""
    table = unpacked(spark, path)
    found = table.where("n = 0").select("member", "fields").collect()
    twice = [m for m, n in Counter(r["member"] for r in found).items() if n > 1]
    if twice:
        raise ValueError(f"two members are named {twice[0]}.txt")
    headers = {r["member"]: r["fields"] for r in found}
    missing = [m for m in REQUIRED if m not in headers]
    if missing or strict and not any(m in headers for m in EITHER):
        raise ValueError(f"the archive lacks {missing or ' or '.join(EITHER)}")
    edition = Edition()
    for name, header in headers.items():
        columns = (F.nullif(F.get("fields", F.lit(header.index(c))), F.lit("")).alias(c) for c in dict.fromkeys(header) if c)
        raw = table.where((F.col("member") == name) & (F.col("n") > 0)).select(*columns)
        if name not in COLUMNS:
            edition.unknown[name] = raw.select(F.lit(provider_id).alias("provider_id"), F.lit(f"{name}.txt").alias("member"), F.to_json(F.struct("*")).alias("row"))
            continue
        lacks = [c for c in COLUMNS[name] if c not in header]
        if lacks and (strict or name in REQUIRED):
            raise ValueError(f"{name}.txt lacks {', '.join(lacks)}")
        if lacks:
            edition.warnings.append(f"{name}.txt lacks {', '.join(lacks)}: skipped")
            continue
        edition.members[name] = typed(name, raw, provider_id)
    return edition
