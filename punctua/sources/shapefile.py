"""Shapefiles in a zip: points and lines with attributes, and their match with the timetable."""

from __future__ import annotations

import io
import math
import re
import struct
import zipfile
from collections.abc import Iterator
from itertools import batched

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctua.session import shipped

#: Features that leave a task at once.
FEATURES = 5_000


#: Record kinds of the public format, with and without heights or measures.
POINTS, LINES, AREAS = (1, 11, 21), (3, 13, 23), (5, 15, 25)
#: Geometry types of well-known binary.
POINT, LINE_STRING, MULTI_LINE = 1, 2, 5


def geometries(shp: bytes) -> Iterator[tuple[int, list[list[tuple[float, float]]]]]:
    """Kind and parts of each record: a point is one part of one point; an empty record has none. Heights and measures are left out."""
    at = 100
    while at < len(shp):
        size = struct.unpack_from(">i", shp, at + 4)[0] * 2
        body = shp[at + 8 : at + 8 + size]
        kind = struct.unpack_from("<i", body)[0]
        if kind in POINTS:
            yield kind, [[struct.unpack_from("<2d", body, 4)]]
        elif kind in LINES + AREAS:
            n_parts, n_points = struct.unpack_from("<2i", body, 36)
            starts = [*struct.unpack_from(f"<{n_parts}i", body, 44), n_points]
            points = list(struct.iter_unpack("<2d", body[44 + 4 * n_parts : 44 + 4 * n_parts + 16 * n_points]))
            yield kind, [points[a:b] for a, b in zip(starts, starts[1:], strict=False)]
        else:
            yield kind, []
        at += 8 + size


def line_binary(part: list[tuple[float, float]]) -> bytes:
    return struct.pack(f"<BII{2 * len(part)}d", 1, LINE_STRING, len(part), *(c for point in part for c in point))


def binary(kind: int, parts: list[list[tuple[float, float]]]) -> tuple[str | None, bytes | None]:
    """Type and well-known binary (little-endian) of a point or line; parts of a line with fewer than two points go, and of one part the line is single. Areas have none."""
    if kind in POINTS and parts:
        return "Point", struct.pack("<BI2d", 1, POINT, *parts[0][0])
    lines = [part for part in parts if len(part) > 1] if kind in LINES else []
    if not lines:
        return None, None
    if len(lines) == 1:
        return "LineString", line_binary(lines[0])
    return "MultiLineString", struct.pack("<BII", 1, MULTI_LINE, len(lines)) + b"".join(map(line_binary, lines))


def attributes(dbf: bytes) -> list[dict[str, str]]:
    """The text of each record's fields by lower-cased name."""
    count, header, width = struct.unpack("<IHH", dbf[4:12])
    columns = [(dbf[i : i + 11].split(b"\0")[0].decode().lower(), dbf[i + 16]) for i in range(32, header - 1, 32)]
    rows = []
    for k in range(count):
        at, row = header + k * width + 1, {}
        for name, size in columns:
            row[name] = dbf[at : at + size].decode("utf-8", "replace").strip()
            at += size
        rows.append(row)
    return rows


#: Projections that are told by name and parameters where the text names no code.
KNOWN = {
    32188: ("nad1983mtm8", {"false_easting": 304800.0, "false_northing": 0.0, "central_meridian": -73.5, "scale_factor": 0.9999, "latitude_of_origin": 0.0}),
}
AUTHORITY, CODE = re.compile(r'AUTHORITY\["EPSG"\s*,\s*"?(\d+)"?\]', re.I), re.compile(r'EPSG["\]:, ]+(\d+)', re.I)
PARAMETER, NAME = re.compile(r'PARAMETER\["([^"]+)"\s*,\s*(-?\d+(?:\.\d+)?)\]', re.I), re.compile(r'(?:PROJCS|GEOGCS)\["([^"]+)"', re.I)


def epsg(prj: str) -> int | None:
    """The code of a projection text: that of its outermost authority, another mention of a code, or the known projection of its name and parameters; None if nothing tells it."""
    named = AUTHORITY.findall(prj) or CODE.findall(prj)
    if named:
        return int(named[-1])
    if "GCS_WGS_1984" in prj and "PROJCS" not in prj:
        return 4326
    name = "".join(c for c in (NAME.search(prj) or [None, ""])[1].lower() if c.isalnum())
    given = {k.lower(): float(v) for k, v in PARAMETER.findall(prj)}
    for code, (known, wanted) in KNOWN.items():
        if name == known and "North_American" in prj and "1983" in prj and all(abs(given.get(k, math.inf) - v) <= 1e-6 for k, v in wanted.items()):
            return code
    return None


def layers(names: list[str]) -> dict[str, dict[str, str]]:
    """The members of each layer of an archive by their ending; a layer without shapes or attributes is none."""
    found: dict[str, dict[str, str]] = {}
    for name in names:
        base, dot, end = name.rpartition(".")
        if dot and end.lower() in ("shp", "dbf", "prj"):
            found.setdefault(base, {})[end.lower()] = name
    return {base: ends for base, ends in found.items() if {"shp", "dbf"} <= set(ends)}


def features(content: bytes) -> Iterator[tuple]:
    """The features of a zip's layers: layer, id, attributes, points, projection, geometry type and binary."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for layer, ends in sorted(layers(archive.namelist()).items()):
            code, seen = epsg(archive.read(ends["prj"]).decode("utf-8", "replace") if "prj" in ends else ""), {}
            for i, ((kind, parts), row) in enumerate(zip(geometries(archive.read(ends["shp"])), attributes(archive.read(ends["dbf"])), strict=True)):
                key = row.get("stop_id") or row.get("shape_id") or row.get("route_id") or str(i)
                seen[key] = seen.get(key, 0) + 1
                yield layer, key if seen[key] == 1 else f"{key}:{seen[key]}", row, [{"lon": x, "lat": y} for part in parts for x, y in part], code, *binary(kind, parts)


COLUMNS = ("layer", "feature_id", "attributes", "points", "epsg", "geometry_type", "wkb")


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """layer, feature_id (a repeated id gets :n), attributes, points (lon, lat), epsg, geometry_type, wkb. A task for each archive parses it; the driver sees none of it."""
    shipped(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                for some in batched(features(bytes(content)), FEATURES):
                    yield pd.DataFrame(some, columns=COLUMNS).astype({"epsg": "Int32"})

    schema = "layer string, feature_id string, attributes map<string,string>, points array<struct<lon: double, lat: double>>, epsg int, geometry_type string, wkb binary"
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def matched_stops(features: DataFrame, stops: DataFrame) -> DataFrame:
    """Features with the stop of their stop_id, else of their stop_code; those without a match go."""
    by_id = stops.select(F.col("stop_id").alias("m_id"), F.col("stop_id").alias("by_id"))
    by_code = stops.where("stop_code IS NOT NULL").groupBy("stop_code").agg(F.min("stop_id").alias("by_code"))
    rows = features.withColumn("s", F.element_at("attributes", "stop_id")).withColumn("c", F.element_at("attributes", "stop_code"))
    rows = rows.join(by_id, rows["s"] == by_id["m_id"], "left").join(by_code, rows["c"] == by_code["stop_code"], "left")
    return rows.withColumn("stop_id", F.coalesce("by_id", "by_code")).where("stop_id IS NOT NULL").select("feature_id", "stop_id", F.when(F.col("by_id").isNotNull(), "stop_id").otherwise("stop_code").alias("matched_by"), "points")


def matched_lines(features: DataFrame, trips: DataFrame, routes: DataFrame) -> DataFrame:
    """Features with the timetable's shape of their shape_id, else the route of their route_id; those without a match go. Blank ids match nothing."""
    named = lambda c: F.nullif(F.trim(F.element_at("attributes", c)), F.lit(""))
    shapes = trips.where("shape_id IS NOT NULL").select(F.col("shape_id").alias("by_shape")).distinct()
    lines = routes.where("route_id IS NOT NULL").select(F.col("route_id").alias("by_route")).distinct()
    rows = features.withColumns({"s": named("shape_id"), "r": named("route_id")})
    rows = rows.join(shapes, rows["s"] == shapes["by_shape"], "left").join(lines, rows["r"] == lines["by_route"], "left")
    match_key = F.when(F.col("by_shape").isNotNull(), "shape_id").otherwise("route_id").alias("match_key")
    return rows.withColumn("gtfs_id", F.coalesce("by_shape", "by_route")).where("gtfs_id IS NOT NULL").select("feature_id", "gtfs_id", match_key, "points")
