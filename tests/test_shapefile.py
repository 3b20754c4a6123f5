"""Shapefiles: parts, well-known binary as packed by hand, projections."""

import struct
import zipfile

import pytest

from punctua.sources import shapefile

MTM = 'PROJCS["NAD_1983_MTM_8",GEOGCS["GCS_North_American_1983",DATUM["D_North_American_1983"]],PARAMETER["False_Easting",304800.0],PARAMETER["False_Northing",0.0],PARAMETER["Central_Meridian",-73.5],PARAMETER["Scale_Factor",0.9999],PARAMETER["Latitude_Of_Origin",0.0]]'


def line(kind, *parts):
    points = [p for part in parts for p in part]
    starts, at = [], 0
    for part in parts:
        starts.append(at)
        at += len(part)
    body = struct.pack("<i4d2i", kind, 0, 0, 0, 0, len(parts), len(points)) + struct.pack(f"<{len(parts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
    if kind == 13:  # heights follow
        body += struct.pack(f"<2d{len(points)}d", 0, 9, *[5.0] * len(points))
    return struct.pack(">ii", 1, len(body) // 2) + body


def table(*ids):
    rows = b"".join(b" " + i.encode().ljust(4) for i in ids)
    dbf = bytearray(32) + b"shape_id\0\0\0" + b"C" + b"\0" * 4 + bytes([4]) + b"\0" * 15 + b"\r"
    dbf[4:12] = struct.pack("<IHH", len(ids), len(dbf), 5)
    return bytes(dbf) + rows


def test_binary(spark, tmp_path):
    a, b = [(1.0, 2.0), (3.0, 4.5)], [(5.0, 6.0), (7.0, 8.0), (9.0, -1.0)]
    shp = b"\0" * 100 + line(3, a) + line(3, a, b) + line(3, a, [(0.0, 0.0)]) + line(13, b) + line(3, [(0.0, 0.0)]) + line(5, b) + struct.pack(">ii", 1, 10) + struct.pack("<i2d", 1, -73.5, 45.5) + struct.pack(">ii", 1, 2) + struct.pack("<i", 0)
    with zipfile.ZipFile(tmp_path / "s.zip", "w") as z:
        z.writestr("x/lines.shp", shp)
        z.writestr("x/lines.DBF", table("A", "B", "A", "C", "D", "E", "F", "G"))
        z.writestr("x/lines.prj", MTM)
        z.writestr("other.shp", b"\0" * 100 + line(3, a))
        z.writestr("other.dbf", table("Z"))
        z.writestr("lone.shp", b"\0" * 100)
    rows = {(r["layer"], r["feature_id"]): r for r in shapefile.read_features(spark, str(tmp_path / "s.zip")).collect()}
    got = {i: (r["geometry_type"], r["wkb"] and bytes(r["wkb"]), r["epsg"]) for (layer, i), r in rows.items() if layer == "x/lines"}
    one = bytes.fromhex("0102000000" + "02000000" + "000000000000f03f" + "0000000000000040" + "0000000000000840" + "0000000000001240")
    two = b"\x01\x02\x00\x00\x00\x03\x00\x00\x00" + struct.pack("<6d", 5, 6, 7, 8, 9, -1)
    assert got["A"] == ("LineString", one, 32188) and got["A:2"] == ("LineString", one, 32188)
    assert got["B"] == ("MultiLineString", b"\x01\x05\x00\x00\x00\x02\x00\x00\x00" + one + two, 32188)
    assert got["C"] == ("LineString", two, 32188) and got["D"] == got["E"] == got["G"] == (None, None, 32188)
    assert got["F"] == ("Point", b"\x01\x01\x00\x00\x00" + struct.pack("<2d", -73.5, 45.5), 32188)
    assert len(rows["x/lines", "B"]["points"]) == 5 and rows["x/lines", "G"]["points"] == []
    assert rows["other", "Z"]["epsg"] is None and {layer for layer, _ in rows} == {"x/lines", "other"}


@pytest.mark.parametrize("prj, code", [
    (MTM, 32188), (MTM.replace("-73.5", "-76.5"), None), (MTM.replace("D_North_American_1983", "D_Other").replace("GCS_North_American_1983", "G"), None), ("", None), ('GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984"]]', 4326),
    ('PROJCS["x",GEOGCS["y",SPHEROID["s",1,2,AUTHORITY["EPSG","7019"]],AUTHORITY["EPSG","4269"]],AUTHORITY["EPSG","32618"]]', 32618), ("EPSG:3857", 3857), ('PROJCS["odd"]', None)])
def test_projections(prj, code):
    assert shapefile.epsg(prj) == code
