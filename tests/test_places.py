"""Packed world files and GeoJSON gazetteers."""

import json
import os
import struct

import pytest

from shutterlake.sources import places, world


def number(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def signed(n):
    return number(2 * n if n >= 0 else -2 * n - 1)


def section(tag, body):
    return tag + struct.pack("<I", len(body)) + body


def packed():
    def label(kind, lat, lon, people, country, name):
        raw = name.encode()
        return bytes([kind, kind == 2]) + signed(round(lon / places.STEP)) + signed(round(lat / places.STEP)) + bytes([40]) + number(people) + number(country) + number(len(raw)) + raw

    towns = [label(2, 48.8566, 2.3522, 2148000, 1, "Paris"), label(2, -34.6037, -58.3816, 3075646, 2, "Buenos Aires"), label(3, 0.0, -140.0, 0, 0, "Pacífico")]
    names = b"".join(iso + number(len(n)) + n for iso, n in ((b"FR", b"France"), (b"AR", b"Argentina")))
    parts = [section(b"XXXX", b"later"), section(b"LABL", number(3) + b"".join(towns)), section(b"CTRY", number(2) + names)]
    return b"KGEO" + struct.pack("<HH", 1, len(parts)) + b"".join(parts)


def test_world_files(spark):
    whole = packed()
    df = spark.createDataFrame([("a", bytearray(whole)), ("b", bytearray(whole[:40])), ("c", bytearray(b"garbage"))], "path string, content binary")
    got = {r["name"]: r for r in places.world(df).collect()}
    assert set(got) == {"Paris", "Buenos Aires", "Pacífico"}
    assert got["Paris"]["country"] == "France" and got["Paris"]["capital"] and abs(got["Buenos Aires"]["lon"] + 58.3816) < 1e-4
    assert got["Pacífico"]["country"] is None and got["Pacífico"]["kind"] == "ocean" and got["Paris"]["min_zoom"] == 2.5


def test_written_world_is_read_back(spark, tmp_path):
    form = places.SCHEMA + ", iso string"
    rows = [("city", f"Town {n} é", None if n % 7 == 0 else f"Land{n % 3}", n * 0.37 - 60, 100 - n * 1.87, n * 9973, n % 40 / 16, n % 5 == 0, ["FR", "AR", None][n % 3]) for n in range(150)]
    odd = [("city", None, "X", 1.0, 1.0, 1, 1.0, False, "XX"), ("moon", "Sea", None, 1.0, 1.0, 1, 1.0, False, None), ("city", "Nowhere", None, None, 1.0, 1, 1.0, False, None), ("city", "NaN", None, float("nan"), 1.0, 1, 1.0, False, None)]
    bare = [("ocean", "", None, -90.0, 180.0, None, None, None, None), ("state", "Far", "Land1", 0.0, -180.0, -5, 99.0, True, "toolong")]
    path = str(tmp_path / "w.kgeo")
    world.write_world(spark.createDataFrame(rows + odd + bare, form).repartition(3), path, 200)
    assert os.listdir(tmp_path) == ["w.kgeo"]  # no part is left
    want = {r[1]: (r[0], r[2], round(r[3], 5), round(r[4], 5), r[5], r[6], r[7]) for r in rows}
    want |= {"": ("ocean", None, -90.0, 180.0, 0, 0.0, False), "Far": ("state", "Land1", 0.0, -180.0, 0, 255 / 16, True)}
    for got in (world.read_world(spark, path), places.world(spark.read.format("binaryFile").load(path).select("path", "content"))):
        assert {r["name"]: (r["kind"], r["country"], round(r["lat"], 5), round(r["lon"], 5), r["population"], r["min_zoom"], r["capital"]) for r in got.collect()} == want
    assert world.read_world(spark, path).rdd.getNumPartitions() > 10  # a section is a task
    world.write_world(spark.createDataFrame([], form), str(tmp_path / "none.kgeo"))
    assert world.read_world(spark, str(tmp_path / "none.kgeo")).count() == 0
    whole = (tmp_path / "w.kgeo").read_bytes()
    (tmp_path / "cut.kgeo").write_bytes(whole[:-3])
    with pytest.raises(Exception, match="ends early"):
        world.read_world(spark, str(tmp_path / "cut.kgeo")).collect()
    many = spark.range(1001).selectExpr("'city' kind", "'a' name", "string(id) country", "0d lat", "0d lon", "1L population", "1d min_zoom", "false capital")
    with pytest.raises(ValueError, match="countries"):
        world.write_world(many, str(tmp_path / "many.kgeo"))


def test_geojson(spark, tmp_path):
    def feature(name, people):
        return {"type": "Feature", "geometry": {"type": "Point", "coordinates": [4.8, 45.7]}, "properties": {"name": name, "country": "France", "population": people}}

    (tmp_path / "c.json").write_text(json.dumps({"features": [feature("Lyon", 513000), feature("Lyon 03", 90000), feature("Hamlet", 40), feature("Bron (Est)", 9000)]}))
    assert [tuple(r) for r in places.cities(spark, str(tmp_path / "c.json")).collect()] == [("Lyon", "France", 45.7, 4.8, 513000)]
