"""Gazetteers: packed world files and GeoJSON features as city tables."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Degrees of one coordinate step, and kinds of labels by number.
STEP, KINDS = 1e-5, ("country", "state", "city", "ocean")
SCHEMA = "kind string, name string, country string, lat double, lon double, population long, min_zoom double, capital boolean"
LEAST_PEOPLE = 5000


class _Bytes:
    """A cursor over little-endian numbers of variable length."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        if len(out) < n:
            raise ValueError("the file ends early")
        self.at += n
        return out

    def number(self) -> int:
        out = shift = 0
        while True:
            b = self.take(1)[0]
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    def signed(self) -> int:
        n = self.number()
        return n >> 1 if n % 2 == 0 else -(n + 1 >> 1)

    def text(self) -> str:
        return self.take(self.number()).decode("utf-8")


def labels(data: bytes) -> list[tuple]:
    """Rows of SCHEMA from a packed world file; sections of other kinds are passed over."""
    r = _Bytes(data)
    if r.take(4) != b"KGEO" or struct.unpack("<H", r.take(2))[0] != 1:
        raise ValueError("not a world file of version 1")
    countries, found = {}, []
    for _ in range(struct.unpack("<H", r.take(2))[0]):
        tag = r.take(4)
        s = _Bytes(r.take(struct.unpack("<I", r.take(4))[0]))
        if tag == b"CTRY":
            for n in range(s.number()):
                s.take(2)  # ISO code
                countries[n + 1] = s.text()
        elif tag == b"LABL":
            for _ in range(s.number()):
                kind, flags = s.take(2)
                lon, lat, zoom = s.signed() * STEP, s.signed() * STEP, s.take(1)[0] / 16
                people, country = s.number(), s.number()
                found.append((KINDS[kind], s.text(), country, lat, lon, people, zoom, flags % 2 == 1))
    return [(*f[:2], countries.get(f[2]), *f[3:]) for f in found]


def world(files: DataFrame) -> DataFrame:
    """All labels of world files (path, content), one task a file; a damaged file has none."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for frame in frames:
            for content in frame["content"]:
                try:
                    yield pd.DataFrame(labels(bytes(content)), columns=names)
                except (ValueError, IndexError, struct.error):
                    continue

    return files.select("content").mapInPandas(work, SCHEMA)


def cities(spark: SparkSession, path: str) -> DataFrame:
    """name, country, lat, lon, population of GeoJSON point features with 5000 people or more.

    City districts ("Lyon 03") and names with brackets are no towns of their own.
    """
    form = "features array<struct<geometry: struct<coordinates: array<double>>, properties: struct<name: string, country: string, population: bigint>>>"
    rows = spark.read.schema(form).json(path, multiLine=True).select(F.explode("features").alias("f"))
    at, p = F.col("f.geometry.coordinates"), F.col("f.properties")
    rows = rows.select(p["name"].alias("name"), p["country"].alias("country"), at[1].alias("lat"), at[0].alias("lon"), p["population"].alias("population"))
    return rows.filter((F.col("population") >= LEAST_PEOPLE) & ~F.col("name").rlike(r"^\S+ \d{1,2}(\s|$)") & ~F.contains("name", F.lit("(")))
