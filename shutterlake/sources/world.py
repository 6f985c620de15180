"""Packed world files as a data source: labels written by tasks as sections, and read a section a task."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from shutterlake.sources.places import KINDS, SCHEMA, STEP, _Bytes

MAGIC = b"KGEO" + struct.pack("<H", 1)
MOST_COUNTRIES, MOST_SECTIONS = 1000, 65535
SECTION_BYTES = 16 << 20
COPY_BYTES = 8 << 20


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def zigzag(n: int) -> bytes:
    return varint(2 * n if n >= 0 else -2 * n - 1)


def section(tag: bytes, body: bytes) -> bytes:
    return tag + struct.pack("<I", len(body)) + body


def text(s: str) -> bytes:
    raw = s.encode("utf-8")
    return varint(len(raw)) + raw


def label(row: dict) -> bytes:
    """One label; ``_country`` is its country's number from 1, 0 for none."""
    zoom = min(255, max(0, round((row["min_zoom"] or 0) * 16)))
    head = bytes([KINDS.index(row["kind"]), bool(row["capital"])]) + zigzag(round(row["lon"] / STEP)) + zigzag(round(row["lat"] / STEP)) + bytes([zoom])
    return head + varint(max(0, row["population"] or 0)) + varint(row["_country"]) + text(row["name"])


def _opened(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)


@dataclass
class Part(WriterCommitMessage):
    number: int
    path: str
    sections: int


class _Writer(DataSourceArrowWriter):
    """Every task writes the sections of its labels to a part file; the commit strings the parts together."""

    def __init__(self, path: str, countries: bytes, section_bytes: int):
        self.path, self.countries, self.section_bytes, self.run = path, countries, section_bytes, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        store, path = _opened(self.path)
        part = Part(number, f"{path}.{self.run}-{number}-{uuid.uuid4().hex}", 0)
        with store.open_output_stream(part.path) as out:

            def flush() -> None:
                if labels:
                    out.write(section(b"LABL", varint(len(labels)) + b"".join(labels)))
                    part.sections += 1
                    labels.clear()

            labels: list[bytes] = []
            held = 0
            for batch in iterator:
                for row in batch.to_pylist():
                    labels.append(label(row))
                    held += len(labels[-1])
                    if held >= self.section_bytes:
                        flush()
                        held = 0
            flush()
        return part

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.number)
        sections = 1 + sum(p.sections for p in parts)
        if sections > MOST_SECTIONS:
            self.abort(messages)
            raise ValueError(f"a world file holds {MOST_SECTIONS} sections at most, not {sections}: write fewer, larger parts")
        store, path = _opened(self.path)
        whole = f"{path}.{self.run}"
        with store.open_output_stream(whole) as out:
            out.write(MAGIC + struct.pack("<H", sections) + self.countries)
            for p in parts:
                with store.open_input_stream(p.path) as f:
                    while piece := f.read(COPY_BYTES):
                        out.write(piece)
        store.move(whole, path)
        self.abort(messages)

    def abort(self, messages: list[Part | None]) -> None:
        """Delete the part files; those of tasks that died before they answered stay and are never read."""
        store, _ = _opened(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(m.path)


class Section(InputPartition):
    def __init__(self, at: int, size: int, countries: list[tuple[int, int]]):
        self.at, self.size, self.countries = at, size, countries


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Section]:
        """The driver reads the heads of the sections alone."""
        store, path = _opened(self.path)
        with store.open_input_file(path) as f:
            head = f.read_at(8, 0)
            if head[:6] != MAGIC or len(head) < 8:
                raise ValueError("not a world file of version 1")
            at, found = 8, []
            for _ in range(struct.unpack("<H", head[6:])[0]):
                tag = f.read_at(8, at)
                size = struct.unpack("<I", tag[4:])[0] if len(tag) == 8 else 0
                if len(tag) < 8 or at + 8 + size > f.size():
                    raise ValueError("the file ends early")
                found.append((tag[:4], at + 8, size))
                at += 8 + size
        countries = [(a, n) for tag, a, n in found if tag == b"CTRY"]
        return [Section(a, n, countries) for tag, a, n in found if tag == b"LABL"]

    def read(self, partition: Section | None) -> Iterator[tuple]:
        if partition is None:  # a file without labels
            return
        store, path = _opened(self.path)
        with store.open_input_file(path) as f:
            names: dict[int, str] = {}
            for at, size in partition.countries:
                s = _Bytes(f.read_at(size, at))
                for n in range(s.number()):
                    s.take(2)  # ISO code
                    names[n + 1] = s.text()
            s = _Bytes(f.read_at(partition.size, partition.at))
        for _ in range(s.number()):
            kind, flags = s.take(2)
            lon, lat, zoom = s.signed() * STEP, s.signed() * STEP, s.take(1)[0] / 16
            people, country = s.number(), s.number()
            yield KINDS[kind], s.text(), names.get(country), lat, lon, people, zoom, flags % 2 == 1


class WorldLabels(DataSource):
    """``format("world_labels")``. Options: path; for writing countries (hex of their section) and section_bytes."""

    @classmethod
    def name(cls) -> str:
        return "world_labels"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], bytes.fromhex(self.options["countries"]), int(self.options.get("section_bytes", SECTION_BYTES)))


def _countries(labels: DataFrame) -> list[tuple[str, str]]:
    """Names of countries in their order with an ISO code, "--" where ``iso`` is absent; more than MOST_COUNTRIES are refused."""
    iso = F.min("iso") if "iso" in labels.columns else F.lit(None).cast("string")
    rows = labels.filter("country is not null").groupBy("country").agg(iso.alias("code")).limit(MOST_COUNTRIES + 1).collect()
    if len(rows) > MOST_COUNTRIES:
        raise ValueError(f"more than {MOST_COUNTRIES} countries")
    return sorted((r["country"], r["code"] if r["code"] and len(r["code"]) == 2 and r["code"].isascii() else "--") for r in rows)


def write_world(labels: DataFrame, path: str, section_bytes: int = SECTION_BYTES) -> None:
    """Write labels (places.SCHEMA, and ``iso`` if there is one) to one packed world file.

    Coordinates are rounded to hundred-thousandths of a degree, zooms to
    sixteenths below 16. Labels without a known kind, a name or a position
    on the globe are not written; a null population is 0. Tasks encode sections in parallel;
    the file is one, so the commit copies their bytes one after another.
    """
    spark = labels.sparkSession
    spark.dataSource.register(WorldLabels)
    known = _countries(labels)
    body = varint(len(known)) + b"".join(code.encode("ascii") + text(name) for name, code in known)
    numbers: Iterable = [(name, n) for n, (name, _) in enumerate(known, 1)]
    table = spark.createDataFrame(list(numbers), "country string, _country int")
    finite = [F.abs(c) <= bound for c, bound in (("lat", 90.0), ("lon", 180.0))]  # false for NaN, null for null
    rows = labels.filter(F.col("kind").isin(*KINDS) & F.col("name").isNotNull() & finite[0] & finite[1])
    rows = rows.join(F.broadcast(table), "country", "left").withColumn("_country", F.coalesce("_country", F.lit(0)))  # MOST_COUNTRIES rows at most
    columns = ["kind", "name", "lat", "lon", F.col("population").cast("long").alias("population"), F.col("min_zoom").cast("double").alias("min_zoom"), "capital", "_country"]
    rows.select(*columns).write.format("world_labels").options(countries=section(b"CTRY", body).hex(), section_bytes=section_bytes).mode("append").save(path)


def read_world(spark: SparkSession, path: str) -> DataFrame:
    """Labels of one packed world file, a section a task; a damaged file is an error."""
    spark.dataSource.register(WorldLabels)
    return spark.read.format("world_labels").load(path)
