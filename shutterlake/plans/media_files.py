"""Queries on the bytes of media files, made from the library's rows: metadata removed, ..."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.operators.sorting import shared_folder
from shutterlake.sources import fallbacks, headers, rewrite, wire, world

from .registry import query


def number(x: Column | int, size: int, little: bool = True) -> Column:
    """Hex digits of a whole number of ``size`` bytes."""
    digits = F.lpad(F.hex(F.lit(x) if isinstance(x, int) else x), 2 * size, "0")
    return F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))]) if little else digits


def _entry(tag: int, kind: int, n: int, value: Column | int) -> list:
    return [number(tag, 2), number(kind, 2), number(n, 4), number(value, 4)]


def _joined(parts: list) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def exif_block(i: Column, w: Column, h: Column) -> Column:
    """Hex of a TIFF block of 184 bytes with a size, a date and a place."""
    date = F.concat(F.lit("2021:05:"), F.lpad((i % 28 + 1).cast("string"), 2, "0"), F.lit(" 10:20:30"))
    place = [number(2, 4), number(1, 4)]
    parts = ["49492A0008000000", number(4, 2)]
    for e in (_entry(0x100, 4, 1, w), _entry(0x101, 4, 1, h), _entry(0x132, 2, 20, 62), _entry(0x8825, 4, 1, 82)):
        parts += e
    parts += ["00000000", F.hex(date), "00", number(4, 2)]
    north, east = number(ord("N"), 4), number(ord("E"), 4)
    parts += [number(1, 2), number(2, 2), number(2, 4), north, *_entry(2, 5, 3, 136), number(3, 2), number(2, 2), number(2, 4), east, *_entry(4, 5, 3, 160), "00000000"]
    for degrees, minutes in ((i % 90, i % 60), (i % 180, i % 30)):
        parts += [number(degrees, 4), number(1, 4), number(minutes, 4), number(1, 4), *place]
    return _joined(parts)


PIXELS = "FFD8C0FE00112233445566778899AABB"  # bytes that look like markers


def dealt(media: DataFrame) -> DataFrame:
    """id, file_path dealt evenly over all cores: a row is short, and the file made of it is long to walk."""
    tasks = 3 * media.sparkSession.sparkContext.defaultParallelism
    rows = media.select("id", "file_path")
    return rows if rows.rdd.getNumPartitions() >= tasks else rows.repartition(tasks, "id")


def tagged_files(media: DataFrame) -> DataFrame:
    """path, content: for each row a JPEG, PNG, WebP or TIFF file with a date and a place, or a JPEG that breaks off, or none."""
    i = F.col("id")
    w, h = i % 4000 + 1, i * 7 % 3000 + 1
    block = exif_block(i, w, h)
    frame = ["FFC0001108", number(h, 2, False), number(w, 2, False), "00" * 10]

    def chunk(kind: str, body: Column, size: int) -> list:
        named = F.concat(F.lit(kind.encode().hex()), body)
        return [number(size, 4, False), named, number(F.crc32(F.unhex(named)), 4, False)]

    head = _joined([number(w, 4, False), number(h, 4, False), "0802000000"])
    files = [
        ["FFD8FFE100C0457869660000", block, *frame, "FFDA0002" + PIXELS + "FFD9"],
        ["89504E470D0A1A0A", *chunk("IHDR", head, 13), *chunk("eXIf", block, 184), *chunk("IDAT", F.lit(PIXELS), 16), *chunk("IEND", F.lit(""), 0)],
        ["52494646", number(4 + 18 + 192 + 24, 4), b"WEBPVP8X".hex(), number(10, 4), "08000000", number(w - 1, 3), number(h - 1, 3), b"EXIF".hex(), number(184, 4), block, b"VP8 ".hex(), number(16, 4), PIXELS],
        [block, PIXELS],
        ["FFD8FFE10FFF457869660000", block],
        ["6E6F206D65646961", number(i, 4)],
    ]
    content = F.lit(None).cast("string")
    for n, parts in enumerate(files):
        content = F.when(i % 6 == n, _joined(parts)).otherwise(content)
    return media.select(F.col("file_path").alias("path"), F.unhex(content).alias("content"))


@query(
    "media",
    sql="""WITH f AS (SELECT id, file_path AS path, id % 6 AS k, id % 4000 + 1 AS w, id * 7 % 3000 + 1 AS h, '2021:05:' || LPAD((id % 28 + 1)::VARCHAR, 2, '0') || ' 10:20:30' AS taken,
        id % 90 + (id % 60) / 60.0::DOUBLE + 2 / 3600.0::DOUBLE AS lat, id % 180 + (id % 30) / 60.0::DOUBLE + 2 / 3600.0::DOUBLE AS lon FROM media),
      b AS (SELECT *, CASE k WHEN 0 THEN 237 WHEN 1 THEN 269 WHEN 2 THEN 246 WHEN 3 THEN 200 WHEN 4 THEN 196 ELSE 12 END AS bytes, CASE k WHEN 0 THEN 194 WHEN 1 THEN 196 WHEN 2 THEN 192 ELSE 0 END AS less FROM f)
    SELECT path, mode, CASE WHEN k = 4 THEN 'failed' WHEN k = 5 THEN 'kept' ELSE 'changed' END AS outcome, bytes - CASE WHEN mode = 'all' THEN less ELSE 0 END AS bytes,
      CASE WHEN k < 4 THEN w END::INTEGER AS width, CASE WHEN k < 4 THEN h END::INTEGER AS height, CASE WHEN k < 4 AND mode = 'place' THEN taken END AS taken, k < 4 AS place_was_there, FALSE AS place_is_there, k < 4 AS pixels_equal
    FROM b, (VALUES ('all'), ('place')) m(mode)""",
)
def d28_stripped_files(media):
    """Each file without all metadata, and without its place: what a probe finds before and after, and whether the pixels are the same bytes."""
    there = F.coalesce(F.col("lat").isNotNull() & F.col("kind").isNotNull(), F.lit(False))
    before = headers.with_fields(tagged_files(dealt(media))).select("path", "content", there.alias("place_was_there"))
    modes = before.withColumn("mode", F.explode(F.array(F.lit("all"), F.lit("place"))))
    done = modes.withColumn("_done", rewrite.without_metadata(F.col("content"), F.col("mode") == "place"))
    done = done.select("path", "mode", "place_was_there", F.col("_done.content").alias("content"), F.col("_done.outcome").alias("outcome"))
    bytes_, pixels = F.octet_length("content").alias("bytes"), (F.instr(F.hex("content"), PIXELS) > 0).alias("pixels_equal")
    return headers.with_fields(done).select("path", "mode", "outcome", bytes_, "width", "height", "taken", "place_was_there", there.alias("place_is_there"), pixels)


@query("media", sql="SELECT id, CASE WHEN id % 6 >= 4 THEN latitude END AS latitude, CASE WHEN id % 6 >= 4 THEN longitude END AS longitude FROM media")
def d28_places_forgotten(media):
    return rewrite.places_forgotten(media, rewrite.stripped(tagged_files(dealt(media)), True)).select("id", "latitude", "longitude")


@query(
    "towns",
    sql="""SELECT CASE WHEN id % 40 = 0 THEN 'ocean' ELSE 'city' END AS kind, name, CASE WHEN id % 40 <> 0 THEN country END AS country, ROUND(lat * 100000) * 1e-5::DOUBLE AS lat, ROUND(lon * 100000) * 1e-5::DOUBLE AS lon,
      population::BIGINT AS population, (id % 200) / 16.0::DOUBLE AS min_zoom, id % 9 = 0 AS capital FROM towns""",
)
def d33_world_labels(towns):
    """The towns written to a packed world file, and read back from it by sections."""
    ocean = F.col("id") % 40 == 0
    kind, country = F.when(ocean, "ocean").otherwise("city"), F.when(~ocean, F.col("country"))
    rows = towns.select(kind.alias("kind"), "name", country.alias("country"), "lat", "lon", F.col("population").cast("long").alias("population"), (F.col("id") % 200 / 16).alias("min_zoom"), (F.col("id") % 9 == 0).alias("capital"))
    path = f"{shared_folder(towns.sparkSession)}/world-{uuid.uuid4().hex}.kgeo"
    world.write_world(rows, path)
    return world.read_world(towns.sparkSession, path)


def _segment(mark: str, body: Column) -> list:
    return [mark, number(F.length(body) / 2 + 2, 2, False), body]


def described_files(media: DataFrame) -> DataFrame:
    """path, content: for each row a JPEG with a full Exif block and a packet that differs, one with a packet of attributes, an unknown format with a packet of elements, a JPEG with an IPTC date, or one with its size alone."""
    i = F.col("id")
    w, h = i % 4000 + 1, i * 7 % 3000 + 1
    day, minute = F.lpad((i % 28 + 1).cast("string"), 2, "0"), F.lpad((i % 60).cast("string"), 2, "0")
    lat, lon = F.format_string("%d,%d.5%s", i % 80, i % 60, F.when(i % 2 == 0, "N").otherwise("S")), F.format_string("%d,%d,30%s", i % 170, i % 60, F.when(i % 4 < 2, "E").otherwise("W"))
    date = F.concat(F.lit("2019-03-"), day, F.lit("T08:"), minute, F.lit(":09+02:00"))
    head = '<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">'
    space = 'xmlns:exif="http://ns.adobe.com/exif/1.0/" xmlns:xmp="http://ns.adobe.com/xap/1.0/"'
    tail = "</rdf:RDF></x:xmpmeta>"
    attributes = F.concat(F.lit(f'{head}<rdf:Description {space} rdf:about="" exif:DateTimeOriginal="'), date, F.lit('" exif:GPSLatitude="'), lat, F.lit('" exif:GPSLongitude="'), lon, F.lit(f'"/>{tail}'))
    elements = F.concat(F.lit(f"{head}<rdf:Description {space}><exif:PixelXDimension>"), w.cast("string"), F.lit("</exif:PixelXDimension><exif:PixelYDimension>"), h.cast("string"), F.lit(f"</exif:PixelYDimension></rdf:Description><rdf:Description {space}><xmp:CreateDate>"), date, F.lit(f"</xmp:CreateDate></rdf:Description>{tail}"))
    packet = F.hex(F.concat(F.lit("http://ns.adobe.com/xap/1.0/"), F.decode(F.lit(b"\0"), "ISO-8859-1"), attributes))
    record = F.concat(F.lit("1C02370008"), F.hex(F.concat(F.lit("201807"), day)), F.when(i % 2 == 0, F.concat(F.lit("1C023C000B"), F.hex(F.concat(F.lit("09"), minute, F.lit("30+0100"))))).otherwise(""))
    iptc = F.concat(F.lit(b"Photoshop 3.0\0".hex() + b"8BIM".hex() + "0404" + "0000"), number(F.length(record) / 2, 4, False), record)
    frame = ["FFC0001108", number(h, 2, False), number(w, 2, False), "00" * 10, "FFDA0002" + PIXELS + "FFD9"]
    files = [
        ["FFD8", "FFE100C0457869660000", exif_block(i, w, h), *_segment("FFE1", packet), *frame],
        ["FFD8", *_segment("FFE1", packet), *frame],
        ["1A45DFA3", PIXELS, F.hex(elements), PIXELS],
        ["FFD8", *_segment("FFED", iptc), *frame],
        ["FFD8", *frame],
    ]
    content = F.lit(None).cast("string")
    for n, parts in enumerate(files):
        content = F.when(i % 5 == n, _joined(parts)).otherwise(content)
    return media.select(F.col("file_path").alias("path"), F.unhex(content).alias("content"))


@query(
    "media",
    sql="""WITH f AS (SELECT file_path AS path, id, id % 5 AS k, LPAD((id % 28 + 1)::VARCHAR, 2, '0') AS d, LPAD((id % 60)::VARCHAR, 2, '0') AS m FROM media)
    SELECT path, (id % 4000 + 1)::INTEGER AS width, (id * 7 % 3000 + 1)::INTEGER AS height,
      CASE k WHEN 0 THEN '2021:05:' || d || ' 10:20:30' WHEN 3 THEN '2018:07:' || d || CASE WHEN id % 2 = 0 THEN ' 09:' || m || ':30' ELSE ' 00:00:00' END WHEN 4 THEN NULL ELSE '2019:03:' || d || ' 08:' || m || ':09' END AS taken,
      CASE k WHEN 0 THEN id % 90 + (id % 60) / 60.0::DOUBLE + 2 / 3600.0::DOUBLE WHEN 1 THEN (id % 80 + (id % 60 + 0.5::DOUBLE) / 60) * CASE WHEN id % 2 = 0 THEN 1 ELSE -1 END END AS lat,
      CASE k WHEN 0 THEN id % 180 + (id % 30) / 60.0::DOUBLE + 2 / 3600.0::DOUBLE WHEN 1 THEN (id % 170 + (id % 60) / 60.0::DOUBLE + 30 / 3600.0::DOUBLE) * CASE WHEN id % 4 < 2 THEN 1 ELSE -1 END END AS lon,
      CASE WHEN k = 2 THEN 'xmp' ELSE 'header' END AS size_by, CASE k WHEN 0 THEN 'header' WHEN 3 THEN 'iptc' WHEN 4 THEN NULL ELSE 'xmp' END AS taken_by, CASE k WHEN 0 THEN 'header' WHEN 1 THEN 'xmp' END AS place_by,
      CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE 3 END AS asked FROM f""",
)
def s14_probed_in_turn(media):
    return fallbacks.probed_in_turn(described_files(dealt(media))).drop("orientation", "seconds")


def varint_hex(n: Column) -> Column:
    """Hex digits of a number that is not negative, in groups of seven bits."""
    groups = F.ceil(F.length(F.bin(n)) / 7).cast("int")
    digit = F.transform(F.sequence(F.lit(0), groups - 1), lambda i: F.lpad(F.hex(F.call_function("shiftright", n, i * 7).bitwiseAND(127).bitwiseOR(F.when(i < groups - 1, 128).otherwise(0))), 2, "0"))
    return F.array_join(digit, "")


def messages(media: DataFrame) -> DataFrame:
    """path, content: each row as a message of its id, a message of path and size, up to two numbers, and a date, whose last byte some lack."""
    i, size, path = F.col("id").cast("long"), F.col("file_size").cast("long"), F.col("file_path")
    inner = F.concat(F.lit("0A"), varint_hex(F.octet_length(path).cast("long")), F.hex(path), F.lit("10"), varint_hex(size))
    again = F.when(i % 3 == 0, "").when(i % 3 == 1, "2800").otherwise("28002801")
    whole = F.concat(F.lit("08"), varint_hex(i), F.lit("12"), varint_hex((F.length(inner) / 2).cast("long")), inner, again, F.lit("21"), number(F.col("creation_date").cast("long"), 8))
    return media.select(path.alias("path"), F.unhex(F.when(i % 10 == 7, whole.substr(F.lit(1), F.length(whole) - 2)).otherwise(whole)).alias("content"))


@query(
    "media",
    sql="""WITH m AS (SELECT *, LENGTH(file_path) AS n, CASE WHEN file_size < 128 THEN 1 WHEN file_size < 16384 THEN 2 ELSE 3 END AS v FROM media)
    SELECT file_path AS path, '1' AS field, 0 AS wire, id AS number, NULL::INTEGER AS bytes, NULL AS text FROM m UNION ALL SELECT file_path, '2', 2, NULL, n + v + 3, NULL FROM m UNION ALL SELECT file_path, '2.1', 2, NULL, n, file_path FROM m
    UNION ALL SELECT file_path, '2.2', 0, file_size, NULL, NULL FROM m UNION ALL SELECT file_path, '5', 0, UNNEST(RANGE(id % 3)), NULL, NULL FROM m
    UNION ALL SELECT file_path, CASE WHEN id % 10 = 7 THEN '' ELSE '4' END, CASE WHEN id % 10 <> 7 THEN 1 END, CASE WHEN id % 10 <> 7 THEN creation_date END, NULL, NULL FROM m""",
)
def s20_wire_fields(media):
    rows = wire.wire_fields(messages(media), {"2"})
    return rows.select("path", "field", "wire", "number", F.octet_length("bytes").alias("bytes"), F.when(F.col("field") == "2.1", F.decode("bytes", "UTF-8")).alias("text"))
