"""Sizes, dates and places from the headers of media files.

Formats with fields at fixed places are read by column expressions on the
binary content. JPEG, TIFF and MP4 chain their fields, as do the Exif chunks of
PNG and WebP, so a small helper walks them in Arrow batches. A damaged file
yields nulls, never an error; sizes beyond 2^31 - 1 are damage.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.functions.geo import iso6709

#: Formats whose fields chain, and the fields that the helper finds.
CHAINED = ("jpeg", "tiff", "bmff", "png", "webp")
FIELDS = "width int, height int, orientation int, taken string, lat double, lon double, seconds double, place string"
_ARROW = pa.struct([(n, {"int": pa.int32(), "double": pa.float64(), "string": pa.string()}[kind]) for n, kind in (f.split() for f in FIELDS.split(", "))])

#: What a helper raises on a damaged file.
DAMAGE = (struct.error, IndexError, KeyError, TypeError, ValueError, OverflowError, RecursionError)

# Boxes that hold boxes, and QuickTime's keys of place and local date.
HOLDERS = {"/moov", "/moov/trak", "/moov/trak/mdia", "/moov/udta", "/moov/udta/meta", "/moov/meta", "/meta", "/meta/iprp", "/meta/iprp/ipco"}
PLACES = ("com.apple.quicktime.location.ISO6709", "location")
MADE = "com.apple.quicktime.creationdate"


def _number(content: Column, at: int, size: int, little: bool) -> Column:
    digits = F.hex(F.substring(content, at + 1, size))
    if little:
        digits = F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))])
    return F.when(F.length(digits) == 2 * size, F.conv(digits, 16, 10).try_cast("long"))  # null if the file ends before


def kind_of(content: Column) -> Column:
    """The format by its first bytes."""
    head, brand = F.hex(F.substring(content, 1, 12)), F.hex(F.substring(content, 5, 8))
    out = F.when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("89504E470D0A1A0A"), "png").when(head.rlike("^52494646.{8}57454250"), "webp")
    out = out.when(head.rlike("^474946383[79]61"), "gif").when(head.startswith("424D"), "bmp").when(head.rlike("^(49492A00|4D4D002A)"), "tiff")
    return out.when(brand == "6674797063727820", F.lit(None)).when(brand.startswith("66747970"), "bmff")  # raw CR3 is refused


def fixed_sizes(files: DataFrame) -> DataFrame:
    """``files`` with kind, and width and height of PNG, GIF, BMP and WebP files, from their content."""
    c = F.col("content")
    rows = files.withColumn("kind", kind_of(c))
    chunk = F.hex(F.substring(c, 13, 4))
    lossless, tall = _number(c, 21, 4, True), _number(c, 22, 4, True)
    tall = F.abs(F.when(tall >= 2**31, tall - 2**32).otherwise(tall))  # a negative height runs from the top
    sizes = {
        "png": (_number(c, 16, 4, False), _number(c, 20, 4, False)),
        "gif": (_number(c, 6, 2, True), _number(c, 8, 2, True)),
        "bmp": (_number(c, 18, 4, True), tall),
    }
    webp = (
        F.when(chunk == "56503858", _number(c, 24, 3, True) + 1).when(chunk == "56503820", _number(c, 26, 2, True).bitwiseAND(16383)).when(chunk == "5650384C", lossless.bitwiseAND(16383) + 1),
        F.when(chunk == "56503858", _number(c, 27, 3, True) + 1).when(chunk == "56503820", _number(c, 28, 2, True).bitwiseAND(16383)).when(chunk == "5650384C", F.shiftrightunsigned(lossless, 14).bitwiseAND(16383) + 1),
    )
    sizes["webp"] = webp
    wide = high = F.lit(None).cast("long")
    for kind, (w, h) in sizes.items():
        wide, high = F.when(F.col("kind") == kind, w).otherwise(wide), F.when(F.col("kind") == kind, h).otherwise(high)
    return rows.withColumns({"width": wide.try_cast("int"), "height": high.try_cast("int")})


def _tiff(data: bytes) -> dict:
    """Fields of a TIFF block: size, orientation, the best date, and the place."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    width = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}

    def fields(at: int) -> dict:
        out = {}
        for i in range(struct.unpack_from(order + "H", data, at)[0]):
            tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            size = width.get(kind, 0) * n
            place = at + 10 + 12 * i
            if size > 4:
                place = struct.unpack_from(order + "I", data, place)[0]
            raw = data[place : place + size]
            if not size or len(raw) < size:
                continue
            if kind == 2:
                out[tag] = raw.split(b"\0")[0].decode("latin-1")
            elif kind in (1, 3, 4):
                out[tag] = struct.unpack(f"{order}{n}{ {1: 'B', 3: 'H', 4: 'I'}[kind] }", raw)
            elif kind == 5:
                v = struct.unpack(f"{order}{2 * n}I", raw)
                out[tag] = [a / b if b else 0.0 for a, b in zip(v[::2], v[1::2], strict=True)]
        return out

    def numbers(found: dict, tag: int) -> tuple:
        """Whole numbers of a field of bytes, shorts or longs; none if it has another type."""
        return found[tag] if isinstance(found.get(tag), tuple) else ()

    def below(tag: int) -> dict:
        at = numbers(top, tag)
        return fields(at[0]) if at and at[0] + 2 <= len(data) else {}

    top = fields(struct.unpack_from(order + "I", data, 4)[0])
    exif, gps = below(0x8769), below(0x8825)
    out: dict = {}
    for name, places in (("orientation", ((top, 0x112),)), ("width", ((exif, 0xA002), (top, 0x100))), ("height", ((exif, 0xA003), (top, 0x101)))):
        out[name] = next((v[0] for v in (numbers(*p) for p in places) if v), None)
    out["taken"] = next((t for t in (exif.get(0x9003), exif.get(0x9004), top.get(0x132)) if t and isinstance(t, str)), None)
    for name, tag in (("lat", 2), ("lon", 4)):
        if isinstance(gps.get(tag), list) and len(gps[tag]) == 3:
            d, m, s = gps[tag]
            out[name] = (d + m / 60 + s / 3600) * (-1 if gps.get(tag - 1) in ("S", "W") else 1)
    return out


def _jpeg(data: bytes) -> dict:
    out, at = {}, 2
    for _ in range(512):
        mark, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        if mark == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            try:
                found = _tiff(data[at + 10 : at + 2 + size])
                out |= {k: v for k, v in found.items() if k not in ("width", "height")}
            except DAMAGE:
                pass  # the size may still follow
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            out["height"], out["width"] = struct.unpack_from(">HH", data, at + 5)
            break
        at += 2 + size
    return out


def _chunked(data: bytes, at: int, head: str, pad: int, name: bytes) -> dict:
    """Fields of the Exif chunk ``name`` of a file of chunks (size and name, in the order of ``head``), rounded up to ``pad``."""
    for _ in range(4096):
        size, kind = sorted(struct.unpack_from(head, data, at), key=lambda x: isinstance(x, bytes))
        at += 8
        if kind == name:
            block = data[at : at + size]
            found = _tiff(block[6:] if block[:6] == b"Exif\0\0" else block)
            return {k: v for k, v in found.items() if k not in ("width", "height")}
        at += size + (4 if pad == 1 else size % pad)  # PNG has a check sum instead of padding
    return {}


def _boxes(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        size = size or end - at
        if size < head or at + size > end:
            return
        yield kind, at + head, at + size
        at += size


def _tree(data: bytes, at: int, end: int, above: str = "") -> Iterator[tuple[str, int, int]]:
    """Path, start and end of every box below the containers that hold fields, in file order."""
    for kind, x, y in _boxes(data, at, end):
        path = f"{above}/{kind.decode('latin-1')}"
        yield path, x, y
        if path in HOLDERS:
            # a box of sub-boxes may start with four bytes of version and flags
            yield from _tree(data, x + 4 if path.endswith("/meta") and data[x + 4 : x + 8] != b"hdlr" else x, y, path)


def _film(data: bytes, boxes: list[tuple[str, int, int]]) -> dict:
    """Duration and date of moov, the size of the first picture track, and what QuickTime's keys say of date and place."""
    out: dict = {}
    track: dict = {}
    names: list[str] = []

    def place(raw: bytes) -> None:
        said = raw.decode("latin-1")
        if re.match(r"[+-][0-9.]+[+-][0-9.]+", said):
            out["place"] = said

    def settle() -> None:
        if track.get("size") and track.get("handler", b"vide") == b"vide" and "width" not in out:
            out["width"], out["height"] = track["size"]

    for path, x, y in boxes:
        leaf = path.rsplit("/", 1)[1]
        if path == "/moov/mvhd":
            made, _, scale, length = struct.unpack_from(">IIII" if data[x] == 0 else ">QQIQ", data, x + 4)
            out["seconds"] = length / scale if scale else None
            if 631152000 < made - 2082844800 < 2**33 and "local" not in out:  # from 1990 to 2242
                out["taken"] = str(pd.Timestamp(made - 2082844800, unit="s"))
        elif path == "/moov/trak":
            settle()
            track = {}
        elif leaf == "tkhd":
            m = x + (40 if data[x] == 0 else 52)
            w, h = (v >> 16 for v in struct.unpack_from(">II", data, m + 36))
            if w and h:
                track["size"] = (w, h) if struct.unpack_from(">i", data, m)[0] else (h, w)
        elif path == "/moov/trak/mdia/hdlr":
            track["handler"] = data[x + 8 : x + 12]
        elif leaf == "\xa9xyz":
            place(data[x + 4 : y])
        elif leaf == "keys":
            names, at = [], x + 8
            while at + 8 <= y and (size := struct.unpack_from(">I", data, at)[0]) >= 8:
                names.append(data[at + 8 : at + size].decode("latin-1"))
                at += size
        elif leaf == "ilst":
            for number, a, b in _boxes(data, x, y):
                value = next((data[p + 8 : q] for kind, p, q in _boxes(data, a, b) if kind == b"data"), b"")
                nth = int.from_bytes(number, "big")
                name = names[nth - 1] if 0 < nth <= len(names) else ""
                if name in PLACES:
                    place(value)
                elif name == MADE and re.match(rb"\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d", value):
                    out["taken"], out["local"] = value[:19].decode("ascii").replace("T", " "), True
    settle()
    return out


def _extent(data: bytes, x: int, item: int) -> tuple[int, int] | None:
    """Place and length of the first extent of an item in the iloc box that starts at ``x``, if it lies in the file itself."""
    version, wide, index = data[x], data[x + 4], data[x + 5]
    sizes = {"offset": wide >> 4, "length": wide & 15, "base": index >> 4, "index": index & 15 if version else 0}
    at = x + 6

    def take(n: int) -> int:
        nonlocal at
        if at + n > len(data):
            raise IndexError
        at += n
        return int.from_bytes(data[at - n : at], "big")

    long = 2 if version < 2 else 4
    for _ in range(take(long)):
        found = take(long)
        inside = (take(2) & 15) == 0 if version else True
        take(2)
        base, extents = take(sizes["base"]), []
        for _ in range(take(2)):
            take(sizes["index"])
            extents.append((base + take(sizes["offset"]), take(sizes["length"])))
        if found == item:
            return extents[0] if inside and extents else None
    return None


def _picture(data: bytes, boxes: list[tuple[str, int, int]]) -> dict:
    """The largest size of an image, turned if it says so, and the fields of its Exif item."""
    out: dict = {}
    quarter = exif = table = None
    for path, x, y in boxes:
        if path == "/meta/iprp/ipco/ispe":
            w, h = struct.unpack_from(">II", data, x + 4)
            if w * h > (out.get("width") or 0) * (out.get("height") or 0):
                out["width"], out["height"] = w, h
        elif path == "/meta/iprp/ipco/irot":
            quarter = data[x] & 1
        elif path == "/meta/iinf" and exif is None:
            for kind, p, _ in _boxes(data, x + (6 if data[x] == 0 else 8), y):
                form = {2: ">H2x4s", 3: ">I2x4s"}.get(data[p]) if kind == b"infe" else None
                if form and struct.unpack_from(form, data, p + 4)[1] == b"Exif":
                    exif = struct.unpack_from(form, data, p + 4)[0]
                    break
        elif path == "/meta/iloc":
            table = x
    if quarter and "width" in out:
        out["width"], out["height"] = out["height"], out["width"]
    try:
        spot = _extent(data, table, exif) if table is not None and exif is not None else None
        if spot:
            at, size = spot
            skip = struct.unpack_from(">I", data, at)[0]
            if skip < size:
                out |= {k: v for k, v in _tiff(data[at + 4 + skip : at + size]).items() if k not in ("width", "height")}
    except DAMAGE:
        pass  # the size is known all the same
    return out


def _bmff(data: bytes) -> dict:
    boxes = list(_tree(data, 0, len(data)))
    found = _film(data, boxes) if any(path == "/moov" for path, _, _ in boxes) else _picture(data, boxes)
    found.pop("local", None)
    return found


def parsed(data: bytes) -> dict:
    """Fields of one file; {} if it is damaged or of another format."""
    try:
        if data[:2] == b"\xff\xd8":
            return _jpeg(data)
        if data[:4] in (b"II*\0", b"MM\0*"):
            return _tiff(data)
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return _chunked(data, 8, ">I4s", 1, b"eXIf")
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            return _chunked(data, 12, "<4sI", 2, b"EXIF")
        if data[4:8] == b"ftyp" and data[8:12] != b"crx ":
            return _bmff(data)
    except DAMAGE:
        pass
    return {}


def _fitting(name: str, x: object) -> object:
    """A field as its column takes it: whole numbers below 2^31, finite numbers, text; null else."""
    if name in ("width", "height", "orientation"):
        return x if isinstance(x, int) and 0 <= x < 2**31 else None
    if name in ("lat", "lon", "seconds"):
        return float(x) if isinstance(x, (int, float)) and abs(x) < 1e300 else None
    return x if isinstance(x, str) else None


def _read(content: pa.Array) -> pa.Array:
    found = [parsed(c) if c is not None else {} for c in content.to_pylist()]
    return pa.StructArray.from_arrays([pa.array([_fitting(f.name, x[f.name]) if f.name in x else None for x in found], f.type) for f in _ARROW], fields=list(_ARROW))


def fields(content: Column) -> Column:
    """Struct of FIELDS that the helper finds in a file of a chained format; nulls for null content."""
    return F.arrow_udf(_read, FIELDS)(content)


def with_fields(files: DataFrame) -> DataFrame:
    """``files`` with kind, width, height, orientation, taken, lat, lon, seconds from their content; nulls for other formats."""
    rows = fixed_sizes(files).withColumn("_h", fields(F.when(F.col("kind").isin(*CHAINED), F.col("content"))))
    place = iso6709(F.col("_h.place"))
    found = {n: F.col(f"_h.{n}") for n in ("orientation", "taken", "seconds")}
    found |= {n: F.coalesce(n, f"_h.{n}") for n in ("width", "height")} | {n: F.coalesce(F.col(f"_h.{n}"), place[n]) for n in ("lat", "lon")}
    return rows.withColumns(found).drop("_h")


def probed(files: DataFrame) -> DataFrame:
    """path, width, height, orientation, taken, lat, lon, seconds of media files (path, content).

    Files of other formats are left out in the task that reads the rest: a filter
    would be pushed below the content and compute it once more.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("kind").is_valid())
            found = _read(pc.if_else(pc.is_in(batch.column("kind"), pa.array(CHAINED)), batch.column("content"), None))
            whole = [pc.coalesce(batch.column(n), found.field(n)) for n in ("width", "height")] + [found.field(f.name) for f in list(_ARROW)[2:]]
            yield pa.RecordBatch.from_arrays([batch.column("path"), *whole], ["path", *(f.name for f in _ARROW)])

    read = fixed_sizes(files.select("path", "content")).mapInArrow(work, f"path string, {FIELDS}")
    place = iso6709(F.col("place"))
    return read.withColumns({"lat": F.coalesce("lat", place["lat"]), "lon": F.coalesce("lon", place["lon"])}).drop("place")
