"""Files without their metadata: headers are copied, pixels are not touched.

``stripped`` rewrites JPEG, PNG, WebP and TIFF content (path, content), the whole
metadata or only where a picture was taken:

* JPEG segments, PNG chunks and WebP chunks are copied one by one; those that
  hold Exif, XMP or IPTC (and JPEG comments) are left out. PNG check sums, the
  size of a WebP file and its flags for what it holds are made anew.
* TIFF directories lose the entries that hold or describe metadata, and the bytes
  that these entries pointed at become zero; no offset moves.
* For the location alone, the GPS directory of an Exif block goes in that way,
  and XMP properties that name GPS or a location are blanked in place.

Colour profiles stay, as pixels mean nothing without them, and so does the
orientation of a TIFF file. A file without anything to remove is ``kept`` as it is;
one that cannot be walked to its end is ``failed`` and passes through unchanged,
as does null content. Walking is a loop over a file's own parts in an Arrow task.
"""

from __future__ import annotations

import re
import struct
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .headers import DAMAGE

# TIFF tags of directories, packets and descriptions; names of PNG text chunks; flags of a WebP file.
EXIF_IFD, GPS_IFD, XMP_TAG = 0x8769, 0x8825, 0x02BC
META_TAGS = {0x010E, 0x010F, 0x0110, 0x0131, 0x0132, 0x013B, XMP_TAG, 0x83BB, 0x8298, 0x8649, EXIF_IFD, GPS_IFD}
XMP_HEAD, XMP_LONG, IPTC_HEAD, EXIF_HEAD = b"http://ns.adobe.com/xap/1.0/\0", b"http://ns.adobe.com/xmp/extension/\0", b"Photoshop 3.0\0", b"Exif\0\0"
RAW_PROFILE, XMP_TEXT = b"Raw profile type ", b"XML:com.adobe.xmp\0"
EXIF_FLAG, XMP_FLAG = 0x08, 0x04
UNIT = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4}

_PLACE = re.compile(rb"""[\w.-]+:[\w.-]*(?:GPS|Location)[\w.-]*\s*=\s*(?:"[^"]*"|'[^']*')|<([\w.-]+:[\w.-]*(?:GPS|Location)[\w.-]*)(?:\s[^<>]*)?(?:/>|>.*?</\1\s*>)""", re.DOTALL)

OUT = "content binary, outcome string"


def without_places(xmp: bytes) -> bytes:
    """An XMP packet of the same length whose properties of places are blanks."""
    return _PLACE.sub(lambda m: b" " * len(m[0]), xmp)


def tiff_without(data: bytes, tags: set[int]) -> bytes:
    """A TIFF block of the same length without the entries of ``tags`` and what they pointed at, in all its directories."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    out = bytearray(data)
    seen: set[int] = set()

    def span(at: int) -> tuple[int, int]:
        """Place and size of the value of the entry at ``at``, if it lies outside the entry."""
        kind, n = struct.unpack_from(order + "HI", data, at + 2)
        size = UNIT.get(kind, 0) * n
        place = struct.unpack_from(order + "I", data, at + 8)[0]
        if size > 4 and place + size > len(data):
            raise IndexError
        return (place, size) if size > 4 else (0, 0)

    def wiped(at: int) -> None:
        """Zero a directory that is no longer pointed at, and its values."""
        n = struct.unpack_from(order + "H", data, at)[0]
        for i in range(n):
            place, size = span(at + 2 + 12 * i)
            out[place : place + size] = bytes(size)
        out[at : at + 6 + 12 * n] = bytes(min(6 + 12 * n, len(out) - at))

    at = struct.unpack_from(order + "I", data, 4)[0]
    while at and at not in seen:
        seen.add(at)
        n = struct.unpack_from(order + "H", data, at)[0]
        rest = data[at + 2 + 12 * n : at + 6 + 12 * n]
        kept = b""
        for i in range(n):
            entry = at + 2 + 12 * i
            tag, kind = struct.unpack_from(order + "HH", data, entry)
            if tag not in tags:
                span(entry)
                kept += data[entry : entry + 12]
                continue
            place, size = span(entry)
            out[place : place + size] = bytes(size)
            if tag in (EXIF_IFD, GPS_IFD) and kind in (4, 13):
                wiped(struct.unpack_from(order + "I", data, entry + 8)[0])
        if len(kept) < 12 * n:
            out[at : at + 6 + 12 * n] = struct.pack(order + "H", len(kept) // 12) + kept + rest + bytes(12 * n - len(kept))
        at = struct.unpack(order + "I", rest)[0]
    return bytes(out)


def _placeless(block: bytes) -> bytes:
    """An Exif block without its GPS directory; its head, if it has one, stays."""
    head = EXIF_HEAD if block.startswith(EXIF_HEAD) else b""
    return head + tiff_without(block[len(head) :], {GPS_IFD})


def _jpeg(data: bytes, location_only: bool) -> bytes:
    out, at = [data[:2]], 2
    while True:
        if data[at] != 0xFF:
            raise IndexError
        mark = data[at + 1]
        if mark == 0xFF:  # padding
            at += 1
            continue
        if mark in (0xDA, 0xD9):  # pixels follow
            return b"".join([*out, data[at:]])
        size = struct.unpack_from(">H", data, at + 2)[0]
        end = at + 2 + size
        if size < 2 or end > len(data):
            raise IndexError
        body = data[at + 4 : end]
        exif, xmp = mark == 0xE1 and body.startswith(EXIF_HEAD), mark == 0xE1 and body.startswith((XMP_HEAD, XMP_LONG))
        if location_only:
            body = _placeless(body) if exif else without_places(body) if xmp else body
            out.append(data[at : at + 4] + body)
        elif not (exif or xmp or mark == 0xED and body.startswith(IPTC_HEAD) or mark == 0xFE):
            out.append(data[at:end])
        at = end


def _png(data: bytes, location_only: bool) -> bytes:
    out, at = [data[:8]], 8
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if at + 12 + size > len(data):
            raise IndexError
        xmp = kind == b"iTXt" and body.startswith(XMP_TEXT)
        profile = kind in (b"zTXt", b"tEXt", b"iTXt") and body.startswith(RAW_PROFILE)
        if location_only and kind == b"eXIf":
            body = _placeless(body)
        elif location_only and xmp:
            at_text = body.index(b"\0", body.index(b"\0", len(XMP_TEXT) + 2) + 1) + 1
            packed = body[len(XMP_TEXT)] == 1
            text = without_places(zlib.decompress(body[at_text:]) if packed else body[at_text:])
            body = body[:at_text] + (zlib.compress(text) if packed else text)
        elif kind == b"eXIf" or xmp or profile:
            body = None  # a raw profile may hold a place as well
        if body is not None:
            out.append(struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body)))
        at += 12 + size
        if kind == b"IEND":
            return b"".join([*out, data[at:]])
    raise IndexError


def _webp(data: bytes, location_only: bool) -> bytes:
    out, at, end = [], 12, 8 + struct.unpack_from("<I", data, 4)[0]
    if end > len(data):
        raise IndexError
    while at + 8 <= end:
        kind, size = struct.unpack_from("<4sI", data, at)
        body = data[at + 8 : at + 8 + size]
        if at + 8 + size > end:
            raise IndexError
        if location_only:
            body = _placeless(body) if kind == b"EXIF" else without_places(body) if kind == b"XMP " else body
        elif kind == b"VP8X":
            body = bytes([body[0] & ~(EXIF_FLAG | XMP_FLAG)]) + body[1:]
        if location_only or kind not in (b"EXIF", b"XMP "):
            out.append(struct.pack("<4sI", kind, len(body)) + body + bytes(size % 2))
        at += 8 + size + size % 2
    inner = b"WEBP" + b"".join(out)
    return b"RIFF" + struct.pack("<I", len(inner)) + inner + data[end:]


def _tiff(data: bytes, location_only: bool) -> bytes:
    if not location_only:
        return tiff_without(data, META_TAGS)
    out = bytearray(tiff_without(data, {GPS_IFD}))
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    at = struct.unpack_from(order + "I", data, 4)[0]
    for i in range(struct.unpack_from(order + "H", out, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", out, at + 2 + 12 * i)
        place = struct.unpack_from(order + "I", out, at + 10 + 12 * i)[0]
        if tag == XMP_TAG and UNIT.get(kind) == 1 and n > 4:
            out[place : place + n] = without_places(bytes(out[place : place + n]))
    return bytes(out)


def rewritten(data: bytes, location_only: bool) -> tuple[bytes, str]:
    """A file's content without metadata, and the outcome: changed, kept or failed."""
    kinds = ((b"\xff\xd8\xff", _jpeg), (b"\x89PNG\r\n\x1a\n", _png), (b"II*\0", _tiff), (b"MM\0*", _tiff))
    walk = next((f for head, f in kinds if data.startswith(head)), _webp if data[:4] == b"RIFF" and data[8:12] == b"WEBP" else None)
    if walk is None:
        return data, "kept"
    try:
        new = walk(data, location_only)
    except (*DAMAGE, zlib.error):
        return data, "failed"
    return new, "kept" if new == data else "changed"


def _written(content: pa.Array, location_only: pa.Array) -> pa.Array:
    done = [rewritten(c, only) if c is not None else (None, "failed") for c, only in zip(content.to_pylist(), location_only.to_pylist(), strict=True)]
    return pa.StructArray.from_arrays([pa.array([c for c, _ in done], pa.binary()), pa.array([o for _, o in done], pa.string())], ["content", "outcome"])


def without_metadata(content: Column, location_only: Column) -> Column:
    """Struct of content and outcome of a file without its metadata, or without its place where ``location_only`` holds."""
    return F.arrow_udf(_written, OUT)(content, location_only)


def stripped(files: DataFrame, location_only: bool = False) -> DataFrame:
    """path, content, outcome of files (path, content) without their metadata."""
    done = files.select("path", without_metadata(F.col("content"), F.lit(location_only)).alias("_done"))
    return done.select("path", "_done.content", "_done.outcome")


def places_forgotten(media: DataFrame, done: DataFrame) -> DataFrame:
    """``media`` with null places where ``stripped`` has changed the file, in either mode."""
    gone = done.filter("outcome = 'changed'").select(F.col("path").alias("file_path"), F.lit(True).alias("_gone")).distinct()
    rows = media.join(gone, "file_path", "left")
    return rows.withColumns({c: F.when(F.col("_gone").isNull(), F.col(c)) for c in ("latitude", "longitude")}).drop("_gone")
