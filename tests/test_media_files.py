"""Headers of damaged and mistyped files, and files rewritten without metadata."""

import random
import struct
import zlib

from shutterlake.plans.media_files import d28_stripped_files, tagged_files
from shutterlake.sources import headers, rewrite

FILES = "path string, content binary"


def tiff(entries, order="<", below=()):
    """A TIFF block of a directory of (tag, kind, count, four bytes or longer), and directories below it as (tag, entries)."""
    n = len(entries) + len(below)
    tail, at = b"", 8 + 2 + 12 * n + 4
    out = struct.pack(order + "H", n)
    for tag, kind, count, value in entries:
        if len(value) > 4:
            spot, tail = at + len(tail), tail + value
            value = struct.pack(order + "I", spot)
        out += struct.pack(order + "HHI", tag, kind, count) + value.ljust(4, b"\0")
    for tag, inner in below:
        spot = at + len(tail)
        sub, far = struct.pack(order + "H", len(inner)), b""
        for t, kind, count, value in inner:
            if len(value) > 4:
                place, far = spot + 6 + 12 * len(inner) + len(far), far + value
                value = struct.pack(order + "I", place)
            sub += struct.pack(order + "HHI", t, kind, count) + value.ljust(4, b"\0")
        tail += sub + bytes(4) + far
        out += struct.pack(order + "HHI", tag, 4, 1) + struct.pack(order + "I", spot)
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8) + out + bytes(4) + tail


def jpeg(*segments, size=(30, 40)):
    return b"\xff\xd8" + b"".join(b"\xff" + bytes([m]) + struct.pack(">H", len(b) + 2) + b for m, b in segments) + b"\xff\xc0\0\x11\x08" + struct.pack(">HH", size[1], size[0]) + bytes(10) + b"\xff\xda\0\x02pixels\xff\xd9"


def png(*chunks):
    return b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b)) for k, b in chunks)


HEAD = (b"IHDR", struct.pack(">II", 30, 40) + b"\x08\x02\0\0\0")
PLACE = [(1, 2, 2, b"N\0"), (2, 5, 3, struct.pack("<6I", 48, 1, 30, 1, 0, 1)), (3, 2, 2, b"W\0"), (4, 5, 3, struct.pack("<6I", 2, 1, 15, 1, 0, 1))]
XMP = b"""<x:xmpmeta><rdf:Description exif:GPSLatitude="48,30N" xmp:Rating='3' photoshop:Location = 'Paris'><Iptc4xmpCore:Location>Rue</Iptc4xmpCore:Location><dc:title>GPS of it</dc:title></rdf:Description></x:xmpmeta>"""


def test_any_type_of_any_field_gives_a_value_or_null(spark):
    r = random.Random(1)
    files = []
    for tag in (0x100, 0x101, 0x112, 0x132, 0x8769, 0x8825, 0x9003, 0x9004, 0xA002, 0xA003, 1, 2, 3, 4):
        for kind in range(13):
            for count in (0, 1, 3, 6, 2**32 - 1):
                for value in (b"", b"\xff" * 4, bytes(r.randrange(256) for _ in range(48))):
                    entry = (tag, kind, count, value)
                    below = [(0x8769, [entry]), (0x8825, [entry, *PLACE][: r.randint(1, 5)])] if r.random() < 0.7 else []
                    block = tiff([entry] if tag > 4 else [], r.choice("<>"), below)
                    files.append(r.choice([block, jpeg((0xE1, b"Exif\0\0" + block)), png(HEAD, (b"eXIf", block))]))
    nested = jpeg()
    for _ in range(200):
        nested = jpeg((0xE1, b"Exif\0\0" + nested))
    deep = b"\xff\xd8" + b"\xff\xe1\x00\x0eExif\0\0\xff\xd8" * 4000
    # the five files that once ended a job
    files += [nested, deep, tiff([(0x112, 4, 1, b"\xff" * 4)]), tiff([(0x112, 2, 8, b"upright\0")]), tiff([(0x132, 3, 1, b"\x01\0\0\0")]), tiff([], below=[(0x8769, [(0xA002, 2, 4, b"wide")])]), tiff([(0x100, 5, 1, struct.pack("<2I", 9, 2))])]
    files += [jpeg((0xE1, b"Exif\0\0" + tiff([(0x112, 3, 1, b"\x06\0")], below=[(0x8825, PLACE)])))]
    rows = spark.createDataFrame([(str(i), f) for i, f in enumerate(files)] + [("none", None)], FILES).repartition(4)
    got = {x["path"]: x for x in headers.probed(rows).collect()}
    assert len(got) == len(files)
    last = got[str(len(files) - 1)]
    assert (last["width"], last["height"], last["orientation"], last["lat"], last["lon"]) == (30, 40, 6, 48.5, -2.25)
    assert got[str(len(files) - 2)]["width"] is None and got[str(len(files) - 6)]["orientation"] is None
    for x in got.values():
        assert x["orientation"] is None or 0 <= x["orientation"] < 2**31


def test_random_bytes_never_end_the_probe_or_the_rewriting(spark):
    r = random.Random(2)
    whole = [jpeg((0xE1, b"Exif\0\0" + tiff([(0x132, 2, 20, b"2021:01:02 03:04:05\0")], below=[(0x8825, PLACE)]))), png(HEAD, (b"eXIf", tiff([], below=[(0x8825, PLACE)])), (b"IEND", b"")), tiff([(0x100, 4, 1, b"\x09\0\0\0")], ">", below=[(0x8825, PLACE)])]
    files = []
    for f in whole:
        files += [f[:n] for n in range(len(f))]
        for _ in range(150):
            data = bytearray(f)
            for _ in range(r.randint(1, 6)):
                data[r.randrange(len(data))] = r.randrange(256)
            files.append(bytes(data))
    rows = spark.createDataFrame([(str(i), f) for i, f in enumerate(files)], FILES)
    assert headers.probed(rows).count() <= len(files)
    for only in (False, True):
        done = rewrite.stripped(rows, only).collect()
        assert len(done) == len(files)
        for x in done:
            if x["outcome"] != "changed":
                assert bytes(x["content"]) == files[int(x["path"])]


def probe(data):
    return headers.parsed(data)


def test_all_metadata_goes_and_pixels_stay():
    block = tiff([(0x112, 3, 1, b"\x06\0"), (0x132, 2, 20, b"2021:01:02 03:04:05\0"), (0x10F, 2, 6, b"Maker\0")], below=[(0x8769, [(0x9003, 2, 20, b"2020:01:02 03:04:05\0")]), (0x8825, PLACE)])
    icc = (0xE2, b"ICC_PROFILE\0\1\1colours")
    full = jpeg((0xE0, b"JFIF\0\1\2"), (0xE1, b"Exif\0\0" + block), (0xE1, rewrite.XMP_HEAD + XMP), (0xED, rewrite.IPTC_HEAD + b"8BIM"), icc, (0xFE, b"a comment"))
    assert rewrite.rewritten(full, False) == (jpeg((0xE0, b"JFIF\0\1\2"), icc), "changed")
    assert rewrite.rewritten(jpeg(icc), False) == (jpeg(icc), "kept") and rewrite.rewritten(jpeg(icc), True) == (jpeg(icc), "kept")
    text = (b"iTXt", rewrite.XMP_TEXT + b"\0\0\0\0" + XMP)
    body = [(b"IDAT", b"pixels"), (b"IEND", b"")]
    new, outcome = rewrite.rewritten(png(HEAD, (b"eXIf", block), text, (b"tEXt", b"Title\0kept"), (b"zTXt", b"Raw profile type exif\0\0x"), *body), False)
    assert (new, outcome) == (png(HEAD, (b"tEXt", b"Title\0kept"), *body), "changed")
    new, outcome = rewrite.rewritten(block, False)
    assert outcome == "changed" and len(new) == len(block) and b"2021" not in new and b"2020" not in new and b"Maker" not in new
    found = probe(new)
    assert found["orientation"] == 6 and found["taken"] is None and "lat" not in found


def test_only_the_place_goes():
    block = tiff([(0x112, 3, 1, b"\x06\0")], below=[(0x8769, [(0x9003, 2, 20, b"2020:01:02 03:04:05\0")]), (0x8825, PLACE)])
    full = jpeg((0xE1, b"Exif\0\0" + block), (0xE1, rewrite.XMP_HEAD + XMP))
    new, outcome = rewrite.rewritten(full, True)
    assert outcome == "changed" and len(new) == len(full)
    assert probe(full)["lat"] == 48.5 and "lat" not in probe(new)
    assert (probe(new)["taken"], probe(new)["orientation"]) == ("2020:01:02 03:04:05", 6)
    assert b"GPSLatitude" not in new and b"Paris" not in new and b"Rue" not in new and b"Rating='3'" in new and b"GPS of it" in new
    assert struct.pack("<6I", 48, 1, 30, 1, 0, 1) not in new
    body = [(b"IDAT", b"pixels"), (b"IEND", b"")]
    for packed in (False, True):
        text = rewrite.XMP_TEXT + bytes([packed]) + b"\0\0\0" + (zlib.compress(XMP) if packed else XMP)
        new, outcome = rewrite.rewritten(png(HEAD, (b"iTXt", text), *body), True)
        at = new.index(rewrite.XMP_TEXT) + len(rewrite.XMP_TEXT) + 4
        said = zlib.decompress(new[at:-28]) if packed else new[at:]
        assert outcome == "changed" and b"Paris" not in said and b"GPS of it" in said
        assert headers.parsed(new) == {}
    assert rewrite.rewritten(b"GIF89a...", True) == (b"GIF89a...", "kept")


def test_files_are_made_once_for_both_rewritings_and_all_probes(spark):
    media = spark.range(1, 200, numPartitions=1).selectExpr("id", "concat('/f/', id) file_path")

    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    once = plan(tagged_files(media)).count("unhex(")
    for done in (d28_stripped_files(media), headers.probed(tagged_files(media))):
        assert plan(done).count("unhex(") == once and "Join" not in plan(done) and "Union" not in plan(done)
    done = d28_stripped_files(media)
    assert done.count() == 2 * 199 and done.rdd.getNumPartitions() == 3 * spark.sparkContext.defaultParallelism
