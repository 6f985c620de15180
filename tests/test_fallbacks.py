"""Fields of media files from one reader after another."""

from shutterlake.plans.media_files import dealt, described_files
from shutterlake.sources import fallbacks, headers

HEAD = b'<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="r" xmlns:exif="e">'
TAIL = b"</rdf:RDF></x:xmpmeta>"
SIZED = b"\xff\xd8\xff\xc0\x00\x11\x08\x00\x10\x00\x20" + bytes(10)


def test_headers_alone_agree_with_the_probe(spark):
    media = spark.range(1, 200).selectExpr("id", "concat('/f/', id) file_path")
    files = described_files(media)
    one = {r["path"]: r for r in headers.probed(files).collect()}
    got = fallbacks.probed_in_turn(files).collect()
    assert len(got) == 199
    for r in got:
        if r["asked"] == 1:
            p = one[r["path"]]
            assert all(r[n] == p[n] for n in fallbacks.FIELDS) and r["size_by"] == r["taken_by"] == r["place_by"] == "header"
    assert sum(r["asked"] == 1 for r in got) == 39


def test_odd_packets(spark):
    def described(text):
        return b"no format" + HEAD + text + TAIL

    cases = {
        "null": None,
        "empty": b"",
        "broken off": SIZED + HEAD + b"<rdf:Description exif:PixelXDimension='3'",
        "not xml": SIZED + HEAD + b"<rdf:Description & <" + TAIL,
        "no description": described(b""),
        "half a size": described(b"<rdf:Description exif:PixelXDimension='3'/>"),
        "not a size": described(b"<rdf:Description exif:PixelXDimension='x' exif:PixelYDimension='99999999999'/>"),
        "two places": described(b"<rdf:Description exif:GPSLatitude='1,30.0S'/><rdf:Description exif:GPSLongitude='2,15,36E'/>"),
        "off the globe": described(b"<rdf:Description exif:GPSLatitude='91,0.0N' exif:GPSLongitude='2,0.0E'/>"),
        "minutes alone": described(b"<rdf:Description exif:DateTimeOriginal='2020-01-02T03:04'/>"),
        "day alone": described(b"<rdf:Description exif:DateTimeOriginal='2020-01-02'/>"),
        "blank": described(b"<rdf:Description exif:DateTimeOriginal=' '><exif:DateTimeOriginal>2020-01-02T03:04:05Z</exif:DateTimeOriginal></rdf:Description>"),
        "iptc": SIZED + b"8BIM\x04\x04\0\0\0\0\0\x20" + b"\x1c\x02\x37\x00\x0820200102",
        "iptc elsewhere": SIZED + b"\x1c\x02\x37\x00\x0820200102",
    }
    files = spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in cases.items()], "path string, content binary")
    got = {r["path"]: r for r in fallbacks.probed_in_turn(files).collect()}
    assert set(got) == set(cases)
    assert {k: (r["width"], r["height"]) for k, r in got.items() if r["width"] is not None} == {k: (32, 16) for k in ("broken off", "not xml", "iptc", "iptc elsewhere")}
    assert {k: (r["lat"], r["lon"]) for k, r in got.items() if r["place_by"]} == {"two places": (-1.5, 2.26)}
    assert {k: (r["taken"], r["taken_by"]) for k, r in got.items() if r["taken"]} == {
        "minutes alone": ("2020:01:02 03:04:00", "xmp"),
        "blank": ("2020:01:02 03:04:05", "xmp"),
        "iptc": ("2020:01:02 00:00:00", "iptc"),
    }


def test_a_packet_is_parsed_once_and_files_are_dealt_over_the_cores(spark):
    media = spark.range(1, 200, numPartitions=1).selectExpr("id", "concat('/f/', id) file_path")
    done = fallbacks.probed_in_turn(described_files(dealt(media)))
    assert done._jdf.queryExecution().optimizedPlan().toString().count("from_xml(") == 1
    assert done.rdd.getNumPartitions() == 3 * spark.sparkContext.defaultParallelism
    assert done.count() == 199
