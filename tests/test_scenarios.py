"""Scenarios and invariants of operators that SQL does not express."""

import colorsys
import math
import struct
from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from shutterlake.functions.dates import exif_seconds
from shutterlake.functions.media import COLOURS, colour_bucket
from shutterlake.functions.text import chunks
from shutterlake.operators import aggregates, dml, layout, search, sorting, vectors, windows
from shutterlake.operators.limits import small_list
from shutterlake.plans.fixtures import load
from shutterlake.plans.registry import QUERIES
from shutterlake.sources import files, headers
from shutterlake.streaming import ingest

SF = "/root/testdata/sf0.001"


def test_clusters_against_every_pair(spark):
    r = np.random.default_rng(7)
    for n in (40, 120):
        v = r.normal(size=(n, 12))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        fixed, barred = np.where(r.random(n) < 0.15, r.integers(0, 6, n), -1), np.where(r.random(n) < 0.3, r.integers(0, 8, n), -1)
        got = vectors.cluster_block(v, fixed, barred, r.permutation(n), 0.363)
        for c in set(got.tolist()):
            assert len({p for p in fixed[got == c] if p >= 0}) <= 1
        for p in set(fixed[fixed >= 0].tolist()):
            own = set(got[fixed == p].tolist())
            assert len(own) == 1 and not ((got == own.pop()) & (barred == p) & (fixed < 0)).any()
        sums = [v[got == c].sum(axis=0) for c in range(got.max() + 1)]
        for a in range(len(sums)):  # no two clusters are left that may merge
            for b in range(a):
                people = [{p for p in fixed[got == c] if p >= 0} for c in (a, b)]
                bars = [{p for p in barred[(got == c) & (fixed < 0)] if p >= 0} for c in (a, b)]
                if all(people) or people[0] & bars[1] or people[1] & bars[0]:
                    continue
                assert sums[a] @ sums[b] / np.linalg.norm(sums[a]) / np.linalg.norm(sums[b]) < 0.363


def test_all_faces_are_clustered_and_vote(spark):
    sf = "/root/testdata/sf0.1"
    faces = load(spark, sf, "faces")
    got = QUERIES["v6_a25_face_clusters"](spark, sf).toPandas()
    assert sorted(got["id"]) == sorted(r["id"] for r in faces.select("id").collect()) and got["id"].max() >= 500
    person = {r["id"]: r["person_id"] for r in faces.select("id", "person_id").collect()}
    votes = {}
    for i, c in zip(got["id"], got["cluster"], strict=True):
        if person[i] is not None:
            of = votes.setdefault(c, {})
            of[person[i]] = of.get(person[i], 0) + 1
    want = {}
    for c in sorted(votes):
        free = sorted((-n, p) for p, n in votes[c].items() if p not in want)
        if free:
            want[free[0][1]] = c
    assert {r["person_id"]: r["cluster"] for r in QUERIES["v7_a26_claimed_labels"](spark, sf).collect()} == want


def test_groups_of_a_clustering_are_counted(spark):
    label = {i: i % 7 if i < 30 else 100 + i for i in range(50)}
    df = spark.createDataFrame([(i, 0, c) for i, c in label.items()], "id long, block long, cluster long")
    assert tuple(vectors.cluster_stats(df).first()) == (7, 30, 50)
    assert tuple(vectors.cluster_stats(df.limit(0)).first()) == (0, 0, 0)


def test_extra_copies_of_a_large_group(spark):
    """Copies without a date, at one second and over many days rank as one sorted list does."""
    r = np.random.default_rng(14)
    dates = [None, 0, 40, 86400 * 9] + [int(x) for x in r.integers(1, 10**7, 40)]
    rows = [(i * 90001 % 7000003, f"/p{i % 5}/{'same' if i % 3 else 'other'}.jpg", 5, dates[int(r.integers(0, len(dates)))], 0) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, file_path string, file_size long, creation_date long, is_trashed int")
    want = {}
    for name in ("same.jpg", "other.jpg"):
        own = sorted((x[3] is not None, x[3] or 0, x[0]) for x in rows if x[1].endswith("/" + name))
        want |= {i: n for n, (_, _, i) in enumerate(own, 1) if n > 1}
    assert {x["id"]: x["nth"] for x in aggregates.extra_copies(df).collect()} == want
    groups = aggregates.duplicate_groups(df, 1).collect()
    assert len(groups) == 1 and groups[0]["name"] == "same.jpg" and len(groups[0]["ids"].split("|")) == groups[0]["copies"] == 600


def test_rows_span_the_width(spark):
    got = QUERIES["w6_justified_rows"](spark, SF).toPandas()
    media = load(spark, SF, "media").filter("is_trashed = 0 and is_hidden = 0 and is_ignored = 0")
    assert len(got) == media.count()
    for _, month in got.groupby("month"):
        month = month.sort_values("position")
        assert month["position"].tolist() == list(range(len(month))) and month["row"].is_monotonic_increasing
        assert set(month["row"].diff().fillna(0)) <= {0, 1} and (month.groupby("row")["height"].nunique() == 1).all()
        assert month["height"].between(layout.LEAST, layout.MOST).all()


def test_pins_hold_all_cells(spark):
    cells = aggregates.geo_cells(load(spark, SF, "media"))
    pins = QUERIES["g3_pins"](spark, SF).collect()
    assert sum(p["n"] for p in pins) == cells.agg(F.sum("n")).first()[0] and 0 < len(pins) <= cells.count()


def test_memory_batches_and_their_retirement(spark):
    media = load(spark, SF, "media")
    none = spark.createDataFrame([], "date string, created_at long, expires_at long, custom int")
    fresh = aggregates.memory_batch(media, none).toPandas()
    videos = {r["id"] for r in media.filter("mime_type like 'video/%'").select("id").collect()}
    for _, own in fresh.groupby("place"):
        assert 6 <= len(own) <= 12 and own["id"].is_unique and sum(i in videos for i in own["id"]) <= 3 and not own["stale"].any()
    used = spark.createDataFrame([(d,) for d in fresh["date"].unique()], "date string")
    again = aggregates.memory_batch(media, used).toPandas()
    old = again[again["stale"]]["place"].min()
    assert again[~again["stale"]]["place"].max() <= len(again["place"].unique()) and (len(again[again["stale"]]) == 0 or old > 1)
    now = 1000000
    held = [("a", 10, now + 5, 0), ("b", 10, now - 5, 0), ("c", 10, now - 5, 1)]
    memories = spark.createDataFrame(held, none.schema)
    new = spark.createDataFrame([("x",), ("x",), ("y",)], "date string")
    assert sorted(r["date"] for r in ingest.weekly_batch(memories, new, now).collect()) == ["c", "x", "y"]
    assert sorted(r["date"] for r in ingest.weekly_batch(memories, new.limit(0), now).collect()) == ["a", "b", "c"]
    full = spark.createDataFrame([(str(i), 10, now + 5, 0) for i in range(5)], none.schema)
    assert ingest.weekly_batch(full, new, now).count() == 5


def test_boxes_against_one_at_a_time(spark):
    r = np.random.default_rng(11)
    rows = [(img, *r.uniform(0, 60, 2).tolist(), *r.uniform(5, 30, 2).tolist(), float(n)) for img in range(6) for n in range(25)]

    def share(p, q):
        wide, high = (min(p[k] + p[k + 2], q[k] + q[k + 2]) - max(p[k], q[k]) for k in (1, 2))
        both = max(0, wide) * max(0, high)
        return both / (p[3] * p[4] + q[3] * q[4] - both)

    want = []
    for row in sorted(rows, key=lambda x: -x[5]):
        if all(row[0] != k[0] or share(row, k) <= 0.3 for k in want):
            want.append(row)
    df = spark.createDataFrame(rows, "img long, x double, y double, w double, h double, score double")
    assert sorted(map(tuple, vectors.kept_boxes(df, "img").collect())) == sorted(want)


def test_similarity_transforms_are_recovered(spark):
    r = np.random.default_rng(12)
    rows, made = [], {}
    for k in range(20):
        made[k] = a, b, tx, ty = r.uniform(-3, 3, 4)
        rows += [(k, float(x), float(y), float(a * x - b * y + tx), float(b * x + a * y + ty)) for x, y in r.uniform(-50, 50, (int(r.integers(3, 9)), 2))]
    out = vectors.similarity_transform(spark.createDataFrame(rows, "k long, x double, y double, u double, v double"), "k").collect()
    assert len(out) == 20
    for t in out:
        assert np.allclose([t["a"], t["b"], t["tx"], t["ty"]], made[t["k"]], atol=1e-6)


def test_pins_part_and_meet():
    r = np.random.default_rng(13)
    points = [(float(a), float(b), float(n)) for a, b, n in zip(r.uniform(-60, 60, 80), r.uniform(-170, 170, 80), r.integers(1, 99, 80), strict=True)]
    assert set(layout.pin_groups(points, math.pi)) == {0}
    assert sorted(layout.pin_groups(points, 1e-9)) == list(range(80))
    some = layout.pin_groups(points, 0.3)
    leads = {}
    for i in sorted(range(80), key=lambda i: (-points[i][2], i)):
        leads.setdefault(some[i], i)
    assert list(leads) == list(range(len(leads)))  # groups are numbered as their heaviest points come


def test_colours_over_the_whole_circle(spark):
    """Buckets of vivid, dark and pale colours against hue, saturation and value as the standard library gives them."""
    bounds = [(15, 1), (40, 2), (68, 3), (160, 4), (195, 5), (255, 6), (290, 7), (345, 8), (361, 1)]
    rows = []
    for hue in range(2, 360, 5):
        for sat, value in ((0.95, 0.95), (0.7, 0.5), (0.5, 0.9), (0.1, 0.9), (0.05, 0.5), (1.0, 0.1)):
            if value < 0.16:
                want = 10
            elif sat < 0.16:
                want = 11 if value > 0.86 else 12
            elif value < 0.58 and sat < 0.85 and (hue < 45 or hue >= 345):
                want = 9
            else:
                want = next(n for top, n in bounds if hue < top)
            rows.append((*colorsys.hsv_to_rgb(hue / 360, sat, value), want))
    df = spark.createDataFrame(rows, "r double, g double, b double, want int")
    assert df.filter(colour_bucket(F.col("r"), F.col("g"), F.col("b")) != F.col("want")).count() == 0
    assert len(COLOURS) == 12 and {r[3] for r in rows} == set(range(1, 13))


def test_exif_dates(spark):
    good = [datetime(1900 + 7 * i, 1 + i % 12, 1 + i % 28, i % 24, i % 60, (3 * i) % 60, tzinfo=timezone.utc) for i in range(40)]
    rows = [(t.strftime(f), int(t.timestamp())) for t in good for f in ("%Y:%m:%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S")]
    rows += [(t, None) for t in ("", "1899:12:31 23:59:59", "2201:01:01 00:00:00", "2011:02:30 08:00:00", "2011:04:09", "2011:04:09 25:00:00", "soon", None)]
    df = spark.createDataFrame(rows, "t string, want long")
    assert df.filter(~exif_seconds(F.col("t")).eqNullSafe(F.col("want"))).count() == 0


def ifd(order, at, entries, tail=b""):
    """A TIFF directory of (tag, kind, n, value) that starts at ``at``; values over four bytes follow it."""
    out, extra = struct.pack(order + "H", len(entries)), b""
    place = at + 2 + 12 * len(entries) + 4
    for tag, kind, n, value in entries:
        if isinstance(value, int):
            value = struct.pack(order + ("H" if kind == 3 else "I"), value)
        if len(value) > 4:
            extra, value = extra + value, struct.pack(order + "I", place + len(extra))
        out += struct.pack(order + "HHI", tag, kind, n) + value.ljust(4, b"\0")
    return out + b"\0\0\0\0" + extra


def tiff(order=">", turned=8, taken="2017:11:30 06:45:10", lat=(59, 20, 15.5), lon=(18, 3, 54.25), size=(2592, 1944)):
    """A picture from Stockholm: the first directory, then the Exif and the place directory."""
    def parts(x):
        return struct.pack(order + "6I", x[0], 1, x[1], 1, int(x[2] * 400), 400)

    head = (b"MM\0*" if order == ">" else b"II*\0") + struct.pack(order + "I", 8)
    top = [(0x112, 3, 1, turned), (0x8769, 4, 1, 0), (0x8825, 4, 1, 0)]
    first = len(ifd(order, 8, top))
    exif = [(0x9003, 2, len(taken) + 1, taken.encode() + b"\0"), (0xA002, 4, 1, size[0]), (0xA003, 4, 1, size[1])]
    place = [(1, 2, 2, b"N\0"), (2, 5, 3, parts(lat)), (3, 2, 2, b"E\0"), (4, 5, 3, parts(lon))]
    exif_at = 8 + first
    place_at = exif_at + len(ifd(order, exif_at, exif))
    top[1], top[2] = (0x8769, 4, 1, exif_at), (0x8825, 4, 1, place_at)
    return head + ifd(order, 8, top) + ifd(order, exif_at, exif) + ifd(order, place_at, place)


@pytest.mark.parametrize("order", [">", "<"])
def test_exif_blocks(order):
    got = headers.parsed(tiff(order))
    assert (got["orientation"], got["taken"], got["width"], got["height"]) == (8, "2017:11:30 06:45:10", 2592, 1944)
    assert abs(got["lat"] - (59 + 20 / 60 + 15.5 / 3600)) < 1e-9 and abs(got["lon"] - (18 + 3 / 60 + 54.25 / 3600)) < 1e-9


def box(kind, body):
    return struct.pack(">I4s", 8 + len(body), kind) + body


def film(length=45, scale=1000, place=b"-41.2865+174.7762/", turned=True, wide=1280, high=720):
    turn = (0, 65536, 0, -65536, 0, 0, 0, 0, 1 << 30) if turned else (65536, 0, 0, 0, 65536, 0, 0, 0, 1 << 30)
    tkhd = b"\0" * 40 + struct.pack(">9i", *turn) + struct.pack(">II", wide << 16, high << 16)
    mvhd = struct.pack(">5I", 0, 0, 0, scale, length * scale) + b"\0" * 80
    said = box(b"\xa9xyz", struct.pack(">HH", len(place), 0x15C7) + place)
    return box(b"ftyp", b"mp42\0\0\0\0") + box(b"free", b"") + box(b"moov", box(b"mvhd", mvhd) + box(b"trak", box(b"tkhd", tkhd)) + box(b"udta", said))


def png(wide, high, *chunks):
    body = b"".join(struct.pack(">I4s", len(b), k) + b + b"\0" * 4 for k, b in ((b"IHDR", struct.pack(">II", wide, high) + b"\x08\x06\0\0\0"), *chunks))
    return b"\x89PNG\r\n\x1a\n" + body


def webp(kind, body, *chunks):
    body = b"".join(struct.pack("<4sI", k, len(b)) + b + b"\0" * (len(b) % 2) for k, b in ((kind, body), *chunks))
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WEBP" + body


def media_files():
    exif = b"Exif\0\0" + tiff("<", turned=3)
    return {
        "p.png": png(1001, 77, (b"eXIf", tiff(">", turned=6))),
        "g.gif": b"GIF87a" + struct.pack("<HH", 31, 13) + b"\0" * 6,
        "up.bmp": b"BM" + b"\0" * 16 + struct.pack("<ii", 19, 23) + b"\0" * 4,
        "down.bmp": b"BM" + b"\0" * 16 + struct.pack("<ii", 19, -23) + b"\0" * 4,
        "x.webp": webp(b"VP8X", b"\x08\0\0\0" + (299).to_bytes(3, "little") + (199).to_bytes(3, "little"), (b"EXIF", exif)),
        "l.webp": webp(b"VP8L", b"/" + struct.pack("<I", 511 | 255 << 14 | 1 << 31)),
        "j.jpg": b"\xff\xd8\xff\xe1" + struct.pack(">H", 2 + len(exif)) + exif + b"\xff\xc2\0\x11\x08" + struct.pack(">HH", 345, 678) + b"\0" * 10,
        "t.tif": tiff(),
        "m.mp4": film(),
        "i.heic": heic(1),
        "c.mov": camera_film(),
    }


def heic(turns, small=(160, 120), large=(3024, 4032), base=0):
    """A picture with a thumbnail's size, a turn, and an Exif item of which iinf and iloc tell."""
    exif = struct.pack(">I", 6) + b"Exif\0\0" + tiff("<", turned=1)
    sizes = b"".join(box(b"ispe", b"\0" * 4 + struct.pack(">II", *s)) for s in (large, small))
    props = box(b"iprp", box(b"ipco", sizes + box(b"irot", bytes([turns]))))
    entries = box(b"infe", b"\2\0\0\0" + struct.pack(">HH", 1, 0) + b"hvc1\0") + box(b"infe", b"\2\0\0\0" + struct.pack(">HH", 9, 0) + b"Exif\0")
    info = box(b"iinf", b"\0" * 4 + struct.pack(">H", 2) + entries)

    def whole(at):
        rows = struct.pack(">HHHIHII", 1, 0, 0, 0, 1, 5, 5) + struct.pack(">HHHIHII", 9, 0, 0, base, 1, at - base, len(exif))
        loc = box(b"iloc", b"\1\0\0\0" + bytes([0x44, 0x40]) + struct.pack(">H", 2) + rows)
        return box(b"ftyp", b"heic\0\0\0\0") + box(b"meta", b"\0" * 4 + info + loc + props) + box(b"mdat", exif)

    return whole(len(whole(base)) - len(exif))


def camera_film():
    """A film whose first track is sound and whose keys tell place and local time."""
    def track(kind, wide, high):
        tkhd = b"\0" * 40 + struct.pack(">9i", 65536, 0, 0, 0, 65536, 0, 0, 0, 1 << 30) + struct.pack(">II", wide << 16, high << 16)
        return box(b"trak", box(b"tkhd", tkhd) + box(b"mdia", box(b"hdlr", b"\0" * 8 + kind + b"\0" * 12)))

    names = (b"com.apple.quicktime.make", b"com.apple.quicktime.creationdate", b"com.apple.quicktime.location.ISO6709")
    keys = box(b"keys", struct.pack(">II", 0, 3) + b"".join(struct.pack(">I4s", 8 + len(n), b"mdta") + n for n in names))
    said = (b"Someone", b"2019-08-24T21:15:42+0900", b"-33.8568+151.2153/")
    values = box(b"ilst", b"".join(box(struct.pack(">I", i), box(b"data", struct.pack(">II", 1, 0) + v)) for i, v in enumerate(said, 1)))
    mvhd = struct.pack(">5I", 0, 3649233342, 0, 90000, 1125000) + b"\0" * 80
    meta = box(b"meta", box(b"hdlr", b"\0" * 8 + b"mdta" + b"\0" * 12) + keys + values)
    return box(b"ftyp", b"qt  \0\0\0\0") + box(b"moov", box(b"mvhd", mvhd) + track(b"soun", 5, 6) + track(b"vide", 3840, 2160) + track(b"vide", 90, 60) + meta)


def test_items_and_keys(spark):
    more = {"flat.heic": heic(2), "turned.heic": heic(3, base=7), "far.heic": heic(1)[:-40], "c.mov": camera_film()}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in more.items()], "path string, content binary")
    got = {r["path"]: r for r in headers.probed(df).collect()}
    assert {k: (r["width"], r["height"]) for k, r in got.items()} == {"flat.heic": (3024, 4032), "turned.heic": (4032, 3024), "far.heic": (4032, 3024), "c.mov": (3840, 2160)}
    assert got["far.heic"]["lat"] is None
    for k in ("flat.heic", "turned.heic"):
        assert (got[k]["taken"], got[k]["orientation"]) == ("2017:11:30 06:45:10", 1) and abs(got[k]["lat"] - 59.3376389) < 1e-6
    film_row = got["c.mov"]
    assert (film_row["taken"], film_row["seconds"]) == ("2019-08-24 21:15:42", 12.5)
    assert abs(film_row["lat"] + 33.8568) < 1e-9 and abs(film_row["lon"] - 151.2153) < 1e-9


def test_headers_of_files(spark):
    more = {"odd.jpg": b"\xff\xd8\xff\xe0", "x.bin": b"of no kind", "none": b"", "huge.png": png(2**31, 5), "huge.bmp": b"BM" + b"\xff" * 40}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in (media_files() | more).items()] + [("null", None)], "path string, content binary")
    got = {r["path"]: r for r in headers.probed(df).collect()}
    sizes = {k: (r["width"], r["height"]) for k, r in got.items()}
    assert sizes == {
        "p.png": (1001, 77), "g.gif": (31, 13), "up.bmp": (19, 23), "down.bmp": (19, 23), "x.webp": (300, 200), "l.webp": (512, 256), "j.jpg": (678, 345), "t.tif": (2592, 1944), "m.mp4": (720, 1280), "i.heic": (4032, 3024), "c.mov": (3840, 2160),
        "odd.jpg": (None, None), "huge.png": (None, 5), "huge.bmp": (None, 1),
    }
    assert {k: r["orientation"] for k, r in got.items() if r["orientation"]} == {"p.png": 6, "x.webp": 3, "j.jpg": 3, "t.tif": 8, "i.heic": 1}
    assert all(got[k]["taken"] == "2017:11:30 06:45:10" and abs(got[k]["lon"] - 18.0650694) < 1e-6 for k in ("p.png", "x.webp", "j.jpg", "t.tif"))
    assert got["m.mp4"]["seconds"] == 45 and abs(got["m.mp4"]["lat"] + 41.2865) < 1e-9


def test_damaged_files_give_nulls(spark):
    """Every file cut short anywhere, and with all bits of any four bytes set, gives a row or none, never an error."""
    rows = []
    for name, data in media_files().items():
        rows += [(f"{name}-{n}", bytearray(data[:n])) for n in range(len(data))]
        rows += [(f"{name}+{n}", bytearray(data[:n] + b"\xff" * 4 + data[n + 4 :])) for n in range(len(data) - 3)]
    got = headers.probed(spark.createDataFrame(rows, "path string, content binary")).collect()
    assert 0 < len(got) <= len(rows) and len({r["path"] for r in got}) == len(got)


def test_listing(spark, tmp_path):
    for name in ("a/1.JPG", "a/b/2.png", "a/b/c/3.heic", "d/5.mp4", "d/readme", "skip/4.jpg", "d/note.txt"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("some text")
    found = files.with_extension(files.listing(spark, str(tmp_path)), "path").filter("not contains(path, '/skip/')")
    assert sorted(r["path"].split(str(tmp_path))[1] for r in found.collect()) == ["/a/1.JPG", "/a/b/2.png", "/a/b/c/3.heic", "/d/5.mp4"]
    docs = files.text_files(spark, str(tmp_path))
    assert [r["text"] for r in docs.collect()] == ["some text"]


def test_upsert_is_idempotent_and_keeps_flags(spark):
    media = load(spark, SF, "media").limit(200).cache()
    new = media.filter("id % 2 = 0").withColumn("file_size", F.lit(5).cast("long")).select("file_path", *dml.METADATA)
    once = dml.upsert_media(media, new)
    twice = dml.upsert_media(once, new)
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    assert once.count() == media.count()
    added = new.withColumn("file_path", F.concat(F.lit("/more/"), F.coalesce("mime_type", F.lit("none")), F.col("file_path")))
    top = media.agg(F.max("id")).first()[0]
    more = dml.upsert_media(media, added).filter("file_path like '/more/%'").orderBy("file_path").collect()
    assert sorted(r["id"] for r in more) == list(range(top + 1, top + 1 + added.distinct().count()))
    assert once.agg(F.sum("is_favorite")).first()[0] == media.agg(F.sum("is_favorite")).first()[0]


def test_stream_upserts_and_replays(spark, tmp_path):
    media = load(spark, SF, "media").limit(100)
    state = str(tmp_path / "state-0")
    media.write.parquet(state)
    place = [state]
    arrivals = tmp_path / "in"
    new = media.filter("id % 3 = 0").withColumn("file_size", F.lit(7).cast("long")).select("file_path", *dml.METADATA)
    new.write.parquet(str(arrivals))

    def write(df, number):
        place.append(str(tmp_path / f"state-{number + 1}"))
        df.write.mode("overwrite").parquet(place[-1])

    stream = ingest.arrivals(spark, str(arrivals), new.schema)
    ingest.drain(ingest.into_library(stream, lambda: spark.read.parquet(place[-1]), write, str(tmp_path / "ckpt")))
    out = spark.read.parquet(place[-1])
    assert out.count() == 100 and out.filter("file_size = 7").count() == new.count()
    n = len(place)
    ingest.drain(ingest.into_library(ingest.arrivals(spark, str(arrivals), new.schema), lambda: spark.read.parquet(place[-1]), write, str(tmp_path / "ckpt")))
    assert len(place) == n  # nothing new, nothing done


def test_only_pending_rows_are_handled(spark, tmp_path):
    rows = spark.createDataFrame([(f"/f{i}",) for i in range(10)], "file_path string")
    rows.write.parquet(str(tmp_path / "in"))
    seen = []
    done = rows.filter("file_path < '/f4'")
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    ingest.drain(ingest.pending_only(stream, lambda: done, lambda df, n: seen.extend(r["file_path"] for r in df.collect()), str(tmp_path / "c")))
    assert sorted(seen) == [f"/f{i}" for i in range(4, 10)]


def test_streaming_windows_equal_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    batch = {(r["start"], r["event_type"]): r["n"] for r in ingest.activity(events).collect()}
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    writer = ingest.activity(stream).writeStream.format("memory").queryName("activity").outputMode("complete").option("checkpointLocation", out)
    ingest.drain(writer)
    assert {(r["start"], r["event_type"]): r["n"] for r in spark.table("activity").collect()} == batch


def test_search_reads_the_names_of_all_people(spark):
    media, faces, analysis, cities = (load(spark, SF, t) for t in ("media", "faces", "analysis", "cities"))
    rows = [(i, f"May N{i}", 0) for i in range(300)] + [(300, "  May Red ", 0), (301, "May Blue", 1)]
    persons = spark.createDataFrame(rows, "id long, name string, hidden int").coalesce(1)
    places = cities.limit(0).select("id", F.col("name").alias("city"), "country")
    ids = [{r["id"] for r in search.search(media, q, persons, faces, analysis, places).collect()} for q in ("may", "May  RED", "may blue", "MAY red blue")]
    assert ids[0] and ids[0] == ids[1] and ids[2] < ids[0] and ids[3] == ids[2]


def test_places_of_a_whole_table(spark):
    """Places equal a sort's for few and many blocks, with nulls, ties, mixed directions and one value that half of the rows hold."""
    r = np.random.default_rng(21)
    rows = [(i, None if i % 11 == 0 else 5 if i % 2 else int(r.integers(0, 40)), None if i % 7 == 0 else "abc"[i % 3] * (i % 4)) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, n int, s string")
    for up in (True, False):
        def sizes(x, up=up):
            n = (x[1] is not None, x[1] or 0)
            return (n if up else (-n[0], -n[1]), x[0] if not up else -x[0])

        want = {x[0]: i for i, x in enumerate(sorted(rows, key=lambda x: (x[2] is not None, x[2] or "", *sizes(x))), 1)}
        keys = [(F.col("s"), True), (F.col("n"), up), (F.col("id"), not up)]
        for block_rows in (100_000, 600, 64):
            assert {x["id"]: x["place"] for x in sorting.placed(df, keys, block_rows).collect()} == want
    assert sorting.placed(df.limit(0), [(F.col("id"), True)]).count() == 0


def test_decks_are_dealt_in_turn(spark):
    rows = [(i, "x" if i % 3 else "yz"[i % 2], i * 7919 % 101) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, deck string, score long")
    decks = {d: [x[0] for x in sorted(rows, key=lambda x: (-x[2], x[0])) if x[1] == d] for d in "xyz"}
    want = [d[n] for n in range(400) for d in decks.values() if n < len(d)]
    got = windows.interleaved(df, "deck", [(F.col("score"), False), (F.col("id"), True)]).orderBy("place").collect()
    assert [x["id"] for x in got] == want and [x["place"] for x in got] == list(range(1, 401))


def test_chunks_of_whole_texts(spark):
    texts = ["", "a", "x" * 629, "x" * 630, "y" * 631, "".join(chr(97 + i % 26) for i in range(40320)), "\U0001f4f7\u00e9b" * 60000, None]
    got = {r["i"]: r["c"] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", chunks(F.col("t")).alias("c")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == [t[at : at + 700] for at in range(0, len(t or ""), 630)]
    assert spark.createDataFrame([("z" * 90000,)], "t string").select(F.size(chunks(F.col("t"), most=20))).first()[0] == 20


def test_long_lists_are_refused(spark):
    with pytest.raises(ValueError):
        small_list(spark.range(2000), "id")


def test_values_and_times_carried_over_blocks(spark):
    """Last marks and clip starts equal those of one pass over each group, however groups fall into blocks."""
    r = np.random.default_rng(22)
    rows = [(i, None if i % 13 == 0 else "ab"[int(r.integers(0, 40) == 0)], f"m{i}" if r.integers(0, 30) == 0 else None, float(r.integers(2, 9))) for i in range(900)]
    df = spark.createDataFrame(rows, "position long, folder string, mark string, seconds double").repartition(5)
    last, start, marks, starts = {}, {}, {}, {}
    for i, folder, mark, seconds in rows:
        last[folder] = mark or last.get(folder)
        marks[i], starts[i] = last[folder], start.get(folder, 0.0)
        start[folder] = starts[i] + seconds - 0.5
    for block_rows in (10_000, 100, 37):
        got = windows.carried_forward(df, [(F.col("position"), True)], "mark", "folder", "header", block_rows)
        assert {x["position"]: x["header"] for x in got.collect()} == marks
        got = windows.clip_timeline(df, "folder", 0.5, block_rows)
        assert {x["position"]: x["start"] for x in got.collect()} == starts
    assert windows.clip_timeline(df.limit(0), "folder").count() == 0
