"""Land masks against point-in-polygon, and simplified lines against a plain procedure."""

import random

import numpy as np
from pyspark.sql import functions as F

from shutterlake.operators import regions


def inside(x, y, ring):
    out = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (y1 > y) != (y2 > y) and x1 + (y - y1) * (x2 - x1) / (y2 - y1) <= x:
            out = not out
    return out


def test_masks_of_random_rings(spark):
    r = random.Random(3)
    width, height = 72, 36
    shapes = {k: [[(r.uniform(-179, 179), r.uniform(-89, 89)) for _ in range(r.randint(3, 9))] for _ in range(r.randint(1, 3))] for k in range(12)}
    shapes[12] = [[(-180.0, -90.0), (180.0, -90.0), (180.0, 90.0), (-180.0, 90.0)]]  # the whole world
    shapes[13] = [[(-50.0, 10.0), (50.0, 10.0), (50.0, 10.0), (-50.0, 10.0)]]  # flat
    rows = [(k, i, n, x, y) for k, rings in shapes.items() for i, ring in enumerate(rings) for n, (x, y) in enumerate(ring)]
    rings = spark.createDataFrame(rows, "region int, ring int, n int, x double, y double")
    mask = regions.runs(rings, width, height).collect()
    land = {(m["region"], m["row"], c) for m in mask for c in range(m["first"], m["last"] + 1)}
    for k, shape in shapes.items():
        for row in range(height):
            for col in range(width):
                x, y = -180 + (col + 0.5) * 360 / width, 90 - (row + 0.5) * (180 / height)
                assert ((k, row, col) in land) == (sum(inside(x, y, ring) for ring in shape) % 2 == 1)
    assert len({(m["region"], m["row"], m["first"]) for m in mask}) == len(mask)
    points = [(i, r.uniform(-90, 90), r.uniform(-180, 180)) for i in range(300)] + [(900, None, 3.0), (901, 3.0, None), (902, 90.0, 180.0), (903, -90.0, -180.0), (904, 10.0, 540.0)]
    some = rings.filter("region < 4")
    got = regions.on_land(spark.createDataFrame(points, "id int, latitude double, longitude double"), regions.runs(some, width, height), width, height).collect()
    assert len(got) == len(points)
    for p in got:
        if p["id"] in (900, 901):
            assert p["land"] is None
            continue
        row, col = min(height - 1, max(0, int((90 - p["latitude"]) // (180 / height)))), int((p["longitude"] + 180) // (360 / width)) % width
        assert p["land"] == any((k, row, col) in land for k in range(4))


def plain(points, tolerance):
    """Douglas-Peucker by recursion: indices that stay."""
    def go(a, b):
        (x1, y1), (x2, y2) = points[a], points[b]
        size = (x2 - x1) ** 2 + (y2 - y1) ** 2
        best, at = 0.0, None
        for i in range(a + 1, b):
            px, py = points[i][0] - x1, points[i][1] - y1
            far = ((x2 - x1) * py - (y2 - y1) * px) ** 2 if size else px * px + py * py
            if far > best:
                best, at = far, i
        return go(a, at) | go(at, b) if at is not None and best > tolerance**2 * (size or 1) else {a, b}

    return go(0, len(points) - 1)


def test_lines_keep_what_a_plain_version_keeps(spark):
    r = np.random.default_rng(5)
    lines = {k: np.cumsum(r.integers(-9, 10, size=(n, 2)), axis=0).astype(float) for k, n in enumerate([1, 2, 3, 50, 51, 101, 230, 500])}
    lines[20] = np.zeros((120, 2))  # one place
    rows = [(k, n, float(x), float(y)) for k, line in lines.items() for n, (x, y) in enumerate(line)]
    df = spark.createDataFrame(rows, "line int, n int, x double, y double").repartition(3)
    for tolerance, piece in ((6.0, 1000), (6.0, 50), (0.0, 50)):
        got = {}
        for x in regions.simplified(df, tolerance, piece).collect():
            got.setdefault(x["line"], []).append(x["n"])
        for k, line in lines.items():
            want = set()
            for a in range(0, max(1, len(line) - 1), piece):
                part = line[a : a + piece + 1].tolist()
                want |= {a + i for i in plain(part, tolerance)}
            kept = sorted(got[k])
            assert kept == sorted(want) and len(set(kept)) == len(kept)
            for a, b in zip(kept, kept[1:], strict=False):  # what is dropped lies within the tolerance of the line that stays
                d = line[b] - line[a]
                for i in range(a + 1, b):
                    p = line[i] - line[a]
                    far = abs(d[0] * p[1] - d[1] * p[0]) / np.hypot(*d) if d.any() else np.hypot(*p)
                    assert far <= tolerance + 1e-9
    assert regions.simplified(df.limit(0), 1.0).count() == 0 and df.filter(F.col("line") == 0).count() == 1
