"""Queries on land masks and simplified lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from shutterlake.operators import regions

from .registry import query

WIDTH, HEIGHT = 14400, 7200
#: Whether the middle of a cell (cx, cy) lies inside a region, by the edges of its ring.
EDGES = "e AS (SELECT a.region, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM shores a JOIN shores b ON b.region = a.region AND b.n = (a.n + 1) % 6)"
INSIDE = "COUNT(*) FILTER (WHERE (y1 > cy) <> (y2 > cy) AND x1 + (cy - y1) * (x2 - x1) / (y2 - y1) <= cx) % 2 = 1"
MIDDLE = f"-180.0::DOUBLE + (col + 0.5::DOUBLE) * 360.0::DOUBLE / {WIDTH} AS cx, 90.0::DOUBLE - (row + 0.5::DOUBLE) * (180.0::DOUBLE / {HEIGHT}) AS cy"


@query(
    "shores",
    sql=f"""WITH {EDGES}, b AS (SELECT region, MIN(x1) AS w, MAX(x1) AS o, MIN(y1) AS s, MAX(y1) AS n FROM e GROUP BY region),
    k AS (SELECT region, row, UNNEST(RANGE(FLOOR((w + 180) / 360 * {WIDTH})::BIGINT - 2, FLOOR((o + 180) / 360 * {WIDTH})::BIGINT + 3)) AS col FROM (SELECT *, UNNEST(RANGE(FLOOR((90 - n) / 180 * {HEIGHT})::BIGINT - 2, FLOOR((90 - s) / 180 * {HEIGHT})::BIGINT + 3)) AS row FROM b) t),
    i AS (SELECT k.region, row, col FROM (SELECT *, {MIDDLE} FROM k) k JOIN e ON e.region = k.region GROUP BY k.region, row, col, cx, cy HAVING {INSIDE})
    SELECT region, row, MIN(col) AS first, MAX(col) AS last FROM (SELECT *, col - ROW_NUMBER() OVER (PARTITION BY region, row ORDER BY col) AS island FROM i) t GROUP BY region, row, island""",
)
def g7_land_runs(shores):
    """The mask of all regions, as runs of cells; the oracle tests the middle of every cell."""
    return regions.runs(shores, WIDTH, HEIGHT)


@query(
    "media",
    "shores",
    sql=f"""WITH {EDGES}, c AS (SELECT DISTINCT GREATEST(0, LEAST({HEIGHT - 1}, FLOOR((90 - latitude) / 180 * {HEIGHT})::BIGINT)) AS row, FLOOR((longitude + 180) / 360 * {WIDTH})::BIGINT % {WIDTH} AS col FROM media WHERE latitude IS NOT NULL),
    i AS (SELECT row, col, region FROM (SELECT *, {MIDDLE} FROM c) c, e GROUP BY row, col, cx, cy, region HAVING {INSIDE}),
    l AS (SELECT DISTINCT row, col FROM i)
    SELECT id, CASE WHEN latitude IS NOT NULL THEN l.row IS NOT NULL END AS land FROM media LEFT JOIN l ON l.row = GREATEST(0, LEAST({HEIGHT - 1}, FLOOR((90 - latitude) / 180 * {HEIGHT})::BIGINT)) AND l.col = FLOOR((longitude + 180) / 360 * {WIDTH})::BIGINT % {WIDTH}""",
)
def f40_points_on_land(media, shores):
    return regions.on_land(media, regions.runs(shores, WIDTH, HEIGHT), WIDTH, HEIGHT).select("id", "land")


#: Lines of 2000 samples cut in pieces of 250; the squared distance of v from the line through a and b, times the squared length.
FAR = "CASE WHEN a.x = b.x AND a.y = b.y THEN (v.x - a.x) ** 2 + (v.y - a.y) ** 2 ELSE ((b.x - a.x) * (v.y - a.y) - (b.y - a.y) * (v.x - a.x)) ** 2 END"
SIZE = "CASE WHEN a.x = b.x AND a.y = b.y THEN 1 ELSE (b.x - a.x) ** 2 + (b.y - a.y) ** 2 END"


@query(
    "samples",
    sql=f"""WITH RECURSIVE v AS (SELECT idx // 2000 AS line, idx % 2000 AS n, idx::DOUBLE AS x, FLOOR(s / 256.0::DOUBLE) AS y FROM samples),
    g AS (SELECT line, n AS lo, LEAST(n + 250, (SELECT MAX(n) FROM v w WHERE w.line = v.line)) AS hi FROM v WHERE n % 250 = 0 AND n < (SELECT MAX(n) FROM v w WHERE w.line = v.line)),
    r AS (SELECT line, lo, hi FROM g UNION ALL
      SELECT line, CASE side WHEN 0 THEN lo ELSE m END, CASE side WHEN 0 THEN m ELSE hi END FROM (
        SELECT line, lo, hi, m FROM (
          SELECT r.line, r.lo, r.hi, v.n AS m, {FAR} AS far, {SIZE} AS size, ROW_NUMBER() OVER (PARTITION BY r.line, r.lo, r.hi ORDER BY {FAR} DESC, v.n) AS nth
          FROM r JOIN v a ON a.line = r.line AND a.n = r.lo JOIN v b ON b.line = r.line AND b.n = r.hi JOIN v ON v.line = r.line AND v.n > r.lo AND v.n < r.hi) t
        WHERE nth = 1 AND far > 40.0 * 40.0 * size) u, (VALUES (0), (1)) s(side)),
    k AS (SELECT line, lo AS n FROM r UNION SELECT line, hi FROM r UNION SELECT line, n FROM v WHERE n % 250 = 0)
    SELECT k.line, k.n, v.x, v.y FROM k JOIN v ON v.line = k.line AND v.n = k.n""",
)
def g7_simplified_lines(samples):
    """Waveforms of 2000 samples as lines of as few vertices as a tolerance of 40 allows."""
    lines = samples.select(F.floor(F.col("idx") / 2000).alias("line"), (F.col("idx") % 2000).alias("n"), F.col("idx").cast("double").alias("x"), F.floor(F.col("s") / 256).cast("double").alias("y"))
    return regions.simplified(lines, 40.0, 250)
