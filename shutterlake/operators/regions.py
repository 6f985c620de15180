"""Land masks of polygons as runs of grid cells, and simplified lines.

A mask is a table of runs: in a row of the grid the cells first..last of a region
are land. Runs come from where the edges of a region cross the middle of a row
(even-odd rule), so a polygon is never in one task as a whole. Points are looked
up by their cell: distinct cells meet the runs of their row by buckets of columns.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells of a row that a bucket of the lookup spans; vertices of a piece of a line.
BUCKET, PIECE = 256, 1000


def edges(rings: DataFrame) -> DataFrame:
    """region, x1, y1, x2, y2 for rings (region, ring, n, x, y) whose vertices n = 0, 1, ... close by themselves."""
    size = rings.groupBy("region", "ring").agg(F.max("n").alias("_last"))
    start = rings.join(size, ["region", "ring"]).withColumn("_next", F.when(F.col("n") == F.col("_last"), 0).otherwise(F.col("n") + 1))
    end = rings.select("region", "ring", F.col("n").alias("_next"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return start.join(end, ["region", "ring", "_next"]).select("region", F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2")


def row_middle(row: Column, height: int) -> Column:
    return F.lit(90.0) - (row + F.lit(0.5)) * (180.0 / height)


def column_middle(col: Column, width: int) -> Column:
    return F.lit(-180.0) + (col + F.lit(0.5)) * F.lit(360.0) / width


def cell(lat: Column, lon: Column, width: int, height: int) -> tuple[Column, Column]:
    """(row, column) of a point; rows end at the poles, columns go round."""
    row = F.floor((F.lit(90.0) - lat) / 180.0 * height).cast("long")
    col = F.floor((lon + F.lit(180.0)) / 360.0 * width).cast("long")
    row = F.when(row.isNotNull(), F.greatest(F.lit(0).cast("long"), F.least(F.lit(height - 1).cast("long"), row)))  # these two skip nulls
    return row, F.pmod(col, F.lit(width).cast("long"))


def runs(rings: DataFrame, width: int, height: int) -> DataFrame:
    """region, row, first, last: the runs of cells whose middles lie inside a region (x: longitude, y: latitude).

    An edge toggles a row at the first cell whose middle is not west of where it
    crosses. Two toggles of one cell cancel out. A region has at most
    ``width`` + 1 toggles in a row, which one window orders.
    """
    e = edges(rings).filter("y1 <> y2")
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    top = F.greatest(F.lit(0), F.floor((F.lit(90.0) - high) / 180.0 * height).cast("int") - 1)
    bottom = F.least(F.lit(height - 1), F.floor((F.lit(90.0) - low) / 180.0 * height).cast("int") + 1)
    e = e.withColumn("row", F.explode(F.sequence(top, F.greatest(top, bottom)))).withColumn("_c", row_middle(F.col("row"), height))
    e = e.filter((F.col("y1") > F.col("_c")) != (F.col("y2") > F.col("_c")))
    x = F.col("x1") + (F.col("_c") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    guess = F.ceil((x + F.lit(180.0)) / 360.0 * width - F.lit(0.5)).cast("int")
    e = e.select("region", "row", x.alias("_x"), guess.alias("_at"))
    # the guess is rounded; the middles of cells decide
    at = F.when(column_middle(F.col("_at") - 1, width) >= F.col("_x"), F.col("_at") - 1).when(column_middle(F.col("_at"), width) < F.col("_x"), F.col("_at") + 1).otherwise(F.col("_at"))
    toggles = e.select("region", "row", F.greatest(F.lit(0), at).alias("first")).groupBy("region", "row", "first").agg(F.count(F.lit(1)).alias("_n")).filter((F.col("_n") % 2 == 1) & (F.col("first") < width))
    order = Window.partitionBy("region", "row").orderBy("first")
    toggles = toggles.select("region", "row", "first", (F.coalesce(F.lead("first").over(order), F.lit(width)) - 1).alias("last"), F.row_number().over(order).alias("_nth"))
    return toggles.filter("_nth % 2 = 1").drop("_nth")


def on_land(points: DataFrame, mask: DataFrame, width: int, height: int, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """``points`` with ``land``: whether the cell of a point is in a run of any region; null without a place.

    Distinct cells are looked up, so a place with very many points asks once.
    """
    row, col = cell(F.col(lat), F.col(lon), width, height)
    rows = points.withColumns({"_row": row, "_col": col})
    cells = rows.filter(F.col("_row").isNotNull() & F.col("_col").isNotNull()).select("_row", "_col").distinct().withColumn("_b", F.floor(F.col("_col") / BUCKET))
    spread = mask.select(F.col("row").cast("long").alias("_row"), "first", "last", F.explode(F.sequence(F.floor(F.col("first") / BUCKET), F.floor(F.col("last") / BUCKET))).alias("_b"))
    near = cells.join(spread, ["_row", "_b"]).filter(F.col("_col").between(F.col("first"), F.col("last")))
    land = near.select("_row", "_col").distinct().withColumn("_land", F.lit(True))
    known = F.col("_row").isNotNull() & F.col("_col").isNotNull()
    return rows.join(land, ["_row", "_col"], "left").withColumn("land", F.when(known, F.coalesce("_land", F.lit(False)))).drop("_row", "_col", "_land")


def kept_vertices(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Which vertices Douglas-Peucker keeps: of a stretch the farthest from the line through its ends (the first of equals), if beyond the tolerance."""
    keep = np.zeros(len(x), bool)
    keep[[0, -1]] = True
    stack = [(0, len(x) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        dx, dy = x[b] - x[a], y[b] - y[a]
        px, py = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a]
        size = dx * dx + dy * dy
        far = (dx * py - dy * px) ** 2 if size else px * px + py * py
        m = int(np.argmax(far))
        if far[m] > tolerance * tolerance * (size or 1):
            keep[a + 1 + m] = True
            stack += [(a, a + 1 + m), (a + 1 + m, b)]
    return keep


def simplified(lines: DataFrame, tolerance: float, piece: int = PIECE) -> DataFrame:
    """The rows of lines (line, n, x, y; n = 0, 1, ...) that stay within ``tolerance`` of the lines without the others.

    Every ``piece``-th vertex is kept and cuts its line, so a task holds
    ``piece`` + 1 vertices, whatever the length of a line.
    """
    both = F.when((F.col("n") > 0) & (F.col("n") % piece == 0), F.array(F.col("n") / piece - 1, F.col("n") / piece)).otherwise(F.array(F.floor(F.col("n") / piece)))
    parts = lines.select("line", "n", "x", "y", F.explode(F.transform(both, lambda b: b.cast("long"))).alias("_part"))

    def work(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("n")
        keep = kept_vertices(part["x"].to_numpy(float), part["y"].to_numpy(float), tolerance)
        return part.loc[keep, ["line", "n", "x", "y"]]

    kinds = dict(lines.dtypes)
    kept = parts.groupBy("line", "_part").applyInPandas(work, ", ".join(f"{c} {kinds[c]}" for c in ("line", "n", "x", "y")))
    return kept.distinct()  # cuts come from both sides
