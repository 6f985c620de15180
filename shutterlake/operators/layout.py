"""Stateful layouts that no window expresses: justified rows and pin clusters."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAP, LEAST, MOST = 6.0, 140.0, 520.0


def justified_rows(items: DataFrame, width: float, target: float = 260.0) -> DataFrame:
    """month, position, row, height: rows are filled until their pictures at the target height span the width.

    items: month, position, ratio. A month is one group; a library's month fits a task.
    """

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("position").reset_index(drop=True)
        rows, heights, start, total = [], [], 0, 0.0
        for i, ratio in enumerate(frame["ratio"]):
            total += ratio
            rows.append(len(heights))
            gaps = GAP * (i - start)
            if total * target + gaps >= width:
                heights.append(min(MOST, max(LEAST, (width - gaps) / total)))
                start, total = i + 1, 0.0
        if start < len(frame):
            heights.append(target)
        return pd.DataFrame({"month": frame["month"], "position": frame["position"], "row": rows, "height": [heights[r] for r in rows]})

    return items.groupBy("month").applyInPandas(fill, "month string, position long, row long, height double")


def pin_groups(points: list[tuple[float, float, float]], reach: float) -> list[int]:
    """Group of each point (lat, lon, weight): heaviest first, a point joins the first group within ``reach`` radians."""

    def vector(lat: float, lon: float) -> tuple[float, float, float]:
        a, b = math.radians(lat), math.radians(lon)
        return math.cos(a) * math.cos(b), math.cos(a) * math.sin(b), math.sin(a)

    order = sorted(range(len(points)), key=lambda i: (-points[i][2], i))
    group, centres = [0] * len(points), []
    for i in order:
        v = vector(*points[i][:2])
        for g, c in enumerate(centres):
            size = math.sqrt(sum(x * x for x in c)) or 1.0
            if math.acos(max(-1.0, min(1.0, sum(x * y for x, y in zip(c, v, strict=True)) / size))) <= reach:
                break
        else:
            g = len(centres)
            centres.append((0.0, 0.0, 0.0))
        centres[g] = tuple(x + y * points[i][2] for x, y in zip(centres[g], v, strict=True))
        group[i] = g
    return group


def pins(cells: DataFrame, radius: float, merge: float = 40.0, most: int = 500) -> DataFrame:
    """Clusters of the ``most`` heaviest cells (lat, lon, n) on a globe of ``radius`` pixels, ``merge`` pixels apart."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n", "lat", "lon"], ascending=[False, True, True]).reset_index(drop=True)
        frame["pin"] = pin_groups(list(zip(frame["lat"], frame["lon"], frame["n"], strict=True)), merge / radius)
        by = frame.groupby("pin")
        return pd.DataFrame({"pin": by["n"].first().index, "n": by["n"].sum().to_numpy(), "lat": by["lat"].first().to_numpy(), "lon": by["lon"].first().to_numpy()})

    top = cells.orderBy(F.desc("n"), "lat", "lon").limit(most)  # the map draws no more
    return top.withColumn("map", F.lit(0)).groupBy("map").applyInPandas(work, "pin long, n long, lat double, lon double")
