"""Joins of the library: rank joins, lookups that keep order, nearest places, overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shutterlake.functions import geo
from shutterlake.operators.filters import alive


def in_given_order(media: DataFrame, ids: list[int], most: int = 2000) -> DataFrame:
    """Alive media of a list of ids, in its order; an id that repeats is answered each time."""
    spark: SparkSession = media.sparkSession
    wanted = spark.range(1).select(F.posexplode(F.array(*[F.lit(i).cast("long") for i in ids[:most]])).alias("position", "id"))
    return media.filter(alive()).join(F.broadcast(wanted), "id").orderBy("position")


def first_of_folder(media: DataFrame, folders: DataFrame) -> DataFrame:
    """Each folder (path_prefix, ...) with the path of its first media by id."""
    first = media.groupBy(F.col("folder_path").alias("path_prefix")).agg(F.min(F.struct("id", "file_path")).alias("first"))
    return folders.join(first, "path_prefix", "left").withColumn("cover", F.col("first.file_path")).drop("first")


def best_faces(faces: DataFrame, persons: DataFrame) -> DataFrame:
    """The cover face of each person: its own if still valid, else confirmed first, then the largest score x width."""
    own = faces.filter("person_id is not null")
    rank = F.row_number().over(Window.partitionBy("person_id").orderBy(F.desc("confirmed"), F.desc(F.col("score") * F.col("w")), "id"))
    best = own.withColumn("rank", rank).filter("rank = 1").select("person_id", F.col("id").alias("best"))
    valid = own.select(F.col("person_id").alias("_p"), F.col("id").alias("_f"))
    out = persons.join(valid, (F.col("cover_face_id") == F.col("_f")) & (F.col("id") == F.col("_p")), "left")
    out = out.join(best, F.col("id") == F.col("person_id"), "left")
    return out.select("id", F.coalesce("_f", "best").alias("cover"))


def near_places(points: DataFrame, cities: DataFrame, max_km: float) -> DataFrame:
    """For each point (key, lat, lon) the town that fits best within max_km, through a one-degree grid.

    Of the towns within max(1.8 d, d + 4) km, d the distance to the nearest one,
    the least (km + 1) / (1 + 0.8 log10(population / 5000)) wins. Points meet
    towns of neighbouring cells only; towns are exploded into the cells that can
    see them and joined by cell, so neither side is broadcast or crossed.
    """
    reach = min(5, max(1, -(-int(max_km) // 111)))
    # a degree of longitude is short near the poles; widen the reach there
    wide = F.least(F.lit(180), F.ceil(F.lit(float(reach)) / F.greatest(F.cos(F.radians("city_lat")), F.lit(0.05))).cast("int"))
    towns = cities.select(F.col("id").alias("city_id"), "name", "country", F.col("lat").cast("double").alias("city_lat"), F.col("lon").cast("double").alias("city_lon"), "population")
    towns = towns.withColumn("cell_lat", F.explode(F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda i: F.floor("city_lat") + i)))
    towns = towns.withColumn("cell_lon", F.explode(F.array_distinct(F.transform(F.sequence(-wide, wide), lambda i: F.pmod(F.floor("city_lon") + i + 180, F.lit(360)) - 180))))
    here = points.withColumns({"cell_lat": F.floor("lat"), "cell_lon": F.pmod(F.floor("lon") + 180, F.lit(360)) - 180})
    met = here.join(towns, ["cell_lat", "cell_lon"]).withColumn("km", geo.great_circle_km(F.col("lat"), F.col("lon"), F.col("city_lat"), F.col("city_lon"))).filter(F.col("km") <= max_km)
    nearest = F.min("km").over(Window.partitionBy("key"))
    met = met.withColumn("nearest", nearest).filter(F.col("km") <= F.greatest(F.col("nearest") * 1.8, F.col("nearest") + 4))
    weight = F.log10(F.greatest(F.col("population"), F.lit(5000)) / 5000.0) * 0.8 + 1
    best = met.groupBy("key").agg(F.min(F.struct(((F.col("km") + 1) / weight).alias("score"), "city_id", "name", "country", "km")).alias("best"))
    return best.select("key", F.col("best.name").alias("city"), F.col("best.country").alias("country"), F.col("best.km").alias("km"))


def places_of(media: DataFrame, cities: DataFrame, max_km: float = 60) -> DataFrame:
    """id, city, country, km of geotagged alive media; distinct hundredths of a degree are looked up once."""
    rows = media.filter(alive() & F.col("latitude").isNotNull() & ~((F.col("latitude") == 0) & (F.col("longitude") == 0)))
    lat, lon = geo.hundredths(F.col("latitude")), geo.hundredths(F.col("longitude"))
    spot = F.concat_ws(",", lat.cast("string"), lon.cast("string"))
    spots = rows.select(spot.alias("key"), lat.alias("lat"), lon.alias("lon")).distinct()
    return rows.withColumn("key", spot).join(near_places(spots, cities, max_km), "key").select("id", "creation_date", "city", "country", "km")


def under_roots(dirs: DataFrame, roots: DataFrame) -> DataFrame:
    """Directories equal to or below a root: each is expanded to its ancestors and joined on equality."""
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    expanded = dirs.select("dir", F.explode(above).alias("path"))
    return expanded.join(roots.select("path"), "path").select("dir").distinct()


def without_excluded(files: DataFrame, exclusions: DataFrame, directory: Column) -> DataFrame:
    """Files whose directory contains none of the non-empty patterns; patterns are a short user list."""
    from shutterlake.operators.limits import small_list

    patterns = small_list(exclusions.filter("pattern <> ''").select("pattern"), "pattern")
    out = files
    for p in patterns:
        out = out.filter(~F.contains(directory, F.lit(p)))
    return out
