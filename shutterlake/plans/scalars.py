"""Queries for the scalar functions, each with its SQL oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from shutterlake.functions import dates, geo, paths, text
from shutterlake.functions import media as m
from shutterlake.operators import sorting

from .registry import query
from .relational import BASE, EXT, TS


@query("media", sql=f"SELECT id, {EXT} AS ext, {BASE} AS name, REGEXP_REPLACE(file_path, '/[^/]*$', '') AS dir FROM media")
def f1_f2_f3_path_parts(media):
    p = F.col("file_path")
    return media.select("id", paths.extension(p).alias("ext"), paths.base_name(p).alias("name"), paths.dir_name(p).alias("dir"))


@query("rolls", sql="SELECT path_prefix, CASE WHEN LENGTH(custom_name) > 0 THEN custom_name WHEN STARTS_WITH(path_prefix, '__virtual__') THEN SUBSTR(path_prefix, 12) ELSE STRING_SPLIT(path_prefix, '/')[-1] END AS name FROM rolls")
def f4_leaf_names(albums):
    return albums.select("path_prefix", paths.leaf_name(F.col("path_prefix"), F.col("custom_name")).alias("name"))


@query("rolls", sql="SELECT name, '__virtual__' || REGEXP_REPLACE(TRIM(REGEXP_REPLACE(name || '  x/y ', '\\s+', ' ', 'g')), '[ /]', '_', 'g') AS prefix FROM rolls")
def d12_virtual_prefix(albums):
    return albums.select("name", paths.virtual_prefix(F.concat("name", F.lit("  x/y "))).alias("prefix"))


SIZE = "file_size * (id % 7 + 1) * (CASE WHEN id % 5 = 0 THEN 100000 ELSE 1 END)"


@query(
    "media",
    sql=f"""SELECT id, CASE WHEN s < 1024 THEN PRINTF('%d B', s) WHEN s < 1048576 THEN PRINTF('%.1f KB', FLOOR(s / 1024.0::DOUBLE * 10 + 0.5) / 10) WHEN s < 1073741824 THEN PRINTF('%.1f MB', FLOOR(s / 1048576.0::DOUBLE * 10 + 0.5) / 10) ELSE PRINTF('%.1f GB', FLOOR(s / 1073741824.0::DOUBLE * 10 + 0.5) / 10) END AS size,
    CASE WHEN s < 1024 THEN PRINTF('%d B', s) ELSE CASE WHEN v >= 100 THEN PRINTF('%.0f', FLOOR(v + 0.5)) WHEN v >= 10 THEN PRINTF('%.1f', FLOOR(v * 10 + 0.5) / 10) ELSE PRINTF('%.2f', FLOOR(v * 100 + 0.5) / 100) END || ' ' || u END AS short
    FROM (SELECT id, s, CASE WHEN s < 1048576 THEN 'KB' WHEN s < 1073741824 THEN 'MB' ELSE 'GB' END AS u, s / CASE WHEN s < 1048576 THEN 1024.0::DOUBLE WHEN s < 1073741824 THEN 1048576.0::DOUBLE ELSE 1073741824.0::DOUBLE END AS v FROM (SELECT id, {SIZE} AS s FROM media) a) b""",
)
def f6_size_texts(media):
    size = F.expr(SIZE)
    return media.select("id", m.size_text(size).alias("size"), m.short_size_text(size).alias("short"))


@query("media", sql=f"SELECT id, STRFTIME({TS}, '%B %Y') AS header, STRFTIME({TS}, '%Y') AS y, STRFTIME({TS}, '%Y-%m') AS ym, STRFTIME({TS}, '%Y-%m-%d') AS ymd, STRFTIME({TS}, '%A, %-d %B %Y') AS title FROM media")
def f7_f8_f37_date_keys(media):
    t = F.col("creation_date")
    patterns = {"header": "MMMM yyyy", "y": "yyyy", "ym": "yyyy-MM", "ymd": "yyyy-MM-dd", "title": "EEEE, d MMMM yyyy"}
    return media.select("id", *[dates.key(t, p).alias(n) for n, p in patterns.items()])


@query("media", sql=f"SELECT id, ABS(DATE_DIFF('day', MAKE_DATE(YEAR({TS}), 1, 20), {TS}::DATE)) <= 3 AND YEAR({TS}) < 2024 AS near FROM media")
def f9_near_day(media):
    return media.select("id", dates.near_anniversary(F.col("creation_date"), 2024, 1, 20).alias("near"))


@query("media", sql=f"SELECT id, YEAR({TS})::INTEGER AS year, MONTH({TS})::INTEGER AS month, DAY({TS})::INTEGER AS day, HOUR({TS})::INTEGER AS hour, MINUTE({TS})::INTEGER AS minute, SECOND({TS})::INTEGER AS second FROM media")
def f10_civil_time(media):
    return media.select("id", dates.civil(F.col("creation_date")).alias("c")).select("id", "c.*")


@query("media", sql="SELECT id, CASE WHEN id % 7 IN (0, 1) THEN creation_date END AS seconds FROM media")
def f11_exif_dates(media):
    """Dates with colons and with hyphens; null for months after 12, day 0, hour 24, letters, and what is cut off."""
    t, i = F.col("creation_date"), F.col("id")
    right = dates.key(t, "yyyy:MM:dd HH:mm:ss")
    wrong = [
        F.concat(F.lit("2020:"), (i % 87 + 13).cast("string"), F.lit(":07 11:12:13")),
        F.regexp_replace(right, r"^(\d+:\d+):\d+", "$1:00"),
        F.regexp_replace(right, r" \d+", " 24"),
        F.regexp_replace(right, r"^\d", "Q"),
        F.substring(right, 1, 12),
    ]
    said = F.when(i % 7 == 0, right).when(i % 7 == 1, dates.key(t, "yyyy-MM-dd HH:mm:ss"))
    for n, text_of in enumerate(wrong, 2):
        said = said.when(i % 7 == n, text_of)
    return media.select("id", dates.exif_seconds(said).alias("seconds"))


@query("said", sql="SELECT id, TRY_CAST(NULLIF(REGEXP_EXTRACT(place, '^([+-][0-9.]+)([+-][0-9.]+)', 1), '') AS DOUBLE) AS lat, TRY_CAST(NULLIF(REGEXP_EXTRACT(place, '^([+-][0-9.]+)([+-][0-9.]+)', 2), '') AS DOUBLE) AS lon FROM said")
def f12_iso6709(said):
    return said.select("id", geo.iso6709(F.col("place")).alias("p")).select("id", "p.lat", "p.lon")


@query("media", sql="SELECT id, FLOOR(latitude * 100 + 0.5) / 100.0::DOUBLE AS lat FROM media WHERE latitude IS NOT NULL")
def f13_hundredths(media):
    return media.filter("latitude is not null").select("id", geo.hundredths(F.col("latitude")).alias("lat"))


@query("media", sql=f"SELECT {BASE} AS name, LIST_AGGREGATE(LIST_TRANSFORM(REGEXP_EXTRACT_ALL(LOWER({BASE}), '([0-9]+|[^0-9]+)'), lambda t: CASE WHEN REGEXP_MATCHES(t, '^[0-9]') THEN LPAD(t, 20, '0') ELSE t END), 'string_agg', '') AS key FROM media")
def f14_natural_keys(media):
    name = paths.base_name(F.col("file_path"))
    return media.select(name.alias("name"), paths.natural_key(name).alias("key"))


@query("media", sql="SELECT id, CASE WHEN width = 0 OR height = 0 THEN 3 WHEN width > height THEN 0 WHEN width = height THEN 1 ELSE 2 END::INTEGER AS shape, width * height AS area, CASE WHEN id % 8 + 1 >= 5 THEN height ELSE width END AS shown_width FROM media")
def f15_f16_f17_shapes(media):
    w, h = F.col("width"), F.col("height")
    return media.select("id", m.orientation(w, h).alias("shape"), m.area(w, h).alias("area"), m.display_size(w, h, F.col("id") % 8 + 1)["width"].alias("shown_width"))


@query("media", sql="SELECT id, COALESCE(ABS(latitude) <= 90 AND ABS(longitude) <= 180 AND NOT (ABS(latitude) < 1e-9 AND ABS(longitude) < 1e-9), FALSE) AS valid, (id % 90 + (id % 60) / 60.0::DOUBLE + (id % 50) / 3600.0::DOUBLE) * CASE WHEN id % 2 = 0 THEN -1 ELSE 1 END AS degrees FROM media")
def f18_f19_gps(media):
    ref = F.when(F.col("id") % 2 == 0, "S").otherwise("N")
    return media.select("id", geo.valid_point(F.col("latitude"), F.col("longitude")).alias("valid"), geo.degrees(F.col("id") % 90, F.col("id") % 60, F.col("id") % 50, ref).alias("degrees"))


@query("media", sql="SELECT id, ((id % 256) << 16) | ((id * 7 % 256) << 8) | (id * 13 % 256) AS rgb FROM media")
def f21_packed_rgb(media):
    return media.select("id", m.packed_rgb(F.col("id") % 256, F.col("id") * 7 % 256, F.col("id") * 13 % 256).alias("rgb"))


HAVERSINE = "2 * 6371.0::DOUBLE * ASIN(LEAST(1.0::DOUBLE, SQRT(SIN(RADIANS(48.5 - latitude) / 2) ** 2 + COS(RADIANS(latitude)) * COS(RADIANS(48.5::DOUBLE)) * SIN(RADIANS(2.5 - longitude) / 2) ** 2)))"
CIRCLE = "6371.0::DOUBLE * ACOS(GREATEST(-1.0::DOUBLE, LEAST(1.0::DOUBLE, SIN(RADIANS(latitude)) * SIN(RADIANS(48.5::DOUBLE)) + COS(RADIANS(latitude)) * COS(RADIANS(48.5::DOUBLE)) * COS(RADIANS(2.5 - longitude)))))"


@query("media", sql=f"SELECT id, FLOOR({HAVERSINE} * 1000 + 0.5) / 1000.0::DOUBLE AS km, FLOOR({CIRCLE} * 10 + 0.5) / 10.0::DOUBLE AS arc FROM media WHERE latitude IS NOT NULL")
def f22_f23_distances(media):
    here = (F.col("latitude"), F.col("longitude"), F.lit(48.5), F.lit(2.5))
    km, arc = geo.haversine_km(*here), geo.great_circle_km(*here)
    return media.filter("latitude is not null").select("id", (F.floor(km * 1000 + 0.5) / 1000.0).alias("km"), (F.floor(arc * 10 + 0.5) / 10.0).alias("arc"))


@query("media", sql="SELECT id, CASE WHEN mime_type LIKE 'video/%' THEN CASE WHEN duration >= 1.5 THEN LEAST(duration, 6.0::DOUBLE) END ELSE 3.2::DOUBLE END AS seconds FROM media")
def f25_clip_seconds(media):
    return media.select("id", m.clip_seconds(F.col("mime_type"), F.col("duration")).alias("seconds"))


RATIOS = "[" + ", ".join(f"{r!r}::DOUBLE" for r in m.RATIOS) + "]"


@query("media", sql=f"SELECT id, CASE WHEN width > 0 AND height > 0 THEN width / height::DOUBLE ELSE {RATIOS}[id % 10 + 1] END AS ratio FROM media")
def f26_aspect_ratio(media):
    return media.select("id", m.aspect_ratio(F.col("width"), F.col("height"), F.col("id")).alias("ratio"))


@query("releases", sql="SELECT version, ROW_NUMBER() OVER (ORDER BY REGEXP_MATCHES(version, p), TRY_CAST(REGEXP_EXTRACT(version, p, 1) AS BIGINT) NULLS FIRST, TRY_CAST(REGEXP_EXTRACT(version, p, 2) AS BIGINT) NULLS FIRST, TRY_CAST(REGEXP_EXTRACT(version, p, 3) AS BIGINT) NULLS FIRST, REGEXP_EXTRACT(version, p, 4) = '', version) AS place FROM releases, (SELECT '^v?(\\d+)\\.(\\d+)\\.(\\d+)(-[0-9A-Za-z.-]+)?$' AS p) q")
def f27_versions(releases):
    return sorting.placed(releases, [(text.version_key(F.col("version")), True), (F.col("version"), True)])


@query("media", sql="SELECT id, 'file://' || REPLACE(REPLACE(URL_ENCODE(file_path || ' ü&+'), '%2F', '/'), '%3A', ':') AS url, file_path || ' ü&+' AS back FROM media")
def f28_c24_urls(media):
    rows = media.select("id", paths.file_url(F.concat("file_path", F.lit(" ü&+"))).alias("url"))
    return rows.withColumn("back", paths.path_of_url(F.col("url")))


@query("media", sql="SELECT id, MD5(file_path) AS cache_key, SHA256(file_path) AS digest FROM media")
def f29_hashes(media):
    return media.select("id", F.md5(F.col("file_path").cast("binary")).alias("cache_key"), F.sha2("file_path", 256).alias("digest"))


@query("faces", sql="SELECT person_id, STRING_AGG(PRINTF('%.4f', score), ',' ORDER BY id) AS csv FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY person_id ORDER BY id DESC) AS r FROM faces WHERE person_id IS NOT NULL) t WHERE r <= 20 GROUP BY person_id")
def f30_number_lists(faces):
    by = faces.filter("person_id is not null").groupBy("person_id").agg(F.sort_array(F.collect_list(F.struct("id", "score"))).alias("all"))
    return by.select("person_id", text.csv_of(F.transform("all", lambda x: x["score"]), 20).alias("csv"))


@query("recollections", sql="SELECT id, LOWER(TRIM(REGEXP_REPLACE('  ' || title || '   Day ', '\\s+', ' ', 'g'))) AS plain FROM recollections")
def f31_simplified(memories):
    return memories.select("id", F.lower(paths.simplified(F.concat(F.lit("  "), "title", F.lit("   Day ")))).alias("plain"))


@query("towns", sql="SELECT id, CASE WHEN LEN(LIST_FILTER(STRING_SPLIT_REGEX(LOWER(name), '[\\s,/_-]+'), lambda w: STARTS_WITH(w, 'bo'))) > 0 THEN 1 ELSE 0 END AS one, CASE WHEN STARTS_WITH(LOWER(name), 'new yo') THEN 2 WHEN LEN(LIST_FILTER(STRING_SPLIT_REGEX(LOWER(name), '[\\s,/_-]+'), lambda w: STARTS_WITH(w, 'yo'))) > 0 THEN 1 ELSE 0 END AS two FROM towns")
def f32_prefix_match(cities):
    return cities.select("id", text.prefix_match(F.col("name"), "bo").alias("one"), text.prefix_match(F.col("name"), "New yo").alias("two"))


@query("towns", sql="SELECT id, t AS place, STRING_SPLIT(t, ', ')[1] AS first, STRING_SPLIT(t, ', ')[-1] AS last FROM (SELECT id, CASE WHEN country = name THEN name ELSE name || ', ' || country END AS t FROM towns) x")
def f33_f34_place_texts(cities):
    rows = cities.select("id", geo.place_text(F.col("name"), F.col("country")).alias("place"))
    return rows.select("id", "place", text.section(F.col("place"), 1).alias("first"), text.section(F.col("place"), -1).alias("last"))


@query("towns", sql="SELECT id, PRINTF('%.2f', FLOOR(ABS(lat::DOUBLE) * 100 + 0.5) / 100) || '° ' || CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END || ', ' || PRINTF('%.2f', FLOOR(ABS(lon::DOUBLE) * 100 + 0.5) / 100) || '° ' || CASE WHEN lon >= 0 THEN 'E' ELSE 'W' END AS label FROM towns")
def f35_coordinate_labels(cities):
    return cities.select("id", geo.coordinate_label(F.col("lat").cast("double"), F.col("lon").cast("double")).alias("label"))


@query("media", sql=f"SELECT folder_path, (DATE_DIFF('day', MIN({TS})::DATE, MAX({TS})::DATE) + 1)::INTEGER AS days FROM media WHERE creation_date > 0 GROUP BY folder_path")
def f36_days_span(media):
    by = media.filter("creation_date > 0").groupBy("folder_path").agg(F.min("creation_date").alias("a"), F.max("creation_date").alias("b"))
    return by.select("folder_path", dates.days_span(F.col("a"), F.col("b")).alias("days"))


@query("events", sql="SELECT event_id, (props ->> '$.k')::BIGINT AS k, COALESCE(props ->> '$.missing', 'none') AS missing FROM events")
def f38_json(events):
    return events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.coalesce(F.get_json_object("props", "$.missing"), F.lit("none")).alias("missing"))


@query("media", sql="SELECT id, LEN(STRING_SPLIT(file_path, '/'))::INTEGER AS n, STRING_SPLIT(file_path, '/')[2] AS second, LIST_CONTAINS(STRING_SPLIT(file_path, '/'), 'lib') AS lib FROM media")
def f39_arrays(media):
    p = F.split("file_path", "/")
    return media.select("id", F.size(p).alias("n"), p[1].alias("second"), F.array_contains(p, "lib").alias("lib"))


@query("media", sql="SELECT id, LEN(LIST_FILTER([100, 900, 1500, 2800, 3000], lambda t: t <= width)) % 2 = 1 AS land FROM media")
def f40_land(media):
    return media.select("id", geo.is_land(F.array(*[F.lit(t) for t in (100, 900, 1500, 2800, 3000)]), F.col("width")).alias("land"))


@query("recollections", sql="SELECT id, UPPER(SUBSTR(title, 1, 1)) || SUBSTR(title, 2) || ' Memory ' || date || '.mp4' AS file FROM recollections")
def c22_c23_titles(memories):
    return memories.select("id", F.concat(F.initcap("title"), F.lit(" Memory "), "date", F.lit(".mp4")).alias("file"))


@query("recollections", sql="SELECT id, CASE WHEN title = 'Trip' THEN 'Voyage' WHEN title = 'Party' THEN 'Party!' ELSE title END AS shown FROM recollections")
def c25_translation(memories):
    french, english = (F.create_map(*[F.lit(x) for x in t]) for t in (("Trip", "Voyage"), ("Party", "Party!", "Trip", "Journey")))
    return memories.select("id", F.coalesce(F.try_element_at(french, F.col("title")), F.try_element_at(english, F.col("title")), "title").alias("shown"))
