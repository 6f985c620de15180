"""Queries for filters, joins, rollups, orders and set operations, each with its SQL oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.functions import dates, paths
from shutterlake.functions import geo as g
from shutterlake.functions.media import type_label
from shutterlake.operators import aggregates as agg
from shutterlake.operators import filters as flt
from shutterlake.operators import joins, sorting
from shutterlake.operators import search as find
from shutterlake.sources import files, headers

from .fixtures import TODAY
from .registry import query

ALIVE = "is_trashed = 0 AND COALESCE(is_hidden, 0) = 0 AND COALESCE(is_ignored, 0) = 0"
LIVE = "COALESCE(is_trashed, 0) = 0"
TS = "MAKE_TIMESTAMP(creation_date * 1000000)"
EXT = "LOWER(STRING_SPLIT(file_path, '.')[-1])"
BASE = "STRING_SPLIT(file_path, '/')[-1]"
RAW16 = ", ".join(f"'{e}'" for e in paths.RAW_FILTER)
RAW20 = ", ".join(f"'{e}'" for e in paths.RAW_REPORT)
ALL_EXT = ", ".join(f"'{e}'" for e in paths.MEDIA)
IGNORED = "COALESCE(folder_path, '') NOT IN (SELECT COALESCE(path_prefix, '') FROM albums WHERE is_ignored = 1)"


def ids(df: DataFrame) -> DataFrame:
    return df.select("id")


# ---- sources ------------------------------------------------------------------------------------


@query("media", sql=f"SELECT id, file_path FROM media WHERE {BASE} LIKE '%.%' AND {EXT} IN ({ALL_EXT})")
def s2_extension_filter(media):
    return files.with_extension(media, "file_path").select("id", "file_path")


@query("media", "exclusions", sql="SELECT id FROM media m WHERE NOT EXISTS (SELECT 1 FROM exclusions e WHERE pattern <> '' AND CONTAINS(folder_path, pattern))")
def s3_exclusions(media, exclusions):
    return ids(joins.without_excluded(media, exclusions, F.col("folder_path")))


@query("media", sql=f"SELECT id, {BASE} AS name FROM media WHERE folder_path = '/lib/a3' ORDER BY 1")
def s15_siblings(media):
    return sorting.siblings(media, "/lib/a3").select("id", paths.base_name(F.col("file_path")).alias("name"))


@query("media", sql="SELECT file_path AS path, CASE WHEN creation_date <> 0 AND width <> 0 AND height <> 0 THEN file_size ELSE -1 END AS size FROM media WHERE STARTS_WITH(file_path, '/lib/a1/')")
def s16_snapshot(media):
    return files.snapshot(media, "/lib/a1")


CHUNK_SQL = "SELECT file_path, i::INTEGER AS chunk_idx, SUBSTR(text, i * 630 + 1, 700) AS chunk FROM (SELECT file_path, text, UNNEST(RANGE(0, (LENGTH(text) + 629) // 630)) AS i FROM doc_files) c WHERE i * 630 < LENGTH(text)"


@query("doc_files", sql=CHUNK_SQL)
def s17_document_chunks(docs):
    return files.document_chunks(docs)


@query("preferences", sql="SELECT value ->> '$.theme' AS theme, COALESCE(value ->> '$.columns', '4') AS columns, COALESCE(value ->> '$.gap', '6') AS gap FROM preferences WHERE key = 'config_123'")
def s21_json_settings(settings):
    return files.json_settings(settings, "config_123", {"theme": "light", "columns": "4", "gap": "6"})


@query("samples", sql="SELECT bucket, MAX(ABS(s)) AS peak, MAX(ABS(s)) / GREATEST(MAX(MAX(ABS(s))) OVER (), 1e-6::DOUBLE) AS level FROM (SELECT s, ((idx + 1) * 100 - 1) // (SELECT COUNT(*) FROM samples) AS bucket FROM samples) t GROUP BY bucket")
def s22_a20_peaks(samples):
    return agg.bucket_peaks(samples, 100)


def _hex(number, size: int, little: bool = False):
    digits = F.lpad(F.hex(number), 2 * size, "0")
    return F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))]) if little else digits


def _small_files(media):
    """path, content of a small file for each row, of eight kinds in turn; every ninth one is cut after ten bytes."""
    i = F.col("id")
    w, h = i % 4000 + 1, i * 7 % 3000 + 1
    turned = F.when(i % 2 == 0, F.concat(_hex(F.lit(0), 4), _hex(F.lit(65536), 4))).otherwise(F.concat(_hex(F.lit(65536), 4), _hex(F.lit(0), 4)))
    bodies = [
        ("89504E470D0A1A0A0000000D49484452", _hex(w, 4), _hex(h, 4), "080600000000000000"),
        ("474946383961", _hex(w, 2, True), _hex(h, 2, True), "000000"),
        ("424D" + "00" * 16, _hex(w, 4, True), _hex(F.when(i % 2 == 0, h).otherwise(F.lit(2**32) - h), 4, True), "00000000"),
        ("52494646000000005745425056503858" + "0A00000000000000", _hex(w - 1, 3, True), _hex(h - 1, 3, True), "00"),
        ("FFD8FFC0001108", _hex(h, 2), _hex(w, 2), "00" * 10),
        ("49492A00080000000300" + "0001040001000000", _hex(w, 4, True), "0101040001000000", _hex(h, 4, True), "1201030001000000", _hex(i % 8 + 1, 4, True), "00000000"),
        ("00000010667479706D70343200000000" + "000000D86D6F6F76" + "0000006C6D766864" + "00" * 12 + "000003E8", _hex(i % 1000 * 500, 4), "00" * 80 + "000000647472616B" + "0000005C746B6864" + "00" * 40, turned, "00" * 28, _hex(w * 65536, 4), _hex(h * 65536, 4)),
        ("6E6F206D65646961",),
    ]
    content = F.lit(None).cast("string")
    for n, parts in enumerate(bodies):
        content = F.when(i % 8 == n, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])).otherwise(content)
    content = F.unhex(F.when(i % 9 == 0, F.substring(content, 1, 20)).otherwise(content))
    return media.select(i.cast("string").alias("path"), content.alias("content"))


@query(
    "media",
    sql="""SELECT id::VARCHAR AS path, CASE WHEN cut THEN NULL WHEN turned THEN h ELSE w END::INTEGER AS width, CASE WHEN cut THEN NULL WHEN turned THEN w ELSE h END::INTEGER AS height,
      CASE WHEN k = 5 AND NOT cut THEN id % 8 + 1 END::INTEGER AS orientation, CASE WHEN k = 6 AND NOT cut THEN (id % 1000 * 500) / 1000.0::DOUBLE END AS seconds
    FROM (SELECT id, id % 8 AS k, id % 4000 + 1 AS w, id * 7 % 3000 + 1 AS h, id % 9 = 0 AND id % 8 <> 1 AS cut, id % 8 = 6 AND id % 2 = 0 AS turned FROM media WHERE id % 8 < 7 AND NOT (id % 9 = 0 AND id % 8 = 3)) t""",
)
def s5_s9_s12_s13_headers(media):
    return headers.probed(_small_files(media)).select("path", "width", "height", "orientation", "seconds")


# ---- filters ------------------------------------------------------------------------------------


@query("media", "albums", sql=f"SELECT id FROM media WHERE is_ignored = 0 AND {IGNORED} AND {EXT} NOT IN ({RAW16}) AND COALESCE(is_trashed, 0) = 0 AND COALESCE(is_hidden, 0) = 0")
def p1_base_query(media, albums):
    return ids(flt.base_query(media, albums, raw=1, trashed=False, hidden=False))


@query("media", "albums", sql=f"SELECT id FROM media WHERE {IGNORED}")
def p2_ignored_folders(media, albums):
    return ids(flt.without_ignored_folders(media, albums))


@query("media", sql=f"SELECT id, file_path FROM media WHERE {EXT} IN ({RAW16})")
def p3_raw_filter(media):
    return media.filter(paths.is_raw(F.col("file_path"))).select("id", "file_path")


@query("media", sql="SELECT id FROM media WHERE folder_path = '/lib/a2'")
def p4_folder(media):
    return ids(media.filter(flt.with_folder("/lib/a2")))


@query("media", sql="SELECT id FROM media WHERE CONTAINS(LOWER(file_path), 'click_1')")
def p5_substring(media):
    return ids(media.filter(flt.path_contains("CLICK_1")))


@query("media", sql="SELECT id FROM media WHERE STARTS_WITH(mime_type, 'image/x-') OR STARTS_WITH(mime_type, 'video/')")
def p6_mime_prefixes(media):
    return ids(media.filter(flt.mime_in("image/x-||video/")))


@query(
    "media",
    sql=f"""SELECT 'all' AS mode, id FROM media WHERE {LIVE} AND COALESCE(is_hidden, 0) = 0
    UNION ALL SELECT 'favorites', id FROM media WHERE is_favorite = 1 AND {LIVE} AND COALESCE(is_hidden, 0) = 0
    UNION ALL SELECT 'trash', id FROM media WHERE is_trashed = 1 UNION ALL SELECT 'hidden', id FROM media WHERE is_hidden = 1""",
)
def p7_filter_modes(media):
    modes = F.array(*[F.when(flt.in_mode(m), F.lit(m)) for m in ("all", "favorites", "trash", "hidden")])
    return media.select(F.explode(F.array_compact(modes)).alias("mode"), "id")


@query("media", sql=f"SELECT id FROM media WHERE {ALIVE}")
def p8_alive(media):
    return ids(media.filter(flt.alive()))


@query("media", sql=f"SELECT id FROM media WHERE {LIVE}")
def p9_live(media):
    return ids(media.filter(flt.live()))


@query("media", sql=f"SELECT id FROM media WHERE {ALIVE} AND creation_date > 0 AND (mime_type IN ('image/jpeg', 'image/webp') OR mime_type LIKE 'video/%')")
def p10_usable(media):
    return ids(media.filter(flt.usable()))


@query("media", sql=f"SELECT id FROM media WHERE {ALIVE} AND (mime_type IN ('image/jpeg', 'image/webp', 'image/png') OR mime_type LIKE 'video/%') ORDER BY creation_date DESC, id DESC LIMIT 6000")
def p11_editor_pool(media):
    return ids(media.filter(flt.in_editor_pool()).orderBy(F.desc("creation_date"), F.desc("id")).limit(6000))


@query("media", sql=f"SELECT id FROM media WHERE {ALIVE} AND width > 2000 ORDER BY creation_date DESC, id DESC LIMIT 5000")
def p12_media_where(media):
    return ids(flt.media_where(media, F.col("width") > 2000))


@query("media", sql="SELECT id, file_path, mime_type FROM media WHERE id = 42")
def p13_by_id(media):
    return media.filter("id = 42").select("id", "file_path", "mime_type")


@query(
    "media",
    "faces",
    "analysis",
    sql=f"""SELECT 'favorite' AS kind, id FROM media WHERE {ALIVE} AND is_favorite = 1
    UNION ALL SELECT 'video', id FROM media WHERE {ALIVE} AND mime_type LIKE 'video/%'
    UNION ALL SELECT 'year', id FROM media WHERE {ALIVE} AND creation_date > 0 AND STRFTIME({TS}, '%Y') = '2022'
    UNION ALL SELECT 'person', id FROM media WHERE {ALIVE} AND id IN (SELECT media_id FROM faces WHERE person_id = 2)
    UNION ALL SELECT 'color', id FROM media WHERE {ALIVE} AND id IN (SELECT media_id FROM analysis WHERE color_bucket = 4)
    UNION ALL SELECT 'album', id FROM media WHERE {ALIVE} AND folder_path = '/lib/a4'""",
)
def p13_keyed_media(media, faces, analysis):
    rows = media.filter(flt.alive())
    by = {
        "favorite": rows.filter("is_favorite = 1"),
        "video": rows.filter(F.col("mime_type").startswith("video/")),
        "year": rows.filter((F.col("creation_date") > 0) & (dates.key(F.col("creation_date"), "yyyy") == "2022")),
        "person": rows.join(faces.filter("person_id = 2").select(F.col("media_id").alias("id")), "id", "left_semi"),
        "color": rows.join(analysis.filter("color_bucket = 4").select(F.col("media_id").alias("id")), "id", "left_semi"),
        "album": rows.filter(flt.with_folder("/lib/a4")),
    }
    out = None
    for kind, df in by.items():
        own = df.select(F.lit(kind).alias("kind"), "id")
        out = own if out is None else out.union(own)
    return out


@query("media", "analysis", sql=f"SELECT m.id FROM media m LEFT JOIN analysis a ON a.media_id = m.id WHERE {ALIVE} AND mime_type LIKE 'image/%' AND (a.media_id IS NULL OR version < 1 OR faces_done = 0) ORDER BY creation_date DESC, m.id DESC LIMIT 48")
def p14_j7_pending_analysis(media, analysis):
    return ids(flt.pending_analysis(media, analysis))


@query("media", "ai_embeddings", sql="SELECT id FROM media WHERE is_trashed = 0 AND is_hidden = 0 AND id NOT IN (SELECT media_id FROM ai_embeddings)")
def p15_pending_embedding(media, ai_embeddings):
    return ids(flt.pending_embedding(media, ai_embeddings))


@query("media", sql=f"SELECT COUNT(*) FILTER (latitude <> 0 AND longitude <> 0) AS grouping_points, COUNT(*) FILTER (latitude IS NOT NULL AND NOT (latitude = 0 AND longitude = 0)) AS trip_points FROM media WHERE {LIVE}")
def p16_geo_validity(media):
    one = (F.col("latitude") != 0) & (F.col("longitude") != 0)
    two = F.col("latitude").isNotNull() & ~((F.col("latitude") == 0) & (F.col("longitude") == 0))
    return media.filter(flt.live()).agg(F.count_if(one).alias("grouping_points"), F.count_if(two).alias("trip_points"))


R2 = "FLOOR({} * 100 + 0.5) / 100.0::DOUBLE"


@query("media", sql=f"SELECT id FROM media WHERE {ALIVE} AND ({R2.format('latitude')}, {R2.format('longitude')}) IN ((48.85::DOUBLE, 2.35::DOUBLE), (48.9::DOUBLE, 2.4::DOUBLE), (35.7::DOUBLE, 139.7::DOUBLE)) ORDER BY creation_date DESC, id DESC LIMIT 5000")
def p17_cell_members(media):
    cells = media.sparkSession.sql("SELECT * FROM (VALUES (48.85D, 2.35D), (48.9D, 2.4D), (35.7D, 139.7D)) AS t(lat, lon)")
    rows = media.withColumns({"lat": g.hundredths(F.col("latitude")), "lon": g.hundredths(F.col("longitude"))})
    return ids(flt.media_where(rows.join(F.broadcast(cells), ["lat", "lon"], "left_semi"), F.lit(True)))


@query("media", sql=f"SELECT id FROM media WHERE {LIVE} AND {EXT} IN ('jpg', 'jpeg', 'png', 'webp', 'tif', 'tiff')")
def p19_strippable(media):
    return ids(media.filter(flt.strippable()))


@query("media", sql=f"SELECT id, 'file://' || REPLACE(REPLACE(URL_ENCODE(file_path), '%2F', '/'), '%3A', ':') AS url, ROW_NUMBER() OVER (ORDER BY creation_date DESC, id DESC) - 1 AS flat_index FROM media WHERE {ALIVE}")
def p20_w5_enriched(media):
    from shutterlake.operators.windows import flat_index

    rows = media.filter(flt.alive())
    return rows.select("id", paths.file_url(F.col("file_path")).alias("url")).join(flat_index(rows), "id")


@query("media", sql=f"SELECT id, {BASE} AS name FROM media WHERE CONTAINS(LOWER(file_path), 'purchase') ORDER BY LOWER({BASE}), id LIMIT 50")
def p21_list_view(media):
    name = paths.base_name(F.col("file_path"))
    return media.filter(flt.path_contains("purchase")).select("id", name.alias("name")).orderBy(F.lower("name"), "id").limit(50)


@query("memories", "media", sql=f"SELECT id FROM memories m WHERE NOT EXISTS (SELECT 1 FROM (SELECT UNNEST(STRING_SPLIT(m.sources, '|')) AS s) x WHERE s <> '' AND s NOT IN (SELECT file_path FROM media WHERE {ALIVE}))")
def p23_c21_visible_memories(memories, media):
    return ids(flt.visible_memories(memories, media))


# ---- catalogue ----------------------------------------------------------------------------------


@query("roots", sql="SELECT path, is_active FROM roots WHERE is_active = 1")
def c1_active_directories(directories):
    return directories.filter("is_active = 1").select("path", "is_active")


@query("patterns", sql="SELECT pattern FROM patterns UNION SELECT '/new'")
def c2_exclusions(exclusions):
    from shutterlake.operators.dml import insert_or_ignore

    new = exclusions.sparkSession.sql("SELECT TRIM(p) AS pattern FROM (VALUES (' /new '), ('/p1')) AS t(p)")
    return insert_or_ignore(exclusions, new, "pattern")


@query("preferences", sql="SELECT SUBSTR(key, 11) AS view, CASE WHEN v THEN value[1]::INTEGER ELSE 0 END AS role, CASE WHEN v THEN value[3]::INTEGER ELSE 0 END AS ascending FROM (SELECT *, REGEXP_MATCHES(value, '^\\d,\\d$') AS v FROM preferences WHERE STARTS_WITH(key, 'sort_pref_')) t")
def c3_sort_preferences(settings):
    return files.sort_preferences(settings)


@query("preferences", sql="SELECT key, value FROM preferences WHERE key = 'threshold_11' UNION ALL SELECT 'absent', '0.38'")
def c4_settings(settings):
    one = files.setting(settings, "threshold_11", F.lit("0.38")).select(F.lit("threshold_11").alias("key"), "value")
    return one.union(files.setting(settings, "absent", F.lit("0.38")).select(F.lit("absent").alias("key"), "value"))


@query("preferences", sql="SELECT key, SHA256(value) = SHA256('0.30') AS matches FROM preferences")
def c5_password(settings):
    return settings.select("key", (F.sha2("value", 256) == F.sha2(F.lit("0.30"), 256)).alias("matches"))


@query("media", sql="SELECT file_path FROM media WHERE is_trashed = 0")
def c6_live_paths(media):
    return media.filter("is_trashed = 0").select("file_path")


@query("albums", "media", sql="SELECT a.path_prefix, (SELECT file_path FROM media m WHERE m.folder_path = a.path_prefix ORDER BY id LIMIT 1) AS cover FROM albums a WHERE is_ignored = 1")
def c7_j11_ignored_folders(albums, media):
    return joins.first_of_folder(media, albums.filter("is_ignored = 1").select("path_prefix"))


@query("media", "albums", sql=f"SELECT DISTINCT folder_path, CASE WHEN LENGTH(custom_name) > 0 THEN custom_name ELSE STRING_SPLIT(folder_path, '/')[-1] END AS name FROM media LEFT JOIN albums ON path_prefix = folder_path WHERE {LIVE} AND {IGNORED}")
def c8_j1_album_list(media, albums):
    rows = flt.without_ignored_folders(media.filter(flt.live()), albums).select("folder_path").distinct()
    rows = rows.join(albums.select(F.col("path_prefix").alias("folder_path"), "custom_name"), "folder_path", "left")
    return rows.select("folder_path", paths.leaf_name(F.col("folder_path"), F.col("custom_name")).alias("name"))


@query("media", "albums", sql=f"SELECT folder_path FROM (SELECT DISTINCT folder_path, CASE WHEN LENGTH(custom_name) > 0 THEN custom_name ELSE STRING_SPLIT(folder_path, '/')[-1] END AS name FROM media LEFT JOIN albums ON path_prefix = folder_path WHERE {LIVE} AND {IGNORED}) t WHERE CONTAINS(LOWER(name), 'a1') OR CONTAINS(LOWER(name), 'first')")
def c9_album_search(media, albums):
    name = F.lower("name")
    return c8_j1_album_list(media, albums).filter(F.contains(name, F.lit("a1")) | F.contains(name, F.lit("first"))).select("folder_path")


@query("faces", "media", sql=f"SELECT f.id, media_id, confirmed, score FROM faces f JOIN media m ON m.id = media_id WHERE {ALIVE} AND person_id = 1 ORDER BY confirmed DESC, score DESC, f.id LIMIT 32")
def c11_j3_person_faces(faces, media):
    rows = faces.filter("person_id = 1").join(media.filter(flt.alive()).select(F.col("id").alias("media_id")), "media_id")
    return rows.select("id", "media_id", "confirmed", "score").orderBy(F.desc("confirmed"), F.desc("score"), "id").limit(32)


@query("media", "analysis", sql=f"SELECT m.id, color_frac FROM media m JOIN analysis a ON a.media_id = m.id WHERE {ALIVE} AND color_bucket = 5 ORDER BY color_frac DESC, m.id LIMIT 100")
def c12_j12_colour_media(media, analysis):
    rows = media.filter(flt.alive()).select("id").join(analysis.filter("color_bucket = 5").select(F.col("media_id").alias("id"), "color_frac"), "id")
    return rows.orderBy(F.desc("color_frac"), "id").limit(100)


@query("media", sql=f"SELECT id FROM media WHERE {ALIVE} AND latitude IS NOT NULL AND creation_date BETWEEN 1641000000 AND 1644000000 ORDER BY creation_date, id")
def c14_trip_media(media):
    return ids(media.filter(flt.alive() & F.col("latitude").isNotNull() & F.col("creation_date").between(1641000000, 1644000000)))


@query("media", "ai_embeddings", sql="SELECT COUNT(*) AS pending, COUNT(*) = 0 AS ready FROM media WHERE is_trashed = 0 AND is_hidden = 0 AND id NOT IN (SELECT media_id FROM ai_embeddings)")
def c15_index_state(media, ai_embeddings):
    return flt.pending_embedding(media, ai_embeddings).agg(F.count(F.lit(1)).alias("pending")).withColumn("ready", F.col("pending") == 0)


@query("media", sql=f"SELECT SUM(file_size) / 1073741824.0::DOUBLE AS gib, FLOOR(100.0::DOUBLE * SUM(file_size) / 500000000)::INTEGER AS percent FROM media WHERE {LIVE}")
def c17_storage_ratio(media):
    total = F.sum("file_size")
    return media.filter(flt.live()).agg((total / 1073741824.0).alias("gib"), F.floor(total * 100.0 / 500000000).cast("int").alias("percent"))


@query("media", sql="SELECT id FROM media WHERE id % 10 = 3 AND file_path NOT IN (SELECT file_path FROM media WHERE is_favorite = 1)")
def c18_selection(media):
    chosen, gone = media.filter("id % 10 = 3"), media.filter("is_favorite = 1").select("file_path")
    return ids(chosen.join(gone, "file_path", "left_anti"))


@query("media", sql=f"SELECT id, name, file_size, nth FROM (SELECT id, {BASE} AS name, file_size, ROW_NUMBER() OVER (PARTITION BY {BASE}, file_size ORDER BY creation_date, id)::INTEGER AS nth FROM media WHERE {LIVE} AND file_size > 0) t WHERE nth > 1")
def c19_extra_copies(media):
    return agg.extra_copies(media)


@query("media", sql=f"SELECT GREATEST(MAX(s), 1)::BIGINT AS most FROM (SELECT SUM(file_size)::BIGINT AS s FROM media WHERE {LIVE} AND creation_date > 0 GROUP BY STRFTIME({TS}, '%Y')) t")
def c20_chart_max(media):
    return agg.by_year(media).agg(F.greatest(F.max("size"), F.lit(1).cast("long")).alias("most"))


# ---- joins --------------------------------------------------------------------------------------


@query("media", sql=f"SELECT lat, lon, n, m.id AS sample_id FROM (SELECT {R2.format('latitude')} AS lat, {R2.format('longitude')} AS lon, COUNT(*) AS n, MIN(file_path) AS p FROM media WHERE {LIVE} AND latitude <> 0 GROUP BY 1, 2) t JOIN media m ON m.file_path = p")
def j2_cell_samples(media):
    rows = media.filter(flt.live() & (F.col("latitude") != 0))
    by = rows.groupBy(g.hundredths(F.col("latitude")).alias("lat"), g.hundredths(F.col("longitude")).alias("lon"))
    return by.agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("file_path", "id")).alias("s")).select("lat", "lon", "n", F.col("s.id").alias("sample_id"))


@query("faces", "media", "persons", sql=f"SELECT f.person_id AS person, f.id AS face, m.id AS media FROM persons p JOIN faces f ON f.person_id = p.id JOIN media m ON m.id = f.media_id WHERE {ALIVE}")
def j4_people_faces_media(faces, media, persons):
    rows = faces.select(F.col("id").alias("face"), F.col("media_id").alias("media"), F.col("person_id").alias("person"))
    rows = rows.join(media.filter(flt.alive()).select(F.col("id").alias("media")), "media")
    return rows.join(persons.select(F.col("id").alias("person")), "person").select("person", "face", "media")


@query("faces", "media", "persons", sql=f"SELECT f.id FROM faces f JOIN media m ON m.id = f.media_id LEFT JOIN persons p ON p.id = f.person_id WHERE {ALIVE} AND (p.id IS NULL OR p.name IS NULL)")
def j5_unnamed_faces(faces, media, persons):
    rows = faces.join(media.filter(flt.alive()).select(F.col("id").alias("media_id")), "media_id")
    named = persons.filter("name is not null").select(F.col("id").alias("person_id"))
    return ids(rows.join(named, "person_id", "left_anti"))


@query("ai_embeddings", "media", sql=f"SELECT media_id FROM ai_embeddings JOIN media ON id = media_id WHERE {ALIVE}")
def j8_vectors_of_media(ai_embeddings, media):
    return ai_embeddings.join(media.filter(flt.alive()).select(F.col("id").alias("media_id")), "media_id").select("media_id")


@query("media", "faces", sql="SELECT id FROM media WHERE id IN (SELECT media_id FROM faces WHERE person_id = 3)")
def j9_person_media(media, faces):
    return ids(media.join(faces.filter("person_id = 3").select(F.col("media_id").alias("id")), "id", "left_semi"))


@query("persons", "faces", sql="SELECT id FROM persons WHERE name IS NULL AND id NOT IN (SELECT DISTINCT person_id FROM faces WHERE person_id IS NOT NULL)")
def j10_orphans(persons, faces):
    return ids(persons.filter("name is null").join(faces.filter("person_id is not null").select(F.col("person_id").alias("id")), "id", "left_anti"))


@query("persons", "faces", sql="SELECT p.id, (SELECT COUNT(*) FROM faces f WHERE f.person_id = p.id) AS n FROM persons p WHERE name IS NOT NULL")
def j13_face_counts(persons, faces):
    by = faces.groupBy(F.col("person_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return persons.filter("name is not null").join(by, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


@query("faces", "persons", sql="SELECT p.id, COALESCE((SELECT f.id FROM faces f WHERE f.id = p.cover_face_id AND f.person_id = p.id), (SELECT f.id FROM faces f WHERE f.person_id = p.id ORDER BY confirmed DESC, score * w DESC, f.id LIMIT 1)) AS cover FROM persons p")
def j14_cover_faces(faces, persons):
    return joins.best_faces(faces, persons.withColumn("cover_face_id", F.col("cover_face_id").cast("long")))


ORDERED = "[17, 4, 250, 17, 11, 999999, 52, 8]"


@query("media", sql=f"SELECT (i - 1)::INTEGER AS position, m.id FROM (SELECT UNNEST({ORDERED}) AS id, GENERATE_SUBSCRIPTS({ORDERED}, 1) AS i) t JOIN media m ON m.id = t.id WHERE {ALIVE}")
def j15_j16_given_order(media):
    return joins.in_given_order(media, [17, 4, 250, 17, 11, 999999, 52, 8]).select("position", "id")


@query("media", sql="SELECT file_path AS path, file_size + id % 3 AS size FROM media m WHERE id % 3 <> 0 OR creation_date = 0 OR width = 0 OR height = 0")
def j17_changed_files(media):
    found = media.select(F.col("file_path").alias("path"), (F.col("file_size") + F.col("id") % 3).alias("size"))
    return files.changed(found, files.snapshot(media, "/lib"))


@query("media", "directories", sql="SELECT DISTINCT folder_path AS dir FROM media, directories WHERE path IN ('/old', '/lib/a7') AND (folder_path = path OR STARTS_WITH(folder_path, path || '/'))")
def j23_under_roots(media, directories):
    return joins.under_roots(media.select(F.col("folder_path").alias("dir")).distinct(), directories.filter("path <> '/lib'"))


# ---- rollups ------------------------------------------------------------------------------------

ALBUMS = f"""SELECT folder_path, COUNT(*) AS n, SUM(file_size)::BIGINT AS size, COALESCE(FIRST(cover_path), MIN(file_path)) AS cover, FIRST(custom_name) AS custom_name,
  COALESCE(FIRST(is_pinned), 0) AS is_pinned, FIRST(description) AS description
FROM media LEFT JOIN albums ON path_prefix = folder_path WHERE {ALIVE.replace("is_ignored", "media.is_ignored")} AND {IGNORED.replace("is_ignored = 1", "albums.is_ignored = 1")} GROUP BY folder_path
UNION ALL SELECT path_prefix, 0, 0, cover_path, name, is_pinned, description FROM albums WHERE STARTS_WITH(path_prefix, '__virtual__') AND is_ignored = 0"""


@query("media", "albums", sql=f"SELECT *, CASE WHEN LENGTH(custom_name) > 0 THEN custom_name WHEN STARTS_WITH(folder_path, '__virtual__') THEN SUBSTR(folder_path, 12) ELSE STRING_SPLIT(folder_path, '/')[-1] END AS name FROM ({ALBUMS}) t")
def u1_albums(media, albums):
    """A1, U1, F4: folder albums and virtual ones with names, counts, sizes and covers."""
    return agg.all_albums(media, albums)


@query("media", sql=f"SELECT {R2.format('latitude')} AS lat, {R2.format('longitude')} AS lon, COUNT(*) AS n, MIN(file_path) AS sample FROM media WHERE {LIVE} AND latitude <> 0 AND longitude <> 0 GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 500")
def a2_geo_cells(media):
    return agg.geo_cells(media)


@query("media", sql=f"SELECT COALESCE(SUM(file_size), 0)::BIGINT AS total, COALESCE(SUM(file_size) FILTER (mime_type NOT LIKE 'video/%'), 0)::BIGINT AS photos, COALESCE(SUM(file_size) FILTER (mime_type LIKE 'video/%'), 0)::BIGINT AS videos FROM media WHERE {LIVE}")
def a3_storage_totals(media):
    return agg.storage_totals(media)


@query("media", sql=f"SELECT COUNT(*) FILTER (mime_type NOT LIKE 'video/%') AS photos, COUNT(*) FILTER (mime_type LIKE 'video/%') AS videos FROM media WHERE {LIVE} AND COALESCE(is_hidden, 0) = 0")
def a4_counts(media):
    return agg.counts(media)


@query(
    "media",
    sql=f"""SELECT *, GREATEST(0, 900000000 - photos - videos - raw - trash)::BIGINT AS other FROM (SELECT
    COALESCE(SUM(file_size) FILTER ({LIVE} AND mime_type NOT LIKE 'video/%' AND {EXT} NOT IN ({RAW20})), 0)::BIGINT AS photos,
    COALESCE(SUM(file_size) FILTER ({LIVE} AND mime_type LIKE 'video/%'), 0)::BIGINT AS videos,
    COALESCE(SUM(file_size) FILTER ({LIVE} AND {EXT} IN ({RAW20})), 0)::BIGINT AS raw,
    COALESCE(SUM(file_size) FILTER (NOT ({LIVE})), 0)::BIGINT AS trash, COUNT(*) FILTER (NOT ({LIVE})) AS trash_count FROM media) t""",
)
def a5_overview(media):
    return agg.overview(media, 1000000000, 100000000)


@query("media", sql=f"SELECT folder_path, SUM(file_size)::BIGINT AS size, COUNT(*) AS n, STRING_SPLIT(folder_path, '/')[-1] AS name FROM media WHERE {LIVE} GROUP BY folder_path ORDER BY size DESC, folder_path LIMIT 8")
def a6_by_folder(media):
    return agg.by_folder(media)


@query("media", sql=f"SELECT STRFTIME({TS}, '%Y') AS year, SUM(file_size)::BIGINT AS size, COUNT(*) AS n FROM media WHERE {LIVE} AND creation_date > 0 GROUP BY 1")
def a7_by_year(media):
    return agg.by_year(media)


@query("media", sql=f"SELECT {EXT} AS ext, SUM(file_size)::BIGINT AS size, COUNT(*) AS n, {EXT} IN ({RAW20}) AS raw FROM media WHERE {LIVE} GROUP BY {EXT}")
def a8_by_type(media):
    return agg.by_type(media)


@query("media", sql=f"SELECT {BASE} AS name, file_size, COUNT(*) AS copies, file_size * (COUNT(*) - 1) AS wasted, STRING_AGG(id::VARCHAR, '|' ORDER BY creation_date, id) AS ids FROM media WHERE {LIVE} AND file_size > 0 GROUP BY 1, 2 HAVING COUNT(*) > 1 ORDER BY wasted DESC, 1, 2 LIMIT 40")
def a9_j19_duplicates(media):
    return agg.duplicate_groups(media)


@query("faces", "persons", "media", sql=f"SELECT p.id, ANY_VALUE(p.name) AS name, COUNT(*) AS faces, COUNT(DISTINCT media_id) AS photos FROM persons p JOIN faces f ON f.person_id = p.id JOIN media m ON m.id = f.media_id WHERE {ALIVE} AND hidden = 0 GROUP BY p.id HAVING COUNT(*) >= 2 OR ANY_VALUE(p.name) IS NOT NULL")
def a10_people(faces, persons, media):
    return agg.people(faces, persons, media)


@query(
    "media",
    "analysis",
    sql=f"""SELECT color_bucket, COUNT(*) AS n, STRING_AGG(media_id::VARCHAR, '|' ORDER BY nth) FILTER (nth <= 4) AS covers FROM (
    SELECT color_bucket, media_id, ROW_NUMBER() OVER (PARTITION BY color_bucket ORDER BY color_frac DESC, media_id) AS nth
    FROM analysis JOIN media m ON m.id = media_id WHERE color_bucket > 0 AND {ALIVE}) t GROUP BY color_bucket HAVING COUNT(*) >= 3""",
)
def a11_j6_j18_colour_groups(media, analysis):
    return agg.colour_groups(media, analysis)


Y, M, D = TODAY


@query("media", sql=f"SELECT STRFTIME({TS}, '%Y') AS year, COUNT(*) AS n, ({Y} - YEAR({TS}))::INTEGER AS years_ago FROM media WHERE {ALIVE} AND creation_date > 0 AND YEAR({TS}) < {Y} AND ABS(DATE_DIFF('day', MAKE_DATE(YEAR({TS}), {M}, {D}), {TS}::DATE)) <= 3 GROUP BY YEAR({TS}), 1 HAVING COUNT(*) >= 2")
def a12_on_this_day(media):
    return agg.on_this_day(media, *TODAY)


@query("media", sql=f"SELECT STRFTIME({TS}, '%Y') AS year, COUNT(*) AS n FROM media WHERE {ALIVE} AND creation_date > 0 GROUP BY 1 HAVING COUNT(*) >= 12")
def a13_year_memories(media):
    return agg.by_year(media, flt.alive()).filter("n >= 12").select("year", "n")


@query("media", sql=f"SELECT FLOOR(latitude)::BIGINT AS cell_lat, FLOOR(longitude)::BIGINT AS cell_lon, COUNT(*) AS n FROM media WHERE {ALIVE} AND latitude IS NOT NULL GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 1")
def a14_home_cell(media):
    return agg.home_cell(media.filter(flt.alive() & F.col("latitude").isNotNull()))


USABLE = f"{ALIVE} AND creation_date > 0 AND (mime_type IN ('image/jpeg', 'image/webp') OR mime_type LIKE 'video/%')"


@query("media", sql=f"SELECT 'day' AS kind, STRFTIME({TS}, '%Y-%m-%d') AS date, COUNT(*) AS n FROM media WHERE {USABLE} GROUP BY 2 HAVING COUNT(*) >= 8 UNION ALL SELECT 'month', STRFTIME({TS}, '%Y-%m'), COUNT(*) FROM media WHERE {USABLE} GROUP BY 2 HAVING COUNT(*) >= 16")
def a16_memory_candidates(media):
    return agg.memory_candidates(media)


LABELS = "CASE mime_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in __import__("shutterlake.functions.media", fromlist=["TYPE_LABELS"]).TYPE_LABELS.items()) + " ELSE UPPER(REGEXP_REPLACE(STRING_SPLIT(mime_type, '/')[2], '^(x-)?(vnd\\.)?(ms-)?', '')) END"


@query("media", sql=f"SELECT {LABELS} AS label, STRING_AGG(mime_type, '|' ORDER BY mime_type) AS filter FROM (SELECT DISTINCT mime_type FROM media WHERE mime_type IS NOT NULL) t GROUP BY 1")
def a18_type_groups(media):
    return agg.type_groups(media)


@query("media", sql=f"SELECT DISTINCT folder_path FROM media WHERE {LIVE}")
def a19_folders(media):
    return media.filter(flt.live()).select("folder_path").distinct()


@query("media", sql=f"SELECT creation_date AS median FROM (SELECT creation_date, ROW_NUMBER() OVER (ORDER BY creation_date, id) - 1 AS i, COUNT(*) OVER () AS n FROM media WHERE {ALIVE} AND creation_date > 0) t WHERE i = n // 2")
def a21_median_date(media):
    return agg.upper_median(media.filter(flt.alive() & (F.col("creation_date") > 0)), "creation_date")


@query("ai_embeddings", "doc_files", sql="SELECT COUNT(*) FILTER (LEN(embedding) > 1) AS media, (SELECT COUNT(DISTINCT file_path) FROM doc_files) AS documents FROM ai_embeddings")
def a28_indexed_counts(ai_embeddings, docs):
    return ai_embeddings.agg(F.count_if(F.size("embedding") > 1).alias("media")).crossJoin(docs.agg(F.countDistinct("file_path").alias("documents")))


BUCKET = """CASE WHEN v < 0.16 THEN 10 WHEN s < 0.16 OR d < 0.06 THEN (CASE WHEN v > 0.86 THEN 11 ELSE 12 END)
  WHEN (h < 45 OR h >= 345) AND v < 0.58 AND s < 0.85 THEN 9 WHEN h < 15 OR h >= 345 THEN 1 WHEN h < 40 THEN 2 WHEN h < 68 THEN 3
  WHEN h < 160 THEN 4 WHEN h < 195 THEN 5 WHEN h < 255 THEN 6 WHEN h < 290 THEN 7 ELSE 8 END"""
HISTOGRAM = f"""WITH c AS (SELECT img, r AS ir, g AS ig, b AS ib, r / 255.0::DOUBLE AS r, g / 255.0::DOUBLE AS g, b / 255.0::DOUBLE AS b FROM pixels),
v AS (SELECT *, GREATEST(r, g, b) AS v, GREATEST(r, g, b) - LEAST(r, g, b) AS d FROM c),
h0 AS (SELECT *, CASE WHEN v > 0 THEN d / v ELSE 0 END AS s, CASE WHEN d = 0 THEN NULL WHEN v = r THEN (g - b) / d WHEN v = g THEN (b - r) / d + 2 ELSE (r - g) / d + 4 END * 60.0::DOUBLE AS h1 FROM v),
h AS (SELECT *, CASE WHEN h1 < 0 THEN h1 + 360 ELSE h1 END AS h FROM h0),
x AS (SELECT img, {BUCKET} AS bucket, COUNT(*) AS n, SUM(ir)::BIGINT AS sum_r, SUM(ig)::BIGINT AS sum_g, SUM(ib)::BIGINT AS sum_b FROM h GROUP BY 1, 2)"""


@query("pixels", sql=HISTOGRAM + " SELECT *, n / SUM(n) OVER (PARTITION BY img)::DOUBLE AS share FROM x")
def a29_f20_histogram(pixels):
    return agg.histogram(pixels)


@query(
    "pixels",
    sql=HISTOGRAM
    + """, t AS (SELECT img, SUM(n)::DOUBLE AS total FROM x GROUP BY img),
    k AS (SELECT img, bucket, n / total AS f, ROW_NUMBER() OVER (PARTITION BY img, bucket < 10 ORDER BY n DESC, CASE WHEN bucket < 10 THEN bucket ELSE -bucket END) AS nth FROM x JOIN t USING (img)),
    w AS (SELECT t.img, MAX(f) FILTER (bucket < 10 AND nth = 1) AS f1, MAX(bucket) FILTER (bucket < 10 AND nth = 1) AS b1, COALESCE(MAX(f) FILTER (bucket < 10 AND nth = 2), 0) AS f2,
      MAX(f) FILTER (bucket >= 10 AND nth = 1) AS fz, MAX(bucket) FILTER (bucket >= 10 AND nth = 1) AS bz FROM t LEFT JOIN k ON t.img = k.img GROUP BY t.img)
    SELECT img, CASE WHEN f1 >= CASE WHEN b1 = 9 THEN 0.45 ELSE 0.28 END AND f1 >= f2 * 1.5 THEN b1 WHEN fz >= 0.55 THEN bz ELSE 0 END AS bucket FROM w""",
)
def v9_dominant_colour(pixels):
    return agg.dominant_colour(pixels)


SCALE = "256.0::DOUBLE * 16"


@query(
    "media",
    sql=f"""WITH c AS (SELECT {R2.format('latitude')} AS lat, {R2.format('longitude')} AS lon, COUNT(*) AS n, MIN(id) AS id FROM media WHERE {LIVE} AND latitude <> 0 GROUP BY 1, 2),
    s AS (SELECT *, FLOOR((lon + 180) / 360.0::DOUBLE * {SCALE} / 64)::BIGINT AS cx, FLOOR((0.5::DOUBLE - LN((1 + SIN(RADIANS(lat))) / (1 - SIN(RADIANS(lat)))) / (4 * 3.141592653589793::DOUBLE)) * {SCALE} / 64)::BIGINT AS cy FROM c)
    SELECT cx, cy, SUM(n)::BIGINT AS n, COUNT(*) AS members, FIRST(id ORDER BY n DESC, id) AS lead FROM s GROUP BY cx, cy""",
)
def a30_g4_screen_clusters(media):
    cells = media.filter(flt.live() & (F.col("latitude") != 0)).groupBy(g.hundredths(F.col("latitude")).alias("lat"), g.hundredths(F.col("longitude")).alias("lon"))
    return agg.screen_clusters(cells.agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")), 4)


# ---- orders, limits, sets -----------------------------------------------------------------------


def _order_query(role: int, ascending: bool, sql: str):
    def run(media):
        rows = media.filter(flt.alive()).withColumn("last_viewed", F.lit(0))
        return sorting.placed(rows, sorting.media_keys(role, ascending)).select("place", "id")

    run.__name__ = f"o1_order_{role}_{'asc' if ascending else 'desc'}"
    query("media", sql=f"SELECT ROW_NUMBER() OVER (ORDER BY {sql}) AS place, id FROM (SELECT *, 0 AS last_viewed FROM media WHERE {ALIVE}) t")(run)


AREA = "COALESCE(width, 0) * COALESCE(height, 0)"
for _role, _ascending, _sql in (
    (0, False, "creation_date DESC, id DESC"), (1, True, "modified_date, id"), (2, True, "LOWER(file_path), id"), (3, False, "file_size DESC, id DESC"), (4, True, "last_viewed, id"),
    (5, True, "LOWER(COALESCE(mime_type, '')), creation_date DESC, id DESC"), (6, False, "COALESCE(width, 0) DESC, id DESC"), (7, True, "COALESCE(height, 0), id"), (8, False, f"{AREA} DESC, id DESC"),
    (9, True, f"CASE WHEN COALESCE(width, 0) = 0 OR COALESCE(height, 0) = 0 THEN 3 WHEN width > height THEN 0 WHEN width = height THEN 1 ELSE 2 END, {AREA} DESC, id DESC"),
):
    _order_query(_role, _ascending, _sql)


@query("media", "albums", sql=f"SELECT folder_path, ROW_NUMBER() OVER (ORDER BY is_pinned DESC, n DESC, folder_path)::INTEGER AS place FROM ({ALBUMS}) t")
def o2_o4_album_order(media, albums):
    rows = agg.all_albums(media, albums)
    # a row for each album
    return rows.select("folder_path", F.row_number().over(Window.orderBy(F.desc("is_pinned"), F.desc("n"), "folder_path")).alias("place"))


@query("media", sql=f"SELECT id, ROW_NUMBER() OVER (ORDER BY LOWER({BASE}), id) AS place FROM media WHERE {ALIVE}")
def o3_flat_list(media):
    keys = [(F.lower(paths.base_name(F.col("file_path"))), True), (F.col("id"), True)]
    return sorting.placed(media.filter(flt.alive()), keys).select("id", "place")


@query("media", sql=f"SELECT 'largest' AS list, id FROM (SELECT id FROM media WHERE {LIVE} ORDER BY file_size DESC, id LIMIT 60) a UNION ALL SELECT 'trash', id FROM (SELECT id FROM media WHERE is_trashed = 1 ORDER BY file_size DESC, id LIMIT 1000) b")
def o5_top_sizes(media):
    order = [F.desc("file_size"), F.asc("id")]
    largest = sorting.top(media.filter(flt.live()), order, 60).select(F.lit("largest").alias("list"), "id")
    return largest.union(sorting.top(media.filter("is_trashed = 1"), order, 1000).select(F.lit("trash").alias("list"), "id"))


@query("media")
def o6_random_cover(media):
    return ids(media.filter(flt.alive()).orderBy(F.rand(7)).limit(1))


@query("media", sql=f"SELECT id FROM media WHERE {ALIVE} ORDER BY is_favorite DESC, (id * 2654435761) % 1000, id LIMIT 4")
def o7_hash_sample(media):
    return ids(media.filter(flt.alive()).orderBy(F.desc("is_favorite"), (F.col("id") * F.lit(2654435761)) % 1000, "id").limit(4))


@query("towns", sql="SELECT id, name FROM towns ORDER BY CASE WHEN population > 5000000 THEN 1 WHEN population > 500000 THEN 3 ELSE 5 END, population DESC, id LIMIT 24")
def o10_label_order(cities):
    zoom = F.when(F.col("population") > 5000000, 1).when(F.col("population") > 500000, 3).otherwise(5)
    return cities.orderBy(zoom, F.desc("population"), "id").limit(24).select("id", "name")


@query("media", sql="SELECT file_path FROM media WHERE id % 5 <> 0")
def u2_difference(media):
    present = media.filter("id % 5 = 0").select("file_path")
    return media.select("file_path").join(present, "file_path", "left_anti")


@query("towns", sql="SELECT name FROM towns UNION SELECT country FROM towns")
def u3_distinct_union(cities):
    return cities.select("name").union(cities.select("country")).distinct()


@query("customer", sql="SELECT c_custkey, CONCAT(c_custkey % 5, ',', c_custkey % 3 + 20, ',30') AS merged FROM customer")
def u5_ordered_merge(customer):
    """What was chosen and is still there, in its order, then what is new."""
    k = F.col("c_custkey")
    chosen, out = F.array(k % 5, k % 7 + 10, k % 3 + 20), F.array(k % 3 + 20, F.lit(30).cast("long"), k % 5)
    merged = F.array_union(F.array_intersect(chosen, out), out)
    return customer.select("c_custkey", F.array_join(F.transform(merged, lambda x: x.cast("string")), ",").alias("merged"))


@query("media", "memories", sql="SELECT file_path FROM media WHERE folder_path = '/lib/a1' AND file_path NOT IN (SELECT UNNEST(STRING_SPLIT(sources, '|')) FROM memories)")
def u6_unreferenced(media, memories):
    used = memories.select(F.explode(F.split("sources", r"\|")).alias("file_path"))
    return media.filter("folder_path = '/lib/a1'").select("file_path").join(used, "file_path", "left_anti")


# ---- search -------------------------------------------------------------------------------------


def _search_query(name: str, text: str, where: str):
    def run(media, persons, faces, analysis, cities):
        return ids(find.search(media, text, persons, faces, analysis, joins.places_of(media, cities)))

    run.__name__ = name
    sql = f"SELECT id FROM media WHERE {ALIVE} AND {where} ORDER BY creation_date DESC, id DESC LIMIT {600 if 'CONTAINS' in where else 5000}"
    query("media", "persons", "faces", "analysis", "cities", sql=sql)(run)


_search_query("l4_l5_search_dates", "january 2022", f"creation_date > 0 AND STRFTIME({TS}, '%m') = '01' AND STRFTIME({TS}, '%Y') = '2022'")
_search_query("l3_search_colour", "grey blue 2023", f"id IN (SELECT media_id FROM analysis WHERE color_bucket IN (12, 6)) AND creation_date > 0 AND STRFTIME({TS}, '%Y') = '2023'")
_search_query("l2_search_person", "Bob  2021", f"id IN (SELECT media_id FROM faces WHERE person_id = 1) AND creation_date > 0 AND STRFTIME({TS}, '%Y') = '2021'")
_search_query("l8_l10_search_name", "signup_4", "CONTAINS(LOWER(file_path), 'signup_4')")


@query("media", sql="SELECT DISTINCT folder_path FROM media WHERE CONTAINS(STRING_SPLIT(folder_path, '/')[-1], 'a12') ORDER BY folder_path LIMIT 6")
def l7_album_chips(media):
    return find.album_chips(media, "a12")


@query("media", sql=f"SELECT id, {LABELS} AS label FROM media")
def f5_type_label(media):
    return media.select("id", type_label(F.col("mime_type")).alias("label"))


