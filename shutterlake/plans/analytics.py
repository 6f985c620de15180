"""Queries for windows, vectors, places, layouts and streams, with oracles where SQL has one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.functions import geo
from shutterlake.functions.media import aspect_ratio, clip_seconds
from shutterlake.operators import aggregates as agg
from shutterlake.operators import filters as flt
from shutterlake.operators import joins, layout, vectors, windows
from shutterlake.operators import search as find
from shutterlake.streaming import ingest, timers

from .fixtures import NOW
from .registry import query
from .relational import ALIVE, CHUNK_SQL, TS, USABLE

# ---- windows ------------------------------------------------------------------------------------

MONTHS = f"SELECT STRFTIME({TS}, '%Y-%m') AS month, COUNT(*) AS n FROM media WHERE {ALIVE} GROUP BY 1"


@query("media", sql=f"SELECT month, n, COALESCE(SUM(46.0::DOUBLE + CEIL(n / 5.0::DOUBLE) * 206) OVER (ORDER BY month DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM ({MONTHS}) t")
def w1_row_offsets(media):
    return windows.row_offsets(media.filter(flt.alive()), 5, 200.0, 40.0, 6.0)


@query("media", sql=f"SELECT month FROM (SELECT month, COALESCE(SUM(46.0::DOUBLE + CEIL(n / 5.0::DOUBLE) * 206) OVER (ORDER BY month DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM ({MONTHS}) t) u WHERE top <= 150000 ORDER BY top DESC LIMIT 1")
def w2_row_at(media):
    return windows.row_at(w1_row_offsets(media), 150000.0).select("month")


@query("media", sql=f"SELECT month, STRFTIME(STRPTIME(month || '-01', '%Y-%m-%d'), '%B %Y') AS label, n, COALESCE(SUM(n) OVER (ORDER BY month DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM ({MONTHS}) t")
def w3_month_headers(media):
    return windows.month_starts(media.filter(flt.alive()))


@query("media", sql="SELECT id, LAST_VALUE(CASE WHEN id % 6 = 0 THEN file_path END IGNORE NULLS) OVER (PARTITION BY folder_path ORDER BY id) AS header FROM media")
def w4_carried_forward(media):
    rows = media.withColumn("mark", F.when(F.col("id") % 6 == 0, F.col("file_path")))
    return windows.carried_forward(rows, [(F.col("id"), True)], "mark", "folder_path", "header").select("id", "header")


@query("media", sql=f"SELECT id, month, ((p - 1) // 5)::BIGINT AS row, ((p - 1) % 5)::INTEGER AS col FROM (SELECT id, STRFTIME({TS}, '%Y-%m') AS month, ROW_NUMBER() OVER (PARTITION BY STRFTIME({TS}, '%Y-%m') ORDER BY creation_date DESC, id DESC) AS p FROM media WHERE {ALIVE}) t")
def w7_grid(media):
    return windows.grid(media.filter(flt.alive()), 5)


@query("media")
def w6_justified_rows(media):
    rows = windows.month_rows(media.filter(flt.alive()))
    items = rows.select("month", F.col("position").cast("long").alias("position"), aspect_ratio(F.col("width"), F.col("height"), F.col("position")).alias("ratio"))
    return layout.justified_rows(items, 1200.0)


HOME = f"SELECT FLOOR(latitude) + 0.5 AS hlat, FLOOR(longitude) + 0.5 AS hlon FROM media WHERE {ALIVE} AND latitude IS NOT NULL AND creation_date > 0 GROUP BY FLOOR(latitude), FLOOR(longitude) ORDER BY COUNT(*) DESC, FLOOR(latitude), FLOOR(longitude) LIMIT 1"
KM = "2 * 6371.0::DOUBLE * ASIN(LEAST(1.0::DOUBLE, SQRT(SIN(RADIANS(hlat - latitude) / 2) ** 2 + COS(RADIANS(latitude)) * COS(RADIANS(hlat)) * SIN(RADIANS(hlon - longitude) / 2) ** 2)))"
TRIPS = f"""p AS (SELECT id, creation_date AS t, latitude, longitude, {KM} >= 120 AS away FROM media, ({HOME}) h WHERE {ALIVE} AND latitude IS NOT NULL AND creation_date > 0),
q AS (SELECT *, CASE WHEN away AND (NOT COALESCE(LAG(away) OVER o, FALSE) OR t - LAG(t) OVER o >= 259200) THEN 1 ELSE 0 END AS starts FROM p WINDOW o AS (ORDER BY t, id)),
tr AS (SELECT *, SUM(starts) OVER (ORDER BY t, id)::BIGINT AS trip FROM q),
trips AS (SELECT trip, COUNT(*) AS n, MIN(t) AS first, MAX(t) AS last FROM tr WHERE away GROUP BY trip HAVING COUNT(*) >= 4)"""


@query("media", sql=f"WITH {TRIPS} SELECT trip, n, first, last, (DATE_DIFF('day', MAKE_TIMESTAMP(first * 1000000)::DATE, MAKE_TIMESTAMP(last * 1000000)::DATE) + 1)::INTEGER AS days FROM trips ORDER BY first DESC LIMIT 12")
def w8_t4_trips(media):
    return windows.newest_trips(media).select("trip", "n", "first", "last", "days")


@query("analysis", sql="SELECT color_bucket, media_id, nth::INTEGER AS nth FROM (SELECT color_bucket, media_id, ROW_NUMBER() OVER (PARTITION BY color_bucket ORDER BY color_frac DESC, media_id) AS nth FROM analysis) t WHERE nth <= 4")
def w9_top_per_group(analysis):
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("color_bucket").orderBy(F.desc("color_frac"), "media_id"))
    return analysis.select("color_bucket", "media_id", nth.alias("nth")).filter("nth <= 4")


@query("faces", sql="SELECT id, ROW_NUMBER() OVER (ORDER BY p, person_id) AS place FROM (SELECT id, person_id, ROW_NUMBER() OVER (PARTITION BY person_id ORDER BY score DESC, id) AS p FROM faces WHERE person_id IS NOT NULL) t")
def w10_interleaved(faces):
    decks = faces.filter("person_id is not null").select("id", "score", F.col("person_id").alias("deck"))
    return windows.interleaved(decks, "deck", [(F.col("score"), False), (F.col("id"), True)]).select("id", "place")


@query("faces", sql="WITH m AS (SELECT id, ROW_NUMBER() OVER (ORDER BY score, id) - 1 AS p FROM faces WHERE person_id = 1), o AS (SELECT id, ROW_NUMBER() OVER (ORDER BY score DESC, id) - 1 AS p FROM faces WHERE person_id IS NULL), c AS (SELECT LEAST((SELECT COUNT(*) FROM m), (SELECT COUNT(*) FROM o)) AS c) SELECT id, slot FROM (SELECT id, CASE WHEN p < c THEN 2 * p ELSE c + p END AS slot FROM m, c UNION ALL SELECT id, CASE WHEN p < c THEN 2 * p + 1 ELSE c + p END FROM o, c) t ORDER BY slot LIMIT 24")
def w11_alternating(faces):
    from pyspark.sql import Window

    def ranked(rows: DataFrame, *order) -> DataFrame:
        best = rows.orderBy(*order).limit(24)  # no more can be shown
        return best.select("id", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long").alias("position"))

    mine, others = faces.filter("person_id = 1"), faces.filter("person_id is null")
    both = windows.alternating(ranked(mine, F.asc("score"), F.asc("id")), ranked(others, F.desc("score"), F.asc("id")), 24)
    return both.select("id", "slot")


@query("media", sql=f"SELECT folder_path, id, COALESCE(SUM(s - 0.6::DOUBLE) OVER (PARTITION BY folder_path ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM (SELECT folder_path, id, CASE WHEN mime_type LIKE 'video/%' THEN CASE WHEN duration >= 1.5 THEN LEAST(duration, 6.0::DOUBLE) END ELSE 3.2::DOUBLE END AS s FROM media WHERE {ALIVE}) t WHERE s IS NOT NULL")
def w12_clip_timeline(media):
    clips = media.filter(flt.alive()).select("folder_path", "id", F.col("id").alias("position"), clip_seconds(F.col("mime_type"), F.col("duration")).alias("seconds"))
    return windows.clip_timeline(clips.filter("seconds is not null"), "folder_path").select("folder_path", "id", "start")


# ---- vectors ------------------------------------------------------------------------------------

DOT = "LIST_DOT_PRODUCT(embedding::DOUBLE[], q::DOUBLE[])"
SIX = "FLOOR({} * 1000000 + 0.5) / 1000000.0::DOUBLE"
Q = "(SELECT embedding AS q FROM ai_embeddings WHERE media_id = 8) q"


@query("ai_embeddings", sql=f"SELECT media_id, {SIX.format(DOT)} AS score FROM ai_embeddings, {Q}")
def v1_similarity(ai_embeddings):
    rows = ai_embeddings.crossJoin(vectors.one_vector(ai_embeddings, F.col("media_id") == 8))
    return rows.select("media_id", vectors.rounded(vectors.dot(F.col("embedding"), F.col("q"))).alias("score"))


@query("ai_embeddings", sql=f"SELECT media_id, {SIX.format('(embedding[1] * 3)::DOUBLE / SQRT(LIST_DOT_PRODUCT(LIST_TRANSFORM(embedding, lambda x: (x * 3)::DOUBLE), LIST_TRANSFORM(embedding, lambda x: (x * 3)::DOUBLE)))')} AS first FROM ai_embeddings")
def v2_normalised(ai_embeddings):
    tripled = F.transform("embedding", lambda x: x * F.lit(3).cast("float"))
    return ai_embeddings.select("media_id", vectors.rounded(vectors.normalised(tripled)[0]).alias("first"))


@query(
    "ai_embeddings",
    "media",
    sql=f"""WITH s AS (SELECT media_id AS id, {SIX.format(DOT)} AS score FROM ai_embeddings JOIN media m ON m.id = media_id, {Q} WHERE {ALIVE}),
    r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY score DESC, id)::INTEGER AS rank FROM s), c AS (SELECT AVG(score) + 1.6 * STDDEV_POP(score) AS cut FROM s)
    SELECT id, score, rank FROM r, c WHERE rank <= 240 AND (rank <= 12 OR score >= cut)""",
)
def v3_w14_j15_semantic_search(ai_embeddings, media):
    return vectors.semantic_search(ai_embeddings, media, vectors.one_vector(ai_embeddings, F.col("media_id") == 8))


@query("ai_embeddings", sql=f"SELECT '/docs/' || (media_id // 7)::VARCHAR AS file_path, MAX({SIX.format(DOT)}) AS score FROM ai_embeddings, {Q} GROUP BY 1 ORDER BY score DESC, 1 LIMIT 10")
def a24_o8_best_documents(ai_embeddings):
    chunks = ai_embeddings.select(F.concat(F.lit("/docs/"), F.floor(F.col("media_id") / 7).cast("string")).alias("file_path"), "embedding")
    return vectors.best_documents(chunks, vectors.one_vector(ai_embeddings, F.col("media_id") == 8))


@query(
    "ai_embeddings",
    "scenes",
    sql=f"""WITH s AS (SELECT a.media_id, scene, {DOT.replace('embedding', 'a.embedding')} AS score FROM ai_embeddings a, (SELECT scene, embedding AS q FROM scenes JOIN ai_embeddings ON media_id = vec + 1) p),
    m AS (SELECT scene, AVG(score) AS mean, GREATEST(STDDEV_POP(score), 1e-6) AS sd FROM s GROUP BY scene),
    z AS (SELECT media_id, s.scene, {SIX.format('((score - mean) / sd)')} AS z FROM s JOIN m ON m.scene = s.scene),
    b AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY media_id ORDER BY z DESC, scene) AS nth FROM z) t WHERE nth = 1 AND z > 1.25)
    SELECT scene, media_id, z, n FROM b JOIN (SELECT scene AS sc, COUNT(*) AS n FROM b GROUP BY scene HAVING COUNT(*) >= 3) k ON sc = b.scene""",
)
def v4_a23_j21_c16_scenes(ai_embeddings, scenes):
    prompts = scenes.join(ai_embeddings, F.col("media_id") == F.col("vec") + 1).select("scene", F.col("embedding").alias("q"))
    return vectors.scenes(ai_embeddings, prompts)


CENTROID = "SELECT person_id, i, SUM(x) AS x FROM (SELECT person_id, UNNEST(embedding::DOUBLE[]) AS x, GENERATE_SUBSCRIPTS(embedding, 1) AS i FROM faces WHERE person_id IS NOT NULL) t GROUP BY person_id, i"


@query("faces", sql=f"SELECT person_id, i - 1 AS i, {SIX.format('x / SQRT(SUM(x * x) OVER (PARTITION BY person_id))')} AS x FROM ({CENTROID}) c")
def a22_centroids(faces):
    rows = vectors.centroids(faces).select("person_id", F.posexplode("centroid").alias("i", "x"))
    return rows.select("person_id", F.col("i").cast("long").alias("i"), vectors.rounded(F.col("x")).alias("x"))


@query("faces", "persons", sql=f"WITH c AS (SELECT LIST(x / SQRT(n) ORDER BY i) AS q FROM (SELECT i, x, SUM(x * x) OVER () AS n FROM ({CENTROID}) k WHERE person_id = 2) u) SELECT id, score FROM (SELECT f.id, {SIX.format(DOT)} AS score FROM faces f LEFT JOIN persons p ON p.id = f.person_id, c WHERE p.name IS NULL AND COALESCE(person_id, -1) <> 2 AND excluded_person <> 2) t WHERE score >= 0.1::DOUBLE - 0.15 ORDER BY score DESC, id LIMIT 48")
def v5_j20_suggested_faces(faces, persons):
    return vectors.suggested_faces(faces, persons, 2, threshold=0.1)


REVIEW = f"""c AS (SELECT person_id AS cp, LIST(x / SQRT(n) ORDER BY i) AS q FROM (SELECT person_id, i, x, SUM(x * x) OVER (PARTITION BY person_id) AS n FROM ({CENTROID}) k) u GROUP BY person_id),
    f AS (SELECT f.* FROM faces f JOIN media m ON m.id = f.media_id WHERE {ALIVE}),
    t AS (SELECT p.id AS person, COUNT(*) AS size FROM persons p JOIN f ON f.person_id = p.id WHERE hidden = 0 GROUP BY p.id, name HAVING COUNT(*) >= 2 OR name IS NOT NULL ORDER BY size DESC, p.id LIMIT 6),
    s AS (SELECT person, size, f.id, {SIX.format(DOT)} AS score, COALESCE(f.person_id = person, FALSE) AS mine, excluded_person FROM t JOIN c ON cp = person, f WHERE confirmed = 0),
    r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY person, mine ORDER BY CASE WHEN mine THEN score ELSE ABS(score - 0.38::DOUBLE) END, id) - 1 AS p FROM s WHERE mine OR (excluded_person <> person AND score >= 0.38::DOUBLE - 0.15::DOUBLE)),
    l AS (SELECT *, LEAST(COUNT(*) FILTER (WHERE mine) OVER w, COUNT(*) FILTER (WHERE NOT mine) OVER w) AS c FROM r WINDOW w AS (PARTITION BY person)),
    o AS (SELECT person, size, id, score, mine, CASE WHEN p < c THEN 2 * p + CASE WHEN mine THEN 0 ELSE 1 END ELSE c + p END AS slot FROM l)"""


@query("faces", "persons", "media", sql=f"WITH {REVIEW} SELECT person, id, score, mine, slot FROM o WHERE slot < GREATEST(4, 30 // (SELECT COUNT(*) FROM t)) ORDER BY slot, size DESC, person LIMIT 30")
def v10_o9_review_queue(faces, persons, media):
    """Cards of the largest people, own faces and others in turn, dealt round-robin."""
    return vectors.review_cards(faces, media, agg.people(faces, persons, media), 30)


@query("replies", sql="WITH a AS (SELECT similarity::DOUBLE AS s, answer FROM replies), c AS (SELECT (s + LEAD(s) OVER (ORDER BY s)) / 2 AS cut FROM (SELECT DISTINCT s FROM a) d), e AS (SELECT cut, (SELECT COUNT(*) FROM a WHERE answer = 1 AND s < cut) + (SELECT COUNT(*) FROM a WHERE answer = 0 AND s >= cut) AS errors FROM c WHERE cut IS NOT NULL), b AS (SELECT * FROM e ORDER BY errors, ABS(cut - 0.38), cut LIMIT 1), w AS (SELECT LEAST(0.8::DOUBLE, COUNT(*) / 60.0::DOUBLE) AS w FROM a) SELECT cut, errors, CASE WHEN ABS(LEAST(0.6::DOUBLE, GREATEST(0.25::DOUBLE, 0.38::DOUBLE * (1 - w) + cut * w)) - 0.38::DOUBLE) >= 0.005 THEN LEAST(0.6::DOUBLE, GREATEST(0.25::DOUBLE, 0.38::DOUBLE * (1 - w) + cut * w)) ELSE 0.38::DOUBLE END AS threshold FROM b, w")
def v8_calibration(answers):
    return vectors.calibrated_threshold(answers.select(F.col("similarity").cast("double").alias("similarity"), "answer"), 0.38)


POINTS = "SELECT label, vec_id, CAST(vec_id * 7 % 31 AS DOUBLE) AS x, CAST(vec_id * 11 % 29 AS DOUBLE) AS y, 1.2 * (vec_id * 7 % 31) - 0.5 * (vec_id * 11 % 29) + label AS u, 0.5 * (vec_id * 7 % 31) + 1.2 * (vec_id * 11 % 29) - 4 AS v FROM embeddings"


@query("embeddings", sql=f"SELECT label, 1.2::DOUBLE AS a, 0.5::DOUBLE AS b, label::DOUBLE AS tx, -4.0::DOUBLE AS ty FROM embeddings GROUP BY label")
def v12_similarity_transform(embeddings):
    x, y = (F.col("vec_id") * 7 % 31).cast("double"), (F.col("vec_id") * 11 % 29).cast("double")
    rows = embeddings.select("label", x.alias("x"), y.alias("y"), (x * 1.2 - y * 0.5 + F.col("label")).alias("u"), (x * 0.5 + y * 1.2 - 4).alias("v"))
    out = vectors.similarity_transform(rows, "label")
    return out.select("label", *[vectors.rounded(F.col(c)).alias(c) for c in ("a", "b", "tx", "ty")])


@query("faces")
def v6_a25_face_clusters(faces):
    return vectors.face_clusters(faces, 0.363)


@query("faces")
def v7_a26_claimed_labels(faces):
    return vectors.claimed_labels(vectors.face_clusters(faces, 0.363), faces)


@query("faces")
def a25_cluster_stats(faces):
    return vectors.cluster_stats(vectors.face_clusters(faces, 0.363))


@query("faces")
def v11_j24_kept_boxes(faces):
    return vectors.kept_boxes(faces.select("media_id", "id", "x", "y", "w", "h", "score"), "media_id")


# ---- places -------------------------------------------------------------------------------------

NEAR = """k AS (SELECT s.lat, s.lon, c.name AS city, c.country, c.id AS cid, population, 6371.0::DOUBLE * ACOS(GREATEST(-1.0::DOUBLE, LEAST(1.0::DOUBLE,
    SIN(RADIANS(s.lat)) * SIN(RADIANS(c.lat::DOUBLE)) + COS(RADIANS(s.lat)) * COS(RADIANS(c.lat::DOUBLE)) * COS(RADIANS(c.lon::DOUBLE - s.lon))))) AS km FROM s, cities c),
    n AS (SELECT *, MIN(km) OVER (PARTITION BY lat, lon) AS d FROM k WHERE km <= {km}),
    g AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY lat, lon ORDER BY (km + 1) / (1 + 0.8::DOUBLE * LOG10(GREATEST(population, 5000) / 5000.0::DOUBLE)), cid) AS nth FROM n WHERE km <= GREATEST(1.8 * d, d + 4))"""
SPOTS = f"s AS (SELECT DISTINCT latitude AS lat, longitude AS lon FROM media WHERE {ALIVE} AND latitude IS NOT NULL)"


@query("media", "cities", sql=f"WITH {SPOTS}, {NEAR.format(km=60)} SELECT m.id, city, country FROM media m JOIN g ON g.lat = latitude AND g.lon = longitude WHERE {ALIVE} AND nth = 1".replace("ALIVE", ALIVE))
def g1_g2_g8_j22_places(media, cities):
    return joins.places_of(media, cities).select("id", "city", "country")


SUGGESTED = """s AS (SELECT DISTINCT latitude AS lat, longitude AS lon FROM media WHERE {alive} AND latitude IS NOT NULL), {near},
    here AS (SELECT DISTINCT city, country FROM media m JOIN g ON g.lat = latitude AND g.lon = longitude AND nth = 1 WHERE {alive}),
    c AS (SELECT 0 AS prio, 'person' AS kind, TRIM(name) AS label FROM persons WHERE hidden = 0 AND name IS NOT NULL UNION SELECT 1, 'place', city FROM here UNION SELECT 2, 'country', country FROM here
      UNION SELECT 3, 'album', STRING_SPLIT(folder_path, '/')[-1] FROM media UNION SELECT 4, 'colour', UNNEST({colours}) UNION SELECT 5, 'month', UNNEST({months}) UNION SELECT 6, 'year', STRFTIME({ts}, '%Y') FROM media WHERE creation_date > 0),
    w AS (SELECT * FROM c WHERE LEN(LIST_FILTER(STRING_SPLIT_REGEX(LOWER(label), '[\\s,/_-]+'), lambda x: STARTS_WITH(x, 'b'))) > 0),
    d AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY LOWER(label) ORDER BY prio, kind, label) AS r FROM w)
    SELECT kind, label, prio FROM d WHERE r = 1 ORDER BY prio, label LIMIT 8"""


@query("media", "persons", "cities", sql="WITH " + SUGGESTED.format(alive=ALIVE, near=NEAR.format(km=60), ts=TS, colours=list(find.COLOURS), months=[m.capitalize() for m in find.MONTHS]))
def l9_suggest(media, persons, cities):
    return find.suggest("b", persons, joins.places_of(media, cities), media)


@query("media", "cities", sql=f"WITH {SPOTS}, {NEAR.format(km=60)} SELECT city || ', ' || country AS place, COUNT(*) AS n, MIN(m.id) AS cover FROM media m JOIN g ON g.lat = latitude AND g.lon = longitude WHERE {ALIVE} AND nth = 1 GROUP BY 1".replace("ALIVE", ALIVE))
def a15_places_rollup(media, cities):
    rows = joins.places_of(media, cities)
    return rows.groupBy(geo.place_text(F.col("city"), F.col("country")).alias("place")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("cover"))


@query("media", "cities", sql=f"WITH {SPOTS}, {NEAR.format(km=60)} SELECT m.id FROM media m JOIN g ON g.lat = latitude AND g.lon = longitude WHERE {ALIVE} AND nth = 1 AND city = 'Paris' ORDER BY creation_date DESC, m.id DESC LIMIT 2000".replace("ALIVE", ALIVE))
def c13_place_media(media, cities):
    return joins.places_of(media, cities).filter("city = 'Paris'").orderBy(F.desc("creation_date"), F.desc("id")).limit(2000).select("id")


@query("media", "persons", "faces", "analysis", "cities", sql=f"WITH {SPOTS}, {NEAR.format(km=60)} SELECT id FROM media WHERE {ALIVE} AND id IN (SELECT media_id FROM analysis WHERE color_bucket = 1) AND id IN (SELECT m.id FROM media m JOIN g ON g.lat = latitude AND g.lon = longitude WHERE nth = 1 AND country = 'Japan') ORDER BY creation_date DESC, id DESC LIMIT 5000")
def l6_search_place(media, persons, faces, analysis, cities):
    return find.search(media, "japan red", persons, faces, analysis, joins.places_of(media, cities)).select("id")


@query(
    "media",
    "cities",
    sql=f"""WITH {SPOTS}, {NEAR.format(km=60)}, {TRIPS}, l AS (SELECT * FROM trips ORDER BY first DESC LIMIT 12),
    x AS (SELECT trip, city, country FROM media m JOIN g ON g.lat = latitude AND g.lon = longitude AND nth = 1 JOIN l ON creation_date BETWEEN first AND last WHERE {ALIVE}),
    a AS (SELECT trip, COUNT(*) AS n, COUNT(DISTINCT country) AS cs FROM x GROUP BY trip),
    c AS (SELECT trip, city, COUNT(*) AS k, ROW_NUMBER() OVER (PARTITION BY trip ORDER BY COUNT(*) DESC, city) AS r FROM x GROUP BY trip, city),
    o AS (SELECT trip, country, COUNT(*) AS k, ROW_NUMBER() OVER (PARTITION BY trip ORDER BY COUNT(*) DESC, country) AS r FROM x GROUP BY trip, country)
    SELECT a.trip, CASE WHEN c.k * 2 >= n THEN city WHEN cs = 1 OR o1.k >= n * 0.6 THEN o1.country ELSE o1.country || ' & ' || o2.country END AS name
    FROM a JOIN c ON c.trip = a.trip AND c.r = 1 JOIN o o1 ON o1.trip = a.trip AND o1.r = 1 LEFT JOIN o o2 ON o2.trip = a.trip AND o2.r = 2""",
)
def a27_trip_names(media, cities):
    return windows.trip_names(joins.places_of(media, cities), windows.newest_trips(media))


@query(
    "media",
    "cities",
    sql=f"""WITH s AS (SELECT lat, lon, n FROM (SELECT FLOOR(latitude * 100 + 0.5) / 100.0::DOUBLE AS lat, FLOOR(longitude * 100 + 0.5) / 100.0::DOUBLE AS lon, COUNT(*) AS n FROM media WHERE COALESCE(is_trashed, 0) = 0 AND latitude <> 0 AND longitude <> 0 GROUP BY 1, 2) t ORDER BY n DESC, lat, lon LIMIT 500),
    {NEAR.format(km=250)} SELECT s.lat, s.lon, s.n, CASE WHEN km > 25 THEN 'near ' || city ELSE COALESCE(city, PRINTF('%.2f', s.lat)) END AS label FROM s LEFT JOIN g ON g.lat = s.lat AND g.lon = s.lon AND nth = 1""",
)
def p22_place_rows(media, cities):
    cells = agg.geo_cells(media).withColumn("key", F.concat_ws(",", F.col("lat").cast("string"), F.col("lon").cast("string")))
    near = joins.near_places(cells.select("key", "lat", "lon"), cities, 250)
    label = F.when(F.col("km") > 25, F.concat(F.lit("near "), "city")).otherwise(F.coalesce("city", F.format_string("%.2f", F.col("lat"))))
    return cells.join(near, "key", "left").select("lat", "lon", "n", label.alias("label"))


@query("media")
def g3_pins(media):
    return layout.pins(agg.geo_cells(media), 300.0)


@query("media", sql=f"SELECT folder_path, FLOOR(MAX(km) * 10 + 0.5) / 10.0::DOUBLE AS spread, MAX(km) > 25 AS expand FROM (SELECT folder_path, 2 * 6371.0::DOUBLE * ASIN(LEAST(1.0::DOUBLE, SQRT(SIN(RADIANS(flat - latitude) / 2) ** 2 + COS(RADIANS(latitude)) * COS(RADIANS(flat)) * SIN(RADIANS(flon - longitude) / 2) ** 2))) AS km FROM (SELECT folder_path, latitude, longitude, FIRST_VALUE(latitude) OVER w AS flat, FIRST_VALUE(longitude) OVER w AS flon FROM media WHERE {ALIVE} AND latitude IS NOT NULL WINDOW w AS (PARTITION BY folder_path ORDER BY id)) t) u GROUP BY folder_path")
def g5_spread(media):
    rows = media.filter(flt.alive() & F.col("latitude").isNotNull()).select("folder_path", "id", "latitude", "longitude")
    first = rows.groupBy("folder_path").agg(F.min(F.struct("id", "latitude", "longitude")).alias("f")).select("folder_path", F.col("f.latitude").alias("flat"), F.col("f.longitude").alias("flon"))
    km = geo.haversine_km(F.col("latitude"), F.col("longitude"), F.col("flat"), F.col("flon"))
    by = rows.join(first, "folder_path").groupBy("folder_path").agg(F.max(km).alias("km"))
    return by.select("folder_path", (F.floor(F.col("km") * 10 + 0.5) / 10.0).alias("spread"), (F.col("km") > 25).alias("expand"))


KEYED = f"SELECT id, file_path, mime_type LIKE 'video/%' AS video, 'day' AS kind, STRFTIME({TS}, '%Y-%m-%d') AS date, 8 AS least FROM media WHERE {USABLE} UNION ALL SELECT id, file_path, mime_type LIKE 'video/%', 'month', STRFTIME({TS}, '%Y-%m'), 16 FROM media WHERE {USABLE}"
BATCH = f"""k AS ({KEYED}),
    b AS (SELECT kind, date, date IN (SELECT date FROM memories) AS stale, MD5('7' || kind || date) AS drawn FROM k GROUP BY kind, date HAVING COUNT(*) >= MAX(least) AND COUNT(*) FILTER (WHERE NOT video) + LEAST(COUNT(*) FILTER (WHERE video), 3) >= 6),
    l AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY LEFT(date, 7) ORDER BY stale, drawn) > 1 AS later FROM b),
    c AS (SELECT kind, date, stale, 8 + ASCII(drawn) % 5 AS want, ROW_NUMBER() OVER (ORDER BY later, stale, drawn)::INTEGER AS place FROM l ORDER BY later, stale, drawn LIMIT 5),
    v AS (SELECT c.*, k.id, k.video, MD5('7' || file_path) AS drawn, ROW_NUMBER() OVER (PARTITION BY place, video ORDER BY MD5('7' || file_path), k.id) AS n FROM k JOIN c ON c.kind = k.kind AND c.date = k.date),
    w AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY place ORDER BY drawn, id) AS nth FROM v WHERE NOT video OR n <= 3)"""


@query("media", "memories", sql=f"WITH {BATCH} SELECT place, kind, date, stale, id FROM w WHERE nth <= want")
def a17_u4_memory_batch(media, memories):
    return agg.memory_batch(media, memories)


@query("media", "memories", sql=f"WITH {BATCH} SELECT date, created_at, expires_at, custom FROM memories WHERE custom = 1 UNION ALL SELECT date, {NOW}, {NOW} + 7 * 86400, 0 FROM c UNION ALL SELECT date, created_at, expires_at, custom FROM memories WHERE custom = 0 AND NOT EXISTS (SELECT 1 FROM c)")
def t5_weekly_batch(media, memories):
    return ingest.weekly_batch(memories, agg.memory_batch(media, memories), NOW)


# ---- streams (also as batch, to have an oracle) ---------------------------------------------------


@query("events", sql="SELECT DATE_TRUNC('day', ts) AS start, event_type, COUNT(*) AS n, SUM(value) AS value FROM events GROUP BY 1, 2")
def t_daily_activity(events):
    out = ingest.activity(events)
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("events", sql="SELECT user_id, MIN(ts) AS start, MAX(ts) + INTERVAL 12 HOUR AS \"end\", COUNT(*) AS n FROM (SELECT *, SUM(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events) a) b GROUP BY user_id, s")
def t_sessions(events):
    out = ingest.sessions(events, "user_id", "12 hours")
    return out.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


@query("events", sql="SELECT event_type, MAX(ts) + INTERVAL 10 MINUTE AS fires, COUNT(*) AS n FROM (SELECT *, SUM(new) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - LAG(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) <= INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM events) a) b GROUP BY event_type, s")
def t2_coalesced_refreshes(events):
    return ingest.coalesced(events, "event_type", "10 minutes").withColumn("fires", F.col("fires").cast("timestamp_ntz"))


@query("doc_files", sql=f"SELECT file_path, COUNT(*) AS chunks FROM ({CHUNK_SQL}) t GROUP BY file_path")
def f24_chunk_counts(docs):
    from shutterlake.sources.files import document_chunks

    return document_chunks(docs).groupBy("file_path").agg(F.count(F.lit(1)).alias("chunks"))




def messages_of(events: DataFrame) -> DataFrame:
    """Requests and answers made of events: every event asks with a number of its own, and is answered up to three hours later."""
    asked = events.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.lit(False).alias("answers"), F.col("event_id").alias("generation"), F.col("event_id").alias("id"))
    late = F.col("ts") + F.make_interval(secs=(F.col("id") * 7919 % 10800).cast("decimal(18,6)"))
    return asked.unionByName(asked.withColumns({"ts": late, "answers": F.lit(True)}))


@query(
    "events",
    sql="""WITH a AS (SELECT user_id AS key, ts + (event_id * 7919 % 10800) * INTERVAL 1 SECOND AS ts, event_id AS generation FROM events)
    SELECT key, generation AS id, ts, generation FROM a WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = a.key AND e.ts <= a.ts AND e.event_id > a.generation)""",
)
def t7_latest_answers(events):
    return timers.latest_answers_of(messages_of(events)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
