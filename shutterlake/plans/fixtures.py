"""Tables of a media library derived from the driver's tables, by one SQL text for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The clock of all queries: 2024-01-20 12:00 UTC.
NOW, TODAY = 1705752000, (2024, 1, 20)

_MEDIA = """
SELECT id, folder_path, CONCAT(folder_path, '/', stem, '.', ext) AS file_path, file_size,
  CASE WHEN id % 101 = 0 THEN NULL WHEN LOWER(ext) IN ('jpg') THEN 'image/jpeg' WHEN ext = 'png' THEN 'image/png'
       WHEN ext = 'heic' THEN 'image/heic' WHEN ext = 'webp' THEN 'image/webp' WHEN ext = 'gif' THEN 'image/gif'
       WHEN ext = 'nef' THEN 'image/x-nikon-nef' WHEN ext = 'cr2' THEN 'image/x-canon-cr2' WHEN ext = 'dng' THEN 'image/x-adobe-dng'
       WHEN ext = 'mp4' THEN 'video/mp4' WHEN ext = 'mov' THEN 'video/quicktime' ELSE 'video/vnd.avi' END AS mime_type,
  CASE WHEN id % 89 = 0 THEN 0 ELSE e END AS creation_date, e + 60 AS modified_date,
  (id * 37) % 4000 AS width, (id * 53) % 3000 AS height,
  CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END AS is_favorite, CASE WHEN id % 11 = 0 THEN 1 ELSE 0 END AS is_trashed,
  CASE WHEN id % 13 = 0 THEN 1 ELSE 0 END AS is_hidden, CASE WHEN id % 17 = 0 THEN 1 ELSE 0 END AS is_ignored,
  CASE WHEN id % 3 = 0 THEN NULL WHEN away = 1 THEN CAST(3560 + u % 30 AS DOUBLE) / 100 ELSE CAST(4880 + u % 30 AS DOUBLE) / 100 END AS latitude,
  CASE WHEN id % 3 = 0 THEN NULL WHEN away = 1 THEN CAST(13960 + u % 20 AS DOUBLE) / 100 ELSE CAST(230 + u % 20 AS DOUBLE) / 100 END AS longitude,
  CASE WHEN ext IN ('mp4','mov','avi') THEN CAST(id % 120 AS DOUBLE) / 10 ELSE CAST(0 AS DOUBLE) END AS duration,
  CASE WHEN id % 11 = 0 THEN e + 86400 * (id % 60) ELSE NULL END AS trashed_at
FROM (SELECT *, CASE WHEN day % 10 IN (3, 4) THEN 1 ELSE 0 END AS away,
        CONCAT('/lib/a', CAST(CAST(FLOOR(CAST(id AS DOUBLE) / 300) AS BIGINT) AS STRING)) AS folder_path,
        CONCAT(et, '_', CAST(id % 100 AS STRING)) AS stem,
        CASE id % 12 WHEN 0 THEN 'jpg' WHEN 1 THEN 'JPG' WHEN 2 THEN 'png' WHEN 3 THEN 'heic' WHEN 4 THEN 'mp4' WHEN 5 THEN 'nef'
             WHEN 6 THEN 'cr2' WHEN 7 THEN 'webp' WHEN 8 THEN 'mov' WHEN 9 THEN 'gif' WHEN 10 THEN 'dng' ELSE 'avi' END AS ext,
        (id % 20) * 1000 AS file_size
      FROM (SELECT *, CAST(FLOOR(CAST(e AS DOUBLE) / 86400) AS BIGINT) AS day
            FROM (SELECT event_id AS id, user_id AS u, event_type AS et, {epoch} - 31536000 * (user_id % 5) AS e FROM {events}) r0) r1) r2
"""

_CITIES = (
    ("Paris", "France", 48.8566, 2.3522, 2148000), ("Versailles", "France", 48.8014, 2.1301, 85000), ("Boulogne-Billancourt", "France", 48.8352, 2.2410, 120000),
    ("Saint-Denis", "France", 48.9362, 2.3574, 110000), ("Montreuil", "France", 48.8638, 2.4485, 109000), ("Lyon", "France", 45.7640, 4.8357, 513000),
    ("Marseille", "France", 43.2965, 5.3698, 861000), ("Nice", "France", 43.7102, 7.2620, 342000), ("Tokyo", "Japan", 35.6895, 139.6917, 8336000),
    ("Yokohama", "Japan", 35.4437, 139.6380, 3726000), ("Kawasaki", "Japan", 35.5308, 139.7029, 1475000), ("Chiba", "Japan", 35.6073, 140.1063, 970000),
    ("Saitama", "Japan", 35.8617, 139.6455, 1263000), ("Osaka", "Japan", 34.6937, 135.5023, 2691000), ("Kyoto", "Japan", 35.0116, 135.7681, 1475000),
    ("London", "United Kingdom", 51.5074, -0.1278, 8982000), ("Oxford", "United Kingdom", 51.7520, -1.2577, 152000), ("Berlin", "Germany", 52.5200, 13.4050, 3645000),
    ("Potsdam", "Germany", 52.3906, 13.0645, 178000), ("Munich", "Germany", 48.1351, 11.5820, 1472000), ("Rome", "Italy", 41.9028, 12.4964, 2873000),
    ("Milan", "Italy", 45.4642, 9.1900, 1352000), ("Madrid", "Spain", 40.4168, -3.7038, 3223000), ("Barcelona", "Spain", 41.3851, 2.1734, 1620000),
    ("New York", "United States", 40.7128, -74.0060, 8337000), ("Newark", "United States", 40.7357, -74.1724, 281000), ("Boston", "United States", 42.3601, -71.0589, 692000),
    ("San Francisco", "United States", 37.7749, -122.4194, 883000), ("Oakland", "United States", 37.8044, -122.2711, 433000), ("Sydney", "Australia", -33.8688, 151.2093, 5312000),
    ("Melbourne", "Australia", -37.8136, 144.9631, 5078000), ("Cape Town", "South Africa", -33.9249, 18.4241, 4618000), ("Singapore", "Singapore", 1.3521, 103.8198, 5686000),
    ("Monaco", "Monaco", 43.7384, 7.4246, 39000), ("Cairo", "Egypt", 30.0444, 31.2357, 9540000), ("Mumbai", "India", 19.0760, 72.8777, 12442000),
    ("Delhi", "India", 28.7041, 77.1025, 16788000), ("Sao Paulo", "Brazil", -23.5505, -46.6333, 12330000), ("Toronto", "Canada", 43.6532, -79.3832, 2731000),
    ("Fontainebleau", "France", 48.4040, 2.7010, 15000),
)


#: Driver tables that derived tables read.
GIVEN = ("events", "embeddings", "documents", "customer", "supplier", "nation", "part", "orders", "labels")


def _values(columns: str, rows: list[str]) -> str:
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS t({columns})"


_INLINE = {
    "albums": _values(
        "path_prefix, name, custom_name, is_pinned, is_ignored, cover_path, description",
        [
            "('/lib/a0', 'a0', NULL, 0, 1, NULL, NULL)",
            "('/lib/a1', 'One', 'First album', 1, 0, '/covers/one.jpg', 'the first')",
            "('/lib/a2', 'a2', '', 0, 0, NULL, NULL)",
            "('/lib/a5', 'a5', NULL, 0, 1, NULL, 'hidden away')",
            "('__virtual__Best_of', 'Best of', NULL, 0, 0, '/lib/a2/view_7.png', 'picked')",
        ],
    ),
    "album_rows": _values(
        "id, path_prefix, name",
        ["(1, '/lib/a0', 'old')", "(2, '/lib/a0', 'new')", "(3, '/lib/a1', 'one')", "(4, NULL, 'lost')", "(5, '/lib/a0', 'newest')", "(6, NULL, 'lost too')"],
    ),
    "persons": _values(
        "id, name, hidden, cover_face_id",
        ["(0, 'Ann Lee', 0, 0)", "(1, 'Bob', 0, 12)", "(2, CAST(NULL AS STRING), 0, 24)", "(3, ' ann lee ', 0, 3)", "(4, 'Cara Diaz', 1, NULL)", "(5, 'Dan', 0, 9999999)", "(6, NULL, 0, NULL)", "(77, NULL, 0, NULL)", "(78, 'Eve', 0, NULL)"],
    ),
    "memories": _values(
        "id, date, title, sources, created_at, expires_at, custom",
        [
            "(1, '2023-05-18', 'Spring', '/lib/a1/click_1.JPG', 1700000000, 1705800000, 0)",
            "(2, '2022-07', 'July', '', 1700000000, 1705700000, 0)",
            "(3, '2024-01-02', 'Trip', '/lib/a0/view_1.JPG|/gone.jpg', 1704000000, 1706000000, 1)",
            "(4, '2021-12-31', 'Party', '/gone.jpg', 1690000000, 1691000000, 0)",
        ],
    ),
    "settings_kv": _values("key, value", ["('sort_pref_albums', '3,1')", "('sort_pref_timeline', 'x')", "('people_threshold', '0.42')", "('trash_days', '30')", "('config', '{\"theme\": \"dark\", \"columns\": 5, \"raw\": true}')"]),
    "exclusions": _values("pattern", ["('/a1')", "('a22')", "('')", "('/A3')"]),
    "directories": _values("path, item_count, last_scan, is_active", ["('/lib', 10, 1700000000, 1)", "('/old', 0, 0, 0)", "('/lib/a7', 3, 1690000000, 1)"]),
    "cities": _values("id, name, country, lat, lon, population", [f"({i}, '{n}', '{c}', {lat}, {lon}, {p})" for i, (n, c, lat, lon, p) in enumerate(_CITIES)]),
    "answers": _values("similarity, answer", ["(0.31, 1)", "(0.52, 1)", "(0.47, 1)", "(0.28, 0)", "(0.35, 0)", "(0.40, 0)", "(0.44, 1)", "(0.22, 0)", "(0.61, 1)", "(0.39, 0)"]),
    "scenes": _values("scene, name, vec", [f"({n}, '{name}', {n * 7})" for n, name in enumerate(("Sunsets", "Beaches", "Mountains", "Snow", "Forests", "Lakes & rivers"))]),
}

#: Tables made of driver tables: SQL text, and the driver table it reads.
_DERIVED = {
    "media": (_MEDIA, "events"),
    "faces": (
        "SELECT vec_id AS id, vec_id * 3 % 997 + 1 AS media_id, CAST(vec_id % 10 AS DOUBLE) / 20 AS x, CAST(vec_id % 7 AS DOUBLE) / 20 AS y, "
        "CAST(vec_id % 5 + 1 AS DOUBLE) / 10 AS w, CAST(vec_id % 4 + 1 AS DOUBLE) / 10 AS h, CAST(vec_id * 17 % 100 AS DOUBLE) / 100 AS score, embedding, "
        "CASE WHEN vec_id % 2 = 0 THEN CAST(label AS BIGINT) ELSE NULL END AS person_id, CASE WHEN vec_id % 10 = 0 THEN 1 ELSE 0 END AS confirmed, "
        "CASE WHEN vec_id % 9 = 0 THEN CAST(label AS BIGINT) ELSE CAST(-1 AS BIGINT) END AS excluded_person FROM {embeddings}",
        "embeddings",
    ),
    "ai_embeddings": ("SELECT vec_id + 1 AS media_id, embedding, CASE WHEN vec_id % 50 = 3 THEN 'old' ELSE 'v2' END AS model_ver FROM {embeddings}", "embeddings"),
    "analysis": (
        "SELECT id AS media_id, id * 5 % 13 AS color_bucket, CAST(id * 7 % 100 AS DOUBLE) / 100 AS color_frac, id * 9973 % 16777216 AS avg_rgb, "
        "CASE WHEN id % 5 = 0 THEN 0 ELSE 1 END AS faces_done, CASE WHEN id % 23 = 0 THEN 0 ELSE 1 END AS version FROM ({media}) m0 WHERE id % 4 <> 0",
        "media",
    ),
    "doc_files": ("SELECT CONCAT('/docs/', CAST(doc_id AS STRING), '.txt') AS file_path, text FROM {documents}", "documents"),
    "pixels": (
        "SELECT id % 40 AS img, id AS n, id * 37 * (id % 40 + 1) % 256 AS r, id * 91 % (id % 40 * 6 + 5) AS g, id * 53 % (250 - id % 40 * 6) AS b FROM ({media}) m0",
        "media",
    ),
    "shores": (
        "SELECT c_custkey AS region, 0 AS ring, n, CASE c_custkey % 3 WHEN 0 THEN CAST(2.4 AS DOUBLE) WHEN 1 THEN CAST(139.7 AS DOUBLE) ELSE CAST(c_custkey * 73 % 320 - 160 AS DOUBLE) END "
        "+ CAST(c_custkey * 29 % 40 - 20 AS DOUBLE) / 100 + CAST(dx * (c_custkey % 4 + 1) AS DOUBLE) / 200 AS x, CASE c_custkey % 3 WHEN 0 THEN CAST(48.95 AS DOUBLE) WHEN 1 THEN CAST(35.75 AS DOUBLE) "
        "ELSE CAST(c_custkey * 37 % 120 - 60 AS DOUBLE) END + CAST(c_custkey * 13 % 40 - 20 AS DOUBLE) / 100 + CAST(dy * (c_custkey % 4 + 1) AS DOUBLE) / 200 AS y "
        "FROM {customer} c0 CROSS JOIN (VALUES (0, -3, 0), (1, -1, 2), (2, 2, 3), (3, 3, 0), (4, 1, -3), (5, -2, -2)) AS t(n, dx, dy)",
        "customer",
    ),
    "towns": (
        "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN CONCAT('New Yo', CAST(c_custkey % 97 AS STRING)) WHEN 1 THEN CONCAT('Boville_', CAST(c_custkey AS STRING)) "
        "WHEN 2 THEN CONCAT('Land', CAST(c_nationkey AS STRING)) ELSE CONCAT('San Yolo/', c_mktsegment) END AS name, CONCAT('Land', CAST(c_nationkey AS STRING)) AS country, "
        "CAST(c_custkey * 37 % 18000 - 9000 AS DOUBLE) / 100 AS lat, CAST(c_custkey * 73 % 36000 - 18000 AS DOUBLE) / 100 AS lon, c_custkey * 7919 % 9000000 AS population FROM {customer}",
        "customer",
    ),
    "rolls": (
        "SELECT CONCAT(CASE c_custkey % 5 WHEN 0 THEN '__virtual__' ELSE '/lib/' END, 'a', CAST(c_custkey AS STRING)) AS path_prefix, c_name AS name, "
        "CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE CONCAT('Album ', CAST(c_custkey AS STRING)) END AS custom_name, CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END AS is_pinned FROM {customer}",
        "customer",
    ),
    "roll_rows": (
        "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CONCAT('/lib/a', CAST(o_custkey AS STRING)) END AS path_prefix, o_orderpriority AS name FROM {orders}",
        "orders",
    ),
    "recollections": (
        "SELECT o_orderkey AS id, CAST(CAST(o_orderdate AS DATE) AS STRING) AS date, CASE o_orderkey % 4 WHEN 0 THEN 'Trip' WHEN 1 THEN 'Party' WHEN 2 THEN 'spring' ELSE CONCAT('July', CAST(o_custkey AS STRING)) END AS title, "
        "CASE WHEN o_orderkey % 9 = 0 THEN 1 ELSE 0 END AS custom, 1705752000 + (o_orderkey % 200 - 100) * 86400 AS expires_at FROM {orders}",
        "orders",
    ),
    "preferences": (
        "SELECT CONCAT(CASE c_custkey % 3 WHEN 0 THEN 'config_' WHEN 1 THEN 'sort_pref_' ELSE 'threshold_' END, CAST(c_custkey AS STRING)) AS key, CASE c_custkey % 3 "
        "WHEN 0 THEN CONCAT(CHR(123), '\"theme\": \"dark', CAST(c_custkey AS STRING), '\", \"columns\": ', CAST(c_custkey % 9 AS STRING), CHR(125)) "
        "WHEN 1 THEN CASE c_custkey % 4 WHEN 0 THEN 'x' WHEN 1 THEN '3' ELSE CONCAT(CAST(c_custkey % 10 AS STRING), ',', CAST(c_custkey % 2 AS STRING)) END "
        "ELSE CONCAT('0.', CAST(c_custkey % 90 + 10 AS STRING)) END AS value FROM {customer}",
        "customer",
    ),
    "roots": (
        "SELECT CONCAT('/lib/a', CAST(c_custkey AS STRING)) AS path, c_custkey % 50 AS item_count, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END AS is_active FROM {customer}",
        "customer",
    ),
    "patterns": ("SELECT CONCAT('/p', CAST(s_suppkey AS STRING)) AS pattern FROM {supplier}", "supplier"),
    "replies": (
        "SELECT CAST(vec_id * 37 % 500 AS DOUBLE) / 1000 + CAST(0.1 AS DOUBLE) AS similarity, CASE WHEN vec_id * 37 % 500 + vec_id * 11 % 200 > 380 THEN 1 ELSE 0 END AS answer FROM {embeddings}",
        "embeddings",
    ),
    "said": (
        "SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN CONCAT('no place ', CAST(c_custkey AS STRING)) WHEN 1 THEN CONCAT(CAST(c_custkey % 90 AS STRING), '.5+24.9') WHEN 2 THEN CONCAT('+1.2.', CAST(c_custkey AS STRING), '+4') "
        "WHEN 3 THEN CONCAT('-', CAST(c_custkey % 90 AS STRING), '.25-', CAST(c_custkey % 180 AS STRING), '.75+026.400/') ELSE CONCAT('+', LPAD(CAST(c_custkey % 90 AS STRING), 2, '0'), '.', LPAD(CAST(c_custkey * 7 % 10000 AS STRING), 4, '0'), '+', LPAD(CAST(c_custkey % 180 AS STRING), 3, '0'), '.5/') END AS place FROM {customer}",
        "customer",
    ),
    "releases": (
        "SELECT CASE c_custkey % 6 WHEN 0 THEN CONCAT('nope', CAST(c_custkey AS STRING)) WHEN 1 THEN CONCAT('v', CAST(c_custkey % 3 AS STRING), '.', CAST(c_custkey % 11 AS STRING), '.', CAST(c_custkey AS STRING), '-beta') "
        "ELSE CONCAT(CASE WHEN c_custkey % 2 = 0 THEN 'v' ELSE '' END, CAST(c_custkey % 3 AS STRING), '.', CAST(c_custkey % 11 AS STRING), '.', CAST(c_custkey AS STRING)) END AS version FROM {customer}",
        "customer",
    ),
    "samples": ("SELECT event_id - (SELECT MIN(event_id) FROM {events}) AS idx, event_id * 7919 % 65536 - 32768 AS s FROM {events}", "events"),
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the library as a lazy DataFrame."""
    if name in _INLINE:
        return spark.sql(_INLINE[name])
    if name not in _DERIVED:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text, source = _DERIVED[name]
    if source == "media":
        return spark.sql(text.replace("({media}) m0", "{media}"), media=load(spark, sf_dir, "media"))
    return spark.sql(text.replace("{epoch}", "UNIX_SECONDS(CAST(ts AS TIMESTAMP))"), **{source: load(spark, sf_dir, source)})


def with_tables(names: tuple[str, ...], sql: str) -> str:
    """``sql`` for DuckDB with the library's tables as common table expressions."""
    parts = []
    for name in names:
        text = _INLINE.get(name) or (_DERIVED[name][0] if name in _DERIVED else None)
        if text is not None:
            text = text.replace("{media}", _MEDIA).replace("{epoch}", "CAST(FLOOR(EPOCH(ts)) AS BIGINT)")
            for table in GIVEN:
                text = text.replace("{" + table + "}", table)
            parts.append(f"{name} AS ({text})")
    if not parts:
        return sql
    own = next((w for w in ("WITH RECURSIVE ", "WITH ") if sql.lstrip().upper().startswith(w)), "")
    head = (own or "WITH ") + ",\n".join(parts)
    return head + (",\n" + sql.lstrip()[len(own) :] if own else "\n" + sql)
