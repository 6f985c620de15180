"""Queries for changes of the library, each with its SQL oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from shutterlake.operators import dml, moves, revisions
from shutterlake.operators.sorting import checkpointed
from shutterlake.streaming.ingest import live_memories

from .fixtures import NOW
from .registry import query

ENTRIES = "SELECT CONCAT(file_path, CASE WHEN id % 20 = 0 THEN '.new' ELSE '' END) AS file_path, folder_path, file_size + 1 AS file_size, mime_type, creation_date, modified_date, width, height, 0.0 + COALESCE(latitude, 0) AS latitude, 0.0 + COALESCE(longitude, 0) AS longitude, duration FROM media WHERE id % 4 = 0"
SHOWN = ("id", "file_path", "file_size", "latitude", "is_favorite", "is_trashed")


@query(
    "media",
    sql=f"""WITH e AS ({ENTRIES}) SELECT COALESCE(m.id, (SELECT MAX(id) FROM media) + ROW_NUMBER() OVER (PARTITION BY m.id IS NULL ORDER BY REGEXP_EXTRACT(e.file_path, '^.*/'), e.file_path))::BIGINT AS id, COALESCE(m.file_path, e.file_path) AS file_path, COALESCE(e.file_size, m.file_size) AS file_size,
    CASE WHEN e.file_path IS NOT NULL THEN NULLIF(e.latitude, 0) ELSE m.latitude END AS latitude, COALESCE(is_favorite, 0) AS is_favorite, COALESCE(is_trashed, 0) AS is_trashed
    FROM media m FULL JOIN e ON e.file_path = m.file_path""",
)
def d1_t10_upsert(media):
    new = media.filter("id % 4 = 0").withColumns({"file_path": F.concat("file_path", F.when(F.col("id") % 20 == 0, ".new").otherwise("")), "file_size": F.col("file_size") + 1, "latitude": F.coalesce("latitude", F.lit(0.0)), "longitude": F.coalesce("longitude", F.lit(0.0))})
    return dml.upsert_media(media, new.select("file_path", *dml.METADATA)).select(*SHOWN)


@query("media", sql="SELECT path, size FROM (SELECT CONCAT(file_path, CASE WHEN id % 7 = 0 THEN 'x' ELSE '' END) AS path, file_size + id % 2 AS size FROM media) f LEFT JOIN media m ON m.file_path = path WHERE m.id IS NULL OR file_size <> size OR creation_date = 0 OR width = 0 OR height = 0")
def d3_needs_update(media):
    found = media.select(F.concat("file_path", F.when(F.col("id") % 7 == 0, "x").otherwise("")).alias("path"), (F.col("file_size") + F.col("id") % 2).alias("size"))
    return dml.needs_update(media, found)


@query("media", sql="SELECT file_path FROM media WHERE id % 9 = 0")
def d4_d5_missing(media):
    return dml.prune_missing(media.select("file_path"), media.filter("id % 9 <> 0").select("file_path"), 100)


@query("media", sql="SELECT 'media' AS list, file_path FROM media WHERE id % 9 <> 0 UNION ALL SELECT 'thumbnails', file_path FROM media WHERE id % 9 <> 0 AND id % 2 = 0")
def d5_orphan_sweep(media):
    kept, thumbnails = dml.swept(media, media.filter("id % 2 = 0").select("file_path"), media.filter("id % 9 <> 0").select(F.col("file_path").alias("path")))
    return kept.select(F.lit("media").alias("list"), "file_path").unionByName(thumbnails.select(F.lit("thumbnails").alias("list"), "file_path"))


@query("media", sql=f"SELECT id FROM media WHERE NOT (is_trashed = 1 AND COALESCE(trashed_at, 0) < {NOW} - 30 * 86400)")
def d6_t6_purge(media):
    return dml.purge_trash(media, NOW, 30).select("id")


@query("media", sql=f"SELECT id, CASE WHEN id % 10 = 0 THEN 1 WHEN id % 10 = 1 THEN 0 ELSE is_trashed END AS is_trashed, CASE WHEN id % 10 = 0 THEN {NOW} WHEN id % 10 = 1 THEN NULL ELSE trashed_at END AS trashed_at FROM media")
def d7_trash(media):
    out = dml.set_trashed(media, F.col("id") % 10 == 0, True, NOW)
    return dml.set_trashed(out, F.col("id") % 10 == 1, False, NOW).select("id", "is_trashed", "trashed_at")


@query("media", sql=f"SELECT id, CASE WHEN id % 3 = 0 THEN 1 - is_favorite ELSE is_favorite END AS is_favorite, CASE WHEN id % 6 = 1 THEN 1 ELSE is_hidden END AS is_hidden, CASE WHEN id = 5 THEN {NOW} ELSE 0 END AS last_viewed FROM media")
def d8_d9_d29_flags(media):
    out = dml.toggle_favourite(media.withColumn("last_viewed", F.lit(0)), F.col("id") % 3 == 0)
    out = dml.update_where(out, F.col("id") % 6 == 1, is_hidden=F.lit(1))
    return dml.update_where(out, F.col("id") == 5, last_viewed=F.lit(NOW)).select("id", "is_favorite", "is_hidden", "last_viewed")


@query("rolls", sql="SELECT path_prefix, CASE WHEN path_prefix = '/lib/a2' THEN 1 ELSE is_pinned END AS is_pinned FROM rolls UNION ALL SELECT '/new/a9', 1")
def d10_d11_album_upsert(albums):
    changes = albums.sparkSession.sql("SELECT * FROM (VALUES ('/lib/a2', 1), ('/new/a9', 1)) AS t(path_prefix, is_pinned)")
    return dml.album_upsert(albums, changes).select("path_prefix", "is_pinned")


@query("roll_rows", sql="SELECT id, path_prefix, name FROM roll_rows WHERE id IN (SELECT MAX(id) FROM roll_rows WHERE path_prefix IS NOT NULL GROUP BY path_prefix)")
def d14_newest_albums(rows):
    return dml.newest_album_rows(rows)


@query(
    "media",
    sql=r"""WITH w AS (SELECT id, file_path, CASE WHEN id % 3 = 0 THEN '/lib/a0' ELSE '/lib/a' || (id % 5 + 1) END AS target, REGEXP_EXTRACT(file_path, '[^/]*$') AS name FROM media WHERE id % 4 <> 1),
      r AS (SELECT *, REGEXP_EXTRACT(name, '^(.*)\.([^.]*)$', 1) AS base, REGEXP_EXTRACT(name, '[^.]*$') AS ext, target || '/' || name AS wanted FROM w WHERE target || '/' || name <> file_path),
      k AS (SELECT *, wanted NOT IN (SELECT file_path FROM media) AND ROW_NUMBER() OVER (PARTITION BY wanted ORDER BY id) = 1 AS keeps FROM r),
      n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY target, base, ext ORDER BY id) AS place, COUNT(*) OVER (PARTITION BY target, base, ext) AS movers FROM k WHERE NOT keeps),
      used AS (SELECT file_path FROM media UNION SELECT wanted FROM k WHERE keeps),
      tried AS (SELECT target, base, ext, UNNEST(RANGE(1, movers + (SELECT COUNT(*) FROM used u WHERE STARTS_WITH(u.file_path, target || '/' || base || '_')) + 1)) AS i FROM (SELECT DISTINCT target, base, ext, movers FROM n) g),
      free AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY target, base, ext ORDER BY i) AS place FROM tried WHERE target || '/' || base || '_' || i || '.' || ext NOT IN (SELECT file_path FROM used)),
      done AS (SELECT id, wanted AS new_path, target FROM k WHERE keeps UNION ALL SELECT id, target || '/' || base || '_' || i || '.' || ext, target FROM n JOIN free USING (target, base, ext, place))
    SELECT m.id, COALESCE(new_path, m.file_path) AS file_path, COALESCE(target, m.folder_path) AS folder_path FROM media m LEFT JOIN done USING (id)""",
)
def d13_moved_media(media):
    """Three quarters of the library moved to six folders, where names recur."""
    target = F.when(F.col("id") % 3 == 0, "/lib/a0").otherwise(F.concat(F.lit("/lib/a"), (F.col("id") % 5 + 1).cast("string")))
    return moves.moved(media, moves.renames(media, media.filter("id % 4 <> 1").select("id", target.alias("target")))).select("id", "file_path", "folder_path")


@query("analysis", sql="SELECT media_id, CASE WHEN media_id % 2 = 0 THEN 99 ELSE color_bucket END AS color_bucket FROM analysis")
def d15_insert_or_replace(analysis):
    old = analysis.select("media_id", F.lit(1).alias("written"), "color_bucket")
    new = analysis.filter("media_id % 2 = 0").select("media_id", F.lit(2).alias("written"), F.lit(99).cast("long").alias("color_bucket"))
    return dml.last_write_wins(old.union(new), ["media_id"], "written").select("media_id", "color_bucket")


@query("roots", sql="SELECT path FROM roots UNION SELECT '/more'")
def d16_insert_or_ignore(directories):
    new = directories.sparkSession.sql("SELECT * FROM (VALUES ('/lib/a1'), ('/more')) AS t(path)")
    return dml.insert_or_ignore(directories.select("path"), new, "path")


@query("faces", sql="SELECT id, media_id FROM faces WHERE confirmed = 1 OR media_id NOT IN (SELECT media_id FROM faces WHERE id % 5 = 0) UNION ALL SELECT id + 100000, media_id FROM faces WHERE id % 5 = 0")
def d17_replace_unconfirmed(faces):
    found = faces.filter("id % 5 = 0").withColumn("id", F.col("id") + 100000)
    return dml.replace_unconfirmed(faces, found).select("id", "media_id")


@query("ai_embeddings", sql="SELECT media_id FROM ai_embeddings WHERE model_ver = 'v2'")
def d18_of_model(ai_embeddings):
    return dml.of_model(ai_embeddings, "v2").select("media_id")


@query("directories", "media", sql="SELECT path, (SELECT COUNT(*) FROM media WHERE folder_path = path OR STARTS_WITH(folder_path, path || '/')) AS item_count, 1705752000::BIGINT AS last_scan, is_active FROM directories")
def d19_directory_stats(directories, media):
    return dml.directory_stats(directories, media, NOW)


MERGE = "SELECT p.id, FIRST_VALUE(p.id) OVER (PARTITION BY LOWER(TRIM(name)) ORDER BY (SELECT COUNT(*) FROM faces f WHERE f.person_id = p.id) DESC, p.id) AS \"into\" FROM persons p WHERE TRIM(COALESCE(name, '')) <> ''"


@query("persons", "faces", sql=MERGE)
def d20_same_names(persons, faces):
    return dml.same_name_merge(persons, faces)


@query("persons", "faces", sql=f"WITH r AS ({MERGE}) SELECT f.id, COALESCE(r.into, f.person_id) AS person_id, CASE WHEN r.into IS NOT NULL THEN 1 ELSE confirmed END AS confirmed FROM faces f LEFT JOIN r ON r.id = f.person_id AND r.id <> r.into")
def d21_merge_people(persons, faces):
    return dml.reassign(faces, dml.same_name_merge(persons, faces)).select("id", "person_id", "confirmed")


@query("faces", sql="SELECT id, CASE WHEN id % 15 = 0 THEN NULL WHEN id % 15 = 1 THEN 7 ELSE person_id END AS person_id, CASE WHEN id % 15 = 0 THEN 0 WHEN id % 15 = 1 THEN 1 ELSE confirmed END AS confirmed, CASE WHEN id % 15 = 0 THEN COALESCE(person_id, -1) WHEN id % 15 = 1 THEN -1 ELSE excluded_person END AS excluded_person FROM faces")
def d22_d23_remove_assign(faces):
    out = dml.assign_faces(dml.remove_faces(faces, F.col("id") % 15 == 0), F.col("id") % 15 == 1, 7)
    return out.select("id", "person_id", "confirmed", "excluded_person")


@query("faces", sql="SELECT id FROM faces WHERE NOT COALESCE(person_id = 2 AND media_id % 2 = 0, FALSE)")
def d24_discard(faces):
    return dml.discard_faces(faces, 2, faces.filter("media_id % 2 = 0").select("media_id")).select("id")


@query("faces", "persons", sql="SELECT p.id, CASE WHEN p.id = 1 THEN 1 ELSE hidden END AS hidden, (SELECT COUNT(*) FROM faces f WHERE f.person_id = p.id) AS faces FROM persons p WHERE p.id <> 4")
def d25_forget_hide(faces, persons):
    kept = dml.update_where(persons.filter("id <> 4"), F.col("id") == 1, hidden=F.lit(1))
    by = faces.filter(F.coalesce(F.col("person_id") != 4, F.lit(True))).groupBy(F.col("person_id").alias("id")).agg(F.count(F.lit(1)).alias("faces"))
    return kept.join(by, "id", "left").select("id", "hidden", F.coalesce("faces", F.lit(0)).alias("faces"))


@query("faces", sql="SELECT id, CASE WHEN id = 3 THEN 1 WHEN id = 4 AND person_id = 1 THEN NULL WHEN id = 3 THEN 1 ELSE person_id END AS person_id, CASE WHEN id = 3 THEN -1 WHEN id = 4 THEN 1 ELSE excluded_person END AS excluded_person FROM faces")
def d26_review(faces):
    out = dml.answer_review(dml.answer_review(faces, 3, 1, True), 4, 1, False)
    return out.select("id", "person_id", "excluded_person")


@query("persons", "faces", sql="SELECT id FROM persons WHERE name IS NOT NULL OR id IN (SELECT person_id FROM faces WHERE person_id IS NOT NULL)")
def d27_tidy(persons, faces):
    return dml.tidy_persons(persons, faces).select("id")


@query("recollections", sql=f"SELECT id FROM recollections WHERE custom = 1 OR expires_at > {NOW}")
def t5_live_memories(memories):
    return live_memories(memories, NOW).select("id")


STEPS = (
    ("id % 10 = 0", "SELECT id, folder_path, file_path, file_size, creation_date, 1 AS is_trashed FROM s WHERE id % 10 = 0 UNION ALL SELECT * FROM s WHERE id % 10 <> 0"),
    ("id % 35 = 2", "SELECT id, '/lib/a1' AS folder_path, file_path, file_size + 7 AS file_size, creation_date, is_trashed FROM s WHERE id % 35 = 2 UNION ALL SELECT * FROM s WHERE id % 35 <> 2"),
    ("id % 900 < 50", "SELECT * FROM s WHERE id % 900 >= 50"),
)


def _rollup_sql(state: str) -> str:
    return f"SELECT folder_path, COUNT(*) AS n, SUM(file_size)::BIGINT AS bytes, MIN(creation_date) AS first, MAX(creation_date) AS last, MAX(ROW(creation_date, file_path)) AS newest FROM {state} WHERE is_trashed = 0 GROUP BY 1"


def _steps_sql() -> str:
    """Each state in full, its rollup in full, and the last step at which a group's rollup differs from the one before."""
    parts = ["s0 AS (SELECT id, folder_path, file_path, file_size, creation_date, is_trashed FROM media)", f"r0 AS (SELECT *, 0 AS revision FROM ({_rollup_sql('s0')}) x)"]
    for i, (_, sql) in enumerate(STEPS, 1):
        parts.append(f"s{i} AS ({sql.replace('FROM s ', f'FROM s{i - 1} ')})")
        same = " AND ".join(f"x.{c} IS NOT DISTINCT FROM o.{c}" for c in ("n", "bytes", "first", "last", "newest"))
        parts.append(f"r{i} AS (SELECT x.*, CASE WHEN {same} THEN o.revision ELSE {i} END AS revision FROM ({_rollup_sql(f's{i}')}) x LEFT JOIN r{i - 1} o USING (folder_path))")
    return f"WITH {', '.join(parts)} SELECT folder_path, n, bytes, first, last, newest[2] AS cover, revision::BIGINT AS revision FROM r{len(STEPS)}"


@query("media", sql=_steps_sql())
def t9_revised_rollups(media):
    """Album rollups after three batches: files trashed, files moved and grown, files deleted; each revises what it touches."""
    state = media.select("id", "folder_path", "file_path", "file_size", "creation_date", "is_trashed")
    rollup = revisions.rolled_up(state.filter("is_trashed = 0"), ["folder_path"])
    for i, (where, _) in enumerate(STEPS, 1):
        changes = state.filter(where).withColumn("deleted", F.lit(i == 3))
        if i == 1:
            changes = changes.withColumn("is_trashed", F.lit(1))
        if i == 2:
            changes = changes.withColumns({"folder_path": F.lit("/lib/a1"), "file_size": F.col("file_size") + 7})
        old, new, state = revisions.changed_rows(state, changes)
        state = checkpointed(state)  # a batch starts from tables, as a stream's does
        rollup = checkpointed(revisions.revised(rollup, *[x.filter("is_trashed = 0") for x in (old, new, state)], ["folder_path"], i))
    return rollup
