"""Changes to the library as pure functions from tables to tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.functions import dates

METADATA = ("folder_path", "file_size", "mime_type", "creation_date", "modified_date", "width", "height", "latitude", "longitude", "duration")


def upsert_media(media: DataFrame, entries: DataFrame) -> DataFrame:
    """Metadata of ``entries`` (file_path, METADATA) replaces the old; the user's flags stay.

    New files get flags 0 and the ids after the largest one, in the order of
    their paths, as _new_ids numbers them.
    """
    new = entries.select("file_path", F.lit(True).alias("_new"), *[F.col(c).alias(f"_{c}") for c in METADATA])
    new = new.withColumns({c: F.when(F.col(c) != 0, F.col(c)) for c in ("_latitude", "_longitude")})
    both = media.join(new, "file_path", "full_outer")
    known = F.coalesce("_new", F.lit(False))
    out = {c: F.when(known, F.col(f"_{c}")).otherwise(F.col(c)) for c in METADATA}
    out |= {c: F.coalesce(c, F.lit(0)) for c in ("is_favorite", "is_trashed", "is_hidden", "is_ignored")}
    out = both.withColumns(out).select(*media.columns)
    if "id" not in media.columns:
        return out
    added = _new_ids(new.select("file_path").distinct().join(media, "file_path", "left_anti"), media)
    return out.join(added, "file_path", "left").withColumn("id", F.coalesce("id", "_next")).select(*media.columns)


def _new_ids(paths: DataFrame, media: DataFrame) -> DataFrame:
    """file_path, _next: max(id) + rank by path. Rows are ranked within their folder, and folders by their totals."""
    folder = F.substring_index("file_path", "/", -1)
    rows = paths.withColumn("_folder", F.expr("substring(file_path, 1, length(file_path) - length(substring_index(file_path, '/', -1)))"))
    before = Window.orderBy("_folder").rowsBetween(Window.unboundedPreceding, -1)  # a row for each folder
    folders = rows.groupBy("_folder").agg(F.count(F.lit(1)).alias("n")).withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    top = media.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    place = F.row_number().over(Window.partitionBy("_folder").orderBy(folder))
    return rows.withColumn("_place", place).join(folders, "_folder").join(F.broadcast(top)).select("file_path", (F.col("_top") + F.col("_before") + F.col("_place")).cast("long").alias("_next"))


def needs_update(media: DataFrame, found: DataFrame) -> DataFrame:
    """Files of a walk (path, size) that are new, changed or incompletely known."""
    old = media.select(F.col("file_path").alias("path"), "file_size", "creation_date", "width", "height")
    incomplete = (F.col("creation_date") == 0) | (F.col("width") == 0) | (F.col("height") == 0)
    return found.join(old, "path", "left").filter(F.col("file_size").isNull() | (F.col("file_size") != F.col("size")) | incomplete).select("path", "size")


def prune_missing(known: DataFrame, present: DataFrame, found: int) -> DataFrame:
    """Known file_path that a walk has not met; none if the walk met nothing."""
    return known.join(present, "file_path", "left_anti") if found > 0 else known.limit(0)


def swept(media: DataFrame, thumbnails: DataFrame, listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Media and thumbnails (file_path, ...) without the rows of media whose file a listing (path) no longer has."""
    there = listing.select(F.col("path").alias("file_path"))
    gone = media.select("file_path").join(there, "file_path", "left_anti")
    return media.join(there, "file_path", "left_semi").select(*media.columns), thumbnails.join(gone, "file_path", "left_anti").select(*thumbnails.columns)


def purge_trash(media: DataFrame, now: int, days: int) -> DataFrame:
    """What stays after trash older than ``days`` goes; 0 empties it."""
    old = F.lit(True) if days == 0 else F.coalesce("trashed_at", F.lit(0)) < now - days * dates.DAY
    return media.filter(~((F.col("is_trashed") == 1) & old))


def update_where(df: DataFrame, where: Column, **values: Column) -> DataFrame:
    """Columns of matching rows; right sides see the old row."""
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def set_trashed(media: DataFrame, where: Column, trashed: bool, now: int) -> DataFrame:
    return update_where(media, where, is_trashed=F.lit(int(trashed)), trashed_at=F.lit(now).cast("long") if trashed else F.lit(None).cast("long"))


def toggle_favourite(media: DataFrame, where: Column) -> DataFrame:
    return update_where(media, where, is_favorite=1 - F.col("is_favorite"))


def last_write_wins(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Insert-or-replace: the row of each key that comes last in ``order``."""
    best = df.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in df.columns if c not in (*keys, order)])).alias("_row"))
    return best.select(*[c if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def insert_or_ignore(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` whose key is not there yet are added, one a key."""
    return old.unionByName(new.dropDuplicates([key]).join(old.select(key), key, "left_anti").select(*old.columns))


def newest_album_rows(albums: DataFrame) -> DataFrame:
    """One row a path prefix, that of the largest id; rows without a prefix go."""
    return albums.filter("path_prefix is not null").groupBy("path_prefix").agg(F.max(F.struct("id", "name")).alias("r")).select("r.id", "path_prefix", "r.name")


def replace_unconfirmed(faces: DataFrame, found: DataFrame) -> DataFrame:
    """New detections replace the unconfirmed faces of their media."""
    gone = found.select("media_id").distinct()
    kept = faces.filter("confirmed = 1").unionByName(faces.filter("confirmed = 0").join(gone, "media_id", "left_anti").select(*faces.columns))
    return kept.unionByName(found)


def of_model(embeddings: DataFrame, version: str) -> DataFrame:
    return embeddings.filter(F.col("model_ver") == version)


def directory_stats(directories: DataFrame, media: DataFrame, scanned_at: int) -> DataFrame:
    """Item counts of each directory from its media."""
    part = F.split("folder_path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(part)), lambda i: F.array_join(F.slice(part, F.lit(1), i), "/"))
    by = media.groupBy("folder_path").agg(F.count(F.lit(1)).alias("n"))
    by = by.select(F.explode(above).alias("path"), "n").groupBy("path").agg(F.sum("n").alias("n"))
    return directories.drop("item_count", "last_scan").join(by, "path", "left").select("path", F.coalesce("n", F.lit(0)).alias("item_count"), F.lit(scanned_at).cast("long").alias("last_scan"), "is_active")


def same_name_merge(persons: DataFrame, faces: DataFrame) -> DataFrame:
    """id, into: people of one name (case and ends ignored) merge into the one with most faces, then the least id."""
    n = faces.groupBy(F.col("person_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    named = persons.filter(F.trim(F.coalesce("name", F.lit(""))) != "").join(n, "id", "left").withColumns({"key": F.lower(F.trim("name")), "n": F.coalesce("n", F.lit(0))})
    best = named.groupBy("key").agg(F.max(F.struct("n", (-F.col("id")).alias("neg"))).alias("b"))
    return named.join(best, "key").select("id", (-F.col("b.neg")).alias("into"))


def reassign(faces: DataFrame, remap: DataFrame) -> DataFrame:
    """Faces of merged people move and count as confirmed; remap: id, into."""
    moved = remap.filter("id <> into").select(F.col("id").alias("person_id"), "into")
    out = faces.join(moved, "person_id", "left")
    return out.withColumns({"confirmed": F.when(F.col("into").isNotNull(), 1).otherwise(F.col("confirmed")), "person_id": F.coalesce("into", "person_id")}).select(*faces.columns)


def remove_faces(faces: DataFrame, where: Column) -> DataFrame:
    return update_where(faces, where, excluded_person=F.coalesce("person_id", F.lit(-1)), person_id=F.lit(None).cast("long"), confirmed=F.lit(0))


def assign_faces(faces: DataFrame, where: Column, person: int) -> DataFrame:
    return update_where(faces, where, person_id=F.lit(person).cast("long"), confirmed=F.lit(1), excluded_person=F.lit(-1).cast("long"))


def answer_review(faces: DataFrame, face: int, person: int, yes: bool) -> DataFrame:
    """Yes assigns the face; no excludes the person and clears the face only if it is the person's now."""
    this = F.col("id") == face
    if yes:
        return assign_faces(faces, this, person)
    return update_where(faces, this, excluded_person=F.lit(person).cast("long"), person_id=F.when(F.col("person_id") == person, F.lit(None).cast("long")).otherwise(F.col("person_id")))


def discard_faces(faces: DataFrame, person: int, media_ids: DataFrame) -> DataFrame:
    """Delete a person's faces on a set of media."""
    gone = faces.filter(F.col("person_id") == person).join(media_ids, "media_id", "left_semi").select("id")
    return faces.join(gone, "id", "left_anti").select(*faces.columns)


def tidy_persons(persons: DataFrame, faces: DataFrame) -> DataFrame:
    """Unnamed people without faces go."""
    seen = faces.filter("person_id is not null").select(F.col("person_id").alias("id")).distinct()
    empty = persons.filter("name is null").join(seen, "id", "left_anti").select("id")
    return persons.join(empty, "id", "left_anti").select(*persons.columns)


def album_upsert(albums: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows of ``changes`` (path_prefix and columns to set) update albums of that prefix, others are added."""
    columns = [c for c in changes.columns if c != "path_prefix"]
    new = changes.select("path_prefix", F.lit(True).alias("_new"), *[F.col(c).alias(f"_{c}") for c in columns])
    out = albums.join(new, "path_prefix", "full_outer")
    return out.withColumns({c: F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}).select(*albums.columns)
