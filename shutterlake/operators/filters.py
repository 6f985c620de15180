"""Predicates and filters of a media table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.functions import paths


def flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def alive() -> Column:
    """Neither trashed nor hidden nor ignored."""
    return (F.col("is_trashed") == 0) & (flag("is_hidden") == 0) & (flag("is_ignored") == 0)


def live() -> Column:
    """Not trashed."""
    return flag("is_trashed") == 0


def usable() -> Column:
    """Fit for a memory: alive, dated, JPEG, WebP or video."""
    return alive() & (F.col("creation_date") > 0) & (F.col("mime_type").isin("image/jpeg", "image/webp") | F.col("mime_type").startswith("video/"))


def in_editor_pool() -> Column:
    return alive() & (F.col("mime_type").isin("image/jpeg", "image/webp", "image/png") | F.col("mime_type").startswith("video/"))


def in_mode(mode: str) -> Column:
    """The timeline's four modes; hidden wins over trashed in "hidden" only."""
    trashed, hidden = flag("is_trashed") != 0, flag("is_hidden") != 0
    return {
        "all": ~trashed & ~hidden,
        "favorites": (flag("is_favorite") != 0) & ~trashed & ~hidden,
        "trash": trashed,
        "hidden": hidden,
    }[mode]


def without_ignored_folders(media: DataFrame, albums: DataFrame) -> DataFrame:
    """Drop media in folders that an ignored album names; a null folder and a null prefix are both ""."""
    ignored = albums.filter("is_ignored = 1").select(F.coalesce("path_prefix", F.lit("")).alias("_folder")).distinct()
    return media.withColumn("_folder", F.coalesce("folder_path", F.lit(""))).join(ignored, "_folder", "left_anti").drop("_folder")


def base_query(media: DataFrame, albums: DataFrame | None = None, raw: int = 0, trashed: bool | None = None, hidden: bool | None = None) -> DataFrame:
    """All media that are not ignored; raw: 0 all, 1 none, 2 only."""
    out = media.filter(F.col("is_ignored") == 0)
    if albums is not None:
        out = without_ignored_folders(out, albums)
    if raw:
        out = out.filter(paths.is_raw(F.col("file_path")) == F.lit(raw == 2))
    for name, want in (("is_trashed", trashed), ("is_hidden", hidden)):
        if want is not None:
            out = out.filter(flag(name) == int(want))
    return out


def path_contains(text: str) -> Column:
    """Literal, without regard to case, anywhere in the path."""
    return F.contains(F.lower("file_path"), F.lit(text.lower()))


def mime_in(prefixes: str) -> Column:
    """Any of the |-separated MIME prefixes."""
    out = F.lit(False)
    for p in filter(None, prefixes.split("|")):
        out = out | F.col("mime_type").startswith(p)
    return out


def with_folder(folder: str) -> Column:
    return F.col("folder_path") == folder


def media_where(media: DataFrame, where: Column, order: Sequence[Column] | None = None, limit: int = 5000) -> DataFrame:
    """Alive media that meet ``where``, newest first, ``limit`` at the most."""
    return media.filter(alive() & where).orderBy(*(order or (F.desc("creation_date"), F.desc("id")))).limit(limit)


def pending_analysis(media: DataFrame, analysis: DataFrame, faces: bool = True, limit: int = 48) -> DataFrame:
    """Alive photos without a current analysis, newest first."""
    a = analysis.select(F.col("media_id").alias("_m"), "version", "faces_done")
    todo = F.col("_m").isNull() | (F.col("version") < 1)
    if faces:
        todo = todo | (F.col("faces_done") == 0)
    rows = media.filter(alive() & F.col("mime_type").startswith("image/")).join(a, F.col("id") == F.col("_m"), "left").filter(todo)
    return rows.drop("_m", "version", "faces_done").orderBy(F.desc("creation_date"), F.desc("id")).limit(limit)


def pending_embedding(media: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Neither trashed nor hidden, no vector yet (ignored media count)."""
    return media.filter("is_trashed = 0 and is_hidden = 0").join(embeddings.select(F.col("media_id").alias("id")), "id", "left_anti")


def strippable() -> Column:
    return (flag("is_trashed") == 0) & paths.extension(F.col("file_path")).isin("jpg", "jpeg", "png", "webp", "tif", "tiff")


def visible_memories(memories: DataFrame, media: DataFrame) -> DataFrame:
    """Memories all of whose sources are alive media; one without sources is visible."""
    source = memories.select("id", F.explode(F.filter(F.split("sources", r"\|"), lambda s: s != "")).alias("file_path"))
    broken = source.join(media.filter(alive()).select("file_path"), "file_path", "left_anti").select("id").distinct()
    return memories.join(broken, "id", "left_anti")
