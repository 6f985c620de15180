"""Files moved between folders, with numbers for names that are taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.operators.sorting import checkpointed, placed

GROUP = ("_target", "_base", "_ext")


def _name_parts(name: Column) -> tuple[Column, Column]:
    """A name up to its last dot, and what follows; a name without a dot is all base."""
    dotted = F.contains(name, F.lit("."))
    ext = F.when(dotted, F.substring_index(name, ".", -1)).otherwise("")
    return F.when(dotted, name.substr(F.lit(1), F.length(name) - F.length(ext) - 1)).otherwise(name), ext


def _folder(path: Column) -> Column:
    return path.substr(F.lit(1), F.length(path) - F.length(F.substring_index(path, "/", -1)) - 1)


def _ranked(rows: DataFrame, keys: list[str], order: list[str], block_rows: int, to: str) -> DataFrame:
    """``rows`` with their 1-based number ``to`` within ``keys``, by ``order``: places in the whole order, less where the group starts."""
    out = placed(rows, [(F.col(c), True) for c in (*keys, *order)], block_rows)
    starts = out.groupBy(*keys).agg(F.min("place").alias("_first"))
    return out.join(starts, keys).withColumn(to, F.col("place") - F.col("_first") + 1).drop("place", "_first")


def renames(media: DataFrame, moves: DataFrame, listing: DataFrame | None = None, block_rows: int = 1_000_000) -> DataFrame:
    """id, file_path, new_path, new_folder of every move (id, target) whose path changes.

    A file keeps its name if no file of ``listing`` (file_path; ``media`` if
    absent) has it in the target folder; of several that want one name the least
    id gets it. The others become ``base_n.ext`` by id, with the least numbers
    that neither a listed file nor one that kept its name has; no two bases share
    a numbered name. Names that the batch frees are not used by it. Of several
    moves of an id that with the least target counts; unknown ids, null paths and
    null targets move nothing, nor does a file that is in its target already.

    A name is no group of one task: ranks come from whole orders in blocks. A
    taken number t with j taken ones up to it has t - j free ones below, so in the
    order of those counts the r-th mover stands where its number says.
    """
    there = (media if listing is None else listing).select("file_path").filter("file_path is not null").distinct()
    targets = moves.filter("target is not null").groupBy("id").agg(F.min("target").alias("_target"))
    rows = media.select("id", "file_path").filter("file_path is not null").join(targets, "id")
    name = F.substring_index("file_path", "/", -1)
    base, ext = _name_parts(name)
    rows = rows.select("id", "file_path", "_target", base.alias("_base"), ext.alias("_ext"), F.concat("_target", F.lit("/"), name).alias("_wanted"))
    rows = rows.filter(F.col("_wanted") != F.col("file_path"))
    taken = there.select(F.col("file_path").alias("_wanted"), F.lit(True).alias("_there"))
    first = rows.groupBy("_wanted").agg(F.min("id").alias("_first")).join(taken, "_wanted", "left").select("_wanted", F.when(F.col("_there").isNull(), F.col("_first")).alias("_winner"))
    rows = rows.join(first, "_wanted").withColumn("_keeps", F.coalesce(F.col("id") == F.col("_winner"), F.lit(False)))
    rows = checkpointed(rows.drop("_winner"))  # read six times from here on
    keep, number = rows.filter("_keeps"), rows.filter("not _keeps").select("id", "file_path", *GROUP)

    used = there.unionByName(keep.select(F.col("_wanted").alias("file_path")))
    stem, suffix = _name_parts(F.substring_index("file_path", "/", -1))
    used = used.select(_folder(F.col("file_path")).alias("_target"), stem.alias("_stem"), suffix.alias("_ext"), F.endswith("file_path", F.lit(".")).alias("_bare"))
    parts = F.regexp_extract("_stem", r"^([\s\S]*)_([1-9][0-9]{0,17})$", 2)
    used = used.filter((parts != "") & ~F.col("_bare")).select("_target", F.regexp_extract("_stem", r"^([\s\S]*)_([1-9][0-9]{0,17})$", 1).alias("_base"), "_ext", parts.cast("long").alias("_n"))
    used = used.join(number.select(*GROUP).distinct(), list(GROUP), "left_semi")

    both = number.select("id", "file_path", *GROUP, F.lit(0).alias("_kind"), F.col("id").cast("long").alias("_key"))
    none = [F.lit(None).cast(number.schema[c].dataType).alias(c) for c in ("id", "file_path")]
    both = both.unionByName(used.select(*none, *GROUP, F.lit(1).alias("_kind"), F.col("_n").alias("_key")))
    ranked = _ranked(checkpointed(both), ["_kind", *GROUP], ["_key"], block_rows, "_rank")
    # the r-th mover comes after the taken numbers that have fewer than r free ones below
    merged = ranked.withColumn("_below", F.when(F.col("_kind") == 0, F.col("_rank")).otherwise(F.col("_key") - F.col("_rank")))
    given = _ranked(checkpointed(merged), list(GROUP), ["_below", "_kind", "_key"], block_rows, "_number").filter("_kind = 0")
    dot = F.when(F.col("_ext") == "", "").otherwise(F.concat(F.lit("."), F.col("_ext")))
    given = given.select("id", "file_path", F.concat("_target", F.lit("/"), "_base", F.lit("_"), F.col("_number").cast("string"), dot).alias("new_path"), F.col("_target").alias("new_folder"))
    return given.unionByName(keep.select("id", "file_path", F.col("_wanted").alias("new_path"), F.col("_target").alias("new_folder")))


def moved(media: DataFrame, done: DataFrame) -> DataFrame:
    """``media`` after ``renames``."""
    out = media.join(done.select("id", "new_path", "new_folder"), "id", "left")
    return out.withColumns({"file_path": F.coalesce("new_path", "file_path"), "folder_path": F.coalesce("new_folder", "folder_path")}).select(*media.columns)


def moved_thumbnails(thumbnails: DataFrame, done: DataFrame) -> DataFrame:
    """Thumbnails (file_path, ...) after ``renames``."""
    out = thumbnails.join(done.select("file_path", "new_path"), "file_path", "left")
    return out.withColumn("file_path", F.coalesce("new_path", "file_path")).select(*thumbnails.columns)
