"""Files as tables: listing, filters, snapshots, documents, settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.functions import paths
from shutterlake.functions.text import chunks


def listing(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """path, length, modificationTime of every file under a folder; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(root).select("path", "length", "modificationTime")


def with_extension(files: DataFrame, path: str, kinds: tuple[str, ...] = paths.MEDIA) -> DataFrame:
    """Files whose extension (after the last dot of the name, in any case) is one of ``kinds``."""
    name = paths.base_name(F.col(path))
    return files.filter(F.contains(name, F.lit(".")) & paths.extension(name).isin(*kinds))


def snapshot(media: DataFrame, root: str) -> DataFrame:
    """path, size of known files under a root; size -1 where date or dimensions are missing."""
    complete = (F.col("creation_date") != 0) & (F.col("width") != 0) & (F.col("height") != 0)
    rows = media.filter(F.col("file_path").startswith(root.rstrip("/") + "/"))
    return rows.select(F.col("file_path").alias("path"), F.when(complete, F.col("file_size")).otherwise(F.lit(-1).cast("long")).alias("size"))


def changed(found: DataFrame, known: DataFrame) -> DataFrame:
    """Files of a walk (path, size) that are not in the snapshot with that size."""
    return found.join(known, ["path", "size"], "left_anti")


def text_files(spark: SparkSession, root: str) -> DataFrame:
    """file_path, text of the text documents under a folder."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(root)
    files = files.select(F.input_file_name().alias("file_path"), F.col("value").alias("text"))
    return files.filter(paths.extension(F.col("file_path")).isin("txt", "md", "csv"))


def document_chunks(docs: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """file_path, chunk_idx, chunk of documents that have no chunk yet."""
    rows = docs if done is None else docs.join(done.select("file_path").distinct(), "file_path", "left_anti")
    return rows.select("file_path", F.posexplode(chunks(F.col("text"))).alias("chunk_idx", "chunk"))


def setting(settings: DataFrame, key: str, default: Column) -> DataFrame:
    """One row: the value of a key, or the default."""
    return settings.filter(F.col("key") == key).agg(F.coalesce(F.max("value"), default).alias("value"))


def sort_preferences(settings: DataFrame) -> DataFrame:
    """view, role, ascending of all views, stored as "role,order" under "sort_pref_" and the view; malformed gives 0, 0."""
    part, prefix = F.split("value", ","), "sort_pref_"
    role, order = (F.try_element_at(part, F.lit(i)).try_cast("int") for i in (1, 2))
    valid = (F.size(part) == 2) & role.isNotNull() & order.isNotNull()
    rows = settings.filter(F.col("key").startswith(prefix))
    return rows.select(F.substr("key", F.lit(len(prefix) + 1)).alias("view"), *[F.when(valid, x).otherwise(0).alias(n) for x, n in ((role, "role"), (order, "ascending"))])


def sort_preference(settings: DataFrame, view: str) -> DataFrame:
    """One row: role, ascending of a view; absent gives 0, 0."""
    own = sort_preferences(settings).filter(F.col("view") == view)
    return own.agg(*[F.coalesce(F.max(n), F.lit(0)).alias(n) for n in ("role", "ascending")])


def json_settings(settings: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """Typed fields of a JSON value, each with its default."""
    row = setting(settings, key, F.lit("{}"))
    return row.select(*[F.coalesce(F.get_json_object("value", f"$.{n}"), F.lit(d)).alias(n) for n, d in fields.items()])
