"""Orders of media and album lists. Every order is total, so limits are deterministic."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shutterlake.functions import media as m
from shutterlake.functions import paths

# Sort roles.
CREATED, MODIFIED, NAME, SIZE, VIEWED, TYPE, WIDTH, HEIGHT, DIMENSIONS, ORIENTATION = range(10)


#: Rows of a range of an order.
BLOCK_ROWS = 1_000_000

Keys = list[tuple[Column, bool]]  # a column, and whether it ascends; null is the smallest value


def media_keys(role: int = CREATED, ascending: bool = False) -> Keys:
    """Sort keys of a role; ids break ties in the same direction, by type and orientation newest or largest first."""
    size = m.area(F.col("width"), F.col("height"))
    keys = {
        MODIFIED: F.col("modified_date"),
        NAME: F.lower("file_path"),
        SIZE: F.col("file_size"),
        VIEWED: F.col("last_viewed"),
        WIDTH: F.coalesce("width", F.lit(0)),
        HEIGHT: F.coalesce("height", F.lit(0)),
        DIMENSIONS: size,
    }
    if role == TYPE:
        return [(F.lower(F.coalesce("mime_type", F.lit(""))), ascending), (F.col("creation_date"), False), (F.col("id"), False)]
    if role == ORIENTATION:
        return [(m.orientation(F.col("width"), F.col("height")), ascending), (size, False), (F.col("id"), False)]
    return [(keys.get(role, F.col("creation_date")), ascending), (F.col("id"), ascending)]


def order_of(keys: Keys) -> list[Column]:
    return [c.asc_nulls_first() if up else c.desc_nulls_last() for c, up in keys]


def media_order(role: int = CREATED, ascending: bool = False) -> list[Column]:
    """Sort columns of a role."""
    return order_of(media_keys(role, ascending))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``); a local master gets one of its own if it is unset."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="shutterlake-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def blocked(df: DataFrame, keys: Keys, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with ``_block`` and ``_at``: the order of ``keys``, which must be total, is that of the blocks and of ``_at`` within.

    Rows are dealt by ranges of their keys, whose bounds Spark samples, and
    sorted within. A block is a partition, so blocks grow in number with the
    table, and a row's number in its sorted partition costs no window. As ranges
    are sampled anew in each job, the numbered rows are written once. An order of
    one block is sorted in one task and written nowhere.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.withColumns({n: c for n, (c, _) in zip(names, keys, strict=True)})
    order = order_of([(F.col(n), up) for n, (_, up) in zip(names, keys, strict=True)])
    parts = max(1, -(-df.count() // block_rows))
    dealt = rows.repartitionByRange(parts, *order) if parts > 1 else rows.coalesce(1)
    # the partition's number stands above bit 33, the row's number in it below
    numbered = dealt.sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).drop(*names)
    numbered = numbered.withColumns({"_block": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND((1 << 33) - 1)})
    return checkpointed(numbered) if parts > 1 else numbered


def placed(df: DataFrame, keys: Keys, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with its 1-based ``place`` in the order of ``keys``: the sizes of the blocks before plus the place within."""
    rows = blocked(df, keys, block_rows)
    counts = rows.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    starts = counts.select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return rows.join(starts, "_block").withColumn("place", F.col("_at") + F.col("_start") + 1).drop("_block", "_start", "_at")


def list_order(field: str, ascending: bool = True, text: bool = False, pinned: str | None = None) -> list[Column]:
    """Order of an in-memory list: pinned first whatever the direction, then the key, then the old position."""
    key = paths.natural_key(F.col(field)) if text else F.col(field)
    first = [F.desc(pinned)] if pinned else []
    return [*first, key.asc() if ascending else key.desc(), F.asc("position")]


def top(df: DataFrame, keys: list[Column], n: int) -> DataFrame:
    return df.orderBy(*keys).limit(n)


def siblings(media: DataFrame, folder: str) -> DataFrame:
    """Files of one folder in natural order."""
    return media.filter(F.col("folder_path") == folder).orderBy(paths.natural_key(paths.base_name(F.col("file_path"))), "id")
