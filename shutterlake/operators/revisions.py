"""Rollups kept up to date from changed rows alone.

A rollup has one row a key: n, bytes, first and last date, the cover (path of the
newest file) and the revision that last changed it. Counts and sizes move by
signed deltas of old and new rows. An extreme can only be lost with the row that
held it, so groups that lose one are computed anew from their rows, and no others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEASURES = ("n", "bytes", "first", "last", "cover")


def _newest() -> Column:
    """Of equal dates the greatest path is the cover."""
    return F.max(F.struct(F.col("creation_date").alias("at"), F.col("file_path").alias("path")))


def rolled_up(rows: DataFrame, keys: list[str], revision: int = 0) -> DataFrame:
    """The rollup of all rows (keys, file_path, file_size, creation_date); null sizes count as 0."""
    by = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("file_size", F.lit(0))).alias("bytes"), F.min("creation_date").alias("first"), _newest().alias("_newest")
    )
    return by.select(*keys, "n", "bytes", "first", F.col("_newest.at").alias("last"), F.col("_newest.path").alias("cover"), F.lit(revision).cast("long").alias("revision"))


def _same(keys: list[str], a: str, b: str) -> Column:
    """Keys are equal, null keys too."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def revised(rollup: DataFrame, old: DataFrame, new: DataFrame, now: DataFrame, keys: list[str], revision: int) -> DataFrame:
    """The rollup after a batch: ``old`` and ``new`` are the changed rows before and after, ``now`` all rows after.

    Changed rows are summed by key first, so a batch reaches the rollup as one row
    a group. Groups whose sums, dates and cover all stay keep their revision;
    groups without rows go. Of ``now`` only the rows of groups that lost a first
    date or a cover are read beyond the join.
    """
    columns = [*keys, "file_path", "file_size", "creation_date"]
    signed = old.select(*columns, F.lit(-1).alias("_sign")).unionByName(new.select(*columns, F.lit(1).alias("_sign")))
    came, went = F.when(F.col("_sign") == 1, F.col("creation_date")), F.when(F.col("_sign") == -1, F.col("creation_date"))
    newest = F.struct(F.col("creation_date").alias("at"), F.col("file_path").alias("path"))
    delta = signed.groupBy(*keys).agg(
        F.sum("_sign").alias("_n"),
        F.sum(F.col("_sign") * F.coalesce("file_size", F.lit(0))).alias("_bytes"),
        F.min(came).alias("_came"),
        F.min(went).alias("_went"),
        F.max(F.when(F.col("_sign") == 1, newest)).alias("_new"),
        F.max(F.when(F.col("_sign") == -1, newest)).alias("_gone"),
    )
    r, d = rollup.withColumn("_had", F.lit(True)).alias("r"), delta.withColumn("_hit", F.lit(True)).alias("d")
    both = r.join(d, _same(keys, "r", "d"), "full_outer")
    both = both.select(*[F.when(F.col("_hit"), F.col(f"d.{k}")).otherwise(F.col(f"r.{k}")).alias(k) for k in keys], *MEASURES, "revision", "_had", "_hit", "_n", "_bytes", "_came", "_went", "_new", "_gone")

    was = F.struct(F.col("last").alias("at"), F.col("cover").alias("path"))
    lost_first = (F.col("_went") == F.col("first")) & ~F.coalesce(F.col("_came") <= F.col("_went"), F.lit(False))
    lost_cover = (F.col("_gone") == was) & ~F.coalesce(F.col("_new") >= F.col("_gone"), F.lit(False))
    both = both.withColumn("_lost", F.coalesce(lost_first, F.lit(False)) | F.coalesce(lost_cover, F.lit(False)))
    best = F.when(F.col("_had"), F.greatest(was, F.col("_new"))).otherwise(F.col("_new"))
    after = both.withColumns(
        {
            "_to_n": F.coalesce("n", F.lit(0)) + F.coalesce("_n", F.lit(0)),
            "_to_bytes": F.coalesce("bytes", F.lit(0)) + F.coalesce("_bytes", F.lit(0)),
            "_to_first": F.least("first", "_came"),
            "_to_last": best["at"],
            "_to_cover": best["path"],
        }
    ).filter("_to_n > 0")

    again = after.filter("_lost").select(*keys).alias("g")
    rows = now.select(*columns).alias("m").join(again, _same(keys, "m", "g"), "left_semi")
    fresh = rolled_up(rows, keys).select(*keys, *[F.col(c).alias(f"_fresh_{c}") for c in ("first", "last", "cover")], F.lit(True).alias("_again"))
    out = after.alias("a").join(fresh.alias("f"), _same(keys, "a", "f"), "left")
    to = {c: F.when(F.col("_again"), F.col(f"_fresh_{c}")).otherwise(F.col(f"_to_{c}")) for c in ("first", "last", "cover")} | {"n": F.col("_to_n"), "bytes": F.col("_to_bytes")}
    kept = F.coalesce(F.col("_had"), F.lit(False))
    for c in MEASURES:
        kept = kept & to[c].eqNullSafe(F.col(f"a.{c}"))
    return out.select(*[F.col(f"a.{k}").alias(k) for k in keys], *[to[c].alias(c) for c in MEASURES], F.when(kept, F.col("revision")).otherwise(F.lit(revision).cast("long")).alias("revision"))


def changed_rows(media: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Old rows, new rows and all rows after ``changes`` (the columns of media, and ``deleted``), one change an id."""
    ids = changes.select("id")
    old = media.join(ids, "id", "left_semi")
    new = changes.filter("not deleted").select(*media.columns)
    return old, new, media.join(ids, "id", "left_anti").unionByName(new)
