"""Exact deduplication by distributed MSD radix partitioning.

Texts are compared after lower-casing A-Z only. Each round groups the rows that
are still open by (group, next bytes): a group of one row is settled, a group
whose texts have ended holds equal texts, and every other group is split again
by the bytes that follow. The digit widens from round to round, so that a text
of n bytes takes O(log n) rounds. Groups are told apart by their bytes alone;
no digest decides equality.

Defined cases: null text is empty; a null doc_id ranks below all others; of
rows that repeat both doc_id and text one is kept; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_key, materialize, salted_join, text_or_empty

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of the first digit, and how much wider each next one is.
FIRST_DIGIT, WIDEN = 64, 16


def exact_groups(docs: DataFrame, carry: list[str] = []) -> DataFrame:  # noqa: B006
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``.

    keep_id is the doc_id of the row that stays in each group of equal texts.
    carry: further columns of ``docs`` to hand through.
    """
    text = text_or_empty()
    # the first FIRST_DIGIT bytes lie within as many characters
    head = F.translate(F.substring(text, 1, FIRST_DIGIT), UPPER, LOWER).cast("binary")
    first = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.substring(head, 1, FIRST_DIGIT).alias("digit"),
        (F.octet_length(text) <= FIRST_DIGIT).alias("ended"),
        text.alias("text"),
        *carry,
    )
    keys = ["digit", "ended"]
    # round 1: rows alone under their first digit are settled; the others get a lasting row number
    groups = first.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    groups = materialize(groups.withColumn("gid", F.monotonically_increasing_id()), "radix-groups")
    rows = first.select("doc_id", *carry, *keys, F.translate("text", UPPER, LOWER).cast("binary").alias("text"))
    rows = rows.select("doc_id", *carry, *keys, F.sha2("text", 256).alias("sha"), F.expr(f"substring(text, {FIRST_DIGIT + 1})").alias("rest"))
    total = docs.count()
    met = _look_up(rows, groups, keys, ["doc_id", "sha"], total)
    met = materialize(
        met.select("doc_id", *carry, "sha", "gid", F.when(F.col("gid").isNotNull(), F.col("rest")).alias("rest"), F.monotonically_increasing_id().alias("uid")),
        "radix-rows",
    )
    alone = F.col("gid").isNull()
    settled = [met.filter(alone).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha", *carry)]
    open_rows, width = met.filter(~alone), FIRST_DIGIT * WIDEN
    while (left := open_rows.count()) > 0:
        keys = ["gid", "digit", "ended"]
        rows = open_rows.withColumns({"digit": F.expr(f"substring(rest, 1, {width})"), "ended": F.octet_length("rest") <= width})
        groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "uid")).alias("last")).filter("n > 1")
        groups = materialize(groups.withColumn("next", F.monotonically_increasing_id()), "radix-groups")
        rows = rows.select("doc_id", "uid", "sha", *carry, *keys, F.expr(f"substring(rest, {width + 1})").alias("rest"))
        met = _look_up(rows, groups, keys, ["uid"], left)
        same = F.col("next").isNotNull() & F.col("ended")
        met = materialize(
            met.select(
                "doc_id",
                "uid",
                "sha",
                *carry,
                (F.col("next").isNotNull() & ~F.col("ended")).alias("open"),
                F.col("next").alias("gid"),
                F.when(F.col("next").isNotNull() & ~F.col("ended"), F.col("rest")).alias("rest"),
                F.when(same, F.col("last.doc_id")).otherwise(F.col("doc_id")).alias("keep_id"),
                F.when(same, F.col("n")).otherwise(F.lit(1)).cast("long").alias("group_size"),
                (~same | (F.col("last.uid") == F.col("uid"))).alias("kept"),
            ),
            "radix-rows",
        )
        settled.append(met.filter("not open").select("doc_id", "keep_id", "group_size", "kept", "sha", *carry))
        open_rows, width = met.filter("open").select("doc_id", "uid", "sha", *carry, "gid", "rest"), width * WIDEN
    out = settled[0]
    for more in settled[1:]:
        out = out.union(more)
    return out.withColumnRenamed("sha", "text_sha256")


def _look_up(rows: DataFrame, groups: DataFrame, keys: list[str], salt_on: list[str], total: int) -> DataFrame:
    """Join on the keys' bytes; hot keys are found by a hash of them, so no digit is broadcast."""
    deal = F.xxhash64(*keys).alias("_deal")
    return salted_join(rows.select("*", deal), groups.select("*", deal), keys, salt_on, total, "left", deal_by=["_deal"])


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    groups = exact_groups(docs.select("doc_id", "text", F.md5(text_or_empty().cast("binary")).alias("_tk")), carry=["_tk"]).withColumn("_id", id_key())
    gone = groups.groupBy("_id", "_tk").agg(F.bool_or("kept").alias("any_kept"), F.count(F.lit(1)).alias("n"))
    gone = materialize(gone.filter("not any_kept or n > 1"), "radix-gone")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), id_key().alias("_id"), F.md5(text_or_empty().cast("binary")).alias("_tk"))
    out = rows.join(gone.select("_id", "_tk"), ["_id", "_tk"], "left_anti")
    repeated = gone.filter("any_kept").select("_id", "_tk")
    if repeated.limit(1).count():  # rows that repeat doc_id and text: one of each stays
        out = out.unionByName(rows.join(repeated, ["_id", "_tk"], "left_semi").dropDuplicates(["_id", "_tk"]))
    return out.select("_row.*")


SQL = f"""
WITH d AS (SELECT doc_id, TRANSLATE(COALESCE(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents)
SELECT doc_id, MAX(doc_id) OVER g AS keep_id, COUNT(*) OVER g AS group_size,
  ROW_NUMBER() OVER (PARTITION BY norm ORDER BY doc_id DESC) = 1 AS kept, SHA256(norm) AS text_sha256
FROM d WINDOW g AS (PARTITION BY norm)
"""
