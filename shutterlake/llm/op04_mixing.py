"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Each source gets a target; a source's documents all expect target / size
copies. The prefix sum of the expected copies within a source, shifted by one
random offset, crosses integers; a document is emitted once for each integer
that its own step crosses. The prefix runs over the documents by size, so that
the words taken stay near the target. It is summed by small blocks (source,
size class, hash of doc_id and text): totals of the classes of a source and of
the blocks of a class give each block's start, and a window ranks within the
block, so a source with a third of all rows is many blocks. Ties go by the
text, then by the whole row, so that the mix of a table is the same however its
rows are dealt.

Defined cases: null text has size 0; null source is a source of its own, after
all others; rows without words are carried along and take no words; rows that
repeat doc_id and text are separate rows; an empty table gives an empty result;
other columns are handed through by ``mixed_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, text_or_empty

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: The mix holds this share of all words, and no source more than CAP times its own.
SHARE, CAP = 1.5, 2
SEED = "mix-1"


def n_words(text: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def _unit(text: Column) -> Column:
    """A fixed number in [0, 1) from a string: 32 bits of its MD5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _size_class(size: Column) -> Column:
    """Sortable text: binary digits of the size, then its first five of them."""
    bits = F.bin(size)
    return F.concat(F.lpad(F.length(bits).cast("string"), 2, "0"), F.rpad(F.substring(bits, 1, 5), 5, "0"))


def _sum_before(value: str, keys: list[str], order: str) -> Column:
    return F.coalesce(F.sum(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, target: weighted shares, each held to cap x size, the excess reshared.

    Resharing until none is above its cap ends where every source has
    min(cap x size, level x weight) for one common level; sources fill up in
    order of cap x size / weight, so the level follows from prefix sums.
    """
    by = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")  # a row for each source
    nth = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    by = by.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), nth.cast("int") + 1))
    fill = Window.orderBy(F.col("source_size") * float(cap) / F.col("weight"), F.col("source").isNull(), "source")
    before, everything = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    by = by.withColumns(
        {
            "all_size": F.sum("source_size").over(everything) * float(share),
            "full": F.coalesce(F.sum("source_size").over(before), F.lit(0)) * float(cap),
            "open": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    )
    # the level if exactly the sources before this one are full; the first that is not above its cap holds
    by = by.withColumn("level", (F.col("all_size") - F.col("full")) / F.col("open"))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("source_size") * float(cap), F.struct(F.col("full"), F.col("level")))
    by = by.withColumn("level", F.min(fits).over(everything)["level"])
    target = F.least(F.col("source_size") * float(cap), F.coalesce(F.col("level") * F.col("weight"), F.col("source_size") * float(cap)))
    return by.select("source", "source_size", target.alias("target"))


def with_copies(rows: DataFrame, seed: str = SEED) -> DataFrame:
    """``rows`` (doc_id, source, size, md5 of the text, tie, ...) with source_size, target and copies."""
    block = {
        "_class": _size_class(F.col("size")),
        "_part": F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "md5").cast("binary")), 1, 2),
        "_null": F.col("source").isNull(),
        "_source": F.coalesce("source", F.lit("")),
    }
    keys = ["_null", "_source", "_class", "_part"]
    rows = rows.withColumns(block)
    blocks = materialize(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")), "mix-blocks")
    targets = source_targets(blocks.select(F.when(~F.col("_null"), F.col("_source")).alias("source"), "size"))
    targets = targets.select(F.col("source").isNull().alias("_null"), F.coalesce("source", F.lit("")).alias("_source"), "source_size", "target")
    # a source has 16 classes an octave of sizes and a class 256 parts, however many rows they hold
    classes = blocks.groupBy("_null", "_source", "_class").agg(F.sum("n").alias("n"))
    classes = classes.withColumn("_before", _sum_before("n", ["_null", "_source"], "_class")).drop("n")
    starts = blocks.withColumn("start", _sum_before("n", ["_null", "_source", "_class"], "_part")).drop("n", "size")
    starts = starts.join(classes, ["_null", "_source", "_class"]).withColumn("start", F.col("start") + F.col("_before")).drop("_before").join(targets, ["_null", "_source"])
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("size", "doc_id", "md5", "tie")).cast("long")
    rows = rows.withColumn("_rank", rank).join(materialize(starts, "mix-starts"), keys)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = _unit(F.concat(F.lit(seed), F.col("_null").cast("string"), F.col("_source")))
    place = F.col("start") + F.col("_rank")
    copies = F.floor(place * rate + offset) - F.floor((place - 1) * rate + offset)
    return rows.withColumn("copies", copies.cast("long")).drop(*keys, "_rank", "start")


def mixture(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row per row of ``docs``."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words().alias("size"), F.md5(text_or_empty().cast("binary")).alias("md5"), F.lit(0).alias("tie"))
    out = with_copies(materialize(sized, "mix-sizes"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of ``docs`` as many times as it is taken."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words().alias("size"), F.md5(text_or_empty().cast("binary")).alias("md5"), F.xxhash64(*docs.columns).alias("tie"))
    out = with_copies(rows).filter("copies > 0").withColumn("_nth", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select("_row.*")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, MD5(COALESCE(text, '')) AS md5, COALESCE(LEN(REGEXP_EXTRACT_ALL(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (
  SELECT source, SUM(size)::BIGINT AS source_size,
    ([3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE])[((ROW_NUMBER() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS weight
  FROM d GROUP BY source),
p AS (
  SELECT *, SUM(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS all_size,
    COALESCE(SUM(source_size) OVER f, 0)::DOUBLE * 2.0::DOUBLE AS full_size,
    SUM(weight) OVER () - COALESCE(SUM(weight) OVER f, 0.0::DOUBLE) AS open_weight
  FROM s WINDOW f AS (ORDER BY source_size * 2.0::DOUBLE / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (
  SELECT *, (all_size - full_size) / open_weight AS level FROM p),
l AS (
  SELECT level FROM v WHERE level * weight <= source_size * 2.0::DOUBLE ORDER BY full_size, level LIMIT 1),
t AS (
  SELECT source, source_size, LEAST(source_size * 2.0::DOUBLE, COALESCE((SELECT level FROM l) * weight, source_size * 2.0::DOUBLE)) AS target FROM v),
r AS (
  SELECT d.*, source_size, target,
    ROW_NUMBER() OVER (PARTITION BY d.source ORDER BY
      LPAD(LENGTH(BIN(size))::VARCHAR, 2, '0') || RPAD(SUBSTR(BIN(size), 1, 5), 5, '0'),
      SUBSTR(MD5(COALESCE(doc_id::VARCHAR, '') || md5), 1, 2), size, doc_id NULLS FIRST, md5) AS place,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate,
    CAST('0x' || SUBSTR(MD5('mix-1' || CASE WHEN d.source IS NULL THEN 'true' ELSE 'false' END || COALESCE(d.source, '')), 1, 8) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE AS shift
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  size * (FLOOR(place::DOUBLE * rate + shift) - FLOOR((place - 1)::DOUBLE * rate + shift))::BIGINT AS taken
FROM r
"""
