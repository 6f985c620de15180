"""Helpers shared by the corpus operators: scratch tables, row keys, skew-safe joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Keys that hold more than one part in HOT_SHARE of the rows are split. Fewer
#: than HOT_SHARE keys can be that large, which bounds what a join broadcasts.
HOT_SHARE = 2000
#: A key with no more rows than this is never split.
HOT_FLOOR = 100

WORD = r"[^\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Only a local master, where one machine is the whole cluster, gets a
    temporary folder when the setting is absent.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="shutterlake-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


#: The tables of each open ``scratch_tables`` block of this thread, innermost last.
_open: ContextVar[tuple[list[str], ...]] = ContextVar("scratch_tables", default=())


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialized inside are deleted at the end, but for those made with ``keep``.

    What leaves the block must not read them: its plan may only hold tables
    made with ``keep``, which belong to the block around this one, if any.
    """
    own: list[str] = []
    before = _open.set((*_open.get(), own))
    try:
        yield
    finally:
        _open.reset(before)
        for path in own:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def tables_of(spark: SparkSession) -> str:
    """The folder of this application's tables."""
    return f"{scratch_dir(spark)}/shutterlake/{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete all tables that this application has made; what was computed from them must have been written."""
    _delete(spark, tables_of(spark))


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts lineage: a lost executor costs a re-read of the table, and ids
    given by ``monotonically_increasing_id`` stay what they were when written.
    """
    spark = df.sparkSession
    path = f"{tables_of(spark)}/{name}-{uuid.uuid4().hex}"
    blocks = _open.get()
    owner = len(blocks) - (2 if keep else 1)
    if owner >= 0:
        blocks[owner].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def id_key(doc_id: str = "doc_id") -> Column:
    """doc_id without nulls, for use as a join key together with a text hash."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63)))


def plain_id(doc_id: str = "doc_id") -> Column:
    """doc_id as text, so that pandas does not turn ids beside nulls into floats."""
    return F.col(doc_id).cast("long").cast("string").alias("doc_id")


def text_key(text: str = "text") -> Column:
    return F.xxhash64(text_or_empty(text))


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], salt_on: list[str], total: int, how: str = "inner", counts: DataFrame | None = None, deal_by: list[str] | None = None) -> DataFrame:
    """Join a large ``left`` to a ``right`` with one row a key, splitting hot keys.

    Keys with more than ``total / HOT_SHARE`` rows in ``left`` (at most
    HOT_SHARE keys, so their list is broadcast) are spread over as many salts as
    they hold such shares; the matching row of ``right`` is repeated for each
    salt. The salt is a hash of ``salt_on``, so a retried task deals alike.
    Keys must not be null. counts: the rows of each key as ``_n``, if known.
    deal_by: short columns of both sides that the keys determine, e.g. a hash of
    wide keys; hot ones are found, and broadcast, by these. They are dropped.
    """
    deal = deal_by or keys
    most = max(HOT_FLOOR, total // HOT_SHARE)
    counts = left.groupBy(*deal).agg(F.count(F.lit(1)).alias("_n")) if counts is None else counts
    hot = counts.filter(F.col("_n") > most)
    hot = F.broadcast(hot.select(*deal, F.ceil(F.col("_n") / F.lit(most)).cast("int").alias("_fan")))
    salt = F.pmod(F.xxhash64(*salt_on), F.coalesce("_fan", F.lit(1))).cast("int")
    dealt = left.join(hot, deal, "left").withColumn("_salt", salt).drop("_fan")
    spread = right.join(hot, deal, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_fan", F.lit(1)) - 1))).drop("_fan")
    own = [c for c in deal if c not in keys]
    return dealt.drop(*own).join(spread.drop(*own), [*keys, "_salt"], how).drop("_salt")


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, comp) for every node of ``edges`` (a long, b long); comp is the least node.

    Min-label propagation with pointer jumping, one table a round; labels halve
    their distance to the root, so the rounds grow with the log of the diameter.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = materialize(both, f"{name}-edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("degree"), F.least(F.col("node"), F.min("b")).alias("comp")), name)
    nodes, total = labels.agg(F.count(F.lit(1)), F.coalesce(F.sum("degree"), F.lit(0))).first()
    degrees, labels = labels.select("node", F.col("degree").alias("_n")), labels.select("node", "comp")
    moved = nodes
    while moved:
        near = salted_join(both.withColumnRenamed("b", "node"), labels, ["node"], ["a"], total, counts=degrees)
        near = near.groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("_near"))
        step = materialize(labels.join(near, "node").select("node", F.col("comp").alias("_old"), F.least("comp", "_near").alias("comp")), name)
        up = step.select(F.col("node").alias("comp"), F.col("comp").alias("_up"))
        jumped = salted_join(step, up, ["comp"], ["node"], nodes).withColumn("comp", F.least("comp", "_up"))
        seen = Observation()  # counted while the table is written
        labels = materialize(jumped.observe(seen, F.count_if(F.col("comp") != F.col("_old")).alias("moved")).select("node", "comp"), name)
        moved = seen.get["moved"]
    return labels
