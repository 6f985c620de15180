"""Incremental ingest with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from shutterlake.operators.dml import upsert_media
from shutterlake.operators.revisions import changed_rows, revised


def arrivals(spark: SparkSession, folder: str, schema, batch_files: int = 512) -> DataFrame:
    """Parquet files of scanned entries as they are added to a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", batch_files).parquet(folder)


def into_library(entries: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """Upsert each batch of entries into the library; of one path the last modified entry of a batch counts.

    ``write`` gets the new table and the batch number; a batch that is replayed
    after a failure gives the same table, so it may be written again.
    """

    def batch(df: DataFrame, number: int) -> None:
        latest = df.groupBy("file_path").agg(F.max_by(F.struct(*df.columns), F.struct("modified_date", "file_size")).alias("e")).select("e.*")
        write(upsert_media(read(), latest), number)

    return entries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def pending_only(entries: DataFrame, done: Callable[[], DataFrame], handle: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """Hand each batch's rows that have no result yet (by file_path) to ``handle``."""

    def batch(df: DataFrame, number: int) -> None:
        handle(df.dropDuplicates(["file_path"]).join(done().select("file_path"), "file_path", "left_anti"), number)

    return entries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def into_rollups(changes: DataFrame, read: Callable[[int], tuple[DataFrame, dict[str, DataFrame]]], write: Callable[[int, DataFrame, dict[str, DataFrame]], None], keys: dict[str, list[str]], rows: Callable[[DataFrame], DataFrame], checkpoint: str) -> DataStreamWriter:
    """Keep media and its rollups in step with a stream of changes (the columns of media, ``deleted``, ``changed_at``).

    ``read(n)`` gives media and rollups as they were before batch ``n``, ``write(n,
    media, rollups)`` stores them under that number; a batch that is replayed after
    a failure reads and writes the same, so no delta counts twice. ``rows`` picks
    the media that count and adds the keys. Of one id the last change of a batch
    counts. The revision of batch ``n`` is ``n + 1``.
    """

    def batch(df: DataFrame, number: int) -> None:
        media, rollups = read(number)
        latest = df.groupBy("id").agg(F.max(F.struct("changed_at", *[c for c in df.columns if c not in ("id", "changed_at")])).alias("c")).select("id", "c.*")
        old, new, now = changed_rows(media, latest)
        write(number, now, {name: revised(rollups[name], rows(old), rows(new), rows(now), k, number + 1) for name, k in keys.items()})

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def drain(writer: DataStreamWriter) -> StreamingQuery:
    """Process what is there and stop."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def activity(events: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events by window and type with a watermark; works on batch and streaming tables alike."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    by = rows.groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return by.select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, key: str, gap: str = "3 days", late: str = "1 day") -> DataFrame:
    """Sessions of each key that end after ``gap`` without an event."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    by = rows.groupBy(F.session_window("ts", gap), key).agg(F.count(F.lit(1)).alias("n"))
    return by.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def coalesced(triggers: DataFrame, key: str, quiet: str = "1 second", late: str = "1 day") -> DataFrame:
    """One refresh for each burst of triggers of a key: when it fires, ``quiet`` after the last one, and how many it answers."""
    return sessions(triggers, key, quiet, late).select(key, F.col("end").alias("fires"), "n")


def weekly_batch(memories: DataFrame, batch: DataFrame, now: int, full: int = 5, days: int = 7) -> DataFrame:
    """Memories (date, created_at, expires_at, custom) after a weekly run that made ``batch`` (date).

    Nothing changes while ``full`` memories that are not custom are live. Else
    the new ones live for ``days``, and older ones that are not custom go, if
    there is any new one.
    """
    columns = ["date", "created_at", "expires_at", "custom"]
    live = memories.agg(F.count_if((F.col("custom") == 0) & (F.col("expires_at") > now)).alias("_live"))
    made = batch.select("date").distinct().join(F.broadcast(live)).filter(F.col("_live") < full)  # one row
    made = made.select("date", F.lit(now).alias("created_at"), F.lit(now + days * 86400).alias("expires_at"), F.lit(0).alias("custom"))
    any_new = made.agg((F.count(F.lit(1)) > 0).alias("_replaced"))
    kept = memories.select(*columns).join(F.broadcast(any_new)).filter(~F.col("_replaced") | (F.col("custom") == 1) | (F.col("created_at") >= now))
    return kept.select(*columns).unionByName(made)


def live_memories(memories: DataFrame, now: int) -> DataFrame:
    """Memories that are custom or have not expired."""
    return memories.filter((F.col("custom") == 1) | (F.col("expires_at") > now))
