"""Stateful timers on streams equal batch versions, whatever the batches, and after a restart from a checkpoint."""

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shutterlake.plans.analytics import messages_of
from shutterlake.plans.registry import ORACLE
from shutterlake.streaming import timers

EVENTS = "/root/testdata/sf0.001/events.parquet"
LATER = "2030-01-01 00:00:00"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, timers.ROCKSDB)
    yield spark
    spark.conf.set(name, before)


def streamed(spark, rows, make, path, batches, end):
    """What ``make`` of a stream of the rows gives, which arrive in batches and out of order within a few hours; stopped and started again half-way."""
    folder, out, checkpoint = (f"{path}/{n}" for n in ("in", "out", "checkpoint"))

    def run():
        stream = make(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    cut = rows.withColumn("_b", F.ntile(batches).over(Window.orderBy(F.col("ts") + F.make_interval(secs=(F.xxhash64("ts", "key") % 1800).cast("decimal(18,6)")))))
    cut = cut.cache()
    for b in range(1, batches + 1):
        cut.filter(F.col("_b") == b).drop("_b").coalesce(1).write.mode("append").parquet(folder)
        if b == batches // 2:
            run()
    run()
    end.coalesce(1).write.mode("append").parquet(folder)  # a row of a far later time moves the watermark past all others
    run()
    return spark.read.parquet(out)


def test_debounce_equals_bursts_of_the_table(rocks, tmp_path):
    rows = rocks.read.parquet(EVENTS).select(F.col("event_type").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    end = rocks.createDataFrame([("end", LATER)], "key string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = streamed(rocks, rows, lambda s: timers.debounced(s, 1_800_000, "2 hours"), tmp_path, 6, end)
    con = duckdb.connect()
    want = con.sql(f"""SELECT event_type, EPOCH_US(MAX(ts)) + 1800000000, COUNT(*) FROM (SELECT *, SUM(new) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS s FROM (
        SELECT *, CASE WHEN ts - LAG(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM '{EVENTS}') a) b GROUP BY event_type, s""").fetchall()
    assert sorted(map(tuple, got.filter("key <> 'end'").select("key", F.unix_micros("fires"), "n").collect())) == sorted(want)


def test_only_the_latest_generation_is_answered(rocks, tmp_path):
    events = rocks.read.parquet(EVENTS)
    rows = messages_of(events)
    end = rows.limit(1).select(F.lit(-1).cast("long").alias("key"), F.lit(LATER).cast("timestamp").alias("ts"), F.lit(False).alias("answers"), F.lit(0).cast("long").alias("generation"), F.lit(0).cast("long").alias("id"))
    got = streamed(rocks, rows, lambda s: timers.latest_answers(s, "2 hours"), tmp_path, 5, end)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{EVENTS}'")
    want = con.sql(f"SELECT key, id, EPOCH_US(ts), generation FROM ({ORACLE['t7_latest_answers']}) t").fetchall()
    assert 0 < len(want) < events.count()
    assert sorted(map(tuple, got.select("key", "id", F.unix_micros("ts"), "generation").collect())) == sorted(want)
