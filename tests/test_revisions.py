"""Rollups maintained batch by batch equal rollups of the whole table, also after a restart and a replayed batch."""

import random

from pyspark.sql import functions as F

from shutterlake.operators import revisions
from shutterlake.streaming import ingest

SCHEMA = "id long, folder_path string, file_path string, file_size long, creation_date long, is_trashed int"
KEYS = {"albums": ["folder_path"], "years": ["year", "kind"]}


def counted(media):
    rows = media.filter("is_trashed = 0")
    return rows.withColumns({"year": F.year(F.timestamp_seconds("creation_date")), "kind": F.substring_index("file_path", ".", -1)})


def row(deal, i):
    date = None if deal.random() < 0.1 else deal.choice([0, 1, 2]) * 40_000_000 + deal.randrange(3)
    return (i, deal.choice(["/a", "/b", "/c", None]), f"/f/{i}.{deal.choice(['jpg', 'png'])}", deal.choice([None, 1, 20, 300]), date, int(deal.random() < 0.2))


def test_stream_of_changes(spark, tmp_path):
    deal = random.Random(11)
    store = str(tmp_path / "store")
    media = spark.createDataFrame([row(deal, i) for i in range(60)], SCHEMA)

    def write(number, media, rollups):
        media.write.mode("overwrite").parquet(f"{store}/{number}/media")
        for name, r in rollups.items():
            r.write.mode("overwrite").parquet(f"{store}/{number}/{name}")

    def read(number):
        at = f"{store}/{number - 1}"
        return spark.read.parquet(f"{at}/media"), {name: spark.read.parquet(f"{at}/{name}") for name in KEYS}

    write(-1, media, {name: revisions.rolled_up(counted(media), k) for name, k in KEYS.items()})
    form = SCHEMA + ", deleted boolean, changed_at long"
    state = {r["id"]: tuple(r) for r in media.collect()}
    touched = []
    for b in range(4):
        batch, last = [], {}
        for at in range(12):
            i = deal.randrange(70)
            gone = deal.random() < 0.3
            batch.append((*row(deal, i), gone, at))
            last[i] = None if gone else batch[-1][:6]
        touched.append(last)
        spark.createDataFrame(deal.sample(batch, len(batch)), form).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(form).parquet(str(tmp_path / "in"))
        ingest.drain(ingest.into_rollups(stream, read, write, KEYS, counted, str(tmp_path / "checkpoint")))  # a restart for each batch
        state = {i: r for i, r in (state | last).items() if r is not None}
        now = spark.createDataFrame(list(state.values()), SCHEMA)
        got_media, got = read(b + 1)
        assert sorted(map(str, got_media.collect())) == sorted(map(str, now.collect()))
        _, before = read(b)
        for name, k in KEYS.items():
            want = revisions.rolled_up(counted(now), k).drop("revision")
            assert sorted(map(str, got[name].drop("revision").collect())) == sorted(map(str, want.collect()))
            old = {tuple(r)[:-1]: r["revision"] for r in before[name].collect()}
            for r in got[name].collect():
                assert r["revision"] == old.get(tuple(r)[:-1], b + 1)  # kept where nothing changed

    # a batch that is run again writes the same
    last = 3
    first = {name: sorted(map(str, read(last + 1)[1][name].collect())) for name in KEYS}
    media, rollups = read(last)
    changes = spark.createDataFrame([(*(r or (i, None, None, None, None, 0)), r is None) for i, r in touched[last].items()], SCHEMA + ", deleted boolean")
    old, new, now = revisions.changed_rows(media, changes)
    for name, k in KEYS.items():
        again = revisions.revised(rollups[name], counted(old), counted(new), counted(now), k, last + 1)
        assert sorted(map(str, again.collect())) == first[name]


def test_empty_batch(spark):
    media = spark.createDataFrame([row(random.Random(1), i) for i in range(9)], SCHEMA)
    rollup = revisions.rolled_up(media, ["folder_path"])
    none = media.limit(0)
    assert sorted(map(str, revisions.revised(rollup, none, none, media, ["folder_path"], 5).collect())) == sorted(map(str, rollup.collect()))
    assert revisions.revised(rollup, media, none, none, ["folder_path"], 5).count() == 0
