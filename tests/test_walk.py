"""Walks of generated trees against a plain one, and watched roots over restarts."""

import os
import random
import time
from pathlib import Path

from pyspark.sql import functions as F

from shutterlake.sources import walk


def grown(top: Path, seed: int, n: int = 60) -> None:
    r = random.Random(seed)
    folders = [top]
    for i in range(n):
        folder = r.choice(folders) / f"d{i % 17}{r.choice(['', 'skip', '.x'])}"
        folder.mkdir(parents=True, exist_ok=True)
        folders.append(folder)
        for j in range(r.randint(0, 4)):
            (folder / f"f{i}_{j}.{r.choice(['JPG', 'png', 'txt', 'mp4'])}").write_bytes(bytes(r.randint(0, 900)))
    (top / "noext").write_bytes(b"x")
    os.symlink(folders[3], top / "link")
    os.symlink(top / "noext", top / "link.jpg")


def plain(top, exclusions=(), extensions=()):
    out = []
    for folder, names, files in os.walk(top):
        names[:] = [n for n in names if not any(e and e in f"{folder}/{n}" for e in exclusions)]
        for f in files:
            p = f"{folder}/{f}"
            if not os.path.islink(p) and (not extensions or "." in f and f.rsplit(".", 1)[1].lower() in extensions):
                out.append((p, os.path.getsize(p)))
    return sorted(out)


def pairs(df):
    return sorted((r["path"], r["size"]) for r in df.collect())


def test_walk_equals_a_plain_one_and_prunes(spark, tmp_path):
    grown(tmp_path, 1)
    top = str(tmp_path)
    assert pairs(walk.walked(spark, [top])) == plain(top)
    assert pairs(walk.walked(spark, [top, f"{top}/d1", top])) == plain(top)  # roots within roots count once
    got = walk.walked(spark, [top], ["skip", ""], ["jpg", "mp4"])
    assert pairs(got) == plain(top, ["skip"], {"jpg", "mp4"}) and 0 < got.count() < len(plain(top))
    some = f"{top}/d1"
    near = walk.walked(spark, [top]).filter(F.col("path").startswith(some) & (F.col("size") > 100) & (F.col("size") <= 700) & (F.col("modified") > 0))
    assert pairs(near) == [p for p in plain(top) if p[0].startswith(some) and 100 < p[1] <= 700]
    one = plain(top)[5][0]
    assert pairs(walk.walked(spark, [top]).filter(F.col("path") == one)) == [p for p in plain(top) if p[0] == one]
    assert walk.walked(spark, [f"{top}/none"]).count() == 0
    met = []
    rules = walk.Rules(["skip"], [], f"{top}/d1")
    rules.descends, keep = (lambda folder, f=rules.descends: met.append(folder) or f(folder)), rules.descends
    list(walk.below(top, rules))
    opened = {os.path.dirname(m) for m in met}
    assert all(o == top or keep(o) for o in opened)  # no folder below an excluded or a far one was opened


def test_parts_cover_a_tree_once(tmp_path):
    grown(tmp_path, 2)
    rules = walk.Rules([], [])
    for enough in (1, 3, 20, 10_000):
        found = [f[:2] for p in walk.dealt([str(tmp_path)], rules, enough) for f in walk.read(walk.Part(*p), rules)]
        assert sorted(found) == plain(tmp_path)


def test_watched_roots_over_restarts(spark, tmp_path):
    one, two, out, announced = tmp_path / "one", tmp_path / "two", tmp_path / "out", tmp_path / "announced"
    grown(one, 3, 20)
    grown(two, 4, 10)
    announced.write_text(f"{one}/d1\n")

    def run():
        stream = walk.watched(spark, str(announced), ["skip"], settle=0)
        query = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        assert query.awaitTermination(60)

    def seen():
        return pairs(spark.read.parquet(str(out)))

    (one / "d1").mkdir(exist_ok=True)
    (one / "d1" / "first.jpg").write_bytes(b"1")
    time.sleep(0.05)
    run()
    assert seen() == plain(one / "d1", ["skip"])
    announced.write_text(f"{one}/d1\n{one}\n{two}\n")  # a root around a known one, and another
    time.sleep(0.05)
    run()
    assert seen() == sorted(plain(one, ["skip"]) + plain(two, ["skip"]))
    time.sleep(0.05)
    (two / "new" / "deep").mkdir(parents=True)
    (two / "new" / "deep" / "late.png").write_bytes(b"22")
    (one / "d1" / "more.png").write_bytes(b"333")
    time.sleep(0.05)
    run()
    run()  # nothing new
    assert seen() == sorted(plain(one, ["skip"]) + plain(two, ["skip"]))
