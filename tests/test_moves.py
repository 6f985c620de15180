"""Moves with numbered names equal a sequential version, whatever the blocks."""

import random

import pytest

from shutterlake.operators import moves


def one_by_one(files, wanted):
    """Moves by id: first those that keep their names, then the numbered ones."""
    used, out = set(files.values()), {}
    rows = []
    for i in sorted(wanted):
        folder, name = files[i].rsplit("/", 1)
        if folder != wanted[i]:
            rows.append((i, wanted[i], name))
    rest = []
    for i, target, name in rows:
        if f"{target}/{name}" in used:
            rest.append((i, target, name))
        else:
            out[i] = f"{target}/{name}"
            used.add(out[i])
    for i, target, name in rest:
        base, dot, ext = name.rpartition(".")
        base, ext = (base, ext) if dot else (name, "")
        n = 1
        while (new := f"{target}/{base}_{n}" + ("." + ext if ext else "")) in used:
            n += 1
        out[i] = new
        used.add(new)
    return out


@pytest.mark.parametrize("block_rows", [7, 1_000_000])
def test_moves(spark, block_rows):
    deal = random.Random(5)
    names = ["a.jpg", "a_1.jpg", "a_3.jpg", "a_1_1.jpg", "a_01.jpg", "a", "a.", "a_2", "a_2.", ".a", "_1.a", "b.tar.gz", "b.tar_1.gz", "b_7.JPG", "é\n_1.x"]
    files = {}
    for folder in ("/x", "/y", "/y/z", "/w%_"):
        for name in names:
            if deal.random() < 0.7:
                files[len(files) + 1] = f"{folder}/{name}"
    for n in range(40):
        files[len(files) + 1] = f"/many/{n}/a.jpg"  # the name of most
    wanted = {i: deal.choice(["/x", "/y", "/w%_"]) for i in files if deal.random() < 0.8}
    media = spark.createDataFrame([(i, p, p.rsplit("/", 1)[0], "kept") for i, p in files.items()] + [(999, None, None, "lost")], "id long, file_path string, folder_path string, target string")
    asked = spark.createDataFrame([*wanted.items(), (4711, "/x"), (999, "/x"), (1, None), *[(i, t + "~") for i, t in wanted.items() if i % 3 == 0]], "id long, target string")
    done = moves.renames(media, asked, block_rows=block_rows)
    got = {r["id"]: r["new_path"] for r in done.collect()}
    want = one_by_one(files, wanted)
    assert got == want
    after = moves.moved(media, done).collect()
    assert {r["id"]: (r["file_path"], r["target"]) for r in after if r["id"] != 999} == {i: (want.get(i, p), "kept") for i, p in files.items()}
    assert len({r["file_path"] for r in after}) == len(files) + 1
    assert all(r["folder_path"] == r["file_path"].rsplit("/", 1)[0] for r in after if r["file_path"])
    thumbs = spark.createDataFrame([(p, 1) for p in files.values()], "file_path string, size int")
    assert {r["file_path"] for r in moves.moved_thumbnails(thumbs, done).collect()} == {want.get(i, p) for i, p in files.items()}


def test_nothing_to_move(spark):
    media = spark.createDataFrame([(1, "/x/a.jpg", "/x")], "id long, file_path string, folder_path string")
    asked = spark.createDataFrame([(1, "/x")], "id long, target string")
    assert moves.renames(media, asked).count() == 0 and moves.renames(media.limit(0), asked).count() == 0
    assert moves.renames(media, asked.limit(0)).count() == 0
    elsewhere = media.select("file_path").union(spark.createDataFrame([("/y/a.jpg",)], "file_path string"))
    to = spark.createDataFrame([(1, "/y")], "id long, target string")
    assert moves.renames(media, to, elsewhere).first()["new_path"] == "/y/a_1.jpg"
