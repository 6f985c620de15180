"""Near-duplicate detection by DartMinHash signatures and banded joining.

A document is the weighted set of its runs of five words, weight = times that
the run occurs; similarity is the weighted Jaccard index. DartMinHash throws
darts at the weighted elements: each unit of weight of an element has its own
fixed Poisson stream of darts, a dart having a rank and a coordinate, and each
coordinate of the signature keeps the earliest dart. Only ranks below
t / total weight are ever generated, so a signature costs O(weight + k log k).

Documents that agree on all coordinates of a band meet in a bucket. Within a
bucket members are first compared with its most popular member, not with each
other; that leader has met all members and leaves, and a bucket is done when
its members are in one class. What is then left is cut into blocks of BLOCK
members and BLOCK_WEIGHT elements, and each two blocks of a bucket are compared
by one numpy step that returns only links which join classes. So every pair
that shares a bucket and ends in two classes has been compared, no task holds
more than two blocks, and links are verified on the full sets.

Defined cases: null text is empty; texts of one to four words are one run of
all their words; texts without words are near nothing but texts equal to them;
equal texts are one document to the search; rows that repeat doc_id and text
count as one document; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, id_key, materialize, salted_join, scratch_tables, text_or_empty
from .textkit import Words, batches, encoded, grams, mix

RUN = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 6
#: Members and elements of a block of what a bucket's leader leaves, as dealt by hash.
BLOCK, BLOCK_WEIGHT = 512, 1 << 20
#: Members that one matrix product compares with as many others; cells of the matrix, beyond which pairs are intersected one by one.
TILE, CELLS = 128, 1 << 25
_STEP = np.uint64(0x9E3779B97F4A7C15)


def weighted_elements(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(element, index of text): one 64-bit element for each unit of weight.

    The j-th occurrence of a run in a text is the run's j-th unit, so that the
    weighted Jaccard index is the plain one of these element sets.
    """
    words = Words(texts)
    h = words.hash
    runs = grams(h, RUN)
    doc = words.doc[: len(runs)]
    inside = words.doc[RUN - 1 :] == doc if len(runs) else np.zeros(0, bool)
    runs, doc = runs[inside], doc[inside]
    short = np.flatnonzero((words.count > 0) & (words.count < RUN))
    if len(short):
        whole = [grams(h[a : a + n], n)[0] for a, n in zip(words.first[short], words.count[short], strict=True)]
        runs, doc = np.append(runs, np.array(whole, np.uint64)), np.append(doc, short)
    order = np.lexsort((runs, doc))
    runs, doc = runs[order], doc[order]
    at = np.arange(len(runs))
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:] != runs[:-1]) | (doc[1:] != doc[:-1])
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    return mix(runs + nth.astype(np.uint64) * _STEP), doc


def dart_signatures(element: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """The [n_docs, k] earliest darts; rows of documents without elements are 0."""
    weight = np.bincount(doc, minlength=n_docs)
    out = np.zeros((n_docs, k), np.uint64)
    t = k * (np.log(k) + 5)
    todo = weight > 0
    while todo.any():
        on = todo[doc]
        found, rank = _earliest(element[on], doc[on], n_docs, k, t / np.maximum(weight, 1))
        full = todo & np.isfinite(rank).all(axis=1)
        out[full] = found[full]
        todo &= ~full
        t *= 2
    return out


def _earliest(element: np.ndarray, doc: np.ndarray, n_docs: int, k: int, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cells, ranks, darts = [], [], []
    reached, thrown, width = np.zeros(len(element)), 0, 1
    while len(element):
        nth = np.arange(thrown, thrown + width, dtype=np.uint64)
        dart = mix(element[:, None] + (nth + np.uint64(1))[None, :] * np.uint64(0xC2B2AE3D27D4EB4F))
        gap = -np.log(((mix(dart ^ _STEP) >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53)
        rank = reached[:, None] + np.cumsum(gap, axis=1)
        early = rank <= limit[doc][:, None]
        row, _ = np.nonzero(early)
        hit = dart[early]
        cells.append(doc[row] * k + (hit % np.uint64(k)).astype(np.int64))
        ranks.append(rank[early])
        darts.append(hit)
        go = early[:, -1]
        element, doc, reached = element[go], doc[go], rank[go, -1]
        thrown, width = thrown + width, min(64, width * 4)
    cell, rank, dart = (np.concatenate(x) if x else np.zeros(0) for x in (cells, ranks, darts))
    best = np.full(n_docs * k, np.inf)
    np.minimum.at(best, cell.astype(np.int64), rank)
    found = np.zeros(n_docs * k, np.uint64)
    first = rank == best[cell.astype(np.int64)]
    found[cell[first].astype(np.int64)] = dart[first]
    return found.reshape(n_docs, k), best.reshape(n_docs, k)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(signatures), bands), np.uint64)
    for b in range(bands):
        x = np.full(len(signatures), mix(np.full(1, b + 1, np.uint64))[0])
        for r in range(rows):
            x = mix(x + signatures[:, b * rows + r])
        out[:, b] = x
    return out.view(np.int64)


def _band_frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        texts = encoded(frame["text"])
        for a, b in batches(texts):
            element, doc = weighted_elements(texts[a:b])
            weight = np.bincount(doc, minlength=b - a)
            bands = band_keys(dart_signatures(element, doc, b - a, BANDS * ROWS), BANDS, ROWS)
            bands = [list(x) if w else [] for x, w in zip(bands, weight, strict=True)]
            yield pd.DataFrame({"fp": frame["fp"].to_numpy()[a:b], "weight": weight, "bands": bands})


def _set_frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        texts = encoded(frame["text"])
        for a, b in batches(texts):
            element, doc = weighted_elements(texts[a:b])
            cut = np.searchsorted(doc, np.arange(b - a + 1))
            sets = [element[x:y].view(np.int64) for x, y in zip(cut[:-1], cut[1:], strict=True)]
            yield pd.DataFrame({"uid": frame["uid"].to_numpy()[a:b], "elements": sets})


def near_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, class_size, kept, fp: one row per row of ``docs``.

    class_id is the least doc_id of the class, whose row is kept; class_size
    counts documents. fp is the MD5 of the text.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text_or_empty().cast("binary")).alias("fp"))
    with scratch_tables(docs.sparkSession):
        slim = docs.select(F.md5(text_or_empty().cast("binary")).alias("fp"), text_or_empty().alias("text"))
        signed = slim.mapInPandas(_band_frames, "fp string, weight long, bands array<long>")
        texts = materialize(signed.dropDuplicates(["fp"]).withColumn("uid", F.monotonically_increasing_id()), "dart-signatures")
        classes = _classes(slim, texts, similarity)
        member = texts.select("fp", "uid").join(classes, "uid", "left").select("fp", F.coalesce("comp", "uid").alias("comp"))
        by_text = ids.groupBy("fp").agg(F.min(F.struct(id_key().alias("k"), "doc_id", "fp")).alias("first"), F.count(F.lit(1)).alias("n"))
        by_text = materialize(by_text.join(member, "fp"), "dart-members")
        by_class = by_text.groupBy("comp").agg(F.min("first").alias("first"), F.sum("n").alias("class_size"))
        answer = salted_join(by_text.select("fp", "comp", "n"), by_class, ["comp"], ["fp"], by_text.count()).select("fp", "n", "first", "class_size")
        answer = materialize(answer, "dart-answer", keep=True)
    out = salted_join(ids, answer.drop("n"), ["fp"], ["doc_id"], docs.count(), counts=answer.select("fp", F.col("n").alias("_n")))
    kept = (id_key() == F.col("first.k")) & (F.col("fp") == F.col("first.fp"))
    return out.select("doc_id", F.col("first.doc_id").alias("class_id"), "class_size", kept.alias("kept"), "fp")


def _classes(slim: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(uid, comp) of the texts that verified links connect."""
    banded = texts.select("uid", "weight", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # rows of a bucket are short, and none meets more than one: skewed buckets are split by AQE
    seats = materialize(banded.join(shared, "band"), "dart-buckets")
    n_seats = seats.count()
    if not n_seats:
        return texts.select("uid", F.col("uid").alias("comp")).limit(0)
    # the text that others were copied from shares most bands with most of them and leads best
    popular = seats.groupBy("uid").agg(F.sum("n").alias("pop"))
    seats = materialize(seats.join(popular, "uid"), "dart-seats")
    # copies of a text are dropped before its set is made: partial dropDuplicates leaves one a task
    wanted = slim.dropDuplicates(["fp"]).join(texts.select("uid", "fp").join(popular.select("uid"), "uid", "left_semi"), "fp").select("uid", "text")
    sets = materialize(wanted.mapInPandas(_set_frames, "uid long, elements array<long>"), "dart-sets")
    lead = seats.groupBy("band").agg(F.max(F.struct("pop", "uid", "weight")).alias("lead"))
    led = materialize(seats.join(lead, "band").filter(F.col("uid") != F.col("lead.uid")).select("band", "uid", "weight", F.col("lead.uid").alias("lead"), F.col("lead.weight").alias("lead_weight")), "dart-led")
    # only leaders whose weight allows the similarity
    alike = F.least("weight", "lead_weight") >= F.greatest("weight", "lead_weight") * similarity - 1e-9
    pairs = led.filter(alike).select(F.least("uid", "lead").alias("a"), F.greatest("uid", "lead").alias("b")).distinct()
    classes = connected_components(_verified(materialize(pairs, "dart-pairs"), sets, similarity), "dart-classes").withColumnRenamed("node", "uid")
    # leaders have met all members of their buckets and go; a bucket of one class is done
    rest = led.select("band", "uid", "weight").join(classes, "uid", "left").withColumn("comp", F.coalesce("comp", "uid"))
    rest = materialize(rest, "dart-rest")
    divided = rest.groupBy("band").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")).filter("x <> y")
    blocks = F.ceil(F.greatest(F.col("n") / float(BLOCK), F.col("w") / float(BLOCK_WEIGHT))).cast("int")
    rest = materialize(rest.join(divided.select("band", blocks.alias("blocks")), "band"), "dart-divided")
    joined = materialize(_block_links(rest, sets, similarity, n_seats), "dart-joined")
    if joined.limit(1).count():  # classes are few here: each joins others as one node
        above = connected_components(joined, "dart-joined-classes").select(F.col("node").alias("comp"), F.col("comp").alias("_up"))
        classes = classes.join(joined.select(F.col("a").alias("uid")).union(joined.select("b")).distinct(), "uid", "full_outer").withColumn("comp", F.coalesce("comp", "uid"))
        classes = salted_join(classes, above, ["comp"], ["uid"], n_seats, "left").select("uid", F.coalesce("_up", "comp").alias("comp"))
    return classes


def _block_links(rest: DataFrame, sets: DataFrame, similarity: float, n_seats: int) -> DataFrame:
    """Links (a, b) between the classes of what is left in each bucket (band, uid, comp, blocks), two blocks at a time."""
    rows = rest.withColumn("block", F.pmod(F.xxhash64("uid", "band"), F.col("blocks")).cast("int"))
    # block i meets the blocks from i on; each two blocks are a key of their own
    later = F.transform(F.sequence("block", F.col("blocks") - 1), lambda j: F.struct(F.col("block").alias("i"), j.alias("j"), F.lit(False).alias("second")))
    before = F.transform(F.sequence(F.lit(0), F.col("block")), lambda i: F.struct(i.alias("i"), F.col("block").alias("j"), F.lit(True).alias("second")))
    before = F.filter(before, lambda p: p["i"] < p["j"])
    rows = salted_join(rows, sets, ["uid"], ["band"], n_seats)
    met = rows.select("band", "uid", "comp", "elements", F.explode(F.concat(later, before)).alias("p")).select("band", "uid", "comp", "elements", "p.*")

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        x = frame[~frame["second"]]
        y = frame[frame["second"]] if frame["second"].any() else x
        return pd.DataFrame(_joining_links(x, y, similarity), columns=["a", "b"])

    return met.groupBy("band", "i", "j").applyInPandas(work, "a long, b long").distinct()


def _joining_links(x: pd.DataFrame, y: pd.DataFrame, similarity: float) -> list[tuple[int, int]]:
    """Classes (of uid, comp, elements) of two blocks that a link joins; what is joined already is left out."""
    up: dict[int, int] = {}

    def top(c: int) -> int:
        while c in up:
            c = up[c]
        return c

    out = []
    for i in range(0, len(x), TILE):
        for j in range(i if x is y else 0, len(y), TILE):
            one, two = x.iloc[i : i + TILE], y.iloc[j : j + TILE]
            classes = one["comp"].tolist(), two["comp"].tolist()
            if len({top(c) for c in (*classes[0], *classes[1])}) == 1:
                continue
            for m, n in zip(*np.nonzero(_near(one["elements"].tolist(), two["elements"].tolist(), similarity)), strict=True):
                a, b = top(classes[0][m]), top(classes[1][n])
                if a != b:
                    up[max(a, b)] = min(a, b)
                    out.append((classes[0][m], classes[1][n]))
    return out


def _near(x: list, y: list, similarity: float) -> np.ndarray:
    """[x, y]: whether two element sets reach the similarity."""
    every = [np.asarray(e) for e in (*x, *y)]
    size = np.array([len(e) for e in every])
    m = len(x)
    kinds, place = np.unique(np.concatenate(every), return_inverse=True)
    if len(every) * len(kinds) <= CELLS:
        held = np.zeros((len(every), len(kinds)), np.float32)
        held[np.repeat(np.arange(len(every)), size), place] = 1
        both = held[:m] @ held[m:].T
    else:
        both = np.array([[len(np.intersect1d(a, b, assume_unique=True)) if similarity * max(len(a), len(b)) <= min(len(a), len(b)) else 0 for b in every[m:]] for a in every[:m]])
    return both >= (size[:m, None] + size[None, m:] - both) * similarity - 1e-6


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    n = pairs.count()
    one = salted_join(pairs, sets.withColumnsRenamed({"uid": "a", "elements": "x"}), ["a"], ["b"], n)
    two = salted_join(one, sets.withColumnsRenamed({"uid": "b", "elements": "y"}), ["b"], ["a"], n)
    both = F.size(F.array_intersect("x", "y"))
    return two.filter(both >= (F.size("x") + F.size("y") - both) * similarity - 1e-9).select("a", "b")


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each class, with all their columns."""
    answer = near_classes(docs, similarity)
    keys = [id_key().alias("_id"), F.md5(text_or_empty().cast("binary")).alias("_fp")]
    gone = answer.select(id_key().alias("_id"), F.col("fp").alias("_fp"), "kept").groupBy("_id", "_fp").agg(F.first("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    gone = materialize(gone.filter("not kept or n > 1"), "dart-gone")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), *keys)
    out = rows.join(gone.select("_id", "_fp"), ["_id", "_fp"], "left_anti")
    repeated = gone.filter("kept").select("_id", "_fp")
    if repeated.limit(1).count():  # rows that repeat doc_id and text: one of each stays
        out = out.unionByName(rows.join(repeated, ["_id", "_fp"], "left_semi").dropDuplicates(["_id", "_fp"]))
    return out.select("_row.*")
