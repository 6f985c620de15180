"""Hard negatives for retrieval training by a norm-bucketed search.

Vectors are quantised to integers, sorted by norm and packed in buckets, each
of which knows its largest norm. An anchor's score with a row of a bucket is at
most |anchor| * largest norm (Cauchy-Schwarz), so buckets whose bound is below
what a window still takes are skipped, and as buckets are met by falling norm,
the first bucket that is skipped for all anchors ends the search. Twice:

* positives: the best rows of the anchor's own label; the bar is the running
  k-th best score.
* negatives: for each positive the best rows of other labels whose scores lie in
  its window [low * score, high * score]; the bar is the window's lower limit or
  the running k-th best score, whichever is higher. Buckets below the lowest
  limit of a whole block of anchors are not even sent to it.

Anchors are packed in blocks as well, by norm. Buckets are gathered in groups
and anchors in chunks of bounded bytes, and a task meets one group with one
chunk, so neither side is in a task as a whole, a group is copied once for each
chunk, a chunk once for each group, and a task hands on k rows a window.

Defined cases: rows without vec_id or label, and vectors that are null or hold
null or non-finite components, take no part; an anchor meets vectors of its own
length only; rows that repeat an anchor's vec_id are that anchor and not others,
and it is asked once, with the least of its vectors (then of its labels); other
repeated rows are candidates each; an anchor without another row of its label
gives nothing, nor does a positive whose score is negative (its window is empty)
or that no row of another label comes close to; an empty table gives an empty
result; other columns are ignored. Scores are exact whatever their size; a
component of 62 bits or more, or a positive's score that is no long, ends the
job with an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .vectorkit import finite, floored, from_bytes, products, runs, to_bytes

SCALE = 256
#: Bytes of vectors in a group of buckets, or in a chunk of anchors; anchors that are scored at once.
GROUP_BYTES, CHUNK_BYTES, BATCH = 32 << 20, 8 << 20, 256
#: Most rows of a list of groups or chunks that is broadcast, and most partitions that pairs of them are dealt to.
LISTED, MOST_TASKS = 100_000, 20_000
#: What a bound computed in doubles may be too small by.
SLACK = 1 + 1e-9
NO_LONG = 2**63 - 1
LOWEST = -(2**63)

PACKED = "dim int, width int, n int, part int, high double, least double, ids binary, labels binary, data binary, won binary, scores binary"


def taking_part(table: DataFrame, label: Column | None = None) -> DataFrame:
    """vec_id, label, v of the rows that take part: whole numbers floor(SCALE * x)."""
    label = F.col("label") if label is None else label
    rows = table.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("embedding")))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), floored(F.col("embedding"), SCALE).alias("v"))


def _packer(most_bytes: int, share: tuple[int, int] | None):
    """Rows vec_id, label, v, norm (and won, scores) of a task as blocks. ``share``: a window's lower limit as a fraction of its positive's score."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for frame in frames:
                columns = [frame[c] for c in ("vec_id", "label", "v", "norm")] + ([frame["won"], frame["scores"]] if share else [])
                yield from zip(*columns, strict=True)

        part = held = 0
        for block in runs(rows(), lambda r: len(r[2])):
            width, data = to_bytes([r[2] for r in block])
            if held and held + len(data) > most_bytes:
                part, held = part + 1, 0
            held += len(data)
            out = {"dim": len(block[0][2]), "width": width, "n": len(block), "part": part, "high": max(r[3] for r in block), "least": -math.inf}
            out |= {"ids": np.array([r[0] for r in block], "<i8").tobytes(), "labels": np.array([r[1] for r in block], "<i8").tobytes(), "data": data, "won": b"", "scores": b""}
            if share:
                most = max(len(r[4]) for r in block)
                won, scores = np.zeros((len(block), most), "<i8"), np.full((len(block), most), -1, "<i8")  # a window of -1 is empty
                for i, r in enumerate(block):
                    won[i, : len(r[4])], scores[i, : len(r[5])] = r[4], r[5]
                out |= {"won": won.tobytes(), "scores": scores.tobytes(), "least": float(scores[scores >= 0].min(initial=NO_LONG)) * share[0] / share[1]}
            yield pd.DataFrame([out])

    return work


def _blocks(rows: DataFrame, name: str, most_bytes: int, share: tuple[int, int] | None = None) -> DataFrame:
    """``rows`` by length and falling norm in blocks; ``lot`` numbers runs of blocks of at most ``most_bytes``, or one block."""
    rows = rows.withColumns({"dim": F.size("v"), "norm": F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))})
    n, values = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("dim"), F.lit(0))).first()
    wide = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, -(-values * 2 // most_bytes), min(-(-n // 512), wide))
    # the last two keys only deal ties of a norm and repeated rows over the partitions
    rows = rows.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(parts, "dim", F.desc("norm"), F.xxhash64("vec_id"), "_at")
    packed = rows.sortWithinPartitions("dim", F.desc("norm")).drop("_at").mapInPandas(_packer(most_bytes, share), PACKED)
    lot = F.spark_partition_id().cast("long") * (1 << 20) + F.col("part")
    return materialize(packed.withColumn("lot", lot).drop("part"), name)  # a written number of a lot stays


class _Best:
    """The k best (score, id) of each key so far; ties go to the smaller id."""

    def __init__(self, keys: int, k: int):
        self.k = k
        self.key, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.bar = np.full(keys, LOWEST, np.int64)

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(key):
            return
        key, score, ids = np.append(self.key, key), np.append(self.score, score), np.append(self.id, ids)
        order = np.lexsort((ids, -score, key))
        key, score, ids = key[order], score[order], ids[order]
        nth = np.arange(len(key)) - np.searchsorted(key, key)
        fine = nth < self.k
        self.bar[key[nth == self.k - 1]] = score[nth == self.k - 1]
        self.key, self.score, self.id = key[fine], score[fine], ids[fine]


def search(buckets: list[tuple], anchors: tuple, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, window, id, score) of the k best rows of each window [low, high] (anchor, window), in batches of anchors.

    buckets: (largest norm, ids, labels, vectors) by falling norm; anchors: ids,
    labels, vectors, norms; same: rows of the anchor's label, else of others.
    """
    ids, labels, vectors, norms = anchors
    windows = low.shape[1]
    for a in range(0, len(ids), BATCH):
        lo, hi = low[a : a + BATCH], high[a : a + BATCH]
        best = _Best(lo.size, k)
        for norm, row_ids, row_labels, rows in buckets:
            bars = np.maximum(lo, best.bar.reshape(lo.shape))
            bars = np.where(lo <= hi, bars, NO_LONG)  # nothing enters an empty window
            bar = bars.min(axis=1)
            alive = np.flatnonzero((norms[a : a + BATCH] * norm * SLACK >= bar) & (bar < NO_LONG))
            if not len(alive):
                break  # those that follow have smaller norms
            score = products(vectors[a + alive], rows)
            fine = (score >= bar[alive, None]) & ((labels[a + alive, None] == row_labels) == same) & (ids[a + alive, None] != row_ids)
            x, row = np.nonzero(fine)
            found, x = score[x, row], alive[x]
            for w in range(windows):
                inside = (found >= bars[x, w]) & (found <= hi[x, w])
                best.add(x[inside] * windows + w, found[inside], row_ids[row[inside]])
        yield a + best.key // windows, best.key % windows, best.id, best.score


def _searched(same: bool, k: int, share: tuple[int, int] | None):
    """What a task makes of one group of buckets and one chunk of anchors."""

    def work(index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        by_dim: dict[int, list[tuple]] = {}
        if len(asked):
            for r in index.sort_values("high", ascending=False).itertuples(index=False):
                by_dim.setdefault(r.dim, []).append((r.high, np.frombuffer(r.ids, "<i8"), np.frombuffer(r.labels, "<i8"), from_bytes(r.data, r.width, r.n)))
        for r in asked.itertuples(index=False):
            ids, vectors = np.frombuffer(r.ids, "<i8"), from_bytes(r.data, r.width, r.n)
            norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
            if share:
                won, high = np.frombuffer(r.won, "<i8").reshape(r.n, -1), np.frombuffer(r.scores, "<i8").reshape(r.n, -1)
                low = np.array([[-(-share[0] * p // share[1]) if p >= 0 else 0 for p in line] for line in high.tolist()], np.int64).reshape(high.shape)
            else:
                won, low, high = (np.full((r.n, 1), x, np.int64) for x in (0, LOWEST, NO_LONG))
            for x, w, found, score in search(by_dim.get(r.dim, []), (ids, np.frombuffer(r.labels, "<i8"), vectors, norms), low, high, same, k):
                out.append(pd.DataFrame({"anchor_id": ids[x], "nth": (w + 1).astype(np.int32), "positive_id": won[x, w], "positive_score": high[x, w], "vec_id": found, "score": score}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in FOUND_COLUMNS})

    return work


FOUND = "anchor_id long, nth int, positive_id long, positive_score long, vec_id long, score long"
FOUND_COLUMNS = [c.split()[0] for c in FOUND.split(", ")]


def _listed(stats: DataFrame) -> DataFrame:
    """A list of groups or chunks, broadcast if it is short."""
    return F.broadcast(stats) if stats.limit(LISTED + 1).count() <= LISTED else stats


def _met(index: DataFrame, asked: DataFrame, same: bool, k: int, share: tuple[int, int] | None) -> DataFrame:
    """``FOUND`` rows: the k best of each group of buckets for each window of each anchor."""
    groups = index.groupBy("lot", "dim").agg(F.max("high").alias("_high")).select(F.col("lot").alias("grp"), F.col("dim").alias("_dim"), "_high")
    chunks = asked.groupBy("lot", "dim").agg(F.max("high").alias("_high"), F.min("least").alias("_least")).select(F.col("lot").alias("chunk"), F.col("dim").alias("_dim"), "_high", "_least")
    near = (F.col("dim") == F.col("_dim")) & (F.col("high") * F.col("_high") * SLACK >= F.coalesce("_least", F.lit(float("-inf"))))
    pairs = groups.select("grp").distinct().count() * chunks.select("chunk").distinct().count()
    tasks = max(1, min(pairs, MOST_TASKS))
    one = index.join(_listed(chunks), near).withColumnRenamed("lot", "grp").drop("_dim", "_high", "_least")
    near = (F.col("dim") == F.col("_dim")) & (F.col("high") * F.col("_high") * SLACK >= F.col("least"))
    two = asked.join(_listed(groups), near).withColumnRenamed("lot", "chunk").drop("_dim", "_high")
    both = one.repartition(tasks, "grp", "chunk").groupBy("grp", "chunk").cogroup(two.repartition(tasks, "grp", "chunk").groupBy("grp", "chunk"))
    found = both.applyInPandas(_searched(same, k, share), FOUND)
    best = Window.partitionBy("anchor_id", "nth").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank.

    rows, anchors: vec_id, label, v. For each of the first ``positives`` rows of
    an anchor's label the first ``negatives`` rows of other labels with
    share[0] / share[1] of its score at least, and its score at most.
    """
    least = anchors.groupBy("vec_id").agg(F.min(F.struct("v", "label")).alias("_a")).select("vec_id", "_a.label", "_a.v")
    index = _blocks(rows, "negatives-index", GROUP_BYTES)
    first = _met(index, _blocks(least, "negatives-anchors", CHUNK_BYTES), True, positives, None)
    score = F.when(F.abs(F.col("score")) < NO_LONG, F.col("score")).otherwise(F.raise_error(F.lit("a positive's score is no long")).cast("long"))
    first = first.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", score.alias("score")))).alias("_p"))
    asked = least.join(first.select(F.col("anchor_id").alias("vec_id"), F.col("_p.vec_id").alias("won"), F.col("_p.score").alias("scores")), "vec_id")
    asked = materialize(asked, "negatives-positives")  # it is read to be counted, to be cut in ranges, and to be packed
    found = _met(index, _blocks(asked, "negatives-windows", CHUNK_BYTES, share), False, negatives, share)
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"), F.col("nth").alias("positive_rank"))


def mined(table: DataFrame, every: int = 100) -> DataFrame:
    """Hard negatives of the rows whose vec_id is divisible by ``every``; where it is divisible by 7, the next label counts."""
    label = F.col("label").cast("long")
    rows = taking_part(table, F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives(rows, rows.filter(F.col("vec_id") % every == 0))


SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, LIST_TRANSFORM(embedding, lambda x: FLOOR(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND LEN(LIST_FILTER(embedding, lambda x: x IS NULL OR NOT ISFINITE(x))) = 0),
a AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY v, label) AS nth FROM r WHERE vec_id % 100 = 0) t WHERE nth = 1),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, LIST_DOT_PRODUCT(a.v, r.v)::BIGINT AS score FROM a JOIN r ON a.vec_id <> r.vec_id AND LEN(a.v) = LEN(r.v)),
p AS (SELECT * FROM (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, ROW_NUMBER() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS positive_rank FROM s WHERE same) t WHERE positive_rank <= 5),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, ROW_NUMBER() OVER (PARTITION BY p.anchor_id, positive_rank ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id WHERE NOT same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score, positive_rank::INTEGER AS positive_rank FROM n WHERE rank <= 5
"""
