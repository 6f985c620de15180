"""Vectors: similarity, search, scenes, centroids, calibration, alignment, face clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.operators.filters import alive
from shutterlake.operators.limits import MOST_LISTED
from shutterlake.operators.windows import adaptive_top

THRESHOLD, SLACK = 0.38, 0.15


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalised(v: Column, least: float = 1e-9) -> Column:
    n = norm(v)
    return F.transform(v, lambda x: x.cast("double") / F.greatest(n, F.lit(least)))


def rounded(x: Column) -> Column:
    return F.floor(x * 1000000 + 0.5) / 1000000.0


def one_vector(df: DataFrame, where: Column, name: str = "q") -> DataFrame:
    return F.broadcast(df.filter(where).orderBy("media_id").select(F.col("embedding").alias(name)).limit(1))


def scored(embeddings: DataFrame, media: DataFrame, query: DataFrame) -> DataFrame:
    """id, score of media that are not trashed, hidden or ignored; vectors of another length are skipped."""
    rows = embeddings.join(media.filter(alive()).select(F.col("id").alias("media_id")), "media_id").crossJoin(query)
    return rows.filter(F.size("embedding") == F.size("q")).select(F.col("media_id").alias("id"), rounded(dot(F.col("embedding"), F.col("q"))).alias("score"))


def semantic_search(embeddings: DataFrame, media: DataFrame, query: DataFrame) -> DataFrame:
    return adaptive_top(scored(embeddings, media, query))


def best_documents(chunks: DataFrame, query: DataFrame, n: int = 10) -> DataFrame:
    """Files by their best chunk (file_path, embedding)."""
    rows = chunks.crossJoin(query).select("file_path", rounded(dot(F.col("embedding"), F.col("q"))).alias("score"))
    return rows.groupBy("file_path").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "file_path").limit(n)


def scenes(embeddings: DataFrame, prompts: DataFrame, cut: float = 1.25, least: int = 3) -> DataFrame:
    """media_id, scene, z: the scene in which an image stands out most, if by more than ``cut`` deviations.

    prompts (scene, q) is a short list made by hand; a longer one is refused.
    They stand in one row beside each image, so images are not shuffled. A row
    of embeddings is an image. First scene wins ties; scenes of fewer than
    ``least`` images are dropped.
    """
    listed = prompts.agg(F.sort_array(F.collect_list(F.struct("scene", "q"))).alias("p"))
    listed = listed.select(F.when(F.size("p") <= MOST_LISTED, F.col("p")).otherwise(F.raise_error(F.lit(f"more than {MOST_LISTED} scenes"))).alias("p"))
    rows = embeddings.join(F.broadcast(listed)).select("media_id", F.transform("p", lambda p: F.struct(p["scene"].alias("scene"), dot(F.col("embedding"), p["q"]).alias("score"))).alias("scores"))
    each = rows.select(F.explode("scores").alias("s")).groupBy("s.scene").agg(F.avg("s.score").alias("mean"), F.greatest(F.stddev_pop("s.score"), F.lit(1e-6)).alias("sd"))
    stats = each.agg(F.sort_array(F.collect_list(F.struct("scene", "mean", "sd"))).alias("m"))  # a row, an entry for each scene

    def standing(s: Column, m: Column) -> Column:
        return F.struct(rounded((s["score"] - m["mean"]) / m["sd"]).alias("z"), (-s["scene"]).alias("neg"))

    best = rows.join(F.broadcast(stats)).select("media_id", F.array_max(F.zip_with("scores", "m", standing)).alias("s"))
    best = best.select("media_id", (-F.col("s.neg")).alias("scene"), F.col("s.z").alias("z")).filter(F.col("z") > cut)
    big = best.groupBy("scene").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return best.join(F.broadcast(big), "scene")


def centroids(faces: DataFrame, by: str = "person_id") -> DataFrame:
    """Unit sum of each group's vectors as an array; groups with a sum near 0 have none.

    One sum for each place of the longest vector, so that a task sends a row a group.
    """
    own = faces.filter(F.col(by).isNotNull())
    dim = own.agg(F.max(F.size("embedding"))).first()[0] or 0
    sums = own.groupBy(by).agg(F.array(*[F.sum(F.get("embedding", F.lit(i)).cast("double")) for i in range(max(dim, 1))]).alias("v"))
    whole = sums.select(by, F.filter("v", lambda x: x.isNotNull()).alias("v"))
    return whole.filter(norm(F.col("v")) >= 1e-6).select(by, normalised(F.col("v")).alias("centroid"))


def suggested_faces(faces: DataFrame, persons: DataFrame, person: int, threshold: float = THRESHOLD, n: int = 48) -> DataFrame:
    """Faces that may be a person's: near its centroid, not excluded from it, not in another named person."""
    mine = F.broadcast(centroids(faces.filter(F.col("person_id") == person)).select("centroid"))  # one row
    named = persons.filter("name is not null").select(F.col("id").alias("person_id"), F.lit(1).alias("_named"))
    rows = faces.join(named, "person_id", "left").filter(F.col("_named").isNull() & (F.coalesce("person_id", F.lit(-1)) != person) & (F.col("excluded_person") != person))
    rows = rows.crossJoin(mine).select("id", rounded(dot(F.col("embedding"), F.col("centroid"))).alias("score"))
    return rows.filter(F.col("score") >= threshold - SLACK).orderBy(F.desc("score"), "id").limit(n)


def calibrated_threshold(answers: DataFrame, current: float) -> DataFrame:
    """The cut between sorted answers (similarity, answer) with fewest errors, blended with the current one.

    Errors at a cut are yes below it and no at or above it, from running sums
    over distinct similarities. Ties go to the cut nearest the current one.
    """
    by = answers.groupBy("similarity").agg(F.sum("answer").alias("yes"), F.sum(1 - F.col("answer")).alias("no"))
    order = Window.orderBy("similarity")  # a row for each of at most 800 kept answers
    below = order.rowsBetween(Window.unboundedPreceding, 0)
    by = by.withColumns({"cut": (F.col("similarity") + F.lead("similarity").over(order)) / 2, "yes_below": F.sum("yes").over(below), "no_below": F.sum("no").over(below), "all_no": F.sum("no").over(Window.partitionBy(F.lit(1))), "n": F.sum(F.col("yes") + F.col("no")).over(Window.partitionBy(F.lit(1)))})
    error = F.col("yes_below") + F.col("all_no") - F.col("no_below")
    best = by.filter("cut is not null").select("n", F.struct(error.alias("error"), rounded(F.abs(F.col("cut") - current)).alias("far"), F.col("cut")).alias("b"))
    best = best.agg(F.max("n").alias("n"), F.min("b").alias("b"))
    w = F.least(F.lit(0.8), F.col("n") / 60.0)
    blended = F.least(F.lit(0.6), F.greatest(F.lit(0.25), F.lit(current) * (1 - w) + F.col("b.cut") * w))
    return best.select(F.col("b.cut").alias("cut"), F.col("b.error").alias("errors"), F.when(F.abs(blended - current) >= 0.005, blended).otherwise(F.lit(current)).alias("threshold"))


def similarity_transform(points: DataFrame, by: str) -> DataFrame:
    """Least-squares scale, turn and shift from (x, y) to (u, v) for each group, from sums alone."""
    n = F.count(F.lit(1))
    mx, my, mu, mv = (F.avg(c) for c in ("x", "y", "u", "v"))
    s = points.groupBy(by).agg(
        mx.alias("mx"), my.alias("my"), mu.alias("mu"), mv.alias("mv"), n.alias("n"),
        (F.sum(F.col("x") * F.col("u") + F.col("y") * F.col("v")) - n * (mx * mu + my * mv)).alias("dot"),
        (F.sum(F.col("x") * F.col("v") - F.col("y") * F.col("u")) - n * (mx * mv - my * mu)).alias("cross"),
        (F.sum(F.col("x") * F.col("x") + F.col("y") * F.col("y")) - n * (mx * mx + my * my)).alias("var"),
    )
    a, b = F.col("dot") / F.col("var"), F.col("cross") / F.col("var")
    return s.select(by, a.alias("a"), b.alias("b"), (F.col("mu") - a * F.col("mx") + b * F.col("my")).alias("tx"), (F.col("mv") - b * F.col("mx") - a * F.col("my")).alias("ty"))


def kept_boxes(boxes: DataFrame, by: str, iou: float = 0.3) -> DataFrame:
    """Greedy non-maximum suppression of (x, y, w, h, score) in each image; an image's boxes are few."""

    def keep(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("score", ascending=False, kind="stable").reset_index(drop=True)
        chosen: list[int] = []
        x, y, w, h = (frame[c].to_numpy() for c in "xywh")
        for i in range(len(frame)):
            k = np.array(chosen, int)
            wide = np.minimum(x[i] + w[i], x[k] + w[k]) - np.maximum(x[i], x[k])
            high = np.minimum(y[i] + h[i], y[k] + h[k]) - np.maximum(y[i], y[k])
            both = np.clip(wide, 0, None) * np.clip(high, 0, None)
            if not len(k) or (both <= iou * (w[i] * h[i] + w[k] * h[k] - both)).all():
                chosen.append(i)
        return frame.iloc[chosen]

    return boxes.groupBy(by).applyInPandas(keep, boxes.schema)


def cluster_block(vectors: np.ndarray, fixed: np.ndarray, excluded: np.ndarray, order: np.ndarray, threshold: float) -> np.ndarray:
    """Labels of one block of unit vectors.

    Confirmed faces (fixed person or -1) seed a cluster each; the others join
    the nearest centroid over the threshold, the last of equals, unless they are
    excluded from its person; then the closest pair of clusters merges while it
    is over the threshold, never two confirmed ones and never against an exclusion.
    """
    n, dim = vectors.shape
    label = np.full(n, -1)
    seeds = np.unique(fixed[fixed >= 0])
    k = len(seeds)
    sums, units = np.zeros((max(2 * k, 64), dim)), np.zeros((max(2 * k, 64), dim))
    barred: list[set[int]] = [set() for _ in range(k)]

    def unit(v: np.ndarray) -> np.ndarray:
        return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)

    for c, p in enumerate(seeds.tolist()):
        label[fixed == p] = c
        sums[c] = vectors[fixed == p].sum(axis=0)
        units[c] = unit(sums[c])

    for i in order:
        if label[i] >= 0:
            continue
        best = -1
        if k:
            near = units[:k] @ vectors[i]
            if excluded[i] >= 0:
                near[: len(seeds)][seeds == excluded[i]] = -np.inf
            best = k - 1 - int(near[::-1].argmax())
            if near[best] < threshold:
                best = -1
        if best < 0:
            if k == len(sums):
                sums, units = (np.concatenate([x, np.zeros_like(x)]) for x in (sums, units))
            best, k = k, k + 1
            barred.append(set())
        label[i] = best
        sums[best] += vectors[i]
        units[best] = unit(sums[best])
        if excluded[i] >= 0:
            barred[best].add(int(excluded[i]))
    into = merged_clusters(sums[:k], units[:k], np.concatenate([seeds, np.full(k - len(seeds), -1)]), barred, threshold)
    return np.unique(into[label], return_inverse=True)[1]


def merged_clusters(sums: np.ndarray, units: np.ndarray, person: np.ndarray, barred: list[set[int]], threshold: float) -> np.ndarray:
    """The cluster that each cluster ends in, when the closest pair merges while it is over the threshold.

    Each cluster remembers its closest other one, so memory is linear in the
    clusters and a merge compares only the merged one and those it was closest
    to. A score below the threshold is not kept exact: it can only be passed by
    the next merged cluster. The arguments are changed.
    """
    k = len(sums)
    into, gone = np.arange(k), np.zeros(k, bool)
    holder = {int(p): c for c, p in enumerate(person) if p >= 0}
    bars: dict[int, set[int]] = {p: set() for p in holder}
    for c, own in enumerate(barred):
        for p in own & bars.keys():
            bars[p].add(c)
    score, other = np.full(k, -np.inf), np.full(k, -1)

    def rows(of: np.ndarray) -> np.ndarray:
        near = units[of] @ units.T
        near[:, gone] = -np.inf
        near[np.arange(len(of)), of] = -np.inf
        for row, c in zip(near, of.tolist(), strict=True):
            if person[c] >= 0:
                row[person >= 0] = -np.inf
                row[list(bars[int(person[c])])] = -np.inf
            else:
                row[[holder[p] for p in barred[c] & holder.keys()]] = -np.inf
        return near

    def refresh(of: np.ndarray) -> None:
        for part in np.array_split(of, len(of) // 256 + 1):
            if len(part):
                near = rows(part)
                other[part] = near.argmax(axis=1)
                score[part] = near[np.arange(len(part)), other[part]]

    refresh(np.arange(k))
    while k > 1 and score.max() >= threshold:
        a = int(score.argmax())
        a, b = sorted((a, int(other[a])))
        sums[a] += sums[b]
        units[a] = sums[a] / max(np.linalg.norm(sums[a]), 1e-12)
        person[a] = max(person[a], person[b])
        if person[a] >= 0:
            holder[int(person[a])] = a
        for p in barred[b] & bars.keys():
            bars[p].discard(b)
            bars[p].add(a)
        barred[a] |= barred[b]
        gone[b], person[b], score[b], into[into == b] = True, -1, -np.inf, a
        stale = ~gone & ((other == a) | (other == b))
        stale[a] = False
        again = np.flatnonzero(stale & (score >= threshold))
        score[stale] = -np.inf
        row = rows(np.array([a]))[0]
        other[a] = row.argmax()
        score[a] = row[other[a]]
        closer = (row > score) | ((row == score) & (a < other))
        closer[a] = False
        closer &= ~gone
        score[closer], other[closer] = row[closer], a
        refresh(again)
    return into


def face_clusters(faces: DataFrame, threshold: float = 0.363, by: str | None = None) -> DataFrame:
    """id, block, cluster. The procedure is sequential, so it runs within blocks of one library (``by``).

    Every face of a block takes part; time is quadratic in the clusters of a
    block, memory linear in its faces.
    """

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id").reset_index(drop=True)
        v = np.array(frame["embedding"].to_list(), np.float64)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        sure = (frame["confirmed"] == 1) & frame["person_id"].notna()
        fixed = np.where(sure, frame["person_id"].fillna(-1), -1).astype(int)
        order = np.lexsort((frame["id"], -frame["score"], -frame["confirmed"]))
        label = cluster_block(v, fixed, frame["excluded_person"].to_numpy(int), order, threshold)
        return pd.DataFrame({"id": frame["id"], "block": frame["block"], "cluster": label})

    rows = faces.select("id", (F.col(by) if by else F.lit(0)).cast("long").alias("block"), "embedding", "person_id", "confirmed", "excluded_person", "score")
    return rows.groupBy("block").applyInPandas(work, "id long, block long, cluster long")


def cluster_stats(clusters: DataFrame) -> DataFrame:
    """One row for a clustering: groups of two faces or more, faces in them, and all faces."""
    by = clusters.groupBy("block", "cluster").agg(F.count(F.lit(1)).alias("n"))
    several = F.col("n") >= 2
    return by.agg(F.count_if(several).alias("groups"), F.coalesce(F.sum(F.when(several, F.col("n"))), F.lit(0)).alias("grouped"), F.coalesce(F.sum("n"), F.lit(0)).alias("faces"))


def review_cards(faces: DataFrame, media: DataFrame, people: DataFrame, limit: int, threshold: float = THRESHOLD, most: int = 6) -> DataFrame:
    """person, id, score, mine, slot: unconfirmed faces of alive media to ask about, for the ``most`` largest people (id, faces).

    Of each person's own faces the least typical come first, of the others not
    excluded from it those nearest the threshold; the two kinds alternate, and
    the longer list follows. Only as many of a kind as are shown are ranked.
    """
    largest = people.orderBy(F.desc("faces"), "id").limit(most).select(F.col("id").alias("person"), F.col("faces").alias("size"))
    shown = largest.agg(F.greatest(F.lit(4), F.floor(F.lit(limit) / F.greatest(F.count(F.lit(1)), F.lit(1)))).alias("per"))
    centre = centroids(faces.join(F.broadcast(largest.select(F.col("person").alias("person_id"))), "person_id", "left_semi"))
    targets = largest.join(centre, F.col("person") == F.col("person_id")).select("person", "size", "centroid").join(F.broadcast(shown))
    open_ = faces.filter("confirmed = 0").join(media.filter(alive()).select(F.col("id").alias("media_id")), "media_id", "left_semi").select("id", "person_id", "excluded_person", "embedding")
    rows = open_.join(F.broadcast(targets), (F.coalesce("person_id", F.lit(-1)) == F.col("person")) | (F.col("excluded_person") != F.col("person")))  # at most ``most`` targets
    score, mine = rounded(dot(F.col("embedding"), F.col("centroid"))), F.coalesce(F.col("person_id") == F.col("person"), F.lit(False))
    rows = rows.select("id", "person", "size", "per", score.alias("score"), mine.alias("mine")).filter(F.col("mine") | (F.col("score") >= threshold - SLACK))
    order = F.when(F.col("mine"), F.col("score")).otherwise(F.abs(F.col("score") - threshold))
    nth = F.row_number().over(Window.partitionBy("person", "mine").orderBy(order, "id"))
    rows = rows.withColumn("nth", nth).filter(F.col("nth") <= max(4, limit)).withColumn("p", F.col("nth") - 1).filter(F.col("p") < F.col("per"))
    kinds = Window.partitionBy("person")  # a few cards a person
    shorter = F.least(F.sum(F.col("mine").cast("long")).over(kinds), F.sum((~F.col("mine")).cast("long")).over(kinds))
    slot = F.when(F.col("p") < F.col("c"), F.col("p") * 2 + F.when(F.col("mine"), 0).otherwise(1)).otherwise(F.col("c") + F.col("p"))
    cards = rows.withColumn("c", shorter).withColumn("slot", slot).filter(F.col("slot") < F.col("per"))
    return cards.orderBy("slot", F.desc("size"), "person").limit(limit).select("person", "id", "score", "mine", "slot")


def claimed_labels(clusters: DataFrame, faces: DataFrame) -> DataFrame:
    """cluster, person_id: the person most of a cluster's faces had before; a person is claimed once, least ids win ties."""
    votes = clusters.join(faces.filter("person_id is not null").select("id", "person_id"), "id").groupBy("cluster", "person_id").agg(F.count(F.lit(1)).alias("n"))

    def claim(frames: pd.DataFrame) -> pd.DataFrame:
        taken: dict[int, int] = {}
        for cluster, own in frames.sort_values(["cluster", "n", "person_id"], ascending=[True, False, True]).groupby("cluster"):
            free = [p for p in own["person_id"] if p not in taken]
            if free:
                taken[free[0]] = cluster
        return pd.DataFrame({"cluster": list(taken.values()), "person_id": list(taken)})

    # a row for each cluster and person of one library
    return votes.withColumn("library", F.lit(0)).groupBy("library").applyInPandas(claim, "cluster long, person_id long")


