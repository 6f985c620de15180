"""Toxicity by a linear-chain conditional random field over words.

Labels are given for documents only, so words are labelled first. A feature (a
word, its first four or six bytes, its last three) is a mark if it makes up a far
larger share of toxic than of other training texts, in several contexts; the words
of toxic documents with a marked feature are tagged, and a two-state CRF learns the tags
from a bounded sample of lines. The tags are guesses: the CRF tags the toxic
documents anew by its marginals, at least one word in each where it sees any,
and learns once more from these, so that words the marks missed come in and
wrong ones go. Forward-backward marginals then give each word's chance to be
toxic; their sum, their sum for a hundred words and their maximum over the whole
document pass through a logistic curve fitted on the sample's document labels.
Words whose marginal is over 0.5 are the offsets.

Labels come from rows with crc32(doc_id as text) mod 5 > 0 alone. Nothing but
the text enters a score.

Defined cases: null text is empty; an empty text gets the score of a document
without toxic words; a null doc_id counts as held out; labels that repeat a
doc_id count once, toxic if any is; without training rows of both kinds every
score is the share of toxic labels, or 0; an empty table gives an empty result;
repeated rows give repeated results; texts that are equal count once in
training, toxic if any is labelled so; other columns are ignored. The same rows
give the same model however they are dealt to tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, plain_id, scratch_tables, text_or_empty
from .crf import Chain, forward_backward, overlapped, train
from .textkit import Words, batches, encoded

#: The classifier's sample: labelled documents of each kind, and of each the lines with the strongest marks.
SAMPLE_DOCS, SAMPLE_LINES = 2000, 2
#: A feature is a mark if so many different words stand before it in toxic documents, and these make
#: up so many times as large a share there as in others. (Near copies repeat a word after the same word.)
LEAST_CONTEXTS, LEAST_RATIO = 4, 8.0
#: Rounds of learning from the marks, and from the tags given anew; the least marginal that is tagged for want of a higher one.
ROUNDS, MORE_ROUNDS, LEAST_CHANCE = 40, 15, 0.02
#: Words of a piece of a chain, and words more on each side that its marginals are computed with.
PIECE, SIDE = 256, 64
FEATURES, PARTS = 1 << 16, 4
SMOOTH = 10

_TABLE = np.zeros(256, bool)
_TABLE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _words(texts: list[bytes]) -> Words:
    return Words([t.lower() for t in texts], _TABLE)


def _features(w: Words) -> np.ndarray:
    """Each word itself, its first four and six and its last three bytes, as feature numbers."""
    heads = [w.part_hash(w.start, np.minimum(w.start + n, w.end)) for n in (4, 6)]
    parts = (w.hash, *heads, w.part_hash(np.maximum(w.end - 3, w.start), w.end))
    salted = [(h ^ np.uint64(k * 0x5851F42D4C957F2D % 2**64)) % np.uint64(FEATURES) for k, h in enumerate(parts, 1)]
    return np.stack(salted, axis=1).astype(np.int32)


def _chances(chain: Chain, features: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The marginal of the toxic state at each word."""
    entry, place, held, core = overlapped(first, size, PIECE, SIDE)
    chance = np.zeros(len(features))
    found = forward_backward(chain, chain.scores(features[entry]), place, held)[0][:, 1]
    chance[entry[core]] = found[core]
    return chance


@dataclass
class Model:
    chain: Chain | None
    curve: tuple[float, ...]

    def score(self, seen: pd.DataFrame) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_document_features(seen) @ np.array(self.curve), -30, 30)))


def _document_features(seen: pd.DataFrame) -> np.ndarray:
    """From the evidence total, most, words of each document; SMOOTH words more keep short ones from extremes."""
    total, most, words = (seen[c].to_numpy(np.float64) for c in ("total", "most", "words"))
    return np.stack([np.ones(len(seen)), np.log1p(total), most, np.log1p(100 * total / (words + SMOOTH))], axis=1)


def _evidence(chain: Chain | None, texts: list[bytes]) -> pd.DataFrame:
    """For each text the expected number of toxic words, the largest marginal, its words, and start:end of words over 0.5."""
    w = _words(texts)
    total, most, spans = np.zeros(len(texts)), np.zeros(len(texts)), [""] * len(texts)
    if chain is not None and len(w.start):
        chance = _chances(chain, _features(w), *w.lines())
        total = np.bincount(w.doc, chance, len(texts))
        np.maximum.at(most, w.doc, chance)
        if len(hit := np.flatnonzero(chance > 0.5)):
            before = w.code_points()
            for i in np.unique(w.doc[hit]):
                own = hit[w.doc[hit] == i]
                zero = before[w.base[i]]
                spans[i] = ",".join(f"{a}:{b}" for a, b in zip(before[w.start[own]] - zero, before[w.end[own]] - zero, strict=True))
    return pd.DataFrame({"total": total, "most": most, "words": w.count, "spans": spans})


def _evidence_frames(chain: Chain) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, own = encoded(frame["text"]), frame.drop(columns="text")
            for a, b in batches(texts):
                seen = _evidence(chain, texts[a:b])
                yield own.iloc[a:b].assign(**{c: seen[c].to_numpy() for c in seen})

    return work


def _mark_frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each feature, as a number, with a number of the word before it, once for some documents of a kind."""
    for frame in frames:
        for toxic, own in frame.groupby("toxic"):
            w = _words(encoded(own["text"]))
            if len(w.start):
                before = np.append(np.uint64(0), w.hash[:-1]) % np.uint64(1 << 31)
                before[w.first[w.count > 0]] = 0
                pairs = np.unique(_features(w).astype(np.uint64) << np.uint64(32) | before[:, None])
                yield pd.DataFrame({"feature": (pairs >> np.uint64(32)).astype(np.int32), "before": (pairs & np.uint64(0xFFFFFFFF)).astype(np.int32), "toxic": np.int32(toxic)})


def _line_frames(marks: np.ndarray) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Training lines: of each document those with the strongest marks first, then by place."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, text, toxic in zip(frame["key"], encoded(frame["text"]), frame["toxic"], strict=True):
                w = _words([text])
                first, size = w.lines()
                if not len(first):
                    continue
                features = _features(w)
                weight = marks[features].max(axis=1)
                chosen = np.argsort(-np.maximum.reduceat(weight, first), kind="stable")[:SAMPLE_LINES]
                tags = ((weight > 0) & bool(toxic)).astype(np.int8)
                rows = [(key, int(a), int(toxic), features[a : a + n].tobytes(), tags[a : a + n].tobytes()) for a, n in zip(first[chosen], size[chosen], strict=True)]
                yield pd.DataFrame(rows, columns=["key", "at", "toxic", "features", "tags"])

    return work


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from at most SAMPLE_DOCS training documents of each kind, chosen by hash of doc_id."""
    marked = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    marked = marked.filter(~held_out())
    counts = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    plain = Model(None, (float(np.log((share + 1e-6) / (1 - share + 1e-6))) if counts else -30.0, 0.0, 0.0, 0.0))
    if len(counts) < 2:
        return plain
    some = [marked.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS) for k in (0, 1)]
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(F.broadcast(some[0].union(some[1])), "doc_id")
    with scratch_tables(docs.sparkSession):
        # copies of a text teach once
        sample = materialize(sample.groupBy("text").agg(F.max("toxic").alias("toxic")).withColumn("key", F.sha2(F.col("text").cast("binary"), 256)), "toxicity-sample")
        n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
        if len(n) < 2:
            return plain
        pairs = sample.select("text", "toxic").mapInPandas(_mark_frames, "feature int, before int, toxic int")
        pairs = pairs.groupBy("feature", "before").agg(F.max("toxic").alias("with"), F.max(1 - F.col("toxic")).alias("without"))
        marks = pairs.groupBy("feature").agg(F.sum("with").alias("with"), F.sum("without").alias("without"))
        marks = marks.toPandas()  # FEATURES rows at most
        ratio = marks["with"] / max(1, marks["with"].sum()) / ((marks["without"] + 2) / max(1, marks["without"].sum()))
        marks = marks.assign(ratio=ratio)[(marks["with"] >= LEAST_CONTEXTS) & (ratio >= LEAST_RATIO)]
        weight = np.zeros(FEATURES)
        weight[marks["feature"]] = marks["ratio"]
        lines = sample.mapInPandas(_line_frames(weight), "key string, at int, toxic int, features binary, tags binary").toPandas()
        if not len(marks) or not len(lines):
            return plain
        chain = _learnt(lines.sort_values(["key", "at"]))
        seen = sample.select("toxic", "text").mapInPandas(_evidence_frames(chain), "toxic int, total double, most double, words long, spans string").drop("spans").toPandas()
    seen = seen.sort_values(["toxic", "total", "most", "words"])
    fair = np.where(seen["toxic"] > 0, share / n[1], (1 - share) / n[0])
    return Model(chain, _curve(_document_features(seen), seen["toxic"].to_numpy(), fair))


def _learnt(lines: pd.DataFrame) -> Chain:
    tags = np.frombuffer(b"".join(lines["tags"]), np.int8).astype(np.int64)
    features = np.frombuffer(b"".join(lines["features"]), np.int32).reshape(-1, PARTS)
    size = lines["tags"].map(len).to_numpy()
    _, place, held, _ = overlapped(np.cumsum(size) - size, size, PIECE, 0)
    chain = train(features, tags, place, held, FEATURES, 2, ROUNDS)
    chance = _chances(chain, features, place, held)
    doc = np.repeat(np.unique(lines["key"], return_inverse=True)[1], size)
    toxic = np.repeat(lines["toxic"].to_numpy() > 0, size)
    most = np.zeros(doc.max() + 1)
    np.maximum.at(most, doc, chance)
    tags = (toxic & ((chance > 0.5) | ((chance == most[doc]) & (chance > LEAST_CHANCE)))).astype(np.int64)
    return train(features, tags, place, held, FEATURES, 2, MORE_ROUNDS, start=chain)


def _curve(at: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton steps with a small ridge."""
    w = np.zeros(at.shape[1])
    weight = weight * len(at) / weight.sum()
    ridge = 1e-2 * np.eye(len(w))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(at @ w, -30, 30)))
        w += np.linalg.solve((at * (weight * p * (1 - p))[:, None]).T @ at + ridge, at.T @ (weight * (label - p)) - ridge @ w)
    return tuple(map(float, w))


def _score_frames(model: Model) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, own = encoded(frame["text"]), frame.drop(columns="text")
            for a, b in batches(texts):
                seen = _evidence(model.chain, texts[a:b])
                yield own.iloc[a:b].assign(score=model.score(seen), spans=seen["spans"].to_numpy())

    return work


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, spans: one row per row of ``docs``."""
    rows = docs.select(plain_id(), held_out().alias("held_out"), text_or_empty().alias("text"))
    out = rows.mapInPandas(_score_frames(model), "doc_id string, held_out boolean, score double, spans string")
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    work = _score_frames(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        parts = [x["score"] for x in work(iter([texts.to_frame("text")]))]
        return pd.concat(parts, ignore_index=True) if parts else pd.Series([], dtype="float64")

    return docs.filter(score(text_or_empty()) < 0.5)
