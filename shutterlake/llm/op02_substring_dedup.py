"""Substring deduplication: words in passages of WINDOW words that stand elsewhere too are removed.

Suffix automata of reference shards give matching statistics, and maximal
stretches of WINDOW words or more that occur twice are cut. A broadcast of
every shard to every document would cost the square of the corpus, so shards
are routed instead of broadcast: each window of WINDOW words is represented by
its minimizer (the GRAM-word run in it with the least hash, which equal windows
share), only minimizers that occur twice are followed up, and the passages
around a range of minimizers, SHARD_WORDS words in all, are a reference shard.
A task builds the automaton of each shard over its distinct passages, with the
number of places of each as end counts, and streams them through it: a window
whose automaton state ends at two places is repeated.

The passages of a minimizer with more than HOT occurrences would not fit in a
task. Partial aggregation counts them by 128-bit hashes instead: passages that
are equal as a whole first, one row each, and then the windows of one of each.
The words decide there as well: the least and the greatest text under each hash
are carried along and must be the same, else the job ends with an error.

Defined cases: null text has no words; texts shorter than a window keep all
words; rows that repeat doc_id and text are occurrences of their own and give
equal results; a null doc_id is an id like others; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_key, materialize, plain_id, salted_join, text_key, text_or_empty
from .textkit import Words, batches, encoded, grams, mix

WINDOW = 35
#: Words of a minimizer; occurrences beyond which its passages are counted and not gathered.
GRAM, HOT = 10, 1000
#: Words of the distinct passages of a shard, from which it is closed.
SHARD_WORDS = 100_000


class Minimizers:
    """Minimizers of the windows of a batch of texts.

    place: first word of the minimizer; low, high: first and last window start
    that it represents (all as word numbers of the batch); hash: its hash.
    """

    def __init__(self, texts: list[bytes]):
        self.words = w = Words(texts)
        self.word_hash = w.hash
        n = max(0, len(w.start) - WINDOW + 1)  # a batch of fewer words has no window
        valid = w.doc[:n] == w.doc[WINDOW - 1 :] if n else np.zeros(0, bool)
        gram = grams(self.word_hash, GRAM)
        best, reach, need = np.arange(len(gram) if n else 0), 1, WINDOW - GRAM + 1
        while reach < need and n:
            step = min(reach, need - reach)
            left, right = best[: len(best) - step], best[step:]
            best = np.where(gram[left] <= gram[right], left, right)  # the leftmost of equals
            reach += step
        at = np.flatnonzero(valid)
        best = best[at]
        new = np.flatnonzero(np.append(True, (best[1:] != best[:-1]) | (at[1:] != at[:-1] + 1))) if len(at) else at
        self.place, self.low = best[new], at[new]
        self.high = at[np.append(new[1:], len(at)) - 1] if len(at) else at
        self.hash = gram[self.place].view(np.int64)
        self.doc = w.doc[self.low]


def _counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        texts = encoded(frame["text"])
        for a, b in batches(texts):
            h, n = np.unique(Minimizers(texts[a:b]).hash, return_counts=True)
            yield pd.DataFrame({"h": h, "n": n})


def _placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        texts, ids, keys = encoded(frame["text"]), frame["id"].to_numpy(), frame["tk"].to_numpy()
        for a, b in batches(texts):
            m = Minimizers(texts[a:b])
            yield pd.DataFrame({"h": m.hash, "id": ids[a:b][m.doc], "tk": keys[a:b][m.doc], "at": (m.place - m.words.first[m.doc]).astype(np.int32)})


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts without a repeated minimizer are finished; the others keep their text."""
    for frame in frames:
        open_ = frame["cold"].notna() | frame["hot"].notna()
        words = [t.split() for t in encoded(frame["text"])]
        out = frame.assign(n_words=[len(w) for w in words], kept_sha256=[None if o else _digest(w) for w, o in zip(words, open_, strict=True)])
        yield out.assign(text=frame["text"].where(open_, None))


def _passages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each cold minimizer: the words of its windows, and where they start."""
    for frame in frames:
        texts = encoded(frame["text"])
        for a, b in batches(texts):
            m = Minimizers(texts[a:b])
            w, own = m.words, frame.iloc[a:b]
            wanted = [i for i, at in enumerate(own["cold"]) if at is not None]
            marked = np.zeros(len(w.start), bool)
            for i in wanted:
                marked[w.first[i] + np.asarray(own["cold"].iloc[i], np.int64)] = True
            hit = np.flatnonzero(marked[m.place])
            doc = m.doc[hit]
            yield pd.DataFrame({"h": m.hash[hit], "id": own["id"].to_numpy()[doc], "tk": own["tk"].to_numpy()[doc], "at": (m.low[hit] - w.first[doc]).astype(np.int32), "said": _said(m, m.low[hit], m.high[hit] + WINDOW - 1)})


def _hot_passages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each hot minimizer: the hash of its windows in order, its place, its first window and their number."""
    step = np.uint64(0x9E3779B97F4A7C55)
    back = np.uint64(pow(int(step), -1, 1 << 64))
    for frame in frames:
        texts = encoded(frame["text"])
        for a, b in batches(texts, 1 << 18):
            m, own = Minimizers(texts[a:b]), frame.iloc[a:b]
            hit = np.flatnonzero(_marked(m, own)[m.place])
            if not len(hit):
                continue
            doc, low, high = m.doc[hit], m.low[hit], m.high[hit]
            out = {"id": own["id"].to_numpy()[doc], "tk": own["tk"].to_numpy()[doc], "place": (m.place[hit] - m.words.first[doc]).astype(np.int32), "at": (low - m.words.first[doc]).astype(np.int32), "n": (high - low + 1).astype(np.int32)}
            out["said"] = _said(m, low, high + WINDOW - 1)
            for name, hashes in zip(("c1", "c2"), _window_hashes(m), strict=True):
                up, down = (np.cumprod(np.append(np.uint64(1), np.full(len(hashes), x))) for x in (step, back))
                sums = np.append(np.uint64(0), np.cumsum(hashes * up[:-1]))
                out[name] = mix((sums[high + 1] - sums[low]) * down[low]).view(np.int64)
            yield pd.DataFrame(out)


def _said(m: Minimizers, first: np.ndarray, last: np.ndarray) -> list[bytes]:
    """The words from number ``first`` to ``last``, joined by one space."""
    start, end, data = m.words.start, m.words.end, m.words.data
    return [b" ".join(data[start[x] : end[y]].split()) for x, y in zip(first, last, strict=True)]


def _marked(m: Minimizers, own: pd.DataFrame) -> np.ndarray:
    marked = np.zeros(len(m.words.start), bool)
    for i, at in enumerate(own["hot"]):
        if at is not None:
            marked[m.words.first[i] + np.asarray(at, np.int64)] = True
    return marked


def _window_hashes(m: Minimizers) -> tuple[np.ndarray, np.ndarray]:
    return grams(m.word_hash, WINDOW), grams(mix(m.word_hash ^ np.uint64(0xA5A5A5A5)), WINDOW)


def _windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each window of a hot minimizer: its hash and where it starts."""
    for frame in frames:
        texts = encoded(frame["text"])
        for a, b in batches(texts, 1 << 18):
            m = Minimizers(texts[a:b])
            w, own = m.words, frame.iloc[a:b]
            hit = np.flatnonzero(_marked(m, own)[m.place])
            if not len(hit):
                continue
            size = m.high[hit] - m.low[hit] + 1
            at = np.repeat(m.low[hit], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            one, two = _window_hashes(m)
            doc = w.doc[at]
            yield pd.DataFrame({"w1": one[at].view(np.int64), "w2": two[at].view(np.int64), "id": own["id"].to_numpy()[doc], "tk": own["tk"].to_numpy()[doc], "at": (at - w.first[doc]).astype(np.int32), "said": _said(m, at, at + WINDOW - 1)})


class SuffixAutomaton:
    """Of word sequences, each said at ``times`` places, with the number of places at which each state's strings end."""

    def __init__(self, sequences: list[list[bytes]], times: list[int]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.len, self.ends = [-1], [0], [0]
        for words, n in zip(sequences, times, strict=True):
            last = 0
            for word in words:
                last = self._extend(last, word, n)
        order = sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True)
        for v in order:
            self.ends[self.link[v]] += self.ends[v]

    def _state(self, size: int, ends: int, follow: dict[bytes, int], link: int) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.len.append(size)
        self.ends.append(ends)
        return len(self.len) - 1

    def _copy(self, p: int, word: bytes, q: int) -> int:
        """A state for the strings of q that p leads to by ``word``."""
        c = self._state(self.len[p] + 1, 0, dict(self.next[q]), self.link[q])
        self.link[q] = c
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, word: bytes, times: int) -> int:
        q = self.next[last].get(word)
        if q is not None:  # known from an earlier sequence
            v = q if self.len[q] == self.len[last] + 1 else self._copy(last, word, q)
            self.ends[v] += times
            return v
        v, p = self._state(self.len[last] + 1, times, {}, 0), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = v
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[v] = q if self.len[q] == self.len[p] + 1 else self._copy(p, word, q)
        return v

    def repeated(self, words: list[bytes], size: int) -> list[int]:
        """Starts of the ``size``-word windows of a sequence of the set that end at two places or more."""
        out, v, matched = [], 0, 0
        for i, word in enumerate(words):
            while word not in self.next[v]:
                v = self.link[v]
                matched = self.len[v]
            v, matched = self.next[v][word], matched + 1
            while self.len[self.link[v]] >= size:
                v = self.link[v]
                matched = self.len[v]
            if matched >= size and self.ends[v] > 1:
                out.append(i - size + 1)
        return out


def _runs(starts: list[int]) -> list[tuple[int, int]]:
    """Word ranges that windows at ``starts`` (ascending) cover."""
    out: list[tuple[int, int]] = []
    for s in starts:
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], s + WINDOW)
        else:
            out.append((s, s + WINDOW))
    return out


Places = dict[bytes, list[tuple[int, int, int]]]


def _shard(places: Places) -> Iterator[tuple[int, int, int, int]]:
    """id, tk, start, end of the repeated stretches of the passages of a shard, given where each stands."""
    words = [said.split(b" ") for said in places]
    automaton = SuffixAutomaton(words, [len(own) for own in places.values()])
    for passage, own in zip(words, places.values(), strict=True):
        runs = _runs(automaton.repeated(passage, WINDOW))
        for i, k, at in own:
            for a, b in runs:
                yield i, k, at + a, at + b


def _matched(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Repeated stretches, shard by shard; rows come sorted by minimizer, and a minimizer is in one shard."""
    columns = ["id", "tk", "start", "end"]
    last, places, held = None, {}, 0
    for frame in frames:
        out = []
        for r in frame.itertuples(index=False):
            if r.h != last and held >= SHARD_WORDS:
                out += _shard(places)
                places, held = {}, 0
            last = r.h
            own = places.get(r.said)
            if own is None:
                own = places[r.said] = []
                held += r.said.count(b" ") + 1
            own.append((r.id, r.tk, r.at))
        yield pd.DataFrame(out, columns=columns)
    yield pd.DataFrame(list(_shard(places)), columns=columns)


def _removed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for r in frame.itertuples(index=False):
            words = r.text.encode("utf-8", "replace").split()
            cut = np.zeros(len(words) + 1, np.int64)
            for s in r.cuts if r.cuts is not None else ():
                cut[s["start"]] += 1
                cut[s["end"]] -= 1
            gone = np.cumsum(cut)[:-1] > 0
            kept = [w for w, g in zip(words, gone, strict=True) if not g]
            rows.append((r.doc_id, len(words), int(gone.sum()), _digest(kept), b" ".join(kept).decode("utf-8")))
        yield pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def _alike(said: str) -> Column:
    """True if one text stands under a hash; an error if two do."""
    clash = F.raise_error(F.lit("two passages share a 128-bit hash"))
    return F.when(F.min(said) == F.max(said), F.lit(True)).otherwise(clash.cast("boolean")).alias("alike")


def without_repeats(docs: DataFrame, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, one row per row of ``docs``; with ``texts`` also what is kept, null where nothing goes."""
    rows = docs.select(plain_id(), id_key().alias("id"), text_key().alias("tk"), text_or_empty().alias("text"))
    counts = rows.select("text").mapInPandas(_counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1")
    counts = materialize(counts, "substring-minimizers")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    placed = rows.select("id", "tk", "text").mapInPandas(_placed, "h long, id long, tk long, at int")
    met = salted_join(placed, counts, ["h"], ["id", "tk", "at"], total, counts=counts.withColumnRenamed("n", "_n"))
    hot = F.col("n") > HOT
    lists = met.groupBy("id", "tk").agg(F.collect_set(F.when(~hot, F.col("at"))).alias("cold"), F.collect_set(F.when(hot, F.col("at"))).alias("hot"))
    lists = lists.select("id", "tk", *[F.when(F.size(c) > 0, F.col(c)).alias(c) for c in ("cold", "hot")])
    schema = "doc_id string, id long, tk long, text string, cold array<int>, hot array<int>, n_words long, kept_sha256 string"
    split = materialize(rows.join(lists, ["id", "tk"], "left").select("doc_id", "id", "tk", "text", "cold", "hot").mapInPandas(_split, schema), "substring-split")
    open_ = split.filter("text is not null")
    passages = open_.filter("cold is not null").select("id", "tk", "text", "cold").mapInPandas(_passages, "h long, id long, tk long, at int, said binary")
    n = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    cuts = passages.repartition(int(n), "h").sortWithinPartitions("h").mapInPandas(_matched, "id long, tk long, start int, end int")
    often_said = open_.filter("hot is not null").select("id", "tk", "text", "hot")
    whole_runs = often_said.mapInPandas(_hot_passages, "c1 long, c2 long, id long, tk long, place int, at int, n int, said binary")
    same = whole_runs.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("id", "tk", "place")).alias("first"), _alike("said"))
    same = materialize(same, "substring-runs")
    n_same = same.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    whole_runs = whole_runs.drop("said")
    equal = salted_join(whole_runs, same.filter("_n > 1").select("c1", "c2"), ["c1", "c2"], ["id", "tk", "at"], n_same, counts=same.select("c1", "c2", "_n"))
    cuts = cuts.unionByName(equal.select("id", "tk", F.col("at").alias("start"), (F.col("at") + F.col("n") + (WINDOW - 1)).alias("end")))
    firsts = same.select("first.*").groupBy("id", "tk").agg(F.collect_set("place").alias("hot"))
    windows = often_said.drop("hot").join(firsts, ["id", "tk"]).select("id", "tk", "text", "hot").mapInPandas(_windows, "w1 long, w2 long, id long, tk long, at int, said binary")
    often = windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("_n"), _alike("said"))
    often = materialize(often.filter("_n > 1 and alike"), "substring-windows")
    windows = windows.drop("said")
    n_often = often.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    again = salted_join(windows, often.select("w1", "w2"), ["w1", "w2"], ["id", "tk", "at"], n_often, counts=often)
    cuts = cuts.unionByName(again.select("id", "tk", F.col("at").alias("start"), (F.col("at") + WINDOW).alias("end")))
    cuts = cuts.groupBy("id", "tk").agg(F.collect_list(F.struct("start", "end")).alias("cuts"))
    done = open_.select("doc_id", "id", "tk", "text").join(cuts, ["id", "tk"], "left").select("doc_id", "text", "cuts")
    done = done.mapInPandas(_removed, "doc_id string, n_words long, n_removed long, kept_sha256 string, kept_text string")
    whole = split.filter("text is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.lit(None).cast("string").alias("kept_text"))
    out = whole.union(done).withColumn("doc_id", F.col("doc_id").cast("long"))
    return out if texts else out.drop("kept_text")


SQL = rf"""
WITH d AS (SELECT ROW_NUMBER() OVER () AS rid, doc_id, REGEXP_EXTRACT_ALL(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT rid, w, UNNEST(RANGE(1, LEN(w) - {WINDOW - 2})) AS i FROM d WHERE LEN(w) >= {WINDOW}),
h AS (SELECT rid, i, MD5(ARRAY_TO_STRING(w[i:i + {WINDOW - 1}], ' ')) AS h FROM p),
c AS (SELECT h FROM h GROUP BY h HAVING COUNT(*) > 1),
g AS (SELECT DISTINCT rid, UNNEST(RANGE(i, i + {WINDOW})) AS i FROM h SEMI JOIN c USING (h)),
x AS (SELECT rid, doc_id, UNNEST(w) AS word, UNNEST(RANGE(1, LEN(w) + 1)) AS i FROM d),
k AS (
  SELECT x.rid, COUNT(g.i) AS n_removed, STRING_AGG(word, ' ' ORDER BY x.i) FILTER (g.i IS NULL) AS kept
  FROM x LEFT JOIN g ON x.rid = g.rid AND x.i = g.i GROUP BY x.rid)
SELECT doc_id, LEN(w)::BIGINT AS n_words, COALESCE(n_removed, 0)::BIGINT AS n_removed, SHA256(COALESCE(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (rid)
"""
