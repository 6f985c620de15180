"""BPE encoding and decoding of whole texts with a public vocabulary.

A word is a doubly linked list of symbols; a priority queue holds the merge
rank of every adjacent pair, and an entry whose symbols have changed since is
stale and is skipped. Words repeat, so each task keeps the ids of recent words.
Decoding concatenates vocabulary strings.

Text is brought to the vocabulary's form first: NFC, white space runs to one
space, lower case, then split into contractions, letter runs, single numerals
and runs of other signs, each mapped byte by byte to printable characters.
Special tokens that stand in a text are cut out before that, as the public
library does.

Defined cases: null text is empty and encodes to no ids; other columns are
ignored; repeated rows give repeated results; an empty table an empty result.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain_id, text_or_empty

#: Words whose ids a task remembers; it forgets all when full.
REMEMBERED = 600_000

#: A task hands on its results when they hold so many ids.
BATCH = 1_000_000

SCHEMA = "doc_id string, ids array<int>, text string"


def byte_signs() -> list[str]:
    """The printable character that stands for each byte: itself, or 256 + n for the n-th of the others."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + others.index(b)) for b in range(256)]


class WordBpe:
    """A vocabulary file of the kind "BPE with word ends"."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        self.ranks = {tuple(m): i for i, m in enumerate(model["merges"])}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.strings = {i: s for s, i in {**self.vocab, **special}.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.words = regex.compile(split["pattern"]["Regex"])
        self.space = regex.compile(r"\s+")
        self.signs = dict(enumerate(byte_signs()))
        self.known: dict[str, list[int]] = {}

    def word(self, word: str) -> list[int]:
        """Ids of one word: merge the pair of lowest rank, leftmost first, until none is left."""
        symbols = [*word.encode("utf-8").decode("latin-1").translate(self.signs)]
        symbols[-1] += self.end
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue: list[tuple[int, int, str, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (rank := self.ranks.get((symbols[i], symbols[j]))) is not None:
                heapq.heappush(queue, (rank, i, symbols[i], symbols[j]))

        for i in range(n - 1):
            offer(i)
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue  # stale: one of the two has been merged since
            symbols[i], symbols[j] = left + right, ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [self.vocab[s] for s in symbols if s in self.vocab and s]

    def _plain(self, text: str, out: list[int]) -> None:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        known = self.known
        for w in self.words.findall(lowered(self.space.sub(" ", text))):
            ids = known.get(w)
            if ids is None:
                ids = self.word(w)
                if len(known) >= REMEMBERED:
                    known.clear()
                if len(w) <= 64:
                    known[w] = ids
            out += ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                self._plain(part, out)
        return out

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.strings.__getitem__, ids))


def lowered(text: str) -> str:
    """Character by character, without the context rule for a final sigma."""
    return text.lower() if "Σ" not in text else "σ".join(x.lower() for x in text.split("Σ"))


@lru_cache(maxsize=2)
def loaded(path: str) -> WordBpe:
    return WordBpe(path)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, text: the ids of each text and what they decode to. ``path``: the vocabulary file, present on every executor."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = loaded(path)
        for frame in frames:
            rows, held = [], 0
            for doc, text in zip(frame["doc_id"], frame["text"], strict=True):
                ids = bpe.encode(text)
                rows.append((doc, np.array(ids, np.int32), bpe.decode(ids)))
                held += len(ids)
                if held >= BATCH:
                    yield pd.DataFrame(rows, columns=["doc_id", "ids", "text"])
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "ids", "text"])

    return docs.select(plain_id(), text_or_empty().alias("text")).mapInPandas(work, SCHEMA).withColumn("doc_id", F.col("doc_id").cast("long"))


def encoded_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, text, n_tokens, ids_sha256, decoded_sha256: all of ``encoded``, and digests derived from it."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded(docs, path).withColumns({"n_tokens": F.size("ids").cast("long"), "ids_sha256": F.sha2(ids.cast("binary"), 256), "decoded_sha256": F.sha2(F.col("text").cast("binary"), 256)})
