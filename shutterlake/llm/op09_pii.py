"""Personal data by fixed patterns and a conditional random field over word shapes.

Patterns give the base spans: e-mail addresses, IPv4 addresses, card numbers
(Luhn) and phone numbers. A linear-chain CRF reads each word as its shape
(letters, digits and signs, runs collapsed or not) and the collapsed shapes
beside it, is trained from a small labelled table, and is decoded by Viterbi in
numpy batches. The table holds the base spans of a bounded sample of documents,
and sentences made here of FORMS that the patterns leave out (local phone
numbers, mail addresses with the sign spelt out, identity and account numbers)
and of DECOYS (dates, prices, versions, ranges) in SENTENCES; every fourth
sentence is held out for ``held_out_figures``. Stretches of words that the CRF
tags and that touch no base span are the spans that the method adds; base spans
always stay.

Defined cases: null text is empty and has no spans; repeated rows give repeated
results; without a document that has a base span the examples alone train the
model; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, plain_id, scratch_tables, text_or_empty
from .crf import Chain, overlapped, train, viterbi
from .textkit import Words, batches, mix

#: Kinds of the base spans, and one that only the method adds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "id")
#: The labelled table: documents at most, words kept on each side of a span, fillings of each form.
SAMPLE_DOCS, CONTEXT, FILLED = 1500, 12, 24
#: Words of a piece of a line, and words more on each side that it is decoded with.
PIECE, SIDE = 256, 64
FEATURES, PARTS = 1 << 14, 6

#: Forms that the patterns leave out; # stands for a digit, ? and ^ for a small and a large letter.
FORMS = (
    ("phone", "(###) ###-####"),
    ("phone", "###-###-####"),
    ("phone", "###.###.####"),
    ("phone", "1-###-###-####"),
    ("phone", "0###/#######"),
    ("phone", "(0##) ####-####"),
    ("email", "?????[at]??????.com"),
    ("email", "???.?????(at)?????.org"),
    ("email", "??????[at]????[dot]net"),
    ("id", "###-##-####"),
    ("id", "^^## #### #### #### #### ##"),
    ("id", "^#######"),
)
DECOYS = ("20##", "19##-20##", "20##-##-##", "##.##.20##", "##/##/20##", "##:##", "#.#.##", "#,###.##", "$##.##", "##%", "##-##", "#.##", "######", "### (##)", "[##]", "??(?)", "^^-##", "1.2.#", "## ##", "#####, ??")
SENTENCES = (
    "call {} today",
    "my number is {}, thanks",
    "you may reach us at {} or later",
    "write to {} soon.",
    "{}",
    "contact: {}",
    "it was {} and then more of them",
    "the file says {} on the first page",
    "please note {} as given",
    "Ask for {} in the hall, he said",
    "see {} for the rest",
    "they kept {} until the end of it",
)

_LOCAL_END = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can start only where a run of digits starts, so the others are not tried.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HAS_DIGIT = re.compile(r"[0-9]")
_SIGNS = {"#": "0123456789", "?": "abcdefghijklmnopqrstuvwxyz", "^": "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_END:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every base match, in order."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _HAS_DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


#: The class of each byte: one letter or digit stands for all of its kind.
_CLASS = np.arange(256, dtype=np.uint8)
for _low, _high, _sign in ((65, 90, 65), (97, 122, 97), (48, 57, 57), (128, 255, 128)):
    _CLASS[_low : _high + 1] = _sign


def _features(w: Words) -> np.ndarray:
    """Shape, collapsed shape, first and last two signs of the shape, capped length and digits, collapsed shapes before and after in the line, as feature numbers."""
    shape = Words.__new__(Words)
    shape.bytes, shape._sums = _CLASS[w.bytes], None
    size = w.end - w.start
    whole = shape.part_hash(w.start, w.end)
    # runs of one class count once: positions of the kept bytes, and a hash over those alone
    kept = np.ones(len(w.bytes), bool)
    kept[1:] = shape.bytes[1:] != shape.bytes[:-1]
    kept[w.start] = True
    place = np.append(0, np.cumsum(kept))
    short = Words.__new__(Words)
    short.bytes, short._sums = shape.bytes[kept], None
    collapsed = short.part_hash(place[w.start], place[w.end])
    ends = mix(shape.part_hash(w.start, np.minimum(w.start + 2, w.end)) + shape.part_hash(np.maximum(w.end - 2, w.start), w.end) * np.uint64(3))
    digit = np.append(0, np.cumsum(shape.bytes == 57))
    counts = np.minimum(size, 24).astype(np.uint64) * np.uint64(32) + np.minimum(digit[w.end] - digit[w.start], 20).astype(np.uint64)
    parts = (whole, collapsed, ends, mix(counts + np.uint64(7)))
    first, _ = w.lines()
    before, after = np.append(np.uint64(0), collapsed[:-1]), np.append(collapsed[1:], np.uint64(0))
    before[first], after[np.append(first[1:], len(size)) - 1] = 0, 0
    parts = (*parts, before, after)
    salted = [mix(h ^ np.uint64(k)) % np.uint64(FEATURES) for k, h in enumerate(parts, 1)]
    return np.stack(salted, axis=1).astype(np.int32)


def _tagged_words(text: str, spans: list[tuple[int, int, int]]) -> tuple[Words, np.ndarray]:
    """The words of one text and the tag of each: 0, or 1 + kind where a span covers most of the word."""
    w = Words([text.encode("utf-8", "replace")])
    before = w.code_points()
    start, end = before[w.start], before[w.end]
    tags = np.zeros(len(start), np.int64)
    for a, kind, b in spans:
        lo, hi = np.searchsorted(end, a, "right"), np.searchsorted(start, b)
        for i in range(lo, hi):
            if 2 * (min(b, end[i]) - max(a, start[i])) > end[i] - start[i]:
                tags[i] = 1 + kind
    return w, tags


def _stretches(w: Words, tags: np.ndarray) -> list[tuple[list[int], list[int]]]:
    """Features and tags of the stretches around spans, or of the first words of a text without one."""
    near = np.zeros(len(tags) + 1, np.int64)
    hit = np.flatnonzero(tags)
    if not len(hit):
        hit = np.arange(min(1, len(tags)))
    for i in hit:
        near[max(0, i - CONTEXT)] += 1
        near[min(len(tags), i + CONTEXT + 1)] -= 1
    on = np.append(np.cumsum(near[:-1]) > 0, False)
    edge = np.flatnonzero(np.diff(np.append(False, on).astype(np.int8)))
    features = _features(w) if len(tags) else np.zeros((0, PARTS), np.int32)
    return [(features[a:b].ravel().tolist(), tags[a:b].tolist()) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _label_frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = [r for t in frame["text"] for r in _stretches(*_tagged_words(t, base_spans(t)))]
        yield pd.DataFrame(rows, columns=["features", "tags"])


def labelled(held_out: bool) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """(text, spans) of the sentences of the table, or of those held out; the same ones on every call."""
    deal = random.Random(f"table {held_out}")
    said = [t for i, t in enumerate(SENTENCES) if (i % 4 == 3) == held_out]

    def filled(form: str) -> str:
        return "".join(deal.choice(_SIGNS[c]) if c in _SIGNS else c for c in form)

    out = []
    for kind, form in (*FORMS, *[(None, d) for d in DECOYS]):
        for n in range(FILLED):
            part, text = filled(form), said[n % len(said)]
            a = text.index("{}")
            out.append((text.replace("{}", part), [(a, KINDS.index(kind), a + len(part))] if kind else []))
    return out


def held_out_figures(chain: Chain) -> tuple[float, float]:
    """Precision and recall of the added spans on the held-out sentences; a span counts if its kind and most of its words are right."""
    right = found = wanted = 0
    for text, spans in labelled(True):
        raw = [text.encode("utf-8")]
        got = {s for s in _added(chain, raw, [[]])[0]}
        found, wanted = found + len(got), wanted + len(spans)
        for a, kind, b in spans:
            right += any(k == kind and 2 * (min(b, y) - max(a, x)) > b - a and y <= b + 1 and x >= a - 1 for x, k, y in got)
    return right / max(1, found), right / max(1, wanted)


def fit(docs: DataFrame) -> Chain:
    """Train from the labelled table: SAMPLE_DOCS documents by hash of doc_id, half of them with base spans if there are as many."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    likely = F.col("text").rlike(r"@|[0-9][0-9.\x20()-]{6,}[0-9]")
    # ids first: what is ordered and held is two numbers a row
    ids = text.select("doc_id", F.xxhash64("text").alias("tk"), likely.alias("likely"))
    some = [ids.filter(F.col("likely") == k).orderBy(F.xxhash64("doc_id", F.lit("pii")), "doc_id", "tk").limit(SAMPLE_DOCS // 2) for k in (True, False)]
    with scratch_tables(docs.sparkSession):
        sample = materialize(text.withColumn("tk", F.xxhash64("text")).join(F.broadcast(some[0].union(some[1]).select("doc_id", "tk").distinct()), ["doc_id", "tk"]), "pii-sample")
        table = sample.select("text").mapInPandas(_label_frames, "features array<int>, tags array<int>").toPandas()
    rows = list(zip(table["features"], table["tags"], strict=True))
    for text_, spans in labelled(False):
        rows += _stretches(*_tagged_words(text_, spans))
    rows.sort(key=lambda r: (list(r[0]), list(r[1])))
    size = np.array([len(t) for _, t in rows])
    return train(np.concatenate([f for f, _ in rows]).reshape(-1, PARTS).astype(np.int64), np.concatenate([t for _, t in rows]).astype(np.int64), np.cumsum(size) - size, size, FEATURES, 1 + len(KINDS))


def _added(chain: Chain, texts: list[bytes], base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """Spans of tagged words that touch no base span; words of one tag in a line make one span."""
    w = Words(texts)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(w.start):
        return out
    first, size = w.lines()
    entry, place, held, core = overlapped(first, size, PIECE, SIDE)
    tags = np.zeros(len(w.start), np.int8)
    tags[entry[core]] = viterbi(chain, chain.scores(_features(w)[entry]), place, held)[core]
    hit = np.flatnonzero(tags)
    if not len(hit):
        return out
    head = np.zeros(len(tags), bool)
    head[first] = True
    before = w.code_points()
    start, end = before[w.start] - before[w.base[w.doc]], before[w.end] - before[w.base[w.doc]]
    new = np.append(True, (hit[1:] != hit[:-1] + 1) | (tags[hit[1:]] != tags[hit[:-1]]) | head[hit[1:]])
    heads = np.flatnonzero(new)
    for a, b in zip(heads, np.append(heads[1:], len(hit)), strict=True):
        i, j = hit[a], hit[b - 1]
        doc, kind = w.doc[i], int(tags[i]) - 1
        for x, y in _numbers(w, i, j) if KINDS[kind] == "card" else [(i, j)]:
            if not any(p < end[y] and q > start[x] for p, _, q in base[doc]):
                out[doc].append((int(start[x]), kind, int(end[y])))
    return out


def _numbers(w: Words, i: int, j: int) -> Iterator[tuple[int, int]]:
    """Runs of words i..j that are card numbers, the longest first from the left: 13 to 19 digits that pass Luhn. Other words are none."""
    digits = [re.sub(rb"[^0-9]", b"", w.data[w.start[k] : w.end[k]]).decode() for k in range(i, j + 1)]
    a = 0
    while a < len(digits):
        found, said = None, ""
        for b in range(a, len(digits)):
            said += digits[b]
            if len(said) > 19:
                break
            if digits[a] and digits[b] and len(said) >= 13 and _luhn(said):
                found = b
        if found is None:
            a += 1
        else:
            yield i + a, i + found
            a = found + 1


def _scan_frames(chain: Chain) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def said(spans: list[tuple[int, int, int]]) -> str:
        return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            whole, ids = frame["text"].tolist(), frame["doc_id"]
            texts = [t.encode("utf-8", "replace") for t in whole]
            for a, b in batches(texts):
                base = [base_spans(t) for t in whole[a:b]]
                more = _added(chain, texts[a:b], base)
                out = pd.DataFrame({"doc_id": ids.iloc[a:b].to_numpy()})
                for n, kind in enumerate(BASE_KINDS):
                    out[f"n_{kind}"] = [sum(k == n for _, k, _ in x) for x in base]
                out["base_sha256"] = [hashlib.sha256(said(x).encode()).hexdigest() for x in base]
                out["spans"] = [said(sorted(x + y)) for x, y in zip(base, more, strict=True)]
                yield out

    return work


def personal_data(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans: one row per row of ``docs``."""
    rows = docs.select(plain_id(), text_or_empty().alias("text"))
    out = rows.mapInPandas(_scan_frames(chain), "doc_id string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
