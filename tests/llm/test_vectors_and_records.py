"""Hard negatives, whitening and token records against brute force and on odd tables."""

import math
import zlib
from fractions import Fraction
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shutterlake.llm import op11_hard_negatives as negatives
from shutterlake.llm import op12_whitening as whitening
from shutterlake.llm import op13_token_records as records
from shutterlake.llm import queries

SF = "/root/testdata/sf0.001"
EMBEDDINGS = "vec_id long, embedding array<double>, label int, norm string, n string, rank string, dim string, high string, v string"


def table(spark, rows):
    """vec_id, embedding, label, with columns whose names operators use inside."""
    return spark.createDataFrame([(*r, "norm", "n", "rank", "dim", "high", "v") for r in rows], EMBEDDINGS).repartition(3)


def fine(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


# ---- 11 ----


def brute_negatives(rows, every=100):
    use = [(i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256.0 * x) for x in v]) for i, v, label in rows if i is not None and label is not None and fine(v)]
    out = []
    for anchor in sorted({r[0] for r in use if r[0] % every == 0}):
        _, label, v = min((r for r in use if r[0] == anchor), key=lambda r: (r[2], r[1]))
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i, at == label) for i, at, w in use if i != anchor and len(w) == len(v))
        for nth, (score, won, _) in enumerate([s for s in scored if s[2]][:5], 1):
            near = [(s, i) for s, i, same in scored if not same and 80 * -score <= 100 * -s <= 100 * -score][:5]
            out += [(anchor, won, n, i, -score, -s, nth) for n, (s, i) in enumerate(near, 1)]
    return sorted(out)


def odd_vectors():
    r = np.random.default_rng(8)
    rows = [(i, [float(x) for x in r.normal(size=12) * (0.05 if i % 3 else 1.0)], int(r.integers(0, 10))) for i in range(600)]
    rows += [(1000 + i, rows[100][1], i % 2) for i in range(60)]  # ties
    rows += [(200, rows[3][1], 4), (200, rows[200][1], 5), (777, rows[5][1], 1), (777, rows[5][1], 1)]  # repeated ids and rows
    rows += [(2000, None, 1), (2100, [None] * 12, 1), (2200, [float("nan")] * 12, 1), (2300, [float("inf")] * 12, 2), (None, rows[0][1], 1), (2400, rows[1][1], None)]
    rows += [(2500, [1.0, 2.0], 1), (2501, [2.0, 1.0], 1), (2502, [2.0, 0.8], 2), (2600, [], 1), (2601, [], 1), (2602, [], 2), (2700, [0.0] * 12, 3), (2800, [-1.0, 0.0, 0.0], 3), (2801, [1.0, 0.0, 0.0], 3)]
    rows += [(2900, [1.0, 1.0, 1.0, 1.0], 1), (2901, [1e8, 1e8, 0.0, 0.0], 1), (2902, [1.9e8, 0.0, 0.0, 0.0], 2), (2903, [-1e16, 0.0, 0.0, 0.0], 2), (2904, [0.0, 1e14, -1e14, 0.0], 1)]  # wide numbers
    return rows


def test_hard_negatives_against_brute_force(spark, monkeypatch):
    rows = odd_vectors()
    want = brute_negatives(rows)
    assert len(want) > 60
    df = table(spark, rows)
    for block, group, chunk in ((4096, 32 << 20, 8 << 20), (16, 600, 300)):
        monkeypatch.setattr(negatives, "GROUP_BYTES", group)
        monkeypatch.setattr(negatives, "CHUNK_BYTES", chunk)
        monkeypatch.setattr("shutterlake.llm.vectorkit.BLOCK_ROWS", block)
        got = negatives.mined(df)
        assert sorted(tuple(x) for x in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank").collect()) == want
    monkeypatch.setattr(negatives, "LISTED", 0)  # lists that are too long to be broadcast
    assert negatives.mined(df).count() == len(want)
    assert negatives.mined(df.limit(0)).count() == 0


def test_hard_negatives_of_a_score_that_is_no_long(spark):
    rows = [(100, [1e10], 1), (1, [1e10], 1), (2, [1e10], 2)]
    with pytest.raises(Exception, match="no long"):
        negatives.mined(table(spark, rows)).collect()


def test_norms_prune_buckets(monkeypatch):
    r = np.random.default_rng(4)
    rows = r.integers(-50, 50, size=(2000, 8)) * np.repeat([100, 10, 1, 1], 500)[:, None]
    order = np.argsort(-(rows**2).sum(axis=1))
    rows, ids, labels = rows[order], np.arange(2000)[order], np.arange(2000)[order] % 5
    buckets = [(float(np.sqrt((rows[a : a + 100] ** 2).sum(axis=1).max())), ids[a : a + 100], labels[a : a + 100], rows[a : a + 100]) for a in range(0, 2000, 100)]
    met = []
    monkeypatch.setattr(negatives, "products", lambda a, b: met.append(len(b)) or a @ b.T)
    anchor = (ids[:4], labels[:4], rows[:4], np.sqrt((rows[:4] ** 2).sum(axis=1)))
    lowest = np.full((4, 1), negatives.LOWEST)
    (x, _, found, score), *_ = negatives.search(buckets, anchor, lowest, np.full((4, 1), negatives.NO_LONG), True, 5)
    assert len(met) < 10  # half of the buckets cannot hold a better row
    for i in range(4):
        best = sorted((-int(s), int(j)) for s, j, label in zip(rows @ rows[i], ids, labels, strict=True) if label == labels[i] and j != ids[i])[:5]
        assert sorted((-int(s), int(j)) for s, j in zip(score[x == i], found[x == i], strict=True)) == best


# ---- 12 ----


def brute_whitening(rows, most=16):
    """{dim: (distinct vectors, n, S, eigenvalues, eigenvectors, trace)} by exact sums and a dense solver."""
    spaces = {}
    for _, v, _ in rows:
        if fine(v) and v:
            spaces.setdefault(len(v), set()).add(tuple(math.floor(64.0 * x) + 1_000_000 for x in v))
    out = {}
    for dim, distinct in spaces.items():
        x = np.array(sorted(distinct), np.int64)
        n, sums = len(x), x.sum(axis=0)
        c = (n * x - sums) / n
        cov = c.T @ c / n
        e, w = np.linalg.eigh(cov)
        out[dim] = n, sums, e[::-1], w[:, ::-1], np.trace(cov), c
    return out


def test_whitening_against_a_dense_solver(spark):
    r = np.random.default_rng(3)
    spread = np.diag(np.linspace(3, 0.3, 40))
    rows = [(i, [float(x) for x in r.normal(size=40) @ spread], 1) for i in range(400)]
    rows += [(1000 + i, rows[7][1], None) for i in range(150)]  # copies count once
    rows += [(None, rows[9][1], 1), (None, rows[10][1], 1), (7, rows[11][1], 1), (2000, None, 1), (2001, [None] * 40, 1), (2002, [float("nan")] * 40, 1), (2003, [float("-inf")] * 40, 1), (2004, [], 1)]
    rows += [(3000 + i, [float(i % 5), float(i % 3), 4.0], 1) for i in range(30)]  # a constant dimension
    rows += [(4000 + i, [1.0, 2.0], 1) for i in range(5)]  # one vector: nothing to whiten
    df = table(spark, rows)
    got = whitening.whitened(df, whitening.fit(df)).collect()
    spaces = brute_whitening(rows)
    want_rows = [(i, v) for i, v, _ in rows if fine(v) and len(v) in (40, 3)]
    assert len(got) == sum(16 if len(v) == 40 else 2 for _, v in want_rows)
    by_id = {}
    for g in got:
        by_id.setdefault(g["vec_id"], []).append(g)
    assert len(by_id[None]) == 32 and len(by_id[7]) == 32
    for i, v in want_rows:
        if i is None or i == 7:
            continue
        n, sums, e, w, trace, _ = spaces[len(v)]
        x = [math.floor(64.0 * c) + 1_000_000 for c in v]
        for g in by_id[i]:
            j = g["component"] - 1
            exact = sum((n * a - int(s)) ** 2 for a, s in zip(x, sums, strict=True))
            assert g["n"] == n and g["deviation"] == exact
            plain = (np.array([float(Fraction(n * a - int(s), n)) for a, s in zip(x, sums, strict=True)]) @ w[:, j]) / math.sqrt(e[j])
            assert abs(abs(g["whitened"]) - abs(plain)) < 1e-8
            assert abs(g["explained"] * trace / e[j] - 1) < 1e-9 and g["identity_error"] < 1e-9


def test_signs_agree_over_rows_and_empty_tables(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    model = whitening.fit(df)
    rows = whitening.whitened(df.repartition(5), model).toPandas().pivot(index="vec_id", columns="component", values="whitened")
    _, _, e, w, _, _ = brute_whitening([(r["vec_id"], r["embedding"], None) for r in df.collect()])[64]
    found = np.corrcoef(rows.to_numpy().T)
    assert np.abs(found - np.eye(16)).max() < 0.05  # copies weigh here, not in the fit
    m = model[64]
    assert np.abs(np.abs(m.vectors.T @ w[:, :16]) - np.eye(16)).max() < 1e-10 and np.allclose(m.values, e[:16], rtol=1e-12)
    assert whitening.whitened(df.limit(0), whitening.fit(df.limit(0))).count() == 0


@pytest.mark.parametrize("dim", [1, 5, 30, 300])
def test_lobpcg_of_hard_spectra(dim):
    r = np.random.default_rng(dim)
    q = np.linalg.qr(r.normal(size=(dim, dim)))[0]
    for values in (np.linspace(5, 1, dim), np.r_[np.full(min(dim, 3), 7.0), np.geomspace(6, 1e-6, dim)][:dim], np.ones(dim)):
        a = q * values @ q.T
        a = (a + a.T) / 2
        steps = []
        x, e = whitening.lobpcg(lambda b, a=a, steps=steps: steps.append(1) or a @ b, dim, min(dim, 16))
        assert np.allclose(e, np.sort(values)[::-1][: len(e)], rtol=1e-9)
        assert np.linalg.norm(a @ x - x * e, axis=0).max() <= 1e-10 * e[0] and np.abs(x.T @ x - np.eye(len(e))).max() < 1e-12
        assert len(steps) < 120


def test_a_wide_whitening_is_exact(spark):
    rows = [(i, [1e12 * (i % 7), float(i)], 1) for i in range(20)]
    centre = whitening._centres(whitening.fit_list(whitening.whole(table(spark, rows))))[2]
    assert centre.n == 20 and centre.sums == [sum(int(64e12) * (i % 7) + 1_000_000 for i in range(20)), sum(64 * i + 1_000_000 for i in range(20))]
    with pytest.raises(Exception, match="no long"):
        whitening.whitened(table(spark, rows), whitening.fit(table(spark, rows))).collect()


# ---- 13 ----


def by_library(rows):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(queries.vocabulary())
    known.no_truncation()
    out, at = [], 0
    for doc, text in rows:
        ids = np.array([*known.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


TEXTS = [
    None, "", " \n\t ", "I'll DON'T It'S ΑΣ ΟΔΟΣ", "a<|endoftext|>b <|STARTOFTEXT|> <|startoftext|>", "é é \x1c\x85 🙂🙂 日本語　語   x y", "﻿hello ſ's 12 34½ ​", "x" * 70_000,
    "tab\tform\x0cfeed\x0bline\r\nnext", "ó ́ e\ń áb", "l ' ll ''s 'S's", "J\u030c. I\u0307! 12. a1, A1. x\u0301, .... —. «é». ² ²., ﬁ. Ǆ, ͅ. don't. DON'T, o'., ab\u0007. \u0130. <|endoftext|>. <|, |>.", " ".join(f"w{i}" for i in range(3000)),
]


def odd_documents(spark):
    rows = [(i * 3 % 13, t, "c", "s") for i, t in enumerate(TEXTS)] + [(None, "no id", None, None), (None, "no id", None, None), (5, "twice", None, None), (5, "twice", None, None), (-4, "least", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, start string"), rows


def test_records_of_odd_texts_against_the_library(spark, monkeypatch):
    docs, rows = odd_documents(spark)
    got = [tuple(r) for r in records.written_and_read(docs.repartition(4), queries.vocabulary()).collect()]
    # rows that repeat a doc_id may be in any order of their texts
    order, keyed = {}, {(r[0], n, crc): a for r in got for a, n, crc in [r[1:]]}
    for doc, text, *_ in rows:
        (_, _, n, crc), = by_library([(doc, text)])
        assert (doc, n, crc) in keyed
        order.setdefault(doc, []).append(n)
    assert len(got) == len(rows)
    starts = sorted(got, key=lambda r: r[1])
    at = 0
    for r in starts:
        assert r[1] == at
        at += r[2]
    assert [r[0] for r in starts] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    monkeypatch.setattr(records, "REMEMBERED", 3)
    monkeypatch.setattr(records, "ENCODED_BYTES", 50)
    assert sorted(map(str, records.written_and_read(docs, queries.vocabulary()).drop("start").collect())) == sorted(str(r) for r in spark.createDataFrame([(r[0], r[2], r[3]) for r in got], "doc_id long, n_tokens long, ids_crc32 long").collect())
    assert records.written_and_read(docs.limit(0), queries.vocabulary()).count() == 0


def test_records_of_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op13_token_files(spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == by_library(sorted((r["doc_id"], r["text"]) for r in docs.collect()))


def test_shuffled_reads_damage_and_stray_files(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    folder = f"file://{tmp_path}/records"
    records.write_records(docs, queries.vocabulary(), folder)
    plain = records.read_records(spark, folder, slice_bytes=20_000)
    rows = [tuple(r) for r in plain.collect()]
    assert [r[0] for r in rows] == sorted(r[0] for r in rows) and plain.rdd.getNumPartitions() > 8
    one, again, other = ([tuple(r) for r in records.read_records(spark, folder, seed, 20_000).collect()] for seed in (1, 1, 2))
    assert one == again != other and one != rows and sorted(one) == sorted(other) == sorted(rows)
    store = Path(f"{tmp_path}/records")
    (store / "part-000000-of-a-lost-attempt.tokens").write_bytes(b"half a record")
    assert records.read_records(spark, folder).count() == len(rows)
    for at in (3, 9, 40):  # a length, its checksum, a payload
        name = min(p for p in store.glob("*.tokens") if "lost" not in p.name)
        data = bytearray(name.read_bytes())
        data[at] ^= 1
        name.write_bytes(data)
        with pytest.raises(Exception, match="damaged"):
            records.read_records(spark, folder).collect()
        data[at] ^= 1
        name.write_bytes(data)
    assert records.masked(b"") == 0xA282EAD8
    for ids in ([], [0, 65535], [65536, 3], [2**32 - 1]):
        data = np.array(ids, "<u4").tobytes()
        assert all(records.unpacked(records.packed(doc, data)) == (doc, data) for doc in (None, 0, -5, 2**62))


def test_oracle_of_hard_negatives(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.sql(negatives.SQL)
    got = queries.op11_hard_negatives_mined(spark, SF).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
    assert got.filter(F.col("negative_score") > F.col("positive_score")).count() == 0


def test_words_that_differ_in_case_or_signs_ask_the_model_once():
    from tokenizers import Tokenizer

    class Counted:
        """The library, with its model's calls counted and no whole encoding."""

        def __init__(self, library):
            self.whole, self.asked, self.model = library, [], self

        def tokenize(self, word):
            self.asked.append(word)
            return self.whole.model.tokenize(word)

        def encode_batch_fast(self, texts, **options):
            self.asked += [t for t in texts if any(c.isalpha() for c in t)]
            return self.whole.encode_batch_fast(texts, **options)

    encoder, known = records.PieceEncoder(queries.vocabulary()), Tokenizer.from_file(queries.vocabulary())
    encoder.library = Counted(encoder.library)
    far = "ü" * 40  # longer than what is remembered
    texts = ["Übermut übermut ÜBERMUT übermut$$$ Übermut,###", "Only only, ONLY### only$$$ only", f"{far} {far.upper()} été ÉTÉ Kelvin kelvin"]
    got = encoder.encode([t.encode() for t in texts], 2)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [[*known.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert len([w for w in encoder.library.asked if "bermut" in w]) == 1 and len([w for w in encoder.library.asked if "only" in w.lower()]) == 1
    assert max(map(len, encoder.known)) <= records.PIECE_BYTES
