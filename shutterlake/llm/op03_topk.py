"""Exact top-k inner product search on a bit-sliced index.

Vectors are quantised to integers and packed in blocks. A block keeps, for each
component, one bitmap over its rows for every bit of the two's complement value
(the slices). For a batch of queries the upper slices, weighted by the query's
components, are added by bitmap arithmetic (ripple-carry adders on words of 64
rows), giving the slices of the sums. From the most significant sum slice
downward the rows of the k largest sums are selected; the bound on what the
lower slices can add widens that to every row that can still be among the k
best, and these boundary rows are scored exactly.

Queries are a stated subset of the rows. They are packed in blocks as well, and
each block of queries meets each block of rows once. The two are keyed by
(index block, chunk of query blocks), so that the work on one index block is
split over tasks and the index is copied once for each chunk of CHUNK query
blocks. A task keeps only the k best of a query, so k rows for a query and task
are shuffled.

Defined cases: vectors that are null or hold null or non-finite components take
no part, nor do rows without vec_id; a query meets vectors of its own length
only; rows that repeat a query's vec_id are that query and not candidates of
it, and it is asked once, with the least of its vectors; other repeated rows
are candidates each; empty vectors score 0; an empty table gives an empty
result; other columns are ignored. Scores are exact whatever their size:
components of a block are kept as narrow as they allow, and sums that 62 bits
might not hold are added as Python's integers. A quantised component of 2^62 or
more, or a score among the k best that is no long, ends the job with an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SCALE = 256
#: Rows of an index block, queries of a query block, queries that are added at once.
BLOCK_ROWS, BLOCK_QUERIES, BATCH_QUERIES = 8192, 1024, 64
#: Components of a block, and rows of a list of blocks that is broadcast.
BLOCK_VALUES, LISTED = 1 << 20, 100_000
#: Query blocks that meet an index block under one key; most partitions that such keys are dealt to.
CHUNK, MOST_TASKS = 16, 20_000
#: Bits that int64 arithmetic may use.
SAFE_BITS = 62
#: Bits of the components that the adders skip and the exact step resolves.
LOW_BITS = 3
K = 5


def quantised(table: DataFrame) -> DataFrame:
    """vec_id, v: the rows that take part, floor(SCALE * x) in each component."""
    x = F.col("embedding")
    fine = F.col("vec_id").isNotNull() & x.isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    wide = F.exists(x, lambda e: F.abs(e.cast("double") * SCALE) >= float(1 << SAFE_BITS))
    whole = F.transform(x, lambda e: F.floor(e.cast("double") * SCALE).cast("long"))
    whole = F.when(~wide, whole).otherwise(F.raise_error(F.lit("a quantised component has over 62 bits")).cast("array<bigint>"))
    return table.filter(fine).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


class Block:
    """Slices of up to BLOCK_ROWS vectors of one length."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], values[order]
        high = self.values >> LOW_BITS
        top = int(max(high.max(initial=0), -high.min(initial=0) - 1, 0))
        self.bits = top.bit_length() + 1
        self.words = -(-len(ids) // 64)
        # [component, bit, word]: bitmaps over the rows
        self.slices = np.zeros((values.shape[1], self.bits, self.words * 8), np.uint8)
        for b in range(self.bits):
            packed = np.packbits((high >> b & 1).astype(np.uint8).T, axis=1, bitorder="little")
            self.slices[:, b, : packed.shape[1]] = packed
        self.slices = self.slices.view(np.uint64)
        self.rows = np.packbits(np.arange(self.words * 64) < len(ids), bitorder="little").view(np.uint64)

    def sums(self, queries: np.ndarray) -> list[np.ndarray]:
        """Slices [query, word], least first, of query x upper bits, plus a constant of the query's own.

        The sign slice of a two's complement number counts negatively; its
        complement counts positively and differs by a constant, as does the
        complement of a whole number from its negative. So every bitmap that is
        added counts positively, and sums of one query compare as they should.
        """
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        columns: list[list[np.ndarray]] = []

        def add(bitmap: np.ndarray, weight: int) -> None:
            while len(columns) <= weight:
                columns.append([])
            column = columns[weight]
            column.append(bitmap)
            if len(column) == 3:  # a full adder: three bitmaps become their sum here and their carry above
                a, b, c = column
                half = a ^ b
                column[:] = [half ^ c]
                add(a & b | half & c, weight + 1)

        for d in range(queries.shape[1]):
            q = queries[:, d]
            size = np.abs(q)
            flip = np.where(q < 0, full, np.uint64(0))[:, None]
            value = [self.slices[d, b][None] ^ (flip if b < self.bits - 1 else ~flip) for b in range(self.bits)]
            for shift in range(int(size.max(initial=0)).bit_length()):
                on = np.where(size >> shift & 1, full, np.uint64(0))[:, None]
                for b in range(self.bits):
                    add(value[b] & on, b + shift)
        out, weight = [], 0
        while weight < len(columns):  # what two are left in a column are added half by half
            column = columns[weight]
            while len(column) > 1:
                a, b = column.pop(), column.pop()
                column.append(a ^ b)
                add(a & b, weight + 1)
            out.append(column[0] if column else np.zeros((len(queries), self.words), np.uint64))
            weight += 1
        return out or [np.zeros((len(queries), self.words), np.uint64)]


def _bit_select(acc: list[np.ndarray], rows: np.ndarray, k: int) -> np.ndarray:
    """For each query the k-th largest sum over ``rows`` (the least if there are fewer), from the top slice downward."""
    left = np.full(len(acc[0]), min(k, int(np.bitwise_count(rows).sum())))
    equal = np.broadcast_to(rows, acc[0].shape).copy()
    value = np.zeros(len(acc[0]), np.int64 if len(acc) <= SAFE_BITS else object)
    for b in range(len(acc) - 1, -1, -1):
        ones = equal & acc[b]
        many = np.bitwise_count(ones).sum(axis=1, dtype=np.int64)
        up = many >= left
        left = np.where(up, left, left - many)
        equal = np.where(up[:, None], ones, equal & ~acc[b])
        value = value + np.where(up, 1, 0).astype(value.dtype) * (1 << b)
    return value


def _at_least(acc: list[np.ndarray], rows: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Bitmaps of the rows whose sum is ``bound`` or more, compared from the top slice downward."""
    bound = np.maximum(bound, 0)
    more, equal = np.zeros_like(acc[0]), np.broadcast_to(rows, acc[0].shape).copy()
    for b in range(len(acc) - 1, -1, -1):
        want = ((bound >> b) & 1).astype(bool)[:, None]
        more = np.where(want, more, more | equal & acc[b])
        equal &= np.where(want, acc[b], ~acc[b])
    return more | equal


def _bits(x: np.ndarray) -> int:
    return int(np.abs(x).max(initial=0)).bit_length()


def _ranked(score: np.ndarray) -> np.ndarray:
    """Numbers that sort scores downward; np.lexsort takes no Python integers."""
    return -score if score.dtype != object else -np.unique(score, return_inverse=True)[1]


def block_top(block: Block, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of query, ids, scores) of the k best rows of the block, the query's own left out."""
    rest = (1 << LOW_BITS) - 1
    for a in range(0, len(queries), BATCH_QUERIES):
        q, ids = queries[a : a + BATCH_QUERIES], query_ids[a : a + BATCH_QUERIES]
        acc = block.sums(q)
        own = np.searchsorted(block.ids, ids, "right") - np.searchsorted(block.ids, ids)
        wide = len(acc) > SAFE_BITS or _bits(q) + _bits(block.values) + q.shape[1].bit_length() > SAFE_BITS
        kind = object if wide else np.int64
        least = np.zeros(len(q), kind)
        for n in np.unique(own):  # own rows may take up that many of the best
            least[own == n] = _bit_select([x[own == n] for x in acc], block.rows, k + int(n))
        # the lower bits add between the sums of the negative and of the positive components, times rest
        spread = rest * np.abs(q).astype(kind).sum(axis=1)
        near = _at_least(acc, block.rows, least - -(-spread >> LOW_BITS) - 1)
        hit, row = np.nonzero(np.unpackbits(near.view(np.uint8), axis=1, bitorder="little"))
        fine = block.ids[row] != ids[hit]
        hit, row = hit[fine], row[fine]
        score = np.zeros(len(hit), kind)
        for x in range(0, len(hit), 1 << 16):
            score[x : x + (1 << 16)] = (q[hit[x : x + (1 << 16)]].astype(kind) * block.values[row[x : x + (1 << 16)]].astype(kind)).sum(axis=1)
        order = np.lexsort((block.ids[row], _ranked(score), hit))
        hit, row, score = hit[order], row[order], score[order]
        cut = np.searchsorted(hit, np.arange(len(q) + 1))
        for i, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            if y > x:
                y = min(y, x + k)
                yield a + i, block.ids[row[x:y]], score[x:y]


PACKED = "dim int, width int, ids binary, data binary"


def _packed(most: int):
    """Rows vec_id, v of a task as rows dim, width, ids, data of up to ``most`` vectors of one length."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: dict[int, list[tuple[int, np.ndarray]]] = {}

        def out(rows: list) -> pd.DataFrame:
            ids = np.array([i for i, _ in rows], np.int64)
            data = np.array([v for _, v in rows], np.int64).reshape(len(rows), -1)
            width = next(w for w in (2, 4, 8) if _bits(data) < 8 * w)
            return pd.DataFrame({"dim": [data.shape[1]], "width": [width], "ids": [ids.tobytes()], "data": [data.astype(f"i{width}").tobytes()]})

        for frame in frames:
            for i, v in zip(frame["vec_id"], frame["v"], strict=True):
                rows = waiting.setdefault(len(v), [])
                rows.append((i, v))
                if len(rows) >= most or len(rows) * len(v) >= BLOCK_VALUES:
                    yield out(waiting.pop(len(v)))
        yield from map(out, waiting.values())

    return work


def _unpacked(ids: bytes, data: bytes, width: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(data, f"i{width}").astype(np.int64).reshape(len(ids), dim)


def _searched(k: int):
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        block, made = None, None
        for frame in frames:
            for r in frame.itertuples(index=False):
                if made != r.block:
                    made, block = r.block, Block(*_unpacked(r.ids, r.data, r.width, r.dim))
                query_ids, queries = _unpacked(r.query_ids, r.query_data, r.query_width, r.dim)
                for i, ids, score in block_top(block, query_ids, queries, k):
                    q = int(query_ids[i])
                    if q in best:
                        ids, score = np.append(best[q][0], ids), np.append(best[q][1], score)
                        order = np.lexsort((ids, _ranked(score)))[:k]
                        ids, score = ids[order], score[order]
                    best[q] = ids, score
        if best:
            sizes = [len(x) for x, _ in best.values()]
            score = np.concatenate([x for _, x in best.values()])
            yield pd.DataFrame({"query_id": np.repeat(list(best), sizes), "vec_id": np.concatenate([x for x, _ in best.values()]), "score": [str(x) for x in score]})

    return work


def _listed(ids: DataFrame) -> DataFrame:
    """A list of blocks, broadcast if it is short, so that vectors are not dealt by their length."""
    return F.broadcast(ids) if ids.limit(LISTED + 1).count() <= LISTED else ids


def top_k(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: for each of ``queries`` (vec_id, v) its k best of ``rows`` (vec_id, v)."""
    asked = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    # numbers given when the tables were written stay what they are if a task is run again
    index = materialize(rows.mapInPandas(_packed(BLOCK_ROWS), PACKED).withColumn("block", F.monotonically_increasing_id()), "topk-index")
    asked = materialize(asked.mapInPandas(_packed(BLOCK_QUERIES), PACKED).withColumn("nth", F.monotonically_increasing_id()), "topk-queries")
    n_index, n_asked = index.count(), asked.count()
    chunks = max(1, -(-n_asked // CHUNK))
    asked = asked.select("dim", F.col("width").alias("query_width"), F.col("ids").alias("query_ids"), F.col("data").alias("query_data"), F.pmod(F.xxhash64("nth"), F.lit(chunks)).alias("chunk"))
    # each index block once for each chunk, each query block once for each index block; the lists that say so hold ids alone
    tasks = max(1, min(n_index * chunks, MOST_TASKS))
    one = index.join(_listed(asked.select("dim", "chunk").distinct()), "dim").repartition(tasks, "block", "chunk")
    two = asked.join(_listed(index.select("dim", "block")), "dim").drop("dim").repartition(tasks, "block", "chunk")
    found = one.join(two, ["block", "chunk"]).mapInPandas(_searched(k), "query_id long, vec_id long, score string")
    wide = F.col("score").cast("decimal(38,0)")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(wide.desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("score").cast("long").alias("score"))


def nearest_neighbours(table: DataFrame, every: int = 50, k: int = K) -> DataFrame:
    rows = quantised(table)
    return top_k(rows, rows.filter(F.col("vec_id") % every == 0), k)


SQL = """
WITH v AS (
  SELECT vec_id, LIST_TRANSFORM(embedding, lambda x: FLOOR(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND LEN(LIST_FILTER(embedding, lambda x: x IS NULL OR NOT ISFINITE(x))) = 0),
q AS (SELECT vec_id AS query_id, v AS q FROM v WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, LIST_DOT_PRODUCT(q, v)::BIGINT AS score FROM q JOIN v ON query_id <> vec_id AND LEN(q) = LEN(v)),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
