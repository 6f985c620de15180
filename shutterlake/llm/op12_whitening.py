"""Embedding whitening: leading eigenvectors of the covariance by LOBPCG over distributed rows.

Vectors are quantised to whole numbers. The fit list, each distinct vector once,
is written in blocks of narrow integers; its size n and the sums S of its
dimensions are exact, so a row is centred without rounding as n * x - S. The
covariance itself is never made. A step of LOBPCG takes one pass over the blocks:

* the basis is an orthonormal set that spans the block of iterates, their
  residuals and the previous directions;
* the tasks multiply it by the covariance, as sums of c (c' basis) over their
  centred rows c, and the sums of the tasks are added in two steps;
* Rayleigh-Ritz on that product gives the next iterates, their eigenvalues and
  residuals, and what the step moved by is the next direction.

It ends when the residuals of all wanted eigenvectors are below 1e-13 of the
largest eigenvalue (or no longer fall, and are below 1e-10). One more pass with
the eigenvectors alone certifies the residuals anew and measures how far the
covariance of the whitened fit list is from the identity. The driver holds
matrices of (dimensions) x (columns of the basis) only.

Defined cases: rows whose vector is null or holds null or non-finite components
are dropped; vec_id may be null and may repeat, and every remaining row gets its
result; vectors of each length are a space of their own, with their own fit
list; eigenvalues of 1e-9 of the largest one and below are no components (a
constant dimension cannot be whitened), so a fit list of one vector gives no
rows, nor do empty vectors; an empty table gives an empty result; other columns
are ignored. A component of 62 bits or more, or a deviation that is no long,
ends the job with an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .vectorkit import SAFE_BITS, bits, finite, floored, from_bytes, runs, to_bytes

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Columns of the iterate beyond the wanted ones, which make it converge faster.
GUARD = 8
#: Residuals, as a part of the largest eigenvalue, that end the iteration, and that are accepted when it stalls; most steps.
WANTED, CERTIFIED, STEPS = 1e-13, 1e-10, 300
#: Eigenvalues of this part of the largest one and below are no components.
RANK = 1e-9

BLOCKS = "dim int, width int, n long, data binary"


def whole(table: DataFrame) -> DataFrame:
    """vec_id, v of the rows that are not dropped."""
    return table.filter(finite(F.col("embedding"))).select("vec_id", floored(F.col("embedding"), SCALE, SHIFT).alias("v"))


def _pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for block in runs(((v,) for v in sorted(frame["v"], key=len)), lambda r: len(r[0])):
            width, data = to_bytes([v for v, in block])
            yield pd.DataFrame({"dim": [len(block[0][0])], "width": [width], "n": [len(block)], "data": [data]})


def fit_list(rows: DataFrame) -> DataFrame:
    """Blocks of the distinct vectors."""
    return materialize(rows.select("v").distinct().mapInPandas(_pack, BLOCKS), "whitening-fit")


@dataclass
class Centre:
    """Size and sums of a fit list."""

    n: int
    sums: list[int]

    def exact(self, x: np.ndarray) -> np.ndarray:
        """n * x - S for each row of ``x``, without rounding."""
        need = max(self.n.bit_length() + bits(x), max((abs(s).bit_length() for s in self.sums), default=0)) + 1
        kind = np.int64 if need <= SAFE_BITS else object
        return x.astype(kind) * self.n - np.array(self.sums, kind)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return self.exact(x).astype(np.float64) / self.n


@dataclass
class Whitening:
    """Eigenvectors (dimension, component), their eigenvalues, the trace of the covariance, and the distance from the identity."""

    centre: Centre
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float


def _centres(blocks: DataFrame) -> dict[int, Centre]:
    """Size and sums for each length of vectors."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for frame in frames:
            for r in frame.itertuples(index=False):
                x = from_bytes(r.data, r.width, r.n)
                x = x if bits(x) + int(r.n).bit_length() <= SAFE_BITS else x.astype(object)
                sums[r.dim] = sums.get(r.dim, 0) + x.sum(axis=0).astype(object)
        for dim, s in sums.items():
            yield pd.DataFrame({"dim": dim, "at": np.arange(dim), "total": [Decimal(int(t)) for t in s]})

    sizes = {r["dim"]: r["n"] for r in blocks.filter("dim > 0").groupBy("dim").agg(F.sum("n").alias("n")).collect()}
    out = {dim: Centre(n, [0] * dim) for dim, n in sizes.items()}
    totals = blocks.filter("dim > 0").mapInPandas(work, "dim int, at int, total decimal(38,0)").groupBy("dim", "at").agg(F.sum("total").alias("total"))
    for r in totals.collect():  # a number for each dimension
        out[r["dim"]].sums[r["at"]] = int(r["total"])
    return out


def _summed(blocks: DataFrame, tasks: int, centre: Centre, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``of(rows)`` over all blocks of centred rows, added within the ``tasks`` tasks, then in about the root of as many, then here."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for frame in frames:
            for r in frame.itertuples(index=False):
                part = of(centre.rows(from_bytes(r.data, r.width, r.n)))
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"part": [total.tobytes()]})

    def added(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [np.frombuffer(p) for frame in frames for p in frame["part"]]
        if parts:
            yield pd.DataFrame({"part": [np.sum(parts, axis=0).tobytes()]})

    parts = blocks.filter(F.col("dim") == len(centre.sums)).select("width", "n", "data").mapInPandas(each, "part binary")
    if tasks > 16:
        parts = parts.repartition(round(tasks**0.5)).mapInPandas(added, "part binary")
    return np.sum([np.frombuffer(r["part"]) for r in parts.collect()], axis=0)


def _complement(x: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span what ``more`` adds to the orthonormal ``x``."""
    size = np.linalg.norm(more, axis=0)
    more = more[:, size > 0] / size[size > 0]
    for _ in range(2):
        more = more - x @ (x.T @ more)
    u, s, _ = np.linalg.svd(more, full_matrices=False)
    u = u[:, s > 1e-8]
    u = u - x @ (x.T @ u)
    return np.linalg.qr(u)[0] if u.shape[1] else u


def lobpcg(product: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, values) of the ``wanted`` largest eigenvalues of the symmetric map ``product`` of blocks of columns."""
    m = min(dim, wanted + GUARD)
    x = np.linalg.qr(np.random.default_rng(12).normal(size=(dim, m)))[0]
    basis, least, stalled = x, np.inf, 0
    for _ in range(STEPS):
        image = product(basis)
        small = basis.T @ image
        values, y = np.linalg.eigh((small + small.T) / 2)
        values, y = values[::-1][:m], y[:, ::-1][:, :m]
        x = basis @ y
        residual = image @ y - x * values
        worst = np.linalg.norm(residual[:, :wanted], axis=0).max(initial=0)
        top = max(values[0], 0) if m else 0
        stalled = 0 if worst < 0.5 * least else stalled + 1
        least = min(least, worst)
        if worst <= WANTED * top or stalled >= 10 and worst <= CERTIFIED * top:
            return x[:, :wanted], values[:wanted]
        step = basis[:, m:] @ y[m:]  # what residuals and earlier directions added
        x = np.linalg.qr(x)[0]
        basis = np.hstack([x, _complement(x, np.hstack([residual, step]))])
    raise ValueError(f"no convergence: residual {worst} at eigenvalue {top}")


def _whitening(blocks: DataFrame, tasks: int, centre: Centre, most: int) -> Whitening | None:
    dim, n = len(centre.sums), centre.n
    trace = float(_summed(blocks, tasks, centre, lambda c: np.array([(c * c).sum()]))[0]) / n
    if trace == 0:
        return None
    vectors, values = lobpcg(lambda basis: _summed(blocks, tasks, centre, lambda c: (c.T @ (c @ basis)).ravel()).reshape(basis.shape) / n, dim, min(most, dim))
    fine = values > RANK * values[0]
    vectors, values = vectors[:, fine], values[fine]
    k = len(values)

    def checked(c: np.ndarray) -> np.ndarray:
        w = c @ vectors
        white = w / np.sqrt(values)
        return np.concatenate([(c.T @ w).ravel(), (white.T @ white).ravel(), white.sum(axis=0)])

    sums = _summed(blocks, tasks, centre, checked) / n
    image, white, mean = sums[: dim * k].reshape(dim, k), sums[dim * k : -k].reshape(k, k), sums[-k:]
    worst = np.linalg.norm(image - vectors * values, axis=0).max()
    if worst > CERTIFIED * values[0]:
        raise ValueError(f"residual {worst} at eigenvalue {values[0]}")
    return Whitening(centre, vectors, values, trace, float(np.abs(white - np.outer(mean, mean) - np.eye(k)).max()))


def fit(table: DataFrame, most: int = COMPONENTS) -> dict[int, Whitening]:
    """The whitening of each length of vectors that has one."""
    blocks = fit_list(whole(table))
    tasks = blocks.select(F.spark_partition_id()).distinct().count()
    found = {dim: _whitening(blocks, tasks, centre, most) for dim, centre in sorted(_centres(blocks).items())}
    return {dim: w for dim, w in found.items() if w is not None}


OUT = "vec_id long, unnamed boolean, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(table: DataFrame, model: dict[int, Whitening]) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each row and component."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, rows in frame.groupby(frame["v"].map(len)):
                if dim not in model:
                    continue
                m = model[dim]
                k = len(m.values)
                for a in range(0, len(rows), 1024):
                    part = rows.iloc[a : a + 1024]
                    exact = m.centre.exact(np.stack(part["v"].to_list()))
                    square = exact if 2 * bits(exact) + int(dim).bit_length() <= SAFE_BITS else exact.astype(object)
                    deviation = (square * square).sum(axis=1)
                    white = (exact.astype(np.float64) / m.centre.n) @ m.vectors / np.sqrt(m.values)
                    if max(deviation) >= 2**63:
                        raise OverflowError("a deviation is no long")
                    yield pd.DataFrame({
                        "vec_id": np.repeat(part["vec_id"].to_numpy(), k), "unnamed": np.repeat(part["unnamed"].to_numpy(), k), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(part)),
                        "n": m.centre.n, "deviation": np.repeat(deviation.astype(np.int64), k), "whitened": white.ravel(),
                        "explained": np.tile(m.values / m.trace, len(part)), "identity_error": m.identity_error,
                    })

    # ids beside nulls would become floats in pandas
    rows = whole(table).select(F.coalesce(F.col("vec_id").cast("long"), F.lit(0)).alias("vec_id"), F.isnull("vec_id").alias("unnamed"), "v")
    return rows.mapInPandas(work, OUT).withColumn("vec_id", F.when(~F.col("unnamed"), F.col("vec_id"))).drop("unnamed")
