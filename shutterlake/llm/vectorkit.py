"""Vectors of whole numbers: which rows take part, and blocks of them as bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits that int64 arithmetic may use, and whole numbers that doubles hold exactly.
SAFE_BITS, EXACT_BITS = 62, 53
#: Components in a block of vectors, and rows in it.
BLOCK_VALUES, BLOCK_ROWS = 1 << 19, 4096


def finite(x: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return x.isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))


def floored(x: Column, scale: int, plus: int = 0) -> Column:
    """floor(scale * e) + plus for each component e as a double; one of 62 bits or more ends the job with an error."""
    wide = F.exists(x, lambda e: F.abs(e.cast("double") * scale) >= float(1 << SAFE_BITS))
    whole = F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long") + F.lit(plus).cast("long"))
    return F.when(~wide, whole).otherwise(F.raise_error(F.lit("a quantised component has over 62 bits")).cast("array<bigint>"))


def bits(x: np.ndarray) -> int:
    return max(int(x.max()).bit_length(), int(-x.min()).bit_length()) if x.size else 0


def to_bytes(rows: list[np.ndarray]) -> tuple[int, bytes]:
    """(bytes a number, data) of vectors of one length, as narrow as they allow."""
    data = np.array(rows, np.int64)
    width = next(w for w in (2, 4, 8) if bits(data) < 8 * w)
    return width, data.astype(f"<i{width}").tobytes()


def from_bytes(data: bytes, width: int, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{width}").astype(np.int64).reshape(n, -1)


def runs(rows: Iterator[tuple], length) -> Iterator[list[tuple]]:
    """Consecutive rows in lists of vectors of one length, bounded by rows and by components."""
    waiting: list[tuple] = []
    dim = 0
    for row in rows:
        n = length(row)
        if waiting and (n != dim or len(waiting) >= BLOCK_ROWS or len(waiting) * dim >= BLOCK_VALUES):
            yield waiting
            waiting = []
        waiting.append(row)
        dim = n
    if waiting:
        yield waiting


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` with the rows of ``b``, exact; those that are no long become +-(2^63 - 1)."""
    need = bits(a) + bits(b) + a.shape[1].bit_length()
    if need <= EXACT_BITS:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if need <= SAFE_BITS:
        return a @ b.T
    most = 2**63 - 1
    return np.clip(a.astype(object) @ b.astype(object).T, -most, most).astype(np.int64)
