"""Fields of messages in the protobuf wire format, without their schema."""

from __future__ import annotations

from collections.abc import Collection, Iterator

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "path string, field string, wire int, number long, bytes binary"
BATCH_FIELDS = 20_000

# Wire types by number.
VARINT, FIXED64, BYTES, FIXED32 = 0, 1, 2, 5


def _varint(data: bytes, at: int, end: int) -> tuple[int, int] | None:
    """A number of at most 64 bits and the place behind it; none if it does not end in time."""
    out = 0
    for i in range(min(10, end - at)):
        out |= (data[at + i] & 127) << 7 * i
        if data[at + i] < 128:
            return (out, at + i + 1) if out < 1 << 64 else None
    return None


def fields(data: bytes, messages: Collection[str] = ()) -> Iterator[tuple[str, int | None, int | None, bytes | None]]:
    """Field, wire type, number and bytes of every field, in file order.

    ``field`` is the path of field numbers ("4.1"). Fields in ``messages`` are
    walked as well, after their own row. Where a message is damaged (it breaks
    off, or has a field 0 or another wire type) its own path ("" at the top)
    stands without a wire type, and the walk goes on behind that message.
    Numbers are the 64 or 32 bits read as unsigned.
    """
    open_messages = [(0, len(data), "")]  # explicit, so depth costs no recursion
    while open_messages:
        at, end, above = open_messages.pop()
        while at < end:
            key = _varint(data, at, end)
            kind, nth = (key[0] & 7, key[0] >> 3) if key else (-1, 0)
            field = f"{above}.{nth}" if above else str(nth)
            at = key[1] if key else at
            if nth == 0 or nth >= 1 << 29:
                break
            if kind in (FIXED64, FIXED32):
                size = 8 if kind == FIXED64 else 4
                if end - at < size:
                    break
                yield field, kind, int.from_bytes(data[at : at + size], "little"), None
                at += size
                continue
            value = _varint(data, at, end) if kind in (VARINT, BYTES) else None
            if value is None:
                break
            n, at = value
            if kind == VARINT:
                yield field, kind, n, None
                continue
            if end - at < n:
                break
            yield field, kind, None, data[at : at + n]
            if field in messages:
                open_messages.append((at + n, end, above))
                at, end, above = at, at + n, field
            else:
                at += n
        else:
            continue
        yield above, None, None, None


def signed(n: int) -> int:
    """The 64 bits of an unsigned number as a long."""
    return n - (1 << 64) if n >= 1 << 63 else n


def wire_fields(files: DataFrame, messages: Collection[str] = ()) -> DataFrame:
    """SCHEMA: a row for each field of files (path, content); 64-bit numbers above 2^63 - 1 come out negative. Null files have none."""
    walked = frozenset(messages)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["path", "field", "wire", "number", "bytes"], dtype="object")
        return out.assign(wire=out["wire"].astype("Int32"), number=out["number"].astype("Int64"))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for f in frames:
            for path, content in zip(f["path"], f["content"], strict=True):
                for field, wire, number, raw in fields(bytes(content), walked) if content is not None else ():
                    rows.append((path, field, wire, None if number is None else signed(number), raw))
                    if len(rows) >= BATCH_FIELDS:
                        yield frame(rows)
                        rows = []
        if rows:
            yield frame(rows)

    return files.select("path", "content").mapInPandas(work, SCHEMA)
