"""The walk over wire-format messages against an encoder."""

import random

from shutterlake.sources import wire


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def message(deal, above, depth, want, nested):
    """Bytes of a random message; its fields are added to ``want`` in file order."""
    out = b""
    for _ in range(deal.randrange(6)):
        nth = deal.choice([1, 2, 15, 16, 3000, (1 << 29) - 1])
        field = f"{above}.{nth}" if above else str(nth)
        kind = deal.choice([0, 1, 2, 5])
        if kind == 2 and depth and deal.random() < 0.6 and nth < 16:
            nested.add(field)
        if kind == 0:
            n = deal.choice([0, 1, 127, 128, 2**32, 2**63, 2**64 - 1])
            want.append((field, 0, n, None))
            body = varint(n)
        elif kind == 2:
            spot = len(want)
            raw = message(deal, field, depth - 1, want, nested) if field in nested else deal.randbytes(deal.choice([0, 1, 200]))
            want.insert(spot, (field, 2, None, raw))
            body = varint(len(raw)) + raw
        else:
            raw = deal.randbytes(8 if kind == 1 else 4)
            want.append((field, kind, int.from_bytes(raw, "little"), None))
            body = raw
        out += varint(nth << 3 | kind) + body
    return out


def test_round_trip_and_truncation():
    deal = random.Random(3)
    for _ in range(200):
        want, nested = [], {"1", "2", "1.1", "2.15"}
        data = message(deal, "", 3, want, nested)
        got = list(wire.fields(data, nested))
        if any(w is None for _, w, _, _ in got):
            continue  # a plain field became a message path later on
        assert got == want
        cut = data[: deal.randrange(len(data) + 1)]
        part = [r for r in wire.fields(cut, ()) if r[1] is not None]
        assert part == [r for r in wire.fields(data, ())][: len(part)]


def test_damage_stays_in_its_message():
    inner = b"\x08\x05\x12\x7f"  # a field, then bytes that break off
    data = b"\x12" + varint(len(inner)) + inner + b"\x18\x07"
    assert list(wire.fields(data, {"2"})) == [("2", 2, None, inner), ("2.1", 0, 5, None), ("2", None, None, None), ("3", 0, 7, None)]
    for bad in (b"\x00\x01", b"\x0b", b"\x80" * 11, b"\x08" + b"\xff" * 10, b"\x09\x01", b"\x0d\x01", b"\x0a", b"\x08"):
        assert list(wire.fields(bad)) == [("", None, None, None)]
    assert list(wire.fields(b"")) == []
    deep = b"\x08\x01"
    paths = set()
    for _ in range(3000):
        deep = b"\x0a" + varint(len(deep)) + deep
    path = "1"
    for _ in range(3000):
        paths.add(path)
        path += ".1"
    assert sum(1 for _ in wire.fields(deep, paths)) == 3001


def test_on_spark(spark):
    files = spark.createDataFrame([("a", bytearray(b"\x08" + varint(2**64 - 1) + b"\x12\x01x")), ("b", None), ("c", bytearray(b"")), ("d", bytearray(b"\x12\x09x"))], "path string, content binary")
    got = [tuple(r) for r in wire.wire_fields(files).collect()]
    assert sorted(got, key=str) == sorted([("a", "1", 0, -1, None), ("a", "2", 2, None, bytearray(b"x")), ("d", "", None, None, None)], key=str)
