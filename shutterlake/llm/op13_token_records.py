"""Token ids in files of length-delimited binary records, with an index of offsets.

Texts are encoded by the public tokenizers library. Its normalisation and its
splitting never join what white space separates, so a text is cut at ASCII white
space, each distinct piece is encoded by the library once a task, and the ids of
a text are those of its pieces one after the other.

``TokenRecords`` is a data source for the files. A folder holds, for each task
that wrote, a file of records and a file of index entries, and one manifest that
lists the files in order with their records and tokens. The manifest is written
when all tasks have ended, so files of failed or repeated attempts are in no
manifest and are never read.

* record: length of the payload (8 bytes), masked checksum of these 8 bytes (4),
  the payload, masked checksum of the payload (4)
* payload: flags (1 byte: 1 if there is a doc_id, 2 if ids take 2 bytes), doc_id
  (8), ids (2 bytes each if all are below 65536, else 4)
* index entry: offset of the record, tokens of the file before it, its tokens (8 each)
* all numbers are little-endian; a masked checksum is the CRC-32 turned right by
  15 bits plus a constant, so that a checksum over data that holds checksums
  stays sound

Reading verifies every checksum. Slices of a file are read by separate tasks,
which find their first record through the index. With the option ``seed`` the
records come in a shuffled order: slices are permuted over the tasks and each
task reads the records of several slices in a permuted order, by their offsets.

Defined cases: null text is empty and has the end id alone; documents are in
ascending order of doc_id, null first; rows that repeat a doc_id are in an order
of their texts; every row is a record of its own; an empty table makes a
manifest of no files; other columns are ignored.
"""

from __future__ import annotations

import gc
import json
import os
import re
import struct
import sys
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import tables_of, text_or_empty
from .op05_bpe import byte_signs

END_ID = 2
#: Pieces whose ids a task remembers (it forgets all when full), and their longest length in bytes.
REMEMBERED, PIECE_BYTES = 500_000, 64
#: Pieces that the library encodes in one call, and signs that end a word.
CALL, SIGNS = 4096, b".,;:!?%&*)#$"
#: Bytes of text that a task encodes at once, and that a file is made of, about.
ENCODED_BYTES, FILE_BYTES = 2 << 20, 32 << 20
#: Bytes of a slice of a file that is read by one task, slices that are shuffled together, and bytes of ids in a batch read.
SLICE_BYTES, SHUFFLED_SLICES, BATCH_BYTES = 32 << 20, 8, 4 << 20

MANIFEST = "manifest.json"
_HEAD, _SUM, _NAME, _ENTRY = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<Bq"), struct.Struct("<QQQ")
SCHEMA = "doc_id long, start long, n_tokens long, ids binary"


# ---- encoding --------------------------------------------------------------------------------------


def _ids(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()


class PieceEncoder:
    """Ids of texts by the tokenizers library, piece by piece."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.signs = dict(enumerate(byte_signs()))
        self.known: dict[bytes, bytes] = {}

    def _learn(self, new: set[bytes]) -> None:
        """Put the ids of new pieces in ``known``.

        The library lowers letters and separates words from signs, so pieces
        that differ in case or in the signs behind a word share what they can.
        Latin words, which the library does not cut, go to its model at once.
        """
        known, by_model = self.known, self.library.model.tokenize
        joined: list[tuple[bytes, bytes, bytes]] = []
        todo: set[bytes] = set()

        def seen(x: bytes, letters: str) -> None:
            if x in known:
                return
            if x.isalpha():  # letters of ASCII, lower-case here
                known[x] = _ids([t.id for t in by_model(x.decode("ascii"))])
                return
            if letters and letters.isalpha() and max(letters) < "\u0250":  # Latin letters, as the library writes their bytes
                same = letters.encode("utf-8")  # of all words that differ in case
                ids = known.get(same)
                if ids is None:
                    ids = _ids([t.id for t in by_model(same.decode("latin-1").translate(self.signs))])
                    if len(same) <= PIECE_BYTES:
                        known[same] = ids
                known[x] = ids
                return
            todo.add(x)

        for p in new:
            plain = p.isascii()
            low = p.lower() if plain else p  # letters that compose depend on case
            word = low.rstrip(SIGNS)
            if plain and word.isalpha():  # most pieces: a word and no more, or signs that are known
                ids = known.get(word)
                if ids is None:
                    ids = known[word] = _ids([t.id for t in by_model(word.decode("ascii"))])
                if len(word) == len(p):
                    if low != p:
                        known[p] = ids
                    continue
                signs = known.get(low[len(word) :])
                if signs is not None:
                    known[p] = ids + signs
                    continue
            letters = "" if plain else unicodedata.normalize("NFC", word.decode("utf-8")).lower()
            if b"<|" in p:  # may be a special token
                todo.add(p)
            elif len(word) == len(low):
                seen(low, letters)
                if low != p:
                    joined.append((p, low, b""))
            elif word and (word[-1:].isalnum() or letters and letters[-1].isalpha()):
                seen(word, letters)
                seen(low[len(word) :], "")
                joined.append((p, word, low[len(word) :]))
            else:
                todo.add(p)
        rest = list(todo)
        for a in range(0, len(rest), CALL):
            part = rest[a : a + CALL]
            found = self.library.encode_batch_fast([p.decode("utf-8") for p in part], add_special_tokens=False)
            known.update((p, _ids(e.ids)) for p, e in zip(part, found, strict=True))
        for p, word, signs in joined:
            known[p] = known[word] + known[signs] if signs else known[word]

    def encode(self, texts: list[bytes], end_id: int) -> list[bytes]:
        """Little-endian ids of each text, and the end id."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, pieces = self.known, [t.split() for t in texts]
        found = [list(map(known.get, line)) for line in pieces]
        holes = [[k for k, ids in enumerate(row) if ids is None] for row in found]
        new = {line[k] for line, hole in zip(pieces, holes, strict=True) for k in hole}
        self._learn(new)
        end = _ids([end_id])
        for line, row, hole in zip(pieces, found, holes, strict=True):
            for k in hole:
                row[k] = known[line[k]]
            row.append(end)
        out = [b"".join(row) for row in found]
        for p in [p for p in new if len(p) > PIECE_BYTES]:
            for x in (p, p.lower(), p.rstrip(SIGNS), p.lower().rstrip(SIGNS)):
                known.pop(x, None)
        return out


@lru_cache(maxsize=2)
def _encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def encoded_ids(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, ids (little-endian, 4 bytes each, with the end id) in the order of ``docs``. ``path``: the vocabulary file, present on every executor."""

    def work(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        gc.disable()  # nothing here is cyclic, and the pieces that are remembered would be walked again and again
        for batch in found:
            texts = batch.column("text").cast(pa.binary())
            ends = np.cumsum(pc.binary_length(texts).to_numpy())
            a = 0
            while a < len(texts):  # as many texts as hold ENCODED_BYTES, or one
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + ENCODED_BYTES, "right")))
                ids = encoder.encode(texts.slice(a, b - a).to_pylist(), end_id)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(ids, pa.binary())], ["doc_id", "ids"])
                a = b

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(work, "doc_id long, ids binary")


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id, text in ascending order of doc_id over the partitions, each of about FILE_BYTES of text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    wide = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = max(1, -(-size // FILE_BYTES), min(-(-size // (1 << 20)), wide))
    # the last key only deals rows that repeat doc_id and text over the partitions
    rows = rows.withColumns({"_text": F.xxhash64("text"), "_at": F.monotonically_increasing_id()})
    dealt = rows.repartitionByRange(files, F.asc_nulls_first("doc_id"), "_text", "_at")
    return dealt.sortWithinPartitions(F.asc_nulls_first("doc_id"), "_text", "text").select("doc_id", "text")


# ---- files -----------------------------------------------------------------------------------------


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    head = _HEAD.pack(len(payload))
    return b"".join((head, _SUM.pack(masked(head)), payload, _SUM.pack(masked(payload))))


def unframed(take) -> bytes:
    """The payload of the record that ``take(n)`` gives the bytes of."""
    head, check = take(8), take(4)
    if len(head) < 8 or len(check) < 4 or _SUM.unpack(check)[0] != masked(head):
        raise ValueError("damaged length of a token record")
    payload, check = take(_HEAD.unpack(head)[0]), take(4)
    if len(payload) < _HEAD.unpack(head)[0] or len(check) < 4 or _SUM.unpack(check)[0] != masked(payload):
        raise ValueError("damaged token record")
    return payload


def packed(doc: int | None, ids: bytes) -> bytes:
    """The payload of a document's ids (4 bytes each)."""
    wide = np.frombuffer(ids, "<u4")
    narrow = not len(wide) or int(wide.max()) < 1 << 16
    return _NAME.pack((doc is not None) + 2 * narrow, doc or 0) + (wide.astype("<u2").tobytes() if narrow else ids)


def unpacked(payload: bytes) -> tuple[int | None, bytes]:
    """doc_id and ids (4 bytes each) of a payload."""
    flags, doc = _NAME.unpack_from(payload)
    ids = payload[_NAME.size :]
    return doc if flags & 1 else None, np.frombuffer(ids, "<u2").astype("<u4").tobytes() if flags & 2 else ids


def _files(folder: str):
    """(file system, path) of a folder of a shared store or of this machine."""
    from pyarrow import fs

    if "://" in folder and not folder.startswith("file:"):
        return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", folder))
    return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", folder)


@dataclass
class Written(WriterCommitMessage):
    """A pair of files: the partition that wrote it, its name, its records, tokens and bytes."""

    part: int
    name: str
    records: int
    tokens: int
    bytes: int


@dataclass
class Slice:
    """Records [first, first + records) of a file, which has ``start`` tokens before it."""

    name: str
    first: int
    records: int
    start: int


class Slices(InputPartition):
    def __init__(self, slices: list[Slice], seed: int | None):
        self.slices, self.seed = slices, seed


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        out = Written(part, f"part-{part:06d}-{uuid.uuid4().hex}", 0, 0, 0)
        store, path = _files(self.folder)
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/{out.name}.tokens") as data, store.open_output_stream(f"{path}/{out.name}.index") as index:
            for batch in iterator:
                for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                    record = framed(packed(doc, ids))
                    data.write(record)
                    index.write(_ENTRY.pack(out.bytes, out.tokens, len(ids) // 4))
                    out.records, out.tokens, out.bytes = out.records + 1, out.tokens + len(ids) // 4, out.bytes + len(record)
        return out

    def commit(self, messages: list[Written | None]) -> None:
        files, start = [], 0
        for m in sorted((m for m in messages if m is not None and m.records), key=lambda m: m.part):
            files.append({"name": m.name, "records": m.records, "tokens": m.tokens, "bytes": m.bytes, "start": start})
            start += m.tokens
        store, path = _files(self.folder)
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/{MANIFEST}") as out:
            out.write(json.dumps({"records": sum(f["records"] for f in files), "tokens": start, "files": files}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, path = _files(self.folder)
        for m in messages:
            for kind in ("tokens", "index") if m is not None else ():
                store.delete_file(f"{path}/{m.name}.{kind}")


class _Reader(DataSourceReader):
    def __init__(self, folder: str, seed: int | None, slice_bytes: int):
        self.folder, self.seed, self.slice_bytes = folder, seed, slice_bytes

    def partitions(self) -> list[Slices]:
        store, path = _files(self.folder)
        with store.open_input_stream(f"{path}/{MANIFEST}") as f:
            files = json.loads(f.read())["files"]
        slices = []
        for f in files:
            most = max(1, f["records"] * self.slice_bytes // f["bytes"])
            slices += [Slice(f["name"], a, min(most, f["records"] - a), f["start"]) for a in range(0, f["records"], most)]
        if self.seed is None:
            return [Slices([s], None) for s in slices]
        order = np.random.default_rng(self.seed).permutation(len(slices))
        return [Slices([slices[i] for i in order[a : a + SHUFFLED_SLICES]], self.seed + a) for a in range(0, len(slices), SHUFFLED_SLICES)]

    def read(self, partition: Slices | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a manifest of no files
            return
        store, path = _files(self.folder)
        wanted = []  # (slice, index entry) of each record
        for s in partition.slices:
            with store.open_input_file(f"{path}/{s.name}.index") as f:
                entries = np.frombuffer(f.read_at(s.records * _ENTRY.size, s.first * _ENTRY.size), "<u8").reshape(-1, 3).tolist()
            wanted += [(s, e) for e in entries]
        if partition.seed is not None:
            wanted = [wanted[i] for i in np.random.default_rng(partition.seed).permutation(len(wanted))]
        opened: dict[str, pa.NativeFile] = {}
        rows: list[tuple] = []
        held, at = 0, None
        for s, (offset, before, n) in wanted:
            if s.name not in opened:
                opened[s.name] = store.open_input_file(f"{path}/{s.name}.tokens")
            f = opened[s.name]
            if at != (s.name, offset):
                f.seek(offset)
            payload = unframed(f.read)
            at = (s.name, offset + len(payload) + 16)
            doc, ids = unpacked(payload)
            if len(ids) != 4 * n:
                raise ValueError("the index disagrees with a token record")
            rows.append((doc, s.start + before, n, ids))
            held += len(ids)
            if held >= BATCH_BYTES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)
        for f in opened.values():
            f.close()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    doc, start, n, ids = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])


class TokenRecords(DataSource):
    """``format("token_records")``: writes doc_id, ids; reads doc_id, start, n_tokens, ids. Options: path; seed, for a shuffled order; slice_bytes."""

    @classmethod
    def name(cls) -> str:
        return "token_records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options["seed"]) if "seed" in self.options else None, int(self.options.get("slice_bytes", SLICE_BYTES)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"])


def write_records(docs: DataFrame, vocabulary: str, folder: str, end_id: int = END_ID) -> None:
    """Encode ``docs`` and write them to a new folder, in ascending order of doc_id."""
    docs.sparkSession.dataSource.register(TokenRecords)
    encoded_ids(in_order(docs), vocabulary, end_id).write.format("token_records").mode("append").save(folder)


def read_records(spark: SparkSession, folder: str, seed: int | None = None, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, start, n_tokens, ids of a folder's records; with ``seed`` in a shuffled order."""
    spark.dataSource.register(TokenRecords)
    reader = spark.read.format("token_records").option("slice_bytes", slice_bytes)
    return (reader if seed is None else reader.option("seed", seed)).load(folder)


def written_and_read(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files that it was written to."""
    folder = f"{tables_of(docs.sparkSession)}/token-records-{uuid.uuid4().hex}"
    write_records(docs, vocabulary, folder)
    return read_records(docs.sparkSession, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
