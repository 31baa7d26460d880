"""Token ids in seekable compressed files.

A file holds documents in ascending order of doc_id: independent zstandard
frames of whole documents, a skippable frame that lists the documents, and the
seek table of the zstandard seekable format at the end - compressed size, size
and checksum (low half of XXH64) of every frame.  A reader finds a document in
the list and decompresses its frame only.

Scale: rows are dealt into ranges of (doc_id, hash of the text), so equal ids do
not gather in one task; each task writes one file as its rows come and each task
of the read takes files of its own.  A lost task writes a new file; files whose
rows were not committed are never listed.

Cases: null text is empty text, which is its end id; a null doc_id comes first
and stays null; equal doc_ids come in the order of their text's hash, then text;
an empty table gives no rows; other columns are not read.
"""
from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as afs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from packledger.durable import scratch_path

from .common import written
from .tokens import default_path, encoder

#: Bytes of ids after which a frame is closed; a document is never divided between frames.
FRAME = 1 << 18
END_ID = 0
# Fixed values of the zstandard seekable format.
_SKIP, _SKIP_LIST, _FOOTER = 0x184D2A5E, 0x184D2A5D, 0x8F92EAB1


def _open(path: str) -> tuple[afs.FileSystem, str]:
    return afs.FileSystem.from_uri(path)


class Writer:
    """Writes documents to one file; use as a context."""

    def __init__(self, path: str, level: int = 3):
        store, at = _open(path)
        store.create_dir(at.rsplit("/", 1)[0], recursive=True)
        self.out = store.open_output_stream(at, compression=None)
        self.zstd = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.held: list[bytes] = []
        self.size = 0
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int, int, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """Append a document; ids are little-endian unsigned 32-bit integers."""
        self.docs.append((0 if doc_id is None else doc_id, doc_id is not None, len(self.frames), len(ids) // 4))
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= FRAME:
            self._close_frame()

    def _close_frame(self) -> None:
        if self.held:
            raw = b"".join(self.held)
            packed = self.zstd.compress(raw)
            self.out.write(packed)
            self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.held, self.size = [], 0

    def __enter__(self) -> "Writer":
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self._close_frame()
            listed = np.array(self.docs, np.int64).reshape(-1, 4)
            body = self.zstd.compress(listed.astype("<i8").T.tobytes())
            self.out.write(struct.pack("<II", _SKIP_LIST, len(body)) + body)
            table = b"".join(struct.pack("<III", *f) for f in self.frames)
            self.out.write(struct.pack("<II", _SKIP, len(table) + 9) + table
                           + struct.pack("<IBI", len(self.frames), 0x80, _FOOTER))
        self.out.close()


class Reader:
    """Reads the seek table and document list of a file, and frames when asked for."""

    def __init__(self, path: str):
        store, at = _open(path)
        self.file = store.open_input_file(at)
        end = self.file.size()
        frames, flags, magic = struct.unpack("<IBI", self._bytes(end - 9, 9))
        if magic != _FOOTER or not flags & 0x80:
            raise ValueError(f"no seek table with checksums in {path}")
        table = self._bytes(end - 9 - 12 * frames, 12 * frames)
        self.frames = list(struct.iter_unpack("<III", table))
        self.starts = np.concatenate(([0], np.cumsum([f[0] for f in self.frames]))).astype(int).tolist()
        list_at = self.starts[-1]
        size = struct.unpack("<II", self._bytes(list_at, 8))[1]
        raw = zstandard.ZstdDecompressor().decompress(self._bytes(list_at + 8, size), max_output_size=0)
        ids, known, frame, n = np.frombuffer(raw, "<i8").reshape(4, -1)
        self.doc_ids, self.known, self.frame, self.n_ids = ids, known.astype(bool), frame, n

    def _bytes(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at)

    def read_frame(self, k: int) -> bytes:
        packed, size, check = self.frames[k]
        raw = zstandard.ZstdDecompressor().decompress(self._bytes(self.starts[k], packed), max_output_size=size)
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return raw

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int | None, bytes]]:
        """(doc_id, ids) in file order; with ``wanted``, only those and only their frames."""
        take = np.ones(len(self.doc_ids), bool)
        if wanted is not None:
            take = np.isin(self.doc_ids, np.fromiter(wanted, np.int64)) & self.known
        ends = np.cumsum(self.n_ids)
        for k in np.unique(self.frame[take]):
            rows = np.flatnonzero(self.frame == k)
            raw, base = self.read_frame(int(k)), ends[rows[0]] - self.n_ids[rows[0]]
            for r in rows[take[rows]]:
                a, b = 4 * int(ends[r] - self.n_ids[r] - base), 4 * int(ends[r] - base)
                yield (int(self.doc_ids[r]) if self.known[r] else None), raw[a:b]

    def close(self) -> None:
        self.file.close()


def write(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the ids of every row below ``folder``; (ordinal, file, docs, ids) of the files.

    Files in the order of ``ordinal`` hold the documents in ascending order.
    """
    path = path or default_path()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        enc, made = encoder(path), None
        part = TaskContext.get().partitionId()
        file = f"{folder}/ids-{part:06d}-{uuid.uuid4().hex}.zst"
        docs_in = ids_in = 0
        for b in batches:
            if not b.num_rows:
                continue
            made = made or Writer(file)
            for doc, ids in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text"))):
                made.add(doc, ids + end)
                docs_in, ids_in = docs_in + 1, ids_in + len(ids) // 4 + 1
        if made:
            made.__exit__(None)
            yield pa.RecordBatch.from_pydict({"ordinal": pa.array([part], pa.int32()), "file": [file],
                                              "docs": [docs_in], "ids": [ids_in]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    dealt = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    return written(dealt.select("doc_id", "text").mapInArrow(
        run, "ordinal int, file string, docs long, ids long"), "token-files")


def read(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files.

    ``start`` counts the ids of all documents before it.
    """
    before = Window.partitionBy(F.lit(0)).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    listed = files.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))

    def run(batches):
        for b in batches:
            for file, start in zip(b.column("file").to_pylist(), b.column("start").to_pylist()):
                source = Reader(file)
                out = []
                for doc, ids in source.documents():
                    out.append((doc, start, len(ids) // 4, zlib.crc32(ids)))
                    start += len(ids) // 4
                source.close()
                for at in range(0, len(out), 10_000):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int64()) for c in zip(*out[at:at + 10_000])],
                        ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, files.count())
    return listed.select("file", "start").repartition(n).mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the ids of ``docs`` to files of their own and read them back."""
    return read(write(docs, scratch_path(docs.sparkSession, "ids"), path, end_id))
