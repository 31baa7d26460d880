"""Harmonic packing: pieces of reciprocal lengths, a fixed number of them to a sequence.

Class k has the pieces that fit k times into a sequence.  Documents may be cut,
so they are cut where a class is filled to its brim: into whole sequences and,
of what is left over, the largest piece of ``size / 2 ** j`` that fits, again and
again.  The sequences of class k then hold exactly k pieces and no padding.

Every worker fills the sequences of its own documents: an open sequence per
class, closed at its k-th piece.  What a worker has left at the end is laid out
from long to short, which again fills whole sequences, and the last one, not
full, is divided into sequences whose lengths are powers of two, which are not
padded.  So nothing is padded at all, at the price of some ten short sequences
a worker.

Scale: one pass, no shuffle, and no worker waits for another.  A worker holds
the open sequences, fewer than ``2 * size`` pieces together, and one document's ids.

Cases: null text is empty text, which is packed as its end id; repeated rows are
packed as often as they come; a null doc_id stays null; an empty table gives no
rows; other columns are not read.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .tokens import default_path, encoder

SIZE, END_ID = 1024, 0
#: Bits for the sequences of a task.
_PER_TASK = 40


def cuts(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: each as long as fits, of a length in a class."""
    out = [(at, size) for at in range(0, n - size + 1, size)]
    at, piece = n - n % size, size // 2
    while at < n:
        if piece <= n - at:
            out.append((at, piece))
            at += piece
        piece //= 2
    return out


class Bins:
    """The open sequences of one worker."""

    def __init__(self, size: int, first: int):
        self.size, self.next = size, first
        self.open: dict[int, list] = {}

    def _numbered(self, rows: list) -> list[tuple]:
        """Rows (with their length second) as one sequence: (row, sequence, offset)."""
        out, at = [], 0
        for row, n in rows:
            out.append((row, self.next, at))
            at += n
        self.next += 1
        return out

    def add(self, row, n: int) -> list[tuple]:
        """Put a piece in; the pieces of its sequence once that is full."""
        held = self.open.setdefault(n, [])
        held.append((row, n))
        if len(held) * n < self.size:
            return []
        del self.open[n]
        return self._numbered(held)

    def close(self) -> list[tuple]:
        """The pieces of what is left: whole sequences, then one for each power of two."""
        rest = [x for n in sorted(self.open, reverse=True) for x in self.open[n]]
        left, out, held, room = sum(n for _, n in rest), [], [], 0
        for row, n in rest:
            if not held:
                room = self.size if left >= self.size else 1 << left.bit_length() - 1
            held.append((row, n))
            left, room = left - n, room - n
            if not room:
                out += self._numbered(held)
                held = []
        self.open = {}
        return out


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset) of every piece of ``docs``.

    ``size`` must be a power of two.  ``ids`` are little-endian unsigned 32-bit integers.
    """
    if size < 1 or size & size - 1:
        raise ValueError("size must be a power of two")
    path = path or default_path()
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        enc = encoder(path)
        bins = Bins(size, TaskContext.get().partitionId() << _PER_TASK)

        def rows(placed):
            for at in range(0, len(placed), 1000):  # a piece is bounded, so these batches are
                cols = zip(*((*row, seq, off) for row, seq, off in placed[at:at + 1000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

        for b in batches:
            placed: list[tuple] = []
            for doc, ids in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text"))):
                ids += end
                total = len(ids) // 4
                for at, n in cuts(total, size):
                    placed += bins.add((doc, at, n, ids[4 * at:4 * (at + n)], total), n)
                if len(placed) > 20_000:
                    yield from rows(placed)
                    placed = []
            yield from rows(placed)
        yield from rows(bins.close())

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def digests(docs: DataFrame, path: str | None = None, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """As ``pack``, the ids as their checksum."""
    return pack(docs, path, size, end_id).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
