"""Best-fit packing of documents into sequences, planned over a histogram of lengths.

A document's ids end with ``end_id``.  Documents longer than a sequence are cut
into pieces of the sequence's size, the first taking what is left over.  Pieces
are counted by length; best-fit decreasing runs over those counts - a class of
sequences with equal room is filled in one step however many there are - and
gives, for each length, runs of slots.  The pieces of a length then take the
slots in order of their rank.

Scale: the histogram has at most ``size`` entries and the plan's steps do not
depend on the number of documents.  Ranks are counted within (length, lane),
lanes dealing out the rows of any length evenly, and the counts of the lanes
before are added; only narrow rows are shuffled.

Cases: null text is empty text, which is packed as its end id; repeated rows are
packed as often as they come; a null doc_id stays null; an empty table gives no
rows; other columns are not read.
"""
from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import written
from .tokens import default_path, encoder

SIZE, END_ID, LANES = 1024, 2, 4096


def cuts(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids."""
    first = n % size or size
    if n <= size:
        return [(0, n)]
    return [(0, first), *((at, size) for at in range(first, n, size))]


def pieces(docs: DataFrame, path: str | None = None, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids, lane): the pieces of every row of ``docs``.

    ``ids`` are little-endian unsigned 32-bit integers; ``lane`` deals rows out evenly.
    """
    path = path or default_path()
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids", "lane"]

    def run(batches):
        enc = encoder(path)
        lane = TaskContext.get().partitionId() * 97
        for b in batches:
            out: list[tuple] = []
            for doc, ids in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text"))):
                ids += end
                for k, (at, n) in enumerate(cuts(len(ids) // 4, size)):
                    out.append((doc, k, at, n, ids[4 * at:4 * (at + n)], lane % LANES))
                    lane += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32()]
            for at in range(0, len(out), 500):  # a piece is bounded, so these batches are
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out[at:at + 500]), kinds)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids binary, lane int")


@dataclass
class Plan:
    """Runs of slots: ranks from ``rank`` on of a length go to sequences from ``sequence`` on."""
    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def slots(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces by length and rank from 0."""
        key = (self.length << 44) | self.rank
        at = np.searchsorted(key, (length << 44) | rank, side="right") - 1
        return self.sequence[at] + rank - self.rank[at], self.offset[at]


def plan(histogram: Mapping[int, int], size: int = SIZE) -> Plan:
    """Best-fit decreasing over counts.

    Sequences with equal room form classes of runs (first sequence, how many).  A
    length goes to the class with the least room that holds it; a sequence there
    takes as many pieces of the length as fit, since after the first it has the
    least room of all that still hold one.
    """
    classes: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    runs: list[tuple[int, int, int, int]] = []
    used = 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in classes:
                classes[room] = []
                insort(rooms, room)
            classes[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = classes[room].pop()
                if not classes[room]:
                    del classes[room], rooms[at]
            else:
                room, first, n = size, used, -(-left // (size // length))
                used += n
            fit = room // length
            whole = min(n, left // fit)
            for k in range(fit if whole else 0):
                runs.append((length, rank, first, size - room + k * length))
                rank += whole
            left -= whole * fit
            put(room - fit * length, first, whole)
            first, n = first + whole, n - whole
            if n and left:  # what is left does not fill one sequence as far as it could
                for k in range(left):
                    runs.append((length, rank, first, size - room + k * length))
                    rank += 1
                put(room - left * length, first, 1)
                first, n, left = first + 1, n - 1, 0
            put(room, first, n)
    cols = [np.array(c, np.int64) for c in zip(*sorted(runs))] or [np.zeros(0, np.int64)] * 4
    return Plan(*cols, used)


def place(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """The rows (length, lane and any other columns) with sequence_id and offset.

    ``rows`` must be a stored table: it is read once for the histogram and once to place.
    """
    counted = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    planned = rows.sparkSession.sparkContext.broadcast(plan(counted, size))
    sizes = rows.groupBy("length", "lane").agg(F.count(F.lit(1)).alias("held"))
    before = Window.partitionBy("length").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "lane", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"))
    here = Window.partitionBy("length", "lane").orderBy("doc_id", "piece", "start")
    ranked = rows.withColumn("r", F.row_number().over(here)).join(offsets, ["length", "lane"])
    keep = [c for c in rows.columns if c != "lane"]
    ranked = ranked.select(*keep, (F.col("r") + F.col("before") - 1).alias("rank"))

    def run(batches):
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            if not len(length):
                continue
            seq, off = planned.value.slots(length, rank)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in keep), pa.array(seq), pa.array(off)], [*keep, "sequence_id", "offset"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(run, f"{shape}, sequence_id long, offset long")


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences of placed pieces that carry their ids.

    At most ``size`` pieces meet in a sequence, so the groups are small.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset) of every piece of ``docs``.

    The ids stay in the stored pieces while places are found, and are joined to them.
    """
    made = pieces(docs, path, size, end_id).withColumn("row", F.monotonically_increasing_id())
    stored = written(made, "pieces")
    placed = place(stored.drop("ids"), size)
    return placed.join(stored.select("row", "ids"), "row").select(
        "doc_id", "piece", "start", "length", "ids", "sequence_id", "offset")


#: A window of documents is packed once it has so many pieces, or bytes of ids.
WINDOW, WINDOW_BYTES = 1 << 14, 1 << 24


def pack_in_order(docs: DataFrame, path: str | None = None, size: int = SIZE, end_id: int = END_ID,
                  window: int = WINDOW) -> DataFrame:
    """As ``pack``, but a sequence holds documents that stand near each other in the table.

    The rows of a file, in their order, are cut into windows of bounded size, and
    each is packed best-fit over its own histogram as it passes.  So what comes
    first in a stored order comes in the first sequences of its file, and nothing
    is shuffled or planned outside a task.
    """
    path = path or default_path()
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]

    def run(batches):
        enc, used = encoder(path), TaskContext.get().partitionId() << 40
        held: list[tuple] = []
        held_bytes, held_file = 0, None

        def packed():
            nonlocal used, held_bytes
            length = np.array([r[3] for r in held], np.int64)
            order = np.argsort(length, kind="stable")
            rank = np.empty(len(held), np.int64)
            rank[order] = np.arange(len(held)) - np.searchsorted(length[order], length[order], side="left")
            values, counts = np.unique(length, return_counts=True)
            found = plan(dict(zip(values.tolist(), counts.tolist())), size)
            sequence, offset = found.slots(length, rank)
            rows = [(*r, s, o) for r, s, o in zip(held, (sequence + used).tolist(), offset.tolist())]
            used, held_bytes = used + found.sequences, 0
            held.clear()
            for at in range(0, len(rows), 500):  # a piece is bounded, so these batches are
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at:at + 500]), kinds)], names)

        for b in batches:
            files = b.column("file").to_pylist()
            for doc, file, ids in zip(b.column("doc_id").to_pylist(), files, enc.encode(b.column("text"))):
                if held and (file != held_file or len(held) >= window or held_bytes >= WINDOW_BYTES):
                    yield from packed()
                held_file = file
                ids += end
                held_bytes += len(ids)
                held += [(doc, k, at, n, ids[4 * at:4 * (at + n)]) for k, (at, n) in enumerate(cuts(len(ids) // 4, size))]
        if held:
            yield from packed()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.input_file_name()).alias("file")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long")


def digests(docs: DataFrame, path: str | None = None, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """As ``pack``, the ids as their checksum; ids are neither stored nor shuffled."""
    made = pieces(docs, path, size, end_id).select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "lane")
    return place(written(made, "pieces"), size)
