"""Near-duplicate groups by SimHash, found with bit-sliced comparison.

Texts are fingerprinted in 64 bits; texts whose fingerprints differ in at most
``radius`` bits are linked, and a group is what links reach.

Scale: the corpus is reduced to distinct fingerprints before anything is
compared, so copies cost nothing.  By the pigeonhole rule two fingerprints
within the radius agree on all but ``radius`` of ``radius + 2`` blocks, i.e. on
some pair of blocks; each distinct fingerprint is sent to one bucket for every
pair of blocks.  A bucket with more than ``BUCKET`` fingerprints is keyed again
by the bits it leaves free, which again loses no link, until no bucket can be
larger.  Inside a partition buckets lie side by side and are compared in
vertical bit planes.

Cases: a null text counts as an empty one; a text without words has fingerprint
zero and links like any other; repeated rows fall together; a null doc_id never
names a group while the group has another id; an empty table gives no rows;
other columns are not read.
"""
from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import fresh, written
from .components import components

BITS = 64
#: Fingerprints a bucket holds before it is keyed again by its free bits.
BUCKET = 1 << 15
#: Fingerprints compared with each other at once; a multiple of 64.
TILE = 512
_SEED = 42


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of the word shingles of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), _SEED)
    joined = b" ".join(words)
    starts = np.zeros(len(words), np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    np.cumsum(sizes[:-1] + 1, out=starts[1:])
    ends = starts + sizes
    first, last = starts[:len(words) - width + 1].tolist(), ends[width - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], _SEED) for a, b in zip(first, last)], np.uint64)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (counts * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp) of every row; fp holds the 64 bits as a signed long."""
    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, width) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_hash"), pa.array(fps.view(np.int64))],
                ["doc_id", "text_hash", "fp"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"),
                       F.xxhash64("text").alias("text_hash"))
    return docs.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _split(bits: list[int], parts: int) -> list[list[int]]:
    return [list(x) for x in np.array_split(np.array(bits), parts)]


def _bucket(fp: Column, bits: list[int]) -> Column:
    """The bucket of a fingerprint under a set of bits: the set and the bits in it."""
    kept = fp.bitwiseAND(F.lit(_signed(_mask(bits))))
    return F.struct(F.lit(_signed(_mask(bits))).alias("bits"), kept.alias("kept"))


def _plan(bits_free: list[int], radius: int, spare: int) -> list[tuple[int, ...]]:
    """Sets of bits one of which agrees for any two values within the radius."""
    blocks = _split(bits_free, radius + spare)
    return [tuple(sorted(int(b) for x in pick for b in x))
            for pick in itertools.combinations(blocks, spare)]


def buckets(distinct: DataFrame, radius: int, bucket: int = BUCKET) -> DataFrame:
    """(bits, kept, fp): every distinct fingerprint in all its buckets, large ones split."""
    if radius == 0:
        return distinct.limit(0).select(F.lit(0).cast("long").alias("bits"),
                                        F.lit(0).cast("long").alias("kept"), "fp")
    everything = list(range(BITS))
    layer = [(m, [b for b in everything if b not in set(m)]) for m in _plan(everything, radius, 2)]
    rows = distinct.select("fp", F.explode(F.array(*[_bucket(F.col("fp"), m) for m, _ in layer]))
                           .alias("k")).select("k.bits", "k.kept", "fp")
    done = []
    while any((1 << len(free)) > bucket and len(free) > radius for _, free in layer):
        hot = written(rows.groupBy("bits", "kept").count().where(F.col("count") > bucket).drop("count"), "simhash-hot")
        if hot.isEmpty():
            break
        done.append(rows.join(hot, ["bits", "kept"], "left_anti"))
        # free bits within the radius in one of radius + 1 blocks: that block agrees
        finer = {m: list(_finer(m, free, radius)) for m, free in layer}
        masks = F.create_map(*[x for m, more in finer.items() for x in (
            F.lit(_signed(_mask(m))), F.array(*[F.lit(_signed(_mask(n))) for n, _ in more]))])
        keys = F.transform(F.element_at(masks, F.col("bits")), lambda n: F.struct(
            n.alias("bits"), F.col("fp").bitwiseAND(n).alias("kept")))
        big = rows.join(hot, ["bits", "kept"], "left_semi").select("fp", F.explode(keys).alias("k"))
        # two buckets may lead to one and the same finer bucket
        rows = written(big.select("k.bits", "k.kept", "fp").distinct(), "simhash-finer")
        layer = list({n: free for more in finer.values() for n, free in more}.items())
    out = rows
    for d in done:
        out = out.unionByName(d)
    return out


def _finer(m, free, radius):
    for block in _split(free, radius + 1):
        more = [int(b) for b in block]
        yield tuple(sorted([*m, *more])), [b for b in free if b not in set(more)]


def planes(fps: np.ndarray) -> np.ndarray:
    """Vertical store: word w of plane b holds bit b of fingerprints 64w to 64w+63."""
    padded = np.zeros(-(-len(fps) // 64) * 64, np.uint64)
    padded[:len(fps)] = fps
    bits = np.unpackbits(padded.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1,
                         bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def near(queries: np.ndarray, sliced: np.ndarray, radius: int) -> np.ndarray:
    """Bits of the sliced fingerprints within ``radius`` (at most 2) of each query.

    All distances are counted at once in two bit planes (ones, twos) with a
    carry-save step for each plane of the fingerprints; a third plane keeps who
    has left the radius.  Words, and queries, whose candidates have all left
    are not updated again.
    """
    n, words = len(queries), sliced.shape[1]
    out = np.zeros((n, words), np.uint64)
    rows, cols = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(words), indexing="ij"))
    ones = np.zeros(len(rows), np.uint64)
    twos, over = ones.copy(), ones.copy()
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for b in range(BITS):
        flip = np.where((queries >> np.uint64(b)) & np.uint64(1), full, np.uint64(0))
        differs = sliced[b][cols] ^ flip[rows]
        carry = ones & differs
        ones ^= differs
        over |= twos & carry
        twos ^= carry
        if b % 8 == 7:
            alive = (over | _beyond(ones, twos, radius)) != full
            if not alive.all():
                rows, cols, ones, twos, over = (x[alive] for x in (rows, cols, ones, twos, over))
                if not len(rows):
                    return out
    out[rows, cols] = ~(over | _beyond(ones, twos, radius))
    return out


def _beyond(ones, twos, radius):
    return {0: ones | twos, 1: twos, 2: twos & ones}[radius]


def _pairs(left: np.ndarray, right: np.ndarray, radius: int):
    """(i, j) of left and right within the radius of each other."""
    hits = near(left, planes(right), radius)
    at = np.unpackbits(hits.astype("<u8").view(np.uint8).reshape(len(left), -1), axis=1,
                       bitorder="little")[:, :len(right)]
    return np.nonzero(at)


def _roots(parent: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    at = parent[nodes]
    while (parent[at] != at).any():
        at = parent[at]
    return at


def _fold(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Union of all pairs: every root takes its least partner, until no pair has two roots."""
    while len(i):
        ri, rj = _roots(parent, i), _roots(parent, j)
        apart = ri != rj
        i, j, low, high = i[apart], j[apart], np.minimum(ri, rj)[apart], np.maximum(ri, rj)[apart]
        np.minimum.at(parent, high, low)


def linked(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside the buckets of sorted ``keys``: each fingerprint with its first relative.

    A bucket's links are folded to one per fingerprint, so no bucket gives more
    rows than it holds.
    """
    parent = np.arange(len(fps))
    ends = np.searchsorted(keys, keys, side="right") if len(keys) else keys
    for a in range(0, len(fps), TILE):
        stop = min(a + TILE, len(fps))
        for c in range(a, int(ends[stop - 1]), TILE):
            d = min(c + TILE, len(fps))
            i, j = _pairs(fps[a:stop], fps[c:d], radius)
            above = i + a < j + c
            _fold(parent, i[above] + a, j[above] + c)
    roots = _roots(parent, np.arange(len(fps)))
    moved = roots != np.arange(len(fps))
    return fps[moved], fps[roots[moved]]


def links(distinct: DataFrame, radius: int = 2, bucket: int = BUCKET) -> DataFrame:
    """(a, b): fingerprints that reach each other inside one bucket; no link is lost."""
    def run(batches):
        held_bits, held_kept, held_fp = [], [], []
        rest = (np.zeros(0, np.int64),) * 3

        def compare(bits, kept, fp):
            if not len(fp):
                return
            new = np.ones(len(fp), bool)
            new[1:] = (bits[1:] != bits[:-1]) | (kept[1:] != kept[:-1])
            key = np.cumsum(new)
            shared = np.bincount(key)[key] > 1
            key, fp = key[shared], fp[shared]
            a, b = linked(key, fp.view(np.uint64), radius)
            if len(a):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            bits, kept, fp = (np.concatenate([r, c]) for r, c in zip(rest, cols))
            if not len(fp):
                continue
            # the last bucket may go on in the next batch
            tail = (bits != bits[-1]) | (kept != kept[-1])
            cut = int(np.flatnonzero(tail)[-1]) + 1 if tail.any() else 0
            yield from compare(bits[:cut], kept[:cut], fp[:cut])
            rest = (bits[cut:], kept[cut:], fp[cut:])
        yield from compare(*rest)

    found = (buckets(distinct, radius, bucket).repartition("bits", "kept")
             .sortWithinPartitions("bits", "kept", "fp"))
    return found.mapInArrow(run, "a long, b long")


def groups(prints: DataFrame, radius: int = 2, bucket: int = BUCKET) -> DataFrame:
    """(fp, root, component_id) of each distinct fingerprint: its group's least fingerprint and doc_id."""
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    found = written(links(distinct.select("fp"), radius, bucket), "simhash-links")
    joined = components(found)  # (node, root), only for fingerprints with a link
    rooted = distinct.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", "root")
    least = rooted.where("root is not null").groupBy("root").agg(F.min("first_id").alias("least"))
    alone = rooted.where("root is null").select("fp", F.col("fp").alias("root"), F.col("first_id").alias("component_id"))
    return alone.unionByName(rooted.where("root is not null").join(least, "root").select(
        "fp", "root", F.col("least").alias("component_id")))


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id) of every row of ``docs``.

    ``root`` tells groups apart; ``component_id`` is the least doc_id of the
    group, which two groups share where an id stands for several texts.
    """
    prints = written(fingerprints(docs, width), "simhash-prints")
    return prints.join(groups(prints, radius, bucket), "fp", "left").select(
        "doc_id", "text_hash", "fp", "root", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def one_of_each(docs: DataFrame, width: int = 3, radius: int = 2, bucket: int = BUCKET) -> DataFrame:
    """The rows of ``docs``, whole, without all but one of each group.

    The row with the least doc_id stays (an id before none), then the one with the
    least hash of its text.  Rows alike in id and text are one row first; that
    choice ranks inside each task before the shuffle, so many copies of one row
    do not meet.
    """
    found = near_duplicates(docs, width, radius, bucket)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    own_id, own_hash, place, kept_id, kept_hash = fresh(docs, "own_id", "own_hash", "place", "kept_id", "kept_hash")
    kept = found.groupBy("root").agg(first).select(
        F.col("first.doc_id").alias(kept_id), F.col("first.text_hash").alias(kept_hash))
    keyed = docs.withColumns({own_id: F.col("doc_id").cast("long"), own_hash: F.xxhash64("text")})
    ordered = [F.col(f"`{f.name}`") for f in docs.schema
               if f.name != "text" and "map<" not in f.dataType.simpleString()]
    alike = Window.partitionBy(own_id, own_hash).orderBy(*ordered)
    single = keyed.withColumn(place, F.row_number().over(alike)).where(F.col(place) == 1)
    match = F.col(own_id).eqNullSafe(F.col(kept_id)) & (F.col(own_hash) == F.col(kept_hash))
    return single.join(kept, match, "left_semi").drop(own_id, own_hash, place)
