"""One of each group of edited copies: SimHash candidates, confirmed on the shingles themselves.

Texts of which ``SIMILAR`` or more of the different 5-word shingles are shared
are links, and a group is what links reach.  At that similarity some ten of 64
SimHash bits differ, too many for buckets of equal bits.  So texts meet where
two of their ``SEEDS`` least shingle hashes (one for each of as many orders)
agree, which 99.8 in 100 pairs at the threshold do, and more above it.  In a
bucket the SimHashes are compared: a text within ``RADIUS`` bits of an earlier
leader is its candidate, any other becomes a leader.  After a few rounds over all
buckets at once, crowded buckets go on in bit planes, all distances at a time
with carry-save counters.  Candidates are links if their shingles say so.

That joins most copies cheaply, not all: a text is compared with leaders only.
So the links between the groups found are then looked for without loss.  Of two
links each has a shingle of the other among its first fifth and one more, in any
order common to all texts; texts of different groups that share such a shingle,
and whose sizes, places in the order and signatures allow it, are compared as
well, a few of each text first, so that a crowd of links is one group before the
pairs of different groups are all looked at.

Scale: sketches are narrow; a bucket gives one candidate a text.  Crowded keys
are first thinned in parts to their leaders.  Each distinct text with a candidate
is shuffled to its leaders, in parts of bounded size, and compared as it streams by.
The order puts shingles that are frequent in a sample of texts last, so that first
shingles are rare; the sample changes the work, not the links.  Texts of one group
are never paired, and crowded shingles go on in pairs of parts.

Cases: a null text counts as an empty one; texts without words are one group,
texts of fewer words have one shingle, the whole; of equal rows one stays; a row
with a doc_id goes before one without; an empty table gives no rows; other
columns stay as they are.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import fresh, written
from .components import components
from .simhash import BITS, BUCKET, planes

WIDTH, SIMILAR, RADIUS, SEEDS = 5, 0.8, 20, 6
#: Rounds over all buckets before the crowded ones go on in bit planes; texts compared at once there.
ROUNDS, TILE = 16, 512
#: Texts compared with one leader in a task, about.
PART = 4096
#: Bits of a signature; partners a text is given in each bucket, one round after the other, before all of them.
SIGNED, TURNS = 256, (1, 2, 4, 8)
#: Of so many texts one is read for frequent shingles, which are met in so many of those; the most that travel; pairs passed on at once.
SAMPLED, FREQUENT, TRAVEL, PASSED = 16, 4, 200_000, 200_000
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
# odd numbers with well spread bits: powers of one, as a hash needs for each place and each order
_ODD = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, 1 + max(WIDTH, SEEDS))], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    for shift, k in ((np.uint64(31), 0), (np.uint64(29), 1)):
        h = (h ^ (h >> shift)) * _ODD[k]
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Hashes of the word shingles of a text, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    w = np.array([digest(x) for x in words], np.uint64)
    n = max(1, len(w) - width + 1)
    out = np.full(n, min(len(w), width), np.uint64)
    for k in range(min(len(w), width)):
        out = (out + w[k:k + n]) * _ODD[0]
    return _mixed(out)


def sketch(h: np.ndarray) -> tuple[int, list[int]]:
    """(SimHash, least hash in each order) of a text's shingle hashes."""
    if not len(h):
        return 0, [0] * SEEDS
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (counts * 2 > len(h)).astype(np.uint8)
    least = [int(((h ^ (h >> np.uint64(33))) * k).min()) for k in _ODD[:SEEDS]]
    return int(np.packbits(bits, bitorder="little").view("<u8")[0]), least


def signature(h: np.ndarray) -> np.ndarray:
    """For each of ``SIGNED`` places whether an odd number of a text's different shingles falls there.

    A shingle that only one of two texts has turns one place, so they differ in
    as many shingles at least as their signatures do in places.
    """
    odd = np.bincount((np.unique(h) >> np.uint64(20)) % np.uint64(SIGNED), minlength=SIGNED) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, th, fp, least, signed) of every row; ``th`` tells texts apart."""
    names = ["doc_id", "th", "fp", "least", "signed"]

    def lists(rows, size):
        values = np.array(rows, np.uint64).reshape(-1).view(np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * size, pa.int32()), pa.array(values))

    def run(batches):
        for b in batches:
            made = {}
            for t in set(b.column("text").to_pylist()):
                h = shingles(t)
                made[t] = *sketch(h), signature(h)
            found = [made[t] for t in b.column("text").to_pylist()]
            fp = np.array([f for f, _, _ in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(fp), lists(
                [m for _, m, _ in found], SEEDS), lists([s for _, _, s in found], SIGNED // 64)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash().alias("th"), "text")
    return rows.mapInArrow(run, "doc_id long, th long, fp long, least array<long>, signed array<long>")


def _text_hash():
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Bits of the counts, kept as bit planes from ones up, that exceed ``radius``."""
    more, same = np.zeros_like(counters[0]), np.full_like(counters[0], _FULL)
    for k in range(len(counters) - 1, -1, -1):
        if radius >> k & 1:
            same = same & counters[k]
        else:
            more = more | (same & counters[k])
            same = same & ~counters[k]
    return more


def near(queries: np.ndarray, sliced: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Bits of the sliced fingerprints within ``radius`` of each query, all counted at once.

    Words whose fingerprints have all left the radius are not counted on.
    """
    n, words = len(queries), sliced.shape[1]
    out = np.zeros((n, words), np.uint64)
    rows, cols = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(words), indexing="ij"))
    counters = [np.zeros(len(rows), np.uint64) for _ in range(BITS.bit_length())]
    for b in range(BITS):
        flip = np.where((queries >> np.uint64(b)) & np.uint64(1), _FULL, np.uint64(0))
        carry = sliced[b][cols] ^ flip[rows]
        for k, c in enumerate(counters):
            counters[k], carry = c ^ carry, c & carry
        if b % 16 == 15:
            alive = _above(counters, radius) != _FULL
            if not alive.all():
                rows, cols, counters = rows[alive], cols[alive], [c[alive] for c in counters]
                if not len(rows):
                    return out
    out[rows, cols] = ~_above(counters, radius)
    return out


def _hits(queries: np.ndarray, fps: np.ndarray, radius: int) -> np.ndarray:
    bits = near(queries, planes(fps), radius).astype("<u8").view(np.uint8).reshape(len(queries), -1)
    return np.unpackbits(bits, axis=1, bitorder="little")[:, :len(fps)].astype(bool)


def _crowded(fps: np.ndarray, radius: int) -> np.ndarray:
    """The row of each text's leader in one bucket, in bit planes."""
    leader, heads = np.arange(len(fps)), np.zeros(0, np.int64)
    for at in range(0, len(fps), TILE):
        rows = np.arange(at, min(at + TILE, len(fps)))
        for h in range(0, len(heads), 64 * TILE):
            hits = _hits(fps[rows], fps[heads[h:h + 64 * TILE]], radius)
            led = hits.any(axis=1)
            leader[rows[led]] = heads[h:h + 64 * TILE][hits[led].argmax(axis=1)]
            rows = rows[~led]
        hits, free = _hits(fps[rows], fps[rows], radius) if len(rows) else np.zeros((0, 0), bool), np.ones(len(rows), bool)
        new = []
        for i in range(len(rows)):
            if free[i]:
                new.append(rows[i])
                mine = hits[i] & free
                leader[rows[mine]] = rows[i]
                free &= ~mine
        heads = np.concatenate((heads, np.array(new, np.int64)))
    return leader


def leaders(keys: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """The row of each text's leader in the buckets of sorted ``keys``; leaders lead themselves."""
    leader = np.arange(len(keys))
    left = leader.copy()
    for _ in range(ROUNDS):
        if not len(left):
            return leader
        k = keys[left]
        first = np.searchsorted(k, k, side="left")
        led = np.bitwise_count(fps[left] ^ fps[left][first]) <= radius
        leader[left[led]] = left[first[led]]
        left = left[~led]
    for k in np.unique(keys[left]):
        rows = left[keys[left] == k]
        leader[rows] = rows[_crowded(fps[rows], radius)]
    return leader


def _led(rows: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """(key, leader, th, fp) of every row (key, th, fp), buckets told apart by ``keys``."""
    names = ["key", "leader", "th", "fp"]

    def run(batches):
        rest: tuple = ()

        def found(part, key, th, fp):
            led = leaders(np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]) | (part[1:] != part[:-1])))), fp.view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (key, th[led], th, fp)], names)

        for b in batches:
            cols = [b.column(c).to_numpy(zero_copy_only=False) for c in ("part", "key", "th", "fp")]
            cols = [np.concatenate(x) for x in zip(rest, cols)] if rest else cols
            part, key = cols[:2]
            if not len(key):
                continue
            before = np.flatnonzero((key != key[-1]) | (part != part[-1]))  # the last bucket may go on
            cut = int(before[-1]) + 1 if len(before) else 0
            if cut:
                yield found(*(c[:cut] for c in cols))
            rest = tuple(c[cut:] for c in cols)
        if rest and len(rest[0]):
            yield found(*rest)

    rows = rows if "part" in rows.columns else rows.withColumn("part", F.lit(0).cast("long"))
    dealt = rows.select("part", "key", "th", "fp").repartition(*keys).sortWithinPartitions(*keys, "th")
    return dealt.mapInArrow(run, "key long, leader long, th long, fp long")


def candidates(texts: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(a, b): texts (th, fp, least) and the leaders they meet."""
    pairs = [(i, j) for i in range(SEEDS) for j in range(i)]
    keys = F.array(*[F.xxhash64(F.lit(i * SEEDS + j), F.get("least", F.lit(i)), F.get("least", F.lit(j))) for i, j in pairs])
    rows = texts.select("th", "fp", F.explode(keys).alias("key"))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    met = written(sizes.where("n > 1"), "near-keys")
    hot = written(met.where(F.col("n") > bucket), "near-hot")
    plain = rows.join(met.where(F.col("n") <= bucket).select("key"), "key", "left_semi")
    crowded = rows.join(hot.withColumn("parts", F.ceil(F.col("n") / bucket)), "key").withColumn(
        "part", F.pmod(F.xxhash64("th", F.lit(7)), F.col("parts")).cast("long"))
    thinned = written(_led(crowded, ["key", "part"], radius), "near-thinned")
    heads = thinned.where("leader = th").select("key", "th", "fp")
    every = thinned.unionByName(_led(plain, ["key"], radius)).unionByName(_led(heads, ["key"], radius))
    return every.where("leader <> th").select(F.col("leader").alias("a"), F.col("th").alias("b")).distinct()


def confirmed(docs: DataFrame, edges: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The edges (a, b) whose texts share ``similar`` of their different shingles."""
    crowds = edges.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts")).withColumnRenamed("a", "of")
    sized = edges.join(crowds, F.col("a") == F.col("of")).drop("of")
    wanted = sized.select(F.col("b").alias("th"), F.col("a").alias("leader"), F.lit(1).alias("place"), F.pmod(
        F.xxhash64("b"), F.col("parts")).alias("part"))
    heads = crowds.select(F.col("of").alias("th"), F.col("of").alias("leader"), F.lit(0).alias("place"),
                          F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    wanted = written(wanted.unionByName(heads), "near-wanted")
    # whole texts are merged with what is wanted of them at every size, so that the plan does not change with it
    texts = docs.select(_text_hash().alias("th"), F.col("text")).join(
        wanted.select("th").distinct().hint("merge"), "th", "left_semi").dropDuplicates(["th"])
    dealt = wanted.join(texts, "th").repartition("leader", "part").sortWithinPartitions("leader", "part", "place")

    def run(batches):
        head, own = None, None
        for b in batches:
            out = []
            for th, leader, place, text in zip(*(b.column(c).to_pylist() for c in ("th", "leader", "place", "text"))):
                h = np.unique(shingles(text))
                if not place:
                    head, own = leader, h
                    continue
                shared = len(np.intersect1d(own, h, assume_unique=True))
                if head == leader and shared >= similar * (len(own) + len(h) - shared) - 1e-9:
                    out.append((leader, th))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])

    return dealt.select("th", "leader", "place", "text").mapInArrow(run, "a long, b long")


def _of_texts(docs: DataFrame, made, schema: str) -> DataFrame:
    """Rows of numbers for each text of ``docs``, once for its copies in a task; ``made`` gives (columns, rows of a text)."""
    names = ["th", *(c.split()[0] for c in schema.split(", "))]

    def run(batches):
        seen: set = set()
        for b in batches:
            parts, times, of = [], [], []
            for th, text in zip(b.column("th").to_pylist(), b.column("text").to_pylist()):
                if th in seen:
                    continue
                if len(seen) >= 1 << 20:
                    seen.clear()
                seen.add(th)
                parts.append(made(np.unique(shingles(text))))
                of.append(th)
                times.append(len(parts[-1][0]))
            if sum(times):
                cols = [np.repeat(np.array(of, np.int64), times), *(np.concatenate(c) for c in zip(*parts))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

    return docs.select(_text_hash().alias("th"), "text").mapInArrow(run, "th long, " + schema)


def frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, texts they are met in) of shingles frequent in a sample, by hash."""
    few = docs.where(F.pmod(_text_hash(), F.lit(SAMPLED)) == 0)
    met = _of_texts(few, lambda h: (h.view(np.int64),), "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    rows = met.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "key").limit(TRAVEL).collect()
    h, n = (np.array([r[c] for r in rows], np.int64) for c in ("key", "n"))
    order = np.argsort(h.view(np.uint64))
    return h.view(np.uint64)[order], n[order]


def prefix(h: np.ndarray, late: tuple[np.ndarray, np.ndarray], similar: float = SIMILAR) -> np.ndarray:
    """The first of the different shingles of a text: one of them is among the first of any text it is a link of."""
    rank = np.zeros(len(h), np.int64)
    if len(late[0]):
        at = np.minimum(np.searchsorted(late[0], h), len(late[0]) - 1)
        rank = np.where(late[0][at] == h, late[1][at], 0)
    return h[np.lexsort((h, rank))][:len(h) - int(np.ceil(similar * len(h) - 1e-9)) + 1] if len(h) else h


def prefixes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(th, key, at, n): the first shingles of every text, their places, and how many different ones the text has."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent(docs))

    def made(h):
        first = prefix(h, shared.value, similar)
        return first.view(np.int64), np.arange(len(first), dtype=np.int32), np.full(len(first), len(h), np.int32)

    return _of_texts(docs, made, "key long, at int, n int")


def met(rows: DataFrame) -> DataFrame:
    """The rows (th, key, at, n), once, whose key other texts have too."""
    names = ["key", "th", "at", "n"]

    def run(batches):
        held, went = None, False  # the last row, and whether the one before it has its key
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(c).to_numpy(zero_copy_only=False) for c in names]
            cols = [np.concatenate(x) for x in zip(held, cols)] if held else cols
            new = np.concatenate(([True], (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])))
            cols = [c[new] for c in cols]
            same = cols[0][1:] == cols[0][:-1]
            keep = np.concatenate(([went], same)) | np.concatenate((same, [False]))
            held, went = [c[-1:] for c in cols], bool(keep[-1])
            keep[-1] = False
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in cols], names)
        if held and went:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], names)

    return rows.select(*names).repartition("key").sortWithinPartitions("key", "th").mapInArrow(
        run, "key long, th long, at int, n int")


def across(bucket: np.ndarray, root: np.ndarray, at: np.ndarray, n: np.ndarray, signed: list[np.ndarray],
           similar: float = SIMILAR, most: int | None = None):
    """Places (i, j) of rows of one bucket and different groups that may be links; sorted by bucket and root.

    With ``most``, only pairs of which a row has not had so many before; a row with any pair has one then.
    """
    new = np.concatenate(([True], bucket[1:] != bucket[:-1]))
    ends = np.append(np.flatnonzero(new)[1:], len(bucket))
    end = ends[np.cumsum(new) - 1]
    run = new.copy()
    run[1:] |= root[1:] != root[:-1]
    later = np.append(np.flatnonzero(run)[1:], len(bucket))[np.cumsum(run) - 1]
    had = np.zeros(len(bucket), np.int64)
    i = np.flatnonzero(later < end)
    j = later[i]
    while len(i):
        shared = np.minimum(at[i], at[j]) + np.minimum(n[i] - at[i], n[j] - at[j])
        fits = shared >= similar * (n[i] + n[j] - shared) - 1e-9
        if most is not None:
            fits[fits] = (had[i[fits]] < most) | (had[j[fits]] < most)
        a, b = i[fits], j[fits]
        apart = sum(np.bitwise_count((s[a] ^ s[b]).view(np.uint64)).astype(np.int64) for s in signed)
        shared = (n[a] + n[b] - apart) / 2
        fits = shared >= similar * (n[a] + n[b] - shared) - 1e-9
        a, b = a[fits], b[fits]
        if most is not None:
            first = np.zeros(len(a), bool)
            first[np.unique(b, return_index=True)[1]] = True
            free = (had[a] < most) | (first & (had[b] < most))
            a, b = a[free], b[free]
        np.add.at(had, a, 1)
        np.add.at(had, b, 1)
        yield a, b
        left = j + 1 < end[i]
        i, j = i[left], j[left] + 1


def missed(rows: DataFrame, texts: DataFrame, linked: DataFrame, similar: float = SIMILAR, bucket: int = BUCKET,
           most: int | None = None) -> DataFrame:
    """(a, b): texts (th, signed) of different groups (node, root) with an equal one of ``rows`` that may yet be links.

    All of them, or with ``most`` some of each text that has any.
    """
    crowds = rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > bucket).select(
        F.col("key").alias("of"), F.ceil(F.col("rows") / bucket).cast("long").alias("parts"))
    crowds, one = written(crowds, "near-crowds"), F.lit(1).cast("long")
    signs = [f"s{k}" for k in range(SIGNED // 64)]
    marks = texts.join(linked.withColumnRenamed("node", "th"), "th", "left").select(
        "th", F.coalesce("root", "th").alias("root"), *[F.get("signed", F.lit(k)).alias(c) for k, c in enumerate(signs)])
    some = rows.join(marks, "th").join(crowds, F.col("key") == F.col("of"), "left").withColumn(
        "parts", F.coalesce("parts", one))
    mine = F.pmod(F.xxhash64("th", F.lit(11)), F.col("parts"))
    cells = some.withColumn("mine", mine).withColumn(
        "cell", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda other: (
            F.least("mine", other) * F.col("parts") + F.greatest("mine", other)))))
    names = ["key", "cell", "root", "th", "at", "n", *signs]
    out = ["a", "b", "at_a", "at_b", "n_a", "n_b"]

    def found(key, cell, root, th, at, n, *signed):
        of = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1]))))
        held, size = [], 0

        def rows():
            i, j = (np.concatenate(x) for x in zip(*held))
            i, j = np.where(th[i] < th[j], i, j), np.where(th[i] < th[j], j, i)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (th[i], th[j], at[i], at[j], n[i], n[j])], out)

        for pair in across(of, root, at, n, signed, similar, most):
            held.append(pair)
            size += len(pair[0])
            if size >= PASSED:
                yield rows()
                held, size = [], 0
        if size:
            yield rows()

    def run(batches):
        rest: tuple = ()
        for b in batches:
            cols = [b.column(c).to_numpy(zero_copy_only=False) for c in names]
            cols = [np.concatenate(x) for x in zip(rest, cols)] if rest else cols
            key, cell = cols[:2]
            if not len(key):
                continue
            before = np.flatnonzero((key != key[-1]) | (cell != cell[-1]))  # the last bucket may go on
            cut = int(before[-1]) + 1 if len(before) else 0
            if cut:
                yield from found(*(c[:cut] for c in cols))
            rest = tuple(c[cut:] for c in cols)
        if rest and len(rest[0]):
            yield from found(*rest)

    dealt = cells.select(*names).repartition("key", "cell").sortWithinPartitions("key", "cell", "root", "th")
    pairs = dealt.mapInArrow(run, "a long, b long, at_a int, at_b int, n_a int, n_b int")
    if most is not None:
        return pairs.select("a", "b").distinct()
    shared = pairs.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("first"), *[F.max(c).alias(c) for c in ("at_a", "at_b", "n_a", "n_b")])
    length = lambda c: F.col(c) - F.ceil(F.lit(similar) * F.col(c) - 1e-9) + 1
    # beyond the shared first shingles, what comes after the one text's first ones may only be after the other's last shared one
    upper = F.col("first") + F.greatest(
        F.least(F.col("n_a") - length("n_a"), F.col("n_b") - F.col("at_b") - 1),
        F.least(F.col("n_a") - F.col("at_a") - 1, F.col("n_b") - length("n_b")))
    return shared.where(upper >= similar * (F.col("n_a") + F.col("n_b") - upper) - 1e-9).select("a", "b")


def _completed(docs: DataFrame, texts: DataFrame, links: DataFrame, similar: float, bucket: int) -> DataFrame:
    """(node, root) of all groups: ``links`` and those between the groups they make.

    Some pairs of each text come first, for a few rounds, so that a crowd of
    links is one group before all pairs of different groups are looked for.
    """
    rows = written(met(prefixes(docs, similar)), "near-met")
    texts, tried = texts.select("th", "signed"), None
    turns = [*TURNS, None]
    while turns:
        most = turns.pop(0)
        linked = written(components(links), "near-parts")
        pairs = missed(rows, texts, linked, similar, bucket, most)
        if tried is None:
            tried = pairs = written(pairs, "near-missed")
            wanted = pairs.select(F.col("a").alias("th")).unionByName(pairs.select(F.col("b").alias("th"))).distinct()
            # a text with any pair is in one of the first round's
            docs = written(docs.select(_text_hash().alias("th"), "text").join(
                wanted.hint("merge"), "th", "left_semi").dropDuplicates(["th"]).select("text"), "near-few")
        else:
            pairs = written(pairs.join(tried, ["a", "b"], "left_anti"), "near-missed")
            tried = tried.unionByName(pairs)
        new = written(confirmed(docs, pairs, similar), "near-links")
        links = links.unionByName(new)
        if new.isEmpty():  # the groups stay as they are: the rest at once
            turns = turns[-1:]
    return components(links)


def groups(docs: DataFrame, radius: int = RADIUS, similar: float = SIMILAR, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, th, root) of every row; ``root`` tells groups apart."""
    found = written(sketches(docs), "near-sketches")
    texts = written(found.groupBy("th").agg(*[F.first(c).alias(c) for c in ("fp", "least", "signed")]), "near-texts")
    edges = written(candidates(texts, radius, bucket), "near-candidates")
    links = written(confirmed(docs, edges, similar), "near-links")
    linked = _completed(docs, texts, links, similar, bucket)
    return found.join(linked.withColumnRenamed("node", "th"), "th", "left").select(
        "doc_id", "th", F.coalesce("root", "th").alias("root"))


def one_of_each(docs: DataFrame, radius: int = RADIUS, similar: float = SIMILAR, bucket: int = BUCKET) -> DataFrame:
    """The rows of ``docs``, whole, without all but one of each group.

    The row with the least doc_id stays (an id before none), then the one with the
    least hash of its text; of rows alike in both, the first by the other columns.
    """
    found = written(groups(docs, radius, similar, bucket), "near-groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first")
    own_id, own_hash, place, kept_id, kept_hash, times = fresh(
        docs, "own_id", "own_hash", "place", "kept_id", "kept_hash", "times")
    kept = found.groupBy("root").agg(first).select(
        F.col("first.doc_id").alias(kept_id), F.col("first.th").alias(kept_hash))
    held = found.groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias(times))
    kept = written(kept.join(held, F.col(kept_id).eqNullSafe(held["doc_id"]) & (F.col(kept_hash) == held["th"])).select(
        kept_id, kept_hash, times), "near-kept")
    keyed = docs.withColumns({own_id: F.col("doc_id").cast("long"), own_hash: _text_hash()})
    match = F.col(own_id).eqNullSafe(F.col(kept_id)) & (F.col(own_hash) == F.col(kept_hash))
    alone = keyed.join(kept.where(F.col(times) == 1).hint("merge"), match, "left_semi")
    ordered = [F.col(f"`{f.name}`") for f in docs.schema
               if f.name != "text" and "map<" not in f.dataType.simpleString()]
    alike = Window.partitionBy(own_id, own_hash).orderBy(*ordered)
    several = keyed.join(kept.where(F.col(times) > 1), match, "left_semi").withColumn(
        place, F.row_number().over(alike)).where(F.col(place) == 1).drop(place)
    return alone.unionByName(several).drop(own_id, own_hash)
