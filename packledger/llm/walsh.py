"""Product codes of vectors, compared through an integer Walsh-Hadamard transform.

Vectors are whole numbers, cut into equal consecutive parts; every part position
has a codebook of entries, learned by rounds of assignment and means.  Parts and
entries are filled up with zeros to a power of two ``n`` and transformed; the
transform keeps squared distances but for the factor ``n``.  The coefficients
are taken in sequency order - few changes of sign first, where most of a
difference lies - and an entry whose sum so far is beyond the distance of some
other entry is dropped.  Sums only grow, so neither a nearest entry nor a tie is
ever lost.  All of it is exact: 64-bit integers where they cannot overflow,
Python's own beyond.

Scale: one pass over the vectors a round, no vector is shuffled.  A task sums
its parts by entry; the sums are added in Spark, cut into 32-bit limbs that
cannot overflow.  Only codebooks, whose size depends on the width of a vector
alone, reach the driver and the tasks.

Cases: null vectors and vectors with a null or non-finite component are dropped;
shorter vectors are filled up with zeros to the longest, and all to a multiple of
the number of parts; a null vec_id is kept and comes last among seeds; rows with
the same vec_id seed in the order of their vectors, repeated rows as often as
they come; with fewer vectors than entries the codebooks have fewer; an error
beyond 64 bits is null, and null errors are left out of sums; an empty table
gives no rows; other columns are not read.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import written
from .vectors import finite

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Rows compared at once.
LANES = 4096
_LIMB = 32


def walsh(n: int) -> np.ndarray:
    """The Walsh functions of length n (a power of two) by number of sign changes, one a column."""
    h = np.ones((1, 1), np.int64)
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    changes = (h[:, 1:] != h[:, :-1]).sum(axis=1)
    return h[np.argsort(changes)].T


def whole(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of finite doubles, exactly; Python integers where 64 bits could not hold what follows."""
    reach = float(np.abs(x).max(initial=0.0))
    n = 1 << max(0, x.shape[1] - 1).bit_length()
    if scale & scale - 1 == 0 and reach * scale < 2.0 ** 52 and (2.0 * n * (reach * scale + 1)) ** 2 * n < 2.0 ** 62:
        return np.floor(x * scale).astype(np.int64)

    def one(v: float) -> int:
        top, bottom = float(v).as_integer_ratio()
        return top * scale // bottom
    out = np.empty(x.shape, object)
    out.flat = [one(v) for v in x.flat]
    return out


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of each row, ties to the lower index."""
    width = parts.shape[1]
    n = 1 << max(0, width - 1).bit_length()
    turn = walsh(n)[:width]  # rows of zeros beyond the width add nothing
    if parts.dtype == object or entries.dtype == object:
        turn = turn.astype(object)
    a, b = parts.dot(turn), entries.dot(turn)
    rows, count = len(a), len(b)
    sums = (a[:, :1] - b[:, 0]) ** 2
    # the entry that promises most sets the bound: its whole distance
    first = np.argmin(sums, axis=1)
    bound = ((a - b[first]) ** 2).sum(axis=1)
    row, entry = np.nonzero(sums <= bound[:, None])
    left = sums[row, entry]
    for k in range(1, n):
        left = left + (a[row, k] - b[entry, k]) ** 2
        alive = left <= bound[row]
        row, entry, left = row[alive], entry[alive], left[alive]
    # rows come in order and entries ascend in each, so of a row's equal sums the first is the lower index
    starts = np.searchsorted(row, np.arange(rows))
    least = np.minimum.reduceat(left, starts) if rows else left
    hits = np.flatnonzero(left == least[row])
    at = hits[np.searchsorted(row[hits], np.arange(rows))]
    return entry[at], least // n


def _matrix(column, width: int) -> np.ndarray:
    """Lists of doubles as rows, filled up with zeros to ``width``."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v, label) of the vectors that are kept, in doubles."""
    label = F.col("label") if "label" in embeddings.columns else F.lit(None).cast("int")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"), label.alias("label"))
    return rows.where(finite(F.col("v"))).withColumn("v", F.col("v").cast("array<double>"))


def _limbs(total: int) -> list[int]:
    """A whole number in 32-bit limbs, the low ones not negative, the last with the sign."""
    out = []
    while not -2 ** 31 <= total < 2 ** 31:
        out.append(total & 2 ** _LIMB - 1)
        total >>= _LIMB
    return [*out, total]


class Codebooks:
    """Entries of every part position, as rows of whole numbers."""

    def __init__(self, entries: list[np.ndarray], width: int, scale: int = SCALE):
        self.entries, self.width, self.scale = entries, width, scale

    def split(self, column) -> list[np.ndarray]:
        """The parts of a column of vectors, a matrix for each position."""
        x = _matrix(column, self.width)
        step = self.width // len(self.entries)
        return [whole(x[:, k * step:(k + 1) * step], self.scale) for k in range(len(self.entries))]

    def sha256(self) -> str:
        """Digest of all components in decimal by part, entry and position, comma-joined."""
        said = ",".join(str(int(v)) for e in self.entries for v in e.reshape(-1))
        return hashlib.sha256(said.encode()).hexdigest()


def _narrow(rows: list[list[int]], width: int) -> np.ndarray:
    """Rows of whole numbers, in 64 bits if what is done with them stays there."""
    n = 1 << max(0, width - 1).bit_length()
    reach = max((abs(v) for r in rows for v in r), default=0)
    fits = (2 * n * (reach + 1)) ** 2 * n < 2 ** 62
    out = np.empty((len(rows), width), np.int64 if fits else object)
    for i, r in enumerate(rows):
        out[i] = r
    return out


def _sums(rows: DataFrame, books: Codebooks) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(count, component sums) of the parts of each (part, entry) in use."""
    step = books.width // len(books.entries)
    names = ["part", "entry", "place", "limb", "total"]

    def run(batches):
        held: dict[tuple[int, int], list[int]] = {}
        for b in batches:
            for k, parts in enumerate(books.split(b.column("v"))):
                for at in range(0, len(parts), LANES):
                    some = parts[at:at + LANES]
                    index, _ = nearest(some, books.entries[k])
                    for e in np.unique(index):
                        mine = some[index == e]
                        was = held.get((k, int(e)), [0] * (step + 1))
                        now = [int(v) for v in mine.sum(axis=0)]
                        held[k, int(e)] = [x + y for x, y in zip(was, [*now, len(mine)])]
        out = [(k, e, place, limb, v) for (k, e), totals in held.items() for place, total in enumerate(totals)
               for limb, v in enumerate(_limbs(total))]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)

    found = rows.select("v").mapInArrow(run, ", ".join(f"{n} long" for n in names)).groupBy(*names[:4]).agg(
        F.sum("total").alias("total")).collect()
    out: dict[tuple[int, int], list[int]] = {}
    for r in found:
        totals = out.setdefault((r["part"], r["entry"]), [0] * (step + 1))
        totals[r["place"]] += r["total"] << _LIMB * r["limb"]
    return {key: (totals[-1], totals[:-1]) for key, totals in out.items()}


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """Codebooks of the stored vectors (vec_id, v), seeded with those of the smallest ids."""
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-longest // parts) * parts
    seeds = [r["v"] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()]
    x = np.zeros((len(seeds), width))
    for i, v in enumerate(seeds):
        x[i, :len(v)] = v
    step = width // parts
    books = Codebooks([whole(x[:, k * step:(k + 1) * step], scale) for k in range(parts)], width, scale)
    if not seeds or not width:
        return books
    for _ in range(rounds):
        found = _sums(rows, books)
        for k, old in enumerate(books.entries):
            means = [[total // found[k, e][0] for total in found[k, e][1]] if (k, e) in found else [int(v) for v in old[e]]
                     for e in range(len(old))]
            books.entries[k] = _narrow(means, step)
    return books


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, indexes, error) of every vector: its entries by part, and the squared distances together."""
    names = ["vec_id", "label", "indexes", "error"]

    def run(batches):
        for b in batches:
            n = b.num_rows
            codes, errors = np.zeros((n, len(books.entries)), np.int16), [0] * n
            for k, parts in enumerate(books.split(b.column("v")) if books.width else []):
                for at in range(0, n, LANES):
                    index, d = nearest(parts[at:at + LANES], books.entries[k])
                    codes[at:at + LANES, k] = index
                    errors[at:at + LANES] = [x + int(y) for x, y in zip(errors[at:at + LANES], d)]
            flat = pa.array(codes.reshape(-1), pa.int16())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(books.entries), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("label"), lists,
                 pa.array([e if e < 2 ** 63 else None for e in errors], pa.int64())], names)

    label = rows.schema["label"].dataType.simpleString()
    return rows.select("vec_id", "v", "label").mapInArrow(
        run, f"vec_id long, label {label}, indexes array<smallint>, error long")


def compressed(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
               scale: int = SCALE) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every usable vector.

    ``code`` has two hex digits a part; at most 256 entries can be told apart by them.
    """
    rows = written(_usable(embeddings), "code-vectors")
    books = train(rows, parts, entries, rounds, scale)
    coded = written(encode(rows, books), "vector-codes")
    by_label = coded.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "same")
    code = F.array_join(F.transform("indexes", lambda i: F.lower(F.lpad(F.hex(i), 2, "0"))), "")
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("same"))).select(
        "vec_id", code.alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _sql() -> str:
    """The codes in SQL, for the whole embeddings table of vectors of one length: a step of the query for each round."""
    distance = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    steps = [f"""kept AS (SELECT row_number() OVER () AS rid, vec_id, label,
         list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
         WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT rid, part, v[part * (len(v) // {PARTS}) + 1 : (part + 1) * (len(v) // {PARTS})] AS x
         FROM kept, range({PARTS}) t(part)),
seeds AS (SELECT rid, row_number() OVER (ORDER BY vec_id, v) - 1 AS entry FROM kept ORDER BY vec_id, v LIMIT {ENTRIES}),
book0 AS (SELECT part, entry, x AS c FROM parts JOIN seeds USING (rid))"""]
    for k in range(ROUNDS + 1):
        steps.append(f"""near{k} AS MATERIALIZED (SELECT rid, part, any_value(x) AS x, min(d) AS d, arg_min(entry, d * {ENTRIES} + entry) AS entry
         FROM (SELECT rid, part, entry, x, {distance} AS d FROM parts JOIN book{k} USING (part)) GROUP BY rid, part)""")
        if k < ROUNDS:
            steps.append(f"""book{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m, c) AS c FROM book{k} LEFT JOIN (
         SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY place) AS m FROM (
           SELECT part, entry, place, sum(x[place])::BIGINT AS s, count(*) AS n
           FROM near{k}, range(1, 1 + (SELECT max(len(x)) FROM parts)) t(place) GROUP BY part, entry, place)
         GROUP BY part, entry) USING (part, entry))""")
    steps.append(f"""coded AS (SELECT rid, string_agg(lpad(printf('%x', entry), 2, '0'), '' ORDER BY part) AS code,
         sum(d)::BIGINT AS error FROM near{ROUNDS} GROUP BY rid),
whole AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS said FROM book{ROUNDS})""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, said AS codebooks_sha256
FROM kept JOIN coded USING (rid), whole"""


SQL = _sql()
