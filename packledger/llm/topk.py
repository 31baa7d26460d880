"""Exact largest inner products with bounds from segment statistics, coarse to fine.

Components are whole numbers.  A vector is described at several resolutions by
the mean and deviation of its segments; for any two vectors
``a.b <= sum over segments of m * (mean_a * mean_b + dev_a * dev_b)``, the
counterpart for inner products of the lower bound on distances.  The bound at
one resolution is one matrix product over all pairs of a block; pairs whose bound
lies below the query's k-th best exact product so far are dropped, the others
go to the next resolution, and what is left is computed exactly.

Scale: distinct vectors in shards of bounded size, each with its statistics;
blocks of queries meet every shard once, by a stream past it, and only the best
few of a shard go on to the merge.

Cases: rows without a vec_id, null vectors and vectors with a null or non-finite
component take no part; a zero vector does; shorter vectors are filled up with
zeros; rows equal in id and vector count once, and a row with the query's id is
the query's own; ties go to the smaller vec_id; an empty table gives no rows; a
lone vector gives none; a product outside 64 bits is not defined; other columns
are not read.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import vectors
from .common import written

#: Rows of a shard; queries and candidates compared at once.
SHARD, LANES = 16384, 256
#: Shards up to which they keep their size, and rows to which they grow beyond that.
FEW, LARGEST = 32, 65536
#: While more than one pair in so many is left, a resolution is one product of matrices.
DENSE = 16
SCALE = 256


def resolutions(width: int) -> list[int]:
    """Numbers of segments from coarse to fine, up to segments of two components."""
    out, k = [], 1
    while k * 2 <= max(width, 2):
        out.append(k)
        k *= 2
    return out


def profile(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, weighted so that products of profiles bound products."""
    cols = []
    for part in np.array_split(x, segments, axis=1):
        if part.shape[1]:
            cols += [part.mean(axis=1) * np.sqrt(part.shape[1]), part.std(axis=1) * np.sqrt(part.shape[1])]
    return np.stack(cols, axis=1) if cols else np.zeros((len(x), 0))


def _blockwise(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of rows i of a and rows j of b, whole numbers held as doubles or Python integers."""
    parts = [(a[i[c:c + 65536]] * b[j[c:c + 65536]]).sum(axis=1) for c in range(0, len(i), 65536)]
    return np.concatenate(parts) if parts else np.zeros(0)


def profiled(x: np.ndarray) -> list[np.ndarray]:
    """The profiles of the rows at every resolution."""
    return [profile(x, s) for s in resolutions(x.shape[1])]


def best(queries: np.ndarray, x: np.ndarray, k: int, ids: np.ndarray, starts: np.ndarray,
         profiles: list[np.ndarray] | None = None):
    """(query row, id, product) of the k best of each query among the ids of the rows of x.

    Row j of x stands for ``ids[starts[j]:starts[j + 1]]``, in ascending order.
    """
    held = np.diff(starts)
    levels = resolutions(x.shape[1])
    of_x = profiled(x) if profiles is None else profiles
    lanes = max(1, min(LANES, LANES * SHARD // max(1, len(x))))  # pairs at once do not grow with the shard
    reach = float(np.abs(queries).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, x.shape[1])
    slack = reach * 1e-9
    if reach >= 2 ** 52:  # beyond what doubles add up exactly
        queries_i, x_i = queries.astype(object), x.astype(object)
        queries_i[:], x_i[:] = np.vectorize(int, otypes=[object])(queries), np.vectorize(int, otypes=[object])(x)
    else:
        queries_i, x_i = queries, x
    pos, out, score = [], [], []
    for at in range(0, len(queries), lanes):
        q = queries[at:at + lanes]
        of_q = [profile(q, s) for s in levels]
        bound = of_q[0] @ of_x[0].T
        floor = _floor(queries_i[at:at + lanes], x_i, bound, k)
        alive, pairs = bound + slack >= floor[:, None], None
        for a, b in zip(of_q[1:], of_x[1:]):
            if pairs is None and alive.sum() > alive.size // DENSE:  # cheaper for all pairs at once
                alive &= a @ b.T + slack >= floor[:, None]
                continue
            qi, xi = np.nonzero(alive) if pairs is None else pairs
            keep = _blockwise(a, b, qi, xi) + slack >= floor[qi]
            pairs = qi[keep], xi[keep]
        qi, xi = np.nonzero(alive) if pairs is None else pairs
        if len(qi) > alive.size // DENSE and reach < 2 ** 52:
            exact = (q @ x.T)[qi, xi]
        else:
            exact = _blockwise(queries_i[at:at + lanes], x_i, qi, xi)
        keep = exact >= floor[qi]
        qi, xi, exact = qi[keep], xi[keep], exact[keep]
        n = held[xi]
        row = np.repeat(np.arange(len(qi)), n)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        who, what, value = qi[row], ids[starts[xi[row]] + nth], exact[row]
        order = np.lexsort((what, -value, who))
        who, what, value = who[order], what[order], value[order]
        first = np.searchsorted(who, who, side="left")
        top = np.arange(len(who)) - first < k
        pos.append(who[top] + at)
        out.append(what[top])
        score.append(value[top])
    join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
    return join(pos, np.int32), join(out, np.int64), join(score, np.int64)


def _floor(q: np.ndarray, x: np.ndarray, bound: np.ndarray, k: int) -> np.ndarray:
    """For each query a product that its k-th best reaches: the k-th of the rows that promise most."""
    if len(x) < k:
        return np.full(len(q), -np.inf)
    tries = min(len(x), 8 * k)
    seeds = np.argpartition(-bound, tries - 1, axis=1)[:, :tries]
    who = np.repeat(np.arange(len(q)), tries)
    exact = _blockwise(q, x, who, seeds.ravel()).astype(np.float64).reshape(len(q), tries)
    return np.partition(exact, tries - k, axis=1)[:, tries - k]


def index(held: DataFrame) -> DataFrame:
    """(shard, n, width, vectors, ids, counts): one row per shard of (shard, v, ids)."""
    def build(rows: pa.Table) -> pa.Table:
        x = vectors.matrix(rows.column("v").combine_chunks())
        ids = rows.column("ids").combine_chunks()
        return pa.table({"shard": [rows.column("shard")[0].as_py()], "n": [len(x)], "width": [x.shape[1]],
                         "vectors": [x.astype("<f8").tobytes()], "ids": [np.asarray(ids.flatten(), "<i8").tobytes()],
                         "counts": [np.asarray(pc.list_value_length(ids), "<i4").tobytes()]},
                        schema=pa.schema([("shard", pa.int32()), ("n", pa.int32()), ("width", pa.int32()),
                                          *((c, pa.binary()) for c in ("vectors", "ids", "counts"))]))

    return held.groupBy("shard").applyInArrow(
        build, "shard int, n int, width int, vectors binary, ids binary, counts binary")


def _search(k: int):
    def load(row: dict):
        x = np.frombuffer(row["vectors"].as_py(), "<f8").reshape(row["n"].as_py(), row["width"].as_py())
        starts = np.concatenate(([0], np.cumsum(np.frombuffer(row["counts"].as_py(), "<i4"))))
        ids, profiles = np.frombuffer(row["ids"].as_py(), "<i8"), profiled(x)
        return lambda queries: best(queries, x, k + 1, ids, starts, profiles)
    return load


def inner_products(embeddings: DataFrame, is_query, k: int = 5, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows (vec_id, embedding) for which ``is_query`` holds."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & vectors.finite(F.col("v")))
    rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(x.cast("double") * SCALE).cast("double")))
    rows = vectors.padded(rows)
    held, n = vectors.shards(written(vectors.classes(rows, k), "product-classes"), shard, FEW, LARGEST)
    kept = written(index(held), "product-shards")
    queries = rows.where(is_query)
    blocks = vectors.query_blocks(queries)
    found = vectors.searched(blocks, kept, n, "long", _search(k))
    return vectors.ranked(found, blocks, queries, k)
