"""What the two vector searches share: rows that take part, distinct vectors, blocks, ranks.

Rows with one and the same vector are one *class*: a hot vector costs as much as
any other.  A class keeps the ``k + 1`` smallest vec_ids, which is all that a
list of k nearest can need of it.  Queries are distinct vectors too, dealt into
blocks of bounded size; each block meets each shard of the classes once.
"""
from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import written

#: Queries in a block, about.
QUERIES = 2048


def finite(v: Column) -> Column:
    """Neither null nor holding a null or non-finite component."""
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return v.isNotNull() & F.coalesce(whole, F.lit(False))


def padded(rows: DataFrame) -> DataFrame:
    """Vectors of unequal length, the shorter ones filled up with zeros."""
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    if rows.agg(F.min(F.size("v"))).first()[0] in (None, longest):
        return rows
    zero = F.array_repeat(F.lit(0), longest).cast(rows.schema["v"].dataType)
    return rows.withColumn("v", F.slice(F.concat("v", zero), 1, longest))


def classes(rows: DataFrame, k: int) -> DataFrame:
    """(v, ids): the distinct vectors, each with its k + 1 smallest ids in order."""
    one = rows.dropDuplicates(["vec_id", "v"])
    first = Window.partitionBy("v").orderBy("vec_id")
    few = one.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def shards(held: DataFrame, size: int, few: int | None = None, largest: int = 0) -> tuple[DataFrame, int]:
    """A stored table of classes with a shard of about ``size`` rows for each, and how many.

    Every query meets every shard; beyond ``few`` shards, if given, they grow to ``largest`` rows first.
    """
    rows = held.count()
    n = max(1, math.ceil(rows / size))
    if few is not None:
        n = max(min(n, few), math.ceil(rows / max(size, largest)))
    return held.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(n)).cast("int")), n


def query_blocks(queries: DataFrame, size: int = QUERIES) -> DataFrame:
    """(block, vs): the distinct query vectors in stored blocks."""
    distinct = written(queries.select("v").distinct(), "query-vectors")
    n = max(1, math.ceil(distinct.count() / size))
    block = F.pmod(F.xxhash64("v", F.lit(1)), F.lit(n)).cast("int").alias("block")
    return written(distinct.groupBy(block).agg(F.collect_list("v").alias("vs")), "query-blocks")


def matrix(vectors) -> np.ndarray:
    """A column of equally long lists as rows of doubles."""
    n = len(vectors)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, np.float64).reshape(n, -1 if len(flat) else 0)


def searched(blocks: DataFrame, index: DataFrame, n_shards: int, score_type: str,
             search: Callable[[dict], Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]]) -> DataFrame:
    """(block, pos, vec_id, score): what each shard finds for each query.

    ``index`` has one row per shard; ``search`` takes that row and gives a function
    that takes a matrix of queries and gives (query row, vec_id, score).  A shard
    travels to its task once, and the blocks follow it there one by one; the two
    are not joined, since blocks as stored are a small part of what they are when
    every shard has its copy, and Spark would gather them for their stored size.
    """
    dealt = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    both = index.unionByName(dealt, allowMissingColumns=True)
    stream = both.repartition("shard").sortWithinPartitions("shard", F.col("block").asc_nulls_first())
    kind = pa.float64() if score_type == "double" else pa.int64()

    def run(batches):
        shard, find = None, None
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i] for c in b.schema.names}
                if not row["block"].is_valid:
                    shard, find = row["shard"].as_py(), search(row)
                elif shard == row["shard"].as_py():  # a shard without vectors has no row
                    pos, ids, score = find(matrix(row["vs"].values))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(pos), row["block"].as_py()), pa.int32()), pa.array(pos, pa.int32()),
                         pa.array(ids, pa.int64()), pa.array(score, kind)], ["block", "pos", "vec_id", "score"])

    return stream.mapInArrow(run, f"block int, pos int, vec_id long, score {score_type}")


def ranked(found: DataFrame, blocks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of every query row, its own id left out."""
    best = Window.partitionBy("block", "pos").orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    lists = top.groupBy("block", "pos").agg(
        F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("top"))
    named = blocks.select("block", F.posexplode("vs").alias("pos", "v")).join(
        lists.hint("merge"), ["block", "pos"]).select("v", "top")
    each = queries.select(F.col("vec_id").alias("query_id"), "v").dropDuplicates(["query_id", "v"]).join(named.hint("merge"), "v")
    others = F.slice(F.filter("top", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return each.select("query_id", F.posexplode(others).alias("i", "x")).select(
        "query_id", (F.col("i") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
