"""Order- and rank-dependent primitives that survive a hot key.

A plain window over ``key`` sorts every row of the key in one task.  Here a key
is cut into ordered buckets first: per-bucket totals are small and carry the
running value across buckets, and the row-level work happens per (key, bucket).
All results are exact.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..durable import cut

_B, _OFF = "__bucket", "__offset"


def _same(left: DataFrame, right: DataFrame, names: list[str]):
    cond = F.lit(True)
    for n in names:
        cond = cond & left[n].eqNullSafe(right[n])
    return cond


def _attach(df: DataFrame, side: DataFrame, names: list[str], keep: list[str]) -> DataFrame:
    """Null-safe equi-join that keeps one copy of the join columns."""
    side = side.select(*[F.col(n).alias("__r_" + n) for n in names], *keep)
    cond = F.lit(True)
    for n in names:
        cond = cond & F.col(n).eqNullSafe(F.col("__r_" + n))
    return df.join(side, cond, "left").drop(*["__r_" + n for n in names])


#: Bytes of stored payload that are worth a task of their own where reading them takes much work,
#: and bytes a task may get before the input counts as large.
GRAIN, LARGE = 16 * 1024, 128 * 1024 * 1024


def dealt(df: DataFrame) -> DataFrame:
    """A small, dense input dealt out to tasks before work that costs far more than reading it.

    The number of tasks follows the input's bytes, up to what the cluster runs at
    once.  An input that is read in as many parts already, a large one and one of
    unknown size are left where they are, so nothing large is ever moved.
    """
    if df.isStreaming:
        return df
    plan, cores = df._jdf.queryExecution(), df.sparkSession.sparkContext.defaultParallelism
    size = int(str(plan.optimizedPlan().stats().sizeInBytes()))
    parts = min(-(-size // GRAIN), cores)
    if size > cores * LARGE or parts <= plan.toRdd().getNumPartitions():
        return df
    return df.repartition(parts)


def numbered(df: DataFrame, keys: list[str], order: list[Column], bucket: Column,
             name: str = "rn") -> DataFrame:
    """Exact 1-based position of every row inside its key.

    ``bucket`` must not decrease along ``order``.  Rows of one bucket are
    numbered together; the counts of the buckets before it are added.
    """
    df = df.withColumn(_B, bucket)
    sizes = df.groupBy(*keys, _B).agg(F.count(F.lit(1)).alias("__n"))
    before = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(
        _B).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn(_OFF, F.coalesce(F.sum("__n").over(before), F.lit(0)))
    df = _attach(df, sizes, [*keys, _B], [_OFF])
    here = Window.partitionBy(*keys, _B).orderBy(*order)
    return df.withColumn(name, F.row_number().over(here) + F.col(_OFF)).drop(_B, _OFF)


#: What a task numbers at most 2 ** 33 rows with (``monotonically_increasing_id``).
_IN_TASK = 33


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rn") -> DataFrame:
    """Exact 1-based position of every row inside its key, however keys and order values are spread.

    Rows are dealt by sampled split points of (keys, order), so ranges are even
    and a hot key is divided among them.  The sorted ranges are written with each
    row's place in its range; the counts of a key in the ranges before are added.
    ``order`` should end with something unique, or equal rows stay together.
    """
    keyed = [F.col(k) for k in keys]
    spread = cut(df.repartitionByRange(*keyed, *order).sortWithinPartitions(*keyed, *order)
                 .withColumn("__at", F.monotonically_increasing_id())
                 .withColumn(_B, F.shiftright("__at", _IN_TASK)))
    held = spread.groupBy(*keys, _B).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(
        _B).rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn(_OFF, F.coalesce(F.sum("__n").over(before), F.lit(0)))
    out = _attach(spread, held, [*keys, _B], ["__first", _OFF])
    return out.withColumn(name, F.col("__at") - F.col("__first") + F.col(_OFF) + 1).drop("__at", _B, "__first", _OFF)


def running_sum(df: DataFrame, keys: list[str], order: list[Column], bucket: Column,
                value: Column, name: str) -> DataFrame:
    """Exact running sum (current row included) inside a key, bucket by bucket."""
    df = df.withColumn(_B, bucket).withColumn("__v", value)
    sums = df.groupBy(*keys, _B).agg(F.sum("__v").alias("__s"))
    before = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(
        _B).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn(_OFF, F.coalesce(F.sum("__s").over(before), F.lit(0)))
    df = _attach(df, sums, [*keys, _B], [_OFF])
    here = Window.partitionBy(*keys, _B).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum("__v").over(here) + F.col(_OFF)).drop(_B, _OFF, "__v")


def previous(df: DataFrame, keys: list[str], order: list[Column], bucket: Column,
             row: Column, name: str) -> DataFrame:
    """The value of ``row`` (a struct) on the preceding row of the key, or null."""
    df = df.withColumn(_B, bucket).withColumn("__v", row)
    rank = F.struct(*[F.struct(c.isNotNull(), c) for c in order])
    last = df.groupBy(*keys, _B).agg(F.max_by("__v", rank).alias("__last"))
    by_bucket = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(_B)
    last = last.withColumn("__carry", F.lag("__last").over(by_bucket))
    df = _attach(df, last, [*keys, _B], ["__carry"])
    here = Window.partitionBy(*keys, _B).orderBy(*order)
    first = F.row_number().over(here) == 1
    return df.withColumn(name, F.when(first, F.col("__carry")).otherwise(
        F.lag("__v").over(here))).drop(_B, "__v", "__carry")


def first_per_key(df: DataFrame, keys: list, order: list[Column]) -> DataFrame:
    """First row of each key.  Spark prunes to one row per key before the shuffle."""
    return top_k(df, keys, order, 1).drop("rn")


def top_k(df: DataFrame, keys: list, order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows of each key, pruned to ``k`` per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def value_at_rank(df: DataFrame, keys: list[str], value: Column, ranks: dict[str, Column],
                  bucket_width: float = 1.0) -> DataFrame:
    """Exact order statistics per key, with no key sorted in one task.

    ``ranks`` maps an output name to a 1-based rank written over the column
    ``n`` (non-null values of the key).  Values are counted, the counts are cut
    into ranges of ``bucket_width``, the range that holds each rank is found
    over the range totals, and only that range is ordered.
    """
    v = (df.select(*keys, value.alias("__v")).where(F.col("__v").isNotNull())
         .groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__c"))
         .withColumn(_B, F.floor(F.col("__v") / F.lit(bucket_width))))
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    totals = (v.groupBy(*keys, _B).agg(F.sum("__c").alias("__t"))
              .withColumn("n", F.sum("__t").over(part))
              .withColumn("__hi", F.sum("__t").over(
                  part.orderBy(_B).rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("__lo", F.col("__hi") - F.col("__t")))
    wanted = F.explode(F.array(*[F.struct(F.lit(n).alias("what"), r.cast("long").alias("rank"))
                                 for n, r in ranks.items()]))
    hit = (totals.withColumn("__w", wanted)
           .where((F.col("__w.rank") > F.col("__lo")) & (F.col("__w.rank") <= F.col("__hi")))
           .select(*[F.col(k).alias("__k_" + k) for k in keys], F.col(_B).alias("__hb"), "n",
                   "__lo", F.col("__w.what").alias("what"), F.col("__w.rank").alias("rank")))
    inside = Window.partitionBy(*keys, _B).orderBy("__v").rowsBetween(
        Window.unboundedPreceding, 0)
    v = v.withColumn("__cum", F.sum("__c").over(inside))
    cond = F.col(_B) == F.col("__hb")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col("__k_" + k))
    found = v.join(hit, cond).where(
        (F.col("rank") <= F.col("__lo") + F.col("__cum"))
        & (F.col("rank") > F.col("__lo") + F.col("__cum") - F.col("__c")))
    return found.groupBy(*keys).agg(
        F.max("n").alias("n"),
        *[F.max(F.when(F.col("what") == n, F.col("__v"))).alias(n) for n in ranks])


def exact_median(df: DataFrame, keys: list[str], value: Column, name: str,
                 bucket_width: float = 1.0) -> DataFrame:
    """Interpolated median per key (mean of the middle two when the count is even)."""
    n = F.col("n")
    out = value_at_rank(df, keys, value, {
        "__a": F.floor((n + 1) / 2), "__b": F.floor((n + 2) / 2)}, bucket_width)
    return out.select(*keys, ((F.col("__a") + F.col("__b")) / 2).alias(name))
