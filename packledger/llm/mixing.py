"""Interleaving sources to target weights by Pfair scheduling.

A source with integer weight q out of Q gets q of every Q slots.  Its block k
(counted from 0) is released at slot floor(k * Q / q) and due before slot
ceil((k + 1) * Q / q); in each slot the released block with the earliest
deadline runs, ties going to the first source.  With these windows every block
meets its deadline, so after any number of slots a source is less than one
block away from its share.  The schedule repeats after Q slots, so one period
is worked out and every block finds its slot by a join on its place in the period.

A block is one row.  Rows of a source are taken in the order of a hash of their
doc_id.  All rows are given a slot; ``in_mix`` says whether the slot lies within
the horizon up to which every source still has blocks, which is the part of the
schedule that holds the weights.  ``in_order`` gives all rows: a source that has
run dry leaves its slots empty, and the others go on at their weights.

Scale: DataFrame functions only.  Rows are numbered within (source, bucket of
the hash) and the counts of the buckets before are added, so a hot source is
split over all buckets.  The period has as many rows as the weights add up to.

Cases: a null source is a source of its own; repeated rows take slots of their
own; a null doc_id hashes like any other value; an empty table gives no rows; other columns are not read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import fresh, written

#: What the weights add up to, about: each source's is rounded, with 1 at least.
SCALE = 1000
#: Rows of a source count to this power in the default weights (1: as they come, 0: all sources alike).
POWER = 0.7


def source_key(source: Column) -> Column:
    """A source as a join key: null is a value of its own."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def tempered(rows: DataFrame, power: float = POWER, scale: int = SCALE) -> DataFrame:
    """(src, n, q): rows and integer weight of each source, weights in proportion to n ** power."""
    sizes = rows.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    mass = F.pow(F.col("n").cast("double"), F.lit(power))
    share = mass / F.sum(mass).over(Window.partitionBy(F.lit(0)))
    return sizes.select("src", "n", F.greatest(F.lit(1), F.round(share * scale)).cast("long").alias("q"))


def period(weights: DataFrame) -> DataFrame:
    """(src, q, period_slots, slots, horizon) of each source of a (src, n, q) table.

    ``slots`` lists the slots of one period that the source runs in.  The weights
    fold into one array and the slots into a fold over it; its state is how many
    blocks each source has run, and what ran in the slots so far.  ``horizon`` is
    the first slot that a source would have to fill without a block.
    """
    one = weights.agg(F.array_sort(F.collect_list(F.struct("src", "n", "q"))).alias("w"))
    one = one.select("w", F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x["q"]).alias("total"))

    def slot(state, t):
        windows = F.zip_with("w", state["done"], lambda x, d: F.struct(
            F.floor(d * F.col("total") / x["q"]).alias("release"),
            F.ceil((d + 1) * F.col("total") / x["q"]).alias("due")))
        ready = F.transform(windows, lambda x, i: F.struct(
            F.when(x["release"] <= t, x["due"]).otherwise(F.lit(2 ** 62)).alias("due"), i.alias("i")))
        pick = F.array_min(ready)["i"]
        return F.struct(
            F.zip_with(state["done"], F.sequence(F.lit(0), F.size("w") - 1),
                       lambda d, i: F.when(i == pick, d + 1).otherwise(d)).alias("done"),
            F.concat(state["ran"], F.array(pick)).alias("ran"))

    start = F.struct(F.transform("w", lambda x: F.lit(0).cast("long")).alias("done"),
                     F.array().cast("array<int>").alias("ran"))
    ran = F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("total") - 1), start, slot, lambda state: state["ran"])
    runs = one.where("total > 0").select("w", "total", F.posexplode(ran).alias("place", "i")).select(
        F.expr("w[i]").alias("x"), "total", F.col("place").cast("long").alias("place"))
    each = runs.groupBy("x", "total").agg(F.sort_array(F.collect_list("place")).alias("slots")).select(
        "x.src", "x.n", "x.q", F.col("total").alias("period_slots"), "slots")
    empty_at = (F.floor(F.col("n") / F.col("q")) * F.col("period_slots")
                + F.element_at("slots", (F.col("n") % F.col("q") + 1).cast("int")))
    return each.select("src", "q", "period_slots", "slots",
                       F.min(empty_at).over(Window.partitionBy("period_slots")).alias("horizon"))


def numbered(rows: DataFrame) -> DataFrame:
    """The rows with ``k``, their place within their source from 0 (columns src, spot, doc_id)."""
    rows = rows.withColumn("bucket", F.substring("spot", 1, 3))  # 4096 buckets
    sizes = rows.groupBy("src", "bucket").agg(F.count(F.lit(1)).alias("held"))
    before = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("src", "bucket", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"))
    here = Window.partitionBy("src", "bucket").orderBy("spot", "doc_id")
    ranked = rows.withColumn("r", F.row_number().over(here))
    return ranked.join(offsets, ["src", "bucket"]).withColumn(
        "k", F.col("r") + F.col("before") - 1).drop("r", "before", "bucket")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, source, src, spot): what the schedule reads of a row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"))
    return rows.select("doc_id", "source", source_key(F.col("source")).alias("src"), spot(F.col("doc_id")).alias("spot"))


def spot(doc_id: Column) -> Column:
    """Where a row stands in the order of its source."""
    return F.md5(F.coalesce(doc_id.cast("long").cast("string"), F.lit("")).cast("binary"))


def schedule(docs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(doc_id, source, block, weight, period_slots, release_at, due_at, slot, in_mix) of every row.

    ``weights`` has (source, q) with q a whole number above 0; without it they are
    ``tempered``.  A source without a weight is left out of the schedule.
    """
    rows = keyed(docs)
    sizes = tempered(rows)
    if weights is not None:
        given = weights.select(source_key(F.col("source").cast("string")).alias("src"), F.col("q").cast("long").alias("q"))
        sizes = sizes.drop("q").join(given, "src")
    k, q, total = F.col("k"), F.col("q"), F.col("period_slots")
    return _placed(rows, period(sizes)).select(
        "doc_id", "source", k.alias("block"), q.alias("weight"), "period_slots",
        F.floor(k * total / q).alias("release_at"), F.ceil((k + 1) * total / q).alias("due_at"),
        "slot", (F.col("slot") < F.col("horizon")).alias("in_mix"))


def _placed(rows: DataFrame, periods: DataFrame) -> DataFrame:
    """The numbered rows with their source's period and their ``slot``."""
    k, q, total = F.col("k"), F.col("q"), F.col("period_slots")
    return numbered(rows).join(periods, "src").withColumn(
        "slot", F.floor(k / q) * total + F.element_at("slots", (k % q + 1).cast("int")))


def in_order(docs: DataFrame) -> DataFrame:
    """All rows of ``docs``, whole, in the order of their slots under tempered weights."""
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"), F.col("doc_id").cast("long").alias("doc_id"),
        source_key(F.col("source").cast("string")).alias("src"), spot(F.col("doc_id")).alias("spot"))
    periods = written(period(tempered(rows)), "mix-period")  # its stored size decides how it is joined
    return _placed(rows, periods).orderBy("slot").select("whole.*")


def mixed(docs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs``, whole, that lie in the mix.

    A source keeps its rows up to its last one within the horizon; rows of a
    source that are alike in doc_id stay or go together.
    """
    own, bound = fresh(docs, "own_source", "bound")
    last = (schedule(docs, weights).where("in_mix")
            .select(source_key(F.col("source")).alias(own), _turn(F.col("doc_id")).alias("at"))
            .groupBy(own).agg(F.max("at").alias(bound)))
    last = written(last, "mix-last")  # one row per source; its stored size decides how it is joined
    keyed = docs.withColumn(own, source_key(F.col("source").cast("string")))
    return keyed.join(last, own).where(_turn(F.col("doc_id")) <= F.col(bound)).select(
        *(F.col(f"`{c}`") for c in docs.columns))


def _turn(doc_id: Column) -> Column:
    """What orders the rows of a source; no id comes before all ids at the same spot."""
    return F.struct(spot(doc_id).alias("spot"), F.coalesce(doc_id.cast("long"), F.lit(-2 ** 63)).alias("id"))


#: The schedule in SQL, for the whole documents table and the default weights.
SQL = f"""
WITH RECURSIVE placed AS (
  SELECT doc_id, source, coalesce('=' || source, 'null') AS src,
         md5(coalesce(cast(doc_id AS varchar), '')) AS spot FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY spot, doc_id) - 1 AS k FROM placed),
counted AS (SELECT src, count(*) AS n FROM placed GROUP BY src),
sizes AS (SELECT src, n, greatest(1, round(pow(n, {POWER}) / sum(pow(n, {POWER})) OVER () * {SCALE}))::BIGINT AS q
          FROM counted),
w AS (SELECT list(q ORDER BY src) AS qs, list(src ORDER BY src) AS srcs, sum(q)::BIGINT AS total FROM sizes),
sim AS (
  SELECT 0::BIGINT AS t, 0::BIGINT AS pick, list_transform(qs, lambda x: 0::BIGINT) AS done, qs, total FROM w
  UNION ALL
  SELECT t + 1, p, list_transform(done, lambda d, i: d + (i = p)::BIGINT), qs, total FROM (
    SELECT t, done, qs, total, list_position(due, list_min(due))::BIGINT AS p FROM (
      SELECT t, done, qs, total, list_transform(done, lambda d, i: CASE WHEN (d * total) // qs[i] <= t
               THEN ((d + 1) * total + qs[i] - 1) // qs[i] ELSE 4611686018427387904 END) AS due
      FROM sim WHERE t < total))),
slots AS (SELECT srcs[pick] AS src, t - 1 AS place, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS nth
          FROM sim, w WHERE t > 0),
ends AS (SELECT min(n // q * total + place) AS horizon FROM sizes JOIN slots USING (src), w WHERE nth = n % q)
SELECT doc_id, source, k AS block, q AS weight, total AS period_slots, k * total // q AS release_at,
       ((k + 1) * total + q - 1) // q AS due_at, k // q * total + place AS slot,
       k // q * total + place < horizon AS in_mix
FROM ranked JOIN sizes USING (src) JOIN slots ON slots.src = ranked.src AND nth = k % q, w, ends
"""
