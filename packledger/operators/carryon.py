"""Size limits of carriers against the dimensions of bags.

A bag meets a limit when it is below it on every axis.  Bags with like
dimensions are one shape.  The axes are cut at quantiles of the limits; a
carrier is put into every cell that its limit reaches, a shape is in one cell,
and the two meet by an equi-join on the cell, where the fit is worked out
exactly.  So pairs that cannot fit hardly meet, the larger side is not copied,
and neither table's size is bounded.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars as S
from ..functions.skew import ranked, top_k
from .models import indexable

#: Cells to an axis.
CELLS = 6


def carriers(airlines: DataFrame) -> DataFrame:
    """(airline, name, region, carry_on, linear, personal): a row per carrier, limits from the longest axis down."""
    triple = lambda c: F.sort_array(F.col(c).cast("array<double>"), asc=False)
    return airlines.select(
        S.slugify(F.col("name")).alias("airline"), "name", "region", triple("carry_on_cm").alias("carry_on"),
        F.col("carry_on_linear_cm").cast("double").alias("linear"), triple("personal_cm").alias("personal"))


def publishes(c) -> Column:
    """Whether a carrier states a carry-on limit; ``c`` gives its columns by name."""
    return c("carry_on").isNotNull() | c("linear").isNotNull()


def _fits(dims: Column, limit: Column) -> Column:
    """Every axis within the limit, largest against largest; null without three axes."""
    pairs = F.zip_with(F.sort_array(dims, asc=False), limit, lambda a, b: F.struct(
        a.alias("a"), b.alias("b")))
    # a bag axis without a limit to meet does not fit
    return F.when((F.size(dims) >= 3) & limit.isNotNull(), F.forall(
        pairs, lambda p: p["a"].isNull() | F.coalesce(p["a"] <= p["b"], F.lit(False))))


def fit(dims: Column, carrier) -> Column:
    """struct(carry_on, personal): true, false, or null where nothing can be said."""
    total = F.aggregate(dims, F.lit(0.0), lambda a, v: a + v)
    by_sum = F.when((F.size(dims) >= 3) & carrier["linear"].isNotNull(),
                    total <= carrier["linear"])
    by_axis = _fits(dims, carrier["carry_on"])
    both = F.when(by_sum.isNull(), by_axis).when(by_axis.isNull(), by_sum).otherwise(
        by_axis & by_sum)
    return F.struct(both.alias("carry_on"), _fits(dims, carrier["personal"]).alias("personal"))


def _axis(dims: Column, i: int) -> Column:
    return F.get(F.sort_array(dims, asc=False), F.lit(i))


def _cut_at(limits: DataFrame, what: str) -> Column:
    """For each axis, the quantiles of the limits that it is cut at, as one scalar struct."""
    shares = [k / CELLS for k in range(1, CELLS)]
    return limits.agg(F.struct(*[F.percentile_approx(F.get(what, F.lit(i)), shares, 1000).alias(f"a{i}")
                                 for i in range(3)])).scalar()


def _cell(value: Column, axis: int, unknown: int) -> Column:
    """How many cuts of the axis lie below a value; never less for a larger value."""
    below = F.size(F.filter(F.col("__cuts")[f"a{axis}"], lambda c: c < value))
    return F.when(value.isNull(), unknown).otherwise(F.greatest(below, F.lit(0)))


def shapes(bags: DataFrame) -> DataFrame:
    """(dims_cm, bags): the different dimensions of three axes or more, and how many bags have them."""
    return bags.where(F.size("dims_cm") >= 3).groupBy("dims_cm").agg(F.count(F.lit(1)).alias("bags"))


def met(dims: DataFrame, table: DataFrame, what: str = "carry_on") -> DataFrame:
    """``dims`` (dims_cm and others) with airline, name and region of every carrier whose limit it meets."""
    limits = table.where(publishes(F.col) if what == "carry_on" else F.col(what).isNotNull())
    cuts = _cut_at(limits, what).alias("__cuts")
    spread, placed = limits.select("*", cuts), dims.where(F.size("dims_cm") >= 3).select("*", cuts)
    for i in range(3):
        reach = F.sequence(F.lit(0), _cell(F.get(what, F.lit(i)), i, CELLS - 1))
        spread = spread.withColumn(f"__c{i}", F.explode(reach))
        placed = placed.withColumn(f"__c{i}", _cell(_axis(F.col("dims_cm"), i), i, 0))
    spread, placed = spread.drop("__cuts"), placed.drop("__cuts")
    carrier = {c: F.col(c) for c in ("carry_on", "linear", "personal")}
    return placed.join(spread, ["__c0", "__c1", "__c2"]).where(
        F.coalesce(fit(F.col("dims_cm"), carrier)[what], F.lit(False))).select(
        *dims.columns, "airline", "name", "region")


def measured(bags: DataFrame) -> DataFrame:
    return bags.where(indexable() & (F.size("dims_cm") >= 3))


def fit_matrix(bags: DataFrame, airlines: DataFrame) -> DataFrame:
    """bag x carrier, carry-on and personal item: by its nature a row for every pair."""
    every = carriers(airlines).agg(F.collect_list(F.struct("airline", "carry_on", "linear", "personal"))).scalar()
    pairs = bags.select("id", "dims_cm", every.alias("__all")).select("id", "dims_cm", F.explode("__all").alias("c"))
    return pairs.withColumn("f", fit(F.col("dims_cm"), F.col("c"))).select(
        "id", "c.airline", "f.carry_on", "f.personal")


def _by_shape(bags: DataFrame, found: DataFrame) -> DataFrame:
    """The bags with what was found for their dimensions (columns beside dims_cm)."""
    other = found.withColumnRenamed("dims_cm", "__dims")
    return bags.join(other, F.col("dims_cm") == F.col("__dims"), "left").drop("__dims")


def carriers_fitting(bags: DataFrame, airlines: DataFrame) -> DataFrame:
    """Add ``airlines``: slugs of the carriers whose carry-on limit the bag meets, in order; null without three axes."""
    none = F.array().cast("array<string>")
    found = met(shapes(bags).select("dims_cm"), carriers(airlines)).groupBy("dims_cm").agg(
        F.sort_array(F.collect_list("airline")).alias("__airlines"))
    return _by_shape(bags, found).withColumn("airlines", F.when(
        F.size("dims_cm") >= 3, F.coalesce("__airlines", none)).otherwise(none)).drop("__airlines")


def compliance(bags: DataFrame, airlines: DataFrame) -> DataFrame:
    """N of M carriers per bag, for bags with three known axes."""
    table, wanted = carriers(airlines), shapes(bags).select("dims_cm")
    out = bags.where(F.size("dims_cm") >= 3)
    for what in ("carry_on", "personal"):
        out = _by_shape(out, met(wanted, table, what).groupBy("dims_cm").agg(F.count(F.lit(1)).alias("__" + what)))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("int")
    said = lambda test: table.agg(F.count_if(test).cast("int")).scalar()
    return out.select("id", n("__carry_on").alias("carry_on"), said(publishes(F.col)).alias("carry_on_of"),
                      n("__personal").alias("personal"), said(F.col("personal").isNotNull()).alias("personal_of"))


def fits_by_airline(bags: DataFrame, airlines: DataFrame) -> DataFrame:
    """How many measured bags fit each carrier, with its region; carriers nobody fits stay."""
    table, wanted = carriers(airlines), shapes(measured(bags))
    out = airlines.select(S.slugify(F.col("name")).alias("airline"), "name", "region")
    for what, name in (("carry_on", "fits"), ("personal", "personal")):
        counts = met(wanted, table, what).groupBy("airline").agg(F.sum("bags").alias(name))
        out = out.join(counts, "airline", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return out.select("airline", "name", "region", zero("fits"), zero("personal"))


def strictest_loosest(by_airline: DataFrame) -> DataFrame:
    return by_airline.agg(
        F.min_by("airline", F.struct("fits", "airline")).alias("strictest"),
        F.min("fits").alias("strictest_fits"),
        F.max_by("airline", F.struct("fits", "airline")).alias("loosest"),
        F.max("fits").alias("loosest_fits"))


def just_misses(bags: DataFrame, airlines: DataFrame) -> DataFrame:
    """(airline, bag) where the bag fails the carrier but clears 60 % of all of them."""
    table, some = carriers(airlines), measured(bags)
    fitting = met(shapes(some).select("dims_cm"), table).groupBy("dims_cm").agg(
        F.count(F.lit(1)).cast("int").alias("fit_count"))
    total = table.agg(F.count_if(publishes(F.col))).scalar()
    near = fitting.where(F.col("fit_count") >= F.ceil(total * F.lit(0.6)))
    every = table.agg(F.collect_list(F.struct("airline", "carry_on", "linear", "personal"))).scalar()
    # a shape that clears most carriers misses few of them, so there are few pairs more than answers
    missed = near.select("dims_cm", "fit_count", every.alias("__all")).select(
        "dims_cm", "fit_count", F.explode("__all").alias("c")).where(
        F.coalesce(~fit(F.col("dims_cm"), F.col("c"))["carry_on"], F.lit(False))).select(
        F.col("dims_cm").alias("__dims"), "fit_count", "c.airline")
    return some.join(missed, F.col("dims_cm") == F.col("__dims")).select(
        "airline", "id", "fit_count", "volume_l").orderBy(
        "airline", F.desc("fit_count"), F.desc(F.coalesce("volume_l", F.lit(0.0))), "id")


def _fitting_rows(bags: DataFrame, airlines: DataFrame) -> DataFrame:
    """(airline, id, volume_l, category): a row for each bag and carrier whose limit it meets."""
    pairs = met(shapes(bags).select("dims_cm"), carriers(airlines)).select(F.col("dims_cm").alias("__dims"), "airline")
    return bags.join(pairs, F.col("dims_cm") == F.col("__dims")).select("airline", "id", "volume_l", "category")


def largest_fits(bags: DataFrame, airlines: DataFrame, k: int | None = None) -> DataFrame:
    """Bags of known volume that fit each carrier, with their place from the largest; with ``k``, the first k."""
    rows = _fitting_rows(measured(bags).where(F.col("volume_l").isNotNull()), airlines)
    order = [F.desc("volume_l"), F.col("id")]
    return ranked(rows, ["airline"], order) if k is None else top_k(rows, ["airline"], order, k)


def category_mix(bags: DataFrame, airlines: DataFrame) -> DataFrame:
    return _fitting_rows(measured(bags), airlines).groupBy("airline", "category").agg(F.count(F.lit(1)).alias("n"))


def slug_unique(airlines: DataFrame) -> DataFrame:
    """Carrier slugs that more than one carrier claims; must be empty."""
    return (airlines.groupBy(S.slugify(F.col("name")).alias("airline"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first"),
                 F.max("name").alias("last")).where(F.col("n") > 1))
