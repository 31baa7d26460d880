"""Backlog of pages to read, and the merge of page facts into the catalogue."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed as X, text as X2
from ..functions.skew import first_per_key, ranked

PAGE_FIELDS = ["dims_cm", "dims_source", "laptop_in", "volume_l", "volume_source", "weight_g",
               "weight_source", "gtin"]
PERMANENT = [404, 410, 451]


def page_key() -> Column:
    """The page an entry was read off: sizes split from one model share it."""
    return F.coalesce(F.nullif("split_from", F.lit("")), F.col("id"))


def enrichable() -> Column:
    ok = F.lit(False)
    for s in X.ENRICHABLE_SOURCES:
        ok = ok | F.startswith(F.coalesce("source", F.lit("shopify")), F.lit(s))
    return ok


def backlog(bags: DataFrame, cache: DataFrame) -> DataFrame:
    """Entries that miss dimensions or laptop size and whose page was never read."""
    want = bags.withColumn("page_key", page_key()).where(enrichable()).where(
        F.col("dims_cm").isNull() | F.col("laptop_in").isNull())
    return want.join(cache.select("page_key"), "page_key", "left_anti")


def missing_pages(bags: DataFrame, cache: DataFrame, pages: DataFrame) -> DataFrame:
    """Cached entries that answered but whose page was not kept."""
    answered = cache.where(F.col("status").isNull()).select("page_key")
    return (bags.withColumn("page_key", page_key()).where(enrichable())
            .join(answered, "page_key", "left_semi")
            .join(pages.select("page_key"), "page_key", "left_anti"))


def dedupe(df: DataFrame, key: str = "page_key") -> DataFrame:
    """First entry of each page."""
    return first_per_key(df, [key], [F.col("ord")])


def interleave(df: DataFrame, key: str = "brand_slug") -> DataFrame:
    """Round-robin position across brands: (round, first sight of the brand)."""
    seen = df.groupBy(key).agg(F.min("ord").alias("__seen")).withColumnRenamed(key, "__k")
    out = ranked(df, [key], [F.col("ord")], "turn")
    return out.join(seen, F.col(key) == F.col("__k")).drop("__k").withColumn(
        "turn_order", F.col("__seen")).drop("__seen").orderBy("turn", "turn_order")


def size_guard(bags: DataFrame, cache: DataFrame) -> DataFrame:
    """Attach page facts as ``x``; a split entry gets size-bound ones only for its own size."""
    fields = [c for c in cache.columns if c != "page_key"]
    side = cache.select(F.col("page_key").alias("__pk"), F.struct(*fields).alias("x"))
    df = bags.withColumn("page_key", page_key()).join(
        side, F.col("page_key") == F.col("__pk"), "left").drop("__pk")
    other = F.col("split_from").isNotNull() & ~F.col("x.volume_l").eqNullSafe(F.col("volume_l"))
    bound = [f for f in X.SIZE_BOUND_FIELDS if f in fields]
    stated = F.lit(False)
    for f in bound:
        stated = stated | F.col("x." + f).isNotNull()
    df = df.withColumn("withheld", F.col("x").isNotNull() & other & stated)
    guarded = F.struct(*[(F.when(~other, F.col("x." + f)) if f in bound else F.col("x." + f))
                         .alias(f) for f in fields])
    return df.withColumn("x", F.when(F.col("x").isNotNull(), guarded))


def supersede_weight(df: DataFrame) -> DataFrame:
    """A page's weight replaces a shipping weight or a sweep, never a stated figure."""
    weak = (F.coalesce("x.weight_g", F.lit(0)) != 0) & F.col("weight_source").isin(
        X.SUPERSEDED_WEIGHT_SOURCES) & ~F.col("x.weight_g").eqNullSafe(F.col("weight_g"))
    weak = F.coalesce(weak, F.lit(False))
    return (df.withColumn("weight_fixed", weak)
            .withColumn("weight_source", F.when(weak, F.coalesce(
                "x.weight_source", F.lit("product-page"))).otherwise(F.col("weight_source")))
            .withColumn("weight_g", F.when(weak, F.col("x.weight_g"))
                        .otherwise(F.col("weight_g"))))


def fill_gaps(df: DataFrame) -> DataFrame:
    """Page facts fill nulls only; the linear sum follows new dimensions."""
    filled = F.col("dims_cm").isNull() & F.col("x.dims_cm").isNotNull()
    df = df.withColumn("dims_filled", filled)
    cols = {f: F.coalesce(F.col(f), F.col("x." + f)) for f in PAGE_FIELDS}
    cols["linear_cm"] = F.when(F.col("dims_filled"), X2.linear(F.col("x.dims_cm"))).otherwise(
        F.col("linear_cm"))
    return df.withColumns(cols)


def union_features(df: DataFrame) -> DataFrame:
    """Add what the page names, and record that it was scanned."""
    scanned = F.col("x.features_source").isNotNull()
    empty = F.array().cast("array<string>")
    both = lambda c: F.array_sort(F.array_union(F.coalesce(F.col(c), empty),
                                                F.coalesce(F.col("x." + c), empty)))
    return df.withColumns({
        "features_gained": scanned & (F.size(both("features")) > F.size(
            F.coalesce("features", empty))),
        "features": F.when(scanned, both("features")).otherwise(F.col("features")),
        "materials": F.when(scanned, both("materials")).otherwise(F.col("materials")),
        "features_source": F.when(scanned, "product-page").otherwise(
            F.coalesce("features_source", F.lit("description")))})


def merge_pages(bags: DataFrame, cache: DataFrame) -> DataFrame:
    """Guard, supersede, fill, union — with the flags that count each."""
    return union_features(fill_gaps(supersede_weight(size_guard(bags, cache))))


def enrich_gaps(bags: DataFrame, cache: DataFrame) -> DataFrame:
    """Why dimensions are missing, per brand, the worst brand first."""
    why = cache.where(F.col("dims_cm").isNull() & F.col("no_dims").isNotNull()).select(
        F.col("page_key").alias("__pk"), "no_dims")
    hit = bags.withColumn("page_key", page_key()).join(why, F.col("page_key") == F.col("__pk"))
    n = lambda r: F.count_if(F.col("no_dims") == r)
    return (hit.groupBy("brand_slug").agg(
        n("no-spec-text").alias("no_spec_text"), n("not-published").alias("not_published"),
        n("unparsed").alias("unparsed"), F.count(F.lit(1)).alias("total"))
        .orderBy(F.desc("total"), "brand_slug"))


def route_outcomes(attempts: DataFrame) -> DataFrame:
    """Last outcome per page: landed, permanent (recorded) or transient (asked again)."""
    outcome = (F.when(F.coalesce("disallowed", F.lit(False)), "permanent")
               .when(F.col("status") == 200, "landed")
               .when(F.col("status").isin(PERMANENT), "permanent").otherwise("transient"))
    return (attempts.withColumn("outcome", outcome).groupBy("page_key")
            .agg(F.max_by(F.struct("outcome", "status"), F.struct("ts", "ord")).alias("o"))
            .select("page_key", F.col("o.outcome").alias("outcome"),
                    F.col("o.status").alias("status")))


def run_summary(attempts: DataFrame, cool_off: int = 4) -> DataFrame:
    """Attempted, landed and transient counts of a run, and stores dropped for repeated failure."""
    ok = F.col("status") == 200
    gone = F.col("status").isin(PERMANENT)
    per = attempts.groupBy("brand_slug").agg(
        F.count(F.lit(1)).alias("attempted"), F.count_if(ok).alias("landed"),
        F.count_if(~ok & ~gone).alias("transient"),
        F.max(F.when(ok | gone, F.struct("ts", "ord"))).alias("__last"))
    return per.select("brand_slug", "attempted", "landed", "transient",
                      ((F.col("transient") >= cool_off) & F.col("__last").isNull())
                      .alias("dropped"))
