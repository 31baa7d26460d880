"""Category hubs and catalogue reports."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed as X, scalars as S
from ..functions.rules import literal_map
from ..functions.skew import exact_median, ranked, top_k
from .models import indexable


def gpl() -> Column:
    return S.grams_per_litre(F.col("weight_g"), F.col("volume_l"))


def rankable() -> Column:
    return F.coalesce(gpl() >= X.MIN_PLAUSIBLE_GPL, F.lit(False))


def by_density() -> list[Column]:
    """Lightest per litre first; implausible and unknown densities last, by brand."""
    return [F.when(rankable(), gpl()).asc_nulls_last(), F.when(
        ~rankable(), S.collated(F.col("brand"))).asc_nulls_last(), F.col("ord").asc()]


def hub_stats(bags: DataFrame, keys: list[str] = ["category"]) -> DataFrame:
    """Counts, dollar price range and exact interpolated medians per group."""
    usd = F.col("currency") == "USD"
    three = F.coalesce(F.size("dims_cm") >= 3, F.lit(False))
    out = bags.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("brand_slug").alias("brands"),
        F.min(F.when(usd, F.col("price_min"))).alias("price_low"),
        F.max(F.when(usd, F.col("price_min"))).alias("price_high"),
        F.count_if(F.col("price_min").isNotNull() & ~usd).alias("other_currency"),
        F.count_if(three).alias("measured"),
        F.count_if(three & (F.col("linear_cm") <= X.COMMON_CARRYON_CM)).alias("carry_on"))
    for col, name, width in ((F.col("volume_l"), "median_volume", 1.0),
                             (F.col("weight_g").cast("double"), "median_weight", 50.0),
                             (gpl(), "median_gpl", 1.0)):
        out = out.join(exact_median(bags, keys, col, name, width), keys, "left")
    return out


def volume_band() -> Column:
    """The half-open volume band of a bag."""
    col = F.col("volume_l")
    inside = lambda lo, hi: (col >= lo) if hi is None else (col >= lo) & (col < hi)
    return F.coalesce(*[F.when(inside(lo, hi), slug) for slug, lo, hi in X.VOLUME_BANDS])


def volume_facets(bags: DataFrame, least: int = X.MIN_FACET) -> DataFrame:
    """Bags per category and volume band; ``listed`` where there are enough for a page."""
    return (bags.where(F.col("volume_l").isNotNull()).withColumn("band", volume_band())
            .where(F.col("band").isNotNull()).groupBy("category", "band")
            .agg(F.count(F.lit(1)).alias("n")).withColumn("listed", F.col("n") >= least))


def laptop_facets(bags: DataFrame, least: int = X.MIN_FACET, share: float = 0.75) -> DataFrame:
    """Nested laptop sizes; ``listed`` where large enough and clearly smaller than the last listed."""
    sizes = X.LAPTOP_HUB_SIZES
    per = bags.groupBy("category").agg(
        *[F.count_if(F.col("laptop_in") >= s).alias(f"n{s}") for s in sizes])
    kept, cols = F.lit(None).cast("bigint"), []
    for s in sizes:
        n = F.col(f"n{s}")
        ok = (n >= least) & (kept.isNull() | (n <= kept * F.lit(share)))
        cols.append(F.struct(F.lit(s).alias("inches"), n.alias("n"), ok.alias("listed")))
        kept = F.when(ok, n).otherwise(kept)
    return per.select("category", F.explode(F.array(*cols)).alias("f")).select(
        "category", "f.inches", "f.n", "f.listed")


def hubs(bags: DataFrame) -> DataFrame:
    """All categories with what they hold and whether the hub is worth indexing."""
    out = bags.groupBy("category").agg(F.count(F.lit(1)).alias("total"),
                                       F.count_if(indexable()).alias("listed"))
    slug = F.try_element_at(literal_map(X.HUB_SLUG), F.col("category"))
    return (out.withColumn("slug", slug).where(slug.isNotNull())
            .withColumn("indexable", F.col("listed") >= X.MIN_FACET)
            .orderBy(F.desc("listed"), "category"))


def _ranked(rows: DataFrame, keys: list[str], value: str, k: int | None) -> DataFrame:
    """Place ``rn`` of every row by a figure; with ``k``, the first k."""
    order = [F.col(value), F.col("ord")]
    if k is not None:
        return top_k(rows, keys, order, k)
    return ranked(rows, keys, order)


def lightest(bags: DataFrame, k: int | None = None) -> DataFrame:
    rows = bags.where(indexable() & rankable()).withColumn("gpl", gpl())
    return _ranked(rows, ["category"], "gpl", k)


def cheapest(bags: DataFrame, k: int | None = None) -> DataFrame:
    """Cheapest per litre, dollars only."""
    rows = bags.where(indexable() & rankable() & (F.col("currency") == "USD")).withColumn(
        "ppl", S.price_per_litre(F.col("price_min"), F.col("volume_l")))
    return _ranked(rows.where(F.col("ppl").isNotNull()), ["category"], "ppl", k)


def leaderboards(bags: DataFrame, k: int | None = None) -> DataFrame:
    a = lightest(bags, k).select("category", F.lit("lightest").alias("board"), "rn", "id",
                                 F.col("gpl").alias("value"))
    b = cheapest(bags, k).select("category", F.lit("cheapest").alias("board"), "rn", "id",
                                 F.col("ppl").alias("value"))
    return a.unionByName(b)


def makers(bags: DataFrame) -> DataFrame:
    return (bags.where(indexable()).groupBy("category", "brand_slug")
            .agg(F.min("brand").alias("brand"), F.count(F.lit(1)).alias("n"))
            .orderBy("category", F.desc("n"), "brand"))


def facet_rows(bags: DataFrame, k: int | None = None) -> DataFrame:
    """Bags of each volume facet with their place in density order and the facet's members.

    With ``k``, the first k of a facet, and how many that leaves out.
    """
    rows = bags.where(indexable() & F.col("volume_l").isNotNull()).withColumn(
        "band", volume_band()).where(F.col("band").isNotNull())
    sizes = volume_facets(bags.where(indexable())).withColumnRenamed("n", "members")
    keys = ["category", "band"]
    if k is None:
        top = ranked(rows, keys, by_density())
    else:
        top = top_k(rows, keys, by_density(), k)
    left_out = F.lit(0).cast("bigint") if k is None else F.greatest(F.col("members") - k, F.lit(0))
    return top.join(sizes, keys).withColumn("withheld", left_out)


def brand_shelves(bags: DataFrame) -> DataFrame:
    return bags.groupBy("brand_slug").agg(
        F.min_by("brand", "ord").alias("brand"), F.count(F.lit(1)).alias("n"),
        F.countDistinct("category").alias("categories"), F.min("price_min").alias("price_low"),
        F.max("price_min").alias("price_high"), F.min_by("currency", "ord").alias("currency"))


def related(bags: DataFrame, k: int) -> DataFrame:
    """Other bags of the same brand and category, then of the category, in catalogue order.

    Only the first ``k + 1`` bags of a brand shelf and the first ``2k`` of a
    category can ever be answers, so those short lists are joined, not the groups.
    """
    order = [F.col("ord")]
    shelf = top_k(bags, ["brand_slug", "category"], order, k + 1).select(
        "brand_slug", "category", F.col("id").alias("other"), F.col("ord").alias("o"))
    shelf = shelf.groupBy("brand_slug", "category").agg(
        F.array_sort(F.collect_list(F.struct("o", "other"))).alias("same"))
    # a brand with more than k bags here fills the list itself, so 2k rows are enough
    every = top_k(bags, ["category"], order, 2 * k)
    rest = every.groupBy("category").agg(F.array_sort(F.collect_list(F.struct(
        F.col("ord").alias("o"), F.col("id").alias("other"), "brand_slug"))).alias("rest"))
    df = bags.select("id", "brand_slug", "category").join(
        shelf, ["brand_slug", "category"], "left").join(rest, "category", "left")
    own = F.transform(F.filter("same", lambda s: s["other"] != F.col("id")), lambda s: s["other"])
    others = F.transform(F.filter("rest", lambda s: s["brand_slug"] != F.col("brand_slug")),
                         lambda s: s["other"])
    picks = F.slice(F.concat(own, others), 1, k)
    return df.select("id", F.posexplode(picks).alias("place", "related_id"))


def siblings(bags: DataFrame) -> DataFrame:
    """Sizes of one split model, smallest first, with their place in the line."""
    kids = bags.where(F.col("split_from").isNotNull()).select(
        "split_from", "id", "volume_l", "ord")
    size = F.coalesce("volume_l", F.lit(0.0))
    out = ranked(kids, ["split_from"], [size, F.col("ord")], "place")
    n = kids.groupBy("split_from").agg(F.count(F.lit(1)).alias("sizes"))
    return out.join(n, "split_from").select("split_from", "id", "volume_l", "place", "sizes")


def lastmod(bags: DataFrame, changes: DataFrame) -> DataFrame:
    """Last change per bag, brand, hub and volume facet: stated update or last price move.

    ``changes`` holds (bag_id, ts) of directional ledger rows.
    """
    last = changes.groupBy(F.col("bag_id").alias("__b")).agg(F.max("ts").alias("__t"))
    df = bags.join(last, F.col("id") == F.col("__b"), "left").withColumn(
        "stamp", F.greatest(S.to_utc(F.col("updated_at")), F.col("__t")))
    df = df.where(F.col("stamp").isNotNull()).withColumn("band", F.when(
        indexable(), volume_band()))
    # a struct is never null where its set takes the row, so a null brand is told from another set
    kinds = {"bag": F.struct("id"), "brand": F.struct("brand_slug"), "hub": F.when(indexable(), F.struct("category")),
             "facet": F.when(F.col("band").isNotNull(), F.struct(F.concat_ws("/", "category", "band").alias("k")))}
    rows = df.select(*[k.alias(n) for n, k in kinds.items()], "stamp")
    sets = rows.groupingSets([[F.col(n)] for n in kinds], *kinds).agg(F.max("stamp").alias("stamp"))
    key = F.coalesce(*[F.when(F.col(n).isNotNull(), F.struct(
        F.lit(n).alias("kind"), F.col(n).getField(list(rows.schema[n].dataType.names)[0]).alias("key"))) for n in kinds])
    return sets.select(key.alias("k"), "stamp").where(F.col("k").isNotNull()).select("k.*", "stamp")


def hub_samples(bags: DataFrame, k: int) -> DataFrame:
    """The first bags of each hub by label."""
    order = S.label_order(F.col("brand")) + S.label_order(F.col("name")) + [F.col("ord")]
    return top_k(bags.where(indexable()), ["category"], order, k)


# --- audits -----------------------------------------------------------------

def colour_audit(bags: DataFrame, variants: DataFrame, rulings: DataFrame) -> DataFrame:
    """Colourway names without a family, per brand, and whether anyone has ruled on them."""
    name = F.trim(F.coalesce("color", F.lit("")))
    owner = bags.select(F.col("id").alias("bag_id"), "brand_slug")
    blank = F.coalesce("color_family", F.lit("")) == ""
    from_variants = variants.where(blank).join(owner, "bag_id").select(
        "brand_slug", "bag_id", name.alias("name"))
    bare = bags.where(F.coalesce(F.size("color_families"), F.lit(0)) <= 0).select(
        "brand_slug", F.col("id").alias("bag_id"), F.explode("colors").alias("c")).select(
        "brand_slug", "bag_id", F.trim("c").alias("name"))
    extra = bare.join(from_variants.select("bag_id", "name").distinct(), ["bag_id", "name"],
                      "left_anti")
    rows = from_variants.unionByName(extra.select("brand_slug", "bag_id", "name")).where(
        F.col("name") != "").withColumn("key", S.norm_key(F.col("name")))
    out = rows.groupBy("brand_slug", "key").agg(
        F.min("name").alias("name"), F.count(F.lit(1)).alias("skus"),
        F.countDistinct("bag_id").alias("bags"))
    ruled = rulings.select(F.col("brand").alias("brand_slug"), "key").distinct().withColumn(
        "__r", F.lit(True))
    return out.join(ruled, ["brand_slug", "key"], "left").withColumn(
        "decided", F.coalesce("__r", F.lit(False))).drop("__r")


def colour_coverage(bags: DataFrame, variants: DataFrame) -> DataFrame:
    """How many bags answer no colour, state none, or answer some colourways only."""
    named = F.coalesce("color", F.lit("")) != ""
    per = variants.groupBy("bag_id").agg(
        F.bool_or(named).alias("any_named"),
        F.bool_or(named & (F.coalesce("color_family", F.lit("")) == "")).alias("any_open"))
    df = bags.join(per, bags["id"] == per["bag_id"], "left")
    none = F.coalesce(F.size("color_families"), F.lit(0)) <= 0
    silent = (F.coalesce(F.size("colors"), F.lit(0)) <= 0) & ~F.coalesce("any_named", F.lit(False))
    return df.agg(F.count(F.lit(1)).alias("bags"), F.count_if(none).alias("invisible"),
                  F.count_if(silent).alias("silent"),
                  F.count_if(~none & F.coalesce("any_open", F.lit(False))).alias("partial"))


def ruling_check(bags: DataFrame, variants: DataFrame, rulings: DataFrame) -> DataFrame:
    """Whether each colour ruling reached every variant of that name."""
    owner = bags.select(F.col("id").alias("bag_id"), F.col("brand_slug").alias("brand"))
    named = variants.join(owner, "bag_id").select(
        "brand", S.norm_key(F.col("color")).alias("key"),
        F.nullif("color_family", F.lit("")).alias("family"))
    ruled = rulings.select("brand", "key", F.col("value").alias("ruled_family"))
    hit = named.join(ruled, ["brand", "key"]).groupBy("brand", "key").agg(
        F.count(F.lit(1)).alias("skus"),
        F.bool_and(F.col("family").eqNullSafe(F.col("ruled_family"))).alias("applied"))
    return ruled.join(hit, ["brand", "key"], "left").select(
        "brand", "key", "ruled_family", F.coalesce("skus", F.lit(0).cast("bigint")).alias("skus"),
        F.coalesce("applied", F.lit(False)).alias("applied"))


def reject_audit(rejects: DataFrame, bags: DataFrame, rulings: DataFrame) -> DataFrame:
    """Rejects per reason: total, of brands in the catalogue, already ruled on."""
    held = bags.select(F.col("brand_slug").alias("__b")).distinct().withColumn("__in", F.lit(True))
    ruled = rulings.select(F.col("brand").alias("__rb"), F.col("key").alias("__rk")).distinct(
    ).withColumn("__ruled", F.lit(True))
    df = (rejects.withColumn("key", S.product_key(F.col("url")))
          .join(held, F.col("brand_slug") == F.col("__b"), "left")
          .join(ruled, (F.col("brand_slug") == F.col("__rb")) & (F.col("key") == F.col("__rk")),
                "left"))
    return df.groupBy("reason").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.coalesce("__in", F.lit(False))).alias("in_catalogue"),
        F.count_if(F.coalesce("__ruled", F.lit(False))).alias("decided")).orderBy(
        F.desc("n"), "reason")


def admitted(bags: DataFrame, rulings: DataFrame) -> DataFrame:
    """Category rulings that admit a product, and the bag each one admitted."""
    keyed = bags.select(F.col("brand_slug").alias("brand"), S.product_key(F.col("url")).alias("key"),
                        "id", "ord").groupBy("brand", "key").agg(F.min_by("id", "ord").alias("id"))
    return rulings.where(F.col("value").isNotNull()).join(keyed, ["brand", "key"], "left")
