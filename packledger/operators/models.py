"""From listings to models: merge, size split, variant collapse, identity and meta.

Bags and variants are separate tables.  Members of a model are never gathered
into one row: unions of colours, sizes, tags, images and addresses are child
tables, and everything else is an aggregate that combines before the shuffle.
"""
from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..durable import cut
from ..functions import fixed as X, scalars as S, text as X2
from ..functions.rules import let, rx
from ..functions.skew import numbered, ranked, running_sum


# --- sources ----------------------------------------------------------------

def drop_removed(products: DataFrame, roster: DataFrame):
    """Products of sources that are still listed, and what each removed source held."""
    gone = roster.where(F.coalesce("platform", F.lit("")) == "removed").select("slug")
    kept = products.join(gone, products["brand_slug"] == gone["slug"], "left_anti")
    dropped = (products.join(gone, products["brand_slug"] == gone["slug"], "left_semi")
               .groupBy("brand_slug").agg(F.count(F.lit(1)).alias("dropped")))
    return kept, dropped


def drop_shadowed(bags: DataFrame, aggregator: str = "aggregator:"):
    """An aggregator's row gives way where a direct source carries the brand."""
    from_agg = F.coalesce(F.startswith("source", F.lit(aggregator)), F.lit(False))
    direct, agg = bags.where(~from_agg), bags.where(from_agg)
    known = direct.select(F.lower("brand").alias("__b")).distinct()
    on = F.lower("brand") == F.col("__b")
    return (direct.unionByName(agg.join(known, on, "left_anti")), agg.join(known, on, "left_semi"))


# --- names ------------------------------------------------------------------

def model_key(name: Column) -> Column:
    """Name without trailing colours (two passes), folded."""
    s = F.coalesce(name, F.lit(""))
    for _ in range(2):
        s = F.regexp_replace(s, rx(X.TRAILING_COLOUR), "")
    return F.lower(F.trim(F.regexp_replace(s, r"(?U)\s+", " ")))


def trailing_colour(name: Column) -> Column:
    """The colour a name ends with, or null."""
    hit = F.trim(F.regexp_extract(F.coalesce(name, F.lit("")), rx(X.TRAILING_COLOUR), 0))
    clean = F.trim(F.regexp_replace(hit, r"(?i)^(?:in\s+|[-–—|,:/]\s*)", ""))
    return F.nullif(clean, F.lit(""))


def strip_colour(name: Column) -> Column:
    """struct(name, colour): the display name without its colour, unless it is all there is."""
    bare = F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), rx(X.TRAILING_COLOUR), ""))
    return let(F.struct(name.alias("n"), bare.alias("b")), lambda s: F.when(
        s["b"] != "", F.struct(s["b"].alias("name"), trailing_colour(s["n"]).alias("colour")))
        .otherwise(F.struct(s["n"].alias("name"), F.lit(None).cast("string").alias("colour"))))


# --- merge ------------------------------------------------------------------

class Models(NamedTuple):
    bags: DataFrame        # one row per model
    variants: DataFrame    # variants under their model id
    members: DataFrame     # (listing id, model id, url, ord)
    values: DataFrame      # (id, kind, value, pos): ordered-distinct unions


def merge_models(bags: DataFrame, variants: DataFrame) -> Models:
    """One model per (brand, key).  The best specified listing gives the base row."""
    score = sum(F.col(f).isNotNull().cast("int")
                for f in ("volume_l", "dims_cm", "weight_g", "laptop_in"))
    df = bags.withColumn("__key", model_key(F.col("name"))).withColumn("__score", score)
    group = ["brand_slug", "__key"]
    row = F.struct(*[F.col(c) for c in bags.columns])
    rank = F.struct("__score", -F.col("ord"))

    def fill(value: str, source: str | None = None) -> Column:
        """The base row's figure, else the first listing that has one."""
        pair = F.struct(F.col(value).alias("v"), (F.col(source) if source else F.lit(
            None).cast("string")).alias("s"))
        return F.min_by(pair, F.when(F.col(value).isNotNull(), F.col("ord")))

    out = df.groupBy(*group).agg(
        F.max_by(row, rank).alias("base"), F.count(F.lit(1)).cast("int").alias("merged_from"),
        F.min_by("name", F.struct(F.length("name"), "ord")).alias("short"),
        fill("volume_l", "volume_source").alias("f_volume_l"),
        fill("dims_cm", "dims_source").alias("f_dims_cm"),
        fill("weight_g", "weight_source").alias("f_weight_g"),
        fill("laptop_in").alias("f_laptop_in"),
        F.min_by("image", F.when(F.col("image").isNotNull(), F.col("ord"))).alias("f_image"),
        F.bool_or("in_stock").alias("f_in_stock"), F.bool_or("on_sale").alias("f_on_sale"),
        F.min("price_min").alias("l_min"), F.max(F.greatest("price_max", "price_min")).alias("l_max"),
        F.min("ord").alias("f_ord"))
    out = out.withColumn("id", F.col("base.id"))
    ids = out.select(*group, "id")
    out = out.join(_vocabularies(df, group), group, "left")
    members = (df.select(*group, F.col("id").alias("listing_id"), "url", "ord", "name")
               .join(ids, group).select("listing_id", "id", "url", "ord", "name"))
    moved = (variants.join(members.select("listing_id", F.col("id").alias("__m"),
                                          F.col("ord").alias("__o")),
                           F.col("bag_id") == F.col("listing_id"))
             .withColumn("bag_id", F.col("__m")).withColumn("__at", F.struct("__o", "pos")))
    # variant position inside the model: listing order, then the listing's own order
    moved = ranked(moved.drop("listing_id", "__m"), ["bag_id"], [F.col("__at")], "__rn")
    moved = moved.withColumn("pos", F.col("__rn") - 1).select(*variants.columns)
    prices = moved.groupBy("bag_id").agg(
        F.min("price").alias("v_min"), F.max("price").alias("v_max"),
        F.count(F.lit(1)).cast("int").alias("v_n")).withColumnRenamed("bag_id", "__vid")
    out = out.join(prices, F.col("id") == F.col("__vid"), "left")
    clean = F.when(F.col("merged_from") > 1, F.col("short")).otherwise(F.col("base.name"))
    out = out.withColumn("__sc", strip_colour(clean))
    base = lambda c: F.col("base." + c)
    over = {
        "id": F.col("id"), "name": F.col("__sc.name"), "merged_from": F.col("merged_from"),
        "image": F.coalesce(base("image"), F.col("f_image")),
        **{c: F.coalesce("f_" + c, F.array().cast("array<string>")) for c in VOCABULARIES},
        "in_stock": F.col("f_in_stock"),
        "on_sale": F.col("f_on_sale"), "ord": F.col("f_ord"),
        "variant_count": F.coalesce("v_n", F.lit(0)),
        "price_min": F.round(F.coalesce("v_min", "l_min"), 2),
        "price_max": F.round(F.coalesce("v_max", "l_max"), 2)}
    for f, s in (("volume_l", "volume_source"), ("dims_cm", "dims_source"),
                 ("weight_g", "weight_source"), ("laptop_in", None)):
        over[f] = F.coalesce(base(f), F.col(f"f_{f}.v"))
        if s:
            over[s] = F.when(base(f).isNotNull(), base(s)).otherwise(F.col(f"f_{f}.s"))
    over["linear_cm"] = X2.linear(over["dims_cm"])
    merged = out.select(*[(over[c] if c in over else base(c)).alias(c) for c in bags.columns])
    return Models(merged, moved, members, model_values(df, members, group, out))


VOCABULARIES = ["materials", "features", "color_families"]


def _vocabularies(df: DataFrame, group: list[str]) -> DataFrame:
    """Sorted union of each vocabulary column per group; repeats go before anything is gathered."""
    tagged = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda v: F.struct(
        F.lit(c).alias("kind"), v.alias("value")))
    seen = df.select(*group, F.explode(F.concat(*[tagged(c) for c in VOCABULARIES])).alias("x")).select(
        *group, "x.kind", "x.value").distinct()
    return seen.groupBy(*group).agg(*[F.array_sort(F.collect_set(F.when(
        F.col("kind") == c, F.col("value")))).alias("f_" + c) for c in VOCABULARIES])


def model_values(listings: DataFrame, members: DataFrame, group: list[str],
                 models: DataFrame) -> DataFrame:
    """Ordered-distinct unions over the listings of a model, one row per value."""
    member = members.select(F.col("listing_id").alias("__l"), F.col("id").alias("__m"))
    df = listings.join(member, F.col("id") == F.col("__l"))
    parts = [df.select(F.col("__m").alias("id"), F.lit(kind).alias("kind"),
                       F.col("ord").alias("o"), F.posexplode(kind).alias("p", "value"))
             for kind in ("colors", "sizes", "tags")]
    named = df.select(F.col("__m").alias("id"), F.lit("colors").alias("kind"), F.lit(
        2 ** 62).cast("bigint").alias("o"), F.col("ord").alias("p"),
        trailing_colour(F.col("name")).alias("value"))
    urls = df.select(F.col("__m").alias("id"), F.lit("urls").alias("kind"),
                     F.col("ord").alias("o"), F.lit(0).alias("p"), F.col("url").alias("value"))
    every = parts[0]
    for p in [*parts[1:], named, urls]:
        every = every.unionByName(p)
    return (every.where(F.col("value").isNotNull()).groupBy("id", "kind", "value")
            .agg(F.min(F.struct("o", "p")).alias("first")))


# --- size split -------------------------------------------------------------

def uniq_id(candidates: DataFrame, taken: DataFrame, candidate: str = "candidate",
            order: list[Column] | None = None, out: str = "id") -> DataFrame:
    """The candidate id, or its first free suffixed form (-2, -3, …), per claimant in order."""
    order = order or [F.col("ord")]
    held = taken.select(F.col("id").alias("__t")).distinct()
    df = candidates.join(held, F.col(candidate) == F.col("__t"), "left").withColumn(
        "__held", F.col("__t").isNotNull().cast("int")).drop("__t")
    df = ranked(df, [candidate], order, "__c")
    # claimant k (1-based) needs the (k - 1 + held)-th free suffix, 0 meaning none
    df = df.withColumn("__need", F.col("__c") - 1 + F.col("__held"))
    suffix = r"^(.*)-([2-9]|[1-9]\d{1,17})$"
    used = (held.select(F.regexp_extract("__t", suffix, 1).alias("__stem"),
                        F.nullif(F.regexp_extract("__t", suffix, 2), F.lit("")).cast("bigint").alias("__k"))
            .where(F.col("__k").isNotNull()))
    used = used.join(df.select(F.col(candidate).alias("__stem")).distinct(), "__stem", "left_semi")
    wanted = df.where("__need > 0").select(F.col(candidate).alias("__stem"), F.col("__need").alias("__free"),
                                           F.lit(0).alias("__gap"), F.lit(0).cast("bigint").alias("__taken"))
    # the need-th free suffix comes after as many taken ones as have fewer than need free ones below
    met = running_sum(wanted.unionByName(_gaps(used)), ["__stem"], [F.col("__free"), F.col("__gap")],
                      F.floor(F.col("__free") / _DENSE), F.col("__taken"), "__skip")
    met = met.where("__gap = 0").select("__stem", "__free", "__skip")
    df = df.join(met, (F.col(candidate) == F.col("__stem")) & (F.col("__need") == F.col("__free")), "left")
    return df.withColumn(out, F.when(F.col("__need") == 0, F.col(candidate)).otherwise(
        F.concat(F.col(candidate), F.lit("-"), F.col("__need") + 1 + F.col("__skip")))).drop(
        "__held", "__c", "__need", "__stem", "__free", "__skip")


#: Whole numbers that differ within a key, to a bucket.
_DENSE = 65536


def _gaps(used: DataFrame) -> DataFrame:
    """Where taken suffixes stand: how many lie behind ``__free`` free ones of their stem (2 is the first)."""
    placed = numbered(used, ["__stem"], [F.col("__k")], F.floor(F.col("__k") / _DENSE), "__nth")
    return placed.groupBy("__stem", (F.col("__k") - 1 - F.col("__nth")).alias("__free")).agg(
        F.count(F.lit(1)).alias("__taken")).select("__stem", "__free", F.lit(1).alias("__gap"), "__taken")


def split_sizes(bags: DataFrame, variants: DataFrame):
    """One bag per capacity where every variant states one and there are two at least.

    Returns (bags, variants).  Dimensions are dropped from the children: they
    belong to one size and nothing says which.
    """
    v = variants.withColumn("__vol", X2.volume(F.col("size")))
    sizes = v.groupBy("bag_id", "__vol").agg(
        F.count(F.lit(1)).cast("int").alias("s_count"),
        F.min(F.nullif("price", F.lit(0.0))).alias("s_min"),
        F.max(F.nullif("price", F.lit(0.0))).alias("s_max"),
        F.bool_or(F.coalesce("available", F.lit(False))).alias("s_stock"),
        F.bool_or(F.coalesce(F.col("compare_at") > F.col("price"), F.lit(False))).alias("s_sale"),
        F.max(F.nullif("grams", F.lit(0))).alias("s_grams"),
        F.min_by("image", F.when(F.col("image").isNotNull(), F.col("pos"))).alias("s_image"),
        F.array_sort(F.collect_set("color_family")).alias("s_families"))
    line = sizes.groupBy("bag_id").agg(
        F.bool_and(F.col("__vol").isNotNull()).alias("all_sized"),
        F.count("__vol").alias("n"), F.min("__vol").alias("least"))
    line = line.where(F.col("all_sized") & (F.col("n") >= 2)).select("bag_id", "least")
    whole = bags.join(line, bags["id"] == line["bag_id"], "left_anti")
    kids = (bags.join(line, bags["id"] == line["bag_id"]).drop("bag_id")
            .join(sizes.withColumnRenamed("bag_id", "__b"), F.col("id") == F.col("__b")))
    own = sizes.select(F.col("bag_id").alias("__ob"), F.col("__vol").alias("__ov")).distinct()
    kids = kids.join(own, (F.col("id") == F.col("__ob")) & (F.col("volume_l") == F.col("__ov")),
                     "left").withColumn("__legacy", F.coalesce("__ov", "least")).drop("__ob", "__ov")
    label = S.size_label(F.col("__vol"))
    kids = (kids.withColumn("__parent", F.col("id")).withColumn("candidate", F.concat(
        "id", F.lit("-"), S.slugify(label))).drop("id"))
    kids = uniq_id(kids, bags, order=[F.col("ord"), F.col("__vol")])
    over = {
        "name": F.trim(F.concat_ws(" ", S.name_without_volumes(F.col("name")), label)),
        "variant_count": F.col("s_count"), "price_min": F.round("s_min", 2),
        "price_max": F.round("s_max", 2), "in_stock": F.col("s_stock"),
        "on_sale": F.col("s_sale"), "volume_l": F.col("__vol"),
        "volume_source": F.lit("variant-option"), "weight_g": F.col("s_grams"),
        "weight_source": F.when(F.col("s_grams").isNotNull(), "shopify:grams"),
        "dims_cm": F.lit(None).cast("array<double>"), "dims_source": F.lit(None).cast("string"),
        "linear_cm": F.lit(None).cast("double"), "image": F.coalesce("s_image", "image"),
        "color_families": F.col("s_families"), "split_from": F.col("__parent"),
        "legacy_slug": F.when(F.col("__vol") == F.col("__legacy"), S.slugify(F.col("name")))}
    children = kids.select(*[(over[c] if c in over else F.col(c)).alias(c) for c in bags.columns],
                           F.col("__vol").alias("__cv"))
    owner = children.select(F.col("id").alias("__cid"), F.col("split_from").alias("__cp"), "__cv")
    moved = (v.join(owner, (F.col("bag_id") == F.col("__cp"))
                    & (F.col("__vol") == F.col("__cv")), "left")
             .withColumn("bag_id", F.coalesce("__cid", "bag_id")))
    return (whole.unionByName(children.drop("__cv")), moved.select(*variants.columns))


# --- variant collapse -------------------------------------------------------

class Collapsed(NamedTuple):
    variants: DataFrame    # kept variants
    axes: DataFrame        # (bag_id, axis, value) of collapsed bags
    bags: DataFrame        # (bag_id, collapsed_from, kept)


def collapse_variants(variants: DataFrame, above: int) -> Collapsed:
    """One variant per (colour, price) where a bag lists more than ``above`` of them; 0 takes every bag."""
    colour = F.coalesce(F.nullif("color", F.lit("")), F.nullif("color_family", F.lit("")), "title")
    v = variants.withColumn("__colour", colour)
    pairs = v.groupBy("bag_id", "__colour", "price").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(F.coalesce("available", F.lit(False)))
        .alias("__any"), F.min("pos").alias("__first"))
    per_bag = pairs.groupBy("bag_id").agg(F.sum("n").alias("collapsed_from"),
                                          F.count(F.lit(1)).alias("kept"))
    hit = per_bag.where((F.col("collapsed_from") > above)
                        & (F.col("kept") < F.col("collapsed_from")))
    firsts = pairs.join(hit, "bag_id").select(
        F.col("bag_id").alias("__b"), F.col("__first"), F.col("__any"))
    untouched = variants.join(hit, "bag_id", "left_anti")
    kept = (variants.join(firsts, (F.col("bag_id") == F.col("__b"))
                          & (F.col("pos") == F.col("__first")))
            .withColumn("available", F.col("available") | F.col("__any"))
            .select(*variants.columns))
    axes = (variants.join(hit, "bag_id", "left_semi")
            .select("bag_id", F.explode("options").alias("axis", "value"))
            .where(F.coalesce("value", F.lit("")) != "").distinct())
    return Collapsed(untouched.unionByName(kept), axes, hit)


# --- identity ---------------------------------------------------------------

def permalink(bags: DataFrame) -> DataFrame:
    """Slug of the name, id tail when it has none, numbered when the brand repeats it."""
    slug = S.slugify(F.col("name"))
    df = bags.drop("slug").withColumn("__slug", F.when(slug != "", slug).otherwise(
        F.when(F.contains("id", F.lit("__")), F.regexp_replace("id", r"^.*?__", ""))
        .otherwise(F.col("id"))))
    order = [F.lower("brand"), F.lower("name"), F.col("ord")]
    df = ranked(df, ["brand_slug", "__slug"], order, "__n")
    return df.withColumn("slug", F.when(F.col("__n") > 1, F.concat(
        "__slug", F.lit("-"), "__n")).otherwise(F.col("__slug"))).drop("__slug", "__n")


def usd_approx(bags: DataFrame, rates: DataFrame) -> DataFrame:
    """Dollar estimate of a foreign price; the price itself stays as stated."""
    side = rates.select(F.col("currency").alias("__cur"), F.col("per_usd").alias("__rate"))
    foreign = F.coalesce("currency", F.lit("USD"))
    df = bags.drop("price_usd_approx").join(side, foreign == F.col("__cur"), "left")
    ok = (foreign != "USD") & (F.col("__rate") != 0) & (F.col("price_min") != 0)
    return df.withColumn("price_usd_approx", F.when(
        ok, F.round(F.col("price_min") / F.col("__rate"), 2))).drop("__cur", "__rate")


# --- meta -------------------------------------------------------------------

def coverage(bags: DataFrame, fields: list[str] = X.COVERAGE_FIELDS) -> DataFrame:
    """(field, have, pct) of the bags that state each field."""
    one = bags.agg(F.count(F.lit(1)).alias("n"), *[F.count(f).alias(f) for f in fields])
    out = one.unpivot(["n"], fields, "field", "have")
    return out.select("field", "have", F.when(F.col("n") > 0, F.bround(
        F.lit(100.0) * F.col("have") / F.col("n"), 0).cast("int")).otherwise(0).alias("pct"))


#: Columns whose mix is counted, and those whose different values are.
_MIXES = {"currency": "currencies", "currency_source": "currency_sources", "category": "categories"}
_DISTINCT = {"brand_slug": "brand_count", "category": "category_count", "split_from": "models_split"}
_TOTALS = ("bag_count", "sku_count", "products_merged")


def catalogue_meta(bags: DataFrame, rejects: DataFrame | None = None) -> DataFrame:
    """Long (metric, key, value) table of catalogue totals and mixes, in one pass over the bags.

    The bags are grouped by each column at once (grouping sets); a group then says
    what it adds to the totals, to its mix and to the number of different values.
    """
    # a struct is never null, so a null value is told from a column that is not grouped by
    columns = list(dict.fromkeys([*_MIXES, *_DISTINCT]))
    rows = bags.select(*[F.struct(F.col(c).cast("string").alias("v")).alias(c) for c in columns],
                       F.col("variant_count").cast("bigint").alias("skus"),
                       (F.col("merged_from") - 1).cast("bigint").alias("merged"))
    sets = rows.groupingSets([[F.col(c)] for c in columns], *columns).agg(
        F.count(F.lit(1)).alias("bag_count"), F.coalesce(F.sum("skus"), F.lit(0)).alias("sku_count"),
        F.coalesce(F.sum("merged"), F.lit(0)).alias("products_merged"))
    said = lambda metric, key, value: F.struct(
        F.lit(metric).alias("metric"), key.alias("key"), value.cast("bigint").alias("value"))
    none, parts = F.lit(""), []
    for c in columns:
        adds = [said(_MIXES[c], F.coalesce(F.col(c)["v"], F.lit("unknown")), F.col("bag_count"))] if c in _MIXES else []
        if c in _DISTINCT:
            adds.append(said(_DISTINCT[c], none, F.col(c)["v"].isNotNull().cast("int")))
        if c == columns[0]:
            adds += [said(t, none, F.col(t)) for t in _TOTALS]
        parts.append(F.when(F.col(c).isNotNull(), F.array(*adds)))
    empty = bags.sparkSession.createDataFrame(
        [(t, "", 0) for t in (*_TOTALS, *_DISTINCT.values())], "metric string, key string, value bigint")
    out = (sets.select(F.explode(F.coalesce(*parts)).alias("s")).select("s.*").unionByName(empty)
           .groupBy("metric", "key").agg(F.sum("value").alias("value")))
    if rejects is not None:
        out = out.unionByName(rejects.groupBy(F.col("reason").alias("key")).agg(
            F.count(F.lit(1)).alias("value")).select(F.lit("rejected").alias("metric"),
                                                     "key", "value"))
    return out


def indexable() -> Column:
    """Enough is known to show the bag: dimensions, or a volume and a weight."""
    return F.col("dims_cm").isNotNull() | F.coalesce(
        (F.col("volume_l") != 0) & (F.col("weight_g") != 0), F.lit(False))


def legacy_redirects(bags: DataFrame) -> DataFrame:
    """Old path to new path, unless something live answers at the old one."""
    path = S.bag_path(F.col("brand_slug"), F.col("slug"))
    old = S.bag_path(F.col("brand_slug"), F.col("legacy_slug"))
    live = bags.select(path.alias("__live")).distinct()
    return (bags.where(F.coalesce("legacy_slug", F.lit("")) != "")
            .select(old.alias("from_path"), path.alias("to_path"))
            .join(live, F.col("from_path") == F.col("__live"), "left_anti"))


def variant_urls(bags: DataFrame, variants: DataFrame, listings: DataFrame) -> DataFrame:
    """Address of each colourway: the one listing whose handle names it, else a deep link.

    ``listings`` holds (bag_id, url), all addresses of a model.
    """
    handles = (listings.where(F.coalesce("url", F.lit("")) != "").distinct()
               .withColumn("handle", S.url_handle(F.col("url"))))
    count = handles.groupBy("bag_id").agg(F.count(F.lit(1)).alias("__n"))
    owner = bags.select(F.col("id").alias("bag_id"), F.when(
        F.startswith("source", F.lit("shopify:")), F.col("url")).alias("__deep"))
    v = (variants.select("bag_id", "pos", "variant_id", S.alnum_label(
        F.coalesce(F.nullif("color", F.lit("")), "title")).alias("__key"))
        .join(owner, "bag_id", "left").join(count, "bag_id", "left"))
    # a colour is matched once per (bag, colour), not once per variant
    keys = v.where((F.col("__n") > 1) & (F.length("__key") >= 3)).select("bag_id", "__key").distinct()
    hits = (keys.join(handles, "bag_id").where(F.contains("handle", F.col("__key")))
            .groupBy("bag_id", "__key").agg(F.count(F.lit(1)).alias("__h"),
                                            F.min("url").alias("__u"))
            .where(F.col("__h") == 1).drop("__h"))
    deep = F.when(F.col("variant_id").isNotNull(), F.concat(
        "__deep", F.lit("?variant="), F.col("variant_id").cast("string")))
    return v.join(hits, ["bag_id", "__key"], "left").select(
        "bag_id", "pos", F.coalesce("__u", deep).alias("url"))


def offers(bags: DataFrame, listings: DataFrame) -> DataFrame:
    """One offer per seller host; the bag's own address comes first and carries the price."""
    own = bags.select(F.col("id").alias("bag_id"), "url", F.lit(-1).cast("bigint").alias("ord"))
    every = own.unionByName(listings.select("bag_id", "url", F.col("ord").cast("bigint"))).where(
        F.coalesce("url", F.lit("")) != "")
    host = F.coalesce(S.host(F.col("url")), F.col("url"))
    first = (every.withColumn("host", host).groupBy("bag_id", "host")
             .agg(F.min(F.struct("ord", "url")).alias("f"))
             .select("bag_id", "host", F.col("f.url").alias("url"),
                     (F.col("f.ord") == -1).alias("canonical")))
    price = bags.select(F.col("id").alias("bag_id"), S.price_range_text(
        F.col("price_min"), F.col("price_max"), F.col("currency")).alias("__p"))
    return first.join(price, "bag_id").withColumn(
        "price", F.when(F.col("canonical"), F.col("__p"))).drop("__p")


def build(bags: DataFrame, variants: DataFrame, rates: DataFrame, collapse_above: int = 0):
    """Shadow filter, merge, split, collapse, permalink and dollar estimate, in that order.

    Bags of more than ``collapse_above`` variants are collapsed: all of them, unless told otherwise.

    Each step reads its input several times, so every step's result is written
    to the shared folder before the next one starts.
    """
    kept = cut(drop_shadowed(bags)[0])
    live = cut(variants.join(kept.select(F.col("id").alias("bag_id")), "bag_id", "left_semi"))
    merged = merge_models(kept, live)
    sized, sized_variants = split_sizes(cut(merged.bags), cut(merged.variants))
    sized, slim = cut(sized), collapse_variants(cut(sized_variants), collapse_above)
    return usd_approx(permalink(sized), rates), slim.variants, merged.values
