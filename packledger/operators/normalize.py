"""Platform payloads to one catalogue schema.

Every normaliser takes a table of raw products with the brand context attached
(``brand_slug, brand_name, domain, locale, fetched_at, ord`` plus ``ruling`` and,
for the storefront shape, ``hint_category`` and ``hint_is_bag``) and returns a
:class:`Normalised` triple of tables: bags, variants, rejects.
"""
from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..durable import cut
from ..functions import fixed as X, scalars as S, text as X2
from ..functions.rules import let, literal_map, lookup, matches, once
from ..functions.skew import dealt, first_per_key
from ..schemas import BAG, VARIANT, conform
from . import classify as C, pages as P

CONTEXT = ["brand_slug", "brand_name", "domain", "locale", "fetched_at", "ord", "ruling"]


class Normalised(NamedTuple):
    bags: DataFrame
    variants: DataFrame
    rejects: DataFrame


def first_hit(values: Column, finder) -> Column:
    return F.get(F.filter(F.transform(values, lambda v: finder(v)), lambda v: v.isNotNull()),
                 F.lit(0))


def truthy(col: Column) -> Column:
    """A price of zero is a price not stated."""
    return F.nullif(col.cast("string").try_cast("double"), F.lit(0.0))


def filled(values: Column) -> Column:
    return F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != "")))


def rung(value: Column, source) -> Column:
    source = F.lit(source) if isinstance(source, str) else source
    return F.when(value.isNotNull(), F.struct(value.alias("value"), source.alias("source")))


def resolve(*rungs: Column) -> Column:
    """First rung that has a value, with the name of the rung."""
    return F.coalesce(*rungs)


def locale_path() -> Column:
    tag = F.regexp_replace(F.coalesce("locale", F.lit("")), r"^/+|/+$", "")
    return F.when(tag != "", F.concat(F.lit("/"), tag)).otherwise("")


def _missing(df: DataFrame, **defaults) -> DataFrame:
    for name, kind in defaults.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def _finish(df: DataFrame, title: Column, shelf: Column, tags: Column, url: Column) -> Normalised:
    """Split a decided table with a nested ``variants`` column into the three tables."""
    accepted = df.where(F.col("outcome.reason").isNull())
    bags = accepted.withColumns({
        "brand": F.coalesce("brand_name", "brand_slug"),
        "category": F.col("outcome.category"), "category_source": F.col("outcome.source"),
        "linear_cm": X2.linear(F.col("dims_cm")), "variant_count": F.size("variants"),
        "price_market": F.coalesce(F.nullif(F.regexp_replace(
            F.coalesce("locale", F.lit("")), r"^/+|/+$", ""), F.lit("")), F.lit("default")),
    })
    variants = accepted.select(F.col("id").alias("bag_id"),
                               F.posexplode("variants").alias("pos", "v")).select(
        "bag_id", "pos", "v.*")
    return Normalised(conform(bags, BAG), conform(variants, VARIANT),
                      _rejects(df, title, shelf, tags, url))


def _rejects(df: DataFrame, title: Column, shelf: Column, tags: Column,
             url: Column) -> DataFrame:
    out = _missing(df, ruling_ruled="boolean").where(F.col("outcome.reason").isNotNull())
    return out.select(
        "brand_slug", F.col("outcome.reason").alias("reason"), title.alias("title"),
        F.nullif(shelf, F.lit("")).alias("product_type"), tags.alias("tags"),
        url.alias("url"),
        (F.coalesce("ruling_ruled", F.lit(False)) & F.col("ruling").isNull()).alias("reviewed"))


def no_tags() -> Column:
    return F.array().cast("array<string>")


# --- storefront shape -------------------------------------------------------

def normalize_shopify(raw: DataFrame) -> Normalised:
    """Products with option axes and per-variant prices, images and weights."""
    df = _missing(dealt(raw), ruling="string", hint_category="string", hint_is_bag="boolean",
                  brand_name="string", locale="string", fetched_at="timestamp")
    df = df.withColumn("tags", F.coalesce("tags", no_tags())).withColumn("outcome", once(C.decide_category(
        F.col("title"), F.col("product_type"), F.array_join("tags", " "),
        F.col("hint_category"), F.col("hint_is_bag"), F.col("ruling"))))
    # the verdict comes first: bodies and variants are read of accepted products only
    taken = F.col("outcome.reason").isNull()
    df = df.withColumn("__body", X2.strip_html(F.when(taken, F.col("body_html"))))

    axis = lambda pattern: let(F.get(F.filter(
        "options", lambda o: matches(o["name"], pattern)), F.lit(0)), lambda o: F.when(
            o.isNotNull(), F.coalesce(o["position"], F.lit(1)) - 1))
    df = df.withColumn("__ci", axis(X.OPTION_COLOUR)).withColumn("__si", axis(X.OPTION_SIZE))
    names = F.transform(F.slice("options", 1, 3), lambda o: F.trim(o["name"]))
    df = df.withColumn("axis_names", F.filter(F.coalesce(names, no_tags()),
                                              lambda n: (n != "") & (F.lower(n) != "title")))
    df = df.withColumn("__names", names)

    def variant(v: Column) -> Column:
        opts = F.array(v["option1"], v["option2"], v["option3"])
        color = F.get(opts, F.col("__ci"))
        color = F.when(~S.is_part_number(color), F.nullif(color, F.lit("")))
        size = F.nullif(F.get(opts, F.col("__si")), F.lit(""))
        pairs = F.filter(F.zip_with(F.col("__names"), opts, lambda n, o: F.struct(
            n.alias("key"), o.alias("value"))), lambda e: (e["key"] != "") & (e["value"] != "")
            & (F.lower(e["key"]) != "title"))
        last = F.filter(pairs, lambda e, i: ~F.exists(
            F.slice(pairs, i + 2, 3), lambda x: x["key"] == e["key"]))
        by_id = F.get(F.filter("images", lambda im: F.array_contains(
            im["variant_ids"], v["id"])), F.lit(0))["src"]
        return F.struct(
            F.nullif(v["sku"], F.lit("")).alias("sku"), v["id"].alias("variant_id"),
            v["title"].alias("title"), F.map_from_entries(last).alias("options"),
            color.alias("color"), size.alias("size"), truthy(v["price"]).alias("price"),
            truthy(v["compare_at_price"]).alias("compare_at"),
            F.coalesce(v["available"], F.lit(False)).alias("available"),
            F.nullif(v["grams"], F.lit(0)).cast("int").alias("grams"),
            F.coalesce(v["featured_image"]["src"], by_id).alias("image"))

    df = df.withColumn("variants", F.transform(F.when(
        taken, F.filter("variants", lambda v: v.isNotNull())), variant))
    field = lambda f: F.transform("variants", lambda v: v[f])
    prices = F.array_compact(field("price"))
    df = df.withColumns({"colors": filled(field("color")), "sizes": filled(field("size"))})
    blob = F.concat_ws("\n", "title", F.coalesce("product_type", F.lit("")),
                       F.array_join("tags", " "), "__body")
    df = df.withColumn("__blob", blob)
    litres = resolve(rung(X2.volume(F.col("title")), "title"),
                     rung(first_hit(F.col("sizes"), X2.volume), "variant-option"),
                     rung(X2.volume_bag(F.col("__body")), "description"))
    grams = resolve(rung(F.array_max(field("grams")), "shopify:grams"),
                    rung(X2.weight(F.col("__body")), "description"))
    df = df.withColumns({"__vol": litres, "__wt": grams, "__dims": X2.dims(F.col("__body"))})
    stated = F.concat_ws(" | ", "__blob", F.array_join("colors", " | "),
                         F.array_join(field("title"), " | "))
    url = F.concat(F.lit("https://"), "domain", locale_path(), F.lit("/products/"),
                   F.coalesce("handle", F.lit("")))
    df = df.withColumns({
        "id": F.concat("brand_slug", F.lit("__"), F.coalesce("handle", F.lit(""))),
        "name": F.col("title"), "url": url, "image": F.get("images", F.lit(0))["src"],
        "volume_l": F.col("__vol.value"), "volume_source": F.col("__vol.source"),
        "dims_cm": F.col("__dims.dims"), "dims_source": F.col("__dims.source"),
        "weight_g": F.col("__wt.value"), "weight_source": F.col("__wt.source"),
        "laptop_in": X2.laptop(F.col("__blob")),
        "price_min": F.round(F.array_min(prices), 2),
        "price_max": F.round(F.array_max(prices), 2),
        "on_sale": F.coalesce(F.exists("variants", lambda v: F.coalesce(
            v["compare_at"] > v["price"], F.lit(False))), F.lit(False)),
        "in_stock": F.coalesce(F.exists("variants", lambda v: v["available"]), F.lit(False)),
        "materials": F.array_sort(X2.materials(stated)),
        "features": X2.features(F.col("__blob")), "source": F.lit("shopify:products.json"),
    })
    return _finish(df, F.col("title"), F.col("product_type"), F.col("tags"), url)


# --- SKU-per-row feed -------------------------------------------------------

def normalize_sku_feed(items: DataFrame, label: str = "sku-feed") -> Normalised:
    """One row per SKU, grouped into a model per (name, size).

    Columns: name, sku, barcode, canonical_uri, price_in_cents, currency_code,
    dimensions map<string, array<string>>.
    """
    df = _missing(dealt(items), ruling="string", brand_name="string", locale="string",
                  fetched_at="timestamp")
    cell = lambda k: F.get(F.try_element_at("dimensions", F.lit(k)), F.lit(0))
    many = lambda k: F.coalesce(F.try_element_at("dimensions", F.lit(k)), no_tags())
    num = lambda k: cell(k).try_cast("double")
    words = lambda c: F.initcap(F.nullif(F.replace(c, F.lit("_"), F.lit(" ")), F.lit("")))
    pretty = F.regexp_replace(F.upper(cell("size")), r'^(\d+(?:\.\d+)?)IN$', '$1"')
    tokens = F.concat(many("filter_feature"), many("product_feature"), many("table_features"))
    keys = F.filter(F.map_keys("dimensions"), lambda k: F.startswith(
        k, F.lit("material_composition_")))
    fabric = F.concat_ws(" ", F.array_join(many("material"), " "), F.array_join(keys, " "))
    df = df.withColumns({
        "__size": F.coalesce(cell("size"), F.lit("")), "__pretty": pretty,
        "__color": words(cell("color")), "__material": words(cell("material")),
        "__price": F.round(F.col("price_in_cents") / 100.0, 2),
        "__tokens": tokens,
        "__fabric": F.replace(F.replace(fabric, F.lit("material_composition_"), F.lit("")),
                              F.lit("_"), F.lit(" "))})
    df = df.withColumns({
        "__feat": F.array_union(
            F.array_compact(F.transform("__tokens", lambda t: lookup(X.FEED_FEATURE, t))),
            X2.features(F.replace(F.array_join("__tokens", " "), F.lit("_"), F.lit(" ")))),
        "__mat": X2.materials(F.col("__fabric"))})
    group = ["brand_slug", "name", "__size"]
    rep = first_per_key(df, group, [F.col("ord")])
    # vocabularies are fixed, so these sets are bounded however large a model is
    vocab = lambda c: (df.select(*group, F.explode(c).alias("x")).groupBy(*group)
                       .agg(F.array_sort(F.collect_set("x")).alias(c + "s")))
    names = (df.where(F.col("__color").isNotNull()).groupBy(*group, "__color")
             .agg(F.min("ord").alias("o")).groupBy(*group)
             .agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "__color"))),
                              lambda s: s["__color"]).alias("colors")))
    sums = df.groupBy(*group).agg(
        F.min(truthy(F.col("__price"))).alias("price_min"),
        F.max(truthy(F.col("__price"))).alias("price_max"),
        F.count(F.lit(1)).cast("int").alias("variant_count"))
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    title = F.when((F.col("__size") != "")
                   & ~F.contains(plain(F.col("name")), plain(F.col("__size"))),
                   F.concat_ws(" ", "name", "__pretty")).otherwise(F.col("name"))
    out = (rep.join(sums, group).join(vocab("__feat"), group, "left")
           .join(vocab("__mat"), group, "left").join(names, group, "left")
           .withColumn("title", title))
    kind = C.classify(F.col("title"), F.lit(""), F.lit(""))
    shelf = F.coalesce(cell("filter_sub_category"), F.lit(""))
    ptype = cell("product_type")

    def settle(k: Column) -> Column:
        null = F.lit(None).cast("string")
        on_shelf = lookup(X.FEED_CATEGORY, shelf)
        why = (F.when(ptype.isNotNull() & ~ptype.isin(X.FEED_BAG_TYPES), f"not-a-bag:{label}-type")
               .when(C.excluded(F.col("title")), "not-a-bag")
               .when(shelf.isin(X.FEED_NOT_A_BAG), f"not-a-bag:{label}-shelf")
               .when(k["category"].isNull() & on_shelf.isNull(), "unclassified"))
        source = F.when(k["category"].isNotNull(), k["tier"]).otherwise(f"{label}-shelf")
        return F.when(F.col("ruling").isNotNull(), C._verdict(
            F.col("ruling"), F.lit("override"), null)).otherwise(let(why, lambda w: F.when(
                w.isNotNull(), C._verdict(null, null, w)).otherwise(C._verdict(
                    F.coalesce(k["category"], on_shelf), source, null))))

    out = out.withColumn("outcome", once(let(kind, settle)))
    axes = F.array_compact(F.array(*[F.nullif(num(k), F.lit(0.0)) for k in (
        "product_dim_h_cm", "product_dim_l_cm", "product_dim_d_cm")]))
    litres = resolve(
        rung(F.nullif(num("capacity_litres"), F.lit(0.0)), f"{label}:capacity_litres"),
        rung(F.round(F.nullif(num("product_volume_ml"), F.lit(0.0)) / 1000.0, 1),
             f"{label}:product_volume_ml"))
    grams = F.nullif(num("net_weight_g"), F.lit(0.0)).cast("int")
    laptop = F.array_max(F.array_compact(F.transform(
        many("filter_device_storage"),
        lambda t: F.regexp_extract(t, r"^laptop_(\d+)_inch", 1).try_cast("double"))))
    path = F.substring_index(F.coalesce("canonical_uri", F.lit("")), "?", 1)
    url = F.concat(F.lit("https://"), "domain", path)
    out = out.withColumn("__vol", litres).withColumns({
        "id": F.concat("brand_slug", F.lit("__"), S.slugify(F.col("title"))),
        "brand": F.coalesce("brand_name", "brand_slug"), "name_": F.col("title"),
        "category": F.col("outcome.category"), "category_source": F.col("outcome.source"),
        "url": url, "volume_l": F.col("__vol.value"), "volume_source": F.col("__vol.source"),
        "dims_cm": F.when(F.size(axes) >= 2, F.sort_array(axes, asc=False)),
        "weight_g": grams, "laptop_in": laptop,
        "on_sale": F.lit(False), "in_stock": F.lit(True),
        "colors": F.coalesce("colors", no_tags()),
        "sizes": filled(F.array("__pretty")),
        "features": F.coalesce("__feats", no_tags()),
        "materials": F.coalesce("__mats", no_tags()), "tags": no_tags(),
        "source": F.lit(f"{label}:products"),
    })
    out = out.withColumns({
        "dims_source": F.when(F.col("dims_cm").isNotNull(), f"{label}:product_dim"),
        "weight_source": F.when(F.col("weight_g").isNotNull(), f"{label}:net_weight_g"),
        "linear_cm": X2.linear(F.col("dims_cm")),
        "price_market": F.coalesce(F.nullif("locale", F.lit("")), F.lit("default"))})
    ok = out.where(F.col("outcome.reason").isNull())
    members = ok.select(*group, F.col("id").alias("bag_id"))
    variants = (df.join(members, group)
                .select("bag_id", F.col("ord").alias("pos"), "sku",
                        F.nullif(F.concat_ws(" / ", "__color", "__material"), F.lit(""))
                        .alias("title"), F.col("__color").alias("color"),
                        F.col("__pretty").alias("size"), truthy(F.col("__price")).alias("price"),
                        F.lit(True).alias("available"), "barcode"))
    return Normalised(conform(ok.drop("name").withColumnRenamed("name_", "name"), BAG),
                      conform(variants, VARIANT),
                      _rejects(out, F.col("title"), shelf, no_tags(), url))


# --- aggregator JSON-LD -----------------------------------------------------

def normalize_aggregator(raw: DataFrame, label: str = "aggregator") -> Normalised:
    """Stored Product nodes (url, product JSON, breadcrumbs); the brand comes from the node."""
    get = lambda p: F.get_json_object("product", p)
    df = _missing(dealt(raw), ruling="string", fetched_at="timestamp", locale="string")
    df = df.withColumns({
        "title": F.trim(F.coalesce(get("$.name"), F.lit(""))),
        "brand_name": F.trim(F.coalesce(get("$.brand.name"), get("$.manufacturer"), F.lit(""))),
        "breadcrumbs": filled(F.coalesce("breadcrumbs", no_tags())),
        "__desc": X2.strip_html(get("$.description"))})
    shelf = F.array_join("breadcrumbs", " ")
    hardware = F.array_join(C.shelf_crumbs(F.col("breadcrumbs"), F.col("brand_name")), " ")
    verdict = C.decide_on_shelf(F.col("title"), shelf, F.lit(""), F.col("ruling"),
                                "not-a-bag:breadcrumb", hardware)
    null = F.lit(None).cast("string")
    df = df.withColumn("outcome", once(F.when((F.col("title") != "") & (F.col("brand_name") == ""),
                                              C._verdict(null, null, F.lit("no-brand")))
                                       .otherwise(verdict)))
    offers = F.transform(P.as_list(get("$.offers")), lambda o: F.struct(
        F.get_json_object(o, "$.sku").alias("sku"),
        truthy(F.get_json_object(o, "$.price")).alias("price"),
        F.coalesce(F.endswith(F.get_json_object(o, "$.availability"), F.lit("InStock")),
                   F.lit(False)).alias("available"),
        F.coalesce(F.get_json_object(o, "$.gtin13"), F.get_json_object(o, "$.gtin"))
        .alias("barcode")))
    df = df.withColumn("variants", offers).withColumn(
        "__blob", F.concat_ws("\n", "title", "__desc"))
    litres = resolve(rung(X2.volume_bag(F.col("__desc")), f"{label}:description"),
                     rung(X2.volume_cuin(F.col("__desc")), f"{label}:cubic-inches"))
    prices = F.array_compact(F.transform("variants", lambda v: v["price"]))
    tail = F.regexp_replace(F.try_element_at(F.split(F.coalesce("url", F.lit("")), "/"),
                                             F.lit(-1)), r"[.]html$", "")
    df = df.withColumns({"__vol": litres, "__dims": X2.dims(F.col("__desc"))}).withColumns({
        "id": F.concat(F.lit(f"{label}__"), S.slugify(tail)),
        "brand_slug": S.slugify(F.col("brand_name")), "name": F.col("title"),
        "url": F.coalesce("url", get("$.url")),
        "image": F.coalesce(F.when(F.startswith(get("$.image"), F.lit("[")), F.get(
            F.from_json(get("$.image"), "array<string>"), F.lit(0))), get("$.image")),
        "volume_l": F.col("__vol.value"), "volume_source": F.col("__vol.source"),
        "dims_cm": F.col("__dims.dims"),
        "dims_source": F.concat(F.lit(f"{label}:"), F.col("__dims.source")),
        "weight_g": X2.weight(F.col("__desc")), "laptop_in": X2.laptop(F.col("__blob")),
        "price_min": F.round(F.array_min(prices), 2),
        "price_max": F.round(F.array_max(prices), 2), "on_sale": F.lit(False),
        "in_stock": F.coalesce(F.exists("variants", lambda v: v["available"]), F.lit(False)),
        "colors": no_tags(), "sizes": no_tags(), "tags": no_tags(),
        "materials": F.array_sort(X2.materials(F.col("__blob"))),
        "features": X2.features(F.col("__blob")), "source": F.lit(f"{label}:jsonld")})
    df = df.withColumn("weight_source", F.when(F.col("weight_g").isNotNull(),
                                               f"{label}:description"))
    return _finish(df, F.col("title"), F.array_join("breadcrumbs", " > "), no_tags(),
                   F.col("url"))


# --- WooCommerce shape ------------------------------------------------------

def normalize_woo(raw: DataFrame) -> Normalised:
    """Minor-unit prices and attribute terms."""
    df = _missing(dealt(raw), ruling="string", brand_name="string", locale="string",
                  fetched_at="timestamp")
    names = lambda c: F.transform(F.coalesce(c, F.array()), lambda x: F.coalesce(
        x["name"], F.lit("")))
    df = df.withColumns({
        "title": X2.strip_html(F.col("name")), "__cats": names(F.col("categories")),
        "__tags": names(F.col("tags")),
        "__desc": X2.strip_html(F.concat_ws("\n", F.coalesce("description", F.lit("")),
                                            F.coalesce("short_description", F.lit(""))))})
    shelf, tags = F.array_join("__cats", " "), F.array_join("__tags", " ")
    df = df.withColumn("outcome", once(C.decide_on_shelf(
        F.col("title"), shelf, tags, F.col("ruling"), "not-a-bag:category", shelf)))

    def terms(keep) -> Column:
        return filled(F.flatten(F.transform(F.filter("attributes", keep), lambda a: F.transform(
            a["terms"], lambda t: t["name"]))))

    is_colour = lambda a: matches(a["name"], X.WOO_COLOUR)
    df = df.withColumns({
        "colors": F.coalesce(terms(is_colour), no_tags()),
        "sizes": F.coalesce(terms(lambda a: ~is_colour(a) & matches(a["name"], X.WOO_SIZE)),
                            no_tags()),
        "__price": S.minor_unit_price(F.col("prices.price"), F.col("prices.currency_minor_unit")),
        "__regular": S.minor_unit_price(F.col("prices.regular_price"),
                                        F.col("prices.currency_minor_unit")),
        "__blob": F.concat_ws("\n", "title", shelf, tags, "__desc")})
    only = lambda c: F.when(F.size(c) == 1, F.get(c, F.lit(0)))
    df = df.withColumn("variants", F.array(F.struct(
        F.nullif("sku", F.lit("")).alias("sku"), only("colors").alias("color"),
        only("sizes").alias("size"), F.col("__price").alias("price"),
        F.when(F.col("__regular") > F.col("__price"), F.col("__regular")).alias("compare_at"),
        F.coalesce("is_in_stock", F.lit(False)).alias("available"),
        F.get("images", F.lit(0))["src"].alias("image"))))
    litres = resolve(rung(X2.volume(F.col("title")), "title"),
                     rung(X2.volume_bag(F.col("__desc")), "description"))
    grams = resolve(rung(X2.weight_labelled(F.col("__desc")), "description:labelled"),
                    rung(X2.weight(F.col("__desc")), "description"))
    df = df.withColumns({"__vol": litres, "__wt": grams, "__dims": X2.dims(F.col("__desc"))})
    handle = F.coalesce(F.nullif("slug", F.lit("")), S.slugify(F.col("title")))
    url = F.coalesce("permalink", F.concat(F.lit("https://"), "domain", F.lit("/product/"),
                                           F.coalesce("slug", F.lit(""))))
    df = df.withColumns({
        "id": F.concat("brand_slug", F.lit("__"), handle), "name": F.col("title"), "url": url,
        "image": F.get("images", F.lit(0))["src"],
        "volume_l": F.col("__vol.value"), "volume_source": F.col("__vol.source"),
        "dims_cm": F.col("__dims.dims"), "dims_source": F.col("__dims.source"),
        "weight_g": F.col("__wt.value"), "weight_source": F.col("__wt.source"),
        "laptop_in": X2.laptop(F.col("__blob")), "price_min": F.col("__price"),
        "price_max": F.col("__price"), "on_sale": F.coalesce("on_sale", F.lit(False)),
        "in_stock": F.coalesce("is_in_stock", F.lit(False)),
        "materials": F.array_sort(X2.materials(F.col("__blob"))),
        "features": X2.features(F.col("__blob")), "tags": F.col("__tags"),
        "source": F.lit("woocommerce:store-api")}).drop("slug")
    return _finish(df, F.col("title"), F.array_join("__cats", ", "), F.col("__tags"),
                   F.col("url"))


# --- Magento shape ----------------------------------------------------------

def flat_attributes(items: Column) -> Column:
    """code/value entries from plain values and selected options alike."""
    value = lambda i: F.coalesce(i["value"], F.when(F.size(i["selected_options"]) > 0, F.array_join(
        F.filter(F.transform(i["selected_options"], lambda o: o["label"]), lambda x: x != ""),
        "; ")))
    return F.filter(F.transform(items, lambda i: F.struct(
        i["code"].alias("code"), value(i).alias("value"))),
        lambda e: (e["code"] != "") & e["value"].isNotNull())


def normalize_magento(raw: DataFrame) -> Normalised:
    """Attribute codes, configurable variants and a weight of unstated unit."""
    df = _missing(dealt(raw), ruling="string", brand_name="string", locale="string",
                  fetched_at="timestamp")
    df = df.withColumns({
        "title": X2.strip_html(F.col("name")),
        "__attrs": F.coalesce(flat_attributes(F.col("attribute_items")),
                              F.array().cast("array<struct<code:string,value:string>>")),
        "__desc": X2.strip_html(F.concat_ws("\n", F.coalesce("description_html", F.lit("")),
                                            F.coalesce("short_description_html", F.lit("")))),
        "__cats": F.transform(F.coalesce("categories", F.array()),
                              lambda c: F.coalesce(c["name"], F.lit("")))})
    attr = lambda code: F.coalesce(F.get(F.filter(
        "__attrs", lambda e: e["code"] == code), F.lit(0))["value"], F.lit(""))
    df = df.withColumn("__shelf", F.concat_ws(
        " ", F.array_join("__cats", " "), *[attr(c) for c in X.MAGENTO_SHELF_ATTRS]))
    df = df.withColumn("outcome", once(C.decide_on_shelf(
        F.col("title"), F.col("__shelf"), F.lit(""), F.col("ruling"), "not-a-bag:category",
        F.col("__shelf"), fallback=C.shelf_category(F.col("__shelf")),
        fallback_source="magento-shelf",
        also_excluded=matches(F.col("title"), X.MAGENTO_NOT_A_BAG),
        also_reason="not-a-bag:de")))
    ordered = F.array_sort("__attrs")
    prose = F.transform(F.filter(ordered, lambda e: (e["value"] != "")
                                 & ~matches(e["code"], X.MAGENTO_ATTR_NOISE)
                                 & ~e["value"].rlike(r"^\d+$")), lambda e: e["value"])
    df = df.withColumn("__blob", F.concat_ws("\n", "title", "__shelf", "__desc",
                                             F.array_join(prose, "\n")))
    plain = lambda v: F.nullif(F.trim(v).try_cast("double"), F.lit(0.0))
    lo, hi = X.AXIS_BOUNDS
    axes = F.filter(F.transform("__attrs", lambda e: F.struct(
        F.try_element_at(literal_map(X.MAGENTO_AXIS), F.lower(e["code"])).alias("axis"),
        plain(e["value"]).alias("n"))), lambda s: s["axis"].isNotNull() & s["n"].between(lo, hi))
    axis = lambda a: F.get(F.filter(axes, lambda s: s["axis"] == a), F.lit(0))["n"]
    sides = F.transform(F.array_compact(F.array(axis("h"), axis("w"), axis("d"))), X2.tenth)
    named = F.filter("__attrs", lambda e: matches(e["code"], X.MAGENTO_DIM_ATTR))
    from_attr = first_hit(named, lambda e: let(X2.dims(e["value"], slash=True), lambda d: F.when(
        d.isNotNull(), F.struct(d["dims"].alias("dims"),
                                F.concat(F.lit("magento:"), e["code"]).alias("source")))))
    dims = F.coalesce(
        F.when(F.size(sides) >= 2, F.struct(F.sort_array(sides, asc=False).alias("dims"),
                                            F.lit("magento:attributes").alias("source"))),
        from_attr, X2.dims(F.col("__desc")))
    vlo, vhi = X.VOLUME_BOUNDS
    litre_attrs = F.filter("__attrs", lambda e: matches(e["code"], X.MAGENTO_VOLUME_ATTR))
    litres = resolve(
        first_hit(litre_attrs, lambda e: let(F.coalesce(
            plain(e["value"]), X2.volume(e["value"]), X2.volume_cuin(e["value"])),
            lambda v: F.when(v.between(vlo, vhi), F.struct(
                v.alias("value"), F.concat(F.lit("magento:"), e["code"]).alias("source"))))),
        rung(X2.volume(F.col("title")), "title"),
        rung(X2.volume_bag(F.col("__desc")), "description"))
    weighed = F.filter(ordered, lambda e: matches(e["code"], X.MAGENTO_WEIGHT_ATTR)
                       & matches(e["value"], "[a-z]"))
    shipped = F.array_max(F.transform("variants", lambda v: S.store_grams(v["weight"])))
    grams = resolve(
        first_hit(weighed, lambda e: let(X2.weight(e["value"], metric_first=True), lambda w: F.when(
            w.isNotNull(), F.struct(w.alias("value"),
                                    F.concat(F.lit("magento:"), e["code"]).alias("source"))))),
        rung(F.coalesce(shipped, S.store_grams(F.col("weight"))), "magento:weight"),
        rung(X2.weight_labelled(F.col("__desc")), "description:labelled"))
    role = lambda o: (F.when(matches(F.concat_ws(" ", o["attribute_code"], o["label"]),
                                     X.CONFIG_COLOUR), "color")
                      .when(matches(F.concat_ws(" ", o["attribute_code"], o["label"]),
                                    X.CONFIG_SIZE), "size"))
    codes = lambda kind: F.transform(F.filter(F.coalesce("configurable_options", F.array()),
                                              lambda o: F.coalesce(role(o) == kind, F.lit(False))),
                                     lambda o: o["attribute_code"])
    df = df.withColumns({"__cc": codes("color"), "__sc": codes("size"), "__dims": dims,
                         "__vol": litres, "__wt": grams})
    value = lambda v, wanted: F.get(F.filter(F.transform(F.filter(
        v["attributes"], lambda a: F.array_contains(wanted, a["code"])), lambda a: a["label"]),
        lambda x: x != ""), F.lit(0))

    def variant(v: Column) -> Column:
        color, size = value(v, F.col("__cc")), value(v, F.col("__sc"))
        return _magento_variant(
            v["sku"], F.coalesce(F.nullif(F.concat_ws(" / ", size, color), F.lit("")), v["name"]),
            color, size, v["final_price"], v["regular_price"], v["stock_status"], v["weight"],
            v["image"])

    null = F.lit(None).cast("string")
    single = F.array(_magento_variant(
        F.col("sku"), null, null, null, F.col("final_price"), F.col("regular_price"),
        F.col("stock_status"), F.col("weight"), F.col("image_url")))
    df = df.withColumn("__n", F.coalesce(F.size("variants"), F.lit(0))).withColumn(
        "variants", F.when(F.col("__n") > 0, F.transform("variants", variant)).otherwise(single))
    field = lambda f: F.transform("variants", lambda v: v[f])
    prices = F.array_compact(field("price"))
    top = F.coalesce(truthy(F.col("top_price")), truthy(F.col("final_price")))
    handle = F.coalesce(F.nullif("url_key", F.lit("")), S.slugify(F.col("title")))
    url = F.concat(F.lit("https://"), "domain", F.lit("/"), handle,
                   F.coalesce("url_suffix", F.lit("")))
    df = df.withColumns({
        "id": F.concat("brand_slug", F.lit("__"), handle), "name": F.col("title"), "url": url,
        "image": F.col("image_url"), "volume_l": F.round(F.col("__vol.value"), 1),
        "volume_source": F.col("__vol.source"), "dims_cm": F.col("__dims.dims"),
        "dims_source": F.col("__dims.source"), "weight_g": F.col("__wt.value"),
        "weight_source": F.col("__wt.source"), "laptop_in": X2.laptop(F.col("__blob")),
        "price_min": F.round(F.coalesce(F.array_min(prices), truthy(F.col("final_price"))), 2),
        "price_max": F.round(F.coalesce(F.array_max(prices), top), 2),
        "on_sale": F.exists("variants", lambda v: v["compare_at"].isNotNull()),
        "in_stock": (F.coalesce(F.col("stock_status") == "IN_STOCK", F.lit(False))
                     | F.exists("variants", lambda v: v["available"])),
        "colors": filled(field("color")), "sizes": filled(field("size")),
        "materials": F.array_sort(X2.materials(F.col("__blob"))),
        "features": X2.features(F.col("__blob")), "tags": no_tags(),
        "source": F.lit("magento:graphql")})
    return _finish(df, F.col("title"), F.array_join("__cats", ", "), no_tags(), url)


def _magento_variant(sku, title, color, size, final, regular, stock, weight, image) -> Column:
    price, was = truthy(final), truthy(regular)
    return F.struct(
        sku.alias("sku"), title.alias("title"), color.alias("color"), size.alias("size"),
        F.round(price, 2).alias("price"),
        F.when(was > price, F.round(was, 2)).alias("compare_at"),
        F.coalesce(stock == "IN_STOCK", F.lit(False)).alias("available"),
        S.store_grams(weight).alias("grams"), image.alias("image"))


# --- page digests -----------------------------------------------------------

def normalize_pages(raw: DataFrame) -> Normalised:
    """Digests of stored pages: every field is a ladder from structured to prose."""
    df = _missing(dealt(raw), ruling="string", brand_name="string", locale="string", shelf="string",
                  shelved="boolean", fetched_at="timestamp")
    df = df.withColumn("__ld", P.ld_product("jsonld"))
    df = df.withColumns({"__p": F.col("__ld.product"), "__crumbs": F.col("__ld.crumbs")})
    get = lambda p: F.get_json_object("__p", p)
    meta = lambda k: F.try_element_at("meta", F.lit(k))
    head = F.get(F.split(F.coalesce(meta("og:title"), F.col("title"), F.lit("")),
                         r"(?U)\s+[|–—-]\s+"), F.lit(0))
    df = df.withColumn("__name", X2.strip_html(F.coalesce(get("$.name"), "h1"))).withColumn(
        "__desc", X2.strip_html(F.coalesce(get("$.description"), meta("og:description"),
                                           meta("description"))))
    df = df.withColumn("__title", F.coalesce(F.nullif("__name", F.lit("")), F.trim(head)))
    crumb_text = F.array_join("__crumbs", " ")
    hardware = F.array_join(C.shelf_crumbs(F.col("__crumbs"), F.col("brand_name")), " ")
    df = df.withColumn("outcome", once(C.decide_on_shelf(
        F.col("__title"), crumb_text, F.lit(""), F.col("ruling"), "not-a-bag:breadcrumb",
        hardware, fallback=F.col("shelf"), fallback_source="shelf", known_bag=F.col("shelved"))))
    slash = lambda c: X2.dims(c, slash=True)
    tail = lambda d: F.try_element_at(F.split(d["source"], ":"), F.lit(-1))
    named = lambda d, where: F.when(d.isNotNull(), F.struct(d["dims"].alias("value"), F.concat(
        F.lit(where + ":"), tail(d)).alias("source")))
    lo, hi = X.AXIS_BOUNDS
    sides = F.transform(F.filter(F.array(*[P.ld_number(F.col("__p"), f"$.{k}") for k in (
        "height", "width", "depth", "length")]), lambda v: v.between(lo, hi)), X2.tenth)
    df = df.withColumns({
        "__t": X2.table_specs(F.col("tables")),
        "__w": X2.spec_windows(F.col("text"), F.col("__desc")),
        "__pd": X2.pair_read(F.col("pairs"), "dims", slash), "__sides": sides})
    read = lambda finder: X2.first_read(F.col("__w"), finder)
    windowed = lambda r: F.when(r.isNotNull(), F.struct(r["value"].alias("value"),
                                                        r["source"].alias("source")))
    in_window = let(read(slash), lambda r: F.when(r.isNotNull(), F.struct(
        r["value"]["dims"].alias("value"),
        F.concat_ws(":", r["source"], r["value"]["source"]).alias("source"))))
    dims = resolve(
        named(F.col("__pd"), "pairs"), rung(F.col("__t.dims"), "table"),
        F.when(F.size("__sides") >= 2, F.struct(
            F.slice(F.sort_array("__sides", asc=False), 1, 3).alias("value"),
            F.lit("schema.org:axes").alias("source"))),
        rung(X2.near_label(F.col("text"), "dims", lambda t: slash(t)["dims"]), "label"),
        in_window)
    litres = resolve(
        rung(X2.pair_read(F.col("pairs"), "volume", X2.volume_bag), "pairs"),
        rung(F.col("__t.volume_l"), "table"), rung(X2.volume_bag(F.col("__title")), "title"),
        rung(X2.near_label(F.col("text"), "volume", X2.volume_bag), "label"),
        let(read(X2.volume_bag), windowed))
    either = lambda t: F.coalesce(X2.weight_labelled(t), X2.weight(t))
    grams = resolve(
        rung(X2.pair_read(F.col("pairs"), "weight", X2.weight), "pairs"),
        rung(F.col("__t.weight_g"), "table"),
        rung(X2.weight(get("$.weight")), "schema.org:weight"),
        rung(X2.near_label(F.col("text"), "weight", either), "label"),
        let(read(either), windowed))
    df = df.withColumns({"__dims": dims, "__vol": litres, "__wt": grams,
                         "__offers": P.ld_offers(F.col("__p")),
                         "__pp": X2.page_prices(F.col("values"))})
    stock = lambda o: F.contains(o["availability"], F.lit("InStock"))
    sale, listed = F.col("__pp.sale"), F.col("__pp.listed")
    offered = F.concat(F.transform("__offers", lambda o: truthy(o["price"])),
                       F.transform("__offers", lambda o: truthy(o["high"])))
    title_case = lambda c: F.initcap(F.nullif(F.replace(c, F.lit("-"), F.lit(" ")), F.lit("")))

    def one(js: Column, path: str) -> Column:
        raw_value = F.get_json_object(js, path)
        listed_value = F.get(F.from_json(raw_value, "array<string>"), F.lit(0))
        return F.when(F.startswith(raw_value, F.lit("[")), listed_value).otherwise(raw_value)

    def has_variant(js: Column) -> Column:
        return let(P.ld_offers(js), lambda offers: F.struct(
            F.coalesce(F.get_json_object(js, "$.sku"), F.get_json_object(js, "$.gtin13"))
            .alias("sku"),
            F.nullif(F.regexp_replace(F.get_json_object(js, "$.name"), "<[^>]+>", " "), F.lit(""))
            .alias("title"), title_case(one(js, "$.color")).alias("color"),
            F.round(first_hit(offers, lambda o: truthy(o["price"])), 2).alias("price"),
            F.lit(None).cast("double").alias("compare_at"),
            F.exists(offers, stock).alias("available"),
            X2.weight(F.get_json_object(js, "$.weight")).alias("grams"),
            F.get_json_object(js, "$.gtin13").alias("barcode")))

    def offer_variant(o: Column) -> Column:
        item = F.get_json_object(o["node"], "$.itemOffered")
        null = F.lit(None)
        return F.struct(
            F.coalesce(o["sku"], F.get_json_object(item, "$.model")).alias("sku"),
            F.nullif(F.regexp_replace(F.get_json_object(item, "$.name"), "<[^>]+>", " "),
                     F.lit("")).alias("title"), one(item, "$.color").alias("color"),
            F.round(truthy(o["price"]), 2).alias("price"),
            null.cast("double").alias("compare_at"), stock(o).alias("available"),
            null.cast("int").alias("grams"), null.cast("string").alias("barcode"))

    nodes = F.filter(P.as_list(get("$.hasVariant")), lambda v: F.startswith(v, F.lit("{")))
    df = df.withColumn("__hv", F.transform(nodes, has_variant))
    prices = F.array_compact(F.concat(
        F.when(F.size(F.array_compact(offered)) > 0, offered).otherwise(sale),
        F.transform("__hv", lambda v: v["price"])))
    ready = lambda o: stock(o) | F.contains(o["availability"], F.lit("LimitedAvailability"))
    cut = F.coalesce(F.array_max(listed) > F.array_min(sale), F.lit(False))
    df = df.withColumn("__available", F.when(
        F.size("__offers") > 0, F.exists("__offers", ready)).otherwise(F.size(sale) > 0))
    null = F.lit(None)
    bare = F.array(F.struct(
        null.cast("string").alias("sku"), null.cast("string").alias("title"),
        null.cast("string").alias("color"), F.round(F.array_min(sale), 2).alias("price"),
        F.when(cut, F.round(F.array_max(listed), 2)).alias("compare_at"),
        F.col("__available").alias("available"), null.cast("int").alias("grams"),
        null.cast("string").alias("barcode")))
    df = df.withColumn("variants", F.when(F.size("__hv") > 0, F.col("__hv"))
                       .when(F.size("__offers") > 0, F.transform("__offers", offer_variant))
                       .otherwise(bare))
    pictures = F.filter("images", lambda s: ~matches(s, X.IMAGE_NOISE))
    stated = let(get("$.image"), lambda im: F.coalesce(
        F.get_json_object(im, "$.url"), F.get_json_object(im, "$.contentUrl"),
        F.get_json_object(im, "$[0].url"), F.when(F.startswith(im, F.lit("[")), F.get(
            F.from_json(im, "array<string>"), F.lit(0))),
        F.when(~im.rlike(r"^\s*[\[{]"), im)))
    image = F.coalesce(stated, meta("og:image"), F.get(F.filter(
        pictures, lambda s: matches(s, "product|catalog|media")), F.lit(0)),
        F.get(pictures, F.lit(0)))
    origin = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    absolute = (F.when(image.rlike("(?i)^https?://"), image)
                .when(F.startswith(image, F.lit("//")), F.concat(F.lit("https:"), image))
                .when(F.startswith(image, F.lit("/")), F.concat(origin, image))
                .otherwise(F.concat(F.regexp_replace("url", r"[^/]*$", ""), image)))
    handle = F.regexp_replace(F.try_element_at(F.split(F.regexp_replace(
        "url", r"/+$", ""), "/"), F.lit(-1)), r"\.html?$", "")
    blob = F.concat_ws("\n", "__title", crumb_text, "__desc")
    where = lambda c: F.concat(F.lit("pages:"), F.col(c + ".source"))
    df = df.withColumns({
        "id": F.concat("brand_slug", F.lit("__"), F.coalesce(
            F.nullif(S.slugify(handle), F.lit("")), S.slugify(F.col("__title")))),
        "name": F.col("__title"), "image": absolute, "volume_l": F.col("__vol.value"),
        "volume_source": where("__vol"), "dims_cm": F.col("__dims.value"),
        "dims_source": where("__dims"), "weight_g": F.col("__wt.value"),
        "weight_source": where("__wt"),
        "laptop_in": X2.laptop(F.concat_ws("\n", blob, "text")),
        "price_min": F.round(F.array_min(prices), 2),
        "price_max": F.round(F.array_max(prices), 2), "on_sale": cut,
        "in_stock": F.col("__available") | F.exists("variants", lambda v: v["available"]),
        "colors": filled(F.transform("variants", lambda v: v["color"])), "sizes": no_tags(),
        "materials": F.array_sort(X2.materials(blob)),
        "features": X2.features(F.concat_ws("\n", blob, "text")),
        "tags": no_tags(), "source": F.lit("pages:crawl")})
    return _finish(df, F.col("__title"), F.array_join("__crumbs", " > "), no_tags(),
                   F.col("url"))


# --- dispatch ---------------------------------------------------------------

NORMALISERS = {
    "shopify": normalize_shopify, "sku_feed": normalize_sku_feed,
    "aggregator": normalize_aggregator, "woocommerce": normalize_woo,
    "magento": normalize_magento, "pages": normalize_pages,
}


def assign_families(part: Normalised, rulings: DataFrame) -> Normalised:
    """Colour family per variant, and the families of a bag from variants and colours.

    Both tables are read several times, so they are written once first.
    """
    part = Normalised(cut(part.bags), cut(part.variants), part.rejects)
    owner = part.bags.select(F.col("id").alias("bag_id"), "brand_slug")
    named = part.variants.drop("color_family").join(owner, "bag_id").withColumn(
        "__name", F.coalesce("color", "title"))
    variants = C.colour_family(named, rulings, "brand_slug", "__name")
    listed = C.colour_family(
        part.bags.select(F.col("id").alias("bag_id"), "brand_slug",
                         F.explode("colors").alias("__name")), rulings, "brand_slug", "__name")
    families = (variants.select("bag_id", "color_family")
                .unionByName(listed.select("bag_id", "color_family"))
                .where(F.col("color_family").isNotNull()).groupBy("bag_id")
                .agg(F.array_sort(F.collect_set("color_family")).alias("__f")))
    bags = (part.bags.drop("color_families")
            .join(families, part.bags["id"] == families["bag_id"], "left").drop("bag_id")
            .withColumn("color_families", F.coalesce("__f", no_tags())).drop("__f"))
    return Normalised(conform(bags, BAG), conform(variants, VARIANT), part.rejects)


def normalize_all(raw: dict[str, DataFrame], currencies: DataFrame,
                  rulings: DataFrame) -> Normalised:
    """Run each platform's normaliser and union the results to one schema."""
    parts = [NORMALISERS[name](df) for name, df in raw.items()]
    bags, variants, rejects = parts[0]
    for p in parts[1:]:
        bags = bags.unionByName(p.bags)
        variants = variants.unionByName(p.variants)
        rejects = rejects.unionByName(p.rejects)
    money = currencies.select(F.col("slug").alias("brand_slug"), F.col("currency").alias("__c"),
                              F.col("currency_source").alias("__cs"))
    bags = (bags.join(money, "brand_slug", "left")
            .withColumn("currency", F.coalesce("__c", F.lit("USD")))
            .withColumn("currency_source", F.coalesce("__cs", F.lit("assumed")))
            .drop("__c", "__cs"))
    return assign_families(Normalised(conform(bags, BAG), variants, rejects), rulings)
