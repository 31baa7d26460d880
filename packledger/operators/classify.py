"""Category, colour and currency decisions, rulings, and shelf evidence."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed as X, scalars as S
from ..functions.rules import all_matches, first_match, let, lookup, matches, rx
from ..functions.skew import first_per_key, top_k


# --- category cascade -------------------------------------------------------

def titled(title: Column) -> Column:
    """The category a title names outright."""
    return first_match(title, X.CATEGORY_RULES)


def classify(title: Column, product_type: Column, tags: Column) -> Column:
    """struct(category, tier): the title first, then type and tags, then soft words."""
    tier = lambda c, t: F.when(c.isNotNull(), F.struct(c.alias("category"), F.lit(t).alias("tier")))
    blob = F.concat_ws(" ", F.coalesce(product_type, F.lit("")), F.coalesce(tags, F.lit("")))

    def cascade(s: Column) -> Column:
        pooled = F.concat_ws("\n", s["title"], s["blob"])
        return F.coalesce(
            let(titled(s["title"]), lambda c: tier(c, "title")),
            let(first_match(s["blob"], X.CATEGORY_RULES), lambda c: tier(c, "tag")),
            let(first_match(pooled, X.WEAK_CATEGORY_RULES), lambda c: tier(c, "tag")))

    return let(F.struct(F.coalesce(title, F.lit("")).alias("title"), blob.alias("blob")), cascade)


def excluded(title: Column, product_type: Column | None = None,
             multipack: bool = False) -> Column:
    """True for things that are not carried, by title or by type."""
    hit = matches(title, X.NOT_A_BAG)
    if product_type is not None:
        hit = hit | matches(product_type, X.NOT_A_BAG)
    return hit | matches(title, X.MULTIPACK) if multipack else hit


def type_veto(product_type: Column, title: Column) -> Column:
    """A non-carry type stands unless it also names carry or the title classifies."""
    return (matches(product_type, X.NOT_A_BAG_TYPE) & ~matches(product_type, X.CARRY_TYPE)
            & titled(title).isNull())


def taxonomy(product_type: Column) -> Column:
    """struct(path, leaf, carry) for a controlled-taxonomy path, else null."""
    path = F.trim(F.coalesce(product_type, F.lit("")))
    parts = F.split(path, " > ")
    known = F.trim(F.get(parts, F.lit(0))).isin(X.TAXONOMY_ROOTS)
    carry = F.lit(False)
    for root in X.TAXONOMY_CARRY:
        carry = carry | path.startswith(root)
    return F.when(known, F.struct(path.alias("path"),
                                  F.trim(F.try_element_at(parts, F.lit(-1))).alias("leaf"),
                                  carry.alias("carry")))


def shelf_crumbs(crumbs: Column, brand_name: Column) -> Column:
    """Breadcrumbs that name a shelf rather than the brand."""
    key = S.norm_key(brand_name)
    return F.filter(crumbs, lambda c: (key == "") | ~F.startswith(S.norm_key(c), key))


def climb_veto(category: Column, shelf: Column) -> Column:
    """A ``sling`` on a climbing shelf is webbing."""
    return (F.coalesce(category == "sling", F.lit(False))) & matches(shelf, X.CLIMBING_SHELF)


def shelf_category(shelf: Column) -> Column:
    return first_match(shelf, X.MAGENTO_SHELF_RULES)


def map_codes(code: Column) -> Column:
    """Vendor shelf code to category."""
    return lookup(X.FEED_CATEGORY, code)


def _verdict(category: Column, source: Column, reason: Column) -> Column:
    return F.struct(category.alias("category"), source.alias("source"), reason.alias("reason"))


def decide_category(title: Column, product_type: Column, tags: Column, hint_category: Column,
                    hint_is_bag: Column, ruling: Column) -> Column:
    """struct(category, source, reason): ruling > title > store shelf > tag.

    ``reason`` is null for an accepted product.
    """
    null = F.lit(None).cast("string")
    known_bag = F.coalesce(hint_is_bag, F.lit(False))

    def decide(tax: Column) -> Column:
        shelf = F.when(tax.isNotNull(), tax["leaf"]).otherwise(product_type)
        return let(classify(title, shelf, tags), lambda kind: settle(tax, kind))

    def settle(tax: Column, kind: Column) -> Column:
        from_title = F.coalesce(kind["tier"] == "title", F.lit(False))
        category = F.when(from_title, kind["category"]).otherwise(
            F.coalesce(hint_category, kind["category"]))
        source = (F.when(from_title, F.lit("title"))
                  .when(hint_category.isNotNull(), F.lit("collection"))
                  .when(kind["category"].isNotNull(), F.lit("tag")))
        bad_type = ~from_title & F.when(tax.isNotNull(), ~tax["carry"]).otherwise(
            matches(product_type, X.NOT_A_BAG_TYPE) & ~matches(product_type, X.CARRY_TYPE))
        reason = (F.when(F.coalesce(~hint_is_bag, F.lit(False)), "not-a-bag:collection")
                  .when(excluded(title, product_type, multipack=True), "not-a-bag")
                  .when(bad_type, "not-a-bag:product-type")
                  .when(category.isNull() & known_bag, "unclassified:known-bag")
                  .when(category.isNull(), "unclassified"))
        return let(reason, lambda why: F.when(why.isNotNull(), _verdict(null, null, why))
                   .otherwise(_verdict(category, source, null)))

    return F.when(ruling.isNotNull(), _verdict(ruling, F.lit("override"), null)).otherwise(
        let(taxonomy(product_type), decide))


def decide_on_shelf(title: Column, shelf: Column, tags: Column, ruling: Column,
                    veto_reason: str, climb_shelf: Column,
                    fallback: Column | None = None, fallback_source: str = "",
                    also_excluded: Column | None = None, also_reason: str = "",
                    known_bag: Column | None = None) -> Column:
    """The verdict for platforms that give a title and a shelf path.

    ``fallback`` is a last-resort category read off the shelf itself.
    """
    null = F.lit(None).cast("string")
    spare = null if fallback is None else fallback
    has_title = F.coalesce(title, F.lit("")) != ""

    def settle(kind: Column) -> Column:
        category = F.coalesce(kind["category"], spare)
        source = F.when(kind["category"].isNotNull(), kind["tier"]).when(
            spare.isNotNull(), F.lit(fallback_source))
        reason = F.when(~has_title, "no-title").when(excluded(title), "not-a-bag")
        if also_excluded is not None:
            reason = reason.when(also_excluded, also_reason)
        veto = (matches(shelf, X.NOT_A_BAG_TYPE) & ~matches(shelf, X.CARRY_TYPE)
                & classify(title, F.lit(""), F.lit("")).isNull())
        reason = reason.when(veto, veto_reason)
        if known_bag is not None:
            reason = reason.when(category.isNull() & F.coalesce(known_bag, F.lit(False)),
                                 "unclassified:known-bag")
        reason = (reason.when(category.isNull(), "unclassified")
                  .when(climb_veto(category, climb_shelf), "not-a-bag:climbing"))
        return let(reason, lambda why: F.when(why.isNotNull(), _verdict(null, null, why))
                   .otherwise(_verdict(category, source, null)))

    return F.when(ruling.isNotNull() & has_title, _verdict(ruling, F.lit("override"), null)) \
        .otherwise(let(classify(title, shelf, tags), settle))


def quarantine(decided: DataFrame, outcome: str = "outcome"):
    """Split a decided table into (accepted, rejects, counts per reason)."""
    accepted = decided.where(F.col(outcome)["reason"].isNull())
    rejects = decided.where(F.col(outcome)["reason"].isNotNull())
    counts = rejects.groupBy(F.col(outcome)["reason"].alias("reason")).agg(
        F.count(F.lit(1)).alias("n"))
    return accepted, rejects, counts


# --- rulings ----------------------------------------------------------------

def with_ruling(df: DataFrame, rulings: DataFrame, brand: str, key: Column,
                name: str = "ruling") -> DataFrame:
    """Left join of reviewed rulings: ``<name>_ruled`` tells absent from ruled-null."""
    side = rulings.select(F.col("brand").alias("__rb"), F.col("key").alias("__rk"),
                          F.col("value").alias(name), F.lit(True).alias(name + "_ruled"))
    return (df.withColumn("__key", key)
            .join(side, (F.col(brand) == F.col("__rb")) & (F.col("__key") == F.col("__rk")), "left")
            .withColumn(name + "_ruled", F.coalesce(name + "_ruled", F.lit(False)))
            .drop("__rb", "__rk", "__key"))


def stale_rulings(rulings: DataFrame, used: DataFrame) -> DataFrame:
    """Rulings that nothing matched; ``used`` holds (brand, key)."""
    return rulings.join(used.select("brand", "key").distinct(), ["brand", "key"], "left_anti") \
        .select("brand", "key")


def ruling_report(rulings: DataFrame, used: DataFrame) -> DataFrame:
    hit = rulings.join(used.select("brand", "key").distinct().withColumn("__u", F.lit(1)),
                       ["brand", "key"], "left")
    return hit.agg(F.count(F.lit(1)).alias("entries"), F.count("__u").alias("used"),
                   (F.count(F.lit(1)) - F.count("__u")).alias("stale"))


# --- colours ----------------------------------------------------------------

def family_of_words(name: Column) -> Column:
    """Colour family stated by a colourway name; fabric words and part numbers do not count."""
    text = F.coalesce(name, F.lit(""))
    for _, pattern in X.MATERIAL_RULES:
        text = F.regexp_replace(text, rx(pattern), " ")
    return F.when(~S.is_part_number(name), let(text, lambda t: first_match(t, X.COLOUR_RULES)))


def colour_family(df: DataFrame, rulings: DataFrame, brand: str, name: str,
                  out: str = "color_family") -> DataFrame:
    """Reviewed ruling first (a null ruling included), then the words of the name.

    The words are read once per distinct name, not once per variant.  Variants
    without a name say nothing; each gets a key of its own, so they do not meet.
    """
    names = df.select(F.col(name).alias("__n")).where("__n is not null").distinct().withColumn(
        "__words", family_of_words(F.col("__n")))
    nameless = F.concat(F.lit("\x00"), F.monotonically_increasing_id().cast("string"))
    df = df.withColumn("__key", F.coalesce(F.col(name), nameless)).join(
        names, F.col("__key") == F.col("__n"), "left").drop("__n", "__key")
    df = with_ruling(df, rulings, brand, S.norm_key(F.col(name)), "__fam")
    return df.withColumn(out, F.when(F.col("__fam_ruled"), F.col("__fam"))
                         .otherwise(F.col("__words"))).drop("__fam", "__fam_ruled", "__words")


# --- currency ---------------------------------------------------------------

def stated_codes(product_json: Column) -> Column:
    """Currency codes stated anywhere in a product record."""
    pattern = r'(?i)"(?:currency|currency_code|pricecurrency|currencycode)"\s*:\s*"([A-Za-z]{3})"'
    return F.transform(F.regexp_extract_all(product_json, F.lit(pattern), F.lit(1)),
                       lambda c: F.upper(c))


def observe_currency(products: DataFrame, pages: DataFrame, roster: DataFrame) -> DataFrame:
    """What each brand prices in, and how that is known.

    products(slug, ord, product json), pages(slug, currency), roster(slug, locale,
    country, currency).  Feed > locale > country > product page > roster > assumed.
    """
    codes = products.select("slug", "ord", F.posexplode(stated_codes(F.col("product"))).alias("at", "code"))
    feed = _most_common(codes.select("slug", "code", F.struct("ord", "at").alias("first")), "feed")
    page = _most_common(
        pages.where(F.col("currency").rlike("^[A-Za-z]{3}$"))
        .select("slug", F.upper("currency").alias("code"), F.col("ord").alias("first")), "page")
    locale = S.locale_currency(F.col("locale"))
    country = lookup(X.LOCALE_CURRENCY, F.lower(F.coalesce("country", F.lit(""))))
    declared = F.nullif(F.upper("currency"), F.lit(""))
    rung = lambda c, s: F.when(c.isNotNull(), F.struct(c.alias("code"), F.lit(s).alias("source")))
    best = F.coalesce(rung(F.col("feed"), "feed"), rung(locale, "locale"),
                      rung(country, "country"), rung(F.col("page"), "product-page"),
                      rung(declared, "roster"), rung(F.lit("USD"), "assumed"))
    return (roster.join(feed, "slug", "left").join(page, "slug", "left")
            .withColumn("__b", best)
            .select("slug", F.col("__b.code").alias("currency"),
                    F.col("__b.source").alias("currency_source")))


def _most_common(codes: DataFrame, name: str) -> DataFrame:
    """Majority code per slug; the one met first wins a tie."""
    n = codes.groupBy("slug", "code").agg(F.count(F.lit(1)).alias("n"),
                                          F.min("first").alias("first"))
    return first_per_key(n, ["slug"], [F.desc("n"), F.col("first")]).select(
        "slug", F.col("code").alias(name))


# --- shelves ----------------------------------------------------------------

def collection_category(name: Column) -> Column:
    return first_match(name, X.COLLECTION_RULES)


def collection_signal(collections: DataFrame) -> DataFrame:
    """Collections that say something: category and is_bag per (slug, handle)."""
    name = F.concat_ws(" ", F.coalesce("handle", F.lit("")), F.coalesce("title", F.lit("")))
    category = collection_category(name)
    spare = matches(name, X.SPARE_PART)
    is_bag = (F.when(spare, F.lit(False)).when(category.isNotNull(), F.lit(True))
              .when(matches(name, X.GENERIC_BAG), F.lit(True))
              .when(matches(name, X.ACCESSORY), F.lit(False)))
    noise = matches(F.col("handle"), X.SHELF_NOISE) | matches(F.col("title"), X.SHELF_NOISE)
    return (collections.where(~noise)
            .withColumn("category", F.when(~spare, category)).withColumn("is_bag", is_bag)
            .where(F.col("is_bag").isNotNull()))


def collection_votes(collections: DataFrame, members: DataFrame) -> DataFrame:
    """Products vote through the collections that hold them; a strict majority makes a bag."""
    signal = collection_signal(collections).select("slug", "handle", "ord", "category", "is_bag")
    votes = members.join(signal, ["slug", "handle"])
    known = F.col("category").isNotNull()
    return votes.groupBy("slug", "product_id").agg(
        F.min_by("category", F.when(known, F.col("ord"))).alias("category"),
        F.count_if("is_bag").alias("bag_votes"),
        F.count_if(~F.col("is_bag")).alias("accessory_votes"),
        (F.count_if("is_bag") > F.count_if(~F.col("is_bag"))).alias("is_bag"))


def shelf_hints(shelves: DataFrame, product_pattern: str) -> DataFrame:
    """Product slug -> category off stored shelf pages (url, html, ord).

    Specific shelves before generic ones and ``daypack`` before none; the first
    shelf that links a product names it.  Marked-up product links win over loose ones.
    """
    slug = F.try_element_at(F.split(F.regexp_replace("url", r"/+$", ""), "/"), F.lit(-1))
    name = F.replace(slug, F.lit("-"), F.lit(" "))
    category = collection_category(name)
    keep = ~(matches(slug, X.SHELF_NOISE) | matches(name, X.SPARE_PART)
             | matches(name, X.NOT_CARRY_SHELF))
    # each product's mark-up runs up to the next mark; its first link is the product's
    spans = F.regexp_extract_all("html", F.lit(
        r'(?s)itemtype="[^"]*schema\.org/Product"[^>]*>(.*?)(?=itemtype=|\z)'), F.lit(1))
    marked = F.filter(F.transform(spans, lambda s: F.regexp_extract(s, r'href="([^"#?]+)"', 1)), lambda h: h != "")
    loose = F.filter(F.regexp_extract_all("html", F.lit(r'href="([^"#?]+)"'), F.lit(1)),
                     lambda h: matches(h, product_pattern))
    rank = F.struct(F.col("category").isNull().alias("a"),
                    F.coalesce(F.col("category") == "daypack", F.lit(False)).alias("b"),
                    F.col("ord").alias("c"))
    base = F.concat(F.lit("https://"), F.try_parse_url("url", F.lit("HOST")))
    links = (shelves.withColumn("category", category).where(keep)
             .where(F.col("category").isNotNull() | matches(name, X.GENERIC_BAG))
             .withColumn("links", F.when(F.size(marked) > 0, marked).otherwise(loose))
             .withColumn("rank", rank).withColumn("base", base)
             .select("rank", "category", "base", F.posexplode("links").alias("at", "href")))
    product = F.try_element_at(F.split(F.regexp_replace("href", r"/+$", ""), "/"), F.lit(-1))
    address = F.when(F.startswith("href", F.lit("http")), F.col("href")).otherwise(
        F.concat("base", "href"))
    hit = links.withColumn("product", product).where(F.col("product") != "")
    return hit.groupBy("product").agg(
        F.min_by(F.struct("category"), F.struct("rank", "at")).alias("c"),
        F.min_by(address, F.struct("rank", "at")).alias("url")).select(
        "product", F.col("c.category").alias("category"), "url")


def scope_frontier(candidates: DataFrame, hints: DataFrame) -> DataFrame:
    """All candidates, marked where a carry shelf holds them, with the share that shelves reach."""
    tail = F.try_element_at(F.split(F.regexp_replace("url", r"/+$", ""), "/"), F.lit(-1))
    held = hints.select(F.col("product").alias("__p")).distinct().withColumn("__on", F.lit(True))
    marked = candidates.withColumn("__t", tail).join(
        held, F.col("__t") == F.col("__p"), "left").withColumn(
        "on_shelf", F.coalesce("__on", F.lit(False))).drop("__t", "__p", "__on")
    share = marked.agg(F.count_if("on_shelf") / F.count(F.lit(1))).scalar()
    return marked.withColumn("shelf_share", share)


#: Opens one level of children after the other until none has any.
_TREE = """
WITH RECURSIVE tree AS (
  SELECT uid, name, product_count, children, 0 AS depth FROM {tree}
  UNION ALL
  SELECT c.uid, c.name, c.product_count, c.children, depth + 1 FROM (
    SELECT depth, explode(from_json(children,
      'array<struct<uid:string,name:string,product_count:bigint,children:string>>')) AS c FROM tree))
SELECT uid, name, product_count, depth FROM tree
"""


def carry_categories(tree: DataFrame) -> DataFrame:
    """Flatten a nested category tree (uid, name, product_count, children json) and select carry.

    ``children`` is a JSON array at every level; a level is read from the one above it.
    """
    flat = tree.sparkSession.sql(_TREE, tree=tree.select("uid", "name", "product_count", "children"))
    return (flat.where(F.coalesce("product_count", F.lit(0)) > 0)
            .where(F.col("uid").isNotNull())
            .where(matches(F.col("name"), X.TREE_CARRY) & ~matches(F.col("name"), X.TREE_NOT_CARRY))
            .select("uid", "name", "product_count", "depth")
            .orderBy(F.desc("product_count"), "uid"))


def url_candidates(urls: DataFrame) -> DataFrame:
    slug = F.try_element_at(F.split("url", "/"), F.lit(-1))
    return urls.where(matches(slug, X.URL_SLUG_YES) & ~matches(slug, X.URL_SLUG_NO))


# --- stored pages -----------------------------------------------------------

def platform_of(page: Column) -> Column:
    return F.coalesce(first_match(page, X.PLATFORM_MARKERS), F.lit("unknown"))


def markers_in(page: Column, rules) -> Column:
    return all_matches(page, rules)


def programme_links(pages: DataFrame) -> DataFrame:
    """Same-host programme links of stored pages (url, html), with their place by strength."""
    href = F.regexp_extract_all("html", F.lit(
        r"(?is)<a\b[^>]*?href=[\"']([^\"'#]+)[\"'][^>]*>(.*?)</a>"), F.lit(1))
    inner = F.regexp_extract_all("html", F.lit(
        r"(?is)<a\b[^>]*?href=[\"']([^\"'#]+)[\"'][^>]*>(.*?)</a>"), F.lit(2))
    host = F.lower(F.try_parse_url("url", F.lit("HOST")))
    scheme = F.try_parse_url("url", F.lit("PROTOCOL"))
    links = pages.select("url", host.alias("host"), scheme.alias("scheme"),
                         F.posexplode(F.arrays_zip(href.alias("h"), inner.alias("t")))
                         .alias("at", "link"))
    target = (F.when(F.col("link.h").rlike("(?i)^https?://"), F.col("link.h"))
              .when(F.startswith(F.col("link.h"), F.lit("//")),
                    F.concat("scheme", F.lit(":"), F.col("link.h")))
              .when(F.startswith(F.col("link.h"), F.lit("/")),
                    F.concat("scheme", F.lit("://"), "host", F.col("link.h")))
              .otherwise(F.concat("scheme", F.lit("://"), "host", F.lit("/"), F.col("link.h"))))
    hay = F.concat_ws(" ", F.col("link.h"), F.regexp_replace(F.col("link.t"), "<[^>]+>", " "))
    strength = F.when(matches(hay, X.STRONG_HINT), 1).when(matches(hay, X.WEAK_HINT), 2)
    hits = (links.withColumn("target", target).withColumn("strength", strength)
            .where(F.col("strength").isNotNull())
            .where(F.lower(F.try_parse_url("target", F.lit("HOST"))) == F.col("host"))
            .groupBy("url", "strength", "target").agg(F.min("at").alias("at")))
    place = Window.partitionBy("url", "strength").orderBy("at")   # the links of one page
    return hits.withColumn("rn", F.row_number().over(place)).select("url", "strength", "target", "at", "rn")


def unknown_hosts(pages: DataFrame, k: int | None = None) -> DataFrame:
    """Census of third-party script hosts that no rule knows."""
    known = "|".join(p for _, p in X.IN_HOUSE_MARKERS + X.NETWORK_MARKERS)
    src = F.regexp_extract_all("html", F.lit(r"(?i)<script\b[^>]*?src=[\"']([^\"']+)[\"']"),
                               F.lit(1))
    own = F.lower(F.try_parse_url("url", F.lit("HOST")))
    full = F.when(F.startswith("src", F.lit("//")), F.concat(F.lit("https:"), "src")).otherwise(
        F.col("src"))
    hosts = (pages.select(own.alias("own"), F.explode(src).alias("src"))
             .withColumn("host", F.lower(F.try_parse_url(full, F.lit("HOST"))))
             .where(F.col("host").isNotNull() & ~F.contains("host", F.col("own")))
             .where(~matches(F.col("host"), X.BORING_HOST) & ~matches(F.col("host"), known)))
    census = hosts.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    return census if k is None else census.orderBy(F.desc("n"), "host").limit(k)
