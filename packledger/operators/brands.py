"""Brand master list, domain evidence and outreach worklists."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed as X, scalars as S
from ..functions.rules import let, literal_map, lookup, matches, rx
from ..functions.skew import first_per_key, numbered, top_k
from . import classify as C


def canonical(name: Column, aliases: dict[str, str]) -> Column:
    tidy = F.trim(F.regexp_replace(name, r"(?U)\s+", " "))
    return F.coalesce(lookup(aliases, F.lower(tidy)), tidy) if aliases else tidy


def brand_master(lists: DataFrame, aliases: dict[str, str], seeded: DataFrame,
                 excluded: list[str]) -> DataFrame:
    """Union of brand lists (source, name) under canonical names, best corroborated first."""
    raw = F.trim("name")
    rows = lists.where(~F.lower(raw).isin(excluded) if excluded else F.lit(True)).select(
        "source", raw.alias("raw"), canonical(raw, aliases).alias("name"))
    names = rows.select("name", "source").unionByName(seeded.select(
        "name", F.lit("seed").alias("source"))).distinct()
    counts = names.groupBy("name").agg(F.count(F.lit(1)).alias("source_count"),
                                       F.array_sort(F.collect_set("source")).alias("sources"))
    other = (rows.where(F.col("raw") != F.col("name")).select("name", "raw").distinct()
             .groupBy("name").agg(F.array_sort(F.collect_set("raw")).alias("aliases")))
    return (counts.join(other, "name", "left").join(seeded.select("name", "domain"), "name", "left")
            .withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
            .orderBy(F.desc("source_count"), F.lower("name"), "name"))


def stems(label: Column) -> Column:
    """Name stems of one label: the whole, without a leading "the", its long first word."""
    base = F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), "[^a-z0-9]", "")
    parts = F.filter(F.split(F.coalesce(label, F.lit("")), "[^A-Za-z0-9]+"), lambda p: p != "")
    first = F.lower(F.get(parts, F.lit(0)))
    return F.array(base, F.regexp_replace(base, "^the", ""),
                   F.when((F.size(parts) > 1) & (F.length(first) >= 5), first))


def candidate_domains(brands: DataFrame, suffixes: list[str] = X.DOMAIN_SUFFIXES,
                      n: int | None = None) -> DataFrame:
    """Likely domains per brand (name, aliases), most likely first."""
    labels = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    every = F.array_distinct(F.filter(F.flatten(F.transform(labels, lambda x: stems(x))),
                                      lambda s: s.isNotNull() & (s != "")))
    rows = brands.select("name", F.posexplode(every).alias("s", "stem"))
    forms = F.array(*[F.replace(F.lit(p), F.lit("{s}"), F.col("stem")) for p in suffixes])
    rows = rows.select("name", "s", F.posexplode(forms).alias("p", "domain"))
    first = rows.groupBy("name", "domain").agg(F.min(F.struct("s", "p")).alias("at"))
    ranked = numbered(first, ["name"], [F.col("at")], F.col("at.s"), "place")
    return (ranked if n is None else ranked.where(F.col("place") <= n)).drop("at")


def score_probes(probes: DataFrame, brands: DataFrame) -> DataFrame:
    """Verdict per brand over fetched candidate pages, tried in order.

    probes(name, place, domain, status, final_url, html, vendors array or null);
    brands(name, aliases).
    """
    key = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")
    wanted = F.array_distinct(F.filter(F.transform(F.concat(F.array("name"), F.coalesce(
        "aliases", F.array().cast("array<string>"))), lambda x: key(x)), lambda k: k != ""))
    df = probes.join(brands.select("name", wanted.alias("__w")), "name")
    inside = lambda text: F.exists("__w", lambda w: F.contains(text, w))
    host = F.regexp_extract("final_url", r"^https?://([^/]+)", 1)
    title = F.regexp_extract(F.col("html"), r"(?is)<title[^>]*>(.*?)</title>", 1)
    site = F.regexp_extract(
        "html", r"(?i)<meta[^>]+property=[\"']og:site_name[\"'][^>]+content=[\"']([^\"']+)", 1)
    away = S.registrable(host) != S.registrable(F.col("domain"))
    evidence = (F.when((title != "") & inside(key(title)), "title")
                .when((site != "") & inside(key(site)), "site-name")
                .when(inside(key(host)), "host"))
    vendor = F.exists("vendors", lambda v: F.exists("__w", lambda w: F.contains(
        key(v), w) | F.contains(w, key(v))))
    df = df.withColumn("evidence", evidence)
    outcome = (F.when(F.col("status") == 429, "rate-limited")
               .when((F.col("status") != 200) | (F.coalesce("html", F.lit("")) == ""), "no-answer")
               .when(matches(F.col("html"), X.PARKED) | away, "parked")
               .when(matches(F.col("html"), X.NOT_LIVE), "not-live")
               .when(F.col("evidence").isNull(), "no-name")
               .when(F.coalesce(F.size("vendors"), F.lit(-1)) <= 0, "probable")
               .when(vendor, "verified").otherwise("other-vendor"))
    df = df.withColumn("outcome", outcome)
    good = first_per_key(df.where(F.col("outcome").isin("verified", "probable")), ["name"],
                         [F.col("place")]).select(
        "name", "domain", F.col("outcome").alias("confidence"), "evidence")
    return brands.select("name").join(good, "name", "left").withColumn(
        "confidence", F.coalesce("confidence", F.lit("unresolved")))


def clean_domain(raw: Column) -> Column:
    bare = F.regexp_replace(F.trim(raw), r"^https?://", "")
    return F.nullif(F.lower(F.trim(F.regexp_replace(
        F.substring_index(bare, "/", 1), r"^www\.", ""))), F.lit(""))


def import_worklist(sheet: DataFrame, master: DataFrame, roster: DataFrame):
    """Fill domains by name; add brands the roster does not have.  Returns (master, roster)."""
    filled = sheet.withColumn("__d", clean_domain(F.col("domain"))).where(
        F.col("__d").isNotNull()).withColumn("__p", F.nullif(F.trim("platform"), F.lit("")))
    last = top_k(filled, ["name"], [F.desc("ord")], 1).select("name", "__d", "__p")
    done = master.join(last, "name", "left").withColumns({
        "domain_source": F.when(F.col("__d").isNotNull(), "human"),
        "domain": F.coalesce("__d", "domain")}).drop("__d", "__p")
    new = last.withColumn("slug", S.slugify(F.col("name"))).join(
        roster.select("slug"), "slug", "left_anti")
    new = first_per_key(new, ["slug"], [F.col("name")]).select(
        "slug", "name", F.col("__d").alias("domain"),
        F.coalesce("__p", F.lit("shopify")).alias("platform"))
    return done, roster.select("slug", "name", "domain", "platform").unionByName(new)


# --- programmes -------------------------------------------------------------

def programme_verdicts(homes: DataFrame, programme_pages: DataFrame, bags: DataFrame) -> DataFrame:
    """Verdict per brand from its stored homepage and programme page, ranked by depth.

    homes(brand_slug, status, html); programme_pages(brand_slug, url, html, ord).
    """
    first = lambda c, rules: F.get(C.markers_in(c, rules), F.lit(0))
    home = homes.select("brand_slug", "status", first(F.col("html"), X.IN_HOUSE_MARKERS).alias("hv"),
                        first(F.col("html"), X.NETWORK_MARKERS).alias("hn"),
                        C.platform_of(F.col("html")).alias("platform"),
                        ((F.col("status") == 200) & (F.coalesce("html", F.lit("")) != ""))
                        .alias("live"))
    text = F.regexp_replace("html", "<[^>]+>", " ")
    pages = programme_pages.where(matches(text, X.PROGRAMME_TEXT)).select(
        "brand_slug", "url", "ord", first(F.col("html"), X.IN_HOUSE_MARKERS).alias("pv"),
        first(F.col("html"), X.NETWORK_MARKERS).alias("pn"))
    page = first_per_key(pages, ["brand_slug"], [F.col("ord")]).drop("ord")
    depth = bags.groupBy("brand_slug").agg(F.count(F.lit(1)).alias("models"))
    df = home.join(page, "brand_slug", "left").join(depth, "brand_slug", "left")
    vendor, network = F.coalesce("pv", "hv"), F.coalesce("pn", "hn")
    verdict = (F.when(~F.col("live"), "unreachable")
               .when(vendor.isNotNull(), F.concat(F.lit("in-house:"), vendor))
               .when(network.isNotNull(), F.concat(F.lit("network:"), network))
               .when(F.col("url").isNotNull(), "page-only").otherwise("none-found"))
    live = lambda c: F.when(F.col("live"), c)
    out = df.select("brand_slug", verdict.alias("verdict"), live(vendor).alias("vendor"),
                    live(network).alias("network"), live(F.col("url")).alias("programme_url"),
                    F.when(F.col("live"), F.col("platform")).otherwise("unknown").alias("platform"),
                    F.coalesce("models", F.lit(0).cast("bigint")).alias("models"))
    return out.withColumn("tier", tier(F.col("verdict"), X.VERDICT_TIER)).orderBy(
        "tier", F.desc("models"), "brand_slug")


def tier(verdict: Column, table: dict) -> Column:
    return F.try_element_at(literal_map(table), F.substring_index(verdict, ":", 1))


def best_verdicts(verdicts: DataFrame) -> DataFrame:
    """The most telling verdict of each brand name."""
    return first_per_key(verdicts.withColumn("__k", F.lower(F.trim("brand"))), ["__k"],
                         [tier(F.col("verdict"), X.SUMMARY_TIER), F.col("ord")]).drop("__k")


def verdict_summary(verdicts: DataFrame) -> DataFrame:
    """Brands, models and share of the catalogue per verdict kind."""
    best = best_verdicts(verdicts)
    per = best.groupBy(F.substring_index("verdict", ":", 1).alias("kind")).agg(
        F.count(F.lit(1)).alias("brands"), F.sum("models").cast("bigint").alias("models"))
    whole = F.sum("models").over(Window.partitionBy(F.lit(0)))   # a handful of kinds
    return per.select("kind", "brands", "models", (F.col("models") / F.greatest(
        whole, F.lit(1))).alias("share"))


def marker_tally(verdicts: DataFrame) -> DataFrame:
    best = best_verdicts(verdicts)
    one = lambda c: best.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("name")).agg(
        F.count(F.lit(1)).alias("n")).select(F.lit(c).alias("kind"), "name", "n")
    return one("vendor").unionByName(one("network"))


# --- requests ---------------------------------------------------------------

def request_queue(requests: DataFrame, k: int | None = None) -> DataFrame:
    """Requested brands by folded name: how often, spelled how, first and last."""
    per = requests.groupBy(F.lower(F.trim("name")).alias("folded")).agg(
        F.min("name").alias("name"), F.count(F.lit(1)).alias("requests"),
        F.countDistinct("name").alias("spellings"), F.countDistinct("url").alias("urls"),
        F.countDistinct("email").alias("emails"), F.min("created_at").alias("first_at"),
        F.max("created_at").alias("last_at"))
    return per if k is None else per.orderBy(F.desc("requests"), F.desc("last_at"), "folded").limit(k)


def split_held(queue: DataFrame, brands: DataFrame):
    """(held, gaps): requested brands the catalogue has, by name or slug, and those it lacks."""
    keys = brands.select(S.alnum(F.col("name")).alias("__k")).union(
        brands.select(S.alnum(F.col("slug")))).distinct()
    df = queue.withColumn("__q", S.alnum(F.col("name")))
    held = df.join(keys, F.col("__q") == F.col("__k"), "left_semi").drop("__q")
    gaps = df.join(keys, F.col("__q") == F.col("__k"), "left_anti").drop("__q")
    return held, gaps
