"""Queries over crawl logs, enrichment caches and brand worklists."""
from pyspark.sql import functions as F

from ..operators import brands as W, crawlops as O, enrich as E, models as M
from . import bindings as B
from .registry import query


def _log(spark, d):
    return B.view(spark, d, "fetch_log")


STREAK = """marked AS (SELECT *, status IN ('ok', 'retired', 'removed', 'todo', 'walled', 'unreachable', 'no-adapter') AS reset
  FROM fetch_log),
series AS (SELECT *, sum(CASE WHEN reset THEN 1 ELSE 0 END) OVER (PARTITION BY slug ORDER BY night, ord) AS s FROM marked),
streak AS (SELECT *, sum(CASE WHEN reset THEN 0 ELSE 1 END) OVER (PARTITION BY slug, s ORDER BY night, ord) AS run FROM series)"""


@query("o01_fail_streak", "fetch_log", f"""
WITH {STREAK} SELECT slug, CAST(arg_max(run, (night, ord)) AS BIGINT) AS fail_streak, max(night) AS night FROM streak GROUP BY slug""")
def o01(spark, d):
    return O.fail_streak(_log(spark, d))


@query("o01_running_streak", "fetch_log", f"""
WITH {STREAK} SELECT ord, slug, CAST(run AS BIGINT) AS fail_streak FROM streak""")
def o01b(spark, d):
    return O.running_streak(_log(spark, d)).select("ord", "slug", F.col("fail_streak").cast(
        "bigint").alias("fail_streak"))


def _history(spark, d):
    """One count per brand and night; some brands fall, some go dark."""
    per = _log(spark, d).groupBy("slug", "night").agg(
        F.max("ord").alias("ord"), F.max("platform").alias("platform"),
        F.max("status").alias("status"), F.min("product_count").alias("c"))
    late = F.col("night") >= F.lit("2001-07-25").cast("timestamp_ntz")
    count = F.when(F.col("slug").isin("brand-1", "brand-2") & late, F.floor(F.col("c") / 3)).when(
        F.col("slug") == "brand-3", 0).otherwise(F.col("c"))
    return per.withColumn("product_count", count.cast("int"))


HIST = """per AS (SELECT slug, night, max(ord) AS ord, max(platform) AS platform, min(product_count) AS c
  FROM fetch_log GROUP BY 1, 2),
h AS (SELECT *, CAST(CASE WHEN slug IN ('brand-1', 'brand-2') AND night >= TIMESTAMP '2001-07-25' THEN floor(c / 3)
  WHEN slug = 'brand-3' THEN 0 ELSE c END AS INT) AS pc FROM per),
r AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY night DESC, ord DESC) AS rn FROM h),
w AS (SELECT slug, count(*) AS nights, max(pc) FILTER (WHERE rn = 1) AS latest, max(platform) FILTER (WHERE rn = 1) AS platform,
  count(pc) FILTER (WHERE rn > 1) AS priors, median(pc) FILTER (WHERE rn > 1) AS baseline,
  min(rn) FILTER (WHERE pc <> 0) AS lead_ FROM r WHERE rn <= 22 GROUP BY slug),
ok AS (SELECT * FROM w WHERE platform NOT IN ('retired', 'todo') AND nights >= 5 AND latest IS NOT NULL AND priors >= 4)"""


@query("o02_erosion", "fetch_log", f"""
WITH {HIST} SELECT slug, baseline, latest, (baseline - latest) / baseline AS drop, priors FROM ok
WHERE baseline > 0 AND (baseline - latest) / baseline > 0.2""")
def o02(spark, d):
    return O.erosion(_history(spark, d))


@query("o03_dark", "fetch_log", f"""
WITH {HIST} SELECT slug, CAST(coalesce(lead_ - 1, nights) AS BIGINT) AS nights_dark, lead_ IS NULL AS capped FROM ok
WHERE baseline <= 0 AND latest <= 0""")
def o03(spark, d):
    return O.dark(_history(spark, d))


ISLES = """m AS (SELECT *, status IN (429, 503) AS bad FROM attempt),
i AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (ORDER BY ts, ord) AS isle FROM m),
n AS (SELECT *, row_number() OVER (PARTITION BY isle ORDER BY ts, ord) AS nth FROM i WHERE bad)"""


@query("o04_first_run", "attempt", f"""
WITH {ISLES} SELECT ts AS tripped_at, ord AS tripped_ord FROM n WHERE nth = 6 ORDER BY ts, ord LIMIT 1""")
def o04(spark, d):
    return O.first_run(B.view(spark, d, "attempt"), F.col("status").isin(429, 503), 6, [])


@query("o04_first_run_by_brand", "attempt", """
WITH m AS (SELECT *, status IN (429, 503) AS bad FROM attempt),
i AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY brand_slug ORDER BY ts, ord) AS isle FROM m),
n AS (SELECT *, row_number() OVER (PARTITION BY brand_slug, isle ORDER BY ts, ord) AS nth FROM i WHERE bad),
f AS (SELECT *, row_number() OVER (PARTITION BY brand_slug ORDER BY ts, ord) AS k FROM n WHERE nth = 4)
SELECT brand_slug, ts AS tripped_at, ord AS tripped_ord FROM f WHERE k = 1""")
def o04b(spark, d):
    return O.first_run(B.view(spark, d, "attempt"), F.col("status").isin(429, 503), 4, ["brand_slug"])


@query("o04_distinct_stores", "attempt", f"""
WITH {ISLES}, f AS (SELECT isle, brand_slug, min((ts, ord)) AS at_ FROM n GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY isle ORDER BY at_) AS nth FROM f)
SELECT min(at_)[1] AS tripped_at, min(at_)[2] AS tripped_ord FROM k WHERE nth = 5""")
def o04c(spark, d):
    return O.first_run(B.view(spark, d, "attempt"), F.col("status").isin(429, 503), 5, [],
                       distinct="brand_slug")


@query("o05_stride_shard", "bag", """
SELECT id FROM (SELECT id, row_number() OVER (ORDER BY ord) - 1 AS i FROM bag) t WHERE i % 4 = 2""")
def o05(spark, d):
    return O.stride_shard(B.bags(spark, d), 2, 4, [F.col("ord")], F.floor(F.col("ord") / 512)).select("id")


@query("o05_prune_list", "bag", """
SELECT brand_slug FROM (SELECT DISTINCT brand_slug FROM bag) t WHERE brand_slug NOT IN (SELECT brand_slug FROM
  (SELECT brand_slug, row_number() OVER (ORDER BY brand_slug) - 1 AS i FROM (SELECT DISTINCT brand_slug FROM bag) u) v WHERE i % 3 = 0)""")
def o05b(spark, d):
    held = B.bags(spark, d).select("brand_slug").distinct()
    mine = O.stride_shard(held, 0, 3, [F.col("brand_slug")], F.substring("brand_slug", 1, 7))
    return O.prune_list(held, mine, "brand_slug")


@query("o06_cost_by_brand", "fetch_log", """
SELECT slug, sum(elapsed_s) AS elapsed_s, CAST(sum(product_count) AS BIGINT) AS products, count(*) AS nights,
  count(*) FILTER (WHERE status = 'ok') AS ok_nights, sum(elapsed_s) / sum(product_count) AS s_per_product FROM fetch_log GROUP BY slug""")
def o06(spark, d):
    return O.cost_by_brand(_log(spark, d))


@query("o06_status_tally", "fetch_log", "SELECT status, count(*) AS n FROM fetch_log GROUP BY status")
def o06b(spark, d):
    return O.status_tally(_log(spark, d))


@query("o07_stale", "fetch_log", """
SELECT slug, max(fetched_at) AS fetched_at FROM fetch_log GROUP BY slug HAVING max(fetched_at) <= TIMESTAMP '2001-07-30 00:00:00'""")
def o07(spark, d):
    last = _log(spark, d).groupBy("slug").agg(F.max("fetched_at").alias("fetched_at"))
    return O.stale(last, "2001-08-01 00:00:00", 48.0)


@query("s09_merge_logs", "fetch_log", """
WITH p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY ord DESC) AS rn FROM fetch_log
  WHERE night >= TIMESTAMP '2000-01-01' AND slug <> 'brand-6') t WHERE rn = 1),
q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY ord DESC) AS rn FROM fetch_log
  WHERE night < TIMESTAMP '2000-01-01') t WHERE rn = 1)
SELECT p.slug, p.status, CASE WHEN p.status IN ('ok', 'todo') THEN 0 ELSE coalesce(CAST(q.fail_streak AS BIGINT), 0) + 1 END AS fail_streak
FROM p LEFT JOIN q ON p.slug = q.slug UNION ALL
SELECT slug, status, CAST(fail_streak AS BIGINT) FROM q WHERE slug NOT IN (SELECT slug FROM p)""")
def s09(spark, d):
    from ..functions.skew import top_k
    log = _log(spark, d)
    cut = F.lit("2000-01-01").cast("timestamp_ntz")
    parts = log.where((F.col("night") >= cut) & (F.col("slug") != "brand-6")).withColumn(
        "part", F.col("ord")).drop("fail_streak")
    prev = top_k(log.where(F.col("night") < cut), ["slug"], [F.desc("ord")], 1).drop("rn")
    return O.merge_logs(parts, prev).select("slug", "status", "fail_streak")


@query("s18_build_history", "fetch_log", """
SELECT version, slug, status FROM (SELECT CAST(night AS DATE) AS version, slug, status, row_number() OVER
 (PARTITION BY CAST(night AS DATE), slug ORDER BY ord DESC) AS rn FROM fetch_log) t WHERE rn = 1""")
def s18(spark, d):
    v = _log(spark, d).withColumn("version", F.to_date("night"))
    return O.build_history(v).select("version", "slug", "status")


# --- enrichment -------------------------------------------------------------

CACHE = {
    "page_key": B._id("p_partkey"), "status": "CASE WHEN p_partkey % 19 = 0 THEN 404 ELSE NULL END",
    "no_dims": "CASE p_partkey % 4 WHEN 0 THEN 'unparsed' WHEN 1 THEN 'not-published' "
               "WHEN 2 THEN 'no-spec-text' ELSE NULL END",
    "gtin": "CAST(p_partkey + 4000000 AS STRING)",
    "c1": "CASE WHEN p_partkey % 4 = 3 THEN CAST(51 AS DOUBLE) ELSE NULL END",
    "laptop_in": "CASE WHEN p_partkey % 3 = 1 THEN CAST(15 AS DOUBLE) ELSE NULL END",
    "volume_l": "CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS DOUBLE) ELSE CAST(33 AS DOUBLE) END",
    "weight_g": "CASE WHEN p_partkey % 5 = 1 THEN CAST(700 AS INT) ELSE NULL END",
    "fcsv": "CASE WHEN p_partkey % 3 = 2 THEN 'ykk_zips,rfid,' ELSE '' END",
}
PICK = "p_partkey % 7 < 5"
CACHE_SQL = ("cache AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in CACHE.items())
             + f" FROM part WHERE {PICK} UNION ALL SELECT DISTINCT "
             + "{line}, NULL, NULL, 'line', CAST(40 AS DOUBLE), NULL, CAST(20 AS DOUBLE), CAST(650 AS INT), '' "
             + "FROM bag WHERE split_from IS NOT NULL)").replace("{line}", "split_from")


def _cache(spark, d):
    own = B.table(spark, d, "part").where(PICK).selectExpr(
        *[f"{e} AS {c}" for c, e in CACHE.items()])
    line = B.view(spark, d, "bag").where("split_from IS NOT NULL").selectExpr(
        "split_from AS page_key", "CAST(NULL AS INT) AS status", "CAST(NULL AS STRING) AS no_dims",
        "'line' AS gtin", "CAST(40 AS DOUBLE) AS c1", "CAST(NULL AS DOUBLE) AS laptop_in",
        "CAST(20 AS DOUBLE) AS volume_l", "CAST(650 AS INT) AS weight_g", "'' AS fcsv").distinct()
    df = own.unionByName(line)
    feats = F.filter(F.split("fcsv", ","), lambda v: v != "")
    return df.select(
        "page_key", "status", "no_dims", "gtin", "laptop_in", "volume_l", "weight_g",
        F.when(F.col("c1").isNotNull(), F.array("c1", F.lit(30.0), F.lit(20.0))).alias("dims_cm"),
        F.when(F.col("c1").isNotNull(), "product-page:cm").alias("dims_source"),
        F.lit("product-page").alias("volume_source"), F.lit("product-page").alias("weight_source"),
        feats.alias("features"), F.array().cast("array<string>").alias("materials"),
        F.when(F.size(feats) > 0, "product-page").alias("features_source"))


KEY = "coalesce(split_from, id)"
CAN = "(source LIKE 'shopify%' OR source LIKE 'woocommerce%')"


@query("e01_backlog", "bag", f"""
WITH {CACHE_SQL} SELECT id, {KEY} AS page_key FROM bag WHERE {CAN} AND (dims_cm IS NULL OR laptop_in IS NULL)
AND {KEY} NOT IN (SELECT page_key FROM cache)""")
def e01(spark, d):
    return E.backlog(B.bags(spark, d), _cache(spark, d)).select("id", "page_key")


@query("e02_missing_pages", "bag", f"""
WITH {CACHE_SQL} SELECT id FROM bag WHERE {CAN} AND {KEY} IN (SELECT page_key FROM cache WHERE status IS NULL)
AND {KEY} NOT IN (SELECT page_key FROM cache WHERE gtin LIKE '%3')""")
def e02(spark, d):
    cache = _cache(spark, d)
    pages = cache.where(F.col("gtin").endswith("3")).select("page_key")
    return E.missing_pages(B.bags(spark, d), cache, pages).select("id")


@query("e03_dedupe", "bag", f"""
SELECT page_key, id FROM (SELECT {KEY} AS page_key, id, row_number() OVER (PARTITION BY {KEY} ORDER BY ord) AS rn FROM bag) t WHERE rn = 1""")
def e03(spark, d):
    return E.dedupe(B.bags(spark, d).withColumn("page_key", E.page_key())).select("page_key", "id")


@query("e04_interleave", "bag", """
SELECT id, row_number() OVER (ORDER BY turn, first_) AS place FROM (SELECT id, row_number() OVER
 (PARTITION BY brand_slug ORDER BY ord) AS turn, min(ord) OVER (PARTITION BY brand_slug) AS first_ FROM bag) t""")
def e04(spark, d):
    from ..functions.skew import numbered
    out = E.interleave(B.bags(spark, d))
    return numbered(out, [], [F.col("turn"), F.col("turn_order")], F.floor(F.col("turn") / 16),
                    "place").select("id", "place")


MERGED = f"""{CACHE_SQL},
j AS (SELECT b.*, c.page_key AS ck, c.c1, c.laptop_in AS clap, c.volume_l AS cvol, c.weight_g AS cw, c.gtin AS cg, c.fcsv,
  b.split_from IS NOT NULL AND c.volume_l IS DISTINCT FROM b.volume_l AS other FROM bag b LEFT JOIN cache c ON {KEY} = c.page_key),
g AS (SELECT *, CASE WHEN NOT other THEN c1 END AS gc1, CASE WHEN NOT other THEN cw END AS gw, CASE WHEN NOT other THEN cvol END AS gvol,
  CASE WHEN NOT other THEN cg END AS gg, ck IS NOT NULL AND other AS withheld FROM j),
m AS (SELECT *, coalesce(gw <> 0 AND weight_source IN ('shopify:grams', 'product-page') AND gw IS DISTINCT FROM weight_g, FALSE) AS fixed FROM g)"""


@query("e05_fill_gaps", "bag", f"""
WITH {MERGED} SELECT id, coalesce(d1, gc1) AS first_dim, CASE WHEN d1 IS NULL AND gc1 IS NOT NULL THEN gc1 + 50 ELSE linear_cm END AS linear_cm,
  coalesce(laptop_in, clap) AS laptop_in, coalesce(volume_l, gvol) AS volume_l, gg AS gtin FROM m""")
def e05(spark, d):
    out = E.merge_pages(B.bags(spark, d).withColumn("gtin", F.lit(None).cast("string")),
                        _cache(spark, d))
    return out.select("id", F.get("dims_cm", F.lit(0)).alias("first_dim"), "linear_cm", "laptop_in",
                      "volume_l", "gtin")


@query("e06_supersede_weight", "bag", f"""
WITH {MERGED} SELECT id, CAST(coalesce(CASE WHEN fixed THEN gw ELSE weight_g END, gw) AS INT) AS weight_g,
  fixed AS weight_fixed FROM m""")
def e06(spark, d):
    out = E.merge_pages(B.bags(spark, d).withColumn("gtin", F.lit(None).cast("string")),
                        _cache(spark, d))
    return out.select("id", "weight_g", "weight_fixed")


@query("e07_size_guard", "bag", f"""
WITH {MERGED} SELECT id, withheld FROM m WHERE split_from IS NOT NULL""")
def e07(spark, d):
    return E.size_guard(B.bags(spark, d), _cache(spark, d)).where(
        "split_from IS NOT NULL").select("id", "withheld")


@query("e08_union_features", "bag", f"""
WITH {MERGED} SELECT id, array_to_string(CASE WHEN fcsv <> '' THEN list_sort(list_distinct(list_concat(features,
  ['ykk_zips', 'rfid']))) ELSE features END, ',') AS features,
  CASE WHEN fcsv <> '' THEN 'product-page' ELSE features_source END AS features_source FROM m""")
def e08(spark, d):
    out = E.merge_pages(B.bags(spark, d).withColumn("gtin", F.lit(None).cast("string")),
                        _cache(spark, d))
    return out.select("id", F.array_join("features", ",").alias("features"), "features_source")


@query("e09_enrich_gaps", "bag", f"""
WITH {CACHE_SQL} SELECT brand_slug, count(*) FILTER (WHERE no_dims = 'no-spec-text') AS no_spec_text,
  count(*) FILTER (WHERE no_dims = 'not-published') AS not_published, count(*) FILTER (WHERE no_dims = 'unparsed') AS unparsed,
  count(*) AS total FROM bag b JOIN cache c ON {KEY} = c.page_key WHERE c.c1 IS NULL AND no_dims IS NOT NULL GROUP BY 1""")
def e09(spark, d):
    return E.enrich_gaps(B.bags(spark, d), _cache(spark, d))


@query("e10_run_summary", "attempt", """
SELECT brand_slug, count(*) AS attempted, count(*) FILTER (WHERE status = 200) AS landed,
  count(*) FILTER (WHERE status NOT IN (200, 404, 410, 451)) AS transient,
  count(*) FILTER (WHERE status NOT IN (200, 404, 410, 451)) >= 4 AND count(*) FILTER (WHERE status IN (200, 404, 410, 451)) = 0 AS dropped
FROM attempt GROUP BY brand_slug""")
def e10(spark, d):
    return E.run_summary(B.view(spark, d, "attempt"))


@query("e11_route_outcomes", "attempt", """
SELECT page_key, CASE WHEN disallowed THEN 'permanent' WHEN status = 200 THEN 'landed' WHEN status IN (404, 410, 451) THEN 'permanent'
  ELSE 'transient' END AS outcome, status FROM (SELECT *, row_number() OVER (PARTITION BY page_key ORDER BY ts DESC, ord DESC) AS rn FROM attempt) t WHERE rn = 1""")
def e11(spark, d):
    return E.route_outcomes(B.view(spark, d, "attempt"))


# --- brands -----------------------------------------------------------------

ALIASES = {"customer 7": "Seven", "customer 8": "Eight", "supplier 8": "Eight"}


def _lists(spark, d):
    c = B.table(spark, d, "customer").selectExpr(
        "'sheet' AS source", "'Customer  ' || CAST(c_custkey % 300 AS STRING) AS name")
    s = B.table(spark, d, "supplier").selectExpr(
        "'shop' AS source", "' Supplier ' || CAST(s_suppkey % 90 AS STRING) AS name")
    n = B.table(spark, d, "supplier").selectExpr(
        "'blog' AS source", "'customer ' || CAST(s_suppkey % 12 AS STRING) AS name")
    return c.unionByName(s).unionByName(n)


def _seeded(spark, d):
    return B.table(spark, d, "nation").selectExpr(
        "CASE WHEN n_nationkey % 2 = 0 THEN 'Customer ' || CAST(n_nationkey AS STRING) ELSE n_name END AS name",
        "'n' || CAST(n_nationkey AS STRING) || '.example.com' AS domain")


@query("w01_brand_master", (), """
WITH l AS (SELECT 'sheet' AS source, 'Customer  ' || CAST(c_custkey % 300 AS STRING) AS raw FROM customer UNION ALL
  SELECT 'shop', 'Supplier ' || CAST(s_suppkey % 90 AS STRING) FROM supplier UNION ALL
  SELECT 'blog', 'customer ' || CAST(s_suppkey % 12 AS STRING) FROM supplier),
t AS (SELECT source, raw, regexp_replace(raw, '\\s+', ' ', 'g') AS tidy FROM l WHERE lower(raw) NOT IN ('supplier 3')),
c AS (SELECT source, raw, CASE lower(tidy) WHEN 'customer 7' THEN 'Seven' WHEN 'customer 8' THEN 'Eight'
  WHEN 'supplier 8' THEN 'Eight' ELSE tidy END AS name FROM t),
seed AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'Customer ' || CAST(n_nationkey AS STRING) ELSE n_name END AS name,
  'n' || CAST(n_nationkey AS STRING) || '.example.com' AS domain FROM nation),
u AS (SELECT name, source FROM c UNION SELECT name, 'seed' FROM seed)
SELECT u.name, count(*) AS source_count, string_agg(u.source, ',' ORDER BY u.source) AS sources,
  (SELECT coalesce(string_agg(DISTINCT raw, ',' ORDER BY raw), '') FROM c WHERE c.name = u.name AND c.raw <> c.name) AS aliases,
  max(s.domain) AS domain FROM u LEFT JOIN seed s ON u.name = s.name GROUP BY u.name""")
def w01(spark, d):
    return W.brand_master(_lists(spark, d), ALIASES, _seeded(spark, d), ["supplier 3"]).select(
        "name", "source_count", F.array_join("sources", ",").alias("sources"),
        F.array_join("aliases", ",").alias("aliases"), "domain")


@query("w02_candidate_domains", (), """
WITH b AS (SELECT DISTINCT p_name || ' ' || p_brand AS name FROM part), s AS (SELECT name, 0 AS s,
  regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS stem FROM b UNION ALL
  SELECT name, 1, split_part(name, ' ', 1) FROM b WHERE length(split_part(name, ' ', 1)) >= 5),
f AS (SELECT name, s, 0 AS p, stem || '.com' AS domain FROM s UNION ALL SELECT name, s, 1, stem || 'bags.com' FROM s UNION ALL
  SELECT name, s, 2, 'get' || stem || '.com' FROM s)
SELECT name, domain, row_number() OVER (PARTITION BY name ORDER BY s, p) AS place FROM f""")
def w02(spark, d):
    b = B.table(spark, d, "part").select(F.concat_ws(" ", "p_name", "p_brand").alias("name")).distinct()
    return W.candidate_domains(b.withColumn("aliases", F.array().cast("array<string>")),
                               ["{s}.com", "{s}bags.com", "get{s}.com"])


def _probes(spark, d):
    """Three candidate pages per maker, of every kind the scorer tells apart."""
    s = B.table(spark, d, "supplier")
    probes = s.select(
        F.concat(F.lit("Maker"), F.col("s_suppkey").cast("string"), F.lit("x")).alias("name"),
        F.col("s_suppkey").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("place"))
    kind = (F.col("k") + F.col("place")) % 7
    dom = F.concat(F.lit("maker"), F.col("k").cast("string"), F.lit("x.p"), F.col("place").cast("string"), F.lit(".com"))
    own = F.concat(F.lit("<title>"), F.col("name"), F.lit(" bags</title>"))
    return probes.select(
        "name", "place", dom.alias("domain"),
        F.when(kind == 0, 429).when(kind == 1, 500).otherwise(200).alias("status"),
        F.when(kind == 2, "https://broker.example.net/").otherwise(
            F.concat(F.lit("https://www."), dom, F.lit("/"))).alias("final_url"),
        F.when(kind == 3, F.concat(own, F.lit(" opening soon"))).otherwise(own).alias("html"),
        F.when(kind == 4, F.array(F.lit("Somebody Else"))).when(kind == 5, F.array(F.upper("name")))
        .alias("vendors"))


@query("w03_score_probes", (), """
WITH k AS (SELECT s_suppkey AS k, p.place, (s_suppkey + p.place) % 7 AS kind FROM supplier, (VALUES (0), (1), (2)) p(place)),
g AS (SELECT k, place, kind, row_number() OVER (PARTITION BY k ORDER BY place) AS rn FROM k WHERE kind IN (5, 6))
SELECT 'Maker' || CAST(s_suppkey AS STRING) || 'x' AS name, 'maker' || CAST(s_suppkey AS STRING) || 'x.p' || CAST(g.place AS STRING) || '.com' AS domain,
  CASE g.kind WHEN 5 THEN 'verified' WHEN 6 THEN 'probable' ELSE 'unresolved' END AS confidence,
  CASE WHEN g.kind IS NOT NULL THEN 'title' END AS evidence FROM supplier LEFT JOIN g ON g.k = s_suppkey AND g.rn = 1""")
def w03(spark, d):
    probes = _probes(spark, d)
    brands = probes.select("name").distinct().withColumn("aliases", F.array().cast("array<string>"))
    return W.score_probes(probes, brands)


@query("w04_import_worklist", (), """
SELECT 'master' AS part, 'Maker ' || CAST(s_suppkey AS STRING) AS name,
  CASE WHEN s_suppkey % 3 = 0 THEN 'm' || CAST(s_suppkey AS STRING) || '.example.com' END AS domain FROM supplier UNION ALL
SELECT 'added', 'Maker ' || CAST(s_suppkey AS STRING), 'm' || CAST(s_suppkey AS STRING) || '.example.com' FROM supplier
WHERE s_suppkey % 3 = 0 AND s_suppkey % 2 = 1""")
def w04(spark, d):
    s = B.table(spark, d, "supplier")
    name = "'Maker ' || CAST(s_suppkey AS STRING) AS name"
    master = s.selectExpr(name, "CAST(NULL AS STRING) AS domain")
    sheet = s.selectExpr(name, "s_suppkey AS ord", "CASE WHEN s_suppkey % 3 = 0 THEN ' https://www.M' || "
                         "CAST(s_suppkey AS STRING) || '.example.com/home' ELSE ' ' END AS domain", "'' AS platform")
    roster = s.where("s_suppkey % 2 = 0").selectExpr(
        "'maker-' || CAST(s_suppkey AS STRING) AS slug", name, "'x' AS domain", "'shopify' AS platform")
    done, grown = W.import_worklist(sheet, master, roster)
    added = grown.join(roster.select("slug"), "slug", "left_anti")
    return done.select(F.lit("master").alias("part"), "name", "domain").unionByName(
        added.select(F.lit("added").alias("part"), "name", "domain"))


def _homes(spark, d):
    """Stored homepages with known markers planted by brand, over the real page bodies."""
    pages = B.table(spark, d, "pages")
    tail = (F.when(F.col("page_id") % 6 == 0, "<script src='https://cdn.goaffpro.com/x.js'></script>")
            .when(F.col("page_id") % 6 == 1, "<script src='https://www.awin1.com/t.js'></script>")
            .when(F.col("page_id") % 6 == 2, "<a href='/pages/affiliates'>Affiliate programme</a>")
            .otherwise(""))
    return pages.select(
        F.concat(F.lit("brand-"), F.col("page_id").cast("string")).alias("brand_slug"),
        F.when(F.col("page_id") % 10 == 9, 503).otherwise(200).alias("status"),
        F.concat("html", tail).alias("html"))


VERDICT = """v AS (SELECT 'brand-' || CAST(page_id AS STRING) AS brand_slug, CASE WHEN page_id % 10 = 9 THEN 'unreachable'
  WHEN page_id % 6 = 0 THEN 'in-house:goaffpro' WHEN page_id % 6 = 1 THEN 'network:awin' WHEN page_id % 6 = 2 AND page_id % 4 = 0 THEN 'page-only'
  ELSE 'none-found' END AS verdict, (SELECT count(*) FROM bag WHERE bag.brand_slug = 'brand-' || CAST(page_id AS STRING)) AS models FROM pages)"""


def _verdicts(spark, d):
    prog = B.table(spark, d, "pages").where("page_id % 4 = 0 AND page_id % 6 = 2").select(
        F.concat(F.lit("brand-"), F.col("page_id").cast("string")).alias("brand_slug"),
        F.lit("https://example.com/affiliates").alias("url"),
        F.concat(F.lit("<p>Join our affiliate programme</p>"), "html").alias("html"),
        F.col("page_id").alias("ord"))
    return W.programme_verdicts(_homes(spark, d), prog, B.bags(spark, d))


@query("w05_programme_verdicts", "bag", f"""
WITH {VERDICT} SELECT brand_slug, verdict, models FROM v""")
def w05(spark, d):
    return _verdicts(spark, d).select("brand_slug", "verdict", "models")


@query("w06_verdict_summary", "bag", f"""
WITH {VERDICT} SELECT split_part(verdict, ':', 1) AS kind, count(*) AS brands, CAST(sum(models) AS BIGINT) AS models,
  sum(models) / greatest((SELECT sum(models) FROM v), 1) AS share FROM v GROUP BY 1""")
def w06(spark, d):
    v = _verdicts(spark, d).withColumn("brand", F.col("brand_slug")).withColumn("ord", F.lit(0))
    return W.verdict_summary(v)


@query("w06_marker_tally", "bag", f"""
WITH {VERDICT} SELECT 'vendor' AS kind, 'goaffpro' AS name, count(*) AS n FROM v WHERE verdict LIKE 'in-house%' UNION ALL
SELECT 'network', 'awin', count(*) FROM v WHERE verdict LIKE 'network%'""")
def w06b(spark, d):
    v = _verdicts(spark, d).withColumn("brand", F.col("brand_slug")).withColumn("ord", F.lit(0))
    return W.marker_tally(v)


QUEUE = """q AS (SELECT lower(trim(name)) AS folded, min(name) AS name, count(*) AS requests, count(DISTINCT name) AS spellings,
  count(DISTINCT url) AS urls, count(DISTINCT email) AS emails, min(created_at) AS first_at, max(created_at) AS last_at
  FROM request GROUP BY 1)"""


@query("w07_request_queue", "request", f"WITH {QUEUE} SELECT * FROM q")
def w07(spark, d):
    return W.request_queue(B.view(spark, d, "request"))


@query("w08_split_held", "request", f"""
WITH {QUEUE}, k AS (SELECT 'maker' || CAST(n_nationkey AS STRING) AS k FROM nation)
SELECT folded, regexp_replace(folded, '[^a-z0-9]', '', 'g') IN (SELECT k FROM k) AS held FROM q""")
def w08(spark, d):
    brands = B.table(spark, d, "nation").selectExpr(
        "'Maker ' || CAST(n_nationkey AS STRING) AS name", "'zz-' || n_name AS slug")
    held, gaps = W.split_held(W.request_queue(B.view(spark, d, "request")), brands)
    return held.select("folded", F.lit(True).alias("held")).unionByName(
        gaps.select("folded", F.lit(False).alias("held")))
