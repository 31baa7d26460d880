"""Queries over the catalogue: hub reports, audits and the publish gate."""
from pyspark.sql import functions as F

from ..functions import fixed as X, scalars as S
from ..functions.skew import ranked
from ..operators import hubs as H, models as M, prices as P, quality as V
from . import bindings as B
from .registry import query


def _bags(spark, d):
    return B.bags(spark, d)


IDX = """idx AS (SELECT *, CASE WHEN weight_g <> 0 AND volume_l <> 0 THEN weight_g / volume_l END AS gpl
  FROM bag WHERE dims_cm IS NOT NULL OR coalesce(volume_l <> 0 AND weight_g <> 0, FALSE))"""
BAND = """CASE WHEN volume_l < 10 THEN 'under-10l' WHEN volume_l < 20 THEN '10-20l'
  WHEN volume_l < 30 THEN '20-30l' WHEN volume_l < 40 THEN '30-40l' WHEN volume_l < 60 THEN '40-60l'
  WHEN volume_l >= 60 THEN 'over-60l' END"""


def _listed(spark, d):
    return _bags(spark, d).where(M.indexable())


@query("h01_hub_stats", "bag", f"""
WITH {IDX} SELECT category, count(*) AS n, count(DISTINCT brand_slug) AS brands,
  min(price_min) FILTER (WHERE currency = 'USD') AS price_low,
  max(price_min) FILTER (WHERE currency = 'USD') AS price_high,
  count(*) FILTER (WHERE price_min IS NOT NULL AND currency <> 'USD') AS other_currency,
  count(d3) AS measured, count(*) FILTER (WHERE d3 IS NOT NULL AND linear_cm <= 115) AS carry_on,
  median(volume_l) AS median_volume, median(CAST(weight_g AS DOUBLE)) AS median_weight,
  median(gpl) AS median_gpl FROM idx GROUP BY category""")
def h01(spark, d):
    return H.hub_stats(_listed(spark, d))


@query("h02_volume_facets", "bag", f"""
WITH {IDX} SELECT category, {BAND} AS band, count(*) AS n, count(*) >= 25 AS listed FROM idx WHERE volume_l IS NOT NULL
GROUP BY 1, 2""")
def h02(spark, d):
    return H.volume_facets(_listed(spark, d))


@query("h03_laptop_facets", "bag", f"""
WITH {IDX}, c AS (SELECT category, count(*) FILTER (WHERE laptop_in >= 13) AS n13,
  count(*) FILTER (WHERE laptop_in >= 15) AS n15, count(*) FILTER (WHERE laptop_in >= 16) AS n16
  FROM idx GROUP BY category),
k AS (SELECT *, n13 >= 25 AS k13, n15 >= 25 AND (n13 < 25 OR n15 <= n13 * 0.75) AS k15 FROM c),
m AS (SELECT *, n16 >= 25 AND ((NOT k13 AND NOT k15) OR n16 <= CASE WHEN k15 THEN n15 ELSE n13 END * 0.75)
  AS k16 FROM k)
SELECT category, 13 AS inches, n13 AS n, k13 AS listed FROM m UNION ALL
SELECT category, 15, n15, k15 FROM m UNION ALL SELECT category, 16, n16, k16 FROM m""")
def h03(spark, d):
    return H.laptop_facets(_listed(spark, d))


@query("h04_hubs", "bag", """
SELECT category, count(*) AS total, count(*) FILTER (WHERE dims_cm IS NOT NULL OR
  coalesce(volume_l <> 0 AND weight_g <> 0, FALSE)) AS listed FROM bag GROUP BY category""")
def h04(spark, d):
    return H.hubs(_bags(spark, d)).select("category", "total", "listed")


@query("h05_by_density", "bag", """
SELECT category, id, row_number() OVER (PARTITION BY category ORDER BY
  CASE WHEN weight_g / volume_l >= 5 THEN weight_g / volume_l END ASC NULLS LAST,
  CASE WHEN coalesce(weight_g / volume_l >= 5, FALSE) THEN NULL ELSE icu_sort_key(brand, 'en') END ASC NULLS LAST, ord)
  AS rn FROM bag""")
def h05(spark, d):
    return ranked(_bags(spark, d).select("category", "id", "ord", "brand", "weight_g", "volume_l"),
                  ["category"], H.by_density()).select("category", "id", "rn")


@query("h06_leaderboards", "bag", f"""
WITH {IDX}, r AS (SELECT * FROM idx WHERE gpl >= 5),
a AS (SELECT category, 'lightest' AS board, id, gpl AS value, row_number() OVER
  (PARTITION BY category ORDER BY gpl, ord) AS rn FROM r),
b AS (SELECT category, 'cheapest' AS board, id, price_min / volume_l AS value, row_number() OVER
  (PARTITION BY category ORDER BY price_min / volume_l, ord) AS rn FROM r
  WHERE currency = 'USD' AND price_min <> 0)
SELECT * FROM a UNION ALL SELECT * FROM b""")
def h06(spark, d):
    return H.leaderboards(_bags(spark, d)).withColumn("rn", F.col("rn").cast("bigint"))


@query("h07_makers", "bag", f"""
WITH {IDX} SELECT category, brand_slug, min(brand) AS brand, count(*) AS n FROM idx GROUP BY 1, 2""")
def h07(spark, d):
    return H.makers(_bags(spark, d))


@query("h08_facet_rows", "bag", f"""
WITH {IDX}, x AS (SELECT *, {BAND} AS band FROM idx WHERE volume_l IS NOT NULL),
s AS (SELECT category, band, count(*) AS members FROM x GROUP BY 1, 2),
r AS (SELECT x.category, x.band, x.id, members, row_number() OVER (PARTITION BY x.category, x.band ORDER BY
  CASE WHEN gpl >= 5 THEN gpl END ASC NULLS LAST,
  CASE WHEN coalesce(gpl >= 5, FALSE) THEN NULL ELSE icu_sort_key(brand, 'en') END ASC NULLS LAST, ord) AS rn
  FROM x JOIN s ON x.category = s.category AND x.band = s.band)
SELECT category, band, id, rn, members >= 25 AS listed, members FROM r""")
def h08(spark, d):
    return H.facet_rows(_bags(spark, d)).select("category", "band", "id", F.col("rn").cast("bigint").alias("rn"), "listed", "members")


@query("h09_brand_shelves", "bag", """
SELECT brand_slug, arg_min(brand, ord) AS brand, count(*) AS n, count(DISTINCT category) AS categories,
  min(price_min) AS price_low, max(price_min) AS price_high, arg_min(currency, ord) AS currency
FROM bag GROUP BY brand_slug""")
def h09(spark, d):
    return H.brand_shelves(_bags(spark, d))


@query("h10_related", "bag", """
WITH p AS (SELECT a.id, b.id AS related_id, CASE WHEN a.brand_slug = b.brand_slug THEN 0 ELSE 1 END AS far,
  b.ord FROM bag a JOIN bag b ON a.category = b.category AND a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY far, ord) AS rn FROM p)
SELECT id, related_id, CAST(rn - 1 AS INT) AS place FROM r WHERE rn <= 8""")
def h10(spark, d):
    return H.related(_bags(spark, d), 8)


@query("h11_siblings", "bag", """
SELECT split_from, id, volume_l, row_number() OVER (PARTITION BY split_from
  ORDER BY coalesce(volume_l, 0), ord) AS place, count(*) OVER (PARTITION BY split_from) AS sizes
FROM bag WHERE split_from IS NOT NULL""")
def h11(spark, d):
    return H.siblings(_bags(spark, d))


@query("h12_lastmod", ("bag", "ledger"), f"""
WITH {IDX}, m AS (SELECT bag_id, max(ts) AS t FROM ledger WHERE direction IS NOT NULL GROUP BY bag_id),
s AS (SELECT b.*, greatest(CAST(CAST(replace(b.updated_at, '+02:00', '') AS TIMESTAMP)
  - INTERVAL 2 HOUR AS TIMESTAMP), m.t) AS stamp, {BAND} AS band,
  EXISTS (SELECT 1 FROM idx i WHERE i.id = b.id) AS listed
  FROM bag b LEFT JOIN m ON b.id = m.bag_id)
SELECT 'bag' AS kind, id AS key, stamp FROM s UNION ALL
SELECT 'brand', brand_slug, max(stamp) FROM s GROUP BY 2 UNION ALL
SELECT 'hub', category, max(stamp) FROM s WHERE listed GROUP BY 2 UNION ALL
SELECT 'facet', s.category || '/' || s.band, max(stamp) FROM s
  WHERE listed AND volume_l IS NOT NULL GROUP BY 2""")
def h12(spark, d):
    moved = B.view(spark, d, "ledger").where(F.col("direction").isNotNull())
    return H.lastmod(_bags(spark, d), moved.select("bag_id", "ts"))


@query("h13_hub_samples", "bag", f"""
WITH {IDX} SELECT category, id FROM (SELECT category, id, row_number() OVER (PARTITION BY category
  ORDER BY CASE WHEN regexp_matches(brand, '^[0-9]') THEN 1 ELSE 0 END, icu_sort_key(brand, 'en'),
  CASE WHEN regexp_matches(name, '^[0-9]') THEN 1 ELSE 0 END, icu_sort_key(name, 'en'), ord) AS rn FROM idx) t WHERE rn <= 12""")
def h13(spark, d):
    return H.hub_samples(_bags(spark, d), 12).select("category", "id")


RULINGS = [(f"brand-{i}", k, v) for i in range(0, 25, 3)
           for k, v in (("forest green", "green"), ("atlantic", None), ("jet black", "black"))]


def colour_rulings(spark):
    return spark.createDataFrame(RULINGS, "brand string, key string, value string")


RULED = ("ruled AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{b}', '{k}', " + ("NULL" if v is None else f"'{v}'") + ")" for b, k, v in RULINGS)
    + ") t(brand, key, value))")


@query("h14_colour_audit", ("bag", "variant"), f"""
WITH {RULED}, fv AS (SELECT b.brand_slug, v.bag_id, v.color AS name FROM variant v JOIN bag b ON v.bag_id = b.id
  WHERE v.color_family IS NULL AND v.color IS NOT NULL),
bare AS (SELECT brand_slug, id AS bag_id, unnest(colors) AS name FROM bag WHERE len(color_families) = 0),
r AS (SELECT * FROM fv UNION ALL SELECT b.* FROM bare b WHERE NOT EXISTS
  (SELECT 1 FROM fv WHERE fv.bag_id = b.bag_id AND fv.name = b.name)),
g AS (SELECT brand_slug, lower(name) AS key, min(name) AS name, count(*) AS skus,
  count(DISTINCT bag_id) AS bags FROM r GROUP BY 1, 2)
SELECT g.*, EXISTS (SELECT 1 FROM ruled u WHERE u.brand = g.brand_slug AND u.key = g.key) AS decided FROM g""")
def h14(spark, d):
    return H.colour_audit(_bags(spark, d), B.view(spark, d, "variant"), colour_rulings(spark))


@query("h14_colour_coverage", ("bag", "variant"), """
WITH p AS (SELECT bag_id, bool_or(color IS NOT NULL) AS named,
  bool_or(color IS NOT NULL AND color_family IS NULL) AS open_ FROM variant GROUP BY bag_id)
SELECT count(*) AS bags, count(*) FILTER (WHERE len(color_families) = 0) AS invisible,
  count(*) FILTER (WHERE len(colors) = 0 AND NOT coalesce(named, FALSE)) AS silent,
  count(*) FILTER (WHERE len(color_families) > 0 AND coalesce(open_, FALSE)) AS partial
FROM bag LEFT JOIN p ON bag.id = p.bag_id""")
def h14b(spark, d):
    return H.colour_coverage(_bags(spark, d), B.view(spark, d, "variant"))


@query("h16_reject_audit", ("bag", "variant"), """
WITH r AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'unclassified' ELSE 'not-a-bag' END AS reason, 'brand-' || CAST(p_partkey % 40 AS STRING) AS brand,
  p_partkey % 40 IN (0, 3) AND p_partkey % 5 = 0 AS decided FROM part)
SELECT reason, count(*) AS n, count(*) FILTER (WHERE brand IN (SELECT brand_slug FROM bag)) AS in_catalogue, count(*) FILTER (WHERE decided) AS decided FROM r GROUP BY 1""")
def h16(spark, d):
    part = B.table(spark, d, "part")
    url = "'https://shop.example.com/products/item-' || CAST(p_partkey AS STRING)"
    rejects = part.selectExpr("CASE WHEN p_partkey % 2 = 0 THEN 'unclassified' ELSE 'not-a-bag' END AS reason",
                              "'brand-' || CAST(p_partkey % 40 AS STRING) AS brand_slug", f"{url} AS url")
    rulings = part.where("p_partkey % 40 IN (0, 3) AND p_partkey % 5 = 0").selectExpr(
        "'brand-' || CAST(p_partkey % 40 AS STRING) AS brand", f"{url} AS url").select("brand", S.product_key(F.col("url")).alias("key"))
    return H.reject_audit(rejects, _bags(spark, d), rulings)


@query("h16_admitted", "bag", """
SELECT brand_slug AS brand, id FROM bag WHERE pk % 7 = 0""")
def h16b(spark, d):
    bags = _bags(spark, d)
    rulings = bags.where("pk % 7 = 0").select(F.col("brand_slug").alias("brand"), S.product_key(F.col("url")).alias("key"), F.lit("pouch").alias("value"))
    return H.admitted(bags, rulings).select("brand", "id")


@query("h15_ruling_check", ("bag", "variant"), f"""
WITH {RULED}, n AS (SELECT b.brand_slug AS brand, lower(v.color) AS key, v.color_family FROM variant v
  JOIN bag b ON v.bag_id = b.id)
SELECT u.brand, u.key, u.value AS ruled_family, count(n.key) AS skus,
  coalesce(bool_and(n.color_family IS NOT DISTINCT FROM u.value) FILTER (WHERE n.key IS NOT NULL), FALSE) AS applied
FROM ruled u LEFT JOIN n ON u.brand = n.brand AND u.key = n.key GROUP BY 1, 2, 3""")
def h15(spark, d):
    return H.ruling_check(_bags(spark, d), B.view(spark, d, "variant"), colour_rulings(spark))


# --- gate -------------------------------------------------------------------

@query("v01_required", "bag", """
SELECT 'fail' AS severity, 'required:legacy_slug' AS check_, 'legacy_slug' AS subject,
  CAST(count(*) FILTER (WHERE legacy_slug IS NULL) AS DOUBLE) AS measure FROM bag""")
def v01(spark, d):
    out = V.check_required(_bags(spark, d), X.REQUIRED_FIELDS + ["legacy_slug"])
    return out.withColumnRenamed("check", "check_")


@query("v02_unique", "bag", """
SELECT 'fail' AS severity, 'unique:permalink' AS check_, brand_slug || '/' || slug AS subject,
  CAST(count(*) AS DOUBLE) AS measure FROM bag GROUP BY brand_slug, slug HAVING count(*) > 1""")
def v02(spark, d):
    return V.check_unique(_bags(spark, d)).withColumnRenamed("check", "check_")


@query("v03_bounds", "bag", """
WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE price_min NOT BETWEEN 1 AND 950) AS price_min,
  count(*) FILTER (WHERE weight_g NOT BETWEEN 100 AND 2400) AS weight_g,
  count(*) FILTER (WHERE volume_l NOT BETWEEN 0.05 AND 300) AS volume_l FROM bag),
l AS (SELECT 'price_min' AS f, price_min AS h FROM c UNION ALL SELECT 'weight_g', weight_g FROM c UNION ALL
  SELECT 'volume_l', volume_l FROM c)
SELECT CASE WHEN (SELECT (price_min + weight_g + volume_l) / n FROM c) > 0.01 THEN 'fail' ELSE 'warn' END AS severity,
  'bounds' AS check_, f AS subject, CAST(h AS DOUBLE) AS measure FROM l WHERE h > 0""")
def v03(spark, d):
    return V.check_bounds(_bags(spark, d), {"price_min": (1, 950), "weight_g": (100, 2400),
                                            "volume_l": (0.05, 300)}).withColumnRenamed(
        "check", "check_")


@query("v04_shape", "bag", """
SELECT 'warn' AS severity, 'variants' AS check_, 'variants' AS subject,
  CAST(count(*) FILTER (WHERE variant_count = 0) AS DOUBLE) AS measure FROM bag
UNION ALL SELECT 'fail', 'price-order', 'price-order', CAST(count(*) AS DOUBLE) FROM bag
  WHERE price_min > price_max - 5 AND price_min IS NOT NULL HAVING count(*) > 0
UNION ALL SELECT 'fail', 'dims', 'dims', CAST(count(*) AS DOUBLE) FROM bag
  WHERE dims_cm IS NOT NULL AND abs(linear_cm + CASE WHEN pk % 50 = 1 THEN 3 ELSE 0 END - linear_cm) > 1 HAVING count(*) > 0""")
def v04(spark, d):
    df = _bags(spark, d).withColumn("price_max", F.col("price_max") - 5).withColumn(
        "linear_cm", F.col("linear_cm") + F.when(F.col("pk") % 50 == 1, 3).otherwise(0))
    return V.check_shape(df).withColumnRenamed("check", "check_")


@query("v05_splits", "bag", """
WITH g AS (SELECT split_from, count(*) AS n, count(legacy_slug) AS claims FROM bag
  WHERE split_from IS NOT NULL GROUP BY split_from)
SELECT 'fail' AS severity, 'split:legacy' AS check_, split_from AS subject, CAST(claims AS DOUBLE) AS measure
FROM g WHERE claims <> 1 UNION ALL
SELECT 'fail', 'split:orphan', split_from, CAST(n AS DOUBLE) FROM g WHERE n < 2 UNION ALL
SELECT 'fail', 'split:shadowed', id, CAST(1 AS DOUBLE) FROM bag b WHERE legacy_slug IS NOT NULL AND EXISTS
  (SELECT 1 FROM bag o WHERE o.brand_slug = b.brand_slug AND o.slug = b.legacy_slug)""")
def v05(spark, d):
    return V.check_splits(_bags(spark, d)).withColumnRenamed("check", "check_")


def _log(spark, d):
    from ..functions.skew import top_k
    return top_k(B.view(spark, d, "fetch_log"), ["slug"], [F.desc("night"), F.desc("ord")], 1)


LAST = """last_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY night DESC, ord DESC)
  AS rn FROM fetch_log) t WHERE rn = 1 AND platform NOT IN ('retired', 'todo'))"""
NOW = "2001-08-05 00:00:00"


@query("v06_freshness", "fetch_log", f"""
WITH {LAST}, a AS (SELECT slug, floor((epoch(TIMESTAMP '{NOW}') - epoch(fetched_at)) / 86400) AS age FROM last_
  WHERE status = 'ok')
SELECT CASE WHEN age >= 14 THEN 'fail' ELSE 'warn' END AS severity, 'freshness' AS check_, slug AS subject,
  CAST(age AS DOUBLE) AS measure FROM a WHERE age >= 3""")
def v06(spark, d):
    return V.check_freshness(_log(spark, d), NOW).withColumnRenamed("check", "check_")


@query("v07_streaks", "fetch_log", f"""
WITH {LAST}, w AS (SELECT * FROM (VALUES ('brand-1'), ('brand-2'), ('brand-77')) t(slug)),
b AS (SELECT l.slug, fail_streak, w.slug IS NOT NULL AS waived FROM last_ l LEFT JOIN w ON l.slug = w.slug
  WHERE status <> 'ok')
SELECT CASE WHEN fail_streak >= 10 AND NOT waived THEN 'fail' ELSE 'warn' END AS severity,
  'fetch:failing' AS check_, slug AS subject, CAST(fail_streak AS DOUBLE) AS measure FROM b WHERE fail_streak >= 3
UNION ALL SELECT 'warn', 'allow:failing-brands', slug, CAST(0 AS DOUBLE) FROM w
WHERE slug NOT IN (SELECT slug FROM b WHERE fail_streak >= 10)""")
def v07(spark, d):
    waived = spark.createDataFrame([("brand-1",), ("brand-2",), ("brand-77",)], "slug string")
    return V.check_streaks(_log(spark, d), waived=waived).withColumnRenamed("check", "check_")


@query("v08_currency", "bag", """
WITH u AS (SELECT brand_slug, price_min, row_number() OVER (PARTITION BY brand_slug ORDER BY price_min) AS r,
  count(*) OVER (PARTITION BY brand_slug) AS n FROM bag WHERE currency = 'USD' AND price_min > 0)
SELECT 'fail' AS severity, 'currency' AS check_, brand_slug AS subject, price_min AS measure FROM u
WHERE r = n // 2 + 1 AND n >= 5 AND price_min > 990 UNION ALL
SELECT 'note', 'currency:provenance', currency_source, CAST(count(*) AS DOUBLE) FROM bag GROUP BY 3""")
def v08(spark, d):
    return V.check_currency(_bags(spark, d), ceiling=990.0).withColumnRenamed("check", "check_")


ROSTER = [("brand-3", "GBP", "shopify"), ("brand-7", "USD", "shopify"), ("brand-9", "EUR", "shopify"),
          ("aggregator", None, "removed")]


def _roster(spark):
    return spark.createDataFrame(ROSTER, "slug string, currency string, platform string")


@query("v09_roster", "bag", """
WITH g AS (SELECT brand_slug, arg_min(currency, ord) AS c, arg_min(currency_source, ord) AS s FROM bag GROUP BY 1)
SELECT 'warn' AS severity, 'currency:roster' AS check_, brand_slug AS subject, CAST(1 AS DOUBLE) AS measure
FROM g JOIN (VALUES ('brand-3', 'GBP'), ('brand-7', 'USD'), ('brand-9', 'EUR')) r(slug, want) ON slug = brand_slug
WHERE c <> want AND s IN ('feed', 'product-page', 'locale')""")
def v09(spark, d):
    return V.check_roster(_bags(spark, d), _roster(spark)).withColumnRenamed("check", "check_")


def _shrunk(spark, d):
    """Tonight's catalogue with some brands thinner than the published one."""
    keep = ~((F.col("brand_slug") == "brand-5") | ((F.col("brand_slug") == "brand-6") & (
        F.col("volume_l") > 20)) | ((F.col("brand_slug") == "brand-8") & (F.col("volume_l") > 35)))
    return _bags(spark, d).where(F.coalesce(keep, F.lit(True)))


SHRUNK = """now_ AS (SELECT * FROM bag WHERE coalesce(NOT (brand_slug = 'brand-5' OR
  (brand_slug = 'brand-6' AND volume_l > 20) OR (brand_slug = 'brand-8' AND volume_l > 35)), TRUE))"""


@query("v10_brand_drop", "bag", f"""
WITH {SHRUNK}, w AS (SELECT brand_slug, count(*) AS was FROM bag GROUP BY 1 HAVING count(*) >= 5),
x AS (SELECT w.brand_slug, (was - (SELECT count(*) FROM now_ n WHERE n.brand_slug = w.brand_slug)) / was AS drop_
  FROM w)
SELECT CASE WHEN drop_ > 0.4 THEN 'fail' ELSE 'warn' END AS severity, 'drop:brand' AS check_,
  brand_slug AS subject, drop_ AS measure FROM x WHERE drop_ > 0.25""")
def v10(spark, d):
    return V.check_brand_drop(_shrunk(spark, d), _bags(spark, d)).withColumnRenamed(
        "check", "check_")


@query("v11_swept", "bag", """
WITH s AS (SELECT category AS brand_slug, volume_source, CASE WHEN pk % 3 = 1 THEN 30 ELSE volume_l END AS v,
  price_min FROM bag WHERE volume_source IN ('product-page', 'description') AND volume_l IS NOT NULL),
p AS (SELECT brand_slug, volume_source, v, count(*) AS n, count(DISTINCT price_min) AS prices FROM s GROUP BY 1, 2, 3),
t AS (SELECT *, sum(n) OVER (PARTITION BY brand_slug, volume_source) AS total, row_number() OVER
  (PARTITION BY brand_slug, volume_source ORDER BY n DESC, prices DESC, v DESC) AS r FROM p)
SELECT 'warn' AS severity, 'volume:swept' AS check_, brand_slug || '/' || volume_source AS subject,
  n / total AS measure FROM t WHERE r = 1 AND total >= 4 AND n / total >= 0.6 AND prices >= 3""")
def v11(spark, d):
    df = _bags(spark, d).withColumn("brand_slug", F.col("category")).withColumn(
        "volume_l", F.when(F.col("volume_l").isNotNull() & (F.col("pk") % 3 == 1), 30.0)
        .otherwise(F.col("volume_l")))
    return V.check_swept(df).withColumnRenamed("check", "check_")


@query("v12_density", "bag", """
SELECT 'warn' AS severity, 'density:implausible' AS check_, weight_source AS subject,
  CAST(count(*) AS DOUBLE) AS measure FROM bag WHERE weight_g <> 0 AND volume_l <> 0 AND weight_g / volume_l < 5
GROUP BY weight_source""")
def v12(spark, d):
    return V.check_density(_bags(spark, d)).withColumnRenamed("check", "check_")


@query("v13_brands_gone", "bag", """
SELECT 'note' AS severity, 'drop:brand_count' AS check_, 'brand-5' AS subject, CAST(1 AS DOUBLE) AS measure
FROM (SELECT count(*) AS n FROM bag WHERE brand_slug = 'brand-5') t WHERE n > 0 UNION ALL
SELECT 'fail', 'drop:brand_count', 'brand-11', CAST(1 AS DOUBLE) FROM (SELECT count(*) AS n FROM bag WHERE brand_slug = 'brand-11') t WHERE n > 0 UNION ALL
SELECT 'warn', 'allow:brands-gone', 'brand-6', CAST(0 AS DOUBLE) FROM (SELECT count(*) AS n FROM bag) t""")
def v13(spark, d):
    now = _shrunk(spark, d).where(F.col("brand_slug") != "brand-11")
    allowed = spark.createDataFrame([("brand-5",), ("brand-6",)], "brand_slug string")
    excused = V.removed_orphans(_bags(spark, d), _roster(spark))
    return V.check_brands_gone(now, _bags(spark, d), allowed, excused).withColumnRenamed(
        "check", "check_")


@query("v13_removed_orphans", "bag", """
SELECT CAST(pk % 100 AS STRING) AS brand_slug FROM bag GROUP BY 1
HAVING bool_and(split_part(source, ':', 1) = 'aggregator')""")
def v13b(spark, d):
    df = _bags(spark, d).withColumn("brand_slug", (F.col("pk") % 100).cast("string"))
    return V.removed_orphans(df, _roster(spark))


MEASURES = """SELECT count(*) AS bag_count, sum(variant_count) AS sku_count,
  round_even(100.0::DOUBLE * count(volume_l) / count(*), 0) AS volume_l, round_even(100.0::DOUBLE * count(dims_cm) / count(*), 0) AS dims_cm,
  round_even(100.0::DOUBLE * count(weight_g) / count(*), 0) AS weight_g, round_even(100.0::DOUBLE * count(laptop_in) / count(*), 0) AS laptop_in,
  round_even(100.0::DOUBLE * count(price_min) / count(*), 0) AS price_min FROM """


@query("v14_regression", "bag", f"""
WITH n AS ({MEASURES} bag WHERE dims_cm IS NOT NULL AND pk % 25 < 15), w AS ({MEASURES} bag),
l AS (SELECT 'bag_count' AS metric, CAST(n.bag_count AS DOUBLE) AS v, CAST(w.bag_count AS DOUBLE) AS was FROM n, w UNION ALL
 SELECT 'sku_count', n.sku_count, w.sku_count FROM n, w UNION ALL
 SELECT 'coverage:volume_l', n.volume_l, w.volume_l FROM n, w UNION ALL
 SELECT 'coverage:dims_cm', n.dims_cm, w.dims_cm FROM n, w UNION ALL
 SELECT 'coverage:weight_g', n.weight_g, w.weight_g FROM n, w UNION ALL
 SELECT 'coverage:laptop_in', n.laptop_in, w.laptop_in FROM n, w UNION ALL
 SELECT 'coverage:price_min', n.price_min, w.price_min FROM n, w)
SELECT CASE WHEN (metric LIKE 'coverage%' AND was - v > 10) OR (metric NOT LIKE 'coverage%' AND v < was * 0.75)
  THEN 'fail' ELSE 'note' END AS severity,
  CASE WHEN metric LIKE 'coverage%' THEN metric ELSE 'drop:' || metric END AS check_,
  metric AS subject, v AS measure FROM l WHERE v <> was""")
def v14(spark, d):
    now = _bags(spark, d).where(F.col("dims_cm").isNotNull()).where(
        F.substring_index("brand_slug", "-", -1).cast("int") < 15)
    return V.check_regression(now, _bags(spark, d)).withColumnRenamed("check", "check_")


@query("v15_gate", "bag", """
WITH g AS (SELECT split_from, count(*) AS n, count(legacy_slug) AS claims FROM bag
  WHERE split_from IS NOT NULL GROUP BY split_from),
f AS (SELECT 'fail' AS s FROM g WHERE claims <> 1 UNION ALL SELECT 'fail' FROM g WHERE n < 2 UNION ALL
  SELECT 'fail' FROM bag b WHERE legacy_slug IS NOT NULL AND EXISTS (SELECT 1 FROM bag o WHERE
    o.brand_slug = b.brand_slug AND o.slug = b.legacy_slug) UNION ALL
  SELECT 'fail' FROM bag GROUP BY brand_slug, slug HAVING count(*) > 1 UNION ALL
  SELECT 'warn' FROM bag WHERE weight_g / volume_l < 5 GROUP BY weight_source)
SELECT CAST(0 AS BIGINT) AS notes, count(*) FILTER (WHERE s = 'warn') AS warnings,
  count(*) FILTER (WHERE s = 'fail') AS failures, count(*) FILTER (WHERE s = 'fail') > 0 AS blocking FROM f""")
def v15(spark, d):
    b = _bags(spark, d)
    return V.gate(V._union(V.check_splits(b), V.check_unique(b), V.check_density(b)))
