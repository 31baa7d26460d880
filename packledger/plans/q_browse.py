"""Queries over the catalogue: browse answers and carrier fits."""
from pyspark.sql import functions as F

from ..functions import fixed as X, scalars as S
from ..functions.skew import ranked
from ..operators import browse as W, carryon as K, prices as P
from . import bindings as B
from .registry import query

QUESTION = W.parse_filter("q=r&cat=daypack,duffel,luggage&feat=laptop_sleeve&color=black,green"
                          "&volMin=5&priceMax=1500&laptopMin=14&sort=vol-desc&per=60")
PLAIN = W.Filter()


def _rows(spark, d):
    return W.browse_rows(B.bags(spark, d), B.airlines(spark))


def _cut_rows(spark, d):
    return W.browse_rows(B.bags(spark, d), B.airlines(spark),
                         P.deepest_cut(B.view(spark, d, "variant")))


FITS = """
pairs AS (SELECT b.*, a.airline, a.name AS airline_name, a.region, a.c1, a.lin, a.p1,
  CASE WHEN d3 IS NULL OR c1 IS NULL THEN NULL ELSE
    greatest(d1, d2, d3) <= c1 AND (d1 + d2 + d3 - greatest(d1, d2, d3) - least(d1, d2, d3)) <= c2
    AND least(d1, d2, d3) <= c3 END AS by_axis,
  CASE WHEN d3 IS NULL OR lin IS NULL THEN NULL ELSE d1 + d2 + d3 <= lin END AS by_sum,
  CASE WHEN d3 IS NULL OR p1 IS NULL THEN NULL ELSE
    greatest(d1, d2, d3) <= p1 AND (d1 + d2 + d3 - greatest(d1, d2, d3) - least(d1, d2, d3)) <= p2
    AND least(d1, d2, d3) <= p3 END AS personal FROM bag b CROSS JOIN airline a),
fit AS (SELECT *, CASE WHEN by_axis IS NULL THEN by_sum WHEN by_sum IS NULL THEN by_axis
  ELSE by_axis AND by_sum END AS carry_on FROM pairs),
fitting AS (SELECT id, list(airline) FILTER (WHERE carry_on) AS carriers,
  count(*) FILTER (WHERE carry_on) AS nfit FROM fit GROUP BY id),
rows_ AS (SELECT b.* EXCLUDE (features), coalesce(f.carriers, []) AS airlines, f.nfit,
  CASE WHEN f.nfit = 7 THEN list_append(b.features, 'carry_on_fit') ELSE b.features END AS features,
  coalesce(price_usd_approx, price_min) AS price_cmp,
  lower(concat_ws(' ', brand, name, category, nullif(array_to_string(materials, ' '), ''),
    nullif(array_to_string(b.features, ' '), ''), nullif(array_to_string(colors, ' '), ''),
    nullif(array_to_string(tags, ' '), ''))) AS hay,
  coalesce(linear_cm <= 115 AND linear_cm <> 0, FALSE) AS carryon, d3 IS NULL AS no_dims,
  coalesce(features_source <> 'product-page', TRUE) AS features_unknown,
  len(color_families) = 0 AS no_colour,
  coalesce(d3 IS NOT NULL AND greatest(d1, d2, d3) <= 40 AND
    (d1 + d2 + d3 - greatest(d1, d2, d3) - least(d1, d2, d3)) <= 30 AND least(d1, d2, d3) <= 20, FALSE)
    AS underseat,
  CASE WHEN weight_g <> 0 AND volume_l <> 0 THEN weight_g / volume_l END AS gpl,
  CASE WHEN coalesce(price_usd_approx, price_min) <> 0 AND volume_l <> 0
    THEN coalesce(price_usd_approx, price_min) / volume_l END AS ppl
  FROM bag b JOIN fitting f ON b.id = f.id)"""
VIEWS = ("bag", "airline")

MARKED = FITS + """,
fixed_ AS (SELECT *, contains(hay, 'r') AND coalesce(volume_l >= 5, FALSE)
  AND coalesce(price_cmp <= 1500, FALSE) AS fixed,
  coalesce(category IN ('daypack', 'duffel', 'luggage'), FALSE) AS ok_cat,
  list_contains(features, 'laptop_sleeve') AS ok_feat,
  len(list_intersect(color_families, ['black', 'green'])) > 0 AS ok_col,
  coalesce(laptop_in >= 14, FALSE) AS ok_lap FROM rows_),
marked AS (SELECT *, (CASE WHEN ok_cat THEN 0 ELSE 1 END + CASE WHEN ok_feat THEN 0 ELSE 1 END
  + CASE WHEN ok_col THEN 0 ELSE 1 END + CASE WHEN ok_lap THEN 0 ELSE 1 END) AS nfail,
  fixed AND ok_cat AND ok_feat AND ok_col AND ok_lap AS hit FROM fixed_)"""


@query("b01_browse_rows", VIEWS, f"""
WITH {FITS} SELECT id, hay, price_cmp, gpl, ppl, carryon, underseat, no_dims, features_unknown,
  no_colour, CAST(len(features) AS INT) AS n_features, array_to_string(list_sort(airlines), ',') AS airlines
FROM rows_""")
def b01(spark, d):
    return _rows(spark, d).select(
        "id", "hay", "price_cmp", "gpl", "ppl", "carryon", "underseat", "no_dims",
        "features_unknown", "no_colour", F.size("features").alias("n_features"),
        F.array_join(F.array_sort("airlines"), ",").alias("airlines"))


@query("b02_search", VIEWS, f"""
WITH {FITS} SELECT id FROM rows_ WHERE contains(hay, 'red') AND contains(hay, 'canvas')""")
def b02(spark, d):
    f = W.parse_filter("q=Red canvas")
    return _rows(spark, d).where(W.search(f.terms)).select("id")


@query("b03_any_of", VIEWS, f"""
WITH {FITS} SELECT id FROM rows_ WHERE category IN ('sling', 'pouch') AND
  brand_slug IN ('brand-3', 'brand-4', 'brand-8') AND len(list_intersect(materials, ['Nylon', 'Leather'])) > 0
  AND len(list_intersect(color_families, ['green', 'blue'])) > 0""")
def b03(spark, d):
    f = W.parse_filter("cat=sling,pouch&brand=brand-3,brand-4,brand-8&mat=Nylon,Leather&color=green,blue")
    tests = W.group_tests(f)
    return _rows(spark, d).where(tests["categories"] & tests["brands"] & tests["materials"]
                                 & tests["colors"]).select("id")


@query("b04_every_of", VIEWS, f"""
WITH {FITS} SELECT id FROM rows_ WHERE list_has_all(features, ['laptop_sleeve', 'rfid'])
  AND list_has_all(airlines, ['foxglove', 'northwind-air'])""")
def b04(spark, d):
    f = W.parse_filter("feat=laptop_sleeve,rfid&airline=foxglove,northwind-air")
    tests = W.group_tests(f)
    return _rows(spark, d).where(tests["features"] & tests["airlines"]).select("id")


@query("b05_ranges", VIEWS, f"""
WITH {FITS} SELECT id FROM rows_ WHERE volume_l >= 0 AND volume_l <= 30 AND price_cmp >= 920
  AND weight_g <= 1200 AND weight_g >= 100 AND linear_cm <= 90""")
def b05(spark, d):
    f = W.parse_filter("volMin=0&volMax=30&priceMin=920&weightMin=100&weightMax=1200"
                       "&linearMax=90&priceMax=abc")
    return _rows(spark, d).where(W.ranges(f)).select("id")


@query("b06_laptop_rungs", VIEWS, f"""
WITH {FITS} SELECT CAST(s.n AS STRING) AS value, count(*) AS n FROM rows_, (VALUES (13), (14), (15), (16), (17)) s(n)
WHERE laptop_in >= s.n GROUP BY 1""")
def b06(spark, d):
    rows = W.marked(_rows(spark, d), PLAIN)
    return W.facet_counts(rows).where(F.col("group") == "laptop").select("value", "n")


@query("b07_presets", VIEWS, f"""
WITH {FITS} SELECT id FROM rows_ WHERE carryon AND underseat AND in_stock AND on_sale""")
def b07(spark, d):
    return _rows(spark, d).where(W.presets(W.parse_filter(
        "preset=carryon,underseat&stock=1&sale=1"))).select("id")


@query("b08_fit_feature", VIEWS, f"""
WITH {FITS} SELECT id FROM rows_ WHERE nfit = 7""")
def b08(spark, d):
    return _rows(spark, d).where(F.array_contains("features", X.FIT_FEATURE)).select("id")


@query("b09_scope", VIEWS, f"""
WITH {FITS} SELECT 'brand' AS scope, count(*) AS n FROM rows_ WHERE brand_slug = 'brand-7' UNION ALL
SELECT 'airline', count(*) FROM rows_ WHERE list_contains(airlines, 'easterly') UNION ALL
SELECT 'sale', count(*) FROM rows_ WHERE on_sale""")
def b09(spark, d):
    rows, air = _rows(spark, d), B.airlines(spark)
    parts = [W.scope(rows, W.parse_filter("scope=" + s), air).agg(
        F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("scope"), "n")
        for k, s in (("brand", "brand:brand-7"), ("airline", "airline:easterly"), ("sale", "sale"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("b10_sorts", VIEWS + ("variant",), f"""
WITH {FITS}, cut AS (SELECT bag_id, max(1.0::DOUBLE - price / compare_at) AS off FROM variant
  WHERE price <> 0 AND compare_at > price GROUP BY bag_id),
x AS (SELECT r.*, CASE WHEN on_sale THEN c.off END AS discount FROM rows_ r LEFT JOIN cut c ON r.id = c.bag_id),
o AS (SELECT 'vol-asc' AS sort, id, row_number() OVER (ORDER BY volume_l ASC NULLS LAST, ord) AS rn FROM x UNION ALL
 SELECT 'price-desc', id, row_number() OVER (ORDER BY price_cmp DESC NULLS LAST, ord) FROM x UNION ALL
 SELECT 'gpl', id, row_number() OVER (ORDER BY gpl ASC NULLS LAST, ord) FROM x UNION ALL
 SELECT 'discount', id, row_number() OVER (ORDER BY discount DESC NULLS LAST, icu_sort_key(brand, 'en'),
   icu_sort_key(name, 'en'), ord) FROM x)
SELECT sort, id, rn FROM o""")
def b10(spark, d):
    rows = _cut_rows(spark, d).select("id", "ord", "volume_l", "price_cmp", "gpl", "discount", "brand", "name")
    out = None
    for s in ("vol-asc", "price-desc", "gpl", "discount"):
        part = ranked(rows, [], W.sort(s)).select(F.lit(s).alias("sort"), "id", "rn")
        out = part if out is None else out.unionByName(part)
    return out


#: The table's names with accents, capitals and figures in front, in both engines.
LABELS = ("CASE pk % 7 WHEN 0 THEN 'é' || substring(name, 2) WHEN 1 THEN upper(name) "
          "WHEN 2 THEN CAST(pk % 100 AS STRING) || ' ' || name WHEN 3 THEN 'Ö' || name "
          "WHEN 4 THEN replace(name, ' ', '-') WHEN 5 THEN name || ' é' ELSE name END")


@query("b11_by_label", "bag", f"""
SELECT category, id, label, row_number() OVER (PARTITION BY category ORDER BY
  CASE WHEN regexp_matches(label, '^[0-9]') THEN 1 ELSE 0 END, icu_sort_key(label, 'en'), ord) AS rn
FROM (SELECT *, {LABELS} AS label FROM bag) t""")
def b11(spark, d):
    rows = B.bags(spark, d).selectExpr("category", "id", "ord", f"{LABELS} AS label")
    return ranked(rows, ["category"], [*S.label_order(F.col("label")), F.col("ord").asc()]).select(
        "category", "id", "label", "rn")


@query("b12_facet_counts", VIEWS, f"""
WITH {MARKED}, live AS (SELECT * FROM marked WHERE fixed)
SELECT 'categories' AS "group", category AS value, count(*) AS n FROM live
  WHERE nfail = 0 OR (nfail = 1 AND NOT ok_cat) GROUP BY category UNION ALL
SELECT 'brands', brand_slug, count(*) FROM live WHERE nfail = 0 GROUP BY brand_slug UNION ALL
SELECT 'features', v, count(*) FROM (SELECT unnest(features) AS v FROM live WHERE nfail = 0) t GROUP BY v UNION ALL
SELECT 'materials', v, count(*) FROM (SELECT unnest(materials) AS v FROM live WHERE nfail = 0) t GROUP BY v UNION ALL
SELECT 'airlines', v, count(*) FROM (SELECT unnest(airlines) AS v FROM live WHERE nfail = 0) t GROUP BY v UNION ALL
SELECT 'colors', v, count(*) FROM (SELECT unnest(color_families) AS v FROM live
  WHERE nfail = 0 OR (nfail = 1 AND NOT ok_col)) t GROUP BY v UNION ALL
SELECT 'laptop', CAST(s.n AS STRING), count(*) FROM live, (VALUES (13), (14), (15), (16), (17)) s(n)
  WHERE (nfail = 0 OR (nfail = 1 AND NOT ok_lap)) AND laptop_in >= s.n GROUP BY 2""")
def b12(spark, d):
    return W.facet_counts(W.marked(_rows(spark, d), QUESTION))


@query("b13_facet_shape", VIEWS, f"""
WITH {MARKED}, sc AS (SELECT * FROM marked WHERE brand_slug = 'brand-7'),
t AS (SELECT 'categories' AS "group", category AS value, count(*) AS total FROM sc GROUP BY category UNION ALL
SELECT 'materials', v, count(*) FROM (SELECT unnest(materials) AS v FROM sc) t GROUP BY v UNION ALL
SELECT 'colors', v, count(*) FROM (SELECT unnest(color_families) AS v FROM sc) t GROUP BY v),
live AS (SELECT 'categories' AS "group", category AS value, count(*) AS n FROM sc
  WHERE fixed AND (nfail = 0 OR (nfail = 1 AND NOT ok_cat)) GROUP BY category UNION ALL
SELECT 'materials', v, count(*) FROM (SELECT unnest(materials) AS v FROM sc WHERE fixed AND nfail = 0) t GROUP BY v UNION ALL
SELECT 'colors', v, count(*) FROM (SELECT unnest(color_families) AS v FROM sc
  WHERE fixed AND (nfail = 0 OR (nfail = 1 AND NOT ok_col))) t GROUP BY v)
SELECT t."group", t.value, row_number() OVER (PARTITION BY t."group" ORDER BY total DESC, t.value) AS place,
  coalesce(l.n, 0) AS n FROM t LEFT JOIN live l ON t."group" = l."group" AND t.value = l.value""")
def b13(spark, d):
    rows = W.marked(W.scope(_rows(spark, d), W.parse_filter("scope=brand:brand-7")), QUESTION)
    return W.facets(rows, rows).where(F.col("group").isin(
        "categories", "materials", "colors")).select(
        "group", "value", F.col("place").cast("bigint").alias("place"), "n")


@query("b14_totals", VIEWS, f"""
WITH {MARKED} SELECT count(*) AS total, count(DISTINCT brand_slug) AS brands,
  CAST(coalesce(sum(variant_count), 0) AS BIGINT) AS skus FROM marked WHERE hit""")
def b14(spark, d):
    return W.totals(W.marked(_rows(spark, d), QUESTION))


@query("b15_caveats", VIEWS, f"""
WITH {MARKED} SELECT count(*) FILTER (WHERE features_unknown) AS no_feature,
  count(*) FILTER (WHERE no_colour) AS no_colour, CAST(0 AS BIGINT) AS no_dims FROM marked WHERE NOT hit""")
def b15(spark, d):
    return W.caveats(W.marked(_rows(spark, d), QUESTION), QUESTION)


FAVS = ["brand-12__m12", "brand-0__m50", "brand-15__m90"]


@query("b16_page", VIEWS, f"""
WITH {MARKED}, o AS (SELECT id, row_number() OVER (ORDER BY volume_l DESC NULLS LAST, ord) AS rn
  FROM marked WHERE hit AND id NOT IN ('{"', '".join(FAVS)}'))
SELECT 'page' AS part, id FROM o WHERE rn BETWEEN 1 AND 60 UNION ALL
SELECT 'fav', id FROM marked WHERE hit AND id IN ('{"', '".join(FAVS)}')""")
def b16(spark, d):
    from dataclasses import replace
    f = replace(QUESTION, fav=tuple(FAVS))
    page, favs = W.page(W.marked(_rows(spark, d), f), f)
    return page.select(F.lit("page").alias("part"), "id").unionByName(
        favs.select(F.lit("fav").alias("part"), "id"))


@query("b17_scope_stats", VIEWS, f"""
WITH {FITS} SELECT greatest(max(volume_l), 0) AS max_volume, greatest(max(price_cmp), 0) AS max_price,
  CAST(greatest(max(weight_g), 0) AS DOUBLE) AS max_weight, count(*) AS bags,
  count(DISTINCT brand_slug) AS brands, CAST(sum(variant_count) AS BIGINT) AS skus,
  count(volume_l) AS have_volume_l, count(dims_cm) AS have_dims_cm, count(weight_g) AS have_weight_g,
  count(laptop_in) AS have_laptop_in, count(price_min) AS have_price_min FROM rows_ WHERE on_sale""")
def b17(spark, d):
    return W.scope_stats(W.scope(_rows(spark, d), W.parse_filter("scope=sale")))


@query("b18_project", VIEWS + ("variant",), f"""
WITH {MARKED}, o AS (SELECT * FROM marked WHERE hit ORDER BY volume_l DESC NULLS LAST, ord LIMIT 60)
SELECT o.id, o.name, o.price_min, v.pos AS v_pos, v.sku AS v_sku, v.color AS v_color, v.price AS v_price
FROM o LEFT JOIN variant v ON v.bag_id = o.id""")
def b18(spark, d):
    page, _ = W.page(W.marked(_rows(spark, d), QUESTION), QUESTION)
    return W.project(page, B.view(spark, d, "variant")).select(
        "id", "name", "price_min", "v_pos", "v_sku", "v_color", "v_price")


CHOSEN = ["brand-2__m2", "brand-3__m3", "brand-9__m34", "brand-16__m41"]


@query("b19_compare", VIEWS, f"""
WITH {FITS}, c AS (SELECT *, list_position(['{"', '".join(CHOSEN)}'], id) AS at_ FROM rows_
  WHERE id IN ('{"', '".join(CHOSEN)}')),
long AS (SELECT 'volume' AS metric, id, at_, volume_l AS v, 'max' AS want FROM c UNION ALL
 SELECT 'weight', id, at_, CAST(weight_g AS DOUBLE), 'min' FROM c UNION ALL
 SELECT 'price', id, at_, price_cmp, 'min' FROM c UNION ALL
 SELECT 'linear', id, at_, linear_cm, 'min' FROM c UNION ALL
 SELECT 'gpl', id, at_, gpl, 'min' FROM c UNION ALL SELECT 'ppl', id, at_, ppl, 'min' FROM c),
agg AS (SELECT metric, count(v) AS n, min(v) AS lo, max(v) AS hi,
  count(DISTINCT coalesce(CAST(v AS STRING), '-')) > 1 AS differs FROM long GROUP BY metric),
w AS (SELECT l.metric, l.id, l.at_, a.differs, a.n > 1 AND l.v = CASE WHEN want = 'min' THEN lo ELSE hi END AS win
  FROM long l JOIN agg a ON l.metric = a.metric),
f AS (SELECT metric, min(at_) AS first_ FROM w WHERE win GROUP BY metric)
SELECT w.metric, w.id, w.differs, coalesce(w.win AND w.at_ = f.first_, FALSE) AS best
FROM w LEFT JOIN f ON w.metric = f.metric""")
def b19(spark, d):
    return W.compare(_rows(spark, d), CHOSEN).where(F.col("metric").isin(
        list(W.COMPARED))).select("metric", "id", "differs", "best")


@query("b20_filter_round_trip", VIEWS, f"""
WITH {MARKED} SELECT id FROM marked WHERE hit""")
def b20(spark, d):
    again = W.parse_filter(W.to_params(QUESTION))
    return W.marked(_rows(spark, d), again).where("hit").select("id")


# --- carriers ---------------------------------------------------------------

@query("k01_k02_fit_matrix", VIEWS, f"""
WITH {FITS} SELECT id, airline, carry_on, personal FROM fit""")
def k02(spark, d):
    return K.fit_matrix(B.bags(spark, d), B.airlines(spark))


@query("k03_compliance", VIEWS, f"""
WITH {FITS} SELECT id, CAST(count(*) FILTER (WHERE carry_on) AS INT) AS carry_on,
  CAST(count(carry_on) AS INT) AS carry_on_of, CAST(count(*) FILTER (WHERE personal) AS INT) AS personal,
  CAST(count(personal) AS INT) AS personal_of FROM fit WHERE d3 IS NOT NULL GROUP BY id""")
def k03(spark, d):
    return K.compliance(B.bags(spark, d), B.airlines(spark))


@query("k04_fits_by_airline", VIEWS, f"""
WITH {FITS} SELECT airline, airline_name AS name, region, count(*) FILTER (WHERE carry_on) AS fits,
  count(*) FILTER (WHERE personal) AS personal FROM fit WHERE d3 IS NOT NULL GROUP BY 1, 2, 3 UNION ALL
SELECT airline, name, region, 0, 0 FROM airline WHERE NOT EXISTS (SELECT 1 FROM fit WHERE d3 IS NOT NULL)""")
def k04(spark, d):
    return K.fits_by_airline(B.bags(spark, d), B.airlines(spark))


@query("k04_strictest_loosest", VIEWS, f"""
WITH {FITS}, n AS (SELECT airline, count(*) FILTER (WHERE carry_on) AS fits FROM fit
  WHERE d3 IS NOT NULL GROUP BY airline)
SELECT (SELECT airline FROM n ORDER BY fits, airline LIMIT 1) AS strictest,
  (SELECT airline FROM n ORDER BY fits DESC, airline DESC LIMIT 1) AS loosest,
  min(fits) AS strictest_fits, max(fits) AS loosest_fits FROM n""")
def k04b(spark, d):
    return K.strictest_loosest(K.fits_by_airline(B.bags(spark, d), B.airlines(spark)))


@query("k05_just_misses", VIEWS, f"""
WITH {FITS} SELECT f.airline, f.id, CAST(g.nfit AS INT) AS fit_count, f.volume_l FROM fit f
JOIN fitting g ON f.id = g.id WHERE f.d3 IS NOT NULL AND f.carry_on = FALSE AND g.nfit >= ceil(7 * 0.6)""")
def k05(spark, d):
    return K.just_misses(B.bags(spark, d), B.airlines(spark))


@query("k06_largest_fits", VIEWS, f"""
WITH {FITS} SELECT airline, id, volume_l, row_number() OVER
  (PARTITION BY airline ORDER BY volume_l DESC, id) AS rn FROM fit WHERE carry_on AND volume_l IS NOT NULL""")
def k06(spark, d):
    return K.largest_fits(B.bags(spark, d), B.airlines(spark)).select(
        "airline", "id", "volume_l", F.col("rn").cast("bigint").alias("rn"))


@query("k06_category_mix", VIEWS, f"""
WITH {FITS} SELECT airline, category, count(*) AS n FROM fit WHERE carry_on GROUP BY 1, 2""")
def k06b(spark, d):
    return K.category_mix(B.bags(spark, d), B.airlines(spark))


@query("k07_carriers_fitting", VIEWS, f"""
WITH {FITS} SELECT id, coalesce(array_to_string(list_sort(carriers), ','), '') AS airlines FROM fitting""")
def k07(spark, d):
    return K.carriers_fitting(B.bags(spark, d), B.airlines(spark)).select(
        "id", F.array_join(F.array_sort("airlines"), ",").alias("airlines"))


@query("k08_slug_collisions", (), """
SELECT lower(regexp_replace(s_name, '[^A-Za-z0-9]+', '-', 'g')) AS airline, count(*) AS n FROM (
  SELECT 'Carrier ' || CAST(s_suppkey % 90 AS STRING) AS s_name FROM supplier) t
GROUP BY 1 HAVING count(*) > 1""")
def k08(spark, d):
    names = B.table(spark, d, "supplier").selectExpr(
        "'Carrier ' || CAST(s_suppkey % 90 AS STRING) AS name")
    return K.slug_unique(names).select("airline", "n")
