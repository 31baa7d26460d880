"""Queries over sources, sinks, images, streams and the composite runs."""
from pyspark.sql import functions as F

from ..durable import scratch_path
from ..functions import fixed as X
from ..operators import alerts as A, images as G, prices as P
from ..sources import files as IO
from ..streaming import jobs as T
from . import bindings as B, pipelines as R
from .q_people import DROPS, EV, _events, _subs  # noqa: F401
from .registry import query

K = "CAST({} AS STRING)".format


# --- sources ----------------------------------------------------------------

@query("s01_read_raw", (), """
SELECT 'products' AS part, count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS keys FROM part UNION ALL SELECT 'unreadable', 1, 0""")
def s01(spark, d):
    docs = B.table(spark, d, "part").selectExpr(
        "'brand-' || CAST(p_partkey % 25 AS STRING) AS slug", "floor(p_partkey / 250) AS block",
        "named_struct('id', p_partkey, 'title', p_name) AS product")
    # blocks keep a document small whatever a brand's share of the table is
    docs = docs.groupBy("slug", "block").agg(F.collect_list("product").alias("products")).select(
        F.to_json(F.struct("slug", F.col("slug").alias("name"), F.lit("shopify").alias("platform"), "products")).alias("value"))
    path = scratch_path(spark, "raw")
    torn = spark.createDataFrame([('{"slug": "torn", "products": [{"id": 1',)], "value string")
    docs.unionByName(torn).write.text(path)
    products, unreadable = IO.read_raw(spark, path, lines=True)
    key = F.get_json_object("product", "$.id").cast("bigint")
    return products.agg(F.count(F.lit(1)).alias("n"), F.sum(key).alias("keys")).select(F.lit("products").alias("part"), "n", "keys").unionByName(
        unreadable.agg(F.count(F.lit(1)).alias("n")).select(F.lit("unreadable").alias("part"), "n", F.lit(0).cast("bigint").alias("keys")))


@query("s02_read_roster", (), "SELECT n_name AS slug, CASE WHEN n_nationkey % 2 = 0 THEN 'EUR' END AS currency FROM nation")
def s02(spark, d):
    path = scratch_path(spark, "roster")
    B.table(spark, d, "nation").selectExpr("n_name AS slug", "n_name AS name", "CASE WHEN n_nationkey % 2 = 0 THEN 'EUR' END AS currency").write.json(path)
    return IO.read_roster(spark, path, lines=True).select("slug", "currency")


@query("s03_read_hints", (), """
SELECT 'brand-' || CAST(p_partkey % 25 AS STRING) AS slug, CAST(p_partkey AS STRING) AS product_id, CASE WHEN p_partkey % 3 = 0 THEN 'tote' END AS hint_category, p_partkey % 2 = 0 AS hint_is_bag FROM part""")
def s03(spark, d):
    path = scratch_path(spark, "hints")
    rows = B.table(spark, d, "part").selectExpr("'brand-' || CAST(p_partkey % 25 AS STRING) AS slug", """map(CAST(p_partkey AS STRING), named_struct('category',
      CASE WHEN p_partkey % 3 = 0 THEN 'tote' END, 'bag_votes', 1, 'accessory_votes', 0, 'in', array('x'), 'is_bag', p_partkey % 2 = 0)) AS products""")
    rows.write.json(path)
    return IO.read_hints(spark, path, lines=True)


@query("s04_read_rulings", (), """
SELECT n_name AS brand, 'forest green' AS key, 'green' AS value FROM nation UNION ALL SELECT n_name, 'x-pac', NULL FROM nation""")
def s04(spark, d):
    path = scratch_path(spark, "rulings")
    # the nation table is a fixed dimension of 25 rows: one document holds it
    e = F.struct(F.lit("green").alias("Forest  Green"), F.lit(None).cast("string").alias("X-Pac"))
    doc = B.table(spark, d, "nation").groupBy().agg(F.map_from_entries(F.collect_list(F.struct("n_name", e))).alias("m"))
    doc.select(F.concat(F.lit('{"_note":"x",'), F.substr(F.to_json("m", {"ignoreNullFields": "false"}), F.lit(2))).alias("value")).write.text(path)
    return IO.read_rulings(spark, path, [n for n, _ in X.COLOUR_RULES])


@query("s05_read_ledger", "ledger", """
SELECT bag_id, count(*) AS n, count(price) AS priced, min(ts) AS first_ts, sum(CASE WHEN rebased THEN 1 ELSE 0 END)::BIGINT AS rebased FROM ledger GROUP BY bag_id""")
def s05(spark, d):
    path = scratch_path(spark, "ledger")
    rows = B.view(spark, d, "ledger").select("ts", "bag_id", "brand", "sku", "color", "price", "rebased", "prev_price", "delta", "direction")
    torn = spark.createDataFrame([('{"ts":"2001-01-01T00:00:00.000","bag_id":"torn","pri',)], "value string")
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).unionByName(torn).write.text(path)
    return IO.read_ledger(spark, path).groupBy("bag_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("price").alias("priced"), F.min("ts").alias("first_ts"), F.count_if("rebased").alias("rebased"))


@query("s06_append_ledger", "ledger", "SELECT CAST(date_trunc('month', ts) AS DATE) AS dt, count(*) AS n FROM ledger GROUP BY 1")
def s06(spark, d):
    path = scratch_path(spark, "ledger-log")
    rows = B.view(spark, d, "ledger")
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    IO.append_ledger(rows.where(F.col("ts") < cut), path, "1")
    IO.append_ledger(rows, path, "2")
    IO.append_ledger(rows.where(F.col("ts") >= cut), path, "2")   # a repeated run replaces its rows
    return spark.read.parquet(path).groupBy("dt").agg(F.count(F.lit(1)).alias("n"))


@query("s07_price_state", (), """
SELECT 'k' || CAST(p_partkey AS STRING) AS key, p_retailprice + 1 AS price FROM part""")
def s07(spark, d):
    path = scratch_path(spark, "state")
    one = B.table(spark, d, "part").selectExpr("'k' || CAST(p_partkey AS STRING) AS key", "p_retailprice AS price", "TRUE AS available")
    IO.save_state(one, path, "2001-01-01")
    IO.save_state(one.withColumn("price", F.col("price") + 1), path, "2001-01-02")
    return IO.load_state(spark, path).select("key", "price")


@query("s08_enrich_cache", (), "SELECT CAST(p_partkey AS STRING) AS page_key, p_size AS v FROM part")
def s08(spark, d):
    path = scratch_path(spark, "cache")
    IO.write_cache(B.table(spark, d, "part").selectExpr("CAST(p_partkey AS STRING) AS page_key", "p_size AS v"), path)
    return IO.read_cache(spark, path)


@query("s10_read_airlines", (), """
SELECT 'Carrier ' || CAST(n_nationkey AS STRING) AS name, CASE WHEN n_nationkey % 3 > 0 THEN CAST(50 + n_nationkey AS STRING) || ',40,20' END AS carry_on,
  CASE WHEN n_nationkey % 3 = 0 THEN CAST(115 AS INT) END AS linear FROM nation""")
def s10(spark, d):
    path = scratch_path(spark, "airlines")
    one = B.table(spark, d, "nation").selectExpr("'Carrier ' || CAST(n_nationkey AS STRING) AS name", "n_name AS region",
        "CASE WHEN n_nationkey % 3 > 0 THEN array(50 + n_nationkey, 40, 20) END AS carry_on_cm", "CASE WHEN n_nationkey % 3 = 0 THEN 115 END AS carry_on_linear_cm")
    doc = one.agg(F.to_json(F.struct(F.collect_list(F.struct(*one.columns)).alias("airlines"))).alias("value"))
    doc.write.text(path)
    return IO.read_airlines(spark, path).select("name", F.array_join(F.col("carry_on_cm").cast("array<string>"), ",").alias("carry_on"), F.col("carry_on_linear_cm").alias("linear"))


@query("s16_read_pages", (), "SELECT count(*) AS files, count(DISTINCT html) AS pages, sum(length(html))::BIGINT AS chars FROM pages")
def s16(spark, d):
    path = scratch_path(spark, "stored")
    pages = B.table(spark, d, "pages").select(F.replace("html", F.lit("\r"), F.lit("")).alias("value"))
    # a file for each of some tasks; the reader opens gzip and takes a file as one page
    pages.repartition(4).write.option("compression", "gzip").option("lineSep", "\x1e").text(path)
    got = IO.read_pages(spark, path).select(F.explode(F.split("html", "\x1e")).alias("html")).where("html <> ''")
    return got.agg(F.count(F.lit(1)).alias("files"), F.countDistinct("html").alias("pages"), F.sum(F.length("html")).alias("chars"))


@query("s11_read_fx", (), """
SELECT DATE '2026-01-05' AS date, CASE n_nationkey WHEN 0 THEN 'USD' ELSE chr(65 + n_nationkey) || 'AA' END AS currency, round((n_nationkey + 2) / 2.0::DOUBLE, 6) AS per_usd FROM nation
UNION ALL SELECT DATE '2026-01-05', 'EUR', 0.5""")
def s11(spark, d):
    path = scratch_path(spark, "fx")
    code = F.when(F.col("n_nationkey") == 0, "USD").otherwise(F.concat(F.char(F.col("n_nationkey") + 65), F.lit("AA")))
    rate = (F.col("n_nationkey") + 2).cast("string")
    # attributes in either order, in either quotes, over lines
    cube = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("<Cube currency='"), code, F.lit("' rate='"), rate, F.lit("'/>"))).otherwise(
        F.concat(F.lit('<Cube note="a > b"\n rate = "'), rate, F.lit('" currency="'), code, F.lit('"></Cube>')))
    body = B.table(spark, d, "nation").groupBy().agg(F.array_join(F.collect_list(cube), "\n").alias("c"))
    body.select(F.concat(F.lit("<?xml version='1.0' encoding='UTF-8'?>\n<g:Envelope xmlns:g='urn:g' xmlns='urn:r'><g:subject>Rates</g:subject><!-- <Cube/> --><Cube><Cube time='2026-01-05'>"),
                         "c", F.lit("</Cube></Cube></g:Envelope>")).alias("value")).write.text(path)
    return IO.read_fx(spark, path)[0]


@query("s12_worklist", (), """
SELECT CAST(p_partkey AS STRING) AS k, p_name || ', "the ' || p_type || '"' || chr(10) || 'x' AS name FROM part""")
def s12(spark, d):
    path = scratch_path(spark, "sheet")
    IO.write_worklist(B.table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.concat("p_name", F.lit(', "the '), "p_type", F.lit('"\nx')).alias("name")), path)
    return IO.read_worklist(spark, path)


@query("s13_write_catalogue", ("bag", "variant"), "SELECT (SELECT count(*) FROM bag) AS bags, (SELECT count(*) FROM variant) AS variants, 25 AS meta_brands")
def s13(spark, d):
    from ..operators.models import catalogue_meta
    path = scratch_path(spark, "catalogue")
    b = B.bags(spark, d)
    IO.write_catalogue(b, B.view(spark, d, "variant"), catalogue_meta(b), path, "1")
    n = lambda t: IO.read_catalogue(spark, path, t).agg(F.count(F.lit(1)).alias(t))
    meta = IO.read_catalogue(spark, path, "meta").where("metric = 'brand_count'").select(F.col("value").cast("int").alias("meta_brands"))
    both = n("bags").unionByName(n("variants"), allowMissingColumns=True).unionByName(meta, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


@query("s14_write_rejects", (), "SELECT CASE WHEN p_partkey % 2 = 0 THEN 'a' ELSE 'b' END AS reason, p_name AS title FROM part")
def s14(spark, d):
    path = scratch_path(spark, "rejects")
    IO.write_rejects(B.table(spark, d, "part").selectExpr("CASE WHEN p_partkey % 2 = 0 THEN 'a' ELSE 'b' END AS reason", "p_brand AS brand_slug", "p_name AS title"), path)
    return spark.read.parquet(path).select("reason", "title")


@query("s15_write_events", ("ledger", "bag"), f"WITH {EV} SELECT bag_id, ord, direction FROM ev")
def s15(spark, d):
    path = scratch_path(spark, "events")
    IO.write_events(_events(spark, d), path)
    return spark.read.parquet(path).select("bag_id", "ord", "direction")


@query("s19_image_urls", ("bag", "variant"), "SELECT image AS url FROM bag UNION SELECT image FROM variant")
def s19(spark, d):
    return G.image_urls(B.bags(spark, d), B.view(spark, d, "variant"))


def _sitemaps(spark, d):
    """One body per 100 stored page addresses, a child sitemap in each, some refused."""
    loc = F.concat(F.lit("<url><loc> "), F.regexp_replace("url", "&", "&amp;"), F.lit(" </loc></url>"))
    p = B.table(spark, d, "pages").withColumn("g", F.floor(F.col("page_id") / 100))
    body = p.groupBy("g").agg(F.array_join(F.collect_list(loc), "").alias("b"))
    return body.select(F.col("g").cast("string").alias("url"), F.when(F.col("g") == 1, 503).otherwise(200).alias("status"),
                       F.concat("b", F.lit("<loc>https://x.example.com/child-"), F.col("g").cast("string"), F.lit(".xml.gz</loc>")).alias("body"))


@query("s20_sitemap_urls", (), """
WITH u AS (SELECT DISTINCT replace(url, '&', '&amp;') AS url FROM pages WHERE NOT (page_id >= 100 AND page_id < 200)),
r AS (SELECT CASE WHEN contains(url, '/en/') THEN 'english' WHEN contains(url, '//m.') THEN 'mobile' END AS route, url FROM u WHERE NOT regexp_matches(url, '(?i)\\.xml(\\.gz)?($|[?#])'))
SELECT route, url FROM r WHERE route IS NOT NULL""")
def s20(spark, d):
    return IO.sitemap_urls(_sitemaps(spark, d), {"english": "/en/", "mobile": "//m\\."})[0]


@query("s20_children_and_refusals", (), """
SELECT 'child' AS kind, count(DISTINCT page_id // 100) AS n FROM pages WHERE page_id // 100 <> 1 UNION ALL
SELECT 'refused', count(DISTINCT page_id // 100) FROM pages WHERE page_id // 100 = 1""")
def s20b(spark, d):
    _, child, refused = IO.sitemap_urls(_sitemaps(spark, d), {"english": "/en/"})
    return child.agg(F.count(F.lit(1)).alias("n")).select(F.lit("child").alias("kind"), "n").unionByName(
        refused.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("refused").alias("kind"), "n"))


@query("s21_baseline", "bag", "SELECT brand_slug, count(*) AS n FROM bag GROUP BY 1")
def s21(spark, d):
    path = scratch_path(spark, "published")
    B.bags(spark, d).select("id", "brand_slug").write.parquet(path)
    return IO.baseline(spark, path, require=True).groupBy("brand_slug").agg(F.count(F.lit(1)).alias("n"))


ASKED = ["brand-9__m34", "brand-2__m2", "nobody__x", "brand-16__m41"]


@query("s22_lookup", "bag", "SELECT id, CAST(list_position(['brand-9__m34', 'brand-2__m2', 'nobody__x', 'brand-16__m41'], id) - 1 AS INT) AS place FROM bag WHERE id IN ('brand-9__m34', 'brand-2__m2', 'brand-16__m41')")
def s22(spark, d):
    return IO.lookup(B.bags(spark, d), ASKED).select("id", "place")


@query("s23_dedupe_feed", (), """
WITH i AS (SELECT 'shelf' || CAST(l_suppkey % 9 AS STRING) AS shelf, CAST(l_partkey AS STRING) AS sku FROM lineitem), n AS (SELECT shelf, count(*) AS n FROM i GROUP BY 1),
r AS (SELECT DISTINCT i.sku, i.shelf, row_number() OVER (PARTITION BY sku ORDER BY n DESC, i.shelf) AS rn FROM i JOIN n ON i.shelf = n.shelf) SELECT sku, shelf FROM r WHERE rn = 1""")
def s23(spark, d):
    items = B.table(spark, d, "lineitem").selectExpr("'shelf' || CAST(l_suppkey % 9 AS STRING) AS shelf", "CAST(l_partkey AS STRING) AS sku", "l_orderkey AS ord")
    return IO.dedupe_feed(items).select("sku", "shelf")


@query("s24_frontier", (), "SELECT 'u' || CAST(p_partkey AS STRING) AS url FROM part WHERE p_partkey % 3 <> 0")
def s24(spark, d):
    c = B.table(spark, d, "part").selectExpr("'u' || CAST(p_partkey AS STRING) AS url", "p_partkey AS ord")
    return IO.frontier(c, c.where("ord % 3 = 0")).select("url")


# --- images -----------------------------------------------------------------

def _corners(spark, d):
    c = "array(v, v, v, CAST({} AS DOUBLE))"
    df = B.table(spark, d, "part").selectExpr("p_partkey AS k", "'https://img.example.com/' || CAST(p_partkey AS STRING) || '.jpg' AS url",
                                              "CAST(CASE p_partkey % 6 WHEN 3 THEN 254 WHEN 4 THEN 120 ELSE 210 + p_partkey % 40 END AS DOUBLE) AS v")
    alpha = F.when(F.col("k") % 6 == 1, 100.0).otherwise(255.0)
    one = F.array("v", "v", "v", alpha)
    odd = F.array(F.col("v") - F.when(F.col("k") % 6 == 2, 9.0).otherwise(0.0), "v", "v", alpha)
    return df.select("k", "url", F.when(F.col("k") % 6 == 0, 12).otherwise(96).alias("width"), F.lit(96).alias("height"), F.array(odd, one, one, one).alias("corners"),
                     F.when(F.col("k") % 30 == 5, "OSError").alias("problem"))


WHY = """CASE WHEN p_partkey % 30 = 5 THEN 'undecodable:OSError' WHEN p_partkey % 6 = 0 THEN 'too-small' WHEN p_partkey % 6 = 1 THEN 'transparent' WHEN p_partkey % 6 = 2 THEN 'corners-disagree'
 WHEN p_partkey % 6 = 3 THEN 'already-white' WHEN p_partkey % 6 = 4 THEN 'too-dark' ELSE 'ok' END"""
HEX = "lower(printf('#%02x%02x%02x', 210 + p_partkey % 40, 210 + p_partkey % 40, 210 + p_partkey % 40))"


@query("g01_plate_colour", (), f"""
SELECT 'https://img.example.com/' || CAST(p_partkey AS STRING) || '.jpg' AS url, {WHY} AS why, CASE WHEN {WHY} = 'ok' THEN {HEX} END AS plate FROM part""")
def g01(spark, d):
    return G.plate_colour(_corners(spark, d))


@query("g02_apply_plates", "bag", f"""
SELECT b.id, CASE WHEN {WHY} = 'ok' THEN {HEX} END AS image_bg FROM bag b JOIN part ON b.pk = p_partkey""")
def g02(spark, d):
    v = B.view(spark, d, "variant")
    return G.apply_plates(B.bags(spark, d), v, G.plate_colour(_corners(spark, d)))[0].select("id", "image_bg")


@query("g02_plate_census", "bag", f"SELECT {WHY} AS why, count(*) AS n FROM part GROUP BY 1")
def g02b(spark, d):
    return G.apply_plates(B.bags(spark, d), B.view(spark, d, "variant"), G.plate_colour(_corners(spark, d)))[2]


# --- streams ----------------------------------------------------------------

def _stream(spark, d, name):
    return T.source(spark, d, B.VIEWS[name][0]).selectExpr(*B.view_columns(name))


CHANGES = """o AS (SELECT *, lag(ts) OVER w AS pts, lag(price) OVER w AS pprice, lag(compare_at) OVER w AS pcmp, lag(available) OVER w AS pav, lag(basis) OVER w AS pbasis FROM observation
  WINDOW w AS (PARTITION BY key ORDER BY ts, ord)),
c AS (SELECT *, pts IS NOT NULL AS seen, coalesce(pbasis <> basis, FALSE) AS rebased FROM o),
log AS (SELECT key, ts, ord, price, rebased, CASE WHEN NOT rebased THEN pprice END AS prev_price FROM c WHERE NOT (seen AND NOT rebased AND price IS NOT DISTINCT FROM pprice
  AND compare_at IS NOT DISTINCT FROM pcmp AND available = pav))"""


@query("t01_stream_changelog", "observation", f"""
WITH {CHANGES} SELECT key, ts, ord, price, rebased, prev_price, CASE WHEN price - prev_price < 0 AND price <> 0 AND prev_price <> 0 THEN 'down'
 WHEN price <> 0 AND prev_price <> 0 THEN 'up' END AS direction FROM log""")
def t01(spark, d):
    return T.stream_changelog(_stream(spark, d, "observation"))[0].select("key", "ts", "ord", "price", "rebased", "prev_price", "direction")


@query("t01_stream_state", "observation", f"""
WITH {CHANGES}, s AS (SELECT *, sum(CASE WHEN rebased THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ts, ord) AS series FROM log),
m AS (SELECT *, max(series) OVER (PARTITION BY key) AS top FROM s)
SELECT key, last(price ORDER BY ts, ord) AS price, coalesce(min(nullif(price, 0)), last(price ORDER BY ts, ord)) AS low, min(ts) AS first_seen, max(ts) AS last_change FROM m WHERE series = top GROUP BY key""")
def t01b(spark, d):
    return T.stream_changelog(_stream(spark, d, "observation"))[1].select("key", "price", "low", "first_seen", "last_change")


CLEAN_DAY = """clean AS (SELECT created_at, trim(name) AS name, brand, nullif(trim(bag_id), '') AS bag_id, user_id FROM raw_click WHERE user_agent NOT LIKE '%crawler%'
 AND trim(name) IN ('product_view', 'buy_click', 'brand_click') AND (placement IS NULL OR placement IN ('product_page', 'offers_table', 'variant_row', 'browse_overlay', 'brand_page')))"""


@query("t02_stream_clicks", "raw_click", f"""
WITH {CLEAN_DAY} SELECT date_trunc('day', created_at)::TIMESTAMP AS start, brand, count(*) FILTER (WHERE name = 'product_view') AS views, count(*) FILTER (WHERE name = 'buy_click') AS clicks FROM clean GROUP BY 1, 2""")
def t02(spark, d):
    out = T.drain_updates(T.stream_clicks(_stream(spark, d, "raw_click")), "clicks", ["start", "brand"])
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("t03_stream_sessions", "raw_click", f"""
WITH {CLEAN_DAY}, x AS (SELECT *, CASE WHEN created_at - lag(created_at) OVER (PARTITION BY user_id, bag_id ORDER BY created_at) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new_ FROM clean WHERE bag_id IS NOT NULL),
s AS (SELECT *, sum(new_) OVER (PARTITION BY user_id, bag_id ORDER BY created_at) AS sid FROM x)
SELECT user_id, bag_id, min(created_at) AS start, count(*) FILTER (WHERE name = 'product_view') AS views, count(*) FILTER (WHERE name = 'buy_click') AS clicks FROM s GROUP BY user_id, bag_id, sid""")
def t03(spark, d):
    from ..operators.funnels import clean_clicks
    clean = clean_clicks(_stream(spark, d, "raw_click")).where(F.col("bag_id").isNotNull())
    end = clean.select("created_at", "user_id", "bag_id", "name")
    # a row far in the future closes the last sessions
    out = T.drain(T.stream_sessions(_with_closer(spark, end), "6 hours", "1 hour"), "sessions")
    return out.where("user_id >= 0").select("user_id", "bag_id", F.col("start").cast("timestamp_ntz").alias("start"), "views", "clicks")


def _with_closer(spark, stream, names=("noise",)):
    path = scratch_path(spark, "closer")
    spark.createDataFrame([("2030-01-01 00:00:00", -1, "x", n) for n in names], "created_at string, user_id bigint, bag_id string, name string").withColumn(
        "created_at", F.col("created_at").cast(stream.schema["created_at"].dataType)).write.parquet(path)
    late = spark.readStream.schema(stream.schema).parquet(path)
    return stream.unionByName(late)


@query("t03_stream_pairs", "raw_click", f"""
WITH {CLEAN_DAY}, v AS (SELECT * FROM clean WHERE name = 'product_view' AND bag_id IS NOT NULL), c AS (SELECT * FROM clean WHERE name = 'buy_click' AND bag_id IS NOT NULL)
SELECT coalesce(v.user_id, c.user_id) AS user_id, coalesce(v.bag_id, c.bag_id) AS bag_id, v.created_at AS view_at, c.created_at AS click_at
FROM v FULL JOIN c ON v.user_id = c.user_id AND v.bag_id = c.bag_id AND v.created_at <= c.created_at AND c.created_at <= v.created_at + INTERVAL 12 HOUR""")
def t03b(spark, d):
    from ..operators.funnels import clean_clicks
    clean = clean_clicks(_stream(spark, d, "raw_click")).select("created_at", "user_id", "bag_id", "name")
    out = T.drain(T.stream_pairs(_with_closer(spark, clean, ("product_view", "buy_click")), "12 hours", "1 hour"), "pairs")
    local = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return out.where("user_id >= 0").select("user_id", "bag_id", local("view_at"), local("click_at"))


@query("t04_stream_mail_events", "mail_event", "SELECT DISTINCT svix_id, type FROM mail_event WHERE svix_id IS NOT NULL AND type IS NOT NULL")
def t04(spark, d):
    return T.drain(T.stream_mail_events(_stream(spark, d, "mail_event").drop("recipient")), "mail").select("svix_id", "type")


@query("t05_stream_dedupe_alerts", (), """
WITH RECURSIVE e AS (SELECT user_id AS subscription_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
r AS (SELECT subscription_id, rn, ts, ts AS last_, TRUE AS ok FROM e WHERE rn = 1 UNION ALL
 SELECT e.subscription_id, e.rn, e.ts, CASE WHEN e.ts - r.last_ >= INTERVAL 24 HOUR THEN e.ts ELSE r.last_ END, e.ts - r.last_ >= INTERVAL 24 HOUR
 FROM r JOIN e ON e.subscription_id = r.subscription_id AND e.rn = r.rn + 1)
SELECT subscription_id, CAST(ts AS TIMESTAMP) AS ts FROM r WHERE ok""")
def t05(spark, d):
    ev = T.source(spark, d, "events").selectExpr("user_id AS subscription_id", "'k' AS alert_key", "CAST(ts AS TIMESTAMP) AS ts")
    return T.drain(T.stream_dedupe_alerts(ev), "alerts").select("subscription_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("t06_stream_daily_cap", "request", """
SELECT ip_hash, id FROM (SELECT ip_hash, id, row_number() OVER (PARTITION BY ip_hash ORDER BY created_at, id) AS rn FROM request) t WHERE rn <= 3""")
def t06(spark, d):
    req = _stream(spark, d, "request").select("id", "created_at", "ip_hash")
    return T.drain(T.stream_daily_cap(req, 3), "cap").select("ip_hash", "id")


@query("t07_late_metrics", (), """
WITH r AS (SELECT ts, FALSE AS back FROM events UNION ALL SELECT ts - INTERVAL 400 DAY, TRUE FROM events WHERE event_id % 50 = 0),
top AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM events)
SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n, (SELECT count(*) FROM r, top WHERE back AND ts < mark) AS dropped FROM r WHERE NOT back GROUP BY 1""")
def t07(spark, d):
    """Daily counts of two batches, and the rows of a third that come long after the watermark has passed them."""
    events = spark.read.parquet(f"{d}/events.parquet").select("ts", "event_id")
    path = scratch_path(spark, "late-events")
    for rows in (events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1"), events.where("event_id % 50 = 0").withColumn("ts", F.expr("ts - INTERVAL 400 DAYS"))):
        rows.select(F.col("ts").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(path)  # a file, hence a batch, each
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    rows, metrics = T.late_metrics(stream, "1 day")
    return rows.select(F.col("day").cast("timestamp_ntz").alias("day"), "n",
                       F.lit(metrics["dropped"]).cast("bigint").alias("dropped"))


@query("t07_stream_suppressions", "mail_event", """
WITH b AS (SELECT *, sha256(lower(trim(recipient))) AS email_sha256 FROM mail_event WHERE type = 'email.complained' OR (type = 'email.bounced' AND lower(coalesce(bounce_type, '')) <> 'transient')),
r AS (SELECT *, row_number() OVER (PARTITION BY email_sha256 ORDER BY received_at, ord) AS rn FROM b)
SELECT email_sha256, CASE type WHEN 'email.complained' THEN 'complaint' ELSE 'bounce' END AS reason, received_at AS created_at FROM r WHERE rn = 1""")
def t07b(spark, d):
    raw = _stream(spark, d, "mail_event").withColumn("recipients", F.array("recipient"))
    return T.stream_suppressions(raw).select("email_sha256", "reason", "created_at")


@query("t08_stream_daily_low", "ledger", "SELECT bag_id, CAST(ts AS DATE) AS day, min(price) AS price FROM ledger WHERE price IS NOT NULL GROUP BY 1, 2")
def t08(spark, d):
    return T.stream_daily_low(_stream(spark, d, "ledger"))


@query("t09_stream_match", ("ledger", "bag", "subscription"), f"""
WITH {DROPS}, live AS (SELECT * FROM subscription WHERE confirmed_at IS NOT NULL),
p AS (SELECT s.id AS subscription_id, s.watch_bag AS k FROM watched w JOIN live s ON s.watch_bag = w.watched_id WHERE (s.watch_brand IS NULL OR s.watch_brand = w.brand_slug) AND (s.max_price IS NULL OR w.price <= s.max_price)
 UNION ALL SELECT s.id, coalesce(d.split_from, d.bag_id) FROM drops d JOIN live s ON s.watch_bag IS NULL AND s.watch_brand = d.brand_slug WHERE s.max_price IS NULL OR d.price <= s.max_price)
SELECT subscription_id, count(DISTINCT k) AS n FROM p GROUP BY 1""")
def t09(spark, d):
    bag = B.view(spark, d, "bag").select(F.col("id").alias("__id"), "brand_slug", "slug", "name", "split_from", "currency")
    led = _stream(spark, d, "ledger").where(F.col("direction").isNotNull() & F.col("price").isNotNull())
    drops = led.join(bag, F.col("bag_id") == F.col("__id")).drop("__id")
    out = T.stream_match(drops, _subs(spark, d))
    return out.groupBy("subscription_id").agg(F.count(F.lit(1)).alias("n"))


# --- composite runs ---------------------------------------------------------

@query("r01_build_catalogue")
def r01(spark, d):
    from .q_models import raws
    from .q_reports import colour_rulings
    raw, money = raws(spark, d)
    out = R.build_catalogue(raw, money, colour_rulings(spark), B.rates(spark))
    return out.bags.groupBy("source").agg(F.count(F.lit(1)).alias("bags"), F.sum("variant_count").alias("skus"), F.countDistinct("slug").alias("slugs"))


@query("r01_rejects", (), """
WITH r AS (SELECT CASE p_partkey % 8 WHEN 2 THEN 'not-a-bag' WHEN 7 THEN 'not-a-bag:product-type' ELSE CASE WHEN p_partkey % 7 = 1 THEN 'unclassified:known-bag' ELSE 'unclassified' END END AS reason
  FROM part WHERE p_partkey % 40 <> 12 AND (p_partkey % 8 IN (2, 7) OR (p_partkey % 8 = 4 AND p_partkey % 5 <> 0 AND p_partkey % 3 <> 0)) UNION ALL
 SELECT CASE p_partkey % 4 WHEN 1 THEN 'not-a-bag:climbing' ELSE 'not-a-bag:breadcrumb' END FROM part WHERE p_partkey % 4 IN (1, 2) UNION ALL
 SELECT CASE p_partkey % 4 WHEN 1 THEN 'not-a-bag:de' ELSE 'unclassified' END FROM part WHERE p_partkey % 4 IN (1, 3))
SELECT reason, count(*) AS n FROM r GROUP BY 1""")
def r01b(spark, d):
    from .q_models import raws
    from .q_reports import colour_rulings
    raw, money = raws(spark, d)
    picked = {k: raw[k] for k in ("shopify", "aggregator", "magento")}
    out = R.N.normalize_all(picked, money, colour_rulings(spark))
    return out.rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("r02_enrich", "bag", """
SELECT count(*) AS bags, count(*) FILTER (WHERE features_source = 'product-page' OR pk % 3 = 2 AND pk % 7 < 5 AND split_from IS NULL) AS scanned FROM bag""")
def r02(spark, d):
    from .q_crawl import _cache
    out, _, _ = R.enrich(B.bags(spark, d).withColumn("gtin", F.lit(None).cast("string")), _cache(spark, d))
    return out.agg(F.count(F.lit(1)).alias("bags"), F.count_if(F.col("features_source") == "product-page").alias("scanned"))


def _run(spark, d):
    """A price run over the variants against a state that knows two thirds of them."""
    bags, v = B.bags(spark, d), B.view(spark, d, "variant")
    state = P.variant_key(v).where("variant_id % 3 < 2").select(
        "key", (F.col("price") + F.when(F.col("variant_id") % 4 == 0, 32.0).otherwise(0.0)).alias("price"), "compare_at", "available", F.lit("USD@default").alias("basis"),
        F.lit("1999-01-01 00:00:00").cast("timestamp_ntz").alias("first_seen"), F.col("price").alias("low"), F.lit("1999-01-01 00:00:00").cast("timestamp_ntz").alias("last_change"))
    return bags, v, R.price_run(bags, v, state, B.view(spark, d, "ledger"), "2001-12-01 00:00:00", "2001-11-26 00:00:00")


@query("r03_price_run", ("bag", "variant"), """
WITH k AS (SELECT v.*, b.currency FROM variant v JOIN bag b ON v.bag_id = b.id), x AS (SELECT *, variant_id % 3 < 2 AS known, currency <> 'USD' AS moved FROM k)
SELECT 'appended' AS metric, count(*) FILTER (WHERE NOT known OR moved OR variant_id % 4 = 0) AS value FROM x UNION ALL
SELECT 'changes', count(*) FILTER (WHERE known AND NOT moved AND variant_id % 4 = 0) FROM x UNION ALL SELECT 'rebased', count(*) FILTER (WHERE known AND moved) FROM x UNION ALL
SELECT 'tracked', count(*) FROM x""")
def r03(spark, d):
    return _run(spark, d)[2].meta


@query("r04_gate_and_publish", ("bag", "variant"), """
SELECT part, blocking, published, CASE WHEN published THEN (SELECT count(*) FROM bag) ELSE 0 END AS bags, (SELECT count(*) FROM variant) AS state_rows
FROM (VALUES ('same', FALSE, TRUE), ('shrunk', TRUE, FALSE)) t(part, blocking, published)""")
def r04(spark, d):
    """A catalogue published over itself, and one that was three times as large before."""
    from .q_reports import NOW, _log, _roster
    _, v, run = _run(spark, d)
    allowed = spark.createDataFrame([], "brand_slug string")
    # a catalogue without faults of its own: the comparison alone decides
    bags = B.bags(spark, d).withColumns({"slug": F.concat_ws("-", "slug", "pk"), "split_from": F.lit(None).cast("string")})
    log = _log(spark, d).withColumns({"fail_streak": F.lit(0), "fetched_at": F.lit(NOW).cast("timestamp_ntz")})
    more = bags.withColumn("id", F.explode(F.array("id", F.concat("id", F.lit("-b")), F.concat("id", F.lit("-c")))))
    out = None
    for part, base in (("same", bags), ("shrunk", more)):
        verdict = R.gate(bags, log, _roster(spark), base, allowed, NOW).verdict
        path = scratch_path(spark, "publish")
        published = R.publish(run, v, verdict, path, "2001-12-01")
        kept = IO.read_catalogue(spark, f"{path}/catalogue", "bags")
        row = verdict.select(F.lit(part).alias("part"), "blocking", F.lit(published).alias("published"),
                             F.lit(kept.count() if kept is not None else 0).cast("bigint").alias("bags"),
                             F.lit(IO.load_state(spark, f"{path}/state").count()).cast("bigint").alias("state_rows"))
        out = row if out is None else out.unionByName(row)
    return out


@query("r05_alert_run", ("ledger", "bag", "subscription"), f"""
WITH {DROPS}, live AS (SELECT * FROM subscription WHERE confirmed_at IS NOT NULL),
p AS (SELECT s.id AS subscription_id, s.email, s.watch_bag, w.* EXCLUDE (watched_id) FROM watched w JOIN live s ON s.watch_bag = w.watched_id WHERE (s.watch_brand IS NULL OR s.watch_brand = w.brand_slug)
  AND (s.max_price IS NULL OR w.price <= s.max_price) UNION ALL SELECT s.id, s.email, s.watch_bag, d.* FROM drops d JOIN live s ON s.watch_bag IS NULL AND s.watch_brand = d.brand_slug WHERE s.max_price IS NULL OR d.price <= s.max_price),
k AS (SELECT *, coalesce(watch_bag, split_from, bag_id) AS alert_key FROM p),
told AS (SELECT DISTINCT s.id, coalesce(s.watch_bag, 'brand-' || CAST(o_custkey % 25 AS STRING) || '__m' || CAST(o_custkey AS STRING)) AS kk FROM orders JOIN subscription s ON s.id = o_custkey
  WHERE o_orderdate > TIMESTAMP '2001-07-31 00:00:00' - INTERVAL 24 HOUR)
SELECT DISTINCT subscription_id, alert_key FROM k WHERE subscription_id % 5 <> 0 AND NOT EXISTS (SELECT 1 FROM told WHERE told.id = k.subscription_id AND told.kk = k.alert_key)""")
def r05(spark, d):
    held = _subs(spark, d).where(F.col("id") % 5 == 0).select(F.sha2(F.lower(F.trim("email")), 256).alias("email_sha256"))
    return R.alert_run(_events(spark, d), _subs(spark, d), B.view(spark, d, "sent"), held, "2001-07-31 00:00:00").select("subscription_id", "alert_key")


@query("r06_browse", ("bag", "airline"), """
SELECT 'facet' AS part, category AS key, count(*) AS n FROM bag WHERE on_sale GROUP BY category UNION ALL SELECT 'total', '', count(*) FROM bag WHERE on_sale AND category = 'sling'""")
def r06(spark, d):
    a = R.browse(B.bags(spark, d), B.view(spark, d, "variant"), B.airlines(spark), "scope=sale&cat=sling&sort=discount")
    facet = a.facets.where(F.col("group") == "categories").select(F.lit("facet").alias("part"), F.col("value").alias("key"), "n")
    return facet.unionByName(a.totals.select(F.lit("total").alias("part"), F.lit("").alias("key"), F.col("total").alias("n")))
