"""Queries over the platform normalisers and model shaping."""
from pyspark.sql import functions as F

from ..functions import fixed as X, scalars as S
from ..operators import models as M, normalize as N
from . import bindings as B
from .registry import query

K = "CAST({} AS STRING)".format
CTX = {"brand_slug": "'brand-' || CAST(p_partkey % 25 AS STRING)", "brand_name": "'Brand ' || CAST(p_partkey % 25 AS STRING)",
       "domain": "'shop.example.com'", "locale": "CASE WHEN p_partkey % 2 = 0 THEN '/en-us/' ELSE '' END",
       "fetched_at": "CAST(NULL AS TIMESTAMP)", "ord": "p_partkey"}


def _raw(spark, d, **cols):
    return B.table(spark, d, "part").selectExpr("p_partkey", "p_size", "p_name", "p_retailprice",
                                                *[f"{e} AS {c}" for c, e in {**CTX, **cols}.items()])


def _arr(c):
    return F.array_join(c, "|").alias(c)


BAG_COLS = ["id", "category", "category_source", "volume_l", "volume_source", "weight_g", "weight_source", "laptop_in",
            "price_min", "price_max", "on_sale", "in_stock", "variant_count"]


def _bags(part):
    return part.bags.select(*BAG_COLS, F.get("dims_cm", F.lit(0)).alias("largest"), "dims_source", _arr("colors"),
                            _arr("materials"), _arr("features"))


def _reasons(part):
    return part.rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


# --- storefront -------------------------------------------------------------

VARS = "sequence(0, CAST(p_partkey % 4 AS INT))"


def _raw_shopify(spark, d):
    df = _raw(
        spark, d, id="p_partkey",
        title=f"""CASE p_partkey % 8 WHEN 0 THEN 'Travel Pack ' || {K('p_size')} || 'L' WHEN 1 THEN p_name || ' Sling' WHEN 2 THEN 'T-Shirt ' || p_name
          WHEN 3 THEN p_name || ' Weekender' WHEN 4 THEN p_name WHEN 5 THEN 'Camera Backpack ' || p_name WHEN 6 THEN p_name || ' Tote' ELSE 'Hiking Shoes' END""",
        handle="'item-' || " + K("p_partkey"), product_type="CASE p_partkey % 8 WHEN 4 THEN 'Things' WHEN 7 THEN 'Footwear' ELSE '' END",
        vendor="'V'", tags="CASE WHEN p_partkey % 8 = 4 AND p_partkey % 3 = 0 THEN array('daypack') ELSE array('gear') END",
        body_html="""'<p>Capacity: 33 L</p><p>Length: 50 cm Width: 30 cm Depth: 20 cm. Weight 1.5 kg</p><p>Cordura body, RFID pocket, 15" laptop</p>'""",
        options="array(named_struct('name', 'Farbe', 'position', 1), named_struct('name', 'Size', 'position', 2))",
        variants=f"""transform({VARS}, i -> named_struct('id', p_partkey * 10 + i, 'title', 'V' || i,
          'option1', element_at(array('Jet Black', 'Forest Green', 'A35-CHOICE_Z10', 'Sand'), i + 1),
          'option2', CASE WHEN p_partkey % 3 = 0 THEN CAST(10 * (i + 1) AS STRING) || 'L' ELSE 'One Size' END, 'option3', CAST(NULL AS STRING),
          'sku', CASE WHEN i = 3 THEN '' ELSE 'S' || CAST(p_partkey * 10 + i AS STRING) END, 'price', CAST(p_retailprice + i * 10 AS STRING),
          'compare_at_price', CASE WHEN (p_partkey + i) % 3 = 0 THEN CAST(p_retailprice + 100 AS STRING) END, 'available', (p_partkey + i) % 2 = 0,
          'grams', CASE WHEN p_partkey % 2 = 0 THEN 400 + 10 * i ELSE 0 END, 'featured_image', named_struct('src', CAST(NULL AS STRING))))""",
        images="array(named_struct('src', 'https://img.example.com/a' || CAST(p_partkey AS STRING), 'width', 10, 'height', 10, 'variant_ids', array(p_partkey * 10)))",
        hint_category="CASE WHEN p_partkey % 8 = 4 AND p_partkey % 5 = 0 THEN 'pouch' END",
        hint_is_bag="CASE WHEN p_partkey % 8 = 4 AND p_partkey % 5 = 0 THEN TRUE WHEN p_partkey % 8 = 4 AND p_partkey % 7 = 1 THEN TRUE END",
        ruling="CASE WHEN p_partkey % 40 = 12 THEN 'wallet' END")
    return df


def _shopify(spark, d):
    return N.normalize_shopify(_raw_shopify(spark, d))


M8 = "p_partkey % 8"
SHOP_CAT = f"""CASE WHEN p_partkey % 40 = 12 THEN 'wallet' WHEN {M8} = 0 THEN 'travel-backpack' WHEN {M8} = 1 THEN 'sling' WHEN {M8} = 3 THEN 'duffel'
  WHEN {M8} = 5 THEN 'camera-bag' WHEN {M8} = 6 THEN 'tote' WHEN {M8} = 4 AND p_partkey % 5 = 0 THEN 'pouch' WHEN {M8} = 4 AND p_partkey % 3 = 0 THEN 'daypack' END"""
SHOP = f"shop AS (SELECT *, p_partkey % 4 AS m, {SHOP_CAT} AS category FROM part)"


@query("n01_shopify_bags", (), f"""
WITH {SHOP} SELECT 'brand-' || {K('p_partkey % 25')} || '__item-' || {K('p_partkey')} AS id, category,
 CASE WHEN p_partkey % 40 = 12 THEN 'override' WHEN {M8} <> 4 THEN 'title' WHEN p_partkey % 5 = 0 THEN 'collection' ELSE 'tag' END AS category_source,
 CASE WHEN {M8} = 0 THEN p_size WHEN p_partkey % 3 = 0 THEN 10 ELSE 33 END::DOUBLE AS volume_l,
 CASE WHEN {M8} = 0 THEN 'title' WHEN p_partkey % 3 = 0 THEN 'variant-option' ELSE 'description' END AS volume_source,
 CAST(CASE WHEN p_partkey % 2 = 0 THEN 400 + 10 * m ELSE 1500 END AS INT) AS weight_g,
 CASE WHEN p_partkey % 2 = 0 THEN 'shopify:grams' ELSE 'description' END AS weight_source, 15.0::DOUBLE AS laptop_in,
 p_retailprice AS price_min, p_retailprice + m * 10 AS price_max,
 (p_partkey % 3 = 0) OR (m >= 1 AND (p_partkey + 1) % 3 = 0) OR (m >= 2 AND (p_partkey + 2) % 3 = 0) AS on_sale,
 (p_partkey % 2 = 0) OR m >= 1 AS in_stock, CAST(m + 1 AS INT) AS variant_count, 50.0::DOUBLE AS largest, 'description:labelled' AS dims_source,
 CASE m WHEN 0 THEN 'Jet Black' WHEN 1 THEN 'Jet Black|Forest Green' WHEN 2 THEN 'Jet Black|Forest Green' ELSE 'Jet Black|Forest Green|Sand' END AS colors,
 'CORDURA' AS materials, 'rfid' AS features FROM shop WHERE category IS NOT NULL""")
def n01(spark, d):
    return _bags(_shopify(spark, d))


@query("n01_shopify_variants", (), f"""
WITH {SHOP} SELECT 'brand-' || {K('p_partkey % 25')} || '__item-' || {K('p_partkey')} AS bag_id, CAST(i AS INT) AS pos,
 CASE WHEN i = 3 THEN NULL ELSE 'S' || CAST(p_partkey * 10 + i AS STRING) END AS sku,
 CASE i WHEN 0 THEN 'Jet Black' WHEN 1 THEN 'Forest Green' WHEN 3 THEN 'Sand' END AS color,
 CASE WHEN p_partkey % 3 = 0 THEN CAST(10 * (i + 1) AS STRING) || 'L' ELSE 'One Size' END AS size, p_retailprice + i * 10 AS price,
 CASE WHEN (p_partkey + i) % 3 = 0 THEN p_retailprice + 100 END AS compare_at, (p_partkey + i) % 2 = 0 AS available,
 CASE i WHEN 0 THEN 'https://img.example.com/a' || CAST(p_partkey AS STRING) END AS image
FROM shop, (VALUES (0), (1), (2), (3)) v(i) WHERE category IS NOT NULL AND i <= m""")
def n01b(spark, d):
    return _shopify(spark, d).variants.select("bag_id", F.col("pos").cast("int").alias("pos"), "sku", "color", "size", "price",
                                              "compare_at", "available", "image")


@query("n01_shopify_rejects", (), f"""
WITH {SHOP} SELECT CASE WHEN {M8} = 2 THEN 'not-a-bag' WHEN {M8} = 7 THEN 'not-a-bag:product-type' WHEN p_partkey % 7 = 1 THEN 'unclassified:known-bag'
 ELSE 'unclassified' END AS reason, count(*) AS n FROM shop WHERE category IS NULL GROUP BY 1""")
def n01c(spark, d):
    return _reasons(_shopify(spark, d))


# --- SKU feed ---------------------------------------------------------------

def _raw_feed(spark, d):
    df = _raw(spark, d, name="CASE p_partkey % 5 WHEN 4 THEN 'Phone Thing' ELSE p_name || ' Pack' END", sku="'S' || " + K("p_partkey"), barcode=K("p_partkey"),
              canonical_uri="'/p/' || replace(p_name, ' ', '-') || '?x=1'", price_in_cents="CAST(p_partkey * 7 + 100 AS BIGINT)", currency_code="'usd'",
              dimensions=f"""map('size', array(CASE WHEN p_partkey % 2 = 0 THEN '16in' ELSE '13in' END), 'color', array(CASE WHEN p_partkey % 3 = 0 THEN 'jet_black' ELSE 'sand' END),
                'filter_sub_category', array(CASE p_partkey % 5 WHEN 4 THEN 'phone_case' ELSE 'backpack' END), 'product_type', array('Bag'), 'material', array('recycled_nylon'),
                'filter_feature', array(CASE WHEN p_partkey % 4 = 0 THEN 'trolley_sleeve' ELSE 'rfid' END), 'capacity_litres', array('21'), 'net_weight_g', array('850'),
                'product_dim_h_cm', array('45'), 'product_dim_l_cm', array('30'), 'product_dim_d_cm', array('15'), 'filter_device_storage', array('laptop_13_inch', 'laptop_16_inch'))""")
    return df


def _feed(spark, d):
    return N.normalize_sku_feed(_raw_feed(spark, d))


FEED = f"""f AS (SELECT p_partkey, 'brand-' || {K('p_partkey % 25')} AS b, p_name || ' Pack' AS name, CASE WHEN p_partkey % 2 = 0 THEN '16IN' ELSE '13IN' END AS sz,
  (p_partkey * 7 + 100) / 100 AS price, p_partkey % 3 = 0 AS black, p_partkey % 4 = 0 AS trolley FROM part WHERE p_partkey % 5 <> 4)"""


@query("n02_sku_feed_bags", (), f"""
WITH {FEED} SELECT b || '__' || replace(name, ' ', '-') AS id_stem, CASE sz WHEN '16IN' THEN '16"' ELSE '13"' END AS size, count(*) AS skus, min(price) AS price_min,
 max(price) AS price_max, CAST(count(*) AS INT) AS variant_count, CASE WHEN bool_or(trolley) AND bool_or(NOT trolley) THEN 'luggage_passthrough|rfid' WHEN bool_or(trolley)
 THEN 'luggage_passthrough' ELSE 'rfid' END AS features, 45.0::DOUBLE AS largest, 16.0::DOUBLE AS laptop_in, CAST(850 AS INT) AS weight_g FROM f GROUP BY 1, 2""".replace("' AS id_stem", "' AS id_stem").replace("replace(name, ' ', '-')", "lower(replace(name, ' ', '-'))"))
def n02(spark, d):
    bags = _feed(spark, d).bags
    return bags.select(F.regexp_replace("id", r"-1[36]$", "").alias("id_stem"), F.get("sizes", F.lit(0)).alias("size"),
                       F.col("variant_count").cast("bigint").alias("skus"), "price_min", "price_max", "variant_count", _arr("features"),
                       F.get("dims_cm", F.lit(0)).alias("largest"), "laptop_in", "weight_g")


@query("n02_sku_feed_variants", (), f"""
WITH {FEED} SELECT 'S' || {K('p_partkey')} AS sku, CASE WHEN black THEN 'Jet Black' ELSE 'Sand' END AS color,
 CASE WHEN black THEN 'Jet Black' ELSE 'Sand' END || ' / Recycled Nylon' AS title, price FROM f""")
def n02b(spark, d):
    return _feed(spark, d).variants.select("sku", "color", "title", "price")


# --- aggregator -------------------------------------------------------------

def _raw_aggregator(spark, d):
    df = _raw(spark, d, url=f"'https://agg.example.com/x/item-' || {K('p_partkey')} || '.html'",
              breadcrumbs="CASE p_partkey % 4 WHEN 1 THEN array('Ravel', 'Climb', 'Ravel Climb') WHEN 2 THEN array('Clothing', 'Jackets') ELSE array('Packs') END",
              product=f"""'{{"@type":"Product","name":"' || p_name || CASE p_partkey % 4 WHEN 2 THEN '' ELSE ' Sling' END || '","brand":{{"name":"Ravel"}},"description":"Holds ' ||
                CASE p_partkey % 4 WHEN 3 THEN '1,710 cu in' ELSE {K('p_size')} || ' liters' END || '. 22in x 13in x 9in. 2 lbs","image":["https://i.example.com/1"],"offers":{{"price":"' ||
                {K('p_partkey + 5')} || '","sku":"A","availability":"http://schema.org/InStock"}}}}'""").drop("brand_name", "brand_slug")
    return df


def _aggregator(spark, d):
    return N.normalize_aggregator(_raw_aggregator(spark, d))


@query("n03_aggregator_bags", (), f"""
SELECT 'aggregator__item-' || {K('p_partkey')} AS id, 'ravel' AS brand_slug, 'sling' AS category, CASE WHEN p_partkey % 4 = 3 THEN 28.0 ELSE p_size END::DOUBLE AS volume_l,
 CASE WHEN p_partkey % 4 = 3 THEN 'aggregator:cubic-inches' ELSE 'aggregator:description' END AS volume_source, CAST(907 AS INT) AS weight_g,
 'aggregator:description:in' AS dims_source, (p_partkey + 5)::DOUBLE AS price_min, 'https://i.example.com/1' AS image FROM part WHERE p_partkey % 4 IN (0, 3)""")
def n03(spark, d):
    return _aggregator(spark, d).bags.select("id", "brand_slug", "category", "volume_l", "volume_source", "weight_g", "dims_source", "price_min", "image")


@query("n03_aggregator_rejects", (), """
SELECT CASE p_partkey % 4 WHEN 1 THEN 'not-a-bag:climbing' ELSE 'not-a-bag:breadcrumb' END AS reason, count(*) AS n FROM part WHERE p_partkey % 4 IN (1, 2) GROUP BY 1""")
def n03b(spark, d):
    return _reasons(_aggregator(spark, d))


# --- WooCommerce ------------------------------------------------------------

def _raw_woo(spark, d):
    df = _raw(spark, d, name="'<b>' || p_name || '</b> ' || CASE p_partkey % 3 WHEN 0 THEN 'Rucksack' WHEN 1 THEN 'Thing' ELSE 'Gift Card' END", slug="'w-' || " + K("p_partkey"),
              permalink="CAST(NULL AS STRING)", sku="'W' || " + K("p_partkey"), description=f"'<p>Weight: 900 g. ' || {K('p_size')} || ' litres</p>'", short_description="''",
              categories="array(named_struct('name', CASE p_partkey % 2 WHEN 0 THEN 'Pouches' ELSE 'Misc' END))", tags="array(named_struct('name', 'new'))",
              on_sale="p_partkey % 2 = 0", is_in_stock="p_partkey % 5 <> 0",
              attributes="array(named_struct('name', 'Colour', 'terms', array(named_struct('name', 'Sand'))), named_struct('name', 'Size', 'terms', array(named_struct('name', 'M'), named_struct('name', 'L'))))",
              prices=f"named_struct('price', {K('p_partkey + 1000')}, 'regular_price', {K('p_partkey + 1100')}, 'currency_code', 'EUR', 'currency_minor_unit', 2)",
              images="array(named_struct('src', 'https://i.example.com/w'))")
    return df


def _woo(spark, d):
    return N.normalize_woo(_raw_woo(spark, d))


@query("n04_woo_bags", (), f"""
SELECT 'brand-' || {K('p_partkey % 25')} || '__w-' || {K('p_partkey')} AS id, p_name || CASE p_partkey % 3 WHEN 0 THEN ' Rucksack' ELSE ' Thing' END AS name,
 CASE p_partkey % 3 WHEN 0 THEN 'daypack' ELSE 'pouch' END AS category, CASE p_partkey % 3 WHEN 0 THEN 'title' ELSE 'tag' END AS category_source, p_size::DOUBLE AS volume_l,
 'description:labelled' AS weight_source, CAST(900 AS INT) AS weight_g, (p_partkey + 1000) / 100 AS price_min, p_partkey % 5 <> 0 AS in_stock, 'https://shop.example.com/product/w-' || {K('p_partkey')} AS url
FROM part WHERE p_partkey % 3 = 0 OR (p_partkey % 3 = 1 AND p_partkey % 2 = 0)""")
def n04(spark, d):
    return _woo(spark, d).bags.select("id", F.regexp_replace("name", " +", " ").alias("name"), "category", "category_source", "volume_l", "weight_source", "weight_g", "price_min", "in_stock", "url")


@query("n04_woo_variants", (), f"""
SELECT 'W' || {K('p_partkey')} AS sku, 'Sand' AS color, CAST(NULL AS STRING) AS size, (p_partkey + 1000) / 100 AS price, (p_partkey + 1100) / 100 AS compare_at
FROM part WHERE p_partkey % 3 = 0 OR (p_partkey % 3 = 1 AND p_partkey % 2 = 0)""")
def n04b(spark, d):
    return _woo(spark, d).variants.select("sku", "color", "size", "price", "compare_at")


# --- Magento ----------------------------------------------------------------

def _raw_magento(spark, d):
    item = lambda c, v: f"named_struct('code', '{c}', 'value', {v}, 'selected_options', CAST(NULL AS array<struct<label:string>>))"
    df = _raw(spark, d, name="p_name || CASE p_partkey % 4 WHEN 0 THEN ' Rucksack' WHEN 1 THEN ' Regenhülle' ELSE ' Aqua' END", sku="'M' || " + K("p_partkey"),
              url_key="'m-' || " + K("p_partkey"), url_suffix="'.html'", stock_status="'OUT_OF_STOCK'", weight="CAST(0.88 AS DOUBLE)",
              description_html="'<p>Weight: 2 kg</p>'", short_description_html="''",
              categories="array(named_struct('name', CASE p_partkey % 4 WHEN 2 THEN 'Fahrradtaschen Lenkertasche' ELSE 'Alles' END))",
              attribute_items=f"""array({item('height', "'50'")}, {item('width', "CASE WHEN p_partkey % 3 = 0 THEN '30' ELSE '0' END")},
                {item('dimensions_text', "'52 / 23 / 18 (L x W x D) cm'")}, {item('volume_x', K('p_size'))},
                {item('gewicht_text', "CASE WHEN p_partkey % 2 = 0 THEN '865g / 1lb 14.5oz' ELSE '880' END")},
                named_struct('code', 'material', 'value', CAST(NULL AS STRING), 'selected_options', array(named_struct('label', 'Cordura'), named_struct('label', 'Nylon'))))""",
              configurable_options="array(named_struct('label', 'Farbe', 'attribute_code', 'col'), named_struct('label', 'Size', 'attribute_code', 'sz'))",
              variants="""transform(sequence(0, 1), i -> named_struct('sku', 'M' || CAST(p_partkey * 10 + i AS STRING), 'name', 'child', 'weight', CAST(1.184 AS DOUBLE), 'stock_status',
                CASE WHEN i = 1 THEN 'IN_STOCK' ELSE 'OUT' END, 'final_price', p_retailprice + i, 'regular_price', p_retailprice + 5 * i, 'image', 'https://i.example.com/m',
                'attributes', array(named_struct('code', 'col', 'label', CASE WHEN i = 1 THEN 'Sand' ELSE 'Navy' END), named_struct('code', 'sz', 'label', 'L'))))""",
              final_price="p_retailprice", regular_price="p_retailprice", top_price="p_retailprice", image_url="'https://i.example.com/m'")
    return df


def _magento(spark, d):
    return N.normalize_magento(_raw_magento(spark, d))


@query("n05_magento_bags", (), f"""
SELECT 'brand-' || {K('p_partkey % 25')} || '__m-' || {K('p_partkey')} AS id, CASE p_partkey % 4 WHEN 0 THEN 'daypack' ELSE 'bike-bag' END AS category,
 CASE p_partkey % 4 WHEN 0 THEN 'title' ELSE 'magento-shelf' END AS category_source, p_size::DOUBLE AS volume_l, 'magento:volume_x' AS volume_source,
 CASE WHEN p_partkey % 3 = 0 THEN 50.0 ELSE 52.0 END::DOUBLE AS largest, CASE WHEN p_partkey % 3 = 0 THEN 'magento:attributes' ELSE 'magento:dimensions_text' END AS dims_source,
 CAST(CASE WHEN p_partkey % 2 = 0 THEN 865 ELSE 1184 END AS INT) AS weight_g, CASE WHEN p_partkey % 2 = 0 THEN 'magento:gewicht_text' ELSE 'magento:weight' END AS weight_source,
 p_retailprice AS price_min, p_retailprice + 1 AS price_max, TRUE AS on_sale, 'CORDURA|Nylon' AS materials, 'Navy|Sand' AS colors FROM part WHERE p_partkey % 4 IN (0, 2)""")
def n05(spark, d):
    b = _magento(spark, d).bags
    return b.select("id", "category", "category_source", "volume_l", "volume_source", F.get("dims_cm", F.lit(0)).alias("largest"), "dims_source", "weight_g", "weight_source",
                    "price_min", "price_max", "on_sale", _arr("materials"), _arr("colors"))


@query("n05_magento_rejects", (), """
SELECT CASE p_partkey % 4 WHEN 1 THEN 'not-a-bag:de' ELSE 'unclassified' END AS reason, count(*) AS n FROM part WHERE p_partkey % 4 IN (1, 3) GROUP BY 1""")
def n05b(spark, d):
    return _reasons(_magento(spark, d))


# --- page digests -----------------------------------------------------------

def _raw_pages(spark, d):
    a, w = "(20 + p_partkey % 45)", "(5 + p_partkey % 20)"
    node = f"""'{{"@type":"ProductGroup","name":"' || p_name || ' Duffel","description":"A duffel. Volume: ' || {K('p_size')} || ' L","hasVariant":[{{"sku":"V1","color":"navy-blue","offers":{{"price":"' ||
      {K('p_partkey + 20')} || '","availability":"InStock"}}}},{{"sku":"V2","color":["sand"],"offers":{{"price":5000}}}}]}}'"""
    df = _raw(spark, d, url=f"'https://shop.example.com/p/item-' || {K('p_partkey')} || '.html'", title="'Shop | Home'", h1="CASE WHEN p_partkey % 3 = 1 THEN p_name || ' Tote' END",
              meta="map('og:title', p_name || ' Backpack | Shop', 'og:image', '/img/x.jpg')", jsonld=f"CASE WHEN p_partkey % 3 = 0 THEN array({node}) ELSE array() END",
              pairs=f"CASE WHEN p_partkey % 2 = 0 THEN array(array('Dimensions', '{{}}')) ELSE array() END".replace("'{}'", f"{K(a)} || ' x ' || {K(w)} || ' x 8 cm'"),
              tables=f"array(array(array('Height', 'Width', 'Weight'), array({K(a)} || ' cm', {K(w)}, '700 g')))",
              values="array(array('price sales', '99.50'), array('price strike', '120'))", images="array('/nav/logo.svg', '/media/product/1.jpg')", text="'Capacity 12 L of things'")
    return df


def _pages(spark, d):
    return N.normalize_pages(_raw_pages(spark, d))


@query("n06_page_bags", (), f"""
SELECT 'brand-' || {K('p_partkey % 25')} || '__item-' || {K('p_partkey')} AS id, CASE p_partkey % 3 WHEN 0 THEN 'duffel' WHEN 1 THEN 'tote' ELSE 'daypack' END AS category,
 greatest(20 + p_partkey % 45, 5 + p_partkey % 20)::DOUBLE AS largest, CASE WHEN p_partkey % 2 = 0 THEN 'pages:pairs:cm' ELSE 'pages:table' END AS dims_source,
 12.0::DOUBLE AS volume_l, 'pages:label' AS volume_source, CAST(700 AS INT) AS weight_g, CASE WHEN p_partkey % 3 = 0 THEN least(99.5, p_partkey + 20) ELSE 99.5 END::DOUBLE AS price_min,
 CASE WHEN p_partkey % 3 = 0 THEN greatest(5000, p_partkey + 20) ELSE 99.5 END::DOUBLE AS price_max, TRUE AS on_sale, CAST(CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS INT) AS variant_count,
 CASE WHEN p_partkey % 3 = 0 THEN 'Navy Blue|Sand' ELSE '' END AS colors, 'https://shop.example.com/img/x.jpg' AS image FROM part""")
def n06(spark, d):
    return _pages(spark, d).bags.select("id", "category", F.get("dims_cm", F.lit(0)).alias("largest"), "dims_source", "volume_l", "volume_source", "weight_g", "price_min", "price_max",
                                        "on_sale", "variant_count", _arr("colors"), "image")


RAWS = {"shopify": _raw_shopify, "sku_feed": _raw_feed, "aggregator": _raw_aggregator, "woocommerce": _raw_woo, "magento": _raw_magento,
        "pages": lambda spark, d: _raw_pages(spark, d).withColumn("brand_slug", F.concat(F.lit("site-"), "brand_slug"))}


def raws(spark, d):
    """Payloads of all six platforms, and what their brands price in."""
    money = B.table(spark, d, "nation").selectExpr(
        "'brand-' || CAST(n_nationkey AS STRING) AS slug", "CASE WHEN n_nationkey % 2 = 0 THEN 'EUR' ELSE 'GBP' END AS currency",
        "CASE WHEN n_nationkey % 2 = 0 THEN 'feed' ELSE 'locale' END AS currency_source")
    return {k: fn(spark, d) for k, fn in RAWS.items()}, money


@query("n07_normalize_all", (), f"""
WITH {SHOP}, {FEED}, g AS (SELECT b, name, sz, count(*) AS skus FROM f GROUP BY ALL),
x AS (SELECT 'shopify:products.json' AS source, 'brand-' || CAST(p_partkey % 25 AS STRING) AS b, m + 1 AS skus FROM shop WHERE category IS NOT NULL UNION ALL
 SELECT 'sku-feed:products', b, skus FROM g UNION ALL SELECT 'aggregator:jsonld', 'ravel', 1 FROM part WHERE p_partkey % 4 IN (0, 3) UNION ALL
 SELECT 'woocommerce:store-api', 'brand-' || CAST(p_partkey % 25 AS STRING), 1 FROM part WHERE p_partkey % 3 = 0 OR (p_partkey % 3 = 1 AND p_partkey % 2 = 0) UNION ALL
 SELECT 'magento:graphql', 'brand-' || CAST(p_partkey % 25 AS STRING), 2 FROM part WHERE p_partkey % 4 IN (0, 2) UNION ALL
 SELECT 'pages:crawl', 'site-brand-' || CAST(p_partkey % 25 AS STRING), CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END FROM part)
SELECT source, CASE WHEN b LIKE 'brand-%' THEN CASE WHEN CAST(substr(b, 7) AS INT) % 2 = 0 THEN 'EUR' ELSE 'GBP' END ELSE 'USD' END AS currency,
 count(*) AS n, CAST(sum(skus) AS BIGINT) AS skus FROM x GROUP BY 1, 2""")
def n07(spark, d):
    from .q_reports import colour_rulings
    raw, money = raws(spark, d)
    part = N.normalize_all(raw, money, colour_rulings(spark))
    n = part.variants.groupBy("bag_id").agg(F.count(F.lit(1)).alias("v"))
    return part.bags.join(n, F.col("id") == F.col("bag_id")).groupBy("source", "currency").agg(
        F.count(F.lit(1)).alias("n"), F.sum("v").alias("skus"))


# --- models -----------------------------------------------------------------

@query("m01_drop_removed", (), """
SELECT 'kept' AS part, count(*) AS n FROM part WHERE (p_partkey % 25) % 7 <> 3 UNION ALL SELECT 'dropped', count(*) FROM part WHERE (p_partkey % 25) % 7 = 3""")
def m01(spark, d):
    products = _raw(spark, d).select("brand_slug", "ord")
    roster = B.table(spark, d, "nation").selectExpr("'brand-' || CAST(n_nationkey AS STRING) AS slug", "CASE WHEN n_nationkey % 7 = 3 THEN 'removed' END AS platform")
    kept, dropped = M.drop_removed(products, roster)
    return kept.agg(F.count(F.lit(1)).alias("n")).select(F.lit("kept").alias("part"), "n").unionByName(
        dropped.agg(F.sum("dropped").alias("n")).select(F.lit("dropped").alias("part"), "n"))


@query("m02_drop_shadowed", "bag", "SELECT id FROM bag WHERE NOT (source LIKE 'aggregator:%' AND pk % 8 = 6)")
def m02(spark, d):
    mixed = F.when(F.col("pk") % 8 == 2, F.concat(F.lit("Solo "), (F.col("pk") % 40).cast("string"))).otherwise(
        F.concat(F.lit("Mix "), (F.col("pk") % 5).cast("string")))
    return M.drop_shadowed(B.bags(spark, d).withColumn("brand", mixed))[0].select("id")


@query("m03_model_key", (), """
SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 2 THEN 'travel pack 3 in x-pac black' ELSE p_name END AS key,
 CASE p_partkey % 4 WHEN 2 THEN 'Travel Pack 3 in X-Pac Black' ELSE p_name END AS name, CASE p_partkey % 4 WHEN 0 THEN 'Black' WHEN 1 THEN 'Wasatch Green' END AS colour FROM part""")
def m03(spark, d):
    df = B.table(spark, d, "part").selectExpr("p_partkey AS k", "CASE p_partkey % 4 WHEN 0 THEN p_name || ' - Black' WHEN 1 THEN p_name || ' in Wasatch Green' "
                                              "WHEN 2 THEN 'Travel Pack 3 in X-Pac Black' ELSE p_name END AS t")
    return df.withColumn("s", M.strip_colour(F.col("t"))).select("k", M.model_key(F.col("t")).alias("key"), "s.name", "s.colour")


def _listings(spark, d):
    """Listings of one model in several colours, under few brands."""
    b = B.bags(spark, d)
    slug = F.concat(F.lit("maker-"), (F.col("pk") % 5).cast("string"))
    base = F.regexp_replace("name", " [0-9]+$", "")
    name = F.when(F.col("pk") % 4 == 0, F.concat(base, F.lit(" - Black"))).when(
        F.col("pk") % 4 == 1, F.concat(base, F.lit(" in Forest Green"))).otherwise(base)
    return b.withColumn("brand_slug", slug).withColumn("name", name).select(
        "id", "brand_slug", "name", "volume_l", "volume_source", "dims_cm", "dims_source", "weight_g", "weight_source", "laptop_in", "image", "materials", "features",
        "color_families", "colors", "sizes", "tags", "in_stock", "on_sale", "price_min", "price_max", "url", "variant_count", "ord",
        F.lit(None).cast("double").alias("linear_cm"), F.lit(None).cast("int").alias("merged_from"))


LIST = """li AS (SELECT *, 'maker-' || CAST(pk % 5 AS STRING) AS maker, regexp_replace(name, ' [0-9]+$', '') AS stem,
  (CASE WHEN volume_l IS NULL THEN 0 ELSE 1 END + CASE WHEN dims_cm IS NULL THEN 0 ELSE 1 END + CASE WHEN weight_g IS NULL THEN 0 ELSE 1 END + CASE WHEN laptop_in IS NULL THEN 0 ELSE 1 END) AS score FROM bag),
r AS (SELECT *, row_number() OVER (PARTITION BY maker, stem ORDER BY score DESC, ord) AS rn, first(id) OVER (PARTITION BY maker, stem ORDER BY score DESC, ord) AS model FROM li)"""


@query("m04_merge_models", ("bag", "variant"), f"""
WITH {LIST}, v AS (SELECT r.model, count(*) AS n, min(price) AS lo, max(price) AS hi FROM variant v JOIN r ON v.bag_id = r.id GROUP BY 1)
SELECT r.model AS id, maker AS brand_slug, stem AS name, CAST(count(*) AS INT) AS merged_from,
 coalesce(max(volume_l) FILTER (WHERE rn = 1), first(volume_l ORDER BY ord) FILTER (WHERE volume_l IS NOT NULL)) AS volume_l,
 CASE WHEN max(volume_l) FILTER (WHERE rn = 1) IS NOT NULL THEN max(volume_source) FILTER (WHERE rn = 1) ELSE first(volume_source ORDER BY ord) FILTER (WHERE volume_l IS NOT NULL) END AS volume_source,
 coalesce(max(weight_g) FILTER (WHERE rn = 1), first(weight_g ORDER BY ord) FILTER (WHERE weight_g IS NOT NULL)) AS weight_g,
 bool_or(in_stock) AS in_stock, bool_or(on_sale) AS on_sale, max(v.lo) AS price_min, max(v.hi) AS price_max, CAST(max(v.n) AS INT) AS variant_count,
 array_to_string(list_sort(list_distinct(flatten(list(materials)))), ',') AS materials FROM r LEFT JOIN v ON r.model = v.model GROUP BY 1, 2, 3""")
def m04(spark, d):
    out = M.merge_models(_listings(spark, d), B.view(spark, d, "variant")).bags
    return out.select("id", "brand_slug", "name", "merged_from", "volume_l", "volume_source", "weight_g", "in_stock", "on_sale", "price_min", "price_max", "variant_count",
                      F.array_join("materials", ",").alias("materials"))


@query("m04_model_values", ("bag", "variant"), f"""
WITH {LIST} SELECT model AS id, 'colors' AS kind, c AS value FROM (SELECT model, unnest(colors) AS c FROM r UNION SELECT model, 'Black' FROM r WHERE pk % 4 = 0 UNION
 SELECT model, 'Forest Green' FROM r WHERE pk % 4 = 1) t UNION SELECT model, 'tags', unnest(tags) FROM r UNION SELECT model, 'urls', url FROM r""")
def m04b(spark, d):
    return M.merge_models(_listings(spark, d), B.view(spark, d, "variant")).values.select("id", "kind", "value")


@query("m04_merged_variants", ("bag", "variant"), f"""
WITH {LIST} SELECT r.model AS bag_id, v.variant_id, v.price, row_number() OVER (PARTITION BY r.model ORDER BY r.ord, v.pos) - 1 AS pos FROM variant v JOIN r ON v.bag_id = r.id""")
def m04c(spark, d):
    return M.merge_models(_listings(spark, d), B.view(spark, d, "variant")).variants.select(
        "bag_id", "variant_id", "price", F.col("pos").cast("bigint").alias("pos"))


SPLIT = """s AS (SELECT bag_id, TRY_CAST(regexp_extract(size, '^([0-9]+)L$', 1) AS DOUBLE) AS vol, count(*) AS n, min(nullif(price, 0)) AS lo, max(nullif(price, 0)) AS hi,
  bool_or(available) AS stock, max(nullif(grams, 0)) AS g FROM variant GROUP BY 1, 2),
line AS (SELECT bag_id, min(vol) AS least FROM s GROUP BY 1 HAVING bool_and(vol IS NOT NULL) AND count(vol) >= 2)"""


@query("m05_split_sizes", ("bag", "variant"), f"""
WITH {SPLIT} SELECT b.id || '-' || CAST(CAST(s.vol AS INT) AS STRING) || 'l' AS id, b.name || ' ' || CAST(CAST(s.vol AS INT) AS STRING) || 'L' AS name, b.id AS split_from, s.vol AS volume_l,
 CAST(s.n AS INT) AS variant_count, s.lo AS price_min, s.hi AS price_max, s.stock AS in_stock, CAST(s.g AS INT) AS weight_g,
 CASE WHEN s.vol = CASE WHEN EXISTS (SELECT 1 FROM s x WHERE x.bag_id = b.id AND x.vol = b.volume_l) THEN b.volume_l ELSE l.least END THEN replace(lower(b.name), ' ', '-') END AS legacy_slug,
 CAST(NULL AS STRING) AS dims_source FROM bag b JOIN line l ON b.id = l.bag_id JOIN s ON s.bag_id = b.id UNION ALL
SELECT id, name, split_from, volume_l, variant_count, price_min, price_max, in_stock, weight_g, legacy_slug, dims_source FROM bag WHERE id NOT IN (SELECT bag_id FROM line)""")
def m05(spark, d):
    bags, _ = M.split_sizes(B.bags(spark, d), B.view(spark, d, "variant"))
    return bags.select("id", "name", "split_from", "volume_l", "variant_count", "price_min", "price_max", "in_stock", "weight_g", "legacy_slug", "dims_source")


@query("m05_split_variants", ("bag", "variant"), f"""
WITH {SPLIT} SELECT CASE WHEN l.bag_id IS NOT NULL THEN v.bag_id || '-' || lower(v.size) ELSE v.bag_id END AS bag_id, count(*) AS n FROM variant v LEFT JOIN line l ON v.bag_id = l.bag_id GROUP BY 1""")
def m05b(spark, d):
    _, v = M.split_sizes(B.bags(spark, d), B.view(spark, d, "variant"))
    return v.groupBy("bag_id").agg(F.count(F.lit(1)).alias("n"))


@query("m06_uniq_id", (), """
WITH c AS (SELECT p_partkey AS ord, 'c' || CAST(p_partkey % 40 AS STRING) AS cand, row_number() OVER (PARTITION BY p_partkey % 40 ORDER BY p_partkey) AS k FROM part),
n AS (SELECT ord, cand, CASE CAST(substring(cand, 2) AS INT) % 4 WHEN 0 THEN k - 1 ELSE k END AS need, CAST(substring(cand, 2) AS INT) % 4 AS m FROM c)
SELECT ord, CASE WHEN need = 0 THEN cand ELSE cand || '-' || CAST(CASE WHEN m = 2 THEN CASE WHEN need + 1 >= 2 THEN need + 2 END WHEN m = 3 THEN CASE WHEN need + 1 >= 4 THEN need + 2 ELSE need + 1 END ELSE need + 1 END AS STRING) END AS id FROM n""")
def m06(spark, d):
    cand = B.table(spark, d, "part").selectExpr("p_partkey AS ord", "'c' || CAST(p_partkey % 40 AS STRING) AS candidate")
    # residues 1..3 are taken already, 2 also holds suffix 2 and 3 holds suffix 4
    taken = B.table(spark, d, "part").selectExpr("""explode(CASE p_partkey % 40 % 4 WHEN 0 THEN array() WHEN 1 THEN array('c' || CAST(p_partkey % 40 AS STRING))
      WHEN 2 THEN array('c' || CAST(p_partkey % 40 AS STRING), 'c' || CAST(p_partkey % 40 AS STRING) || '-2')
      ELSE array('c' || CAST(p_partkey % 40 AS STRING), 'c' || CAST(p_partkey % 40 AS STRING) || '-4') END) AS id""")
    return M.uniq_id(cand, taken).select("ord", "id")


def _coarse(spark, d):
    return B.view(spark, d, "variant").withColumn("price", F.floor(F.col("price") / 40000) * 100.0).withColumn(
        "options", F.create_map(F.lit("Size"), F.col("size"), F.lit("Colour"), F.col("color")))


COARSE = """cv AS (SELECT *, floor(price / 40000) * 100.0 AS p, coalesce(color, color_family, title) AS c FROM variant),
pr AS (SELECT bag_id, c, p, count(*) AS n, min(pos) AS first_, bool_or(available) AS av FROM cv GROUP BY 1, 2, 3),
hit AS (SELECT bag_id, sum(n) AS total, count(*) AS kept FROM pr GROUP BY 1 HAVING sum(n) > {above} AND count(*) < sum(n))"""


@query("m07_collapse_variants", "variant", f"""
WITH {COARSE.format(above=0)} SELECT cv.bag_id, cv.pos, pr.av AS available FROM cv JOIN pr ON cv.bag_id = pr.bag_id AND cv.pos = pr.first_ AND cv.p = pr.p AND cv.c = pr.c
 WHERE cv.bag_id IN (SELECT bag_id FROM hit) UNION ALL SELECT bag_id, pos, available FROM cv WHERE bag_id NOT IN (SELECT bag_id FROM hit)""")
def m07(spark, d):
    return M.collapse_variants(_coarse(spark, d), 0).variants.select("bag_id", "pos", "available")


@query("m07_collapse_above", "variant", f"""
WITH {COARSE.format(above=X.COLLAPSE_ABOVE)} SELECT bag_id, CAST(total AS BIGINT) AS collapsed_from, kept FROM hit""")
def m07c(spark, d):
    return M.collapse_variants(_coarse(spark, d), X.COLLAPSE_ABOVE).bags.select("bag_id", "collapsed_from", "kept")


@query("m07_variant_axes", "variant", f"""
WITH {COARSE.format(above=0)} SELECT DISTINCT bag_id, 'Size' AS axis, size AS value FROM cv WHERE size IS NOT NULL AND bag_id IN (SELECT bag_id FROM hit) UNION
SELECT bag_id, 'Colour', color FROM cv WHERE color IS NOT NULL AND bag_id IN (SELECT bag_id FROM hit)""")
def m07b(spark, d):
    return M.collapse_variants(_coarse(spark, d), 0).axes


@query("m08_permalink", "bag", """
WITH s AS (SELECT id, brand_slug, replace(lower(name), ' ', '-') AS s, row_number() OVER (PARTITION BY brand_slug, replace(lower(name), ' ', '-')
 ORDER BY lower(brand), lower(name), ord) AS n FROM bag) SELECT id, CASE WHEN n > 1 THEN s || '-' || CAST(n AS STRING) ELSE s END AS slug FROM s""")
def m08(spark, d):
    return M.permalink(B.bags(spark, d)).select("id", "slug")


@query("m09_usd_approx", ("bag", "rate"), """
SELECT id, CASE WHEN b.currency <> 'USD' AND price_min <> 0 THEN round(price_min / per_usd, 2) END AS price_usd_approx FROM bag b LEFT JOIN rate r ON b.currency = r.currency""")
def m09(spark, d):
    return M.usd_approx(B.bags(spark, d), B.rates(spark)).select("id", "price_usd_approx")


@query("m10_coverage", "bag", """
WITH c AS (SELECT count(*) AS n, count(volume_l) AS v, count(dims_cm) AS d, count(weight_g) AS w, count(laptop_in) AS l, count(price_min) AS p FROM bag)
SELECT 'volume_l' AS field, v AS have, CAST(round_even(100.0::DOUBLE * v / n, 0) AS INT) AS pct FROM c UNION ALL SELECT 'dims_cm', d, CAST(round_even(100.0::DOUBLE * d / n, 0) AS INT) FROM c UNION ALL
SELECT 'weight_g', w, CAST(round_even(100.0::DOUBLE * w / n, 0) AS INT) FROM c UNION ALL SELECT 'laptop_in', l, CAST(round_even(100.0::DOUBLE * l / n, 0) AS INT) FROM c UNION ALL
SELECT 'price_min', p, CAST(round_even(100.0::DOUBLE * p / n, 0) AS INT) FROM c""")
def m10(spark, d):
    return M.coverage(B.bags(spark, d))


@query("m11_catalogue_meta", "bag", """
SELECT 'bag_count' AS metric, '' AS key, count(*) AS value FROM bag UNION ALL SELECT 'brand_count', '', count(DISTINCT brand_slug) FROM bag UNION ALL
SELECT 'sku_count', '', CAST(sum(variant_count) AS BIGINT) FROM bag UNION ALL SELECT 'category_count', '', count(DISTINCT category) FROM bag UNION ALL
SELECT 'products_merged', '', CAST(sum(merged_from - 1) AS BIGINT) FROM bag UNION ALL SELECT 'models_split', '', count(DISTINCT split_from) FROM bag UNION ALL
SELECT 'currencies', currency, count(*) FROM bag GROUP BY 2 UNION ALL SELECT 'currency_sources', currency_source, count(*) FROM bag GROUP BY 2 UNION ALL
SELECT 'categories', category, count(*) FROM bag GROUP BY 2""")
def m11(spark, d):
    return M.catalogue_meta(B.bags(spark, d))


@query("m12_legacy_redirects", "bag", """
SELECT '/bags/' || brand_slug || '/' || legacy_slug || '/' AS from_path, '/bags/' || brand_slug || '/' || slug || '/' AS to_path FROM bag b
WHERE legacy_slug IS NOT NULL AND NOT EXISTS (SELECT 1 FROM bag o WHERE o.brand_slug = b.brand_slug AND o.slug = b.legacy_slug)""")
def m12(spark, d):
    return M.legacy_redirects(B.bags(spark, d))


@query("m13_indexable", "bag", "SELECT id FROM bag WHERE dims_cm IS NOT NULL OR (volume_l <> 0 AND weight_g <> 0)")
def m13(spark, d):
    return B.bags(spark, d).where(M.indexable()).select("id")


LINKS = """links AS (SELECT id AS bag_id, url, CAST(0 AS BIGINT) AS ord FROM bag UNION ALL SELECT id, 'https://other.example.com/p/' || replace(name, ' ', '-') || '-jet-black', 1 FROM bag WHERE pk % 2 = 0
  UNION ALL SELECT id, 'https://www.third.example.com/p/forest-green', 2 FROM bag WHERE pk % 3 = 0 UNION ALL SELECT id, 'https://third.example.com/x/plain', 3 FROM bag WHERE pk % 3 = 0)"""


def _links(spark, d):
    b = B.bags(spark, d)
    more = [b.select(F.col("id").alias("bag_id"), "url", F.lit(0).alias("ord")),
            b.where("pk % 2 = 0").selectExpr("id AS bag_id", "'https://other.example.com/p/' || replace(name, ' ', '-') || '-jet-black' AS url", "1 AS ord"),
            b.where("pk % 3 = 0").selectExpr("id AS bag_id", "'https://www.third.example.com/p/forest-green' AS url", "2 AS ord"),
            b.where("pk % 3 = 0").selectExpr("id AS bag_id", "'https://third.example.com/x/plain' AS url", "3 AS ord")]
    out = more[0]
    for m in more[1:]:
        out = out.unionByName(m)
    return out


@query("m14_variant_urls", ("bag", "variant"), f"""
WITH {LINKS}, h AS (SELECT bag_id, url, regexp_replace(lower(regexp_extract(url, '[^/]*$')), '[^a-z0-9]+', '', 'g') AS handle FROM links),
n AS (SELECT bag_id, count(*) AS n FROM h GROUP BY 1), k AS (SELECT v.bag_id, v.pos, v.variant_id, regexp_replace(lower(coalesce(color, title)), '[^a-z0-9]+', '', 'g') AS key FROM variant v)
SELECT k.bag_id, k.pos, coalesce((SELECT min(url) FROM h WHERE h.bag_id = k.bag_id AND n.n > 1 AND contains(handle, key) HAVING count(*) = 1),
 CASE WHEN b.source LIKE 'shopify:%' THEN b.url || '?variant=' || CAST(variant_id AS STRING) END) AS url FROM k JOIN bag b ON b.id = k.bag_id JOIN n ON n.bag_id = k.bag_id""")
def m14(spark, d):
    return M.variant_urls(B.bags(spark, d), B.view(spark, d, "variant"), _links(spark, d).select("bag_id", "url"))


@query("m15_offers", "bag", f"""
WITH {LINKS}, e AS (SELECT bag_id, url, ord, regexp_replace(regexp_extract(url, '^https?://([^/]+)', 1), '^www\\.', '') AS host FROM links)
SELECT bag_id, host, arg_min(url, ord) AS url, min(ord) = 0 AS canonical FROM e GROUP BY 1, 2""")
def m15(spark, d):
    return M.offers(B.bags(spark, d), _links(spark, d).where("ord > 0")).select("bag_id", "host", "url", "canonical")
