"""Queries over text: spec extraction, classification and stored pages.

Product texts are rendered from the part table with known figures in them; page
jobs also run over the whole stored pages.
"""
from pyspark.sql import functions as F

from ..functions import fixed as X, scalars as S, text as T
from ..functions.rules import let
from ..functions.skew import dealt
from ..operators import classify as C, enrich as E, normalize as N, pages as P
from . import bindings as B
from .registry import query

K = "CAST({} AS STRING)".format


def _rendered(part, **cols):
    """Rendered texts: every column is an SQL text over the part table."""
    return part.selectExpr(
        "p_partkey AS k", "p_size", "p_name", "p_retailprice",
        *[f"{e} AS {c}" for c, e in cols.items()])


def _part(spark, d, **cols):
    """Rendered texts of parts that are dealt out first: a narrow row becomes a long text to read."""
    return _rendered(dealt(B.table(spark, d, "part")), **cols)


def _read(spark, d, expr, fn, name="v"):
    return _part(spark, d, t=expr).select("k", fn(F.col("t")).alias(name))


# --- text -------------------------------------------------------------------

STRIP = """trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(
  regexp_replace({h}, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'),
  '(?i)<br\\s*/?>|</p>|</li>|</div>', ' ' || chr(10) || ' ', 'g'), '<[^>]+>', ' ', 'g'),
  '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '[ \\t]+', ' ', 'g'), ' ' || chr(10) || chr(13) || chr(9))"""


@query("x01_strip_html", (), f"SELECT page_id, md5({STRIP.format(h='html')}) AS digest FROM pages")
def x01(spark, d):
    return B.table(spark, d, "pages").select("page_id", F.md5(T.strip_html(F.col("html"))).alias("digest"))


@query("x02_volume", (), """
SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS DOUBLE) WHEN 1 THEN p_size + 0.5 WHEN 2 THEN CAST(p_size AS DOUBLE) END AS v FROM part""")
def x02(spark, d):
    return _read(spark, d, f"""CASE k0 % 4 WHEN 0 THEN 'Art. 900L Travel Pack ' || {K('p_size')} || 'L'
      WHEN 1 THEN 'Holds ' || {K('p_size')} || ',5 lt of gear' WHEN 2 THEN 'abc12L and ' || {K('p_size')} || ' litres'
      ELSE 'no figure 7 kg' END""".replace("k0", "p_partkey"), T.volume)


@query("x03_volume_bag", (), """
SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 4 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS v FROM part""")
def x03(spark, d):
    n = K("p_size")
    return _read(spark, d, f"""CASE p_partkey % 5
      WHEN 0 THEN 'Ships with a 2L Reservoir. Capacity: ' || {n} || ' L'
      WHEN 1 THEN 'Fits Harbour 96L, Quarry 98L, Quarry 94L. Volume ' || {n} || 'L'
      WHEN 2 THEN 'slides under a seat and offers ' || {n} || ' liters of tidy space'
      WHEN 3 THEN 'made for weekends this plain ' || {n} || 'L bag'
      ELSE 'can be easily attached to or removed from our Quarry ' || {n} || 'L' END""", T.volume_bag)


@query("x04_volume_cuin", (), """
SELECT p_partkey AS k, CASE WHEN p_partkey % 3 < 2 THEN round((1000 + p_size * 61) * 0.0163871::DOUBLE, 1) END AS v FROM part""")
def x04(spark, d):
    return _read(spark, d, f"""CASE p_partkey % 3 WHEN 0 THEN 'holds ' || {K('1000 + p_size * 61')} || ' cu in'
      WHEN 1 THEN {K('1 + floor(p_size * 61 / 1000)').replace('CAST(', 'CAST(CAST(').replace(' AS STRING)', ' AS INT) AS STRING)')} || ',' ||
        lpad({K('(p_size * 61) % 1000')}, 3, '0') || ' cubic inches' ELSE '999,999 cu in' END""", T.volume_cuin)


A, W_, D_ = "(20 + p_partkey % 45)", "(5 + p_partkey % 20)", "(8 + p_partkey % 11)"


@query("x05_dims_labelled", (), f"""
SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE array_to_string([CAST(x AS STRING) FOR x IN list_reverse_sort(
  CASE WHEN p_partkey % 4 = 2 THEN [CAST({A} AS DOUBLE), round({W_} * 2.54::DOUBLE, 1)]
  ELSE [CAST({A} AS DOUBLE), round({W_} * 2.54::DOUBLE, 1), CAST({D_} AS DOUBLE)] END)], 'x') END AS v FROM part""")
def x05(spark, d):
    df = _part(spark, d, t=f"""CASE p_partkey % 4
      WHEN 3 THEN 'Height: 30 Width: {{}} Length: ' || {K(A)} || ' cm'
      WHEN 2 THEN 'Tall ' || {K(A)} || ' cm, wide: ' || {K(W_)} || '" Depth: 900 cm'
      ELSE 'Length: 99" (' || {K(A)} || ' cm)  Width: ' || {K(W_)} || ' inches  Depth - ' || {K(D_)} || 'cm Height: 44 cm' END""")
    return df.select("k", F.array_join(F.transform(T.dims_labelled(F.col("t")), lambda v: v.cast("string")), "x").alias("v"))


@query("x06_dims_axis", (), f"""
SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 3 THEN NULL WHEN 0 THEN 'cm' WHEN 1 THEN 'in' ELSE 'mm' END AS unit,
 CASE p_partkey % 4 WHEN 0 THEN greatest({A}, {W_}, {D_}) WHEN 1 THEN round(greatest({W_}, {D_}, 12) * 2.54::DOUBLE, 1)
  WHEN 2 THEN greatest({A}, {W_}, {D_}) END::DOUBLE AS largest FROM part""")
def x06(spark, d):
    df = _part(spark, d, t=f"""CASE p_partkey % 4
      WHEN 0 THEN {K(A)} || ' H x ' || {K(W_)} || ' W x ' || {K(D_)} || ' cm D'
      WHEN 1 THEN {K(W_)} || 'in H x 12in L x ' || {K(D_)} || 'in W'
      WHEN 2 THEN {K(A + ' * 10')} || 'mm H × ' || {K(W_ + ' * 10')} || 'mm W × ' || {K(D_ + ' * 10')} || 'mm D'
      ELSE {K(A)} || ' H x ' || {K(W_)} || ' W x ' || {K(D_)} || ' D' END""")
    return df.select("k", let(T.dims_axis(F.col("t")), lambda a: F.struct(a["unit"].alias("unit"), F.get(
        a["dims"], F.lit(0)).alias("largest"))).alias("a")).select("k", "a.unit", "a.largest")


@query("x07_dims_ladder", (), f"""
SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN 'description:labelled' WHEN 1 THEN 'description:axis-cm' WHEN 2 THEN 'description:cm'
  WHEN 3 THEN 'description:in' WHEN 4 THEN 'description:cm-slash' ELSE 'description:labelled-partial' END AS source,
 CAST(CASE p_partkey % 6 WHEN 3 THEN round(greatest({W_}, {D_}, 12) * 2.54::DOUBLE, 1) WHEN 5 THEN greatest({A}, {W_})
  ELSE greatest({A}, {W_}, {D_}) END AS DOUBLE) AS largest, CAST(CASE p_partkey % 6 WHEN 5 THEN 2 ELSE 3 END AS INT) AS axes FROM part""")
def x07(spark, d):
    df = _part(spark, d, t=f"""CASE p_partkey % 6
      WHEN 0 THEN 'Length: ' || {K(A)} || ' cm Width: ' || {K(W_)} || ' cm Depth: ' || {K(D_)} || ' cm'
      WHEN 1 THEN {K(A)} || 'cm H x ' || {K(W_)} || 'cm W x ' || {K(D_)} || 'cm D'
      WHEN 2 THEN 'size ' || {K(A)} || ' × ' || {K(W_)} || ' × ' || {K(D_)} || ' cm'
      WHEN 3 THEN {K(W_)} || '" x 12" x ' || {K(D_)} || '"'
      WHEN 4 THEN {K(A)} || ' / ' || {K(W_)} || ' / ' || {K(D_)} || ' (L x W x D) cm'
      ELSE 'Height: ' || {K(A)} || ' cm Width: ' || {K(W_)} || ' cm' END""")
    one = df.select("k", T.dims(F.col("t"), slash=True).alias("d"))
    return one.select("k", "d.source", F.get("d.dims", F.lit(0)).alias("largest"), F.size("d.dims").alias("axes"))


GR = "(100 + p_partkey % 3000)"


@query("x08_weight", (), f"""
SELECT p_partkey AS k, CAST(CASE p_partkey % 6 WHEN 0 THEN p_size * 100 + 100 WHEN 1 THEN round_even((1 + p_partkey % 15) * 453.592::DOUBLE, 0)
  WHEN 2 THEN round_even((10 + p_partkey % 90) * 28.3495::DOUBLE, 0) WHEN 3 THEN {GR} WHEN 4 THEN NULL ELSE NULL END AS INT) AS v,
 CAST(CASE p_partkey % 6 WHEN 0 THEN p_size * 100 + 100 WHEN 1 THEN {GR} WHEN 2 THEN round_even((10 + p_partkey % 90) * 28.3495::DOUBLE, 0)
  WHEN 3 THEN {GR} END AS INT) AS metric FROM part""")
def x08(spark, d):
    df = _part(spark, d, t=f"""CASE p_partkey % 6
      WHEN 0 THEN 'weighs ' || {K('p_size / 10')[:0]}{K('CAST(floor((p_size + 1) / 10) AS INT)')} || ',' || {K('(p_size + 1) % 10')} || ' kg'
      WHEN 1 THEN {K(GR)} || 'g / ' || {K('1 + p_partkey % 15')} || ' lbs'
      WHEN 2 THEN {K('10 + p_partkey % 90')} || ' oz total, 999999 g' WHEN 3 THEN 'about ' || {K(GR)} || ' grams'
      WHEN 4 THEN 'carries 10-11kg loads, 6–7kg best' ELSE '3.85oz/sqy and 130 g/m² fabric' END""")
    return df.select("k", T.weight(F.col("t")).alias("v"), T.weight(F.col("t"), True).alias("metric"))


@query("x09_weight_labelled", (), f"""
SELECT p_partkey AS k, CAST(CASE p_partkey % 4 WHEN 0 THEN {GR} WHEN 1 THEN round_even((1 + p_partkey % 15) * 453.592::DOUBLE, 0) END AS INT) AS v FROM part""")
def x09(spark, d):
    return _read(spark, d, f"""CASE p_partkey % 4 WHEN 0 THEN 'Weight: ' || {K(GR)} || ' g' WHEN 1 THEN 'Gewicht ' || {K('1 + p_partkey % 15')} || ' lbs'
      WHEN 2 THEN '9,000 meters of yarn weigh 600 grams' ELSE 'Fabric weight: 130 g/m²' END""", T.weight_labelled)


@query("x10_laptop", (), """
SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN 10.0 + p_partkey % 9 WHEN 1 THEN 10.5 + p_partkey % 7 END::DOUBLE AS v FROM part""")
def x10(spark, d):
    return _read(spark, d, f"""CASE p_partkey % 3 WHEN 0 THEN 'fits a ' || {K('10 + p_partkey % 9')} || '" laptop'
      WHEN 1 THEN 'Laptop sleeve takes up to ' || {K('10 + p_partkey % 7')} || '.5 inch machines' ELSE '99 laptop stickers' END""", T.laptop)


@query("x11_near_label", (), f"""
SELECT p_partkey AS k, CAST({GR} AS INT) AS w, CAST(p_size AS DOUBLE) AS v FROM part""")
def x11(spark, d):
    df = _part(spark, d, t=f"'hip belt 4700 g, menu 20L 30L. Capacity Volume: ' || {K('p_size')} || ' L. Weights & Measurements / ' || {K(GR)} || ' g'")
    return df.select("k", T.near_label(F.col("t"), "weight", T.weight).alias("w"),
                     T.near_label(F.col("t"), "volume", T.volume_bag).alias("v"))


@query("x12_spec_windows", (), """
SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN 'spec-block' ELSE 'description' END AS source, CAST(p_size AS DOUBLE) AS v,
  CAST(CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 1 END AS INT) AS n FROM part""")
def x12(spark, d):
    df = _part(spark, d, t=f"""CASE WHEN p_partkey % 2 = 0 THEN 'nav 99L ' || repeat('word ', 200) || 'Specifications ' || {K('p_size')} || ' L '
      || repeat('filler ', 100) || 'Technical data nothing' ELSE 'nav 99L only' END""", desc=f"'a bag of ' || {K('p_size')} || ' liters'")
    w = df.select("k", T.spec_windows(F.col("t"), F.col("desc")).alias("w"))
    return w.select("k", T.first_read(F.col("w"), T.volume_bag).alias("r"), F.size("w").alias("n")).select(
        "k", "r.source", F.col("r.value").alias("v"), "n")


@query("x13_table_specs", (), f"""
SELECT p_partkey AS k, CASE WHEN p_partkey % 3 < 2 THEN greatest({A}, {W_})::DOUBLE END AS largest,
 CAST(CASE WHEN p_partkey % 3 = 0 THEN {GR} END AS INT) AS weight_g, CASE WHEN p_partkey % 3 = 0 THEN p_size::DOUBLE END AS volume_l FROM part""")
def x13(spark, d):
    df = _part(spark, d, a=K(A), w=K(W_), g=K(GR), s=K("p_size"), m="p_partkey % 3")
    row = lambda *c: F.array(*[F.lit(x) if isinstance(x, str) else x for x in c])
    cm = lambda c: F.concat(F.col(c), F.lit(" cm"))
    junk = F.array(row("Colour", "Price"), row("Black", "90"))
    good = F.array(row("Height", "Width", "Weight", "Capacity"),
                   F.array(cm("a"), F.col("w"), F.concat("g", F.lit(" g")), F.concat("s", F.lit(" L"))))
    mm = F.array(row("Höhe", "Breite"), F.array(F.concat("a", F.lit(".0 cm")), F.col("w")))
    t = F.when(F.col("m") == 0, F.array(junk, good)).when(F.col("m") == 1, F.array(mm)).otherwise(F.array(junk))
    return df.select("k", T.table_specs(t).alias("t")).select(
        "k", F.get("t.dims", F.lit(0)).alias("largest"), "t.weight_g", "t.volume_l")


@query("x14_pair_specs", (), f"""
SELECT p_partkey AS k, greatest({A}, {W_}, {D_})::DOUBLE AS largest, p_size::DOUBLE AS volume_l, CAST({GR} AS INT) AS weight_g FROM part""")
def x14(spark, d):
    df = _part(spark, d, dims=f"{K(A)} || ' / ' || {K(W_)} || ' / ' || {K(D_)} || ' cm'", s=f"{K('p_size')} || ' L'", g=f"{K(GR)} || ' g'")
    pair = lambda k, v: F.array(F.lit(k), v if not isinstance(v, str) else F.lit(v))
    pairs = F.array(pair("Color", "Black"), pair("Total  Weight", "n/a"), pair("Dimensions", "n/a"), pair("Abmessungen", F.col("dims")),
                    pair("Volume", F.col("s")), pair("total weight", F.col("g")))
    return df.select("k", F.get(T.pair_read(pairs, "dims", lambda v: T.dims(v, True)["dims"]), F.lit(0)).alias("largest"),
                     T.pair_read(pairs, "volume", T.volume_bag).alias("volume_l"), T.pair_read(pairs, "weight", T.weight).alias("weight_g"))


# --- structured data --------------------------------------------------------

NODE = (f"""'{{"@type":"Product","name":"' || p_name || '","sku":"P' || {K('p_partkey')} || '","offers":' || CASE p_partkey % 3
   WHEN 0 THEN '{{"@type":"Offer","price":"' || {K('p_partkey + 10')} || '.50","priceCurrency":"EUR","availability":"http://schema.org/InStock","sku":"S1"}}'
   WHEN 1 THEN '{{"@type":"AggregateOffer","lowPrice":' || {K('p_partkey + 10')} || ',"highPrice":{{"value":"1,' || lpad({K('p_partkey % 1000')}, 3, '0') || '"}},"priceCurrency":"USD"}}'
   ELSE '[{{"@type":"AggregateOffer","offers":[{{"price":' || {K('p_partkey + 10')} || ',"sku":"A"}},{{"price":5,"gtin13":"G"}}]}},{{"price":7}}]' END || '}}'""")


@query("x15_ld_product", (), f"""
SELECT p_partkey AS k, 'P' || CAST(p_partkey AS STRING) AS sku, 'Packs > ' || p_name AS crumbs FROM part""")
def x15(spark, d):
    df = _part(spark, d, a=f"""'{{"@graph":[{{"@type":"WebPage","mainEntity":' || {NODE} || '}}]}}'""",
               b="""'{"@type":["BreadcrumbList"],"itemListElement":[[{"name":"Packs"}],{"item":{"name":"' || p_name || '"}}]}'""")
    return df.select("k", P.ld_product(F.array("a", "b")).alias("l")).select(
        "k", F.get_json_object("l.product", "$.sku").alias("sku"), F.array_join("l.crumbs", " > ").alias("crumbs"))


@query("x16_ld_offers", (), """
SELECT p_partkey AS k, 0 AS pos, CAST(p_partkey + 10.5 AS DOUBLE) AS price, CAST(NULL AS DOUBLE) AS high, 'EUR' AS currency, 'S1' AS sku FROM part WHERE p_partkey % 3 = 0 UNION ALL
SELECT p_partkey, 0, p_partkey + 10, 1000 + p_partkey % 1000, 'USD', NULL FROM part WHERE p_partkey % 3 = 1 UNION ALL
SELECT p_partkey, 0, p_partkey + 10, NULL, NULL, 'A' FROM part WHERE p_partkey % 3 = 2 UNION ALL
SELECT p_partkey, 1, 5, NULL, NULL, 'G' FROM part WHERE p_partkey % 3 = 2 UNION ALL
SELECT p_partkey, 2, 7, NULL, NULL, NULL FROM part WHERE p_partkey % 3 = 2""")
def x16(spark, d):
    df = _part(spark, d, n=NODE)
    return df.select("k", F.posexplode(P.ld_offers(F.col("n"))).alias("pos", "o")).select(
        "k", "pos", "o.price", "o.high", "o.currency", "o.sku")


@query("x17_page_prices", (), """
SELECT p_partkey AS k, p_retailprice AS sale, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice + 100 END AS listed FROM part""")
def x17(spark, d):
    df = _part(spark, d, s=K("p_retailprice"), l=K("p_retailprice + 100"))
    e = lambda c, v: F.array(F.lit(c), v)
    vals = F.when(F.col("k") % 2 == 0, F.array(e("price sales", F.col("s")), e("price strike", F.col("l")), e("rating value", F.lit("0.5")),
                                              e("price", F.lit("n/a")))).otherwise(F.array(e("value", F.col("s"))))
    p = df.select("k", T.page_prices(vals).alias("p"))
    return p.select("k", F.array_min("p.sale").alias("sale"), F.array_max("p.listed").alias("listed"))


TIDY = "trim(regexp_replace(replace(replace(regexp_extract(html, '(?s)<{t}>(.*?)</{t}>', 1), '&quot;', '\"'), '&amp;', '&'), '\\s+', ' ', 'g'))"


@query("x18_page_digest", (), f"""
SELECT page_id, {TIDY.format(t='title')} AS title, {TIDY.format(t='h1')} AS h1, CAST(0 AS INT) AS images, CAST(0 AS INT) AS tables,
 CAST(0 AS INT) AS blocks FROM pages""")
def x18(spark, d):
    return P.digest(B.table(spark, d, "pages")).select(
        "page_id", "title", "h1", F.size("images").alias("images"), F.size("tables").alias("tables"), F.size("jsonld").alias("blocks"))


@query("x18_digest_fields", (), """
SELECT p_partkey AS k, p_name AS title, 'd ' || p_name AS description, 'The ' || p_name AS h1, '{"@type": "Product", "sku": "' || CAST(p_partkey AS STRING) || '"}' AS jsonld,
 'Volume=' || CAST(p_size AS STRING) || ' L;Weight=' || CAST(p_partkey + 100 AS STRING) || ' g;Origin=' || p_brand AS pairs,
 'H|W/' || CAST(p_size AS STRING) || ' cm|<4>' AS cells, 14 AS tables, 'price box|' || CAST(p_partkey AS STRING) AS vals, 60 AS images, '/i/' || CAST(p_partkey AS STRING) || '.jpg' AS image,
 'The ' || p_name || ' Volume ' || CAST(p_size AS STRING) || ' L Weight ' || CAST(p_partkey + 100 AS STRING) || ' g Origin ' || p_brand || ' ' ||
 repeat('H W ' || CAST(p_size AS STRING) || ' cm <4> ', 14) || repeat('word ', 7000) || 'Capacity ' || CAST(p_size AS STRING) || ' L' AS text FROM part""")
def x18b(spark, d):
    n, size = K("p_partkey"), K("p_size")
    page = f"""'<html><head><title> ' || p_name || '</title><meta name="Description" content="d ' || p_name || '"><meta name=description content=other>
      <script type="application/ld+json">[{{"@type":"Product","sku":"' || {n} || '"}}, 3]</script><script type="application/ld+json">{{broken</script>
      <style>h1{{}}</style></head><body><h1>The&nbsp;' || p_name || '</h1>' || repeat('<img src="/i/' || {n} || '.jpg"><img src="data:x">', 60) ||
      '<dl><dt>Volume<dd>' || {size} || ' L<dt>Weight</dt><dd>' || {K('p_partkey + 100')} || ' g</dd></dl><div class="box"><span class="spec-name">Origin</span> <b class="spec-value">'
      || p_brand || '</b><i class="price" content="' || {n} || '"></i></div>' || repeat('<table><tr><th>H<th>W</tr><tr><td>' || {size} || ' cm</td><td>&lt;4></td></tr></table>', 14)
      || '<!-- <p>no</p> --><noscript>no</noscript><p>' || repeat('word ', 7000) || '</p>Capacity ' || {size} || ' L</body></html>'"""
    rows = P.digest(_part(spark, d, html=page).select("k", "html"))
    flat = lambda c, sep: F.array_join(F.transform(c, lambda p: F.array_join(p, sep)), ";")
    return rows.select(
        "k", "title", F.col("meta")["description"].alias("description"), F.regexp_replace("h1", "\u00a0", " ").alias("h1"), F.array_join("jsonld", ";").alias("jsonld"),
        flat("pairs", "=").alias("pairs"), F.array_join(F.transform(F.get("tables", F.lit(13)), lambda r: F.array_join(r, "|")), "/").alias("cells"),
        F.size("tables").alias("tables"), flat("values", "|").alias("vals"), F.size("images").alias("images"), F.get("images", F.lit(59)).alias("image"), "text")


def _product_pages(spark, d):
    """Product pages rendered from parts, every second one wrapped in a real page's markup."""
    body = f"""'<script type="application/ld+json">{{"@type":"Product","name":"' || p_name || '","description":"A trusty ' || p_name ||
      ' of recycled nylon for long days, model number ' || {K('p_partkey')} || '","gtin13":"' || {K('p_partkey + 4000000')} ||
      '","offers":[{{"priceCurrency":"EUR"}}]}}</script><nav>Bags Pouches</nav><p>A trusty ' || p_name ||
      ' of recycled nylon for long days, model number ' || {K('p_partkey')} || '. ' || CASE p_partkey % 4
      WHEN 0 THEN 'Dimensions: ' || {K(A)} || ' x ' || {K(W_)} || ' x ' || {K(D_)} || ' cm. Weight: ' || {K(GR)} || ' g. fits a 15" laptop. '
      WHEN 1 THEN 'Capacity: ' || {K('p_size')} || ' L. Weight ' || {K(GR)} || ' g. ' WHEN 2 THEN 'Dimensions on request. ' ELSE '' END ||
      'YKK zips.</p><p>You may also like more</p>'"""
    theme = f"""CASE WHEN p_partkey % 4 = 3 THEN '<script type="application/json">{{"a":[{{"spec":{{"Feature text size":"<b>RFID</b> pocket ' ||
      {K('p_partkey')} || '"}}}}]}}</script>' ELSE '' END"""
    return _rendered(B.table(spark, d, "part"), page_key="'pg' || " + K("p_partkey"),
                     html=f"'<html><head><title>x</title></head><body>' || {body} || {theme} || '</body></html>'").select("page_key", "html", "k")


@query("x22_parse_pages", (), f"""
SELECT 'pg' || CAST(p_partkey AS STRING) AS page_key, CAST(p_partkey + 4000000 AS STRING) AS gtin, 'EUR' AS currency,
 CASE WHEN p_partkey % 4 = 0 THEN greatest({A}, {W_}, {D_})::DOUBLE END AS largest,
 CASE WHEN p_partkey % 4 = 0 THEN 15.0::DOUBLE END AS laptop_in,
 CASE WHEN p_partkey % 4 = 1 THEN p_size::DOUBLE END AS volume_l,
 CAST(CASE WHEN p_partkey % 4 < 2 THEN {GR} END AS INT) AS weight_g,
 CASE WHEN p_partkey % 4 = 3 THEN 'rfid,ykk_zips' ELSE 'ykk_zips' END AS features,
 CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 2 THEN 'not-published' WHEN p_partkey % 4 = 1 THEN 'no-spec-text' ELSE 'no-spec-text' END AS no_dims FROM part""")
def x22(spark, d):
    out = P.parse_pages(_product_pages(spark, d).select("page_key", "html"))
    return out.select("page_key", "gtin", "currency", F.get("dims_cm", F.lit(0)).alias("largest"), "laptop_in", "volume_l",
                      "weight_g", F.array_join("features", ",").alias("features"), "no_dims")


@query("x22_parse_stored_pages", (), """
SELECT CAST(page_id AS STRING) AS page_key, CAST(NULL AS STRING) AS gtin FROM pages""")
def x22b(spark, d):
    pages = B.table(spark, d, "pages").select(F.col("page_id").cast("string").alias("page_key"), "html")
    return P.parse_pages(pages).select("page_key", "gtin")


@query("x19_walk_specs", (), """
SELECT 'pg' || CAST(p_partkey AS STRING) AS page_key, CASE WHEN p_partkey % 4 = 3 THEN 'Feature text size: RFID pocket ' || CAST(p_partkey AS STRING) END AS spec FROM part""")
def x19(spark, d):
    out = P.parse_pages(_product_pages(spark, d).select("page_key", "html"))
    return out.select("page_key", F.nullif(T.squash(F.col("spec_text")), F.lit("")).alias("spec"))


@query("x20_product_scope", (), """
SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'The ' || p_name || ' carries everything you need daily. ' || repeat('On and on. ', 400) || 'Holds '
  || CAST(p_size AS STRING) || ' L. ' END AS v FROM part""")
def x20(spark, d):
    df = _part(spark, d, desc="CASE WHEN p_partkey % 3 = 0 THEN 'another text' ELSE 'The ' || p_name || ' carries  everything you need daily.' END",
               t=f"'menu The ' || p_name || '  carries everything you need daily. ' || repeat('On and on. ', 400) || 'Holds ' || {K('p_size')} || ' L. Related products: 99L'")
    return df.select("k", T.product_scope(F.col("t"), F.col("desc")).alias("v"))


@query("x21_capacity_lists", (), """
SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN 'nav ' || repeat(' ', 15) || ' end' WHEN p_partkey % 3 = 1 THEN
 'Volume: 11L 22L 33L and ' || CAST(p_size AS STRING) || 'L' ELSE 'nav 11L 22L ' || CAST(p_size AS STRING) || ' kg' END AS v FROM part""")
def x21(spark, d):
    return _read(spark, d, f"""CASE p_partkey % 3 WHEN 0 THEN 'nav 11L 22L 33L 44L end' WHEN 1 THEN 'Volume: 11L 22L 33L and ' || {K('p_size')} || 'L'
      ELSE 'nav 11L 22L ' || {K('p_size')} || ' kg' END""", T.capacity_lists_blanked)


@query("x23_no_dims_reason", (), """
SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'no-spec-text' WHEN 1 THEN 'unparsed' WHEN 2 THEN 'not-published' END AS v FROM part""")
def x23(spark, d):
    df = _part(spark, d, s=f"""CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'specs ' || {K('p_size')} || ' x 30 cm' ELSE 'specifications: ask' END""",
               t="'a page about ' || p_name")
    dims = F.when(F.col("k") % 4 == 3, F.array(F.lit(1.0)))
    return df.select("k", T.no_dims_reason(dims, F.col("s"), F.col("t")).alias("v"))


@query("x24_detect", (), """
SELECT p_partkey AS k, array_to_string([x FOR x IN [CASE WHEN p_partkey % 2 = 0 THEN 'CORDURA' END, CASE WHEN p_partkey % 3 = 0 THEN 'Waxed canvas' END,
 CASE WHEN p_partkey % 3 = 0 THEN 'Canvas' END] IF x IS NOT NULL], ',') AS materials,
 array_to_string([x FOR x IN [CASE WHEN p_partkey % 5 = 0 THEN 'laptop_sleeve' END, CASE WHEN p_partkey % 7 = 0 THEN 'water_resistant' END,
 CASE WHEN p_partkey % 7 = 0 THEN 'waterproof' END] IF x IS NOT NULL], ',') AS features FROM part""")
def x24(spark, d):
    df = _part(spark, d, t="""CASE WHEN p_partkey % 2 = 0 THEN '1000D Cordura shell ' ELSE 'accordura ' END || CASE WHEN p_partkey % 3 = 0 THEN 'waxed canvas '
      ELSE '' END || CASE WHEN p_partkey % 5 = 0 THEN 'a laptop pocket ' ELSE 'laptops ' END || CASE WHEN p_partkey % 7 = 0 THEN 'WATERPROOF' ELSE 'water' END""")
    j = lambda c: F.array_join(c, ",")
    return df.select("k", j(T.materials(F.col("t"))).alias("materials"), j(T.features(F.col("t"))).alias("features"))


@query("x24_detect_documents", (), """
SELECT doc_id, regexp_matches(text, '(?i)\\bleather\\b') AS leather, regexp_matches(text, '(?i)\\bnylon\\b') AS nylon FROM documents""")
def x24b(spark, d):
    df = B.table(spark, d, "documents").select("doc_id", T.materials(F.col("text")).alias("m"))
    return df.select("doc_id", F.array_contains("m", "Leather").alias("leather"), F.array_contains("m", "Nylon").alias("nylon"))


@query("x25_resolve_ladder", (), """
SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'title' WHEN 1 THEN 'variant-option' WHEN 2 THEN 'description' END AS source,
 CASE WHEN p_partkey % 4 < 3 THEN p_size::DOUBLE END AS value FROM part""")
def x25(spark, d):
    n = K("p_size")
    df = _part(spark, d, title=f"p_name || CASE WHEN p_partkey % 4 = 0 THEN ' ' || {n} || 'L' ELSE '' END",
               opt=f"CASE WHEN p_partkey % 4 < 2 THEN {n} || ' L' ELSE 'Medium' END", body=f"CASE WHEN p_partkey % 4 < 3 THEN 'Holds ' || {n} || ' litres.' ELSE 'n/a' END")
    return df.select("k", N.resolve(N.rung(T.volume(F.col("title")), "title"), N.rung(T.volume(F.col("opt")), "variant-option"),
                                    N.rung(T.volume_bag(F.col("body")), "description")).alias("r")).select("k", "r.source", "r.value")


@query("x26_reparse", (), """
SELECT 'pg' || CAST(p_partkey AS STRING) AS page_key, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey + 4000000 AS STRING) ELSE 'old' END AS gtin,
 p_partkey % 2 = 0 AS reparsed, p_partkey % 2 = 1 AS unreachable FROM part""")
def x26(spark, d):
    pages = _product_pages(spark, d)
    cache = pages.where("k % 2 = 1 OR k % 3 = 0").select("page_key", F.lit("old").alias("gtin"))
    return P.reparse(pages.where("k % 2 = 0").select("page_key", "html"), cache).select("page_key", "gtin", "reparsed", "unreachable")


@query("x27_page_outcome", (), """
SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'error' WHEN page_id % 5 = 0 THEN 'challenge' WHEN page_id % 3 = 0 THEN 'empty' ELSE 'ok' END AS outcome FROM pages""")
def x27(spark, d):
    pages = B.table(spark, d, "pages").select(
        "page_id", F.when(F.col("page_id") % 7 == 0, 503).otherwise(200).alias("status"),
        F.when(F.col("page_id") % 5 == 0, F.concat("html", F.lit("<p>Just a moment...</p>"))).when(
            F.col("page_id") % 3 == 0, F.regexp_replace("html", "(?s)<h1>.*?</h1>", "")).otherwise(F.col("html")).alias("html"))
    dig = P.digest(pages.withColumn("body", F.col("html")))
    return dig.select("page_id", P.page_outcome(F.col("status"), F.col("body"), F.size("jsonld"), F.col("h1")).alias("outcome"))


@query("x28_agg_pages", (), """
SELECT 'https://shop.example.com/' || CAST(p_partkey AS STRING) || '.html' AS url, p_name AS name, 'Packs > ' || p_brand AS crumbs FROM part""")
def x28(spark, d):
    df = _part(spark, d, url=f"'https://shop.example.com/' || {K('p_partkey')} || '.html'", html=f"""'<script type="application/ld+json">' || {NODE} || '</script><p>x</p>'
      || '<script type="application/ld+json">{{"@type":"BreadcrumbList","itemListElement":[{{"item":{{"name":"Packs"}}}},{{"name":"' || p_brand || '"}}]}}</script>'""")
    return P.agg_pages(df).select("url", F.get_json_object("product", "$.name").alias("name"), F.array_join("breadcrumbs", " > ").alias("crumbs"))


# --- classification ---------------------------------------------------------

KINDS = [("Cross Body Bag", "sling"), ("Waistpack", "hip-pack"), ("Toptube-Bag", "bike-bag"), ("Weekender", "duffel"),
         ("Carry-On Luggage", "luggage"), ("Shopper", "tote"), ("Satchel", "messenger"), ("Portfolio", "briefcase"),
         ("Camera Backpack", "camera-bag"), ("Hiking 28 L Backpack", "hiking-pack"), ("Travel Pack 45L", "travel-backpack"),
         ("Card Holder", "wallet"), ("Rucksack", "daypack"), ("Tech Kit", "pouch"), ("Shoulder Bag", "messenger"), ("Bucket", None)]
TITLE = "p_name || ' ' || CASE p_partkey % 16 " + " ".join(f"WHEN {i} THEN '{t}'" for i, (t, _) in enumerate(KINDS)) + " END"
CAT = "CASE p_partkey % 16 " + " ".join(f"WHEN {i} THEN '{c}'" for i, (_, c) in enumerate(KINDS) if c) + " END"


@query("c01_classify", (), f"""
SELECT p_partkey AS k, coalesce({CAT}, CASE WHEN p_partkey % 3 = 0 THEN 'tote' END) AS category,
 CASE WHEN p_partkey % 16 < 14 THEN 'title' WHEN p_partkey % 16 = 14 OR p_partkey % 3 = 0 THEN 'tag' END AS tier FROM part""".replace(
    "coalesce(CASE", "CASE WHEN p_partkey % 16 = 14 AND p_partkey % 3 = 0 THEN 'tote' ELSE coalesce(CASE").replace(
    "'tote' END) AS category", "'tote' END) END AS category"))
def c01(spark, d):
    df = _part(spark, d, t=TITLE, tags="CASE WHEN p_partkey % 3 = 0 THEN 'sale totes' ELSE '' END")
    return df.select("k", C.classify(F.col("t"), F.lit("Thing"), F.col("tags")).alias("c")).select("k", "c.category", "c.tier")


@query("c02_excluded", (), """
SELECT p_partkey AS k, p_partkey % 5 < 3 AS v FROM part""")
def c02(spark, d):
    df = _part(spark, d, t="""p_name || CASE p_partkey % 5 WHEN 0 THEN ' Contact Sling 8.0 180cm' WHEN 1 THEN ' Coasters 4-Pack'
      WHEN 2 THEN ' Hip Belt' WHEN 3 THEN ' Hip Belt Pocket' ELSE ' Arete 18 Pack 1.5L' END""")
    return df.select("k", C.excluded(F.col("t"), multipack=True).alias("v"))


@query("c03_type_veto", (), "SELECT p_partkey AS k, p_partkey % 4 = 0 AS v FROM part")
def c03(spark, d):
    df = _part(spark, d, t="p_name || CASE WHEN p_partkey % 4 = 1 THEN ' Duffel' ELSE '' END",
               y="CASE p_partkey % 4 WHEN 2 THEN 'Beauty, Cosmetic Case' WHEN 3 THEN 'Bags' ELSE 'Footwear' END")
    return df.select("k", C.type_veto(F.col("y"), F.col("t")).alias("v"))


@query("c04_taxonomy", (), """
SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'Backpacks' WHEN 1 THEN 'Tents' WHEN 2 THEN 'Wallets' END AS leaf,
 CASE p_partkey % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 2 THEN TRUE END AS carry FROM part""")
def c04(spark, d):
    df = _part(spark, d, y="""CASE p_partkey % 4 WHEN 0 THEN 'Luggage & Bags > Backpacks' WHEN 1 THEN 'Sporting Goods > Outdoor > Tents'
      WHEN 2 THEN ' Apparel & Accessories > Handbags, Wallets & Cases > Wallets' ELSE 'Backpack > Convertible > RFID Protection' END""")
    return df.select("k", C.taxonomy(F.col("y")).alias("x")).select("k", "x.leaf", "x.carry")


@query("c05_climb_veto", (), "SELECT p_partkey AS k, p_partkey % 3 = 0 AS v FROM part")
def c05(spark, d):
    df = _part(spark, d, y="CASE WHEN p_partkey % 3 = 1 THEN 'Climb On' ELSE 'Ravel' END", c="CASE WHEN p_partkey % 3 = 2 THEN 'daypack' ELSE 'sling' END")
    crumbs = F.when(F.col("k") % 3 == 1, F.array(F.lit("Camp & Hike"), F.lit("Climb On Camp & Hike"))).otherwise(
        F.array(F.lit("Ravel"), F.lit("Climb"), F.lit("Ravel Climb")))
    return df.select("k", C.climb_veto(F.col("c"), F.array_join(C.shelf_crumbs(crumbs, F.col("y")), " ")).alias("v"))


DECIDED = """CASE WHEN p_partkey % 11 = 0 THEN 'wallet' WHEN p_partkey % 8 = 1 THEN NULL WHEN p_partkey % 8 = 2 THEN NULL WHEN p_partkey % 8 = 3 THEN NULL
 WHEN p_partkey % 8 = 4 THEN 'duffel' WHEN p_partkey % 8 = 5 THEN 'pouch' WHEN p_partkey % 8 = 6 THEN 'tote' END"""


def _decided(spark, d):
    df = _part(spark, d, title="""p_name || CASE p_partkey % 8 WHEN 1 THEN ' T-Shirt' WHEN 4 THEN ' Weekender' ELSE '' END""",
               product_type="CASE p_partkey % 8 WHEN 3 THEN 'Footwear' ELSE '' END", tags="CASE WHEN p_partkey % 8 IN (5, 6) THEN 'tote' ELSE '' END",
               hc="CASE WHEN p_partkey % 8 IN (4, 5) THEN 'pouch' END", hb="CASE p_partkey % 8 WHEN 2 THEN FALSE WHEN 7 THEN p_partkey % 3 = 0 END",
               brand_slug="'brand-' || CAST(p_partkey % 25 AS STRING)", url="'https://x.example.com/p/Bag-' || CAST(p_partkey AS STRING) || '/?a=1'",
               key="'bag-' || CAST(p_partkey AS STRING)")
    rul = df.where("k % 11 = 0 OR k % 13 = 0").select(F.col("brand_slug").alias("brand"), "key", F.when(F.col("k") % 11 == 0, "wallet").alias("value"))
    df = C.with_ruling(df.drop("key"), rul, "brand_slug", S.product_key(F.col("url")))
    return df.withColumn("outcome", C.decide_category(F.col("title"), F.col("product_type"), F.col("tags"), F.col("hc"), F.col("hb"), F.col("ruling"))), rul


@query("c06_decide_category", (), f"""
SELECT p_partkey AS k, {DECIDED} AS category, CASE WHEN p_partkey % 11 = 0 THEN 'override' WHEN p_partkey % 8 = 4 THEN 'title'
 WHEN p_partkey % 8 = 5 THEN 'collection' WHEN p_partkey % 8 = 6 THEN 'tag' END AS source,
 CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 8 = 1 THEN 'not-a-bag' WHEN p_partkey % 8 = 2 THEN 'not-a-bag:collection'
  WHEN p_partkey % 8 = 3 THEN 'not-a-bag:product-type' WHEN p_partkey % 8 = 7 AND p_partkey % 3 = 0 THEN 'unclassified:known-bag'
  WHEN p_partkey % 8 = 7 THEN 'not-a-bag:collection' WHEN p_partkey % 8 = 0 THEN 'unclassified' END AS reason FROM part""")
def c06(spark, d):
    return _decided(spark, d)[0].select("k", "outcome.category", "outcome.source", "outcome.reason")


@query("c07_shelf_category", (), """
SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'bike-bag' WHEN 1 THEN 'daypack' WHEN 2 THEN 'luggage' END AS v FROM part""")
def c07(spark, d):
    df = _part(spark, d, s="CASE p_partkey % 4 WHEN 0 THEN 'Gepäckträgertasche' WHEN 1 THEN 'Rucksäcke' WHEN 2 THEN 'Koffer & Trolley' ELSE 'Zelte' END")
    return df.select("k", C.shelf_category(F.col("s")).alias("v"))


@query("c08_map_codes", (), """
SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'tote' WHEN 1 THEN 'briefcase' WHEN 2 THEN 'wallet' END AS v FROM part""")
def c08(spark, d):
    df = _part(spark, d, s="CASE p_partkey % 4 WHEN 0 THEN 'cooler_bag' WHEN 1 THEN 'folio' WHEN 2 THEN 'passport_holder' ELSE 'key_holder' END")
    return df.select("k", C.map_codes(F.col("s")).alias("v"))


@query("c09_colour_family", "variant", """
SELECT pos, bag_id, CASE WHEN split_part(bag_id, '__', 1) IN ('brand-0', 'brand-3') AND color = 'Forest Green' THEN NULL
 WHEN color = 'Jet Black' THEN 'black' WHEN color = 'Forest Green' THEN 'green' END AS family FROM variant""")
def c09(spark, d):
    v = B.view(spark, d, "variant").withColumn("brand_slug", S.id_brand(F.col("bag_id")))
    rul = spark.createDataFrame([("brand-0", "forest green", None), ("brand-3", "forest green", None)], "brand string, key string, value string")
    return C.colour_family(v, rul, "brand_slug", "color", "family").select("pos", "bag_id", "family")


@query("c10_ruling_lookup", (), """
SELECT p_partkey AS k, p_partkey % 11 = 0 OR p_partkey % 13 = 0 AS ruled, CASE WHEN p_partkey % 11 = 0 THEN 'wallet' END AS ruling FROM part""")
def c10(spark, d):
    return _decided(spark, d)[0].select("k", F.col("ruling_ruled").alias("ruled"), "ruling")


@query("c11_stale_rulings", (), """
SELECT 'brand-' || CAST(p_partkey % 25 AS STRING) AS brand, 'bag-' || CAST(p_partkey AS STRING) AS key FROM part
WHERE (p_partkey % 11 = 0 OR p_partkey % 13 = 0) AND p_partkey % 2 = 1""")
def c11(spark, d):
    df, rul = _decided(spark, d)
    used = df.where("k % 2 = 0").select(F.col("brand_slug").alias("brand"), S.product_key(F.col("url")).alias("key"))
    return C.stale_rulings(rul, used)


@query("c11_ruling_report", (), """
SELECT count(*) AS entries, count(*) FILTER (WHERE p_partkey % 2 = 0) AS used, count(*) FILTER (WHERE p_partkey % 2 = 1) AS stale
FROM part WHERE p_partkey % 11 = 0 OR p_partkey % 13 = 0""")
def c11b(spark, d):
    df, rul = _decided(spark, d)
    return C.ruling_report(rul, df.where("k % 2 = 0").select(F.col("brand_slug").alias("brand"), S.product_key(F.col("url")).alias("key")))


@query("c12_locale_currency", (), """
SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' END AS v FROM part""")
def c12(spark, d):
    return _read(spark, d, "CASE p_partkey % 5 WHEN 0 THEN '/en-us' WHEN 1 THEN 'de_AT/' WHEN 2 THEN 'en-GB' WHEN 3 THEN 'us' END", S.locale_currency)


@query("c13_observe_currency", (), """
SELECT 'brand-' || CAST(n_nationkey AS STRING) AS slug, CASE n_nationkey % 6 WHEN 0 THEN 'SEK' WHEN 1 THEN 'GBP' WHEN 2 THEN 'JPY' WHEN 3 THEN 'NOK'
 WHEN 4 THEN 'PLN' ELSE 'USD' END AS currency, CASE n_nationkey % 6 WHEN 0 THEN 'feed' WHEN 1 THEN 'locale' WHEN 2 THEN 'country' WHEN 3 THEN 'product-page'
 WHEN 4 THEN 'roster' ELSE 'assumed' END AS currency_source FROM nation WHERE n_nationkey < 25""")
def c13(spark, d):
    roster = B.table(spark, d, "nation").selectExpr(
        "'brand-' || CAST(n_nationkey AS STRING) AS slug", "CASE WHEN n_nationkey % 6 = 1 THEN 'en-gb' END AS locale",
        "CASE WHEN n_nationkey % 6 = 2 THEN 'JP' END AS country", "CASE WHEN n_nationkey % 6 = 4 THEN 'pln' ELSE '' END AS currency")
    products = _part(spark, d, slug="'brand-' || CAST(p_partkey % 25 AS STRING)", ord="p_partkey", product="""CASE WHEN (p_partkey % 25) % 6 = 0 AND p_partkey % 3 < 2 THEN
      '{"prices":[{"currency_code":"sek"}]}' WHEN (p_partkey % 25) % 6 = 0 THEN '{"priceCurrency":"USD","x":{"y":1}}' ELSE '{"currency":"dollars"}' END""")
    pages = _part(spark, d, slug="'brand-' || CAST(p_partkey % 25 AS STRING)", ord="p_partkey",
                  currency="CASE WHEN (p_partkey % 25) % 6 = 3 THEN CASE WHEN p_partkey % 4 = 0 THEN 'USD' ELSE 'nok' END ELSE 'n/a' END")
    return C.observe_currency(products, pages, roster)


def _shelving(spark, d):
    col = B.table(spark, d, "nation").selectExpr(
        "'store' AS slug", "n_nationkey AS ord", """CASE n_nationkey % 6 WHEN 0 THEN 'duffels-' WHEN 1 THEN 'bags-' WHEN 2 THEN 'apparel-' WHEN 3 THEN 'sale-'
         WHEN 4 THEN 'spare-parts-' ELSE 'weekend-' END || CAST(n_nationkey AS STRING) AS handle""", "n_name AS title")
    mem = B.table(spark, d, "lineitem").selectExpr(
        "'store' AS slug", "CAST(l_partkey AS STRING) AS product_id", """CASE (l_suppkey % 25) % 6 WHEN 0 THEN 'duffels-' WHEN 1 THEN 'bags-' WHEN 2 THEN 'apparel-'
         WHEN 3 THEN 'sale-' WHEN 4 THEN 'spare-parts-' ELSE 'weekend-' END || CAST(l_suppkey % 25 AS STRING) AS handle""")
    return col, mem


@query("c14_collection_votes", (), """
WITH v AS (SELECT CAST(l_partkey AS STRING) AS product_id, (l_suppkey % 25) % 6 AS m FROM lineitem WHERE (l_suppkey % 25) % 6 IN (0, 1, 2, 4))
SELECT 'store' AS slug, product_id, CASE WHEN count(*) FILTER (WHERE m = 0) > 0 THEN 'duffel' END AS category, count(*) FILTER (WHERE m IN (0, 1)) AS bag_votes,
 count(*) FILTER (WHERE m IN (2, 4)) AS accessory_votes, count(*) FILTER (WHERE m IN (0, 1)) > count(*) FILTER (WHERE m IN (2, 4)) AS is_bag FROM v GROUP BY product_id""")
def c14(spark, d):
    col, mem = _shelving(spark, d)
    return C.collection_votes(col, mem)


@query("c15_shelf_hints", (), """
WITH x AS (SELECT p.p_partkey AS k, CASE p.p_partkey % 4 WHEN 0 THEN 'duffel' WHEN 1 THEN 'daypack' ELSE NULL END AS c FROM part p WHERE p.p_partkey % 4 < 3)
SELECT 'model-' || CAST(k AS STRING) AS product, c AS category, 'https://shop.example.com/products/model-' || CAST(k AS STRING) AS url FROM x""")
def c15(spark, d):
    # one shelf page per part and shelf, so that a shelf is never one giant page
    n = K("p_partkey")
    shelf = lambda name, o, test: _part(
        spark, d, url=f"'https://shop.example.com/c/' || {n} || 'x/{name}/'", ord=f"p_partkey + {o}",
        html=f"'<a href=\"/products/model-' || {n} || '\">x</a><a href=\"/about\">y</a>'").where(test)
    shelves = shelf("jackets", 0, "k % 4 = 0").unionByName(shelf("bags", 1, "k % 4 < 3")).unionByName(
        shelf("backpacks", 2, "k % 4 < 2")).unionByName(shelf("duffels", 3, "k % 4 = 0"))
    return C.shelf_hints(shelves, "/products/")


@query("c16_scope_frontier", (), """
WITH m AS (SELECT 'wide' AS part, p_partkey AS k, p_partkey % 3 = 0 AS on_shelf FROM part UNION ALL
 SELECT 'thin', p_partkey, p_partkey % 50 = 0 FROM part)
SELECT *, count(*) FILTER (WHERE on_shelf) OVER (PARTITION BY part) / count(*) OVER (PARTITION BY part) AS shelf_share FROM m""")
def c16(spark, d):
    cand = _part(spark, d, url="'https://shop.example.com/products/m-' || " + K("p_partkey")).select("k", "url")
    hint = lambda test: _part(spark, d, product="'m-' || " + K("p_partkey")).where(test).select("product")
    one = lambda part, test: C.scope_frontier(cand, hint(test)).select(F.lit(part).alias("part"), "k", "on_shelf", "shelf_share")
    return one("wide", "k % 3 = 0").unionByName(one("thin", "k % 50 = 0"))


@query("c17_carry_categories", (), """
SELECT 'u' || CAST(n_nationkey AS STRING) AS uid, 0 AS depth, CAST(n_nationkey + 1 AS BIGINT) AS product_count FROM nation WHERE n_nationkey % 3 = 0 UNION ALL
SELECT 'c' || CAST(n_nationkey AS STRING), 1, n_nationkey + 2 FROM nation UNION ALL SELECT letter || CAST(n_nationkey AS STRING), depth, 11 - depth FROM nation,
 (VALUES ('g', 2), ('h', 3), ('i', 4), ('j', 5)) t(letter, depth)""")
def c17(spark, d):
    n = K("n_nationkey")
    tree = B.table(spark, d, "nation").selectExpr(
        f"'u' || {n} AS uid", "CASE n_nationkey % 3 WHEN 0 THEN 'Rucksäcke' WHEN 1 THEN 'Schlafsäcke' ELSE 'Root' END AS name",
        "CAST(n_nationkey + 1 AS BIGINT) AS product_count",
        f"""'[{{"uid":"c' || {n} || '","name":"Travel Bags","product_count":' || {K('n_nationkey + 2')} ||
          ',"children":[{{"uid":"g' || {n} || '","name":"Duffel","product_count":9,"children":[{{"uid":"h' || {n} || '","name":"Duffel","product_count":8,"children":[{{"uid":"i' || {n} ||
          '","name":"Duffel","product_count":7,"children":[{{"uid":"j' || {n} || '","name":"Duffel","product_count":6}}]}}]}}]}},{{"uid":"z","name":"Bags","product_count":0}}]}}]' AS children""")
    return C.carry_categories(tree).select("uid", "depth", "product_count")


@query("c18_url_candidates", (), "SELECT p_partkey AS k FROM part WHERE p_partkey % 4 IN (0, 3)")
def c18(spark, d):
    df = _part(spark, d, url="""'https://shop.example.com/p/' || CASE p_partkey % 4 WHEN 0 THEN 'red-backpack-' WHEN 1 THEN 'backpack-rain-cover-'
       WHEN 2 THEN 'stove-' ELSE 'sling-' END || """ + K("p_partkey"))
    return C.url_candidates(df).select("k")


@query("c19_quarantine", (), """
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 8 = 1 THEN 'not-a-bag' WHEN p_partkey % 8 = 2 THEN 'not-a-bag:collection'
  WHEN p_partkey % 8 = 3 THEN 'not-a-bag:product-type' WHEN p_partkey % 8 = 7 AND p_partkey % 3 = 0 THEN 'unclassified:known-bag'
  WHEN p_partkey % 8 = 7 THEN 'not-a-bag:collection' WHEN p_partkey % 8 = 0 THEN 'unclassified' END AS reason FROM part) t WHERE reason IS NOT NULL GROUP BY reason""")
def c19(spark, d):
    return C.quarantine(_decided(spark, d)[0])[2]


def _tagged(spark, d):
    tail = (F.when(F.col("page_id") % 4 == 0, "<script src='https://cdn.shopify.com/s/x.js'></script>")
            .when(F.col("page_id") % 4 == 1, "<link href='/wp-content/x.css'><script src='//t.awin1.com/a.js'></script>")
            .when(F.col("page_id") % 4 == 2, "<script src='https://x.refersion.com/a'></script><script src='https://cdn.thing.example/a.js'></script>")
            .otherwise(""))
    return B.table(spark, d, "pages").select("page_id", "url", F.concat("html", tail).alias("html"))


@query("c20_platform", (), """
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'shopify' WHEN 1 THEN 'woocommerce' ELSE 'unknown' END AS platform FROM pages""")
def c20(spark, d):
    return _tagged(spark, d).select("page_id", C.platform_of(F.col("html")).alias("platform"))


@query("c21_markers", (), """
SELECT page_id, CASE page_id % 4 WHEN 2 THEN 'refersion' ELSE '' END AS vendors, CASE page_id % 4 WHEN 1 THEN 'awin' ELSE '' END AS networks FROM pages""")
def c21(spark, d):
    j = lambda r: F.array_join(C.markers_in(F.col("html"), r), ",")
    return _tagged(spark, d).select("page_id", j(X.IN_HOUSE_MARKERS).alias("vendors"), j(X.NETWORK_MARKERS).alias("networks"))


@query("c22_programme_links", (), """
WITH h AS (SELECT page_id, url, regexp_extract(url, '^(https?)://', 1) AS s, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages)
SELECT page_id, 1 AS strength, s || '://' || host || '/pages/affiliates' AS target FROM h UNION ALL
SELECT page_id, 1, s || '://' || host || '/b?x=ambassador' FROM h UNION ALL SELECT page_id, 1, s || '://' || host || '/third-affiliate' FROM h UNION ALL
SELECT page_id, 2, s || '://' || host || '/r' FROM h UNION ALL SELECT page_id, 2, s || '://' || host || '/creators' FROM h""")
def c22(spark, d):
    tail = ("<a href='/pages/affiliates'>Join</a><a href='https://elsewhere.example.net/affiliate'>no</a><a href='/b?x=ambassador'>b</a>"
            "<a href='/third-affiliate'>c</a><a href='/creators'>Creators</a><a href='/r'><b>refer a friend</b></a>")
    df = B.table(spark, d, "pages").select("page_id", "url", F.concat("html", F.lit(tail)).alias("html"))
    ids = df.select("page_id", F.col("url").alias("__u"))
    out = C.programme_links(df).drop("at")
    return out.join(ids, F.col("url") == F.col("__u")).select("page_id", "strength", "target").distinct()


@query("c23_unknown_hosts", (), """
SELECT 'cdn.thing.example' AS host, count(*) FILTER (WHERE page_id % 4 = 2) AS n FROM pages""")
def c23(spark, d):
    return C.unknown_hosts(_tagged(spark, d))


# --- scalars ----------------------------------------------------------------

@query("f01_norm_key", (), """
SELECT doc_id, md5(replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'ß', 'ss')) AS v FROM documents""")
def f01(spark, d):
    return B.table(spark, d, "documents").select("doc_id", F.md5(S.norm_key(F.col("text"))).alias("v"))


@query("f02_product_key", (), """
SELECT page_id, lower(regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '[^/]*$')) AS v FROM pages""")
def f02(spark, d):
    return B.table(spark, d, "pages").select("page_id", S.product_key(F.col("url")).alias("v"))


@query("f03_slugify", (), """
SELECT doc_id, md5(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS v FROM documents""")
def f03(spark, d):
    return B.table(spark, d, "documents").select("doc_id", F.md5(S.slugify(F.col("text"))).alias("v"))


@query("f04_alnum", (), """
SELECT doc_id, md5(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g')) AS v FROM documents""")
def f04(spark, d):
    return B.table(spark, d, "documents").select("doc_id", F.md5(S.alnum(F.col("text"))).alias("v"))


@query("f05_part_number", (), "SELECT p_partkey AS k, p_partkey % 3 = 0 AS v FROM part")
def f05(spark, d):
    return _read(spark, d, f"CASE p_partkey % 3 WHEN 0 THEN ' A' || {K('p_partkey')} || '-CHOICE_ZL ' WHEN 1 THEN 'Jet Black' ELSE 'ABC-DEF' END", S.is_part_number)


@query("f06_names_and_sizes", (), """
SELECT p_partkey AS k, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS STRING) || 'L' ELSE CAST(p_size AS STRING) || '.5L' END AS label FROM part""")
def f06(spark, d):
    df = _part(spark, d, t=f"p_name || CASE WHEN p_partkey % 2 = 0 THEN ' ' || {K('p_size')} || 'L & 58L' ELSE ': 3L, 5L or ' || {K('p_size')} || ' litres' END",
               v="CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS DOUBLE) ELSE p_size + CAST(0.5 AS DOUBLE) END")
    return df.select("k", S.name_without_volumes(F.col("t")).alias("name"), S.size_label(F.col("v")).alias("label"))


@query("f07_id_split", "bag", "SELECT id, brand_slug AS brand, 'm' || CAST(pk AS STRING) AS model FROM bag")
def f07(spark, d):
    return B.bags(spark, d).select("id", S.id_brand(F.col("id")).alias("brand"), S.id_model(F.col("id")).alias("model"))


@query("f08_hosts", (), """
WITH h AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS h, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS p FROM pages)
SELECT page_id, regexp_replace(h, '^www\\.', '') AS host, regexp_extract(h, '[^.]+\\.[^.]+$') AS registrable,
 regexp_replace(lower(regexp_extract(regexp_replace(p, '/+$', ''), '[^/]*$')), '[^a-z0-9]+', '', 'g') AS handle FROM h""")
def f08(spark, d):
    return B.table(spark, d, "pages").select(
        "page_id", S.host(F.col("url")).alias("host"), S.registrable(S.host(F.col("url"))).alias("registrable"), S.url_handle(F.col("url")).alias("handle"))


@query("f09_store_grams", (), """
SELECT p_partkey AS k, CAST(CASE p_partkey % 3 WHEN 0 THEN CASE WHEN p_size <= 7 THEN p_size * 1000 END WHEN 1 THEN 60 + p_partkey % 4000 END AS INT) AS v FROM part""")
def f09(spark, d):
    # figures up to 20 are kilograms; 21 to 49 grams are implausible
    df = _part(spark, d, t=f"CASE p_partkey % 3 WHEN 0 THEN CASE WHEN p_size < 8 THEN {K('p_size')} ELSE '9.5' END WHEN 1 THEN {K('60 + p_partkey % 4000')} ELSE '0' END")
    return df.select("k", S.store_grams(F.col("t")).alias("v"))


@query("f10_minor_unit_price", (), """
SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN (p_partkey + 100) / 100 WHEN 1 THEN p_partkey + 100 END::DOUBLE AS v FROM part""")
def f10(spark, d):
    df = _part(spark, d, t=f"CASE WHEN p_partkey % 3 < 2 THEN {K('p_partkey + 100')} ELSE 'n/a' END", m="CASE p_partkey % 3 WHEN 1 THEN 0 ELSE NULL END")
    return df.select("k", S.minor_unit_price(F.col("t"), F.col("m")).alias("v"))


@query("f11_densities", "bag", """
SELECT id, weight_g / volume_l AS gpl, price_min / volume_l AS ppl, CASE WHEN price_max > price_min THEN 1.0::DOUBLE - price_min / price_max END AS off FROM bag""")
def f11(spark, d):
    return B.bags(spark, d).select("id", S.grams_per_litre(F.col("weight_g"), F.col("volume_l")).alias("gpl"),
                                   S.price_per_litre(F.col("price_min"), F.col("volume_l")).alias("ppl"),
                                   S.discount(F.col("price_min"), F.col("price_max")).alias("off"))


@query("f12_display_forms", "bag", """
SELECT id, CASE WHEN weight_g >= 1000 THEN printf('%.2f', weight_g / 1000 + CASE WHEN weight_g % 125 = 0 THEN 0.000001 ELSE 0 END) || ' kg' ELSE CAST(weight_g AS STRING) || ' g' END AS weight,
 CASE WHEN d3 IS NOT NULL THEN CAST(CAST(d1 AS DECIMAL(18,1)) AS STRING) || ' × ' || CAST(CAST(d2 AS DECIMAL(18,1)) AS STRING) || ' × ' || CAST(CAST(d3 AS DECIMAL(18,1)) AS STRING) || ' cm'
  WHEN d1 IS NOT NULL THEN CAST(CAST(d1 AS DECIMAL(18,1)) AS STRING) || ' × ' || CAST(CAST(d2 AS DECIMAL(18,1)) AS STRING) || ' cm' END AS dims,
 CASE WHEN price_min IS NULL THEN '—' ELSE CASE currency WHEN 'GBP' THEN '£' WHEN 'EUR' THEN '€' ELSE '$' END ||
  CASE WHEN price_min = floor(price_min) THEN CAST(CAST(price_min AS BIGINT) AS STRING) ELSE CAST(CAST(price_min AS DECIMAL(18,2)) AS STRING) END END AS price FROM bag""")
def f12(spark, d):
    return B.bags(spark, d).select("id", S.weight_text(F.col("weight_g")).alias("weight"), S.dims_text(F.col("dims_cm")).alias("dims"),
                                   S.price_text(F.col("price_min"), F.col("currency")).alias("price"))


@query("f13_to_utc", "bag", """
SELECT id, CAST(replace(updated_at, '+02:00', '') AS TIMESTAMP) - INTERVAL 2 HOUR AS v FROM bag""")
def f13(spark, d):
    return B.bags(spark, d).select("id", S.to_utc(F.col("updated_at")).alias("v"))


@query("f14_email_digest", "subscription", "SELECT id, sha256(lower(trim(email))) AS v FROM subscription")
def f14(spark, d):
    return B.view(spark, d, "subscription").select("id", S.email_digest(F.col("email")).alias("v"))


@query("f15_thumb_url", (), """
SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN 'https://cdn.shopify.com/s/' || CAST(p_partkey AS STRING) || '.jpg?v=3&width=96' ELSE
 'https://img.example.com/' || CAST(p_partkey AS STRING) || '.jpg?width=9' END AS v FROM part""")
def f15(spark, d):
    return _read(spark, d, f"""CASE WHEN p_partkey % 2 = 0 THEN 'https://cdn.shopify.com/s/' || {K('p_partkey')} || '.jpg?height=5&v=3&width=900'
      ELSE 'https://img.example.com/' || {K('p_partkey')} || '.jpg?width=9' END""", S.thumb_url)


@query("f16_alias", (), """
SELECT p_partkey AS k, CASE p_name WHEN 'red widget' THEN 'Red Widget Works' ELSE p_name END AS v FROM part""")
def f16(spark, d):
    from ..operators.brands import canonical
    return _read(spark, d, "' ' || replace(p_name, ' ', '  ')", lambda c: canonical(c, {"red widget": "Red Widget Works"}))


@query("f17_labels", "bag", """
SELECT id, CASE category WHEN 'daypack' THEN 'Daypack' WHEN 'pouch' THEN 'Pouch' WHEN 'travel-backpack' THEN 'Travel pack' WHEN 'luggage' THEN 'Luggage'
 WHEN 'duffel' THEN 'Duffel' ELSE 'Sling' END AS v FROM bag""")
def f17(spark, d):
    return B.bags(spark, d).select("id", S.labelled(X.CATEGORY_LABELS, F.col("category")).alias("v"))


@query("f18_cleaning", (), """
SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN 'https://maker' || CAST(p_partkey AS STRING) || '.example.com/' WHEN 1 THEN 'https://shop.example.com/' || repeat('p', 300) || CAST(p_partkey AS STRING) END AS url, p_name AS name,
 p_partkey % 2 = 0 AS ok FROM part""")
def f18(spark, d):
    df = _part(spark, d, u=f"CASE p_partkey % 3 WHEN 0 THEN ' maker' || {K('p_partkey')} || '.example.com ' WHEN 1 THEN 'shop.example.com/' || repeat('p', 300) || {K('p_partkey')} ELSE CASE WHEN p_partkey % 2 = 0 THEN 'nothing' ELSE 'http://x y.com' END END",
               n="'  ' || replace(p_name, ' ', '   ')", e="CASE WHEN p_partkey % 2 = 0 THEN 'a@b.co' ELSE 'a@b' END")
    return df.select("k", S.storefront_url(F.col("u")).alias("url"), S.clean_text(F.col("n"), 80).alias("name"), S.valid_email(F.col("e")).alias("ok"))
