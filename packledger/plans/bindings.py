"""The shared tables as views over a plain star schema.

Every view is a list of expressions that read the same in Spark SQL and in ANSI
SQL engines, so the same rows can be asked for on both sides.  List-valued
columns are carried as comma-separated text (``*_csv``) and opened by
:func:`bags`.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

S = "CAST({} AS STRING)".format
BRAND = "'brand-' || " + S("({k}) % 25")
ID = BRAND + " || '__m' || " + S("{k}")
POS = ("l_orderkey * 100000000 + l_suppkey * 1000 + l_linenumber * 100"
       " + CAST(l_quantity AS BIGINT)")


def _id(k: str) -> str:
    return ID.format(k=k)


def _flags(*pairs: tuple[str, str]) -> str:
    return " || ".join(f"CASE WHEN {test} THEN '{name},' ELSE '' END" for test, name in pairs)


VIEWS = {
    "bag": ("part", {
        "pk": "p_partkey", "ord": "p_partkey", "id": _id("p_partkey"),
        "brand": "'Brand ' || " + S("p_partkey % 25"), "brand_slug": BRAND.format(k="p_partkey"),
        "name": "p_name || ' ' || " + S("p_partkey % 40"),
        "slug": "replace(p_name, ' ', '-') || '-' || " + S("p_partkey % 40"),
        "category": "CASE p_type WHEN 'ECONOMY' THEN 'daypack' WHEN 'SMALL' THEN 'pouch' "
                    "WHEN 'STANDARD' THEN 'travel-backpack' WHEN 'LARGE' THEN 'luggage' "
                    "WHEN 'MEDIUM' THEN 'duffel' ELSE 'sling' END",
        "url": "'https://' || " + BRAND.format(k="p_partkey")
               + " || '.example.com/products/' || replace(p_name, ' ', '-') || '-' || "
               + S("p_partkey"),
        "image": "'https://img.example.com/' || " + S("p_partkey") + " || '.jpg'",
        "volume_l": "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END",
        "volume_source": "CASE p_partkey % 3 WHEN 0 THEN 'title' WHEN 1 THEN 'product-page' "
                         "ELSE 'description' END",
        "weight_g": "CASE WHEN p_partkey % 11 = 0 THEN NULL "
                    "ELSE CAST((p_partkey * 37) % 2400 + 50 AS INT) END",
        "weight_source": "CASE p_partkey % 3 WHEN 0 THEN 'shopify:grams' "
                         "WHEN 1 THEN 'product-page' ELSE 'table' END",
        "d1": "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(20 + p_partkey % 45 AS DOUBLE) END",
        "d2": "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(15 + p_partkey % 25 AS DOUBLE) END",
        "d3": "CASE WHEN p_partkey % 5 = 0 OR p_partkey % 13 = 0 THEN NULL "
              "ELSE CAST(5 + p_partkey % 20 AS DOUBLE) END",
        "dims_source": "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 'description:cm' END",
        "laptop_in": "CASE p_partkey % 6 WHEN 0 THEN CAST(13 AS DOUBLE) WHEN 1 THEN "
                     "CAST(14 AS DOUBLE) WHEN 2 THEN CAST(15.6 AS DOUBLE) WHEN 3 THEN "
                     "CAST(16 AS DOUBLE) WHEN 4 THEN CAST(17 AS DOUBLE) ELSE NULL END",
        "price_min": "CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_retailprice END",
        "price_max": "CASE WHEN p_partkey % 17 = 0 THEN NULL "
                     "ELSE p_retailprice + (p_partkey % 3) * 10 END",
        "currency": "CASE p_partkey % 25 WHEN 3 THEN 'GBP' WHEN 7 THEN 'EUR' ELSE 'USD' END",
        "currency_source": "CASE p_partkey % 25 WHEN 3 THEN 'feed' WHEN 7 THEN 'locale' "
                           "WHEN 9 THEN 'roster' ELSE 'assumed' END",
        "price_usd_approx": "CASE WHEN p_partkey % 17 <> 0 AND p_partkey % 25 IN (3, 7) "
                            "THEN p_retailprice * 1.25 ELSE NULL END",
        "price_market": "'default'",
        "on_sale": "p_partkey % 4 = 0", "in_stock": "p_partkey % 5 <> 1",
        "features_csv": _flags(("p_partkey % 2 = 0", "laptop_sleeve"), ("p_partkey % 3 = 0", "rfid"),
                               ("p_partkey % 5 = 2", "hip_belt"), ("p_partkey % 7 = 3", "molle")),
        "materials_csv": _flags(("p_partkey % 4 = 1", "Nylon"), ("p_partkey % 3 = 1", "Canvas"),
                                ("p_partkey % 9 = 2", "Leather")),
        "families_csv": _flags(("p_partkey % 3 = 0", "black"), ("p_partkey % 4 = 0", "green"),
                               ("p_partkey % 10 = 7", "blue")),
        "colors_csv": _flags(("p_partkey % 3 = 0", "Jet Black"),
                             ("p_partkey % 4 = 0", "Forest Green"),
                             ("p_partkey % 10 = 7", "Atlantic")),
        "tags_csv": _flags(("p_partkey % 6 = 1", "commute"), ("p_partkey % 8 = 5", "trail")),
        "features_source": "CASE WHEN p_partkey % 3 = 0 THEN 'product-page' "
                           "ELSE 'description' END",
        "variant_count": "CAST(p_partkey % 7 AS INT)",
        "merged_from": "CAST(1 + p_partkey % 2 AS INT)",
        "split_from": "CASE WHEN p_partkey % 20 IN (3, 8, 13) THEN "
                      + BRAND.format(k="p_partkey - p_partkey % 5 + 3") + " || '__line' || "
                      + S("p_partkey - p_partkey % 20") + " ELSE NULL END",
        "legacy_slug": "CASE WHEN p_partkey % 20 = 3 THEN replace(p_name, ' ', '-') || '-' || "
                       + S("(p_partkey + 1) % 40") + " ELSE NULL END",
        "source": "CASE p_partkey % 4 WHEN 0 THEN 'shopify:products.json' "
                  "WHEN 1 THEN 'woocommerce:store-api' WHEN 2 THEN 'aggregator:jsonld' "
                  "ELSE 'pages:crawl' END",
        "updated_at": "'2026-07-' || lpad(" + S("1 + p_partkey % 28")
                      + ", 2, '0') || 'T10:00:00+02:00'",
        "vendor": "p_brand",
    }),
    "variant": ("lineitem", {
        "pk": "l_partkey", "bag_id": _id("l_partkey"), "pos": POS,
        "sku": "CASE WHEN l_suppkey % 10 = 9 THEN NULL ELSE 'S' || " + S("l_suppkey") + " END",
        "variant_id": "l_orderkey * 10 + l_linenumber",
        "color": "CASE l_returnflag WHEN 'A' THEN 'Jet Black' WHEN 'N' THEN 'Forest Green' "
                 "ELSE NULL END",
        "color_family": "CASE l_returnflag WHEN 'A' THEN 'black' WHEN 'N' THEN "
                        "CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE 'green' END ELSE NULL END",
        "size": "CASE l_partkey % 3 WHEN 0 THEN " + S("20 + 10 * (l_linenumber % 3)")
                + " || 'L' WHEN 1 THEN 'Medium' ELSE NULL END",
        "title": "'Style ' || " + S("l_suppkey % 4"),
        "price": "l_extendedprice",
        "compare_at": "CASE WHEN l_discount > 0.05 THEN l_extendedprice * 1.25 ELSE NULL END",
        "available": "l_linestatus = 'O'",
        "grams": "CAST(CASE WHEN l_partkey % 2 = 0 THEN 300 + l_suppkey % 900 ELSE NULL END AS INT)",
        "barcode": S("l_orderkey"),
        "image": "'https://img.example.com/' || " + S("l_partkey") + " || '-' || "
                 + S("l_suppkey % 5") + " || '.jpg'",
    }),
    "ledger": ("lineitem", {
        "ts": "l_shipdate", "ord": POS, "pk": "l_partkey", "bag_id": _id("l_partkey"),
        "brand": "'Brand ' || " + S("l_partkey % 25"),
        "sku": "CASE WHEN l_suppkey % 10 = 9 THEN NULL ELSE 'S' || " + S("l_suppkey") + " END",
        "color": "CASE l_returnflag WHEN 'A' THEN 'Jet Black' WHEN 'N' THEN 'Forest Green' "
                 "ELSE NULL END",
        "price": "CASE WHEN l_quantity = 7 THEN NULL ELSE l_extendedprice END",
        "prev_price": "CASE WHEN l_linenumber = 7 THEN NULL "
                      "ELSE l_extendedprice + (l_linenumber - 4) * 16 END",
        "rebased": "l_quantity = 11",
        "direction": "CASE WHEN l_linenumber = 7 OR l_quantity IN (7, 11) THEN NULL "
                     "WHEN l_linenumber > 4 THEN 'down' ELSE 'up' END",
        "delta": "CASE WHEN l_linenumber = 7 OR l_quantity IN (7, 11) THEN NULL "
                 "ELSE CAST((4 - l_linenumber) * 16 AS DOUBLE) END",
    }),
    "observation": ("lineitem", {
        "ts": "l_shipdate", "ord": POS,
        "key": _id("l_partkey") + " || '::S' || " + S("l_suppkey"),
        "bag_id": _id("l_partkey"), "sku": "'S' || " + S("l_suppkey"),
        "brand": "'Brand ' || " + S("l_partkey % 25"),
        "price": "CASE WHEN l_quantity = 7 THEN NULL ELSE "
                 "CAST((l_partkey * 3 + l_suppkey) % 500 + l_linenumber % 3 * 10 AS DOUBLE) END",
        "compare_at": "CASE WHEN l_discount > 0.08 THEN CAST(900 AS DOUBLE) ELSE NULL END",
        "available": "l_linestatus = 'O'",
        "basis": "CASE WHEN l_shipdate >= DATE '1999-01-01' AND l_partkey % 10 = 1 "
                 "THEN 'EUR@default' ELSE 'USD@default' END",
    }),
    "fetch_log": ("orders", {
        "night": "o_orderdate", "ord": "o_orderkey", "slug": BRAND.format(k="o_custkey"),
        "status": "CASE o_orderstatus WHEN 'O' THEN 'ok' WHEN 'F' THEN 'http_500' ELSE "
                  "CASE WHEN o_custkey % 25 = 4 THEN 'todo' ELSE 'rate_limited' END END",
        "platform": "CASE o_custkey % 25 WHEN 4 THEN 'todo' WHEN 5 THEN 'retired' "
                    "ELSE 'shopify' END",
        "product_count": "CAST(CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus <> 'O' THEN 0 "
                         "ELSE floor(o_totalprice / 1000) END AS INT)",
        "elapsed_s": "CAST((o_custkey * 7 + o_orderkey) % 600 AS DOUBLE)",
        "fetched_at": "o_orderdate",
        "fail_streak": "CAST(o_orderkey % 14 AS INT)",
    }),
    "subscription": ("customer", {
        "id": "c_custkey", "email": "c_name || '@Example.com'",
        "watch_bag": "CASE WHEN c_custkey % 3 = 0 THEN " + _id("c_custkey")
                     + " WHEN c_custkey % 60 = 4 THEN "
                     + BRAND.format(k="c_custkey - c_custkey % 5 + 3") + " || '__line' || "
                     + S("c_custkey - c_custkey % 20") + " ELSE NULL END",
        "watch_brand": "CASE WHEN c_custkey % 3 = 1 AND c_custkey % 60 <> 4 THEN "
                       + BRAND.format(k="c_custkey") + " ELSE NULL END",
        "max_price": "CASE WHEN c_custkey % 4 = 0 THEN CAST(50000 AS DOUBLE) ELSE NULL END",
        "confirmed_at": "CASE WHEN c_acctbal > 0 THEN TIMESTAMP '1998-01-01 00:00:00' "
                        "ELSE NULL END",
        "confirm_sent_at": "CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN "
                           "TIMESTAMP '2001-05-31 23:50:00' ELSE "
                           "TIMESTAMP '2001-05-31 12:00:00' END",
        "confirm_token": "'c' || " + S("c_custkey"), "unsub_token": "'u' || " + S("c_custkey"),
    }),
    "sent": ("orders", {
        "id": "o_orderkey", "subscription_id": "o_custkey",
        "bag_id": _id("o_custkey"), "split_from": "CAST(NULL AS STRING)",
        "sent_at": "o_orderdate",
    }),
    "mail_send": ("orders", {
        "id": "o_orderkey", "provider_id": "'p' || " + S("o_orderkey"),
        "kind": "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'confirm' "
                "ELSE 'alert' END",
        "subscription_id": "o_custkey", "sent_at": "o_orderdate",
    }),
    "mail_event": ("lineitem", {
        "svix_id": "'s' || " + S("l_orderkey * 10 + l_linenumber"),
        "provider_id": "CASE WHEN l_linenumber = 7 THEN NULL ELSE 'p' || " + S("l_orderkey") + " END",
        "type": "CASE l_linenumber WHEN 1 THEN 'email.delivered' WHEN 2 THEN 'email.opened' "
                "WHEN 3 THEN 'email.bounced' WHEN 4 THEN 'email.complained' WHEN 5 THEN "
                "'email.clicked' ELSE 'email.delivered' END",
        "received_at": "l_shipdate", "ord": POS + " + l_partkey * 10000000000000",
        "bounce_type": "CASE WHEN l_linenumber = 3 THEN CASE WHEN l_suppkey % 2 = 0 THEN "
                       "'Transient' ELSE 'Permanent' END ELSE NULL END",
        "bounce_subtype": "CASE WHEN l_linenumber = 3 THEN 'General' ELSE NULL END",
        "recipient": "' User' || " + S("l_partkey % 700") + " || '@Example.com '",
        "payload": "'{\"subject\":\"Drop ' || " + S("l_partkey")
                   + " || '\",\"bounce\":{\"type\":\"T' || " + S("l_suppkey")
                   + " || '\",\"subType\":\"General\"}}'",
    }),
    "raw_click": ("events", {
        "event_id": "event_id", "created_at": "ts",
        "name": "CASE event_type WHEN 'view' THEN ' product_view ' WHEN 'click' THEN 'buy_click' "
                "WHEN 'purchase' THEN 'brand_click' ELSE event_type END",
        "brand": BRAND.format(k="user_id"),
        "bag_id": "CASE WHEN event_id % 9 = 0 THEN '' ELSE " + _id("(user_id * 7) % 40") + " END",
        "placement": "CASE event_id % 6 WHEN 0 THEN 'product_page' WHEN 1 THEN 'offers_table' "
                     "WHEN 2 THEN 'variant_row' WHEN 3 THEN 'browse_overlay' "
                     "WHEN 4 THEN 'sidebar' ELSE NULL END",
        "seller": "'seller-' || " + S("(user_id * 3 + event_id) % 30"),
        "model": "'Model ' || " + S("(user_id * 7) % 40"),
        "price": "CASE WHEN event_id % 31 = 0 THEN CAST(-1 AS DOUBLE) ELSE value END",
        "user_agent": "CASE WHEN event_id % 50 = 0 THEN 'ExampleBot/1.0 crawler' "
                      "ELSE 'Mozilla/5.0' END",
        "user_id": "user_id",
    }),
    "pageview": ("events", {
        "ts": "ts", "visitor": "user_id",
        "route": "CASE event_id % 4 WHEN 0 THEN '/' WHEN 1 THEN '/sale/' ELSE "
                 "'/bags/brand/' || " + S("user_id % 20") + " || '/' END",
        "referrer": "CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'search.example.com' "
                    "ELSE 'news.example.org' END",
    }),
    "request": ("events", {
        "id": "event_id", "created_at": "ts",
        "name": "CASE WHEN event_id % 2 = 0 THEN 'Maker ' || " + S("event_id % 60")
                + " ELSE ' MAKER ' || " + S("event_id % 60") + " END",
        "url": "CASE WHEN event_id % 3 = 0 THEN 'https://maker' || " + S("event_id % 60")
               + " || '.example.com/' ELSE NULL END",
        "email": "CASE WHEN event_id % 4 = 0 THEN 'reader' || " + S("user_id")
                 + " || '@example.com' ELSE NULL END",
        "ip_hash": "'ip' || " + S("user_id % 40") + " || '-' || substring(" + S("ts") + ", 1, 10)",
    }),
    "attempt": ("events", {
        "ts": "ts", "ord": "event_id", "brand_slug": BRAND.format(k="user_id"),
        "page_key": _id("user_id"), "disallowed": "event_id % 97 = 0",
        "status": "CASE event_type WHEN 'error' THEN 503 WHEN 'purchase' THEN 404 "
                  "WHEN 'signup' THEN 429 ELSE 200 END",
    }),
}

# Columns that Spark computes in wider numbers than the SQL texts do: the same values, where the
# texts' own would overflow 64 bits on larger tables.
WIDE = {
    "mail_event": {"ord": f"CAST({POS} AS DECIMAL(20, 0)) + CAST(l_partkey AS DECIMAL(20, 0))"
                          " * CAST(10000000000000 AS DECIMAL(14, 0))"},
}

# --- invented carriers (fixed values): name, region, carry-on, linear rule, personal item
AIRLINES = [
    ("Northwind Air", "americas", (56, 36, 23), None, (45, 35, 20)),
    ("Bluebird", "europe", (55, 40, 20), None, (40, 25, 20)),
    ("Cirrus Lines", "europe", (55, 38, 23), 115, None),
    ("Delta Crane", "asia-pacific-me", None, 118, (40, 30, 15)),
    ("Easterly", "asia-pacific-me", (50, 37, 25), None, None),
    ("Foxglove", "americas", (61, 41, 28), None, (46, 36, 20)),
    ("Gannet", "europe", (40, 30, 20), None, (40, 30, 20)),
    ("Harbour", "americas", None, None, (43, 33, 16)),
]
# units of a currency that one dollar buys (fixed values for the test views)
RATES = [("USD", 1.0), ("GBP", 0.8), ("EUR", 0.925), ("SEK", 10.5)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view_columns(name: str) -> list[str]:
    """A view's columns as Spark SQL expressions over its table."""
    return [f"{e} AS {c}" for c, e in {**VIEWS[name][1], **WIDE.get(name, {})}.items()]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views, straight from its table."""
    return table(spark, sf_dir, VIEWS[name][0]).selectExpr(*view_columns(name))


def bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bag view with lists and dimensions opened."""
    opened = {new: F.filter(F.split(old, ","), lambda v: v != "") for new, old in (
        ("features", "features_csv"), ("materials", "materials_csv"),
        ("color_families", "families_csv"), ("colors", "colors_csv"), ("tags", "tags_csv"))}
    dims = F.when(F.col("d3").isNotNull(), F.array("d1", "d2", "d3")).when(
        F.col("d1").isNotNull(), F.array("d1", "d2"))
    df = view(spark, sf_dir, "bag").withColumns(opened).withColumn("dims_cm", dims)
    return df.withColumn("linear_cm", F.col("d1") + F.col("d2") + F.coalesce("d3", F.lit(0.0))) \
        .drop("features_csv", "materials_csv", "families_csv", "colors_csv", "tags_csv") \
        .withColumn("sizes", F.array().cast("array<string>"))


def mail_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "mail_event").withColumn("recipients", F.array("recipient")).drop(
        "recipient")


def airlines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(n, r, list(c) if c else None, lin, list(p) if p else None)
         for n, r, c, lin, p in AIRLINES],
        "name string, region string, carry_on_cm array<int>, carry_on_linear_cm int, "
        "personal_cm array<int>")


def rates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RATES, "currency string, per_usd double")


# --- the same views as SQL --------------------------------------------------

def _cte(name: str) -> str:
    base, cols = VIEWS[name]
    inner = f"SELECT {', '.join(f'{e} AS {c}' for c, e in cols.items())} FROM {base}"
    if name != "bag":
        return inner
    lists = {"features": "features_csv", "materials": "materials_csv",
             "color_families": "families_csv", "colors": "colors_csv", "tags": "tags_csv"}
    opened = ", ".join(f"[x FOR x IN string_split({old}, ',') IF x <> ''] AS {new}"
                       for new, old in lists.items())
    return (f"SELECT *, {opened}, d1 + d2 + coalesce(d3, 0) AS linear_cm, "
            "CASE WHEN d3 IS NOT NULL THEN [d1, d2, d3] WHEN d1 IS NOT NULL THEN [d1, d2] END "
            f"AS dims_cm FROM ({inner}) b")


def _airline_cte() -> str:
    def lit(v):
        return "NULL" if v is None else f"CAST({v} AS DOUBLE)"
    rows = []
    for n, r, c, lin, p in AIRLINES:
        c = sorted(c, reverse=True) if c else (None,) * 3
        p = sorted(p, reverse=True) if p else (None,) * 3
        rows.append(f"('{n}', '{n.lower().replace(' ', '-')}', '{r}', "
                    + ", ".join(lit(v) for v in (*c, lin, *p)) + ")")
    return ("SELECT * FROM (VALUES " + ", ".join(rows)
            + ") t(name, airline, region, c1, c2, c3, lin, p1, p2, p3)")


def sql(body: str, *names: str) -> str:
    """A query over the named views, as one SQL text."""
    parts = []
    for n in names:
        if n == "airline":
            parts.append(f"airline AS ({_airline_cte()})")
        elif n == "rate":
            rows = ", ".join(f"('{c}', CAST({v} AS DOUBLE))" for c, v in RATES)
            parts.append(f"rate AS (SELECT * FROM (VALUES {rows}) t(currency, per_usd))")
        else:
            parts.append(f"{n} AS ({_cte(n)})")
    text = body.strip()
    if not parts:
        return text
    if text[:5].upper() == "WITH ":
        return "WITH " + ", ".join(parts) + ", " + text[5:]
    return "WITH " + ", ".join(parts) + " " + text
