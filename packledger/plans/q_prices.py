"""Queries over the price log (variants, ledger and observations)."""
from pyspark.sql import functions as F

from ..operators import prices as P
from . import bindings as B
from .registry import query

SINCE = "2001-06-01 00:00:00"
SPLIT = "1999-06-01"
NOW = "2001-12-01 00:00:00"


def _ledger(spark, d):
    return B.view(spark, d, "ledger")


def _variants(spark, d):
    return B.view(spark, d, "variant")


def _moves(spark, d):
    return P.moves_since(_ledger(spark, d), SINCE)


@query("p01_ambiguous_skus", "variant", """
SELECT bag_id, sku, count(*) AS n FROM variant WHERE sku IS NOT NULL
GROUP BY bag_id, sku HAVING count(*) > 1""")
def p01(spark, d):
    return P.ambiguous(_variants(spark, d))


KEYED = """
twice AS (SELECT bag_id, sku FROM variant WHERE sku IS NOT NULL
          GROUP BY bag_id, sku HAVING count(*) > 1),
keyed AS (SELECT v.*, CASE WHEN v.sku IS NOT NULL AND t.sku IS NULL THEN v.bag_id || '::' || v.sku
   ELSE v.bag_id || '::#' || CAST(v.pos AS STRING) || ':' || coalesce(v.color, v.title) END AS key
   FROM variant v LEFT JOIN twice t ON v.bag_id = t.bag_id AND v.sku = t.sku)"""


@query("p02_variant_key", "variant", f"""
WITH {KEYED} SELECT bag_id, pos, key FROM keyed""")
def p02(spark, d):
    return P.variant_key(_variants(spark, d)).select("bag_id", "pos", "key")


def _snapshots(spark, d):
    """The last observation of each key before a day (state) and overall (current)."""
    obs = B.view(spark, d, "observation")
    last = lambda df: df.groupBy("key").agg(F.max_by(F.struct(
        "bag_id", "sku", "brand", "price", "compare_at", "available", "basis", "ts"),
        F.struct("ts", "ord")).alias("o")).select("key", "o.*")
    before = last(obs.where(F.col("ts") < F.lit(SPLIT).cast("timestamp_ntz"))).select(
        "key", "price", "compare_at", "available", "basis", F.col("ts").alias("first_seen"),
        F.col("price").alias("low"), F.col("ts").alias("last_change"))
    now = last(obs).withColumn("split_from", F.lit(None).cast("string")).withColumn(
        "color", F.lit(None).cast("string"))
    return now, before


SNAP = f"""
ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, ord DESC) AS rn
           FROM observation),
cur AS (SELECT * FROM ranked WHERE rn = 1),
ranked2 AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, ord DESC) AS rn
            FROM observation WHERE ts < TIMESTAMP '{SPLIT} 00:00:00'),
old AS (SELECT * FROM ranked2 WHERE rn = 1),
both_ AS (SELECT c.key, c.bag_id, c.price, c.compare_at, c.available, c.basis,
  o.key IS NOT NULL AS seen, coalesce(o.basis <> c.basis, FALSE) AS rebased,
  o.price AS oprice, o.ts AS ots,
  o.key IS NOT NULL AND o.basis = c.basis AND o.price IS NOT DISTINCT FROM c.price
  AND o.compare_at IS NOT DISTINCT FROM c.compare_at AND o.available = c.available AS same
  FROM cur c LEFT JOIN old o ON c.key = o.key),
diff AS (SELECT key, bag_id, price, compare_at, available, basis, rebased,
  CASE WHEN NOT rebased THEN oprice END AS prev_price, seen AND NOT rebased AS is_change,
  CASE WHEN NOT rebased THEN ots END AS ots,
  CASE WHEN NOT rebased AND oprice <> 0 AND price <> 0 THEN price - oprice END AS delta
  FROM both_ WHERE NOT same)"""
ROW = ["key", "bag_id", "price", "compare_at", "available", "basis", "rebased", "prev_price",
       "delta", "direction", "is_change"]


def _diff(spark, d):
    now, before = _snapshots(spark, d)
    return P.diff_state(now, before, NOW), before, now


@query("p04_diff_state", "observation", f"""
WITH {SNAP} SELECT key, bag_id, price, compare_at, available, basis, rebased, prev_price, delta,
  CASE WHEN delta < 0 THEN 'down' WHEN delta IS NOT NULL THEN 'up' END AS direction, is_change
FROM diff""")
def p04(spark, d):
    return _diff(spark, d)[0].select(*ROW)


@query("p05_rebased", "observation", f"""
WITH {SNAP} SELECT key, price, basis FROM diff WHERE rebased""")
def p05(spark, d):
    return _diff(spark, d)[0].where("rebased").select("key", "price", "basis")


@query("p06_direction", "observation", f"""
WITH {SNAP}, x AS (SELECT CASE WHEN delta < 0 THEN 'down' WHEN delta IS NOT NULL THEN 'up' END
  AS direction, delta FROM diff)
SELECT direction, count(*) AS n, min(delta) AS least, max(delta) AS most FROM x GROUP BY 1""")
def p06(spark, d):
    return _diff(spark, d)[0].groupBy("direction").agg(
        F.count(F.lit(1)).alias("n"), F.min("delta").alias("least"), F.max("delta").alias("most"))


@query("p07_upsert_state", "observation", f"""
WITH {SNAP},
fresh AS (SELECT key, price, compare_at, available, basis,
  coalesce(ots, TIMESTAMP '{NOW}') AS first_seen,
  coalesce(least(nullif(price, 0), nullif(prev_price, 0)), price) AS low,
  TIMESTAMP '{NOW}' AS last_change FROM diff)
SELECT * FROM fresh UNION ALL
SELECT o.key, o.price, o.compare_at, o.available, o.basis, o.ts, o.price, o.ts FROM old o
WHERE o.key NOT IN (SELECT key FROM fresh)""")
def p07(spark, d):
    rows, before, _ = _diff(spark, d)
    return P.upsert_state(rows, before)


@query("p08_forget_brands", "observation", f"""
WITH {SNAP} SELECT key, price FROM old
WHERE split_part(key, '__', 1) NOT IN ('brand-3', 'brand-17')""")
def p08(spark, d):
    _, before = _snapshots(spark, d)
    return P.forget(before, ["brand-3", "brand-17"]).select("key", "price")


ENDS = f"""
w AS (SELECT * FROM ledger WHERE ts >= TIMESTAMP '{SINCE}'),
s AS (SELECT *, sum(CASE WHEN rebased THEN 1 ELSE 0 END) OVER
  (PARTITION BY bag_id, sku, color ORDER BY ts, ord) AS series,
  min(ts) OVER (PARTITION BY bag_id, sku, color) AS seen_ts FROM w),
l AS (SELECT *, max(series) OVER (PARTITION BY bag_id, sku, color) AS last_series FROM s),
ends AS (SELECT bag_id, sku, color,
  first(nullif(prev_price, 0) ORDER BY ts, ord) FILTER (WHERE nullif(prev_price, 0) IS NOT NULL) AS ref,
  last(nullif(price, 0) ORDER BY ts, ord) FILTER (WHERE nullif(price, 0) IS NOT NULL) AS cur
  FROM l WHERE series = last_series GROUP BY bag_id, sku, color),
best AS (SELECT bag_id, min(cur / ref) AS ratio FROM ends WHERE ref <> cur GROUP BY bag_id)"""


@query("p09_net_ends", "ledger", f"WITH {ENDS} SELECT bag_id, sku, color, ref, cur FROM ends")
def p09a(spark, d):
    return P.net_ends(_ledger(spark, d), SINCE).drop("seen")


@query("p09_moves_since", "ledger", f"""
WITH {ENDS} SELECT DISTINCT e.bag_id, CASE WHEN cur < ref THEN 'down' ELSE 'up' END AS direction,
  ref AS previous_price, cur AS price
FROM ends e JOIN best b ON e.bag_id = b.bag_id AND e.cur / e.ref = b.ratio AND e.ref <> e.cur""")
def p09(spark, d):
    return _moves(spark, d)


def _annotated(spark, d):
    now, before = _snapshots(spark, d)
    rows = P.diff_state(now, before, NOW)
    state = P.upsert_state(rows, before)
    bags = B.bags(spark, d)
    return P.annotate(bags, now.drop("ts"), state, _moves(spark, d)), rows, state


ANNOTATED = f"""{SNAP}, {ENDS},
fresh AS (SELECT key, bag_id, price,
  coalesce(least(nullif(price, 0), nullif(prev_price, 0)), price) AS low,
  TIMESTAMP '{NOW}' AS last_change FROM diff),
state AS (SELECT * FROM fresh UNION ALL SELECT key, bag_id, price, price, ts FROM old
  WHERE key NOT IN (SELECT key FROM fresh)),
held AS (SELECT bag_id, min(nullif(price, 0)) AS now_, min(nullif(low, 0)) AS lowest_ever,
  max(last_change) AS price_changed_at FROM state GROUP BY bag_id),
mv AS (SELECT DISTINCT e.bag_id, CASE WHEN cur < ref THEN 'down' ELSE 'up' END AS price_direction,
  ref AS previous_price FROM ends e JOIN best b
  ON e.bag_id = b.bag_id AND e.cur / e.ref = b.ratio AND e.ref <> e.cur),
ann AS (SELECT b.*, h.lowest_ever, h.price_changed_at, m.price_direction, m.previous_price,
  coalesce(h.now_ <= h.lowest_ever, FALSE) AS at_lowest
  FROM bag b LEFT JOIN held h ON b.id = h.bag_id LEFT JOIN mv m ON b.id = m.bag_id)"""


@query("p10_annotate", ("observation", "ledger", "bag"), f"""
WITH {ANNOTATED} SELECT id, lowest_ever, price_changed_at, price_direction, previous_price, at_lowest
FROM ann""")
def p10(spark, d):
    return _annotated(spark, d)[0].select("id", "lowest_ever", "price_changed_at",
                                          "price_direction", "previous_price", "at_lowest")


@query("p11_run_events", ("observation", "ledger", "bag"), f"""
WITH {ANNOTATED} SELECT x.key, x.bag_id, x.price, x.delta,
  CASE WHEN x.delta < 0 THEN 'down' ELSE 'up' END AS direction, a.brand_slug, a.category,
  a.currency, a.split_from, a.lowest_ever, a.at_lowest
FROM diff x LEFT JOIN ann a ON x.bag_id = a.id WHERE x.delta IS NOT NULL""")
def p11(spark, d):
    bags, rows, _ = _annotated(spark, d)
    return P.run_events(rows, bags).select(
        "key", "bag_id", "price", "delta", "direction", "brand_slug", "category", "currency",
        "split_from", "lowest_ever", "at_lowest")


@query("p12_tracking_meta", "observation", f"""
WITH {SNAP} SELECT 'appended' AS metric, count(*) AS value FROM diff UNION ALL
SELECT 'changes', count(*) FROM diff WHERE is_change UNION ALL
SELECT 'rebased', count(*) FROM diff WHERE rebased UNION ALL
SELECT 'tracked', count(*) FROM (SELECT key FROM old UNION SELECT key FROM diff) t""")
def p12(spark, d):
    rows, before, _ = _diff(spark, d)
    return P.tracking_meta(rows, P.upsert_state(rows, before))


def _lined(spark, d):
    """Ledger in which rows before a day still carry the pre-split id."""
    bags = B.bags(spark, d)
    early = F.col("ts") < F.lit(SPLIT).cast("timestamp_ntz")
    parent = bags.select(F.col("id").alias("__id"), F.col("split_from").alias("__from"))
    led = _ledger(spark, d).join(parent, F.col("bag_id") == F.col("__id"), "left")
    led = led.withColumn("bag_id", F.when(early & F.col("__from").isNotNull(), F.col("__from"))
                         .otherwise(F.col("bag_id"))).drop("__id", "__from")
    return led, bags


LINED = f"""
lined AS (SELECT l.* REPLACE (CASE WHEN l.ts < TIMESTAMP '{SPLIT} 00:00:00' AND b.split_from IS NOT NULL
  THEN b.split_from ELSE l.bag_id END AS bag_id) FROM ledger l LEFT JOIN bag b ON l.bag_id = b.id),
hist AS (SELECT bag_id AS owner, ts, sku, price FROM lined UNION ALL
  SELECT b.id, l.ts, l.sku, l.price FROM bag b
  JOIN (SELECT DISTINCT bag_id, sku FROM variant WHERE sku IS NOT NULL) v ON v.bag_id = b.id
  JOIN lined l ON l.bag_id = b.split_from AND l.sku = v.sku)"""


@query("p03_adopt_split", ("observation", "bag"), f"""
WITH {SNAP},
olds AS (SELECT coalesce(b.split_from, o.bag_id) || '::' || o.sku AS key, o.price,
  o.ts, row_number() OVER (PARTITION BY coalesce(b.split_from, o.bag_id), o.sku
  ORDER BY o.ts DESC, o.ord DESC, o.bag_id) AS r FROM old o LEFT JOIN bag b ON o.bag_id = b.id)
SELECT c.key, o1.key IS NULL AND o2.key IS NOT NULL AS adopted, coalesce(o1.price, o2.price) AS prev_price
FROM cur c LEFT JOIN bag b ON c.bag_id = b.id
LEFT JOIN (SELECT * FROM olds WHERE r = 1) o1 ON o1.key = c.key
LEFT JOIN (SELECT * FROM olds WHERE r = 1) o2 ON o1.key IS NULL
  AND o2.key = b.split_from || '::' || c.sku""")
def p03(spark, d):
    obs = B.view(spark, d, "observation")
    split = B.bags(spark, d).select(F.col("id").alias("__id"), "split_from")
    obs = obs.join(split, F.col("bag_id") == F.col("__id"), "left").drop("__id")
    early = obs.where(F.col("ts") < F.lit(SPLIT).cast("timestamp_ntz"))
    old = early.groupBy(F.coalesce("split_from", "bag_id").alias("owner"), "sku").agg(F.max_by(
        F.struct("price", "compare_at", "available", "basis"),
        F.struct("ts", "ord")).alias("o")).select(
        F.concat("owner", F.lit("::"), "sku").alias("key"), "o.*")
    now = obs.groupBy("key").agg(F.max_by(
        F.struct("bag_id", "sku", "split_from"), F.struct("ts", "ord")).alias("o")).select(
        "key", "o.*")
    return P.adopt_split(now, old).select("key", "adopted", F.col("prev.price").alias("prev_price"))


@query("p13_history_rows", ("ledger", "bag", "variant"), f"""
WITH {LINED} SELECT owner, count(*) AS n, count(DISTINCT sku) AS skus, min(price) AS low,
  max(ts) AS last_ts FROM hist GROUP BY owner""")
def p13(spark, d):
    led, bags = _lined(spark, d)
    return P.history_rows(led, bags, _variants(spark, d)).groupBy("owner").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("sku").alias("skus"),
        F.min("price").alias("low"), F.max("ts").alias("last_ts"))


SERIES = """series AS (SELECT bag_id, CAST(ts AS DATE) AS day, min(price) AS price FROM ledger
  WHERE price IS NOT NULL GROUP BY 1, 2)"""


@query("p14_price_series", "ledger", f"WITH {SERIES} SELECT * FROM series")
def p14(spark, d):
    return P.price_series(_ledger(spark, d))


@query("p15_price_changes", "ledger", """
SELECT bag_id, rn, ts, price, direction FROM (SELECT *, row_number() OVER
  (PARTITION BY bag_id ORDER BY ts DESC, ord) AS rn FROM ledger WHERE direction IS NOT NULL) t""")
def p15(spark, d):
    return P.price_changes(_ledger(spark, d)).select(
        "bag_id", F.col("rn").cast("bigint").alias("rn"), "ts", "price", "direction")


@query("p16_price_spans", "ledger", f"""
WITH {SERIES} SELECT bag_id, day AS valid_from, lead(day) OVER (PARTITION BY bag_id ORDER BY day)
  AS valid_to, price FROM series""")
def p16(spark, d):
    return P.price_spans(P.price_series(_ledger(spark, d)))


@query("p16_price_as_of", ("ledger", "bag"), f"""
WITH {SERIES}, asks AS (SELECT b.id AS bag_id, CAST(x.day AS DATE) AS day FROM bag b,
  (VALUES ('1996-03-01'), ('1998-07-15'), ('2001-01-31')) x(day))
SELECT a.bag_id, a.day, s.price FROM asks a ASOF LEFT JOIN series s
  ON a.bag_id = s.bag_id AND a.day >= s.day""")
def p16b(spark, d):
    days = F.explode(F.array(*[F.to_date(F.lit(x)) for x in (
        "1996-03-01", "1998-07-15", "2001-01-31")])).alias("day")
    asks = B.bags(spark, d).select(F.col("id").alias("bag_id"), days)
    return P.price_as_of(P.price_series(_ledger(spark, d)), asks)


@query("p17_history_summary", "ledger", f"""
WITH {SERIES} SELECT bag_id, min(price) AS lowest, max(price) AS highest, count(*) AS changes,
  min(day) AS since FROM series GROUP BY bag_id""")
def p17(spark, d):
    return P.history_summary(P.price_series(_ledger(spark, d)))


@query("p17_tracking_since", "ledger", "SELECT min(ts) AS since FROM ledger")
def p17b(spark, d):
    return P.tracking_since(_ledger(spark, d))


CUT = """cut AS (SELECT bag_id, off, price, was FROM (SELECT bag_id, 1.0::DOUBLE - price / compare_at
  AS off, price, compare_at AS was, row_number() OVER (PARTITION BY bag_id
  ORDER BY 1.0::DOUBLE - price / compare_at DESC, pos) AS rn FROM variant
  WHERE price <> 0 AND compare_at > price) t WHERE rn = 1)"""


@query("p18_deepest_cut", "variant", f"WITH {CUT} SELECT bag_id, off, price, was FROM cut")
def p18(spark, d):
    return P.deepest_cut(_variants(spark, d))


@query("p19_sale_strip", ("observation", "ledger", "bag"), f"""
WITH {ANNOTATED}, f AS (SELECT id, price_min, previous_price, 1.0::DOUBLE - price_min / previous_price
  AS off FROM ann WHERE price_direction = 'down' AND price_min > 0 AND previous_price > price_min)
SELECT * FROM f WHERE off >= 0.05""")
def p19(spark, d):
    return P.sale_strip(_annotated(spark, d)[0]).select("id", "price_min", "previous_price", "off")


@query("p20_sale_stats", ("bag", "variant"), f"""
WITH {CUT}, on_ AS (SELECT * FROM bag WHERE on_sale),
o AS (SELECT off, row_number() OVER (ORDER BY off DESC) - 1 AS i, count(*) OVER () AS n
  FROM on_ JOIN cut ON on_.id = cut.bag_id)
SELECT (SELECT count(*) FROM on_) AS models, (SELECT count(DISTINCT brand_slug) FROM on_) AS brands,
  CAST(floor(max(off) * 100 + 0.5) AS INT) AS deepest_pct,
  CAST(floor(max(CASE WHEN i = n // 2 THEN off END) * 100 + 0.5) AS INT) AS median_pct FROM o""")
def p20(spark, d):
    return P.sale_stats(B.bags(spark, d), P.deepest_cut(_variants(spark, d)))
