"""Queries over subscriptions, mail events, requests and clicks."""
from pyspark.sql import functions as F

from ..operators import alerts as A, funnels as I
from . import bindings as B
from .registry import query

NOW = "2001-06-01 00:00:00"
SENT_NOW = "1998-06-02 00:00:00"
CLICK_NOW = "2024-01-30 12:00:00"


def _subs(spark, d):
    return B.view(spark, d, "subscription")


def _events(spark, d):
    """Ledger moves as run events: the largest ones, with the context of their bag."""
    bag = B.view(spark, d, "bag").select(F.col("id").alias("__id"), "brand_slug", "slug", "name",
                                         "split_from", "currency")
    led = B.view(spark, d, "ledger").where(F.col("direction").isNotNull() & F.col("price").isNotNull())
    return led.join(bag, F.col("bag_id") == F.col("__id")).drop("__id")


EV = """ev AS (SELECT l.*, b.brand_slug, b.slug, b.name, b.split_from, b.currency FROM ledger l
  JOIN bag b ON l.bag_id = b.id WHERE l.direction IS NOT NULL AND l.price IS NOT NULL)"""
DROPS = EV + """, drops AS (SELECT * FROM ev WHERE direction = 'down'),
watched AS (SELECT d.*, d.bag_id AS watched_id FROM drops d UNION ALL
  SELECT d.*, d.split_from FROM drops d WHERE d.split_from IS NOT NULL AND d.split_from <> d.bag_id)"""
PAIRS = DROPS + """,
live AS (SELECT * FROM subscription WHERE confirmed_at IS NOT NULL),
pairs AS (SELECT s.id AS subscription_id, s.email, s.watch_bag, w.* EXCLUDE (watched_id) FROM watched w JOIN live s
   ON s.watch_bag = w.watched_id WHERE (s.watch_brand IS NULL OR s.watch_brand = w.brand_slug)
   AND (s.max_price IS NULL OR w.price <= s.max_price) UNION ALL
  SELECT s.id, s.email, s.watch_bag, d.* FROM drops d JOIN live s ON s.watch_bag IS NULL
   AND s.watch_brand = d.brand_slug WHERE s.max_price IS NULL OR d.price <= s.max_price),
keyed AS (SELECT *, coalesce(watch_bag, split_from, bag_id) AS alert_key FROM pairs),
steep AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subscription_id, alert_key
   ORDER BY coalesce(delta, 0), ord) AS rn FROM keyed) t WHERE rn = 1)"""
VIEWS = ("ledger", "bag", "subscription")


@query("a01_watched", ("ledger", "bag"), f"""
WITH {DROPS} SELECT watched_id, count(*) AS n FROM watched GROUP BY watched_id""")
def a01(spark, d):
    return A.watched(_events(spark, d)).groupBy("watched_id").agg(F.count(F.lit(1)).alias("n"))


@query("a02_candidates", VIEWS, f"""
WITH {DROPS} SELECT id, watch_bag, watch_brand FROM subscription WHERE confirmed_at IS NOT NULL AND
 (watch_bag IN (SELECT watched_id FROM watched) OR watch_brand IN (SELECT brand_slug FROM drops))""")
def a02(spark, d):
    return A.candidates(_subs(spark, d), _events(spark, d)).select("id", "watch_bag", "watch_brand")


def _steep(spark, d, subs=None):
    return A.steepest(_subs(spark, d) if subs is None else subs, _events(spark, d))


@query("a03_wants", VIEWS, f"""
WITH {PAIRS} SELECT DISTINCT subscription_id, alert_key FROM keyed""")
def a03(spark, d):
    return _steep(spark, d).select("subscription_id", "alert_key")


@query("a03_wants_own_bag", VIEWS, f"""
WITH {EV} SELECT e.ord, s.id IS NOT NULL AND (s.watch_bag IS NOT NULL OR s.watch_brand IS NOT NULL)
  AND (s.watch_bag IS NULL OR s.watch_bag = e.bag_id OR coalesce(s.watch_bag = e.split_from, FALSE))
  AND (s.watch_brand IS NULL OR s.watch_brand = e.brand_slug) AND (s.max_price IS NULL OR e.price <= s.max_price) AS wanted
FROM ev e LEFT JOIN subscription s ON s.id = e.pk""")
def a03b(spark, d):
    s = _subs(spark, d).select(F.col("id").alias("__sid"), "watch_bag", "watch_brand", "max_price")
    e = _events(spark, d).join(s, F.col("pk") == F.col("__sid"), "left")
    c = F.col
    return e.select("ord", (c("__sid").isNotNull() & A.wants(c("watch_bag"), c("watch_brand"), c("max_price"), c("bag_id"),
                                                             c("split_from"), c("brand_slug"), c("price"))).alias("wanted"))


@query("a04_a05_steepest", VIEWS, f"""
WITH {PAIRS} SELECT subscription_id, alert_key, bag_id, delta, price FROM steep""")
def a05(spark, d):
    return _steep(spark, d).select("subscription_id", "alert_key", "bag_id", "delta", "price")


@query("a06_not_recent", VIEWS + ("sent",), f"""
WITH {PAIRS}, told AS (SELECT DISTINCT s.id, coalesce(s.watch_bag, t.split_from, t.bag_id) AS k
  FROM sent t JOIN subscription s ON s.id = t.subscription_id
  WHERE t.sent_at > TIMESTAMP '{SENT_NOW}' - INTERVAL 720 HOUR)
SELECT subscription_id, alert_key FROM steep p WHERE NOT EXISTS (SELECT 1 FROM told
  WHERE told.id = p.subscription_id AND told.k = p.alert_key)""")
def a06(spark, d):
    subs, sent = _subs(spark, d), B.view(spark, d, "sent")
    out = _steep(spark, d, A.mark_told(subs, sent, SENT_NOW, hours=720))
    return A.not_recent(out, sent, subs, SENT_NOW, hours=720).select("subscription_id", "alert_key")


@query("a07_not_suppressed", VIEWS, f"""
WITH {PAIRS}, held AS (SELECT sha256(lower(trim(email))) AS h FROM subscription WHERE id % 5 = 0)
SELECT subscription_id, alert_key FROM steep WHERE sha256(lower(trim(email))) NOT IN (SELECT h FROM held)""")
def a07(spark, d):
    held = _subs(spark, d).where(F.col("id") % 5 == 0).select(
        F.sha2(F.lower(F.trim("email")), 256).alias("email_sha256"))
    out = _steep(spark, d, A.mark_suppressed(_subs(spark, d), held))
    return A.not_suppressed(out, held).select("subscription_id", "alert_key")


@query("a08_alert_text", VIEWS, f"""
WITH {PAIRS}, m AS (SELECT *, CASE currency WHEN 'GBP' THEN '£' WHEN 'EUR' THEN '€' ELSE '$' END AS sym,
  regexp_replace(CAST(CAST(price AS DECIMAL(18,6)) AS STRING), '\\.?0+$', '') AS p,
  regexp_replace(CAST(CAST(prev_price AS DECIMAL(18,6)) AS STRING), '\\.?0+$', '') AS q FROM steep)
SELECT subscription_id, alert_key, brand || ' ' || name || ' dropped to ' || sym || p ||
  coalesce(' (was ' || sym || q || ')', '') AS subject, '/bags/' || brand_slug || '/' || slug || '/' AS link FROM m""")
def a08(spark, d):
    return A.alert_text(_steep(spark, d)).select("subscription_id", "alert_key", "subject", "link")


FIRST_MAIL = """first_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY svix_id ORDER BY received_at, ord)
  AS rn FROM mail_event) t WHERE rn = 1)"""


@query("a09_ingest_mail_events", "mail_event", f"""
WITH {FIRST_MAIL} SELECT svix_id, provider_id, type, received_at FROM first_""")
def a09(spark, d):
    return A.ingest_mail_events(B.mail_events(spark, d)).select(
        "svix_id", "provider_id", "type", "received_at")


@query("a10_derive_suppressions", "mail_event", """
WITH b AS (SELECT *, sha256(lower(trim(recipient))) AS email_sha256 FROM mail_event WHERE type = 'email.complained'
  OR (type = 'email.bounced' AND lower(coalesce(bounce_type, '')) <> 'transient')),
r AS (SELECT *, row_number() OVER (PARTITION BY email_sha256 ORDER BY received_at, ord) AS rn FROM b)
SELECT email_sha256, CASE type WHEN 'email.complained' THEN 'complaint' ELSE 'bounce' END AS reason,
  CASE type WHEN 'email.complained' THEN 'reported as spam' ELSE bounce_type || '/' || bounce_subtype END AS detail,
  received_at AS created_at FROM r WHERE rn = 1""")
def a10(spark, d):
    return A.derive_suppressions(B.mail_events(spark, d))


def _asks(spark, d):
    """Watches asked again: some by known mailboxes, some new."""
    c = B.table(spark, d, "customer")
    return c.selectExpr(
        "c_custkey AS ord", "upper(c_name) || '@example.com' AS email",
        "CASE WHEN c_custkey % 3 = 0 THEN 'brand-' || CAST(c_custkey % 25 AS STRING) || '__m' || "
        "CAST(c_custkey AS STRING) ELSE NULL END AS watch_bag",
        "CASE WHEN c_custkey % 3 = 1 THEN 'brand-' || CAST(c_custkey % 25 AS STRING) "
        "WHEN c_custkey % 3 = 2 THEN 'brand-9' ELSE NULL END AS watch_brand",
        "CASE WHEN c_custkey % 4 = 0 THEN CAST(50000 AS DOUBLE) ELSE NULL END AS max_price",
        "'n' || CAST(c_custkey AS STRING) AS confirm_token")


@query("a11_upsert_watch", "subscription", f"""
WITH asks AS (SELECT c_custkey AS ord, lower(c_name || '@example.com') AS mail,
  CASE WHEN c_custkey % 3 = 0 THEN 'brand-' || CAST(c_custkey % 25 AS STRING) || '__m' || CAST(c_custkey AS STRING) END AS watch_bag,
  CASE WHEN c_custkey % 3 = 1 THEN 'brand-' || CAST(c_custkey % 25 AS STRING) WHEN c_custkey % 3 = 2 THEN 'brand-9' END AS watch_brand,
  CASE WHEN c_custkey % 4 = 0 THEN CAST(50000 AS DOUBLE) END AS max_price, 'n' || CAST(c_custkey AS STRING) AS tok FROM customer),
j AS (SELECT s.id, s.email, s.watch_bag AS sb, s.watch_brand AS sw, s.confirmed_at, s.confirm_sent_at, s.confirm_token,
  a.ord, a.mail, a.watch_bag AS ab, a.watch_brand AS aw, a.tok FROM subscription s FULL OUTER JOIN asks a
  ON lower(s.email) = a.mail AND s.watch_bag IS NOT DISTINCT FROM a.watch_bag
  AND s.watch_brand IS NOT DISTINCT FROM a.watch_brand AND s.max_price IS NOT DISTINCT FROM a.max_price)
SELECT lower(coalesce(email, mail)) AS mail, coalesce(sb, ab) AS watch_bag, coalesce(sw, aw) AS watch_brand,
  CASE WHEN id IS NULL THEN tok WHEN ord IS NOT NULL AND confirmed_at IS NULL AND (confirm_sent_at IS NULL OR
    confirm_sent_at < TIMESTAMP '{NOW}' - INTERVAL 15 MINUTE) THEN tok ELSE confirm_token END AS confirm_token FROM j""")
def a11(spark, d):
    out = A.upsert_watch(_subs(spark, d), _asks(spark, d), NOW)
    return out.select(F.lower("email").alias("mail"), "watch_bag", "watch_brand", "confirm_token")


@query("a12_valid_criteria", (), """
SELECT c_custkey AS ord, CASE WHEN c_custkey % 7 = 0 THEN 'email' WHEN c_custkey % 5 = 0 THEN 'criteria' END AS error,
  CASE WHEN c_acctbal > 0 THEN floor(c_acctbal + 0.5) END AS max_price FROM customer""")
def a12(spark, d):
    raw = B.table(spark, d, "customer").selectExpr(
        "c_custkey AS ord", "CASE WHEN c_custkey % 7 = 0 THEN 'not an address' ELSE "
        "' x' || CAST(c_custkey AS STRING) || '@example.com ' END AS email",
        "CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'brand-1__m1' END AS watch_bag",
        "CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'brand-2' END AS watch_brand",
        "CAST(c_acctbal AS STRING) AS max_price")
    return A.valid_criteria(raw).select("ord", "error", "max_price")


@query("a13_confirm_due", "subscription", f"""
SELECT id FROM subscription WHERE confirm_sent_at IS NULL OR confirm_sent_at < TIMESTAMP '{NOW}' - INTERVAL 15 MINUTE""")
def a13(spark, d):
    return _subs(spark, d).where(A.confirm_due(NOW)).select("id")


@query("a14_daily_cap", "request", """
SELECT id, ip_hash FROM (SELECT *, row_number() OVER (PARTITION BY ip_hash ORDER BY created_at, id) AS rn
FROM request) t WHERE rn <= 5""")
def a14(spark, d):
    return A.daily_cap(B.view(spark, d, "request"), 5).select("id", "ip_hash")


@query("a15_upsert_requests", "request", """
WITH g AS (SELECT ip_hash, lower(trim(name)) AS n, arg_min(name, (created_at, id)) AS name,
  arg_max(url, (created_at, id)) FILTER (WHERE url IS NOT NULL) AS url,
  arg_max(email, (created_at, id)) FILTER (WHERE email IS NOT NULL) AS email,
  min(created_at) AS created_at, min(id) AS id, count(*) AS asked FROM request GROUP BY 1, 2)
SELECT ip_hash, name, url, email, created_at, asked FROM (SELECT *, row_number() OVER (PARTITION BY ip_hash
  ORDER BY created_at, id) AS rn FROM g) t WHERE rn <= 4""")
def a15(spark, d):
    return A.upsert_requests(B.view(spark, d, "request"), 4).select(
        "ip_hash", "name", "url", "email", "created_at", "asked")


@query("a16_requester_hash", (), """
SELECT event_id, sha256(strftime(ts, '%Y-%m-%d') || '|' || '10.0.0.' || CAST(user_id AS STRING)) AS h FROM events""")
def a16(spark, d):
    e = B.table(spark, d, "events")
    addr = F.concat(F.lit(" 10.0.0."), F.col("user_id").cast("string"), F.lit(" , 1.2.3.4"))
    return e.select("event_id", A.requester_hash(F.col("ts"), addr).alias("h"))


@query("a17_confirm", "subscription", """
SELECT s.id, coalesce(s.confirmed_at, min(e.ts)) AS confirmed_at FROM subscription s LEFT JOIN events e
ON s.confirm_token = 'c' || CAST(e.user_id AS STRING) GROUP BY s.id, s.confirmed_at""")
def a17(spark, d):
    tokens = B.table(spark, d, "events").select(
        F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("token"), F.col("ts").alias("at"))
    return A.confirm(_subs(spark, d), tokens).select("id", "confirmed_at")


@query("a17_unsubscribe", ("subscription", "sent"), """
WITH gone AS (SELECT DISTINCT 'u' || CAST(user_id AS STRING) AS t FROM events),
k AS (SELECT * FROM subscription WHERE unsub_token NOT IN (SELECT t FROM gone))
SELECT 'subscription' AS part, count(*) AS n FROM k UNION ALL
SELECT 'sent', count(*) FROM sent WHERE subscription_id NOT IN
  (SELECT id FROM subscription WHERE unsub_token IN (SELECT t FROM gone))""")
def a17b(spark, d):
    tokens = B.table(spark, d, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("token"))
    subs, sent = A.unsubscribe(_subs(spark, d), B.view(spark, d, "sent"), tokens)
    n = F.count(F.lit(1)).alias("n")
    return subs.agg(n).select(F.lit("subscription").alias("part"), "n").unionByName(
        sent.agg(n).select(F.lit("sent").alias("part"), "n"))


# --- clicks -----------------------------------------------------------------

CLEAN = """clean AS (SELECT event_id, created_at, trim(name) AS name, brand, nullif(trim(bag_id), '') AS bag_id,
  placement, seller, model, CASE WHEN price >= 0 AND price < 100000 THEN CAST(price AS DECIMAL(10, 2)) END AS price, user_id
  FROM raw_click WHERE user_agent NOT LIKE '%crawler%' AND trim(name) IN ('product_view', 'buy_click', 'brand_click')
  AND (placement IS NULL OR placement IN ('product_page', 'offers_table', 'variant_row', 'browse_overlay', 'brand_page')))"""
RECENT = CLEAN + f""", ev AS (SELECT * FROM clean WHERE created_at >= TIMESTAMP '{CLICK_NOW}' - INTERVAL 20 DAY)"""


def _clean(spark, d):
    return I.clean_clicks(B.view(spark, d, "raw_click"))


def _recent(spark, d):
    return I.since(_clean(spark, d), CLICK_NOW, 20)


@query("i16_clean_clicks", "raw_click", f"""
WITH {CLEAN} SELECT event_id, name, brand, bag_id, placement, CAST(price AS DOUBLE) AS price FROM clean""")
def i16(spark, d):
    return _clean(spark, d).select("event_id", "name", "brand", "bag_id", "placement",
                                   F.col("price").cast("double").alias("price"))


@query("i01_by_placement", "raw_click", f"""
WITH {RECENT} SELECT name, placement, count(*) AS n FROM ev GROUP BY 1, 2""")
def i01(spark, d):
    return I.by_placement(_recent(spark, d))


VC = """count(*) FILTER (WHERE name = 'product_view') AS views, count(*) FILTER (WHERE name = 'buy_click') AS clicks"""


@query("i02_by_brand", "raw_click", f"""
WITH {RECENT} SELECT brand, {VC} FROM ev WHERE brand IS NOT NULL GROUP BY brand""")
def i02(spark, d):
    return I.by_brand(_recent(spark, d))


@query("i03_by_seller", "raw_click", f"""
WITH {RECENT}, s AS (SELECT seller, count(*) FILTER (WHERE name = 'buy_click') AS buys,
  count(*) FILTER (WHERE name = 'brand_click') AS brand_clicks FROM ev WHERE name IN ('buy_click', 'brand_click')
  GROUP BY seller)
SELECT *, buys / (SELECT sum(buys) FROM s) AS share FROM s""")
def i03(spark, d):
    return I.by_seller(_recent(spark, d))


@query("i04_daily_series", "raw_click", f"""
WITH {RECENT}, s AS (SELECT CAST(unnest(generate_series(DATE '2024-01-30' - INTERVAL 44 DAY, DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS day),
g AS (SELECT CAST(created_at AS DATE) AS day, {VC} FROM ev GROUP BY 1)
SELECT s.day, coalesce(views, 0) AS views, coalesce(clicks, 0) AS clicks FROM s LEFT JOIN g ON s.day = g.day""")
def i04(spark, d):
    return I.daily_series(_recent(spark, d), CLICK_NOW, 45)


@query("i05_by_bag", "raw_click", f"""
WITH {RECENT} SELECT bag_id, brand, model, {VC} FROM ev WHERE bag_id IS NOT NULL GROUP BY 1, 2, 3""")
def i05(spark, d):
    return I.by_bag(_recent(spark, d))


@query("i06_brand_clicks", "raw_click", f"""
WITH {RECENT} SELECT brand, count(*) AS n FROM ev WHERE name = 'brand_click' GROUP BY brand""")
def i06(spark, d):
    return I.brand_clicks(_recent(spark, d))


SURF = """surf AS (SELECT 'model-page' AS surface,
  count(*) FILTER (WHERE name = 'product_view' AND placement = 'product_page') AS views,
  count(*) FILTER (WHERE name = 'buy_click' AND placement IN ('product_page', 'offers_table', 'variant_row')) AS clicks
  FROM ev UNION ALL SELECT 'browse-drawer', count(*) FILTER (WHERE name = 'product_view' AND placement = 'browse_overlay'),
  count(*) FILTER (WHERE name = 'buy_click' AND placement = 'browse_overlay') FROM ev)"""


@query("i07_surface_rates", "raw_click", f"""
WITH {RECENT}, {SURF} SELECT surface, views, clicks, CASE WHEN views > 0 THEN clicks / views END AS rate FROM surf""")
def i07(spark, d):
    return I.surface_rates(I.by_placement(_recent(spark, d)))


@query("i08_best_worst", "raw_click", f"""
WITH {RECENT}, g AS (SELECT bag_id, brand, model, {VC} FROM ev WHERE bag_id IS NOT NULL GROUP BY 1, 2, 3),
r AS (SELECT *, clicks / views AS rate FROM g WHERE views >= 3)
SELECT bag_id, brand, model, views, clicks, rate, row_number() OVER (ORDER BY rate DESC, bag_id, brand, model) AS best_rank,
  row_number() OVER (ORDER BY rate, bag_id DESC, brand DESC, model DESC) AS worst_rank FROM r""")
def i08(spark, d):
    return I.best_worst(I.by_bag(_recent(spark, d)), min_views=3)


@query("i09_funnel", ("raw_click", "pageview"), f"""
WITH {RECENT}, {SURF}, s AS (SELECT 1 AS place, 'arrived' AS step, (SELECT count(*) FROM pageview) AS n UNION ALL
  SELECT 2, 'looked', CAST((SELECT sum(views) FROM surf) AS BIGINT) UNION ALL SELECT 3, 'left', CAST((SELECT sum(clicks) FROM surf) AS BIGINT))
SELECT a.place, a.step, a.n, a.n / b.n AS rate FROM s a LEFT JOIN s b ON a.place = b.place + 1""")
def i09(spark, d):
    return I.funnel(B.view(spark, d, "pageview"), I.surface_rates(I.by_placement(_recent(spark, d))))


@query("i09_measured_share", ("raw_click", "pageview"), f"""
WITH {RECENT}, {SURF} SELECT views AS seen, (SELECT count(*) FROM pageview WHERE route LIKE '/bags/%') AS loaded,
  views * 100.0::DOUBLE / (SELECT count(*) FROM pageview WHERE route LIKE '/bags/%') AS pct FROM surf WHERE surface = 'model-page'""")
def i09b(spark, d):
    return I.measured_share(I.surface_rates(I.by_placement(_recent(spark, d))),
                            B.view(spark, d, "pageview"))


@query("i10_traffic", "pageview", """
SELECT 'day' AS kind, CAST(CAST(ts AS DATE) AS STRING) AS key, count(*) AS pageviews, count(DISTINCT visitor) AS visitors FROM pageview GROUP BY 2 UNION ALL
SELECT 'route', route, count(*), count(DISTINCT visitor) FROM pageview GROUP BY 2 UNION ALL
SELECT 'referrer', coalesce(nullif(referrer, ''), 'direct / none'), count(*), count(DISTINCT visitor) FROM pageview GROUP BY 2""")
def i10(spark, d):
    return I.traffic(B.view(spark, d, "pageview"))


@query("i11_subscription_status", "subscription", """
SELECT count(*) AS total, count(confirmed_at) AS confirmed, count(*) - count(confirmed_at) AS pending FROM subscription""")
def i11(spark, d):
    return I.subscription_status(_subs(spark, d))


RATES = """n AS (SELECT count(*) AS sent FROM mail_send), o AS (SELECT * FROM (VALUES ('delivered'), ('bounced'),
  ('complained'), ('opened'), ('clicked')) t(outcome)),
r AS (SELECT o.outcome, n.sent, (SELECT count(DISTINCT provider_id) FROM mail_event e WHERE e.type = 'email.' || o.outcome
  AND provider_id IS NOT NULL) AS n FROM o, n)"""


@query("i12_mail_rates", ("mail_send", "mail_event"), f"""
WITH {RATES} SELECT outcome, sent, n, n * 100.0::DOUBLE / sent AS pct, coalesce(n * 100.0 / sent >= CASE outcome
  WHEN 'complained' THEN 0.3 WHEN 'bounced' THEN 2.0 END, FALSE) AS bad FROM r""")
def i12(spark, d):
    return I.mail_rates(B.view(spark, d, "mail_send"), B.view(spark, d, "mail_event"))


@query("i12_sends_by_kind", "mail_send", "SELECT kind, count(*) AS sent FROM mail_send GROUP BY kind")
def i12b(spark, d):
    return I.sends_by_kind(B.view(spark, d, "mail_send"))


@query("i13_delivery_funnel", ("mail_send", "mail_event"), """
SELECT kind, count(*) AS sent, count(*) FILTER (WHERE provider_id IN (SELECT provider_id FROM mail_event
  WHERE type = 'email.delivered' AND provider_id IS NOT NULL)) AS delivered, count(*) FILTER (WHERE provider_id IN
  (SELECT provider_id FROM mail_event WHERE type = 'email.bounced' AND provider_id IS NOT NULL)) AS bounced
FROM mail_send GROUP BY kind""")
def i13(spark, d):
    return I.delivery_funnel(B.view(spark, d, "mail_send"), B.view(spark, d, "mail_event"))


@query("i14_suppression_summary", "mail_event", """
WITH b AS (SELECT *, sha256(lower(trim(recipient))) AS h FROM mail_event WHERE type = 'email.complained'
  OR (type = 'email.bounced' AND lower(coalesce(bounce_type, '')) <> 'transient')),
r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY received_at, ord) AS rn FROM b)
SELECT CASE type WHEN 'email.complained' THEN 'complaint' ELSE 'bounce' END AS reason, count(*) AS n FROM r WHERE rn = 1 GROUP BY 1""")
def i14(spark, d):
    return I.suppression_summary(A.derive_suppressions(B.mail_events(spark, d)))


@query("i14_silence", ("mail_send", "mail_event"), f"""
WITH {RATES} SELECT greatest(max(sent) - max(n) FILTER (WHERE outcome = 'delivered') - max(n) FILTER (WHERE outcome = 'bounced'), 0) AS silent,
  max(sent) > 0 AND sum(n) FILTER (WHERE outcome IN ('delivered', 'bounced', 'complained')) = 0 AS no_webhook FROM r""")
def i14b(spark, d):
    return I.silence(I.mail_rates(B.view(spark, d, "mail_send"), B.view(spark, d, "mail_event")))


@query("i15_recent_problems", "mail_event", f"""
WITH {FIRST_MAIL} SELECT svix_id, type, received_at, payload->>'$.subject' AS subject, payload->>'$.bounce.type' AS bounce_type,
  payload->>'$.bounce.subType' AS bounce_subtype FROM first_ WHERE type IN ('email.bounced', 'email.complained', 'email.delivery_delayed')""")
def i15(spark, d):
    return I.recent_problems(A.ingest_mail_events(B.mail_events(spark, d)))
