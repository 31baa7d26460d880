"""Alerts of brand watches: every pair once, without a shuffle of the pairs."""
import datetime as dt

from pyspark.sql import functions as F

from packledger.operators import alerts as A

EVENT = ("bag_id string, split_from string, brand_slug string, direction string, price double, delta double, ord bigint")
SUB = "id bigint, email string, watch_bag string, watch_brand string, max_price double"
DAY = dt.datetime(2001, 1, 1)


def tables(spark):
    events = spark.createDataFrame([
        (f"b{bag}", "line" if bag < 2 else None, f"brand{bag % 2}", "down", 100.0 - 10 * k, -5.0 * (k % 3), 10 * bag + k)
        for bag in range(6) for k in range(4)], EVENT)
    subs = spark.createDataFrame([
        (1, "a@x", None, "brand0", None), (2, "b@x", None, "brand1", 85.0), (3, "c@x", "line", None, None),
        (4, "d@x", None, "brand0", 95.0), (4, "e@x", None, "brand0", 75.0), (5, None, None, "brand0", None),
        (None, "f@x", None, "brand0", None), (None, "g@x", "b4", None, 95.0)], SUB).withColumn(
        "confirmed_at", F.lit(DAY)).withColumn("unsub_token", F.lit("u"))
    return subs, events


def expected(subs, events):
    best = {}
    for s in subs.collect():
        for e in events.collect():
            named = s.watch_bag is not None and s.watch_bag in (e.bag_id, e.split_from)
            branded = s.watch_bag is None and s.watch_brand == e.brand_slug
            if (named or branded) and (s.max_price is None or e.price <= s.max_price):
                key = (s.id, s.watch_bag or e.split_from or e.bag_id)
                best[key] = min(best.get(key, (0.0, 99)), (e.delta, e.ord))
    return {(*k, v[1]) for k, v in best.items()}


def test_steepest_against_all_pairs(spark):
    subs, events = tables(spark)
    out = A.steepest(subs, events)
    rows = [(r.subscription_id, r.alert_key, r.ord) for r in out.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expected(subs, events)


def test_pairs_of_brand_watches_are_not_shuffled(spark):
    subs, events = tables(spark)
    plan = A.steepest(subs, events)._jdf.queryExecution().optimizedPlan().toString()
    # the union's second part is the join itself: no ranking by subscription and key above it
    assert plan.startswith("Union")
    last = plan[plan.rindex("\n+- "):]
    assert "row_number" not in last and "Join Inner" in last


def test_marked_subscriptions_give_what_joins_give(spark):
    subs, events = tables(spark)
    held = spark.createDataFrame([("a@x",), ("c@x",)], "e string").select(F.sha2("e", 256).alias("email_sha256"))
    sent = spark.createDataFrame([(4, "b2", None, DAY), (3, "b9", None, DAY), (2, None, None, DAY)],
                                 "subscription_id bigint, bag_id string, split_from string, sent_at timestamp").withColumn(
        "sent_at", F.col("sent_at").cast("timestamp_ntz"))
    now = "2001-01-01 10:00:00"
    key = lambda df: sorted(map(str, df.select("subscription_id", "alert_key").collect()))
    plain = A.steepest(subs, events)
    assert key(A.not_suppressed(A.steepest(A.mark_suppressed(subs, held), events), held)) == key(A.not_suppressed(plain, held))
    told = A.not_recent(A.steepest(A.mark_told(subs, sent, now), events), sent, subs, now)
    assert key(told) == key(A.not_recent(plain, sent, subs, now)) and told.count() < plain.count()
