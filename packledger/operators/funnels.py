"""Referral and mail funnels."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed as X, scalars as S
from ..functions.rules import matches
from ..functions.skew import numbered

SURFACES = {
    "model-page": ("product_page", ["product_page", "offers_table", "variant_row"]),
    "browse-drawer": ("browse_overlay", ["browse_overlay"]),
}


def since(events: DataFrame, now, days: int, at: str = "created_at") -> DataFrame:
    return events.where(F.col(at) >= F.lit(now).cast("timestamp_ntz")
                        - F.make_dt_interval(days=F.lit(days)))


def views() -> Column:
    return F.count_if(F.col("name") == "product_view")


def clicks() -> Column:
    return F.count_if(F.col("name") == "buy_click")


def by_placement(events: DataFrame) -> DataFrame:
    return events.groupBy("name", "placement").agg(F.count(F.lit(1)).alias("n"))


def _first(rows: DataFrame, order: list, k: int | None) -> DataFrame:
    """All rows, or the first ``k`` in order."""
    return rows if k is None else rows.orderBy(*order).limit(k)


def by_brand(events: DataFrame, k: int | None = None) -> DataFrame:
    rows = events.where(F.col("brand").isNotNull()).groupBy("brand").agg(
        views().alias("views"), clicks().alias("clicks"))
    return _first(rows, [F.desc("clicks"), F.desc("views"), F.col("brand")], k)


def by_seller(events: DataFrame, k: int | None = None) -> DataFrame:
    """Buys and brand clicks per seller, with each seller's share of all buys."""
    rows = (events.where(F.col("seller").isNotNull()
                         & F.col("name").isin("buy_click", "brand_click")).groupBy("seller")
            .agg(clicks().alias("buys"),
                 F.count_if(F.col("name") == "brand_click").alias("brand_clicks")))
    total = rows.agg(F.sum("buys")).scalar()
    shares = rows.select("seller", "buys", "brand_clicks",
                         F.when(total > 0, F.col("buys") / total).alias("share"))
    return _first(shares, [F.desc("buys"), F.desc("brand_clicks"), F.col("seller")], k)


def daily_series(events: DataFrame, now, days: int) -> DataFrame:
    """Views and clicks per day of the window, zero on days without events."""
    seen = events.groupBy(F.to_date("created_at").alias("day")).agg(
        views().alias("__v"), clicks().alias("__c"))
    end = F.to_date(F.lit(now).cast("timestamp_ntz"))
    spine = events.sparkSession.range(1).select(F.explode(F.sequence(
        F.date_sub(end, days - 1), end)).alias("day"))
    zero = F.lit(0).cast("bigint")
    return spine.join(seen, "day", "left").select(
        "day", F.coalesce("__v", zero).alias("views"), F.coalesce("__c", zero).alias("clicks"))


def by_bag(events: DataFrame, k: int | None = None) -> DataFrame:
    rows = events.where(F.col("bag_id").isNotNull()).groupBy("bag_id", "brand", "model").agg(
        views().alias("views"), clicks().alias("clicks"))
    return _first(rows, [F.desc("clicks"), F.desc("views"), F.col("bag_id"), F.col("brand"), F.col("model")], k)


def brand_clicks(events: DataFrame, k: int | None = None) -> DataFrame:
    rows = (events.where((F.col("name") == "brand_click") & F.col("brand").isNotNull())
            .groupBy("brand").agg(F.count(F.lit(1)).alias("n")))
    return _first(rows, [F.desc("n"), F.col("brand")], k)


def surface_rates(placements: DataFrame) -> DataFrame:
    """Views and clicks per surface: one placement shows it, several lead out of it."""
    n = lambda name, places: F.coalesce(F.sum(F.when(
        (F.col("name") == name) & F.col("placement").isin(places), F.col("n"))),
        F.lit(0)).cast("bigint")
    one = placements.agg(*[x for s, (view, out) in SURFACES.items() for x in (
        n("product_view", [view]).alias(f"{s}:v"), n("buy_click", out).alias(f"{s}:c"))])
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("surface"), F.col(f"`{s}:v`").alias(
        "views"), F.col(f"`{s}:c`").alias("clicks")) for s in SURFACES]))
    return one.select(rows.alias("s")).select(
        "s.*", F.when(F.col("s.views") > 0, F.col("s.clicks") / F.col("s.views")).alias("rate"))


def best_worst(bags: DataFrame, min_views: int = 20, k: int | None = None) -> DataFrame:
    """Click rate of every rated bag with its rank from the best and from the worst.

    With ``k``, only the first k of either end.
    """
    rated = bags.where(F.col("views") >= min_views).withColumn(
        "rate", F.col("clicks") / F.col("views"))
    order = [F.desc("rate"), F.col("bag_id"), F.col("brand"), F.col("model")]
    out = numbered(rated, [], order, F.floor((1 - F.col("rate")) * 4096), "best_rank")
    rated_bags = rated.agg(F.count(F.lit(1))).scalar()
    out = out.withColumn("worst_rank", rated_bags - F.col("best_rank") + 1)
    return out if k is None else out.where((F.col("best_rank") <= k) | (F.col("worst_rank") <= k))


def funnel(pageviews: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Arrived, looked, left — each with its rate over the step before."""
    steps = pageviews.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(1).alias("place"), F.lit("arrived").alias("step"), "n")
    s = surfaces.agg(F.sum("views").alias("v"), F.sum("clicks").alias("c"))
    steps = steps.unionByName(s.select(F.lit(2).alias("place"), F.lit("looked").alias("step"),
                                       F.col("v").alias("n"))).unionByName(
        s.select(F.lit(3).alias("place"), F.lit("left").alias("step"), F.col("c").alias("n")))
    before = steps.select((F.col("place") + 1).alias("place"), F.col("n").alias("__p"))
    return steps.join(before, "place", "left").select(
        "place", "step", "n", F.when(F.col("__p") > 0, F.col("n") / F.col("__p")).alias("rate"))


def measured_share(surfaces: DataFrame, pageviews: DataFrame) -> DataFrame:
    """Share of model-page views that the beacon saw.  pageviews(route)."""
    seen = surfaces.where(F.col("surface") == "model-page").select(
        F.col("views").alias("seen"), F.lit(None).cast("bigint").alias("loaded"))
    every = pageviews.where(F.startswith("route", F.lit("/bags/"))).agg(
        F.lit(None).cast("bigint").alias("seen"), F.count(F.lit(1)).alias("loaded"))
    both = seen.unionByName(every).agg(F.max("seen").alias("seen"), F.max("loaded").alias("loaded"))
    return both.withColumn("pct", F.when(
        F.col("loaded") > 0, F.col("seen") * 100.0 / F.col("loaded")))


def traffic(pageviews: DataFrame) -> DataFrame:
    """Page views per day, per route and per referrer, as one long table."""
    blank = F.coalesce(F.nullif("referrer", F.lit("")), F.lit("direct / none"))
    one = lambda kind, key: pageviews.groupBy(key.alias("key")).agg(
        F.count(F.lit(1)).alias("pageviews"), F.countDistinct("visitor").alias("visitors")
    ).select(F.lit(kind).alias("kind"), "key", "pageviews", "visitors")
    return (one("day", F.to_date("ts").cast("string")).unionByName(
        one("route", F.coalesce("route", F.lit("—")))).unionByName(one("referrer", blank)))


# --- mail -------------------------------------------------------------------

def subscription_status(subs: DataFrame) -> DataFrame:
    yes = F.col("confirmed_at").isNotNull()
    return subs.agg(F.count(F.lit(1)).alias("total"), F.count_if(yes).alias("confirmed"),
                    F.count_if(~yes).alias("pending"))


OUTCOMES = ["delivered", "bounced", "complained", "opened", "clicked"]


def mail_rates(sends: DataFrame, events: DataFrame) -> DataFrame:
    """Distinct messages per outcome over messages sent, and whether a threshold is broken."""
    sent = sends.agg(F.count(F.lit(1)).alias("sent")).withColumn("__k", F.lit(1))
    seen = events.where(F.col("provider_id").isNotNull()).groupBy("type").agg(
        F.countDistinct("provider_id").alias("n"))
    names = F.explode(F.array(*[F.lit(o) for o in OUTCOMES]))
    rows = sent.select("sent", names.alias("outcome")).join(
        seen, F.concat(F.lit("email."), F.col("outcome")) == F.col("type"), "left")
    n = F.coalesce("n", F.lit(0).cast("bigint"))
    pct = F.when(F.col("sent") > 0, n * 100.0 / F.col("sent"))
    limit = F.when(F.col("outcome") == "complained", X.BAD_RATES["complaint"]).when(
        F.col("outcome") == "bounced", X.BAD_RATES["bounce"])
    return rows.select("outcome", "sent", n.alias("n"), pct.alias("pct"),
                       F.coalesce(pct >= limit, F.lit(False)).alias("bad"))


def sends_by_kind(sends: DataFrame) -> DataFrame:
    return sends.groupBy("kind").agg(F.count(F.lit(1)).alias("sent"))


def delivery_funnel(sends: DataFrame, events: DataFrame) -> DataFrame:
    """Per kind: sent, and how many have a delivery or a bounce on record."""
    marks = events.where(F.col("provider_id").isNotNull()).groupBy(
        F.col("provider_id").alias("__p")).agg(
        F.bool_or(F.col("type") == "email.delivered").alias("__d"),
        F.bool_or(F.col("type") == "email.bounced").alias("__b"))
    df = sends.join(marks, F.col("provider_id") == F.col("__p"), "left")
    yes = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return df.groupBy("kind").agg(F.count(F.lit(1)).alias("sent"),
                                  yes("__d").alias("delivered"), yes("__b").alias("bounced"))


def suppression_summary(suppressions: DataFrame) -> DataFrame:
    return suppressions.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def silence(rates: DataFrame) -> DataFrame:
    """Sends nothing came back for, and whether the webhook looks dead."""
    n = lambda o: F.max(F.when(F.col("outcome") == o, F.col("n")))
    one = rates.agg(F.max("sent").alias("sent"), n("delivered").alias("d"), n("bounced").alias("b"),
                    n("complained").alias("c"))
    return one.select(
        F.greatest(F.col("sent") - F.col("d") - F.col("b"), F.lit(0)).alias("silent"),
        ((F.col("sent") > 0) & (F.col("d") + F.col("b") + F.col("c") == 0)).alias("no_webhook"))


def recent_problems(events: DataFrame, k: int | None = None) -> DataFrame:
    """Bounces, complaints and delays with the fields of their JSON payload; with ``k``, the latest."""
    bad = events.where(F.col("type").isin(
        "email.bounced", "email.complained", "email.delivery_delayed"))
    get = lambda p: F.get_json_object("payload", p)
    return _first(bad, [F.desc("received_at"), F.desc("svix_id")], k).select(
        "svix_id", "type", "received_at", get("$.subject").alias("subject"),
        get("$.bounce.type").alias("bounce_type"),
        get("$.bounce.subType").alias("bounce_subtype"))


def clean_clicks(raw: DataFrame) -> DataFrame:
    """Allow-listed names and placements, trimmed texts, plausible prices, no robots."""
    text = lambda c: S.filled_text(F.col(c))
    price = F.col("price").try_cast("double")
    df = raw.withColumns({
        "name": text("name"), "placement": text("placement"), "brand": text("brand"),
        "bag_id": text("bag_id"), "seller": text("seller"), "model": text("model"),
        "price": F.when((price >= 0) & (price < 100000), price).cast("decimal(10,2)")})
    return df.where(~matches(F.col("user_agent"), X.BOT_AGENT)
                    & F.coalesce(F.col("name").isin(X.CLICK_NAMES), F.lit(False))
                    & (F.col("placement").isNull() | F.col("placement").isin(X.CLICK_PLACEMENTS)))
