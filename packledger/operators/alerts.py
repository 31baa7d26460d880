"""Price alerts and mail-health tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalars as S
from ..functions.skew import first_per_key, numbered


def watched(events: DataFrame) -> DataFrame:
    """Price drops, one row per id a watch could name: the bag's own and its pre-split id."""
    return events.where(F.col("direction") == "down").withColumn("watched_id", F.explode(
        F.array_distinct(F.array_compact(F.array("bag_id", "split_from")))))


def candidates(subs: DataFrame, events: DataFrame) -> DataFrame:
    """Confirmed watches touched by tonight's bags or brands.

    Two equi semi-joins, each on its own key, not one join with OR.
    """
    live = subs.where(F.col("confirmed_at").isNotNull())
    ids = watched(events).select(F.col("watched_id").alias("__w")).distinct()
    brands = events.where(F.col("direction") == "down").select(
        F.col("brand_slug").alias("__w")).distinct()
    by_bag = live.join(ids, F.col("watch_bag") == F.col("__w"), "left_semi")
    by_brand = live.join(brands, F.col("watch_brand") == F.col("__w"), "left_semi")
    return by_bag.unionByName(by_brand).dropDuplicates(["id"])


def wants(watch_bag: Column, watch_brand: Column, max_price: Column, bag_id: Column,
          split_from: Column, brand_slug: Column, price: Column) -> Column:
    """Does a watch cover a drop?  An empty watch covers nothing, an unknown price no ceiling."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    named = blank(watch_bag) | F.coalesce((watch_bag == bag_id) | (watch_bag == split_from),
                                          F.lit(False))
    branded = blank(watch_brand) | F.coalesce(watch_brand == brand_slug, F.lit(False))
    under = max_price.isNull() | F.coalesce(price <= max_price, F.lit(False))
    return named & branded & under & ~(blank(watch_bag) & blank(watch_brand))


NO_CEILING = 1e300


def _frontier(drops: DataFrame, keys: list[str], salts: int = 64) -> DataFrame:
    """The drops that can be somebody's steepest: each cheaper than all the steeper ones.

    A ceiling m is answered by the one row with ``price <= m < ceiling_end``.
    The frontier of a union is the frontier of the frontiers, so a busy key is
    thinned in salted parts first.
    """
    order = [F.coalesce("delta", F.lit(0.0)), F.col("ord")]

    def thin(df: DataFrame, by: list[str]) -> DataFrame:
        steeper = Window.partitionBy(*by).orderBy(*order).rowsBetween(
            Window.unboundedPreceding, -1)
        df = df.withColumn("ceiling_end", F.coalesce(F.min("price").over(steeper), F.lit(
            NO_CEILING * 10)))
        return df.where(F.col("price") < F.col("ceiling_end"))

    parts = drops.where(F.col("price").isNotNull()).withColumn(
        "__salt", F.pmod(F.hash("ord"), F.lit(salts)))
    return thin(thin(parts, [*keys, "__salt"]).drop("ceiling_end", "__salt"), keys)


#: Parts of a brand's lines that its watches meet one at a time.
LINE_PARTS = 32


def steepest(subs: DataFrame, events: DataFrame) -> DataFrame:
    """The steepest covered drop per confirmed subscription and alert key.

    Watches and drops are never paired row by row: each line of drops is cut to
    its frontier first, and a ceiling meets exactly one row of it.  So the pairs
    of a brand watch whose subscription is there once are its answers; they are
    not shuffled again.  Their number is that of watches times lines of the brand.
    """
    live = subs.where(F.col("confirmed_at").isNotNull()).select(
        F.col("id").alias("subscription_id"), "email", "unsub_token",
        F.nullif("watch_bag", F.lit("")).alias("watch_bag"),
        F.nullif("watch_brand", F.lit("")).alias("watch_brand"), "max_price",
        F.coalesce("max_price", F.lit(NO_CEILING)).alias("__m"),
        *[c for c in ("suppressed", "told") if c in subs.columns],
        (F.count(F.lit(1)).over(Window.partitionBy("id")) == 1).alias("__once"))
    meets = (F.col("price") <= F.col("__m")) & (F.col("__m") < F.col("ceiling_end"))
    drops = events.where(F.col("direction") == "down")
    ids = _frontier(watched(events), ["watched_id", "brand_slug"])
    named = live.where(F.col("watch_bag").isNotNull()).join(
        ids, (F.col("watch_bag") == F.col("watched_id")) & meets).where(
        F.col("watch_brand").isNull() | (F.col("watch_brand") == F.col("brand_slug")))
    named = named.withColumn("alert_key", F.col("watch_bag")).drop("watched_id")
    line = F.coalesce(F.nullif("split_from", F.lit("")), "bag_id")
    lines = _frontier(drops.withColumn("__line", line), ["brand_slug", "__line"]).withColumn(
        "__lp", F.pmod(F.hash("__line"), F.lit(LINE_PARTS)))
    watches = live.where(F.col("watch_bag").isNull() & F.col("watch_brand").isNotNull()).withColumn(
        "__wp", F.explode(F.sequence(F.lit(0), F.lit(LINE_PARTS - 1))))
    branded = watches.join(lines, (F.col("watch_brand") == F.col("brand_slug"))
                           & (F.col("__wp") == F.col("__lp")) & meets)
    branded = branded.withColumn("alert_key", F.col("__line")).drop("__line", "__lp", "__wp")
    tidy = lambda df: df.drop("__m", "__once", "ceiling_end")
    # a watched id whose drops span two brands leaves one row for each
    several = named.unionByName(branded.where(~F.col("__once")))
    return first_per_key(tidy(several), ["subscription_id", "alert_key"], [
        F.coalesce("delta", F.lit(0.0)), F.col("ord")]).unionByName(tidy(branded.where("__once")))


def dedupe_key(watch_bag: Column, split_from: Column, bag_id: Column) -> Column:
    """What counts as told already: the watched bag, else the line, else the bag."""
    blank = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(blank(watch_bag), blank(split_from), bag_id)


def _told(sent: DataFrame, subs: DataFrame, now, hours: int) -> DataFrame:
    """(subscription, key) of what was sent within the interval."""
    now = F.lit(now).cast("timestamp_ntz")
    mine = subs.select(F.col("id").alias("__sid"), F.col("watch_bag").alias("__wb"))
    return (sent.where(F.col("sent_at") > now - F.make_dt_interval(hours=F.lit(hours)))
            .join(mine, F.col("subscription_id") == F.col("__sid"))
            .select(F.col("__sid").alias("__s"), dedupe_key(
                F.col("__wb"), F.col("split_from"), F.col("bag_id")).alias("__k")).distinct())


def mark_told(subs: DataFrame, sent: DataFrame, now, hours: int = 24) -> DataFrame:
    """Subscriptions with the keys they were ``told`` of within the interval, known before any pairs are made."""
    keys = _told(sent, subs, now, hours).groupBy("__s").agg(F.collect_set("__k").alias("told"))
    return subs.join(keys, F.col("id") == F.col("__s"), "left").drop("__s")


def not_recent(alerts: DataFrame, sent: DataFrame, subs: DataFrame, now, hours: int = 24) -> DataFrame:
    """Alerts not already sent under the same key within the interval.

    Those of marked subscriptions (:func:`mark_told`) carry what they were told and are not joined.
    """
    if "told" in alerts.columns:
        return alerts.where(~F.coalesce(F.array_contains("told", F.col("alert_key")), F.lit(False))).drop("told")
    return alerts.join(_told(sent, subs, now, hours), (F.col("subscription_id") == F.col("__s"))
                       & (F.col("alert_key") == F.col("__k")), "left_anti")


def _held(suppressions: DataFrame) -> DataFrame:
    return suppressions.select(F.col("email_sha256").alias("__h")).distinct()


def mark_suppressed(subs: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Subscriptions with whether their mailbox is ``suppressed``."""
    return subs.join(_held(suppressions), S.email_digest(F.col("email")) == F.col("__h"), "left").withColumn(
        "suppressed", F.col("__h").isNotNull()).drop("__h")


def not_suppressed(alerts: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Alerts to mailboxes that are not suppressed; marked ones (:func:`mark_suppressed`) are not joined."""
    if "suppressed" in alerts.columns:
        return alerts.where(~F.col("suppressed")).drop("suppressed")
    return alerts.withColumn("__d", S.email_digest(F.col("email"))).join(
        _held(suppressions), F.col("__d") == F.col("__h"), "left_anti").drop("__d")


def alert_text(alerts: DataFrame, site: str = "") -> DataFrame:
    """Subject, amounts and link columns of each alert."""
    money = lambda c: F.concat(S.currency_symbol(F.col("currency")), S.plain_number(F.col(c)))
    name = F.concat_ws(" ", "brand", "name")
    was = F.when(F.coalesce("prev_price", F.lit(0.0)) != 0, money("prev_price"))
    page = F.concat(F.lit(site), S.bag_path(
        F.coalesce("brand_slug", S.id_brand(F.col("bag_id"))),
        F.coalesce("slug", S.id_model(F.col("bag_id")))))
    return alerts.withColumns({
        "amount": money("price"), "was": was, "link": page,
        "subject": F.concat(name, F.lit(" dropped to "), money("price"), F.coalesce(
            F.concat(F.lit(" (was "), was, F.lit(")")), F.lit("")))})


# --- mail events ------------------------------------------------------------

def ingest_mail_events(raw: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Each delivery id once, the first one received; recipients are not kept."""
    ok = raw.where(F.col("svix_id").isNotNull() & F.col("type").isNotNull())
    if stored is not None:
        ok = ok.join(stored.select("svix_id"), "svix_id", "left_anti")
    return first_per_key(ok, ["svix_id"], [F.col("received_at"), F.col("ord")]).drop("recipients")


def derive_suppressions(raw: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Digests of mailboxes that complained or bounced for good; the first reason stands."""
    complaint = F.col("type") == "email.complained"
    hard = (F.col("type") == "email.bounced") & (
        F.lower(F.coalesce("bounce_type", F.lit(""))) != "transient")
    detail = F.when(complaint, "reported as spam").otherwise(F.coalesce(F.nullif(F.concat_ws(
        "/", F.nullif("bounce_type", F.lit("")), F.nullif("bounce_subtype", F.lit(""))),
        F.lit("")), F.lit("bounced")))
    out = (raw.where(complaint | hard)
           .select(F.explode("recipients").alias("to"),
                   F.when(complaint, "complaint").otherwise("bounce").alias("reason"),
                   detail.alias("detail"), F.col("received_at").alias("created_at"), "ord")
           .where(F.col("to").isNotNull())
           .withColumn("email_sha256", S.email_digest(F.col("to"))).drop("to"))
    if existing is not None:
        out = out.join(existing.select("email_sha256"), "email_sha256", "left_anti")
    return first_per_key(out, ["email_sha256"], [F.col("created_at"), F.col("ord")]).select(
        "email_sha256", "reason", "detail", "created_at")


# --- subscriptions ----------------------------------------------------------

def valid_criteria(raw: DataFrame) -> DataFrame:
    """Allow-listed criteria; ``error`` names what is wrong: mailbox, no criteria, or one over its length."""
    longer = lambda c, n: F.coalesce(F.length(c) > n, F.lit(False))
    price = F.col("max_price").try_cast("double")
    df = raw.withColumns({
        "email": S.strip(F.col("email")),
        "max_price": F.when((price > 0) & (price < 100000), F.floor(price + 0.5).cast("double"))})
    none = lambda c: F.coalesce(c, F.lit("")) == ""
    return df.withColumn("error", F.when(~S.valid_email(F.col("email")), "email")
                         .when(none("watch_bag") & none("watch_brand"), "criteria")
                         .when(longer("watch_bag", 200) | longer("watch_brand", 80), "too-long"))


def confirm_due(now, minutes: int = 15) -> Column:
    """A confirmation was never sent, or long enough ago."""
    now = F.lit(now).cast("timestamp_ntz")
    return F.col("confirm_sent_at").isNull() | (
        F.col("confirm_sent_at") < now - F.make_dt_interval(mins=F.lit(minutes)))


CRITERIA = ["watch_bag", "watch_brand", "max_price"]


def upsert_watch(subs: DataFrame, asks: DataFrame, now) -> DataFrame:
    """One row per folded mailbox and criteria.

    The confirm token turns over only while unconfirmed and outside the resend window.
    """
    mail = lambda c: F.lower(F.col(c))
    asks = first_per_key(asks.withColumn("__m", mail("email")), ["__m", *CRITERIA],
                         [F.desc("ord")])
    left = subs.withColumn("__m", mail("email")).select(
        *[F.col(c).alias("__o_" + c) for c in [*subs.columns, "__m"]])
    same = F.col("__m") == F.col("__o___m")
    for c in CRITERIA:
        same = same & F.col(c).eqNullSafe(F.col("__o_" + c))
    both = left.join(asks, same, "full_outer")
    # both sides may carry sent/confirmed columns; the stored row's are the ones that count
    sent, confirmed = F.col("__o_confirm_sent_at"), F.col("__o_confirmed_at")
    lapsed = sent.isNull() | (sent < F.lit(now).cast("timestamp_ntz")
                              - F.make_dt_interval(mins=F.lit(15)))
    known = F.col("__o_id").isNotNull()
    turn = known & F.col("__m").isNotNull() & confirmed.isNull() & lapsed
    cols = []
    for c in subs.columns:
        new = F.col(c) if c in asks.columns else F.lit(None).cast(subs.schema[c].dataType)
        if c == "confirm_token":
            cols.append(F.when(turn | ~known, new).otherwise(F.col("__o_" + c)).alias(c))
        else:
            cols.append(F.when(known, F.col("__o_" + c)).otherwise(new).alias(c))
    return both.select(*cols)


def daily_cap(requests: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` requests of each requester digest."""
    ranked = numbered(requests, ["ip_hash"], [F.col("created_at"), F.col("id")],
                      F.date_trunc("hour", "created_at"), "rn")
    return ranked.where(F.col("rn") <= n).drop("rn")


def upsert_requests(requests: DataFrame, cap: int = 10) -> DataFrame:
    """One row per requester and folded brand name; repeats fill address and mailbox.

    A new name over the daily cap is refused; a repeat of an accepted name never is.
    """
    name = F.lower(F.trim("name"))
    at = F.struct("created_at", "id")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at))
    rows = requests.withColumn("__n", name).groupBy("ip_hash", "__n").agg(
        F.min_by("name", at).alias("name"), last("url").alias("url"), last("email").alias("email"),
        F.min("created_at").alias("created_at"), F.min("id").alias("id"),
        F.count(F.lit(1)).alias("asked"))
    ranked = numbered(rows, ["ip_hash"], [F.col("created_at"), F.col("id")],
                      F.date_trunc("hour", "created_at"), "rn")
    return ranked.where(F.col("rn") <= cap).drop("rn", "__n")


def confirm(subs: DataFrame, tokens: DataFrame) -> DataFrame:
    """The first confirmation time stands.  ``tokens``: (token, at)."""
    hit = tokens.groupBy(F.col("token").alias("__t")).agg(F.min("at").alias("__at"))
    return subs.join(hit, F.col("confirm_token") == F.col("__t"), "left").withColumn(
        "confirmed_at", F.coalesce("confirmed_at", "__at")).select(*subs.columns)


def unsubscribe(subs: DataFrame, sent: DataFrame, tokens: DataFrame):
    """Remove subscriptions by token, and their sent alerts with them."""
    gone = subs.join(tokens.select(F.col("token").alias("__t")).distinct(),
                     F.col("unsub_token") == F.col("__t"), "left_semi").select(
        F.col("id").alias("__id"))
    return (subs.join(gone, F.col("id") == F.col("__id"), "left_anti"),
            sent.join(gone, F.col("subscription_id") == F.col("__id"), "left_anti"))


def requester_hash(day: Column, address: Column) -> Column:
    return S.requester_digest(day, F.coalesce(F.nullif(F.trim(F.substring_index(
        address, ",", 1)), F.lit("")), F.lit("unknown")))
